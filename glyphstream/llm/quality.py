"""Quality classifier: a factorisation machine.

Features are hashed words, statistics of the text's form, and bins of these. Each
feature has a weight and a vector of RANK factors; the interactions of all pairs of a
document's features are scored in linear time, as half of the difference between the
square of the sum and the sum of the squares of its factors. It is trained by AdaGrad on
a bounded sample of labelled rows (SAMPLE_ROWS), with whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shape
from .samples import held_out, labelled
from .words import numbered, words_begin

#: Labelled documents that the model is fitted on at most.
SAMPLE_ROWS = 6000
RANK = 8
WORD_BUCKETS, BINS = 1 << 14, 16


@cache
def _is_letter() -> np.ndarray:
    """str.isalpha of each code point."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def letters_in(text: str) -> int:
    """Letters of the whole text; parts bound the memory."""
    parts = (text[at : at + 65536].encode("utf-32-le", "surrogatepass") for at in range(0, len(text), 65536))
    return sum(int(np.count_nonzero(_is_letter()[np.frombuffer(x, np.uint32)])) for x in parts)


def statistics(text: str, numbers: np.ndarray) -> list[float]:
    """Numbers of about 0 to 1 each, from the text alone."""
    n, chars = len(numbers), max(1, len(text))
    lines = max(1, text.count("\n") + 1)
    return [
        min(1.0, np.log1p(n) / 10),
        min(1.0, len(text) / max(1, n) / 16),
        min(1.0, 8 * sum(map(text.count, shape.SYMBOLS)) / chars),
        min(1.0, 2 * text.count("|") / max(1, n)),
        min(1.0, 4 * text.count("!") / chars),
        min(1.0, 8 * (text.count(".") + text.count(",")) / max(1, n)),
        letters_in(text) / chars,
        min(1.0, len(np.unique(numbers)) / max(1, n)),
        min(1.0, 4 * shape.lines_again(text) / lines),
        min(1.0, shape.words_again(numbers) / max(1, n)),
        min(1.0, np.log1p(n / lines) / 6),
        1.0 if text.isupper() else 0.0,
    ]


N_STATS = 12
SIZE = WORD_BUCKETS + N_STATS * (BINS + 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values. Words' values have the length 1 together, so long texts don't outweigh their form."""
    text = text or ""
    numbers = numbered(text.encode().split())
    at, count = np.unique((numbers % np.uint64(WORD_BUCKETS)).astype(np.int32), return_counts=True)
    value = np.sqrt(count.astype(np.float32))
    value /= max(1.0, float(np.sqrt((value**2).sum())))
    stats = np.array(statistics(text, numbers), np.float32)
    own = WORD_BUCKETS + np.arange(N_STATS, dtype=np.int32) * (BINS + 1)
    bins = own + 1 + np.minimum(BINS - 1, (stats * BINS).astype(np.int32))
    return np.concatenate([at, own, bins]), np.concatenate([value, stats, np.full(N_STATS, 0.5, np.float32)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray) -> float:
        own = self.factors[at] * value[:, None]
        return float(self.bias + self.weights[at] @ value + 0.5 * ((own.sum(0) ** 2) - (own**2).sum(0)).sum())

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, value), -30, 30))))

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]], batch: int = 128) -> np.ndarray:
        """score() of each row; `batch` rows are looked up at once."""
        out = [np.empty(0)]
        for lo in range(0, len(rows), batch):
            own = rows[lo : lo + batch]
            at, value = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
            starts = np.cumsum([0, *(len(x[0]) for x in own[:-1])])
            v = self.factors[at] * value[:, None]
            raw = self.bias + np.add.reduceat(self.weights[at] * value, starts) + 0.5 * (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v**2, starts)).sum(1)
            out.append(1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30))))
        return np.concatenate(out)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 10, rate: float = 0.1, decay: float = 1e-5, batch: int = 128) -> Machine:
    """Logistic loss by AdaGrad. Without rows of both labels the machine gives the labels' mean."""
    random = np.random.default_rng(7)
    mean = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    m = Machine(float(np.log(mean / (1 - mean))), np.zeros(SIZE, np.float32), random.normal(0, 0.01, (SIZE, RANK)).astype(np.float32))
    if not len(labels) or labels.min() == labels.max():
        m.factors[:] = 0
        return m
    g_bias, g_w, g_v = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for lo in range(0, len(order), batch):
            own = [rows[i] for i in order[lo : lo + batch]]
            y = labels[order[lo : lo + batch]]
            at, value = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
            starts = np.cumsum([0, *(len(x[0]) for x in own[:-1])])
            doc = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
            v = m.factors[at] * value[:, None]
            sums = np.add.reduceat(v, starts)
            raw = m.bias + np.add.reduceat(m.weights[at] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(v**2, starts)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y).astype(np.float32)
            e = (error[doc] * value / len(own)).astype(np.float32)
            by = np.argsort(at, kind="stable")
            ids, first = np.unique(at[by], return_index=True)
            d_w = np.add.reduceat(e[by], first) + decay * m.weights[ids]
            d_v = np.add.reduceat((e[:, None] * (sums[doc] - v))[by], first) + decay * m.factors[ids]
            g_w[ids] += d_w**2
            g_v[ids] += d_v**2
            m.weights[ids] -= rate * d_w / np.sqrt(g_w[ids])
            m.factors[ids] -= 0.5 * rate * d_v / np.sqrt(g_v[ids])
            d_b = float(error.mean())
            g_bias += d_b**2
            m.bias -= rate * d_b / np.sqrt(g_bias)
    return m


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted to the sample; only its features reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [features(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "at": [x[0].tobytes() for x in got], "value": [x[1].astype(np.float32).tobytes() for x in got]})

    sample = labelled(docs, labels, "quality", rows).mapInPandas(run, "doc_id long, label int, at binary, value binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], bytes(r["at"]), bytes(r["value"])))
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in sample], np.array([r["label"] for r in sample], np.float32))


def _scoring(machine: Machine):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        words_begin()
        return pd.Series(machine.scores([features(x) for x in texts]), dtype=float)

    return score


def score_documents(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 from the threshold on).

    docs needs text; a column score or predicted of its own is replaced, all others stay. A null
    text is scored like an empty one. Each row stands for itself.
    """
    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", _scoring(machine)("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least `threshold`, with all their columns as they are, whatever these are called."""
    return docs.where(_scoring(machine)(docs["text"]) >= threshold)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted. Labels of held-out ids are never read; a null id isn't held out."""
    out = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
