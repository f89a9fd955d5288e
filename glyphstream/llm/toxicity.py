"""Toxicity by maximum-scoring segments.

Tokens are words and the beginnings of words, so that inflected and unseen forms share
what is known of their stem. A token's score is its log-odds between toxic and other
labelled documents, with an informative Dirichlet prior (the counts of both together),
and nothing where that is below Z_LEAST standard errors or below EFFECT. A word scores like the token of it
that is surest. All other words cost DRIFT, so that the expected score is negative. A linear scan finds every maximal segment of a
text. Scores of the best segments of random text follow an extreme-value law; its
parameters, taken from the labelled documents that aren't toxic, turn a segment's score
and the text's length into the number of such segments expected by chance, and a
logistic curve over the sum turns this into the document's score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, labelled
from .store import cut
from .words import PLAIN, numbered

#: Labelled documents that are used at most; three quarters give log-odds, the rest calibrate.
SAMPLE_ROWS = 16000
#: A passage is significant if chance gives fewer than this many of its score in a text of the length.
LEVEL = 0.01
PRIOR, Z_LEAST, LEAST_DOCS, DRIFT = 0.05, 4.0, 5, 0.05
#: Log-odds below this aren't evidence, however sure they are.
EFFECT = 3.0
#: Letters of a word's beginnings that are tokens of their own.
STEMS = (3, 4, 5, 6)
WORDS_KEPT = 150_000


def words_of(text: str | None) -> list[bytes]:
    return PLAIN.findall((text or "").lower().encode())


def tokens_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings with a mark that no word has."""
    letters = word.decode()
    return [word, *(b"^" + letters[:n].encode() for n in STEMS if n < len(letters))]


class Scores(dict):
    """Word to score by its surest token."""

    def __init__(self, lexicon: dict[int, tuple[float, float]]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) >= WORDS_KEPT:
            self.clear()
        known = [x for x in map(self.lexicon.get, numbered(tokens_of(word)).tolist()) if x]
        got = self[word] = max(known, key=lambda x: abs(x[1]))[0] if known else -DRIFT
        return got


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each token's counts in two classes, and their z: the prior is the share `prior` of both classes' counts together."""
    alpha = prior * (toxic + other)
    n_t, n_o, a = toxic.sum() + alpha.sum(), other.sum() + alpha.sum(), toxic + alpha
    b = other + alpha
    delta = np.log(a / np.maximum(n_t - a, 1e-9)) - np.log(b / np.maximum(n_o - b, 1e-9))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past last, score), in linear time.

    Each has no part that scores more, and isn't part of a longer one with that property. A stack
    holds candidates with the sums before and after each; a new one is joined to the last whose
    sum before is lower, as long as that one's sum after is lower as well.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, past, sum before, sum after
    total, done = 0.0, 0
    for at in np.flatnonzero(scores > 0).tolist():
        total += float(scores[done:at].sum())
        before, after, first = total, total + float(scores[at]), at
        total, done = after, at + 1
        while stack:
            k = len(stack) - 1
            # Candidates whose sum before isn't lower can't begin a longer segment with this one.
            while k >= 0 and stack[k][2] >= before:
                k -= 1
            if k < 0 or stack[k][3] >= after:
                break
            first, before = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, at + 1, before, after))
    return [(first, past, after - before) for first, past, before, after in stack]


@dataclass
class Model:
    """lexicon: score and z by token number. lam, log_k: of the extreme-value law. curve: of the logistic."""

    lexicon: dict[int, tuple[float, float]] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] = (-3.0, 1.0)

    def __post_init__(self) -> None:
        self.scores = Scores(self.lexicon)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "scores"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.scores = Scores(self.lexicon)

    def spans(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        return len(words), segments(np.fromiter(map(self.scores.__getitem__, words), np.float64, len(words)))

    def scores_of(self, text: str | None) -> dict[float, int]:
        return dict(Counter(round(self.scores[w], 2) for w in words_of(text)))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum over segments of how far each is above the law's mode for a text of n tokens, as softened excess."""
        mode = self.log_k + math.log(max(n, 1))
        return sum(float(np.logaddexp(0, self.lam * s - mode)) for _, _, s in found)

    def score(self, text: str | None) -> float:
        n, found = self.spans(text)
        x = self.curve[0] + self.curve[1] * math.log1p(self.evidence(n, found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _law(values: np.ndarray, weights: np.ndarray) -> float:
    """The lambda > 0 at which the mean of exp(lambda * score) is 1, by bisection; 1 if no score is positive."""
    if not (values > 0).any() or (values * weights).sum() >= 0:
        return 1.0
    lo, hi = 1e-3, 1.0
    mean = lambda x: float((weights * np.exp(np.minimum(x * values, 700))).sum() / weights.sum())
    while mean(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return max(hi, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a weak ridge; the slope isn't negative."""
    w = np.array([-2.0, 1.0])
    z = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.01 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), grad)
        w -= np.clip(step, -3, 3)
    return float(w[0]), max(0.0, float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Log-odds from three quarters of the sample, calibration from the rest. Without both labels, no token scores."""
    half = F.when(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4)) == 0, 1).otherwise(0)
    sample = labelled(docs, labels, "toxic", rows).withColumn("half", half)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [np.unique(numbered([t for w in words_of(x) for t in tokens_of(w)]), return_counts=True) for x in batch["text"]]
            size = [len(x[0]) for x in got]
            yield pd.DataFrame(
                {
                    "token": np.concatenate([x[0] for x in got]).view(np.int64) if got else [],
                    "n": np.concatenate([x[1] for x in got]) if got else [],
                    "label": np.repeat(batch["label"].to_numpy(), size),
                }
            )

    tokens = sample.where("half = 0").mapInPandas(count, "token long, n long, label int").groupBy("token")
    # Written, as two sums are read off it; the sample's tokens bound it.
    sums = tokens.agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("other"),
        F.count("*").alias("docs"),
    )
    sums = cut(sums, "token-sums")
    # The sample is bounded, and by it the tokens that at least LEAST_DOCS of its documents have.
    own = sums.where(F.col("docs") >= LEAST_DOCS).toPandas()
    rest = sums.where(F.col("docs") < LEAST_DOCS).agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    if not len(own) or not own["toxic"].sum() or not own["other"].sum():
        return Model()
    toxic = np.append(own["toxic"].to_numpy(float), rest["t"] or 0.0)
    other = np.append(own["other"].to_numpy(float), rest["o"] or 0.0)
    delta, z = log_odds(toxic, other)
    delta, z = delta[:-1], z[:-1]
    names = own["token"].to_numpy(np.int64).view(np.uint64)
    keep = np.flatnonzero((np.abs(z) >= Z_LEAST) & (np.abs(delta) >= EFFECT))
    keep = keep[np.lexsort((names[keep], -np.abs(z[keep])))]
    model = Model({int(names[i]): (float(max(delta[i], -1.0)), float(z[i])) for i in keep})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [model.spans(x) for x in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "n": [x[0] for x in got], "best": [[s for _, _, s in x[1]] for x in got], "each": [model.scores_of(x) for x in batch["text"]]})

    seen = sample.where("half = 1").mapInPandas(scan, "label int, n long, best array<double>, each map<double,long>").toPandas()
    calm = seen[(seen["label"] == 0) & (seen["n"] > 0)]
    if len(calm):
        # A word's scores by how often they stand in calm documents.
        often: Counter[float] = Counter()
        for own_scores in calm["each"]:
            often.update(dict(own_scores))
        values = np.array(sorted(often))
        model.lam = _law(values, np.array([often[v] for v in values.tolist()], float))
        most = np.array([max(x, default=0.0) for x in calm["best"]])
        # The mode of the largest of n tokens is at log(K n) / lambda; its mean lies 0.5772 / lambda above.
        model.log_k = float(np.mean(model.lam * most - np.log(calm["n"].to_numpy(float)))) - 0.5772
    x = np.array([math.log1p(model.evidence(int(n), [(0, 0, s) for s in best])) for n, best in zip(seen["n"], seen["best"], strict=True)])
    y = (seen["label"].to_numpy() == 1).astype(float)
    order = np.lexsort((y, x))
    if len(y) and 0 < y.sum() < len(y):
        model.curve = _logistic(x[order], y[order])
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score, predicted and toxic_spans (first word, one past the last, score; those of which chance gives fewer than LEVEL in a text of the length).

    docs needs text; columns of the result's names are replaced, others stay. A null text is empty:
    no segments, and the score of no evidence. Each row stands for itself.
    """
    docs = docs.drop("score", "predicted", "toxic_spans", "_scored")

    @F.pandas_udf("score double, spans array<struct<first_word:long,past_word:long,score:double>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        scores, spans = [], []
        for text in texts:
            n, found = model.spans(text)
            x = model.curve[0] + model.curve[1] * math.log1p(model.evidence(n, found))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
            least = (model.log_k + math.log(max(n, 1)) - math.log(LEVEL)) / model.lam
            spans.append([{"first_word": a, "past_word": b, "score": s} for a, b, s in found if s >= least])
        return pd.DataFrame({"score": scores, "spans": spans})

    out = docs.withColumn("_scored", scan("text"))
    return out.withColumns(
        {"score": F.col("_scored.score"), "predicted": (F.col("_scored.score") >= threshold).cast("int"), "toxic_spans": F.col("_scored.spans")}
    ).drop("_scored")


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted. Labels of held-out ids are never read; a null id isn't held out."""
    out = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
