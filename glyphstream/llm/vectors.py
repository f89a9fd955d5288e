"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) that differ from each other are taken from a bounded sample.
A vector is described by its NEAREST nearest pivots in order. The index is inverted: each
pair of a vector's pivots leads to a list of the vectors that have both, so vectors that
share at least two pivots meet; how many they share is counted when a pair is verified,
and a pair is verified only in the list of the first two pivots that it shares. Lists are
cut into blocks of BLOCK vectors, a task takes two blocks, multiplies them, and returns
counts for each vector and a spanning forest, never pairs. Equal vectors enter once.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components
from .neardup import _forest
from .store import cut

#: Rows that pivots are chosen from at most; pivots, at least and at most; pivots of a vector; rows of a block and of a task's small lists.
SAMPLE, LEAST_PIVOTS, MOST_PIVOTS, NEAREST, BLOCK, UNIT = 2048, 64, 4096, 5, 1024, 4096


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Unit vectors of the sample in its order, each with a cosine below 0.5 to all before it."""
    out = np.empty((0, sample.shape[1]))
    for x in sample / np.linalg.norm(sample, axis=1, keepdims=True):
        if len(out) == wanted:
            break
        if not len(out) or (out @ x).max() < 0.5:
            out = np.vstack([out, x])
    return out


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first; ties go to the lower number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :NEAREST]


def lists_of(top: np.ndarray) -> list[int]:
    """A number for each pair of the pivots; for fewer than two pivots one list of all."""
    own = sorted(top.tolist())
    return [a * MOST_PIVOTS + b for a, b in combinations(own, 2)] or [-1]


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of sorted pivots, the list of the first two that both have; -1 if there are fewer than two pivots at all."""
    if a.shape[1] < 2:
        return np.full(len(a), -1)
    shared = (a[:, :, None] == b[:, None, :]).any(2)
    first = shared.argmax(1)
    rest = shared.copy()
    rest[np.arange(len(a)), first] = False
    row = np.arange(len(a))
    return a[row, first].astype(np.int64) * MOST_PIVOTS + a[row, rest.argmax(1)]


def verify(vectors: np.ndarray, top: np.ndarray, list_: int, left: np.ndarray, right: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows that are verified in this list: within left, or between left and right."""
    other = left if right is None else right
    norm = np.sqrt((vectors**2).sum(1))
    close = (vectors[left] @ vectors[other].T) / np.outer(norm[left], norm[other]) >= least
    a, b = np.nonzero(np.triu(close, 1) if right is None else close)
    a, b = left[a], other[b]
    if len(a):
        mine = np.concatenate([_first_shared(top[a[k : k + 65536]], top[b[k : k + 65536]]) == list_ for k in range(0, len(a), 65536)])
        a, b = a[mine], b[mine]
    return a, b


def _classes(vectors: DataFrame) -> DataFrame:
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    good = good & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumns(
        {"h1": F.xxhash64(F.lit(1), "label", "embedding"), "h2": F.xxhash64(F.lit(2), "embedding", "label")}
    )


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row.

    vectors needs vec_id, embedding and label; other columns are dropped. Vectors are compared
    if label and length are equal. A row whose id, label or vector is null, or whose vector is
    empty, zero, or holds a null or a value that isn't finite, is linked with nothing: its
    component is its own id, and it is kept. Rows that repeat are linked with each other. Rows
    with one id are one node.
    """
    rows = _classes(vectors)
    classes = cut(
        rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "vectors",
    )
    n = classes.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << math.ceil(math.log2(max(1.0, math.sqrt(n) / 2)))))
    sample = classes.select("h1", "h2", "embedding").orderBy("h1", "h2").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["embedding"]), []).append(r["embedding"])
    pivots = {size: choose_pivots(np.array(own), wanted) for size, own in by_size.items()}

    def describe(batches):
        for batch in batches:
            tops, lists = [], []
            for x in batch["embedding"]:
                own = pivots.get(len(x))
                top = np.empty(0, np.int64) if own is None or len(own) < 2 else nearest_pivots(np.asarray(x)[None], own)[0]
                tops.append(np.sort(top).astype(np.int32))
                lists.append(lists_of(top))
            yield batch.assign(top=tops, lists=lists)

    fields = "h1 long, h2 long, rep long, copies long, label string, embedding array<double>"
    told = classes.withColumn("label", F.col("label").cast("string")).select("h1", "h2", "rep", "copies", "label", "embedding")
    told = cut(told.mapInPandas(describe, fields + ", top array<int>, lists array<long>"), "described")
    one = told.select("h1", "h2", "rep", F.xxhash64("label", F.size("embedding")).alias("_kind"), F.explode("lists").alias("list"))
    sizes = one.groupBy("_kind", "list").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = one.join(sizes.select("_kind", "list", blocks.alias("blocks")), ["_kind", "list"])
    met = met.withColumn("own", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = cut(met.select("h1", "h2", "_kind", "list", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "lists")
    units = max(1, -(-met.count() // UNIT))
    full = met.join(told.select("h1", "h2", "rep", "copies", "embedding", "top"), ["h1", "h2"])
    full = full.withColumn("unit", F.pmod(F.xxhash64("_kind", "list", "i", "j"), F.lit(units)))

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int | None, int, int, int]] = []
        for (_, list_, i, j), own in batch.groupby(["_kind", "list", "i", "j"], sort=False):
            x = np.array(own["embedding"].tolist(), float)
            top = np.array(own["top"].tolist(), np.int64).reshape(len(own), -1)
            side, copies = own["own"].to_numpy(), own["copies"].to_numpy()
            left, right = np.flatnonzero(side == i), None if i == j else np.flatnonzero(side == j)
            a, b = verify(x, top, list_, left, right, least)
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(own)) + np.bincount(b, copies[a], len(own))
            rep, h1, h2 = own["rep"].to_numpy(), own["h1"].to_numpy(), own["h2"].to_numpy()
            order = np.argsort(rep, kind="stable")
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own))
            tops = _forest(len(own), place[a], place[b])
            for k in np.flatnonzero(links).tolist():
                out.append((int(h1[k]), int(h2[k]), int(rep[k]), int(rep[order[tops[place[k]]]]), int(links[k])))
        return pd.DataFrame(out, columns=["h1", "h2", "rep", "least", "links"]).astype(np.int64)

    found = cut(full.groupBy("unit").applyInPandas(run, "h1 long, h2 long, rep long, least long, links long"), "verified")
    group = components(found.select("rep", "least"), "rep", "least").select(F.col("id").alias("rep"), "component")
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    known = classes.select("h1", "h2", "rep", "copies").join(links, ["h1", "h2"], "left").join(group, "rep", "left")
    known = known.where("copies > 1 or links is not null or component is not null").withColumn("good", F.lit(True))
    out = rows.select("vec_id", "good", "h1", "h2").join(known, ["h1", "h2", "good"], "left")
    out = out.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
