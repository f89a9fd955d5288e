"""Connected components of small graphs between regions, lines or cues, and what a node reaches along directed edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed, written

# Edges that one task takes (some 200 bytes each).
ONE_TASK = 500_000


def _joined(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, component) of the ids of at most ONE_TASK edges, by a disjoint set in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[tuple, tuple] = {}

        def root(x: tuple) -> tuple:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for b in batches:
            *k, a, z = (c.to_pylist() for c in b.columns)
            for key, p, q in zip(zip(*k, strict=True) if k else [()] * len(a), a, z, strict=True):
                p, q = root((key, p)), root((key, q))
                # The lesser id stays on top, so a root is the least of its component.
                if p != q:
                    up[p if p[1] > q[1] else q] = p if p[1] < q[1] else q
        kinds = [*(b.type for b in empty), empty[-1].type]
        ids = list(up)
        for i in range(0, len(ids), 10_000):
            some = ids[i : i + 10_000]
            columns = [*zip(*(x[0] for x in some), strict=True), [x[1] for x in some], [root(x)[1] for x in some]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [*keys, "id", "component"])

    flat = edges.select(*keys, "a", "b")
    empty = [pa.array([], f.type) for f in flat.drop("b").limit(0).toArrow().schema]
    out = flat.select(*keys, F.col("a").alias("id"), F.col("b").alias("component")).schema
    return flat.coalesce(1).mapInArrow(run, out)


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], rounds: int = 40) -> DataFrame:
    """nodes (keys, id) with component, the least id reachable within the key.

    Up to ONE_TASK different edges are joined in one task. More go in rounds over the cluster:
    labels halve their distance each round by jumping. Nodes without an edge take part in neither.
    """
    edges = edges.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    if edges.count() <= ONE_TASK:
        found = _joined(edges, keys)
    else:
        ends = edges.select(*keys, F.col("a").alias("id")).unionByName(edges.select(*keys, F.col("b").alias("id"))).distinct()
        found = _rounds(ends, edges, keys, rounds)
    found = found.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("id").alias("_id"), "component")
    same = reduce(and_, (F.col(k) == F.col(f"_{k}") for k in [*keys, "id"]))
    return nodes.select(*keys, "id").join(found, same, "left").select(*keys, "id", F.coalesce("component", "id").alias("component"))


def _rounds(nodes: DataFrame, edges: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    both = edges.select(*keys, F.col("a").alias("id"), F.col("b").alias("near")).unionByName(edges.select(*keys, F.col("b").alias("id"), F.col("a").alias("near"))).distinct()
    now = checkpointed(nodes.select(*keys, "id", F.col("id").alias("component")))
    for _ in range(rounds):
        seen = both.join(now.select(*keys, F.col("id").alias("near"), "component"), [*keys, "near"]).groupBy(*keys, "id").agg(F.min("component").alias("_c"))
        after = now.join(seen, [*keys, "id"], "left").withColumn("component", F.least("component", "_c")).drop("_c")
        jump = now.select(*keys, F.col("id").alias("component"), F.col("component").alias("_j"))
        after = checkpointed(after.join(jump, [*keys, "component"], "left").withColumn("component", F.least("component", "_j")).select(*keys, "id", "component"))
        changed = after.exceptAll(now).limit(1).count()
        now = after
        if not changed:
            return now
    raise RuntimeError("components did not settle")


def reach(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (root, node, depth): for each a all that it reaches, itself included, with the fewest steps.

    A round goes one step on from what the last one found; the rounds end when one finds nothing new.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    front = every = checkpointed(edges.select(F.col("a").alias("root"), F.col("a").alias("node")).distinct().withColumn("depth", F.lit(0)))
    step = 0
    while not front.isEmpty():
        step += 1
        onto = front.join(edges, front["node"] == edges["a"]).select("root", F.col("b").alias("node")).distinct()
        front = checkpointed(onto.join(every, ["root", "node"], "left_anti").withColumn("depth", F.lit(step)))
        every = every.unionByName(front)
        if step % 16 == 0:
            every = checkpointed(every)
    return every
