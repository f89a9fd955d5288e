"""Connected components of links between ids, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def _least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v) with m, the least of u and all v, and the table of the minima.

    Minima are aggregated before the shuffle and written, so the join has a plain table of one row
    a node on one side: small ones are broadcast by size, and of large ones Spark splits the
    partition of a hub (a u with very many v) over several tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    least = cut(least, "least", tidy=False)
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u"), least


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, component): for each id in an edge the least id reachable.

    Rounds of large star (each node's larger neighbours are led to its least one) and
    small star (its smaller neighbours are) until nothing changes; edges only ever get
    fewer, and each round's table is written, so lineage stays short.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", tidy=False)
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both, least = _least(both)
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "edges", tidy=False)
        drop(now, least)
        pairs, least = _least(large)
        small = pairs.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = cut(small, "edges", tidy=False)
        drop(large, least)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("id"), "component").distinct())
