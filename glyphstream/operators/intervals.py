"""Interval algebra: islands, unions, sweeps, overlaps and as-of lookups.

Everything partitions by a key; a window sorts one key's rows, and spills. Joins of
intervals go by time buckets, so that they are equi-joins which can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], order: list[str], starts_new: Column, name: str = "island") -> DataFrame:
    """A number for each stretch of rows; starts_new may use lag() over the same window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = rows.withColumn("_new", F.when(starts_new, 1).otherwise(0))
    return flag.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_islands(rows: DataFrame, keys: list[str], time: str, gap: int, name: str = "island") -> DataFrame:
    """Islands whose neighbours are at most `gap` apart."""
    w = Window.partitionBy(*keys).orderBy(time)
    before = rows.withColumn("_before", F.lag(time).over(w))
    return islands(before, keys, [time], F.col("_before").isNull() | (F.col(time) - F.col("_before") > gap), name).drop("_before")


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "t_start", end: str = "t_end", gap: int = 0) -> DataFrame:
    """Union of closed intervals per key; those at most `gap` apart are one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = rows.withColumn("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = islands(before, keys, [start, end], F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_parts")).drop("island")


def occupancy(rows: DataFrame, keys: list[str], start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Time covered by the union of a key's intervals, the span from first to last, and their share."""
    one = merge_intervals(rows, keys, start, end).groupBy(*keys).agg(
        F.sum(F.col(end) - F.col(start)).alias("occupied_us"), (F.max(end) - F.min(start)).alias("span_us"), F.count("*").alias("n_islands")
    )
    return one.withColumn("share", F.when(F.col("span_us") > 0, F.col("occupied_us") / F.col("span_us")).otherwise(F.lit(0.0)))


def covered_windows(rows: DataFrame, width: int, start: str = "t_start", end: str = "t_end") -> DataFrame:
    """A row for each window of time that an interval truly covers a part of."""
    last = F.greatest(F.col(start), F.col(end) - 1)
    return rows.withColumn("window_id", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def sweep(rows: DataFrame, keys: list[str], item: str, start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Segments between neighbouring bounds with the items on in each; neighbours with equal items are one.

    Each item is spread over the elementary segments it covers, by rank of the bounds, which is
    an equi-join on the key and the segment's number.
    """
    bounds = rows.select(*keys, F.explode(F.array(start, end)).alias("t")).distinct()
    w = Window.partitionBy(*keys).orderBy("t")
    segments = bounds.select(*keys, F.col("t").alias("s"), F.lead("t").over(w).alias("e"), F.row_number().over(w).alias("k")).where("e is not null")
    at_start = segments.select(*keys, F.col("s").alias(start), F.col("k").alias("k0"))
    at_end = segments.select(*keys, F.col("e").alias(end), F.col("k").alias("k1"))
    spread = rows.where(F.col(end) > F.col(start)).join(at_start, [*keys, start]).join(at_end, [*keys, end])
    spread = spread.select(*keys, item, F.explode(F.sequence("k0", "k1")).alias("k"))
    on = spread.groupBy(*keys, "k").agg(F.array_sort(F.collect_set(item)).alias("items"))
    full = segments.join(on, [*keys, "k"])
    order = Window.partitionBy(*keys).orderBy("s")
    full = full.withColumns({"_items": F.lag("items").over(order), "_e": F.lag("e").over(order)})
    full = islands(full, keys, ["s"], F.col("_items").isNull() | (F.col("_items") != F.col("items")) | (F.col("_e") != F.col("s")))
    return full.groupBy(*keys, "island").agg(F.min("s").alias("seg_start"), F.max("e").alias("seg_end"), F.first("items").alias("items")).drop("island")


def merge_growing(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of sweep() that follow each other and only gain items are one, with the last one's items."""
    w = Window.partitionBy(*keys).orderBy("seg_start")
    rows = segments.withColumns({"_i": F.lag("items").over(w), "_e": F.lag("seg_end").over(w)})
    grows = (F.col("_e") == F.col("seg_start")) & (F.size(F.array_except("_i", "items")) == 0) & (F.size("_i") < F.size("items"))
    rows = islands(rows, keys, ["seg_start"], F.coalesce(~grows, F.lit(True)))
    return rows.groupBy(*keys, "island").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.max_by("items", "seg_start").alias("items"), F.count("*").alias("n_steps")).drop("island")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of a (t_start, t_end) and b (u_start, u_end) that overlap, each pair once: it counts in the bucket its overlap begins in."""
    spread = lambda df, s, e: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    pairs = spread(a, "t_start", "t_end").join(spread(b, "u_start", "u_end"), [*keys, "_bucket"])
    begin = F.greatest("t_start", "u_start")
    shared = F.least("t_end", "u_end") - begin
    return pairs.where((shared > 0) & (F.floor(begin / bucket) == F.col("_bucket"))).withColumn("overlap_us", shared).drop("_bucket")


def best_overlap(pairs: DataFrame, of: list[str], ties: list[str]) -> DataFrame:
    """The pair of each row with most overlap; ties by the given columns."""
    w = Window.partitionBy(*of).orderBy(F.desc("overlap_us"), *ties)
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def asof(rows: DataFrame, facts: DataFrame, keys: list[str], time: str, value: str, backward: bool = True) -> DataFrame:
    """rows with the value of the last fact at or before (or first at or after) each time; one sort of both together, no join."""
    own = rows.withColumns({"_fact": F.lit(0), "_value": F.lit(None).cast(facts.schema[value].dataType)})
    more = facts.select(*keys, time, F.lit(1).alias("_fact"), F.col(value).alias("_value"))
    both = own.unionByName(more, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    if backward:
        w = w.orderBy(F.col(time), F.desc("_fact")).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = w.orderBy(F.col(time).desc(), F.desc("_fact")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_fact = 0").drop("_fact", "_value")


def alternations(a: DataFrame, b: DataFrame, keys: list[str], start: str = "t_start") -> DataFrame:
    """How often the source changes if both lists are read in order of their starts."""
    both = a.select(*keys, start, F.lit("a").alias("src")).unionByName(b.select(*keys, start, F.lit("b").alias("src")))
    w = Window.partitionBy(*keys).orderBy(start, "src")
    return both.withColumn("_p", F.lag("src").over(w)).groupBy(*keys).agg(F.count_if(F.col("_p") != F.col("src")).alias("n_alternations"))
