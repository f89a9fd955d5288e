"""Audits: outliers against neighbours, robust lines, multiset differences, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbour_outliers(rows: DataFrame, keys: list[str], order: list[str], value: str, reach: int = 5, ratio: float = 3.0) -> DataFrame:
    """Rows whose value is over `ratio` times, or under a `ratio`-th of, the median of the `reach` values before and after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.collect_list(value).over(w.rowsBetween(1, reach)))
    rows = rows.withColumn("_near", F.array_sort(near)).withColumn("_n", F.size("_near"))
    lo, hi = F.get("_near", F.floor((F.col("_n") - 1) / 2).cast("int")), F.get("_near", F.floor(F.col("_n") / 2).cast("int"))
    rows = rows.withColumn("neighbour_median", (lo + hi) / 2.0).drop("_near")
    odd = (F.col(value) > ratio * F.col("neighbour_median")) | (F.col(value) * ratio < F.col("neighbour_median"))
    return rows.where((F.col("_n") >= reach) & odd).drop("_n")


def theil_sen(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median of the slopes of all pairs of a key's points, not below 0, and the median rest. For keys with few points each."""
    a = points.select(*keys, F.col(x).alias("_x0"), F.col(y).alias("_y0"))
    b = points.select(*keys, F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    pairs = a.join(b, keys).where("_x1 > _x0").withColumn("_s", (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0")))
    slope = pairs.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.percentile("_s", 0.5)).alias("slope"), F.count("*").alias("n_pairs"))
    rest = points.join(slope, keys).groupBy(*keys).agg(F.first("slope").alias("slope"), F.first("n_pairs").alias("n_pairs"), F.percentile(F.col(y) - F.col("slope") * F.col(x), 0.5).alias("intercept"))
    return rest


def multiset_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b, once for each time that one side has them more often."""
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("gained")))


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """2 * rows in both / rows of either, as multisets."""
    both = a.intersectAll(b).agg(F.count("*").alias("n_both"))
    return both.crossJoin(a.agg(F.count("*").alias("n_a"))).crossJoin(b.agg(F.count("*").alias("n_b"))).withColumn("dice", 2 * F.col("n_both") / (F.col("n_a") + F.col("n_b")))


def violations(events: DataFrame, regions: DataFrame) -> DataFrame:
    """(rule, n): ids that repeat, ends before starts, events of unknown regions."""
    again = events.groupBy("id").count().where("count > 1").select(F.lit("id repeats").alias("rule"))
    late = events.where("t_end < t_start").select(F.lit("end before start").alias("rule"))
    lost = events.join(regions, "region", "left_anti").select(F.lit("unknown region").alias("rule"))
    return again.unionByName(late).unionByName(lost).groupBy("rule").agg(F.count("*").alias("n"))


def concurrency(items: DataFrame, keys: list[str], step: int, start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Items on at each sample; summed from +1 and -1 at the first samples in and after each item, not by listing all samples."""
    first, after = F.ceil(F.col(start) / step), F.ceil(F.col(end) / step)
    rows = items.where(after > first)
    marks = rows.select(*keys, first.alias("k"), F.lit(1).alias("d")).unionByName(rows.select(*keys, after.alias("k"), F.lit(-1).alias("d")))
    marks = marks.groupBy(*keys, "k").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("k")
    marks = marks.withColumns({"on": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("k").over(w)})
    return marks.groupBy(*keys).agg(F.max("on").alias("most"), F.sum(F.when(F.col("on") >= 2, F.col("next") - F.col("k")).otherwise(0)).alias("n_crowded"))
