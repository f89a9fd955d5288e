"""Times in whole microseconds, sampling grids and exact ranks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

SECOND = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400
    return (day + F.hour(ts) * 3600 + F.minute(ts) * 60) * SECOND + (F.extract(F.lit("SECOND"), ts) * SECOND).cast("long")




def srt_time(us: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds rounded down."""
    ms = F.floor(us / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_time(us: Column, up: bool) -> Column:
    """H:MM:SS.cc; starts round up and ends down, so that neighbours don't cross."""
    cs = F.ceil(us / 10_000) if up else F.floor(us / 10_000)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def grid_frame(k: Column, p: int, q: int) -> Column:
    """The k-th frame of a grid that samples p of q frames: the ceiling of k * q / p, in whole numbers."""
    return (-F.floor(-(k * q) / p)).cast("long")


def in_grid(frame: Column, p: int, q: int) -> Column:
    """Whether a frame is on the grid: some k has its ceiling there."""
    k = F.floor(frame * p / q)
    return (grid_frame(k, p, q) == frame) | (grid_frame(k + 1, p, q) == frame)


# An approximate rank is off by at most one row in so many.
ACCURACY = 5000


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """keys and the number at the half-even rounded rank q * (n - 1) of each group.

    Approximate ranks around q cut each group in three; the rows of each part are counted, and
    only the values of the part that has the rank are told apart and ordered. The counts decide
    which part that is, so the result is exact wherever the cuts fall.
    """
    v, w = F.col(value), Window.partitionBy(*keys)
    rows = rows.where(v.isNotNull()).select(*keys, value)
    same = lambda t: reduce(and_, (F.col(k).eqNullSafe(t[f"_{k}"]) for k in keys))
    around = [max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(v, around, ACCURACY).alias("_p")).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_p")[0].alias("_lo"), F.col("_p")[1].alias("_hi"))
    cuts = written(cuts, "cuts")
    part = F.when(v < F.col("_lo"), 0).when(v <= F.col("_hi"), 1).otherwise(2)
    parts = rows.join(cuts, same(cuts)).groupBy(*keys, "_lo", "_hi", part.alias("_part")).agg(F.count("*").alias("_c"))
    parts = parts.withColumns({"_rank": F.bround(q * (F.sum("_c").over(w) - 1)), "_before": F.sum("_c").over(w.orderBy("_part")) - F.col("_c")})
    parts = parts.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    parts = written(parts.select(*(F.col(k).alias(f"_{k}") for k in keys), "_lo", "_hi", "_part", (F.col("_rank") - F.col("_before")).alias("_rest")), "parts")
    counts = rows.join(parts, same(parts)).where(part == F.col("_part")).groupBy(*keys, value).agg(F.count("*").alias("_c"), F.first("_rest").alias("_rest"))
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return counts.where(F.col("_upto") > F.col("_rest")).groupBy(*keys).agg(F.min(value).alias(name))
