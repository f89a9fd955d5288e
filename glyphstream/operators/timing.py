"""Timing audits of subtitle items: starts dragged by one member, and speeds and dwells that stand out from their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Fixed values of the audits.
DRAG_US = 1_500_000
REVEAL_RATIO, DWELL_RATIO = 3.0, 4.0
LEAST_CHARS, LEAST_DWELL_US = 8, 3_000_000
REACH, LEAST_NEAR, LEAST_ITEMS = 5, 3, 5


def dragged_starts(members: DataFrame, keys: list[str], gap: int = DRAG_US) -> DataFrame:
    """keys, first_id, next_id, gap_us: items whose first member stands alone for `gap` or longer before another row begins.

    members: keys (of the item), id, t_start, t_full (may be null: then t_start), item_start, box.
    The first member is the earliest, by id where starts are equal; it is whole at t_full but not
    before item_start. Items with a single member, or with a single row, never count.
    """
    w = Window.partitionBy(*keys)
    lead = F.min(F.struct("t_start", "id", "t_full", "item_start", "box")).over(w)
    rest = members.withColumn("_first", lead).where(F.col("id") != F.col("_first.id")).where(~G.same_row(F.col("_first.box"), F.col("box")))
    one = rest.groupBy(*keys).agg(F.min(F.struct("t_start", "id")).alias("_next"), F.first("_first").alias("_first"))
    whole = F.greatest(F.coalesce("_first.t_full", "_first.t_start"), F.col("_first.item_start"))
    wait = F.col("_next.t_start") - whole
    return one.select(*keys, F.col("_first.id").alias("first_id"), F.col("_next.id").alias("next_id"), wait.alias("gap_us")).where(F.col("gap_us") >= gap)


def outliers(rows: DataFrame, keys: list[str], order: list[str], value: str, ratio: float, both: bool, reach: int = REACH, near: int = LEAST_NEAR, least: int = LEAST_ITEMS) -> DataFrame:
    """Rows whose value is over `ratio` times the median of the `reach` rows before and after (or under a `ratio`-th of it, if both), with that median.

    Where a row has fewer than `near` neighbours the median of all rows takes its place; with fewer
    than `least` rows in all nothing stands out. Null values are left out first.
    """
    rows = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(*order)
    around = F.array_sort(F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.collect_list(value).over(w.rowsBetween(1, reach))))
    seen = rows.withColumn("_near", around).withColumn("_n", F.size("_near"))
    low, high = F.get("_near", F.floor((F.col("_n") - 1) / 2).cast("int")), F.get("_near", F.floor(F.col("_n") / 2).cast("int"))
    every = rows.agg(F.count("*").alias("_rows"), F.percentile(value, 0.5).alias("_mid"))
    seen = seen.crossJoin(F.broadcast(every)).withColumn("median", F.when(F.col("_n") >= near, (low + high) / 2.0).otherwise(F.col("_mid")))
    odd = F.col(value) > ratio * F.col("median")
    if both:
        odd |= F.col(value) * ratio < F.col("median")
    return seen.where((F.col("_rows") >= least) & (F.col("median") > 0) & odd).drop("_near", "_n", "_rows", "_mid")


def reveal_outliers(lines: DataFrame, keys: list[str], order: list[str], chars: int = LEAST_CHARS) -> DataFrame:
    """Lines shown letter by letter much slower or faster than their neighbours, with us_a_char and side; lines: keys, order, n_chars, reveal_us."""
    speed = F.col("reveal_us") / (F.col("n_chars") - 1)
    rows = lines.where((F.col("reveal_us") > 0) & (F.col("n_chars") >= chars)).withColumn("us_a_char", speed)
    found = outliers(rows, keys, order, "us_a_char", REVEAL_RATIO, True)
    return found.withColumn("side", F.when(F.col("us_a_char") > F.col("median"), "slow").otherwise("fast"))


def dwell_outliers(items: DataFrame, keys: list[str], order: list[str], chars: int = LEAST_CHARS, dwell: int = LEAST_DWELL_US) -> DataFrame:
    """Items that stay much longer a letter than their neighbours once whole, for `dwell` at least; items: keys, order, n_chars, t_end, shown."""
    rest = F.col("t_end") - F.col("shown")
    rows = items.where(F.col("n_chars") >= chars).withColumn("us_a_char", rest / F.col("n_chars"))
    return outliers(rows, keys, order, "us_a_char", DWELL_RATIO, False).where(rest >= dwell)
