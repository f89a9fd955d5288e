"""Regions of the screen: features, labels, the main track, and text that belongs to the interface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import nearest_rank
from .intervals import covered_windows, occupancy


def persistent_lines(lines: DataFrame, keys: list[str], cue: str, text: str, least_share: float, most_chars: int, least_cues: int) -> DataFrame:
    """Short lines found in at least `least_share` of a key's cues, of which there are at least `least_cues`."""
    total = lines.groupBy(*keys).agg(F.count_distinct(cue).alias("n_cues")).where(F.col("n_cues") >= least_cues)
    own = lines.where(F.length(text) <= most_chars).groupBy(*keys, text).agg(F.count_distinct(cue).alias("n_in"))
    return own.join(total, keys).withColumn("share", F.col("n_in") / F.col("n_cues")).where(F.col("share") >= least_share)


def features(runs: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """A region's count, distinct texts, sharp percentiles of length and duration, and the windows it covers out of its span."""
    runs = runs.withColumns({"_dur": F.col("t_end") - F.col("t_start"), "_len": F.length("text")})
    one = runs.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        F.count_distinct("text").alias("n_texts"),
        F.avg("conf").alias("mean_conf"),
        F.max("conf").alias("max_conf"),
    )
    seen = covered_windows(runs, window_us).groupBy(*keys).agg(F.count_distinct("window_id").alias("n_windows"), (F.max("window_id") - F.min("window_id") + 1).alias("window_span"))
    one = one.join(nearest_rank(runs, keys, "_dur", 0.5, "dur_p50"), keys).join(nearest_rank(runs, keys, "_len", 0.9, "len_p90"), keys)
    return one.join(seen, keys).withColumn("persistence", F.col("n_windows") / F.col("window_span"))


def label(n_runs: Column, persistence: Column, texts_share: Column) -> Column:
    """noise: too few runs; ui: always there with few texts; sparse: seldom there; else dialogue."""
    return F.when(n_runs < 5, "noise").when((persistence >= 0.5) & (texts_share <= 0.05), "ui").when(persistence < 0.05, "sparse").otherwise("dialogue")


def score(label_: Column, n_runs: Column, persistence: Column) -> Column:
    """0 for labels that can't be a main track."""
    return F.when(label_.isin("noise", "ui"), F.lit(0.0)).otherwise(F.sqrt(n_runs.cast("double")) * persistence)


def pick_main(scored: DataFrame, key: str, least: float = 0.0, most: int = 5) -> DataFrame:
    """The best candidates above `least`, at most `most`; none at all is a legal outcome."""
    return scored.where(F.col("score") > least).orderBy(F.desc("score"), key).limit(most)


def footprint_measures(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of time, spread of widths, change of texts and length of content of each footprint."""
    share = occupancy(runs, keys)
    w = F.length("text").cast("double")
    texts = runs.groupBy(*keys, "text").agg(F.sum("n_obs").alias("_n"))
    churn = texts.groupBy(*keys).agg((F.count("*") / F.sum("_n")).alias("churn"), (F.sum(F.when(F.col("_n") >= 2, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("cover"))
    spread = runs.groupBy(*keys).agg((F.stddev_pop(w) / F.avg(w)).alias("width_dispersion"), F.percentile(w, 0.5).alias("content_p50"))
    return share.join(churn, keys).join(spread, keys)


def footprints_of(rows: pd.DataFrame, least: float = 0.6) -> list[int]:
    """For items in order of start, the first footprint whose running mean box overlaps enough; a new one otherwise."""
    boxes: list[list[float]] = []
    out = []
    for r in rows.itertuples():
        own = (r.x0, r.y0, r.x1, r.y1)
        hit = next((k for k, b in enumerate(boxes) if _iou([x / b[4] for x in b[:4]], own) >= least), None)
        if hit is None:
            boxes.append([*own, 1])
            hit = len(boxes) - 1
        else:
            boxes[hit] = [a + c for a, c in zip(boxes[hit], (*own, 1), strict=True)]
        out.append(hit)
    return out


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def footprints(items: DataFrame) -> DataFrame:
    """items (stream_id, item, t_start, box) with footprint. The order decides, so a stream is one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t_start", "item"], kind="stable")
        return rows[["stream_id", "item"]].assign(footprint=footprints_of(rows))

    flat = items.select("stream_id", "item", "t_start", "box.x0", "box.y0", "box.x1", "box.y1")
    return flat.groupBy("stream_id").applyInPandas(run, "stream_id long, item long, footprint long")


def majority(rows: DataFrame, keys: list[str], value: str, least_votes: int = 3, share: float = 0.5) -> DataFrame:
    """The value with a strict majority of a key's votes, if there are enough."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    n = n.withColumns({"total": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("n"), value))})
    return n.where((F.col("_r") == 1) & (F.col("n") > share * F.col("total")) & (F.col("total") >= least_votes)).drop("_r")
