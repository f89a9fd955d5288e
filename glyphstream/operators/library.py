"""Script libraries against what was on screen: bands, variants, short lines, heads, names, gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.readings import bare, bodies_apart
from ..functions.times import nearest_rank

# Thresholds of bands, heads, names and of the language probe.
BAND, BAND_PAD, BAND_LINES = 0.12, 0.02, 10
HEAD_CHARS, HEAD_BODIES, HEAD_SPAN_US = 16, 3, 30_000_000
NAME_VOTES, NAME_SHARE = 3, 2 / 3
LEAST_SAMPLES = 20


def band_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, y: a line's median height on screen, 0 to 1) to keys, top, bottom: the window of BAND that holds most lines, the uppermost of equals, padded. Keys with fewer than BAND_LINES lines have none."""
    held = lines.where("y is not null").withColumn("_n", F.expr(f"count(*) OVER (PARTITION BY {', '.join(keys)} ORDER BY y RANGE BETWEEN CURRENT ROW AND {BAND}D FOLLOWING)"))
    best = held.groupBy(*keys).agg(F.count("*").alias("_all"), F.max_by("y", F.struct(F.col("_n"), -F.col("y"))).alias("_y"))
    return best.where(F.col("_all") >= BAND_LINES).select(*keys, (F.col("_y") - BAND_PAD).alias("top"), (F.col("_y") + BAND + BAND_PAD).alias("bottom"))


def fold_variants(lines: DataFrame, group: str, key: str) -> DataFrame:
    """lines (group, key, ord, anchored, uniquely) with variant_of: null for the line that stands for its group, its key for the others. A uniquely anchored line comes first, then an anchored one, then the first."""
    order = F.struct(~F.col("uniquely"), ~F.col("anchored"), F.col("ord"), F.col(key))
    first = lines.groupBy(group).agg(F.min_by(key, order).alias("_rep"))
    return lines.join(first, group).withColumn("variant_of", F.when(F.col(key) != F.col("_rep"), F.col("_rep"))).drop("_rep")


def short_anchors(lines: DataFrame, anchors: DataFrame, seen: DataFrame, most_units: int, pad_us: int = 60_000_000) -> DataFrame:
    """lines (unit, line, text) without an anchor that were on screen word for word in their unit's time: unit, line, n, t_first, t_last.

    anchors: unit, line, t_us. seen: text, t_us. A text that more than `most_units` units have tells nothing.
    """
    span = anchors.groupBy("unit").agg((F.min("t_us") - pad_us).alias("lo"), (F.max("t_us") + pad_us).alias("hi"))
    open_ = lines.select("unit", "line", "text").join(anchors.select("unit", "line").distinct(), ["unit", "line"], "left_anti").join(span, "unit")
    rare = open_.groupBy("text").agg(F.count_distinct("unit").alias("n")).where(F.col("n") <= most_units).select("text")
    met = open_.join(rare, "text", "left_semi").join(seen.select("text", "t_us"), "text").where("t_us between lo and hi")
    return met.groupBy("unit", "line").agg(F.count("*").alias("n"), F.min("t_us").alias("t_first"), F.max("t_us").alias("t_last"))


def head_lines(cues: DataFrame, script: DataFrame | None = None) -> DataFrame:
    """cues (stream, t_us, lines array) to (stream, head): bare lines that stand above HEAD_BODIES different last lines over HEAD_SPAN_US at least.

    Lines that are whole script lines (script: text, bare) are none. Only lines that pass the cheap
    tests have their bodies compared, a head a task.
    """
    strip = F.pandas_udf(lambda x: x.map(bare, na_action="ignore"), "string")
    rows = cues.select("stream", "t_us", F.filter("lines", lambda x: F.trim(x) != "").alias("l")).where(F.size("l") > 1)
    rows = rows.select("stream", "t_us", F.element_at("l", -1).alias("body"), F.explode(F.slice("l", 1, F.size("l") - 1)).alias("head"))
    rows = rows.select("stream", "t_us", strip("body").alias("body"), strip("head").alias("head")).where((F.col("head") != "") & (F.length("head") <= HEAD_CHARS))
    if script is not None:
        rows = rows.join(script.select(F.col("text").alias("head")).distinct(), "head", "left_anti")
    often = rows.groupBy("stream", "head").agg(F.count_distinct("body").alias("n"), (F.max("t_us") - F.min("t_us")).alias("span"))
    often = often.where((F.col("n") >= HEAD_BODIES) & (F.col("span") >= HEAD_SPAN_US)).select("stream", "head")
    bodies = rows.join(often, ["stream", "head"]).select("stream", "head", "body").distinct()

    def judge(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return own[["stream", "head"]].head(int(bodies_apart(own["body"], HEAD_BODIES) >= HEAD_BODIES))

    return bodies.groupBy("stream", "head").applyInPandas(judge, bodies.select("stream", "head").schema)


def name_votes(votes: DataFrame, least: int = NAME_VOTES, share: float = NAME_SHARE) -> DataFrame:
    """votes (reading, who, record) to (reading, who, n): who most records name, with enough votes and a large enough share of all; ties go to the lesser name."""
    one = votes.select("reading", "who", "record").distinct().groupBy("reading", "who").agg(F.count("*").alias("n"))
    best = one.groupBy("reading").agg(F.sum("n").alias("_all"), F.min_by(F.struct("who", "n"), F.struct(-F.col("n"), F.col("who"))).alias("_b"))
    return best.where((F.col("_b.n") >= least) & (F.col("_b.n") >= share * F.col("_all"))).select("reading", "_b.who", "_b.n")


def choose_language(scores: DataFrame, keys: list[str], default: str, margin: float, least_chars: int) -> DataFrame:
    """scores (keys, lang, score, n_chars) to keys, chosen: the best other language if it beats the default by the margin and anything was read at all, else the default."""
    one = scores.groupBy(*keys).agg(
        F.max("n_chars").alias("_read"),
        F.coalesce(F.max(F.when(F.col("lang") == default, F.col("score"))), F.lit(0.0)).alias("_own"),
        F.min_by(F.struct("lang", "score"), F.when(F.col("lang") != default, F.struct(-F.col("score"), F.col("lang")))).alias("_b"),
    )
    better = (F.col("_read") >= least_chars) & (F.col("_b.lang") != default) & (F.col("_b.score") > F.col("_own") * (1 + margin))
    return one.select(*keys, F.when(F.coalesce(better, F.lit(False)), F.col("_b.lang")).otherwise(F.lit(default)).alias("chosen"))


def gap_report(lines: DataFrame, keys: list[str], long_: int) -> DataFrame:
    """lines (keys, ord, matched) to keys, n_long, in_long, n_short, in_short: stretches of lines that nothing matched, and how many lines they hold."""
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = lines.withColumn("_island", F.sum(F.when(F.col("matched"), 1).otherwise(0)).over(w))
    runs = rows.where(~F.col("matched")).groupBy(*keys, "_island").agg(F.count("*").alias("n"))
    is_long = F.col("n") >= long_
    return runs.groupBy(*keys).agg(
        F.count_if(is_long).alias("n_long"), F.sum(F.when(is_long, F.col("n")).otherwise(0)).alias("in_long"),
        F.count_if(~is_long).alias("n_short"), F.sum(F.when(~is_long, F.col("n")).otherwise(0)).alias("in_short"),
    )


def sure_rank(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """The value at place floor(q * n) of each group in order, the last at most; null for groups of fewer than LEAST_SAMPLES. Equal values are counted before the shuffle."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumns({"_n": F.sum("_c").over(w), "_upto": F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    at = F.least(F.floor(q * F.col("_n")), F.col("_n") - 1)
    return counts.where(F.col("_upto") > at).groupBy(*keys).agg(F.when(F.max("_n") >= LEAST_SAMPLES, F.min(value)).alias(name))


def region_geometry(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys with cx and h (medians) and x0, x1, y0, y1 (the outer two hundredths left out): a signature that far boxes don't stretch."""
    out = runs.groupBy(*keys).agg(F.percentile((F.col("x0") + F.col("x1")) / 2, 0.5).alias("cx"), F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("h"))
    for c, q in (("x0", 0.02), ("x1", 0.98), ("y0", 0.02), ("y1", 0.98)):
        out = out.join(nearest_rank(runs, keys, c, q, c), keys)
    return out


def slot_geometry(regions: DataFrame, keys: list[str]) -> DataFrame:
    """The median of each part of the signatures of a slot's regions."""
    return regions.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(c) for c in ("cx", "h", "x0", "x1", "y0", "y1")])


def frame_shifts(obs: DataFrame, grid: float = 12.0, still: float = 4.0, least: int = 3, lead: int = 2) -> DataFrame:
    """obs (stream_id, t_us, text, x0, y0, x1, y1) to (stream_id, t_us, dx, dy): how far texts moved from the tick before.

    Pairs of equal texts on ticks that follow each other vote for a cell of the grid; those that
    stood still don't. A tick without a clear winner has no row. The number of readings on screen at
    once bounds the pairs.
    """
    ticks = obs.select("stream_id", "t_us").distinct()
    ticks = ticks.withColumn("t_before", F.lag("t_us").over(Window.partitionBy("stream_id").orderBy("t_us")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    now = obs.select("stream_id", "t_us", "text", cx.alias("cx"), cy.alias("cy")).join(ticks, ["stream_id", "t_us"])
    old = obs.select("stream_id", F.col("t_us").alias("t_before"), "text", cx.alias("ox"), cy.alias("oy"))
    pairs = now.join(old, ["stream_id", "t_before", "text"]).withColumns({"dx": F.col("cx") - F.col("ox"), "dy": F.col("cy") - F.col("oy")})
    pairs = pairs.where((F.abs("dx") >= still) | (F.abs("dy") >= still))
    votes = pairs.groupBy("stream_id", "t_us", F.bround(F.col("dx") / grid).alias("gx"), F.bround(F.col("dy") / grid).alias("gy")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("stream_id", "t_us").orderBy(F.desc("n"), "gx", "gy")
    top = votes.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("n").over(w), F.lit(0))}).where("_r = 1")
    return top.where((F.col("n") >= least) & (F.col("n") >= lead * F.col("_next"))).select("stream_id", "t_us", (F.col("gx") * grid).alias("dx"), (F.col("gy") * grid).alias("dy"))


def clock_times(known: DataFrame, asked: DataFrame, us_per_frame: float) -> DataFrame:
    """known (stream_id, frame, t_us), asked (stream_id, frame) to (stream_id, frame, t_at): linear between the known frames, at the nominal rate beyond them. One pass over both in order of frames."""
    both = known.select("stream_id", "frame", F.col("t_us").cast("double").alias("t"), F.lit(False).alias("is_asked")).unionByName(asked.select("stream_id", "frame", F.lit(None).cast("double").alias("t"), F.lit(True).alias("is_asked")))
    at = F.when(~F.col("is_asked"), F.struct("frame", "t"))
    w = Window.partitionBy("stream_id").orderBy("frame")
    rows = both.withColumns({"lo": F.last(at, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "hi": F.first(at, ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing))}).where("is_asked")
    rate = (F.col("hi.t") - F.col("lo.t")) / (F.col("hi.frame") - F.col("lo.frame"))
    t = F.when(F.col("lo").isNull() & F.col("hi").isNull(), F.col("frame") * us_per_frame).when(F.col("lo").isNull(), F.col("hi.t") - (F.col("hi.frame") - F.col("frame")) * us_per_frame)
    t = t.when(F.col("hi").isNull(), F.col("lo.t") + (F.col("frame") - F.col("lo.frame")) * us_per_frame).otherwise(F.col("lo.t") + (F.col("frame") - F.col("lo.frame")) * rate)
    return rows.select("stream_id", "frame", t.alias("t_at"))


def last_onset(ok: Column) -> Column:
    """Where the last stretch of true values begins that lasts to the end; null if the last value isn't true."""
    back = F.array_position(F.transform(F.reverse(ok), lambda x: ~x), F.lit(True))
    return F.when(~F.element_at(ok, -1), None).when(back == 0, F.lit(0)).otherwise(F.size(ok) - back + 1).cast("int")


def paired(frames: dict[str, DataFrame], key: str, text: str) -> DataFrame:
    """One row for each key with a column for each language; all have to have the same keys, else it raises."""
    names = list(frames)
    out = frames[names[0]].select(key, F.col(text).alias(names[0]))
    for n in names[1:]:
        out = out.join(frames[n].select(key, F.col(text).alias(n)).withColumn(f"_{n}", F.lit(True)), key, "full")
    lone = F.lit(False)
    for n in names[1:]:
        lone = lone | F.col(f"_{n}").isNull()
    lone = lone | F.col(key).isNull()
    sizes = {n: df.count() for n, df in frames.items()}
    if len(set(sizes.values())) > 1 or not out.where(lone).isEmpty():
        raise ValueError(f"the languages don't have the same rows: {sizes}")
    return out.drop(*[f"_{n}" for n in names[1:]])
