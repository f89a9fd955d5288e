"""Quality rules as robust multivariate outliers.

A document is a vector of transformed statistics. Each language and source has a
centre and a scatter from the minimum covariance determinant: the half of its documents
(SUPPORT) whose scatter has the least determinant. They are found by concentration steps:
distances to the present centre and scatter, the documents nearest by these, and their
moments as the next ones, until the determinant no longer falls. A document goes if its squared Mahalanobis distance, scaled so
that the group's median is the median of the chi-squared law, is beyond CUTOFF.

No group is gathered. A step is an aggregation of sums and products by group; how far the
nearest half reaches is read off a histogram of log distances per group, and all
documents of the bin in which the half is reached belong to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shape
from .store import cut, drop

STATS = ["x0", "x1", "x2", "x3"]
D = len(STATS)
#: Share of a group that the estimate rests on; by how much the log of a determinant has to fall to go on; least documents for a scatter of a group's own.
SUPPORT, FALL, LEAST = 0.6, 1e-3, 60
#: Squared distance beyond which a document goes: far beyond the 0.999 999 quantile of chi-squared with 4 degrees of freedom (33.4), as the statistics have heavier tails.
CUTOFF, CHI_MEDIAN = 150.0, 3.3567
#: Least standard deviations: differences below these are no oddity, even if a group has none at all.
FLOOR = [0.35, 0.12, 0.04, 0.08]
GROUP = ["_level", "_no_lang", "_lang", "_no_source", "_source"]
#: Estimates in the order they are asked: the source's in its language, the language's, that of all rows.
LEVELS = ("own", "lang", "all")


def vector(n_words: int, chars: int, symbols: int, dup_lines: int, repeated: int, lines: int) -> list[float]:
    """Log of the words, log of the mean word's letters, and square roots of the parts of symbols and of repeated words and lines."""
    n = max(1, n_words)
    again = max(repeated / n, dup_lines / max(1, lines))
    return [float(np.log1p(n_words)), float(np.log((chars + 1) / n)), float(np.sqrt(symbols / max(1, chars))), float(np.sqrt(min(1.0, again)))]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source with the base statistics and the vector."""
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shape.base(text)
                rows.append([*own, *vector(*own, lines=(text or "").count("\n") + 1)])
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *STATS])
            for k in ("source", "lang"):
                out.insert(0, k, batch[k].array)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text", "lang", "source").mapInPandas(run, schema + "".join(f", {x} double" for x in STATS))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products by group: aggregated before the shuffle."""
    sums: list[Column] = [F.count("*").alias("n")]
    sums += [F.sum(x).alias(f"s_{x}") for x in STATS]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(STATS) for b in STATS[i:]]
    return rows.groupBy(*keys).agg(*sums)


def _estimates(moments: DataFrame, keys: list[str]) -> DataFrame:
    """For each group its centre, the inverse of its scatter, as arrays, and the log of the scatter's determinant; one row a group, so any number of groups is handled in parallel."""
    schema = moments.select(*keys).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.diag(np.array(FLOOR) ** 2)
        for batch in batches:
            centres, inverses, logs = [], [], []
            for r in batch.to_dict("records"):
                n = max(1, r["n"])
                mean = np.array([r[f"s_{x}"] for x in STATS]) / n
                scatter = np.empty((D, D))
                for i, a in enumerate(STATS):
                    for j, b in enumerate(STATS[i:], i):
                        scatter[i, j] = scatter[j, i] = r[f"p_{a}_{b}"] / n - mean[i] * mean[j]
                values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
                scatter = (vectors * np.maximum(values, 0)) @ vectors.T + floor
                centres.append(mean.tolist())
                inverses.append(np.linalg.inv(scatter).reshape(-1).tolist())
                logs.append(float(np.linalg.slogdet(scatter)[1]))
            yield batch[keys].assign(centre=centres, inverse=inverses, log_det=logs)

    return moments.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", centre array<double>, inverse array<double>, log_det double")


def _distance() -> Column:
    off = [F.col(x) - F.get("centre", F.lit(i)) for i, x in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(D):
            total = total + off[i] * off[j] * F.get("inverse", F.lit(i * D + j))
    return F.greatest(total, F.lit(0.0))


def _with_distance(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """The distance to the group's estimate, and its bin: 64 to each power of e."""
    out = rows.join(estimates, keys).withColumn("_d2", _distance())
    return out.withColumn("_bin", F.floor(64 * F.log(F.col("_d2") + 1e-6)).cast("int"))


def _reach(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first bin at which `share` of the group's rows are reached. Bins are a few hundred a group at most, and gathered as one sorted list."""
    bins = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("c"))
    lists = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_bin", "c"))).alias("b"), F.sum("c").alias("total"))
    walk = F.aggregate(
        "b",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")),
        lambda acc, x: F.struct(
            (acc["seen"] + x["c"]).alias("seen"),
            F.when(acc["at"].isNull() & (acc["seen"] + x["c"] >= share * F.col("total")), x["_bin"]).otherwise(acc["at"]).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    return lists.select(*keys, walk.alias("_reach"), "total")


def robust(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centre, inverse, scale (to make the median distance chi-squared's) and total, for each group."""
    # The start isn't a subset of the right size, so whatever the first step finds replaces it.
    now = cut(_estimates(_start(rows, keys), keys).withColumn("log_det", F.lit(float("inf"))).withColumn("open", F.lit(True)), "mcd")
    while True:
        near = _with_distance(rows, now.where("open").select(*keys, "centre", "inverse"), keys)
        reach = cut(_reach(near, keys, SUPPORT), "reach", tidy=False)
        step = _estimates(_moments(near.join(reach, keys).where("_bin <= _reach"), keys), keys)
        step = now.join(step.select(*keys, F.struct("centre", "inverse", "log_det").alias("step")), keys, "left")
        fell = F.coalesce(F.col("step.log_det") < F.col("log_det") - FALL, F.lit(False))
        # A group whose determinant doesn't fall is done and keeps its best estimate.
        after = cut(step.select(*keys, *[F.when(fell, F.col(f"step.{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "inverse", "log_det")], fell.alias("open")), "mcd", tidy=False)
        drop(now, reach)
        now = after
        if now.where("open").isEmpty():
            break
    now = now.drop("open", "log_det")
    half = _reach(_with_distance(rows, now, keys), keys, 0.5)
    # A floor of 1 keeps a group without any spread from rejecting what differs a little.
    scale = F.greatest(F.exp((F.col("_reach") + 0.5) / 64) / CHI_MEDIAN, F.lit(0.25))
    return cut(now.join(half.select(*keys, scale.alias("scale"), "total"), keys), "mcd")


def _start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the rows around the group's medians: those within the middle 80 % of every statistic, or all if there are none."""
    q = rows.groupBy(*keys).agg(*[F.percentile_approx(x, [0.1, 0.9], 1000).alias(f"q_{x}") for x in STATS])
    inside = F.lit(True)
    for x in STATS:
        inside = inside & F.col(x).between(F.get(f"q_{x}", F.lit(0)), F.get(f"q_{x}", F.lit(1)))
    marked = rows.join(cut(q, "mcd-start"), keys).withColumn("_in", inside)
    few = marked.groupBy(*keys).agg((F.count_if("_in") < 2 * D).alias("_few"))
    return _moments(marked.join(cut(few, "mcd-few"), keys).where("_in or _few"), keys)


def _level(level: str) -> list[Column]:
    """The group's columns at a level; what a level doesn't tell apart is blank."""
    no, blank = F.lit(False), F.lit("")
    lang = [F.col("_no_lang"), F.col("_lang")] if level != "all" else [no, blank]
    source = [F.col("_no_source"), F.col("_source")] if level == "own" else [no, blank]
    return [c.alias(k) for c, k in zip([F.lit(level), *lang, *source], GROUP, strict=True)]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (scaled, squared) and kept.

    docs needs doc_id, text, lang and source; other columns are dropped. Null text counts as
    empty: no words, so base_failed. A null language or source is a group of its own. Only rows
    that pass the base rules shape the estimates. Groups of fewer than LEAST such rows are judged
    by the estimate of their language, and languages of fewer by that of all rows; without any row
    there is none and the base rules decide alone. Rows are judged one by one, repeated ones alike.
    """
    rows = measured(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    for c in ("lang", "source"):
        rows = rows.withColumn(f"_no_{c}", F.col(c).isNull()).withColumn(f"_{c}", F.coalesce(c, F.lit("")))
    rows = cut(rows.drop("lang", "source"), "measured")
    # A row counts once at each level; levels are groups like any other, so one series of steps serves all.
    at_levels = rows.where("not base_failed").select(*STATS, F.explode(F.array(*[F.struct(*_level(k)) for k in LEVELS])).alias("_g"))
    found = robust(at_levels.select(*STATS, *[F.col(f"_g.{k}").alias(k) for k in GROUP]), GROUP)
    found = found.where((F.col("_level") == "all") | (F.col("total") >= LEAST)).drop("total")
    out = rows
    for level in LEVELS:
        keyed = out.select("*", *[c.alias(f"{k}_of") for c, k in zip(_level(level), GROUP, strict=True)])
        own = found.select(*[F.col(k).alias(f"{k}_of") for k in GROUP], "centre", "inverse", "scale")
        out = keyed.join(own, [f"{k}_of" for k in GROUP], "left").withColumn(f"_d_{level}", _distance() / F.col("scale"))
        out = out.drop("centre", "inverse", "scale", *[f"{k}_of" for k in GROUP])
    out = out.withColumn("distance", F.coalesce("_d_own", "_d_lang", "_d_all"))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
