"""Claims of script lines by cues in passes, each over what the passes before left.

Candidates come from an equi-join on the unit with a predicate on the time in which a line
can be claimed; only their texts go through the Arrow similarity functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import contained
from ..sources.scratch import checkpointed


def candidates(cues: DataFrame, lines: DataFrame) -> DataFrame:
    """cues (unit, cue, t_start, said) with lines (unit, line, lo, hi, text) that can be claimed then."""
    return cues.join(lines, "unit").where(F.col("t_start").between(F.col("lo"), F.col("hi")))


def _one_to_one(hits: DataFrame, how: str, score: Column) -> DataFrame:
    """Each cue's best line, and of these each line's first cue."""
    hits = hits.withColumns({"score": score, "how": F.lit(how)})
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy("unit", "cue").orderBy(F.desc("score"), "line"))).where("_r = 1")
    first = best.withColumn("_r", F.row_number().over(Window.partitionBy("unit", "line").orderBy(F.desc("score"), "t_start", "cue"))).where("_r = 1")
    return first.select("unit", "cue", "line", "how", "score", "t_start")


def _left(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    return pairs.join(taken.select("unit", "cue"), ["unit", "cue"], "left_anti").join(taken.select("unit", "line"), ["unit", "line"], "left_anti")


def _unique(hits: DataFrame) -> DataFrame:
    """Hits of cues with one candidate only."""
    n = hits.groupBy("unit", "cue").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return hits.join(n, ["unit", "cue"], "left_semi")


def claim(cues: DataFrame, lines: DataFrame, near: float = 0.85) -> DataFrame:
    """(unit, cue, line, how, score): exact, contained, prefix, infix, then flanked."""
    # Each pass is read by all that follow: written once, it isn't computed again.
    pairs = checkpointed(candidates(cues, lines))
    said, text = F.col("said"), F.col("text")
    taken = checkpointed(_one_to_one(pairs.where(said == text), "exact", F.lit(1.0)))
    # The whole line is found in what the cue says.
    rest = _left(pairs, taken).where((F.length(text) >= 3) & (F.length(text) <= F.length(said))).withColumn("_c", contained(text, said))
    taken = checkpointed(taken.unionByName(_one_to_one(rest.where(F.col("_c") >= near), "contained", F.col("_c"))))
    # The cue is the beginning of one line alone: a line still being typed.
    rest = _left(pairs, taken).where((F.length(said) >= 8) & (F.length(said) < F.length(text)) & text.startswith(said))
    taken = checkpointed(taken.unionByName(_one_to_one(_unique(rest), "prefix", F.length(said) / F.length(text))))
    # The cue is a large middle part of one line alone.
    rest = _left(pairs, taken).where((F.length(said) >= 12) & (F.length(said) < F.length(text)) & (F.length(said) >= 0.5 * F.length(text))).withColumn("_c", contained(said, text))
    taken = checkpointed(taken.unionByName(_one_to_one(_unique(rest.where("_c >= 0.9")), "infix", F.col("_c"))))
    # The lines before and after are claimed around the cue, and it is at most one letter off.
    known = taken.select("unit", (F.col("line") + 1).alias("line"), F.col("t_start").alias("_before")).join(
        taken.select("unit", (F.col("line") - 1).alias("line"), F.col("t_start").alias("_after")), ["unit", "line"]
    )
    rest = _left(pairs, taken).join(known, ["unit", "line"]).where(F.col("t_start").between(F.col("_before"), F.col("_after")) & (F.levenshtein(said, text) <= 1))
    return taken.unionByName(_one_to_one(rest, "flanked", F.lit(0.5))).drop("t_start")
