"""Observation streams as JSON lines, and subtitles as SRT and ASS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import ass_time, srt_time

OBS = "frame long, t_us long, box array<double>, text string, conf double"
STAMP = r"(\d+):(\d+):(\d+)[,.](\d+)"


def read_obs(spark: SparkSession, path: str, least_conf: float = 0.0) -> DataFrame:
    """Observations of a JSON lines file; the line of metadata is left out by its key."""
    rows = spark.read.text(path).where(~F.col("value").startswith('{"_meta"'))
    return rows.select(F.from_json("value", OBS).alias("o")).select("o.*").where(F.col("conf") >= least_conf)


def _us(stamp: str, unit: int) -> F.Column:
    part = lambda k: F.regexp_extract(stamp, STAMP, k).cast("long")
    return (part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000 + part(4) * unit


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(n, t_start, t_end, lines) of each block. Line ends of any kind; blocks are parted by lines without a letter. A file is read whole, as subtitles are small."""
    text = F.regexp_replace("value", "\r\n?", "\n")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.split(text, r"\n[ \t]*(?:\n[ \t]*)*\n|\n[ \t]*\n")).alias("value"))
    rows = rows.where(F.col("value").contains("-->")).withColumn("b", F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
    at = F.array_position(F.transform("b", lambda x: x.contains("-->")), F.lit(True)).cast("int")
    times = F.split(F.get("b", at - 1), " *--> *")
    rows = rows.withColumns({"at": at, "a": F.get(times, F.lit(0)), "z": F.get(times, F.lit(1))})
    return rows.select(F.when(F.col("at") > 1, F.regexp_extract(F.get("b", F.col("at") - 2), r"(\d+)", 1)).cast("long").alias("n"), _us("a", 1000).alias("t_start"), _us("z", 1000).alias("t_end"), F.slice("b", F.col("at") + 1, F.lit(1 << 20)).alias("lines"))


def read_subs(spark: SparkSession, paths: list[str], by_time: bool = False) -> DataFrame:
    """Cues of several files with `file` (its place in paths) and `ord`, their order: file after file, or all by time."""
    one = [(read_ass(spark, p).withColumn("n", F.monotonically_increasing_id()) if p.endswith(".ass") else read_srt(spark, p)).select(F.lit(k).alias("file"), "n", "t_start", "t_end", "lines") for k, p in enumerate(paths)]
    rows = one[0]
    for other in one[1:]:
        rows = rows.unionByName(other)
    order = ["t_start", "t_end", "file", "n"] if by_time else ["file", "n", "t_start"]
    # The cues of a few subtitle files are one sequence.
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def write_srt(cues: DataFrame, path: str) -> None:
    """cues (t_start, t_end, lines) in order of time. One document's numbering is one sequence, so its text is one file."""
    w = Window.orderBy("t_start", "t_end", "lines")
    blocks = cues.select(F.row_number().over(w).alias("n"), "*")
    text = F.concat_ws("\n", F.col("n").cast("string"), F.concat_ws(" --> ", srt_time(F.col("t_start")), srt_time(F.col("t_end"))), F.concat_ws("\n", "lines"))
    blocks.orderBy("n").coalesce(1).select(text.alias("value")).write.text(path, lineSep="\n\n")


def read_ass(spark: SparkSession, path: str) -> DataFrame:
    """(t_start, t_end, lines) of each Dialogue row; \\N parts lines."""
    rows = spark.read.text(path).where(F.col("value").startswith("Dialogue:"))
    part = F.split(F.substring("value", 11, 1 << 20), ",", 10)
    rows = rows.select(F.get(part, F.lit(1)).alias("a"), F.get(part, F.lit(2)).alias("z"), F.get(part, F.lit(9)).alias("t"))
    return rows.select(_us("a", 10_000).alias("t_start"), _us("z", 10_000).alias("t_end"), F.split("t", r"\\N").alias("lines"))


def ass_rows(cues: DataFrame) -> DataFrame:
    """Dialogue rows of cues."""
    text = F.concat_ws("\\N", "lines")
    return cues.select(F.concat_ws(",", F.lit("Dialogue: 0"), ass_time(F.col("t_start"), True), ass_time(F.col("t_end"), False), F.lit("Default,,0,0,0,"), text).alias("value"))


def count_cues(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.col("value").contains(" --> ") | F.col("value").startswith("Dialogue:")).count()
