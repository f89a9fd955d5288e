"""The tracks artifact as tables: regions, tracks, events, and members (which events a cue of a track shows).

events: doc, id, region, t_start, t_end, t_full, text, flags, x0, y0, x1, y1. tracks: doc, track, kind.
members: doc, track, cue, event, hide, partial; one row for each event of a cue. cues: doc, track, cue.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import srt_time

# Flags, and the shape of a panel.
UI_FLAGS, MOVES = ["ui_filtered", "ui_footprint"], ["moving", "scrolling", "nameplate"]
PANEL_ROWS, PANEL_HEIGHT = 5, 0.15
DROPPED_ECHOES = ["same_time", "log"]
DOCUMENT = (
    "doc string, regions array<struct<index:long,align:string,align_how:string,label:string>>,"
    " tracks array<struct<id:string,kind:string,region:long,ui_lines:array<string>,cues:array<struct<id:string,t_start:long,t_end:long,events:array<long>,hide:array<long>,partial:array<long>>>>>,"
    " events array<struct<id:long,region:long,t_start:long,t_end:long,t_full:long,text:string,flags:array<string>,box:array<double>>>"
)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of artifact files (JSON, one document each); doc is the file."""
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("doc", F.input_file_name())
    tracks = docs.select("doc", F.explode_outer("tracks").alias("t")).where("t is not null")
    cues = tracks.select("doc", F.col("t.id").alias("track"), F.explode("t.cues").alias("c"))
    members = cues.select("doc", "track", F.col("c.id").alias("cue"), F.explode("c.events").alias("event"), "c.hide", "c.partial")
    has = lambda c: F.coalesce(F.array_contains(c, F.col("event")), F.lit(False))
    return {
        "regions": docs.select("doc", F.inline("regions")),
        "tracks": tracks.select("doc", F.col("t.id").alias("track"), "t.kind", "t.region", "t.ui_lines"),
        "cues": cues.select("doc", "track", F.col("c.id").alias("cue"), "c.t_start", "c.t_end"),
        "members": members.withColumns({"hide": has("hide"), "partial": has("partial")}),
        "events": docs.select("doc", F.explode("events").alias("e")).select("doc", "e.id", "e.region", "e.t_start", "e.t_end", "e.t_full", "e.text", "e.flags", *[F.get("e.box", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]),
    }


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """(doc, rule, n) for each rule that a document breaks. Every rule is a join or an aggregation over whole tables."""
    events, members, tracks = t["events"], t["members"], t["tracks"]
    ids = events.select("doc", F.col("id").alias("event")).distinct()
    size = events.groupBy("doc").agg(F.count("*").alias("size"))
    dense = events.join(size, "doc").where(F.col("id").between(0, F.col("size") - 1)).groupBy("doc", "size").agg(F.count_distinct("id").alias("good"))
    dense = size.join(dense.select("doc", "good"), "doc", "left").select("doc", (F.col("size") - F.coalesce("good", F.lit(0))).alias("n"))
    shown = members.join(tracks.select("doc", "track", "kind").distinct(), ["doc", "track"])
    placed = shown.where("kind = 'region'").select("doc", "event").distinct()
    count = lambda df: df.groupBy("doc").agg(F.count("*").alias("n"))
    broken = {
        "ids": dense,
        "order": count(events.where("t_end < t_start")),
        "full": count(events.where("t_full is not null and not (t_full between t_start and t_end)")),
        "region": count(events.join(t["regions"].select("doc", F.col("index").alias("region")).distinct(), ["doc", "region"], "left_anti")),
        "track": count(tracks.groupBy("doc", "track").count().where("count > 1")),
        "subset": count(shown.where("kind <> 'region'").select("doc", "track", "event").distinct().join(placed, ["doc", "event"], "left_anti")),
        "empty": count(t["cues"].select("doc", "track", "cue").join(members, ["doc", "track", "cue"], "left_anti")),
        "hide": count(members.where("partial and not hide")),
        "member": count(members.join(ids, ["doc", "event"], "left_anti")),
    }
    out = None
    for rule, df in broken.items():
        one = df.where("n > 0").select("doc", F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def dump(t: dict[str, DataFrame], path: str) -> None:
    """Writes the tables as Parquet; one that breaks a rule isn't written."""
    found = violations(t).orderBy("doc", "rule").head(1)
    if found:
        raise ValueError(f"document {found[0]['doc']} breaks the rule {found[0]['rule']} {found[0]['n']} times")
    for name, df in t.items():
        df.write.parquet(f"{path}/{name}")


def ui_flagged(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, UI_FLAGS)))


def usable(flags: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an event may vote on alignment: it stands still, is no plate and no interface, and has a box."""
    return ~F.arrays_overlap(flags, F.array(*map(F.lit, MOVES + UI_FLAGS))) & (x1 > x0) & (y1 > y0)


def in_main(region: Column, flags: Column, main: Iterable[int]) -> Column:
    """Whether an event is on the main track: by its region, or merged into it by itself."""
    return region.isin(*main) | F.array_contains(flags, "band_merged")


def in_band(kind: Column, status: Column, others: Iterable[str]) -> Column:
    """Whether a script line belongs into the subtitle band: not of one of the `others` kinds, and nothing known against it."""
    return ~kind.isin(*others) & status.isNull()


def cue_lines(members: DataFrame, events: DataFrame, ui_lines: DataFrame, filtered: bool = True) -> DataFrame:
    """The events that each cue shows: (doc, track, cue, event) with the event's columns.

    Filtered, hidden members, the track's own interface lines (ui_lines: doc, track, text), and what
    is flagged as interface by place or as ruby go; else only partial members do.
    """
    rows = members.where(~F.col("hide") if filtered else ~F.col("partial")).select("doc", "track", "cue", "event")
    rows = rows.join(events.withColumnRenamed("id", "event"), ["doc", "event"])
    if not filtered:
        return rows
    rows = rows.where(~F.arrays_overlap("flags", F.array(F.lit("ui_footprint"), F.lit("ruby"))))
    return rows.withColumn("_line", F.trim("text")).join(ui_lines.select("doc", "track", F.trim("text").alias("_line")).distinct(), ["doc", "track", "_line"], "left_anti").drop("_line")


def panels(lines: DataFrame, height: float) -> DataFrame:
    """(doc, track, cue, n, panel_like): many rows over much of the screen."""
    one = lines.groupBy("doc", "track", "cue").agg(F.count("*").alias("n"), ((F.max("y1") - F.min("y0")) / height).alias("_tall"))
    return one.select("doc", "track", "cue", "n", ((F.col("n") >= PANEL_ROWS) & (F.col("_tall") > PANEL_HEIGHT)).alias("panel_like"))


def feed(cues: DataFrame, tracks: DataFrame, mode: str = "nonoise", panel: bool = False) -> DataFrame:
    """cues (doc, track, cue, panel_like) that go to the matcher: of region tracks, by mode 'all', 'nonoise' (label) or 'main'; panels only if asked."""
    chosen = {"all": F.lit(True), "nonoise": F.coalesce(F.col("label") != "noise", F.lit(True)), "main": F.col("is_main")}[mode]
    own = tracks.where((F.col("kind") == "region") & chosen).select("doc", "track")
    return cues.join(own, ["doc", "track"], "left_semi").where(F.lit(panel) | ~F.col("panel_like"))


def export_srt(lines: DataFrame) -> DataFrame:
    """lines (doc, track, cue, text, t_start, t_end, y0, x0, event) to (doc, track, n, block): the SRT blocks of every track, numbered in order of time. One cue's lines bound what is gathered."""
    rows = F.sort_array(F.collect_list(F.struct("y0", "x0", "event", "text")))
    one = lines.groupBy("doc", "track", "cue").agg(F.min("t_start").alias("s"), F.max("t_end").alias("e"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("body"))
    one = one.withColumn("n", F.row_number().over(Window.partitionBy("doc", "track").orderBy("s", "cue")).cast("long"))
    return one.select("doc", "track", "n", F.concat_ws("\n", F.col("n").cast("string"), F.concat(srt_time(F.col("s")), F.lit(" --> "), srt_time(F.col("e"))), "body").alias("block"))


def shown_groups(tiers: dict[str, str], fill: str, show: Iterable[str] = (), hide: Iterable[str] = ()) -> tuple[set[str], bool]:
    """The groups to show, and whether gaps are filled: groups of tier 'off' only if asked, 'always' ones in any case. Names nobody declared, and contradictions, raise."""
    show, hide = set(show), set(hide)
    unknown = (show | hide) - set(tiers) - {"fill", "all"}
    fixed = {g for g in hide if tiers.get(g) == "always"}
    if unknown or fixed or "all" in hide or show & hide:
        raise ValueError(f"can't show {sorted(show)} and hide {sorted(hide)}")
    every = "all" in show
    groups = {g for g, tier in tiers.items() if every or tier != "off" or g in show}
    return groups - hide, (every or fill == "on" or "fill" in show) and "fill" not in hide


def records_kept(records: DataFrame, mode: str = "drop") -> DataFrame:
    """records (echo, of_slot) without echoes of the same time or the log, unless the line's main claim is no record's own (of_slot -1) and would be lost."""
    if mode == "keep":
        return records
    return records.where(~F.coalesce(F.col("echo").isin(*DROPPED_ECHOES) & (F.col("of_slot") == -1), F.lit(False)))


def claims(records: DataFrame) -> DataFrame:
    """records (doc, record, ref, extra array) to (doc, record, slot, line): slot -1 is the record's own line, the others are counted from 0."""
    own = records.where("ref is not null").select("doc", "record", F.lit(-1).alias("slot"), F.col("ref").alias("line"))
    return own.unionByName(records.select("doc", "record", F.posexplode("extra").alias("slot", "line")))


def rest_of_feed(events: DataFrame, used: DataFrame, fed: DataFrame) -> DataFrame:
    """(doc, event, rest) of events that no item uses: 'unmatched' if they were fed to the matcher, else 'unfed'."""
    ids = events.select("doc", F.col("id").alias("event")).join(used, ["doc", "event"], "left_anti")
    fed = fed.select("doc", "event").distinct().withColumn("_fed", F.lit("unmatched"))
    return ids.join(fed, ["doc", "event"], "left").select("doc", "event", F.coalesce("_fed", F.lit("unfed")).alias("rest"))


def within_regions(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """Members of other tracks as far as a region track has their event; cues that lose all members are gone with them."""
    kinds = tracks.select("doc", "track", "kind").distinct()
    rows = members.join(kinds, ["doc", "track"])
    placed = rows.where("kind = 'region'").select("doc", "event").distinct()
    return rows.where("kind <> 'region'").join(placed, ["doc", "event"], "left_semi").drop("kind")


def spread(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """rows with the flag true wherever one of its chain (keys) has it; chains are aggregated first, so none is gathered."""
    some = rows.groupBy(*keys).agg(F.max(flag).alias("_some"))
    return rows.join(some, keys).withColumn(flag, F.col("_some")).drop("_some")


def stacked(b: Column, c: Column, gap: float = 0.5, smaller: float = 0.9) -> Column:
    """Whether box b, of letters `smaller` than c's at most, stands right above or below box c, each with its centre in the other."""
    h = b["y1"] - b["y0"]
    off = F.greatest(b["y0"] - c["y1"], c["y0"] - b["y1"])
    centre = lambda x: (x["x0"] + x["x1"]) / 2
    return (h <= smaller * (c["y1"] - c["y0"])) & off.between(-gap * h, gap * h) & centre(c).between(b["x0"], b["x1"]) & centre(b).between(c["x0"], c["x1"])
