"""Queries over the tracks artifact and script libraries, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import readings as R
from ..functions import times as T
from ..operators import artifact, intervals, library
from .queries import HOUR, LINES_SQL, OBS_SQL, line_view, obs_view, query, table

# An artifact of the observations, with rules broken here and there: 20 documents, a region by event and a main track of two regions.
ART_SQL = OBS_SQL + f""", ev AS (SELECT stream_id % 20 AS doc, event_id, row_number() OVER (PARTITION BY stream_id % 20 ORDER BY event_id) - 1 + CASE WHEN event_id % 97 = 0 THEN 100000000 ELSE 0 END AS id,
 CASE WHEN event_id % 83 = 0 THEN 90 ELSE event_id % 5 END AS region, t_start, CASE WHEN event_id % 89 = 0 THEN t_start - 1 ELSE t_end END AS t_end, t_start + (event_id % 79) * 1000000 AS t_full, text, event_id % 6 = 0 AS flagged, event_id % 10 = 3 AS moving, x0, y0, x1, y1 FROM obs),
 members AS (SELECT doc, 'r' || (event_id % 5) AS track, 'region' AS kind, t_start // {HOUR} AS cue, id AS event, event_id % 13 = 0 AS hide, event_id % 26 = 0 OR event_id % 31 = 0 AS partial FROM ev WHERE event_id % 17 <> 0
 UNION ALL SELECT doc, 'main', 'main', t_start // {HOUR}, id, FALSE, FALSE FROM ev WHERE event_id % 5 < 2),
 tracks AS (SELECT DISTINCT doc, track, kind FROM members),
 shown AS (SELECT m.doc, m.track, m.cue, m.event, e.* EXCLUDE (doc, id) FROM members m JOIN ev e ON e.doc = m.doc AND e.id = m.event WHERE NOT m.hide AND NOT e.flagged AND NOT (m.track = 'main' AND e.text = 'click'))"""


def artifact_view(spark, d):
    """The artifact of ART_SQL as tables."""
    o = obs_view(spark, d).select("event_id", (F.col("stream_id") % 20).alias("doc"), "t_start", "t_end", "text", "box")
    e = F.col("event_id")
    at = F.row_number().over(Window.partitionBy("doc").orderBy("event_id")).cast("long") - 1
    flags = F.array_compact(F.array(F.when(e % 6 == 0, "ui_footprint"), F.when(e % 10 == 3, "moving")))
    ev = o.select(
        "doc", "event_id", (at + F.when(e % 97 == 0, 100_000_000).otherwise(0)).alias("id"), F.when(e % 83 == 0, 90).otherwise(e % 5).alias("region"), "t_start",
        F.when(e % 89 == 0, F.col("t_start") - 1).otherwise(F.col("t_end")).alias("t_end"), (F.col("t_start") + (e % 79) * 1_000_000).alias("t_full"), "text", flags.alias("flags"), "box.*",
    )
    cue = F.floor(F.col("t_start") / HOUR).alias("cue")
    own = ev.where(e % 17 != 0).select("doc", F.concat(F.lit("r"), (e % 5).cast("string")).alias("track"), F.lit("region").alias("kind"), cue, F.col("id").alias("event"), (e % 13 == 0).alias("hide"), ((e % 26 == 0) | (e % 31 == 0)).alias("partial"))
    members = own.unionByName(ev.where(e % 5 < 2).select("doc", F.lit("main").alias("track"), F.lit("main").alias("kind"), cue, F.col("id").alias("event"), F.lit(False).alias("hide"), F.lit(False).alias("partial")))
    return {
        "regions": ev.select("doc").distinct().withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(4)))),
        "tracks": members.select("doc", "track", "kind").distinct(),
        "cues": members.select("doc", "track", "cue").distinct(),
        "members": members.drop("kind"),
        "events": ev,
    }


def shown_view(spark, d):
    t = artifact_view(spark, d)
    ui = t["tracks"].where("track = 'main'").select("doc", "track", F.lit("click").alias("text"))
    return artifact.cue_lines(t["members"], t["events"], ui)


@query(ART_SQL + """, n AS (SELECT doc, count(*) AS size FROM ev GROUP BY 1), b AS (
 SELECT n.doc, 'ids' AS rule, any_value(n.size) - count(DISTINCT CASE WHEN id BETWEEN 0 AND n.size - 1 THEN id END) AS n FROM n JOIN ev USING (doc) GROUP BY 1
 UNION ALL SELECT doc, 'order', count(*) FROM ev WHERE t_end < t_start GROUP BY 1 UNION ALL SELECT doc, 'full', count(*) FROM ev WHERE NOT (t_full BETWEEN t_start AND t_end) GROUP BY 1
 UNION ALL SELECT doc, 'region', count(*) FROM ev WHERE region > 4 GROUP BY 1 UNION ALL SELECT doc, 'hide', count(*) FROM members WHERE partial AND NOT hide GROUP BY 1
 UNION ALL SELECT doc, 'subset', count(DISTINCT event) FROM members m WHERE kind <> 'region' AND NOT EXISTS (SELECT 1 FROM members r WHERE r.kind = 'region' AND r.doc = m.doc AND r.event = m.event) GROUP BY 1)
 SELECT doc, rule, n FROM b WHERE n > 0""")  # fmt: skip
def tracks_validate(spark, d):
    """The rules that the artifact breaks, and how often."""
    return artifact.violations(artifact_view(spark, d))


@query(ART_SQL + " SELECT doc, track, cue, event, text FROM shown")
def cue_members(spark, d):
    """What each cue shows once hidden, interface and ruby members are left out."""
    return shown_view(spark, d).select("doc", "track", "cue", "event", "text")


@query(ART_SQL + " SELECT doc, track, cue, count(*) AS n, count(*) >= 5 AND (max(y1) - min(y0)) / 600 > 0.15 AS panel_like FROM shown GROUP BY 1, 2, 3")
def panel_cues(spark, d):
    return artifact.panels(shown_view(spark, d), 600.0)


@query(ART_SQL + " SELECT doc, track, cue FROM shown GROUP BY 1, 2, 3 HAVING track <> 'main' AND track <> 'r4' AND NOT (count(*) >= 5 AND (max(y1) - min(y0)) / 600 > 0.15)")
def feed_cues(spark, d):
    """The cues that go to the matcher: of region tracks that aren't noise, without panels."""
    tracks = artifact_view(spark, d)["tracks"].withColumn("label", F.when(F.col("track") == "r4", "noise"))
    return artifact.feed(artifact.panels(shown_view(spark, d), 600.0), tracks).select("doc", "track", "cue")


@query(ART_SQL + """, c AS (SELECT doc, track, cue, min(t_start) AS s, max(t_end) AS e, string_agg(text, chr(10) ORDER BY y0, x0, event) AS body FROM shown GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc, track ORDER BY s, cue) AS n FROM c)
 SELECT doc, track, n, n || chr(10) || printf('%02d:%02d:%02d,%03d', s // 3600000000, s // 60000000 % 60, s // 1000000 % 60, s // 1000 % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', e // 3600000000, e // 60000000 % 60, e // 1000000 % 60, e // 1000 % 1000) || chr(10) || body AS block FROM k""")  # fmt: skip
def export_srt(spark, d):
    """The SRT blocks of every track."""
    return artifact.export_srt(shown_view(spark, d))


@query(ART_SQL + " SELECT doc, id, NOT (flagged OR moving) AND x1 > x0 AND y1 > y0 AS usable, region IN (0, 1) AS in_main, flagged AS ui FROM ev")
def event_verdicts(spark, d):
    """What an event may be used for."""
    e = artifact_view(spark, d)["events"]
    use = artifact.usable(F.col("flags"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return e.select("doc", "id", use.alias("usable"), artifact.in_main(F.col("region"), F.col("flags"), [0, 1]).alias("in_main"), artifact.ui_flagged(F.col("flags")).alias("ui"))


@query(ART_SQL + " SELECT doc, track, cue, event FROM members m WHERE kind <> 'region' AND EXISTS (SELECT 1 FROM members r WHERE r.kind = 'region' AND r.doc = m.doc AND r.event = m.event)")
def within_regions(spark, d):
    t = artifact_view(spark, d)
    return artifact.within_regions(t["members"], t["tracks"]).select("doc", "track", "cue", "event")


@query(ART_SQL + " SELECT doc, id AS event, CASE WHEN event_id % 2 = 0 THEN 'unmatched' ELSE 'unfed' END AS rest FROM ev WHERE event_id % 3 <> 0")
def rest_of_feed(spark, d):
    """Events that no item uses, by whether the matcher had them."""
    e = artifact_view(spark, d)["events"]
    ids = e.select("doc", F.col("id").alias("event"), "event_id")
    return artifact.rest_of_feed(e, ids.where("event_id % 3 = 0"), ids.where("event_id % 2 = 0"))


@query("WITH r AS (SELECT event_id, user_id, ['same_time', 'log', 'replay', NULL][event_id % 4 + 1] AS echo, event_id % 3 - 1 AS of_slot FROM events) SELECT user_id, echo, count(*) AS n FROM r WHERE NOT coalesce(echo IN ('same_time', 'log') AND of_slot = -1, FALSE) GROUP BY 1, 2")
def records_kept(spark, d):
    """Records that a flat export keeps, by their kind of echo."""
    e = table(spark, d, "events").select("user_id", "event_id")
    echo = F.element_at(F.array(F.lit("same_time"), F.lit("log"), F.lit("replay"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select("user_id", echo.alias("echo"), (F.col("event_id") % 3 - 1).alias("of_slot"))
    return artifact.records_kept(rows).groupBy("user_id", "echo").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN length(text) END AS ref, [turn * 10, turn * 10 + 1][1:turn % 3] AS extra FROM conversations) SELECT conv_id AS doc, turn AS record, -1 AS slot, ref AS line FROM r WHERE ref IS NOT NULL UNION ALL SELECT conv_id, turn, i - 1, extra[i] FROM r, unnest(generate_series(1, len(extra))) AS g(i)")
def claims_listed(spark, d):
    """Every claim of every record."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("record"), F.when(F.col("turn") % 3 != 0, F.length("text").cast("long")).alias("ref"), F.col("turn").cast("long").alias("t"))
    extra = F.slice(F.array(F.col("t") * 10, F.col("t") * 10 + 1), F.lit(1), (F.col("t") % 3).cast("int"))
    return artifact.claims(c.withColumn("extra", extra))


@query(OBS_SQL + " SELECT event_id, bool_or(value > 99) OVER (PARTITION BY stream_id, text) AS mark FROM obs")
def spread_flags(spark, d):
    """A mark of one reading for all readings of its chain."""
    o = obs_view(spark, d).select("event_id", "stream_id", "text", (F.col("value") > 99).alias("mark"))
    return artifact.spread(o, ["stream_id", "text"], "mark").select("event_id", "mark")


@query(OBS_SQL + """, p AS (SELECT a.stream_id, a.event_id, b.event_id AS other_id, least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start) AS overlap_us FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND a.event_id <> b.event_id
 AND a.t_start < b.t_end AND b.t_start < a.t_end AND a.y1 - a.y0 <= 0.9 * 1.5 * (b.y1 - b.y0) AND greatest(a.y0 - b.y1, b.y0 - a.y1) BETWEEN -0.5 * (a.y1 - a.y0) AND 0.5 * (a.y1 - a.y0)
 AND b.x0 BETWEEN -1e9 AND 1e9 AND (b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap_us DESC, other_id) AS k FROM p WHERE overlap_us > 0) SELECT event_id, other_id, overlap_us FROM r WHERE k = 1""")  # fmt: skip
def title_partners(spark, d):
    """For each reading the one above or below it, of at least as large letters, that it shares most time with."""
    o = obs_view(spark, d).select("stream_id", "event_id", "t_start", "t_end", "box")
    other = o.select("stream_id", F.col("event_id").alias("other_id"), F.col("t_start").alias("u_start"), F.col("t_end").alias("u_end"), F.col("box").alias("by"))
    pairs = intervals.overlap_join(o, other, ["stream_id"], 24 * HOUR).where(F.col("event_id") != F.col("other_id"))
    return intervals.best_overlap(pairs.where(artifact.stacked(F.col("box"), F.col("by"), smaller=0.9 * 1.5)), ["event_id"], ["other_id"]).select("event_id", "other_id", "overlap_us")


@query(OBS_SQL + """, q AS (SELECT stream_id, x0, y0, x1, y1, row_number() OVER (PARTITION BY stream_id ORDER BY x0) - 1 AS a, row_number() OVER (PARTITION BY stream_id ORDER BY x1) - 1 AS b, row_number() OVER (PARTITION BY stream_id ORDER BY y0) - 1 AS c, row_number() OVER (PARTITION BY stream_id ORDER BY y1) - 1 AS e, count(*) OVER (PARTITION BY stream_id) - 1 AS n FROM obs),
 geo AS (SELECT stream_id, quantile_cont((x0 + x1) / 2, 0.5) AS cx, quantile_cont(y1 - y0, 0.5) AS h, max(CASE WHEN a = round_even(0.02 * n, 0) THEN x0 END) AS x0, max(CASE WHEN b = round_even(0.98 * n, 0) THEN x1 END) AS x1, max(CASE WHEN c = round_even(0.02 * n, 0) THEN y0 END) AS y0, max(CASE WHEN e = round_even(0.98 * n, 0) THEN y1 END) AS y1 FROM q GROUP BY 1) SELECT * FROM geo""")  # fmt: skip
def region_geometry(spark, d):
    return library.region_geometry(obs_view(spark, d).select("stream_id", "box.*"), ["stream_id"])


@query("WITH g AS (" + OBS_SQL + " SELECT stream_id, quantile_cont((x0 + x1) / 2, 0.5) AS cx, quantile_cont(y1 - y0, 0.5) AS h, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM obs GROUP BY 1) SELECT stream_id % 7 AS slot, quantile_cont(cx, 0.5) AS cx, quantile_cont(h, 0.5) AS h, quantile_cont(x0, 0.5) AS x0, quantile_cont(x1, 0.5) AS x1, quantile_cont(y0, 0.5) AS y0, quantile_cont(y1, 0.5) AS y1 FROM g GROUP BY 1")
def slot_geometry(spark, d):
    b = obs_view(spark, d).select("stream_id", "box.*")
    g = b.groupBy("stream_id").agg(F.percentile((F.col("x0") + F.col("x1")) / 2, 0.5).alias("cx"), F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("h"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return library.slot_geometry(g.withColumn("slot", F.col("stream_id") % 7), ["slot"])


@query(OBS_SQL + f""", o AS (SELECT stream_id // 10 AS s, t_start // {6 * HOUR} AS t, text, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM obs), k AS (SELECT s, t, lag(t) OVER (PARTITION BY s ORDER BY t) AS p FROM (SELECT DISTINCT s, t FROM o)),
 v AS (SELECT a.s, a.t, round_even((a.cx - b.cx) / 12, 0) AS gx, round_even((a.cy - b.cy) / 12, 0) AS gy, count(*) AS n FROM o a JOIN k ON k.s = a.s AND k.t = a.t JOIN o b ON b.s = a.s AND b.t = k.p AND b.text = a.text WHERE abs(a.cx - b.cx) >= 4 OR abs(a.cy - b.cy) >= 4 GROUP BY 1, 2, 3, 4),
 r AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY n DESC, gx, gy) AS k, coalesce(lead(n) OVER (PARTITION BY s, t ORDER BY n DESC, gx, gy), 0) AS nxt FROM v) SELECT s AS stream_id, t AS t_us, gx * 12 AS dx, gy * 12 AS dy FROM r WHERE k = 1 AND n >= 2 AND n >= nxt""")  # fmt: skip
def frame_shifts(spark, d):
    """How far the texts of ten streams together moved from one quarter of a day to the next."""
    o = obs_view(spark, d).select(F.floor(F.col("stream_id") / 10).alias("stream_id"), F.floor(F.col("t_start") / (6 * HOUR)).alias("t_us"), "text", "box.*")
    return library.frame_shifts(o, least=2, lead=1)


@query("""WITH k AS (SELECT user_id AS s, event_id AS f, epoch_us(ts)::DOUBLE AS t FROM events WHERE event_id % 3 = 0), q AS (SELECT user_id AS s, event_id AS f FROM events WHERE event_id % 3 <> 0),
 j AS (SELECT q.s, q.f, max(k.f) FILTER (k.f <= q.f) AS lf, min(k.f) FILTER (k.f > q.f) AS hf FROM q LEFT JOIN k ON k.s = q.s GROUP BY 1, 2)
 SELECT j.s AS stream_id, j.f AS frame, CASE WHEN lf IS NULL AND hf IS NULL THEN j.f * 40000.0::DOUBLE WHEN lf IS NULL THEN h.t - (hf - j.f) * 40000.0::DOUBLE WHEN hf IS NULL THEN l.t + (j.f - lf) * 40000.0::DOUBLE ELSE l.t + (j.f - lf) * ((h.t - l.t) / (hf - lf)) END AS t_at
 FROM j LEFT JOIN k l ON l.s = j.s AND l.f = j.lf LEFT JOIN k h ON h.s = j.s AND h.f = j.hf""")  # fmt: skip
def clock_times(spark, d):
    """Times of frames between and beyond those that are known."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame"), T.micros(F.col("ts")).alias("t_us"))
    return library.clock_times(e.where("frame % 3 = 0"), e.where("frame % 3 <> 0"), 40_000.0)


@query(OBS_SQL + ", m AS (SELECT text, stream_id, quantile_cont(y0 + x0 / 7, 0.5) / 1080 AS y FROM obs GROUP BY 1, 2), w AS (SELECT text, y, count(*) OVER (PARTITION BY text ORDER BY y RANGE BETWEEN CURRENT ROW AND 0.12::DOUBLE FOLLOWING) AS n FROM m), b AS (SELECT text, count(*) AS c, arg_max(y, {'n': n, 'y': -y}) AS y FROM w GROUP BY 1) SELECT text, y - 0.02 AS top, y + 0.14 AS bottom FROM b WHERE c >= 10")
def subtitle_band(spark, d):
    """The band on screen in which most streams have a text."""
    o = obs_view(spark, d).select("text", "stream_id", F.col("box.y0").alias("y0"), F.col("box.x0").alias("x0"))
    return library.band_of(o.groupBy("text", "stream_id").agg((F.percentile(F.col("y0") + F.col("x0") / 7, 0.5) / 1080).alias("y")), ["text"])


@query("WITH l AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 6 <> 0, p_size % 3 <> 0, p_partkey) AS k, p_size FROM part), r AS (SELECT p_brand, p_partkey AS rep FROM l WHERE k = 1) SELECT p_partkey, CASE WHEN p_partkey <> rep THEN rep ELSE -1 END AS variant_of FROM l JOIN r USING (p_brand)")
def variants_folded(spark, d):
    """Lines of one group, told by the one that stands for them."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("ord"), (F.col("p_size") % 3 == 0).alias("anchored"), (F.col("p_size") % 6 == 0).alias("uniquely"))
    return library.fold_variants(p, "p_brand", "p_partkey").select("p_partkey", F.coalesce("variant_of", F.lit(-1)).alias("variant_of"))


@query("""WITH e AS (SELECT user_id AS unit, event_id AS line, event_type || '-' || user_id AS text, epoch_us(ts) AS t_us, value FROM events), a AS (SELECT unit, line, t_us FROM e WHERE line % 3 = 0), s AS (SELECT unit, min(t_us) - 60000000 AS lo, max(t_us) + 60000000 AS hi FROM a GROUP BY 1)
 SELECT l.unit, l.line, count(*) AS n, min(o.t_us) AS t_first, max(o.t_us) AS t_last FROM e l JOIN s ON s.unit = l.unit JOIN e o ON o.text = l.text AND o.value > 50 AND o.t_us BETWEEN lo AND hi WHERE l.line % 3 <> 0 GROUP BY 1, 2""")  # fmt: skip
def short_anchors(spark, d):
    """Lines too short for a search, found on screen in the time of their unit."""
    e = table(spark, d, "events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("line"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("text"), T.micros(F.col("ts")).alias("t_us"), "value")
    return library.short_anchors(e, e.where("line % 3 = 0"), e.where("value > 50"), 2)


@query("WITH v AS (SELECT user_id % 97 AS reading, event_type AS who, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY n DESC, who) AS k, sum(n) OVER (PARTITION BY reading) AS every FROM v) SELECT reading, who, n FROM b WHERE k = 1 AND n >= 3 AND n >= 0.3 * every")
def name_votes(spark, d):
    """Who a reading of a name stands for, by the records it stood over."""
    e = table(spark, d, "events").select((F.col("user_id") % 97).alias("reading"), F.col("event_type").alias("who"), F.col("event_id").alias("record"))
    return library.name_votes(e, share=0.3)


@query("WITH s AS (SELECT source, lang, sum(length(text))::DOUBLE AS score, sum(length(text)) AS n FROM documents GROUP BY 1, 2), q AS (SELECT source, max(n) AS m, coalesce(max(CASE WHEN lang = 'en' THEN score END), 0) AS own, max(CASE WHEN lang <> 'en' THEN score END) AS other, arg_min(lang, {'s': -score, 'l': lang}) FILTER (lang <> 'en') AS best FROM s GROUP BY 1) SELECT source, CASE WHEN m >= 20 AND other > own * 1.05 THEN best ELSE 'en' END AS chosen FROM q")
def language_choice(spark, d):
    """The language to read a source with."""
    s = table(spark, d, "documents").groupBy("source", "lang").agg(F.sum(F.length("text")).cast("double").alias("score"), F.sum(F.length("text")).alias("n_chars"))
    return library.choose_language(s, ["source"], "en", 0.05, 20)


@query(LINES_SQL + ", l AS (SELECT doc_id, line_no, length(text) % 3 = 0 AS matched FROM lines), i AS (SELECT *, sum(matched::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l), g AS (SELECT doc_id, k, count(*) AS n FROM i WHERE NOT matched GROUP BY 1, 2) SELECT doc_id, count(*) FILTER (n >= 4) AS n_long, CAST(coalesce(sum(n) FILTER (n >= 4), 0) AS BIGINT) AS in_long, count(*) FILTER (n < 4) AS n_short, CAST(coalesce(sum(n) FILTER (n < 4), 0) AS BIGINT) AS in_short FROM g GROUP BY 1")
def gap_report(spark, d):
    """Long and short stretches of lines that nothing matched."""
    lines = line_view(spark, d).select("doc_id", F.col("line_no").alias("ord"), (F.length("text") % 3 == 0).alias("matched"))
    return library.gap_report(lines, ["doc_id"], 4)


@query("WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, CASE WHEN any_value(n) >= 20 THEN min(v) END AS p75 FROM r WHERE k >= least(floor(0.75 * n), n - 1) GROUP BY 1")
def sure_ranks(spark, d):
    """A rank that is only told of groups that are large enough."""
    return library.sure_rank(table(spark, d, "part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 0.75, "p75")


@query("WITH a AS (SELECT conv_id, list(length(text) > 40 ORDER BY turn) AS ok FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN NOT ok[-1] THEN -1 WHEN NOT list_contains(ok, FALSE) THEN 0 ELSE len(ok) - list_position(list_reverse(ok), FALSE) + 1 END AS onset FROM a")
def last_onsets(spark, d):
    """The turn from which on all turns of a conversation are long. A conversation's turns are a short list."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", (F.length("text") > 40).alias("ok")))).alias("r"))
    return c.select("conv_id", F.coalesce(library.last_onset(F.transform("r", lambda x: x["ok"])), F.lit(-1)).cast("long").alias("onset"))


PUNCTUATION = R.NO_CONTENT.replace("'", "''")


@query(LINES_SQL + f", c AS (SELECT doc_id, length(translate(regexp_replace(replace(text, chr(92) || 'N', ''), '[ \\t\\n\\v\\f\\r]+', '', 'g'), '{PUNCTUATION}', '')) AS n FROM lines) SELECT doc_id, CASE WHEN n = 0 THEN 'punctuation' WHEN n <= 2 THEN 'trivial' ELSE 'content' END AS tier, count(*) AS n FROM c GROUP BY 1, 2")
def content_tiers(spark, d):
    """How many lines of a document are punctuation, trivial, or have content."""
    return line_view(spark, d).groupBy("doc_id", R.tier(F.col("text")).alias("tier")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark), k AS (SELECT w, left(w, 3) AS p FROM w WHERE length(w) BETWEEN 4 AND 8 AND regexp_full_match(w, '[a-z]+')) SELECT a.w AS a, b.w AS b FROM k a JOIN k b ON a.p = b.p AND a.w < b.w WHERE levenshtein(a.w, b.w) = 1")
def one_char_pairs(spark, d):
    """Words of plain letters with the same beginning that are one letter apart."""
    w = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("a")).distinct().where(F.length("a").between(4, 8) & F.col("a").rlike("^[a-z]+$")).withColumn("p", F.substring("a", 1, 3))
    return w.join(w.withColumnRenamed("a", "b"), "p").where("a < b").where(R.one_char_apart(F.col("a"), F.col("b"))).select("a", "b")


@query("SELECT item_id, regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g') AS form FROM benchmark")
def library_forms(spark, d):
    """Texts as a library is searched with."""
    return table(spark, d, "benchmark").select("item_id", R.arrow(R.library_form, "string")("text").alias("form"))
