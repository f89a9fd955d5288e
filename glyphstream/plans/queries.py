"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import texts as X
from ..functions import times as T
from ..operators import audit, graph, intervals, regions, retrieval, runs
from ..sources.scratch import written

HOUR = 3600 * T.SECOND
SAMPLE = 6 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OBS_SQL = """WITH obs AS (SELECT event_id, user_id AS stream_id, epoch_us(ts) AS t_us, event_type AS text, 1.0::DOUBLE / (1 + value) AS conf, value,
 epoch_us(ts) AS t_start, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS t_end,
 CAST((user_id % 7) * 100 AS DOUBLE) AS x0, CAST(length(event_type) * 40 AS DOUBLE) AS y0, CAST((user_id % 7) * 100 + 80 + CAST(floor(value) AS BIGINT) % 50 AS DOUBLE) AS x1, CAST(length(event_type) * 40 + 30 AS DOUBLE) AS y1 FROM events)"""
LINES_SQL = """WITH lines AS (SELECT doc_id, i AS line_no, parts[i] AS text, source FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS g(i) WHERE trim(parts[i]) <> '')"""
RUNS_SQL = f""", lagged AS (SELECT *, lag(t_us) OVER (PARTITION BY stream_id, text ORDER BY t_us) AS p FROM obs),
 marked AS (SELECT *, sum(CASE WHEN p IS NULL OR t_us - p > {SAMPLE + SAMPLE // 2} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, text ORDER BY t_us) AS island FROM lagged),
 runs AS (SELECT stream_id, text, min(t_us) AS t_start, max(t_us) + {SAMPLE} AS t_end, count(*) AS n_obs, max(conf) AS conf FROM marked GROUP BY stream_id, text, island)"""


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs_view(spark: SparkSession, d: str) -> DataFrame:
    """events as observations: a stream for each user, the type as text, a box and a duration by whole-number arithmetic."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    t, x, y = T.micros(F.col("ts")), (F.col("user_id") % 7) * 100, F.length("event_type") * 40
    wide = 80 + F.floor("value") % 50
    return e.select(
        "event_id", F.col("user_id").alias("stream_id"), t.alias("t_us"), F.col("event_type").alias("text"), (1.0 / (1 + F.col("value"))).alias("conf"), "value",
        t.alias("t_start"), (t + F.round(F.col("value") * 100).cast("long") * 600_000).alias("t_end"), G.box(x, y, x + wide, y + 30).alias("box"), "ts",
    )


def line_view(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents with a word, numbered from 1 as they stand in the document."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return docs.where(F.trim("text") != "").select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "text", "source")


def run_view(spark: SparkSession, d: str) -> DataFrame:
    return runs.exact_runs(obs_view(spark, d), SAMPLE)


@query(OBS_SQL + RUNS_SQL + " SELECT stream_id, text, t_start, t_end, n_obs, conf FROM runs")
def runs_exact_text(spark, d):
    return run_view(spark, d)


@query(OBS_SQL + " SELECT stream_id, t_us, text, conf FROM obs WHERE conf >= 0.1 AND text <> 'error'")
def obs_scan_filter(spark, d):
    return obs_view(spark, d).where((F.col("conf") >= 0.1) & (F.col("text") != "error")).select("stream_id", "t_us", "text", "conf")


@query(OBS_SQL + " SELECT stream_id, text, n_votes FROM (SELECT stream_id, text, count(*) AS n_votes, row_number() OVER (PARTITION BY stream_id ORDER BY count(*) DESC, min(t_us)) AS r FROM obs GROUP BY 1, 2) WHERE r = 1")
def run_text_vote(spark, d):
    return runs.vote(obs_view(spark, d), ["stream_id"], "text", "t_us")


UNION_SQL = """, reach AS (SELECT stream_id, t_start, t_end, max(t_end) OVER (PARTITION BY stream_id ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM obs),
 marks AS (SELECT *, sum(CASE WHEN r IS NULL OR t_start > r THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY t_start, t_end ROWS UNBOUNDED PRECEDING) AS k FROM reach),
 merged AS (SELECT stream_id, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS n_parts FROM marks GROUP BY stream_id, k)"""


@query(OBS_SQL + UNION_SQL + " SELECT * FROM merged")
def interval_union(spark, d):
    return intervals.merge_intervals(obs_view(spark, d), ["stream_id"])


@query(OBS_SQL + UNION_SQL + " SELECT stream_id, CAST(sum(t_end - t_start) AS BIGINT) AS occupied_us, max(t_end) - min(t_start) AS span_us, count(*) AS n_islands, round(sum(t_end - t_start) / (max(t_end) - min(t_start)), 9) AS share FROM merged GROUP BY 1")
def occupancy_share(spark, d):
    return intervals.occupancy(obs_view(spark, d), ["stream_id"]).withColumn("share", F.round("share", 9))


@query(OBS_SQL + RUNS_SQL + """, t AS (SELECT stream_id, text, sum(n_obs) AS n FROM runs GROUP BY 1, 2),
 c AS (SELECT stream_id, round(count(*) / sum(n), 9) AS churn, round(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n), 9) AS cover FROM t GROUP BY 1),
 w AS (SELECT stream_id, round(stddev_pop(length(text)) / avg(length(text)), 6) AS width_dispersion, quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS content_p50 FROM runs GROUP BY 1) SELECT * FROM c JOIN w USING (stream_id)""")
def footprint_measures(spark, d):
    got = regions.footprint_measures(run_view(spark, d), ["stream_id"])
    return got.select("stream_id", F.round("churn", 9).alias("churn"), F.round("cover", 9).alias("cover"), F.round("width_dispersion", 6).alias("width_dispersion"), "content_p50")


@query(OBS_SQL + f" SELECT stream_id, count(DISTINCT w) AS n_windows, min(w) AS first_window, max(w) AS last_window FROM (SELECT stream_id, unnest(generate_series(t_start // {SAMPLE}, greatest(t_start, t_end - 1) // {SAMPLE})) AS w FROM obs) GROUP BY 1")
def covered_windows(spark, d):
    got = intervals.covered_windows(obs_view(spark, d).select("stream_id", "t_start", "t_end"), SAMPLE)
    return got.groupBy("stream_id").agg(F.count_distinct("window_id").alias("n_windows"), F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"))


@query(OBS_SQL + f" SELECT ((t_start + t_end) // 2) // {SAMPLE} AS window_id, count(*) AS n, count(DISTINCT stream_id) AS n_streams FROM obs GROUP BY 1")
def window_of(spark, d):
    mid = F.floor((F.col("t_start") + F.col("t_end")) / 2)
    return obs_view(spark, d).groupBy(F.expr(f"((t_start + t_end) div 2) div {SAMPLE}").alias("window_id")).agg(F.count("*").alias("n"), F.count_distinct("stream_id").alias("n_streams"))


SWEEP_SQL = """, live AS (SELECT * FROM obs WHERE t_end > t_start), bounds AS (SELECT DISTINCT stream_id, t FROM (SELECT stream_id, t_start AS t FROM obs UNION ALL SELECT stream_id, t_end FROM obs)),
 segs AS (SELECT stream_id, t AS s, lead(t) OVER (PARTITION BY stream_id ORDER BY t) AS e FROM bounds),
 ons AS (SELECT g.stream_id, g.s, g.e, list_sort(list(o.event_id)) AS items FROM segs g JOIN live o ON o.stream_id = g.stream_id AND o.t_start <= g.s AND o.t_end >= g.e WHERE g.e IS NOT NULL GROUP BY 1, 2, 3),
 pre AS (SELECT *, lag(items) OVER w AS pi, lag(e) OVER w AS pe FROM ons WINDOW w AS (PARTITION BY stream_id ORDER BY s)),
 num AS (SELECT *, sum(CASE WHEN pi IS NULL OR pi <> items OR pe <> s THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY s) AS k FROM pre),
 seg AS (SELECT stream_id, min(s) AS seg_start, max(e) AS seg_end, arg_min(items, s) AS items FROM num GROUP BY stream_id, k)"""


def sweep_view(spark, d):
    return intervals.sweep(obs_view(spark, d).select("stream_id", "event_id", "t_start", "t_end"), ["stream_id"], "event_id")


@query(OBS_SQL + SWEEP_SQL + " SELECT stream_id, seg_start, seg_end, array_to_string(items, ',') AS items FROM seg")
def segment_sweep(spark, d):
    return sweep_view(spark, d).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query(OBS_SQL + SWEEP_SQL + """, g AS (SELECT *, lag(items) OVER w AS pi, lag(seg_end) OVER w AS pe FROM seg WINDOW w AS (PARTITION BY stream_id ORDER BY seg_start)),
 h AS (SELECT *, sum(CASE WHEN pi IS NOT NULL AND pe = seg_start AND list_has_all(items, pi) AND len(pi) < len(items) THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY seg_start) AS k FROM g)
 SELECT stream_id, min(seg_start) AS seg_start, max(seg_end) AS seg_end, array_to_string(arg_max(items, seg_start), ',') AS items, count(*) AS n_steps FROM h GROUP BY stream_id, k""")
def merge_growing(spark, d):
    return intervals.merge_growing(sweep_view(spark, d), ["stream_id"]).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query(OBS_SQL + UNION_SQL + f", r AS (SELECT *, max(t_end - t_start) OVER (PARTITION BY stream_id) AS longest, row_number() OVER (PARTITION BY stream_id ORDER BY t_start) AS n FROM merged) SELECT stream_id, t_start, t_end FROM r WHERE t_end - t_start >= {2 * HOUR} OR (longest < {2 * HOUR} AND n = 1)")
def drop_slivers(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id")
    m = intervals.merge_intervals(obs_view(spark, d), ["stream_id"]).withColumn("_d", F.col("t_end") - F.col("t_start"))
    m = m.withColumns({"_m": F.max("_d").over(w), "_n": F.row_number().over(w.orderBy("t_start"))})
    return m.where((F.col("_d") >= 2 * HOUR) | ((F.col("_m") < 2 * HOUR) & (F.col("_n") == 1))).select("stream_id", "t_start", "t_end")


@query(OBS_SQL + f""", l AS (SELECT DISTINCT stream_id, t_us // {24 * HOUR} AS cue, text FROM obs), n AS (SELECT stream_id, count(DISTINCT cue) AS n_cues FROM l GROUP BY 1 HAVING count(DISTINCT cue) >= 10)
 SELECT stream_id, text, count(*) AS n_in, n_cues, round(count(*) / n_cues, 9) AS share FROM l JOIN n USING (stream_id) WHERE length(text) <= 6 GROUP BY stream_id, text, n_cues HAVING count(*) / n_cues >= 0.4""")
def persistent_ui(spark, d):
    lines = obs_view(spark, d).select("stream_id", "text", F.floor(F.col("t_us") / (24 * HOUR)).alias("cue"))
    return regions.persistent_lines(lines, ["stream_id"], "cue", "text", 0.4, 6, 10).withColumn("share", F.round("share", 9))


FEATURE_SQL = OBS_SQL + RUNS_SQL + f""", reg AS (SELECT *, stream_id % 40 AS region FROM runs),
 ranks AS (SELECT region, t_end - t_start AS dur, row_number() OVER (PARTITION BY region ORDER BY t_end - t_start) - 1 AS k, count(*) OVER (PARTITION BY region) AS n FROM reg),
 lens AS (SELECT region, length(text) AS l, row_number() OVER (PARTITION BY region ORDER BY length(text)) - 1 AS k, count(*) OVER (PARTITION BY region) AS n FROM reg),
 p50 AS (SELECT region, dur AS dur_p50 FROM ranks WHERE k = round_even(0.5 * (n - 1), 0)), p90 AS (SELECT region, l AS len_p90 FROM lens WHERE k = round_even(0.9 * (n - 1), 0)),
 win AS (SELECT region, count(DISTINCT w) AS n_windows, max(w) - min(w) + 1 AS window_span FROM (SELECT region, unnest(generate_series(t_start // {24 * HOUR}, (t_end - 1) // {24 * HOUR})) AS w FROM reg) GROUP BY 1),
 feat AS (SELECT region, count(*) AS n_runs, count(DISTINCT text) AS n_texts, round(avg(conf), 6) AS mean_conf FROM reg GROUP BY 1),
 feats AS (SELECT f.*, dur_p50, len_p90, n_windows, window_span, round(n_windows / window_span, 9) AS persistence FROM feat f JOIN p50 USING (region) JOIN p90 USING (region) JOIN win USING (region)),
 labels_ AS (SELECT *, CASE WHEN n_runs < 5 THEN 'noise' WHEN persistence >= 0.5 AND n_texts / n_runs <= 0.05 THEN 'ui' WHEN persistence < 0.05 THEN 'sparse' ELSE 'dialogue' END AS label FROM feats),
 scored AS (SELECT *, round(CASE WHEN label IN ('noise', 'ui') THEN 0.0 ELSE sqrt(n_runs) * persistence END, 6) AS score FROM labels_)"""


def feature_view(spark, d):
    f = regions.features(run_view(spark, d).withColumn("region", F.col("stream_id") % 40), ["region"], 24 * HOUR)
    f = f.withColumns({"mean_conf": F.round("mean_conf", 6), "persistence": F.round("persistence", 9)}).drop("max_conf")
    f = f.withColumn("label", regions.label(F.col("n_runs"), F.col("persistence"), F.col("n_texts") / F.col("n_runs")))
    return f.withColumn("score", F.round(regions.score(F.col("label"), F.col("n_runs"), F.col("persistence")), 6))


@query(FEATURE_SQL + " SELECT * FROM scored")
def region_features(spark, d):
    return feature_view(spark, d)


@query(FEATURE_SQL + " SELECT region, label, score FROM scored WHERE score > 0 ORDER BY score DESC, region LIMIT 5")
def main_pick(spark, d):
    return regions.pick_main(feature_view(spark, d), "region").select("region", "label", "score")


@query("WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem) SELECT l_returnflag, l_linestatus, l_extendedprice AS p90 FROM r WHERE k = round_even(0.9 * (n - 1), 0)")
def nearest_rank_pct(spark, d):
    return T.nearest_rank(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9, "p90")


def two_lists(spark, d, a, b):
    o = obs_view(spark, d)
    left = o.where(F.col("text") == a).select("stream_id", "event_id", "t_start", "t_end")
    right = o.where(F.col("text") == b).select("stream_id", F.col("event_id").alias("other_id"), F.col("t_start").alias("u_start"), F.col("t_end").alias("u_end"))
    return left, right


@query(OBS_SQL + " SELECT DISTINCT a.stream_id FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND a.text = 'view' AND b.text = 'click' AND least(a.t_end, b.t_end) > greatest(a.t_start, b.t_start)")
def cooccur(spark, d):
    return intervals.overlap_join(*two_lists(spark, d, "view", "click"), ["stream_id"], HOUR).select("stream_id").distinct()


@query(OBS_SQL + ", p AS (SELECT stream_id, text, lag(text) OVER (PARTITION BY stream_id ORDER BY t_us, CASE text WHEN 'view' THEN 'a' ELSE 'b' END) AS q FROM obs WHERE text IN ('view', 'click')) SELECT stream_id, count(*) FILTER (q <> text) AS n_alternations FROM p GROUP BY 1")
def alternations(spark, d):
    o = obs_view(spark, d)
    return intervals.alternations(o.where("text = 'view'"), o.where("text = 'click'"), ["stream_id"], "t_us")


@query(OBS_SQL + ", j AS (SELECT a.stream_id, a.event_id, b.event_id AS other_id, least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start) AS overlap_us FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND a.text = 'purchase' AND b.text = 'view' WHERE least(a.t_end, b.t_end) > greatest(a.t_start, b.t_start)) SELECT stream_id, event_id, other_id, overlap_us FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap_us DESC, other_id) AS r FROM j) WHERE r = 1")
def overlap_argmax_join(spark, d):
    pairs = intervals.overlap_join(*two_lists(spark, d, "purchase", "view"), ["stream_id"], HOUR)
    return intervals.best_overlap(pairs, ["event_id"], ["other_id"]).select("stream_id", "event_id", "other_id", "overlap_us")


@query(OBS_SQL + ", e AS (SELECT * FROM obs WHERE text = 'error') SELECT e.event_id, e.stream_id, coalesce((SELECT max(v.t_us) FROM obs v WHERE v.text = 'view' AND v.stream_id = e.stream_id AND v.t_us <= e.t_us), -1) AS before_us, coalesce((SELECT min(v.t_us) FROM obs v WHERE v.text = 'view' AND v.stream_id = e.stream_id AND v.t_us >= e.t_us), -1) AS after_us FROM e")
def asof_flank(spark, d):
    o = obs_view(spark, d)
    e = o.where("text = 'error'").select("event_id", "stream_id", "t_us")
    v = o.where("text = 'view'").select("stream_id", "t_us", F.col("t_us").alias("before_us"), F.col("t_us").alias("after_us"))
    got = intervals.asof(e, v.drop("after_us"), ["stream_id"], "t_us", "before_us")
    return intervals.asof(got, v.drop("before_us"), ["stream_id"], "t_us", "after_us", backward=False).select("event_id", "stream_id", F.coalesce("before_us", F.lit(-1)).alias("before_us"), F.coalesce("after_us", F.lit(-1)).alias("after_us"))


@query(OBS_SQL + " SELECT a.stream_id, count(*) AS n_pairs, CAST(sum(least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start)) AS BIGINT) AS overlap_us FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND a.text = 'signup' AND b.text = 'click' AND least(a.t_end, b.t_end) > greatest(a.t_start, b.t_start) GROUP BY 1")
def interval_bucket_join(spark, d):
    pairs = intervals.overlap_join(*two_lists(spark, d, "signup", "click"), ["stream_id"], HOUR)
    return pairs.groupBy("stream_id").agg(F.count("*").alias("n_pairs"), F.sum("overlap_us").alias("overlap_us"))


@query(OBS_SQL + """, p AS (SELECT *, lag(x0) OVER w AS a0, lag(y0) OVER w AS b0, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1 FROM obs WINDOW w AS (PARTITION BY stream_id ORDER BY t_us)),
 q AS (SELECT *, greatest(0, least(x1, a1) - greatest(x0, a0)) AS sx, greatest(0, least(y1, b1) - greatest(y0, b0)) AS sy, (x1 - x0) * (y1 - y0) AS sa, (a1 - a0) * (b1 - b0) AS sb FROM p WHERE a0 IS NOT NULL)
 SELECT event_id, round(sx * sy / (sa + sb - sx * sy), 9) AS iou, round(sx / least(x1 - x0, a1 - a0), 9) AS x_ratio, sy >= 0.5 * least(y1 - y0, b1 - b0) AND greatest(y1 - y0, b1 - b0) / least(y1 - y0, b1 - b0) <= 1.7 AS same_row, sx > 0 AND sy > 0 AS crosses, round(sx * sy / sa, 9) AS inside FROM q""")
def box_pairs(spark, d):
    from pyspark.sql import Window

    o = obs_view(spark, d).withColumn("p", F.lag("box").over(Window.partitionBy("stream_id").orderBy("t_us"))).where("p is not null")
    a, b = F.col("box"), F.col("p")
    return o.select("event_id", F.round(G.iou(a, b), 9).alias("iou"), F.round(G.x_overlap_ratio(a, b), 9).alias("x_ratio"), G.same_row(a, b).alias("same_row"), G.boxes_cross(a, b).alias("crosses"), F.round(G.box_inside(a, b), 9).alias("inside"))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, value, lead(user_id) OVER (ORDER BY event_id) AS n FROM events), nodes AS (SELECT DISTINCT user_id AS id FROM events),
 edges AS (SELECT user_id AS a, n AS b FROM o WHERE value > 250 AND n IS NOT NULL UNION SELECT n, user_id FROM o WHERE value > 250 AND n IS NOT NULL),
 reach AS (SELECT id, id AS to_ FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.to_) SELECT id, min(to_) AS component FROM reach GROUP BY 1""")
def connected_components(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    # Event ids have no holes, so the next event is found by an equi-join and not by one global sort. The few events that lead on are a table, so that joins know its size.
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("n"))
    leads = written(e.where("value > 250").select("event_id", "user_id"), "leads")
    edges = leads.join(nxt, "event_id").select(F.lit(0).alias("g"), F.col("user_id").alias("a"), F.col("n").alias("b"))
    return graph.components(e.select(F.lit(0).alias("g"), F.col("user_id").alias("id")).distinct(), edges, ["g"]).select("id", "component")


@query(OBS_SQL + f", l AS (SELECT *, lag(t_us) OVER (PARTITION BY stream_id ORDER BY t_us) AS p FROM obs), m AS (SELECT *, sum(CASE WHEN p IS NULL OR t_us - p > {3 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY t_us) AS k FROM l) SELECT stream_id, min(t_us) AS t_start, max(t_us) AS t_end, count(*) AS n FROM m GROUP BY stream_id, k")
def episodes(spark, d):
    got = intervals.gap_islands(obs_view(spark, d).select("stream_id", "t_us"), ["stream_id"], "t_us", 3 * HOUR)
    return got.groupBy("stream_id", "island").agg(F.min("t_us").alias("t_start"), F.max("t_us").alias("t_end"), F.count("*").alias("n")).drop("island")


@query("""WITH q AS (SELECT item_id AS q_id, list_distinct([substring(text, i, 12) FOR i IN generate_series(1, length(text) - 11)]) AS g FROM benchmark WHERE length(text) >= 12),
 l AS (SELECT doc_id AS item_id, unnest(list_distinct([substring(text, i, 12) FOR i IN generate_series(1, length(text) - 11)])) AS gram FROM documents WHERE length(text) >= 12),
 s AS (SELECT q_id, item_id, count(*) AS n_shared, any_value(n) AS n_grams FROM (SELECT q_id, len(g) AS n, unnest(g) AS gram FROM q) JOIN l USING (gram) GROUP BY 1, 2)
 SELECT q_id, item_id, n_shared, n_grams FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n_shared DESC, item_id) AS r FROM s WHERE n_shared >= 2 AND n_shared >= 0.25 * n_grams) WHERE r <= 6""")
def ngram_topk(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    lib = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return retrieval.ngram_candidates(q, lib, n=12)


@query(LINES_SQL + ", f AS (SELECT text, min(doc_id * 100000 + line_no) AS item_id, count(*) AS n_library FROM lines GROUP BY 1) SELECT doc_id, line_no, item_id, n_library FROM lines JOIN f USING (text) WHERE n_library > 1")
def exact_line_claim(spark, d):
    lines = line_view(spark, d).select("doc_id", "line_no", "text")
    lib = lines.select((F.col("doc_id") * 100000 + F.col("line_no")).alias("item_id"), "text")
    return retrieval.exact_claims(lines, lib).where("n_library > 1").select("doc_id", "line_no", "item_id", "n_library")


@query(LINES_SQL + ", a AS (SELECT doc_id, line_no, text AS line FROM lines WHERE length(text) >= 8), b AS (SELECT min(doc_id * 100000 + line_no) AS item_id, text AS full_ FROM lines WHERE length(text) >= 8 GROUP BY 2), h AS (SELECT doc_id, line_no, item_id FROM a JOIN b ON substring(line, 1, 8) = substring(full_, 1, 8) AND starts_with(full_, line) AND full_ <> line) SELECT doc_id, line_no, min(item_id) AS item_id FROM h GROUP BY 1, 2 HAVING count(*) = 1")
def prefix_claim(spark, d):
    lines = line_view(spark, d).select("doc_id", "line_no", "text")
    lib = lines.groupBy("text").agg(F.min(F.col("doc_id") * 100000 + F.col("line_no")).alias("item_id"))
    return retrieval.prefix_claims(lines, lib)


@query()
def ordered_match(spark, d):
    c = table(spark, d, "conversations")
    turns = c.select(F.col("conv_id").alias("unit"), F.col("turn").cast("long").alias("line"), "text")
    return retrieval.ordered_match(turns.select("unit", F.col("line").alias("ord"), F.expr("substring(text, 1, greatest(1, length(text) div 2))").alias("text")), turns)


@query()
def runs_fuzzy(spark, d):
    return runs.fuzzy_runs(obs_view(spark, d), SAMPLE)


@query()
def footprints(spark, d):
    return regions.footprints(obs_view(spark, d).withColumnRenamed("event_id", "item"))


CUE_SQL = "WITH cues AS (SELECT conv_id, turn, role, text, length(text) AS len, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 50000 AS t_start FROM conversations)"


def cue_view(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.length("text").alias("len"))
    c = c.withColumn("t_start", (F.coalesce(F.sum("len").over(w), F.lit(0)) * 50000).cast("long"))
    return c.withColumn("t_end", F.col("t_start") + F.col("len") * 40000)


@query(CUE_SQL + ", r AS (SELECT *, t_start + len * 40000 AS t_end, CASE WHEN len > 200 THEN 'long' ELSE 'short' END AS line FROM cues), l AS (SELECT *, lag(line) OVER w AS pl, lag(t_end) OVER w AS pe FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY t_start, t_end)), m AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> line OR t_start - pe > 2000000 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY t_start, t_end ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT conv_id, min(line) AS line, CAST(min(t_start) AS BIGINT) AS t_start, CAST(max(t_end) AS BIGINT) AS t_end, count(*) AS n_records, max(len) AS longest FROM m GROUP BY conv_id, k")
def merge_records(spark, d):
    r = cue_view(spark, d).withColumn("line", F.when(F.col("len") > 200, "long").otherwise("short"))
    return retrieval.merge_records(r, ["conv_id"], "line", 2 * T.SECOND)


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'primary' WHEN doc_id - min(doc_id) OVER (PARTITION BY text) <= 100 THEN 'same_time' ELSE 'replay' END AS echo FROM documents")
def echo_classify(spark, d):
    return retrieval.echoes(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", "doc_id", 100).select("doc_id", "echo")


@query(LINES_SQL + " SELECT count(*) AS n_lines_again, CAST(sum(n - 1) AS BIGINT) AS n_surplus FROM (SELECT text, count(*) AS n FROM lines GROUP BY 1) WHERE n >= 2")
def repeat_claims(spark, d):
    return line_view(spark, d).groupBy("text").agg(F.count("*").alias("n")).where("n >= 2").agg(F.count("*").alias("n_lines_again"), F.sum(F.col("n") - 1).alias("n_surplus"))


@query(LINES_SQL + ", a AS (SELECT text FROM lines WHERE source = 'src0'), b AS (SELECT text FROM lines WHERE source = 'src1') SELECT text, 'lost' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT text, 'gained' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def hitset_delta(spark, d):
    lines = line_view(spark, d)
    return audit.multiset_delta(lines.where("source = 'src0'").select("text"), lines.where("source = 'src1'").select("text"))


@query(LINES_SQL + ", a AS (SELECT text FROM lines WHERE source = 'src0'), b AS (SELECT text FROM lines WHERE source = 'src1'), i AS (SELECT count(*) AS n_both FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)) SELECT n_both, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, 2 * n_both / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)) AS dice FROM i")
def obs_dice(spark, d):
    lines = line_view(spark, d)
    return audit.dice(lines.where("source = 'src0'").select("text"), lines.where("source = 'src1'").select("text"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) SELECT user_id, event_type, n, CAST(total AS BIGINT) AS total FROM n WHERE r = 1 AND n > 0.25 * total AND total >= 3")
def majority_vote(spark, d):
    return regions.majority(table(spark, d, "events").select("user_id", "event_type"), ["user_id"], "event_type", 3, 0.25)


@query("WITH c AS (SELECT lang, length(text) - length(regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g')) AS latin, length(text) - length(regexp_replace(text, '[぀-ヿ]', '', 'g')) AS kana, length(text) - length(regexp_replace(text, '[㐀-䶿一-鿿]', '', 'g')) AS han, length(text) - length(regexp_replace(text, '[가-힯]', '', 'g')) AS hangul FROM documents) SELECT lang, CASE WHEN greatest(kana, han, hangul, latin) = 0 THEN 'none' WHEN kana = greatest(kana, han, hangul, latin) THEN 'kana' WHEN han = greatest(kana, han, hangul, latin) THEN 'han' WHEN hangul = greatest(kana, han, hangul, latin) THEN 'hangul' ELSE 'latin' END AS script, count(*) AS n, CAST(sum(latin) AS BIGINT) AS n_latin FROM c GROUP BY 1, 2")
def lang_vote(spark, d):
    docs = table(spark, d, "documents").select("lang", "text")
    return docs.select("lang", X.dominant_script(F.col("text")).alias("script"), X.count_script(F.col("text"), "latin").alias("c")).groupBy("lang", "script").agg(F.count("*").alias("n"), F.sum("c").cast("long").alias("n_latin"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def markup_strip(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@query(LINES_SQL + " SELECT doc_id, count(*) AS n_paragraphs, max(length(text)) AS longest FROM lines GROUP BY 1")
def paragraphs(spark, d):
    return line_view(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max(F.length("text")).alias("longest"))


@query("WITH g AS (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'on' ELSE 'off' END AS tier FROM conversations) SELECT conv_id, turn, role FROM conversations JOIN g USING (conv_id) WHERE tier = 'always' OR (tier = 'on' AND role <> 'system') OR (tier = 'off' AND conv_id % 10 = 2)")
def visibility_filter(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    tier = F.when(F.col("conv_id") % 3 == 0, "always").when(F.col("conv_id") % 3 == 1, "on").otherwise("off")
    seen = (tier == "always") | ((tier == "on") & (F.col("role") != "system")) | ((tier == "off") & (F.col("conv_id") % 10 == 2))
    return c.where(seen)


@query(OBS_SQL + """, t AS (SELECT event_id, t_us % 86400000000 AS a, t_us % 86400000000 + 1234567 AS z FROM obs)
 SELECT event_id, printf('%02d:%02d:%02d,%03d', a // 3600000000, a // 60000000 % 60, a // 1000000 % 60, a // 1000 % 1000) AS srt, printf('%d:%02d:%02d.%02d', (a + 9999) // 10000 // 360000, (a + 9999) // 10000 // 6000 % 60, (a + 9999) // 10000 // 100 % 60, (a + 9999) // 10000 % 100) AS ass_start, printf('%d:%02d:%02d.%02d', z // 3600000000, z // 60000000 % 60, z // 1000000 % 60, z // 10000 % 100) AS ass_end FROM t""")
def srt_format(spark, d):
    a = F.col("t_us") % (24 * HOUR)
    return obs_view(spark, d).select("event_id", T.srt_time(a).alias("srt"), T.ass_time(a, True).alias("ass_start"), T.ass_time(a + 1_234_567, False).alias("ass_end"))


@query(CUE_SQL + ", p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM cues) SELECT role, count(*) AS n_cues, count(DISTINCT conv_id) AS n_units, quantile_cont(CAST(len AS DOUBLE), 0.5) AS len_p50, count(*) FILTER (q = text) AS n_verbatim_again, count(*) FILTER (len < 20) AS n_short FROM p GROUP BY 1")
def track_health(spark, d):
    from pyspark.sql import Window

    c = cue_view(spark, d).withColumn("q", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("role").agg(F.count("*").alias("n_cues"), F.count_distinct("conv_id").alias("n_units"), F.percentile("len", 0.5).alias("len_p50"), F.count_if(F.col("q") == F.col("text")).alias("n_verbatim_again"), F.count_if(F.col("len") < 20).alias("n_short"))


@query(OBS_SQL + f", k AS (SELECT stream_id, k, count(*) AS n FROM (SELECT stream_id, unnest(generate_series((t_start + {HOUR // 4} - 1) // {HOUR // 4}, (t_end + {HOUR // 4} - 1) // {HOUR // 4} - 1)) AS k FROM obs) GROUP BY 1, 2) SELECT stream_id, max(n) AS most, count(*) FILTER (n >= 2) AS n_crowded FROM k GROUP BY 1")
def concurrent_blocks(spark, d):
    return audit.concurrency(obs_view(spark, d).select("stream_id", "t_start", "t_end"), ["stream_id"], HOUR // 4)


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem),
 m AS (SELECT a.l_suppkey, a.l_orderkey, a.l_linenumber, a.v, quantile_cont(b.v, 0.5) AS neighbour_median, count(*) AS n FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND b.k BETWEEN a.k - 5 AND a.k + 5 AND b.k <> a.k GROUP BY ALL) SELECT l_suppkey, l_orderkey, l_linenumber, v, round(neighbour_median, 4) AS neighbour_median FROM m WHERE n >= 5 AND (v > 3 * neighbour_median OR v * 3 < neighbour_median)""")
def neighbour_outliers(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    return audit.neighbour_outliers(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "v"], "v").withColumn("neighbour_median", F.round("neighbour_median", 4))


@query(OBS_SQL + ", p AS (SELECT stream_id, t_us / 86400000000 AS x, value AS y FROM obs), s AS (SELECT a.stream_id, greatest(0, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5)) AS slope, count(*) AS n_pairs FROM p a JOIN p b ON a.stream_id = b.stream_id AND b.x > a.x GROUP BY 1) SELECT stream_id, round(any_value(slope), 6) AS slope, any_value(n_pairs) AS n_pairs, round(quantile_cont(y - slope * x, 0.5), 4) AS intercept FROM p JOIN s USING (stream_id) GROUP BY 1")
def theil_sen(spark, d):
    p = obs_view(spark, d).select("stream_id", (F.col("t_us") / (24 * HOUR)).alias("x"), F.col("value").alias("y"))
    got = audit.theil_sen(p, ["stream_id"], "x", "y")
    return got.select("stream_id", F.round("slope", 6).alias("slope"), "n_pairs", F.round("intercept", 4).alias("intercept"))


@query("WITH g AS (SELECT CAST(ceil(k * 60 / 22) AS BIGINT) AS frame FROM range(1000) t(k)) SELECT i AS frame, i IN (SELECT frame FROM g) AS on_grid FROM range(1000) t(i)")
def time_grid(spark, d):
    return spark.range(1000).select(F.col("id").alias("frame"), T.in_grid(F.col("id"), 22, 60).alias("on_grid"))


@query(LINES_SQL + ", f AS (SELECT text, min(doc_id) AS first_doc FROM lines GROUP BY 1) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first_doc < doc_id) AS n_seen, count(*) FILTER (first_doc < doc_id) >= 0.5 * count(*) AS duplicate FROM lines JOIN f USING (text) GROUP BY 1")
def dup_units(spark, d):
    lines = line_view(spark, d).select("doc_id", "text")
    first = lines.groupBy("text").agg(F.min("doc_id").alias("first_doc"))
    seen = F.count_if(F.col("first_doc") < F.col("doc_id"))
    return lines.join(first, "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), seen.alias("n_seen"), (seen >= 0.5 * F.count("*")).alias("duplicate"))


@query("SELECT lang, quality, toxic, count(*) AS n, count(*) FILTER (length(text) < 200) AS n_short, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def coverage_eval(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("l")).join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("l") < 200).alias("n_short"), F.sum("l").cast("long").alias("n_chars"))


@query("SELECT a.vec_id, b.vec_id AS other_id, round(1 / (1 + exp(-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS affinity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_affinity(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = e.select(F.col("vec_id").alias("other_id"), (F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    dot = F.aggregate(F.zip_with("v", "u", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.join(b, "vec_id").select("vec_id", "other_id", F.round(1 / (1 + F.exp(-dot)), 6).alias("affinity"))


@query(OBS_SQL + f", l AS (SELECT *, lag(t_us) OVER (PARTITION BY stream_id, text ORDER BY t_us) AS p FROM obs), m AS (SELECT *, sum(CASE WHEN p IS NULL OR t_us - p >= {SAMPLE} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, text ORDER BY t_us) AS k FROM l) SELECT stream_id, text, count(*) AS n_obs, min(t_us) AS t_start, max(t_us) AS t_last FROM m GROUP BY stream_id, text, k")
def stream_runs(spark, d):
    """The events file read as a stream; equal to the batch form."""
    from ..streaming.runs import drain, session_runs

    schema = table(spark, d, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    obs = src.select(F.col("user_id").alias("stream_id"), T.micros(F.col("ts")).alias("t_us"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    return drain(session_runs(obs, "6 hours", "1 hour"))


@query("WITH e AS (SELECT event_id % 9900 AS id, user_id AS region, value FROM events) SELECT rule, count(*) AS n FROM (SELECT 'id repeats' AS rule FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'end before start' FROM e WHERE value < 1 UNION ALL SELECT 'unknown region' FROM e WHERE region NOT IN (SELECT user_id FROM events WHERE value > 150)) GROUP BY 1")
def artifact_violations(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 9900).alias("id"), F.col("user_id").alias("region"), F.lit(1.0).alias("t_start"), F.col("value").alias("t_end"), "value")
    return audit.violations(e, e.where("value > 150").select("region").distinct())
