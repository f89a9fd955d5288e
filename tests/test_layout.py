from pyspark.sql import functions as F

from glyphstream.functions import markup
from glyphstream.operators import layout


def test_rows_and_their_texts():
    boxes = [(0, 0, 40, 10), (50, 1, 90, 11), (0, 30, 40, 40)]
    assert layout.rows_of(boxes) == [0, 0, 1]
    assert layout.joined_rows(boxes, ["ab", "cd", "ef"]) == ["ab cd", "ef"]
    assert layout.joined_rows([(0, 0, 10, 10), (12, 0, 20, 10)], ["日", "本"]) == ["日本"]


def test_tracks_and_regions():
    boxes = [(100, 900, 500, 940), (110, 902, 480, 941), (100, 950, 400, 990), (1500, 20, 1600, 50)]
    tracks = layout.line_tracks(boxes, 1920, 1080)
    assert tracks[1] == tracks[0] and len(set(tracks)) == 3
    region = layout.window_regions(boxes, tracks, 1920)
    assert region[tracks[0]] == region[tracks[2]] != region[tracks[3]]


def test_plates_and_joint_ends():
    box = (0.0, 0.0, 50.0, 10.0)
    assert layout.plate_chains([0, 15, 100], [10, 20, 110], [box] * 3, 20) == [0, 0, 1]
    assert layout.vanish_groups([0, 1, 50], [20, 20, 60], 2) == [0, 0, 1]


def test_windows_are_clustered(spark):
    rows = [(1, k, k * 10, k * 10 + 5, (0.0, 100.0 + k % 2 * 500, 200.0, 130.0 + k % 2 * 500)) for k in range(6)]
    df = spark.createDataFrame(rows, "stream_id long, run_id long, t_start long, t_end long, box struct<x0:double,y0:double,x1:double,y1:double>")
    got = layout.cluster_windows(df, 1000, 1920, 1080).groupBy("region").count().collect()
    assert sorted(r["count"] for r in got) == [3, 3]


def test_slot_reasons(spark):
    place = lambda cx, y0, y1, h: F.struct(*[F.lit(float(v)).alias(k) for k, v in (("cx", cx), ("x0", cx - 100), ("x1", cx + 100), ("y0", y0), ("y1", y1), ("h", h))])
    a = place(500, 900, 940, 40)
    got = spark.range(1).select(*[layout.slot_fit(a, b, 1920.0) for b in (place(510, 905, 944, 38), place(500, 900, 940, 80), place(1500, 900, 940, 40), place(500, 100, 140, 40))]).first()
    assert list(got) == ["fits", "height", "across", "down"]


def test_markup(spark):
    df = spark.createDataFrame([("<b>Hi</b>, {NAME}, you", "#AbC", [0, 1, 1, 0, 1, 2]), (None, "nocolour", None)], "t string, c string, i array<int>")
    got = df.select(markup.without_placeholders(markup.plain(F.col("t"))), markup.colour(F.col("c")), markup.ctc_text(F.col("i"), "ab"), markup.wrap(F.col("t"), 6.0)).collect()
    assert list(got[0])[:3] == ["Hi, you", "#aabbcc", "aab"] and got[1][1] is None
    assert markup.wrapped("one two three", 4.0) == ["one two", "three"]
    assert markup.wrapped("日本語。日本", 3.0) == ["日本語。", "日本"]


def test_claims_go_by_passes(spark):
    from glyphstream.operators import claims

    script = ["first line here", "a second longer line", "the third line of all is being typed", "fourth: middle parts are long enough to see", "abc", "last line of it"]
    said = ["first line here", "a second longer line and more", "the third line", "middle parts are long enough", "abd", "last line of it"]
    lines = spark.createDataFrame([(1, k, 0, 1000, t) for k, t in enumerate(script)], "unit long, line long, lo long, hi long, text string")
    cues = spark.createDataFrame([(1, k, 10 * k, t) for k, t in enumerate(said)], "unit long, cue long, t_start long, said string")
    got = {(r.cue, r.line): r.how for r in claims.claim(cues, lines).collect()}
    assert got == {(0, 0): "exact", (1, 1): "contained", (2, 2): "prefix", (3, 3): "infix", (4, 4): "flanked", (5, 5): "exact"}
