"""Planted cases for operators whose order or text matching SQL can't state, and edge cases."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glyphstream.functions import texts, times
from glyphstream.operators import graph, intervals, regions, retrieval, runs
from glyphstream.sources import subtitles


def ticks(*rows):
    return pd.DataFrame([(t, x, c, *b) for t, x, c, b in rows], columns=["t_us", "text", "conf", "x0", "y0", "x1", "y1"])


BOX = (0.0, 0.0, 100.0, 20.0)


def test_static_text_is_one_run():
    got = runs.fuzzy_runs_of(ticks(*[(k * 100 + k % 2, "hello", 0.9, BOX) for k in range(20)]), 100)
    assert [(r["text"], r["n_obs"]) for r in got] == [("hello", 20)]


def test_gap_needs_tolerance():
    rows = ticks(*[(k * 100, "hello", 0.9, BOX) for k in (0, 1, 3, 4)])
    assert len(runs.fuzzy_runs_of(rows, 100)) == 2
    assert len(runs.fuzzy_runs_of(rows, 100, gap=1)) == 1


def test_two_boxes_of_a_tick_are_two_runs():
    got = runs.fuzzy_runs_of(ticks((0, "hello", 0.9, BOX), (0, "hello", 0.8, BOX)), 100)
    assert [r["n_obs"] for r in got] == [1, 1]


def test_typewriter_is_one_run_with_its_longest_text():
    words = ["he", "hello", "hello wor", "hello world"]
    got = runs.fuzzy_runs_of(ticks(*[(k * 100, w, 0.9, (0.0, 0.0, 10.0 * len(w), 20.0)) for k, w in enumerate(words)]), 100)
    assert [r["text"] for r in got] == ["hello world"]


def test_pairs_one_by_one_score_as_arrays_do():
    pick = random.Random(5)
    for _ in range(2000):
        a, b = ((x := pick.choice([0.0, 5.0, 12.5]), y := pick.choice([0.0, 3.0]), x + pick.choice([0.0, 40.0, 47.0, 80.0]), y + pick.choice([0.0, 20.0, 34.0, 36.0])) for _ in range(2))
        assert runs._place_score(b, a) == runs.place_scores(np.array([a]), np.array([b]))[0, 0]
        assert runs._could_grow(a, b) == runs.could_grow(np.array([a]), np.array([b]))[0, 0]


def test_fuzzy_runs_open_no_frame_for_a_stream_or_tick(spark, monkeypatch):
    """Thousands of short streams in one task, against each stream alone; a frame a stream or tick costs about a millisecond each."""
    pick = random.Random(6)
    rows = [(s if s else None, k * 60 + pick.randrange(90), pick.choice(["hello", "hello w", "other"]), pick.random(), (pick.choice([0.0, 4.0]), 0.0, pick.choice([60.0, 90.0]), 20.0)) for s in range(3000) for k in range(6)]
    df = spark.createDataFrame(rows, "stream_id long, t_us long, text string, conf double, box struct<x0: double, y0: double, x1: double, y1: double>").coalesce(1)
    got = runs.fuzzy_runs(df, 100)
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "FlatMapGroups" not in got._jdf.queryExecution().toString()
    want = []
    for s in range(3000):
        want += [(s or None, r["t_start"], r["t_end"], r["text"], r["n_obs"], r["conf"]) for r in runs.fuzzy_runs_of(ticks(*[r[1:] for r in rows if r[0] == (s or None)]) if s < 40 or s > 2990 else ticks(), 100)]
    chosen = {x for x in range(3000) if x < 40 or x > 2990}
    assert sorted(map(repr, (tuple(r) for r in got.collect() if (r.stream_id or 0) in chosen))) == sorted(map(repr, want))


def test_sliding_windows_are_stitched():
    assert texts.stitch(["thequickbrown", "quickbrownfox", "brownfoxjumps"]) == "thequickbrownfoxjumps"


def test_window_hashes_tell_windows_apart():
    text = "".join(random.Random(4).choices("ab世𝄞 ", k=3000))
    for n in (1, 2, 3, 5, 12, 13):
        got = texts.window_hashes(text, n).tolist()
        windows = [text[i : i + n] for i in range(len(text) - n + 1)]
        assert len(got) == len(windows) and len(set(zip(got, windows, strict=True))) == len(set(got)) == len(set(windows))
    assert len(texts.window_hashes("abc", 5)) == len(texts.window_hashes("", 1)) == 0


def test_only_grams_of_queries_are_joined(spark):
    """Few of the library's grams leave the first step; none of a query's is lost, whatever the texts' lengths, and none spans two texts."""
    pick = random.Random(8)
    lines = ["".join(pick.choices("abcd世𝄞 ", k=k)) for k in (0, 4, 5, 300, 3000, retrieval.GRAM_CHARS + 30_000)] + [None]
    ask = [lines[5][-40:], lines[3][:90], "abcd", "no such words at all", lines[4][-3:] + lines[5][:3], None]
    queries = spark.createDataFrame(list(enumerate(ask)), "q_id long, text string")
    library = spark.createDataFrame([(f"i{k}", x) for k, x in enumerate(lines)], "item_id string, text string").coalesce(1)
    cut = lambda x: {x[i : i + 5] for i in range(len(x or "") - 4)}
    wanted = set().union(*map(cut, ask))
    got = {tuple(r) for r in retrieval.grams_in(retrieval.gram_table(queries.select("text"), 5), library, 5).collect()}
    every = {(f"i{k}", g) for k, x in enumerate(lines) for g in cut(x)}
    assert {x for x in every if x[1] in wanted} <= got <= every and len(got) < 0.1 * len(every)
    hits = {(r.q_id, r.item_id, r.n_shared, r.n_grams) for r in retrieval.ngram_candidates(queries, library, n=5).collect()}
    want = {(q, f"i{k}", len(cut(a) & cut(x)), len(cut(a))) for q, a in enumerate(ask) for k, x in enumerate(lines) if len(cut(a) & cut(x)) >= max(2, 0.25 * len(cut(a)))}
    assert hits == want


def test_ordered_match_follows_the_script():
    lines = ["alpha one line", "beta two line", "gamma three line", "delta four line"]
    assert retrieval.ordered_match_of(["alpha one lin", "gamma three", "zzzzqqqq"], lines) == [0, 2, -1]


def test_ordered_match_compares_whole_lines(spark):
    """Lines alike in their first 400 characters and different after."""
    head = "the same words again and again " * 14
    script = spark.createDataFrame([(1, k, head + x) for k, x in enumerate(["to the north", "far to the south", "beyond", "b" * 900])], "unit long, line long, text string")
    cues = spark.createDataFrame([(1, 0, head + "far to the south"), (1, 1, head + "b" * 900), (1, 2, head + "c" * 2000)], "unit long, ord long, text string")
    assert {r.ord: r.line for r in retrieval.ordered_match(cues, script).collect()} == {0: 1, 1: 3, 2: None}


def brute_ordered_match(cues, lines, window=10, least=0.5, jump=0.7):
    def like(a, b):
        if a == b:
            return 1.0
        return 0.95 if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)) else SequenceMatcher(None, a, b, autojunk=False).ratio()

    cursor, out = 0, []
    for cue in cues:
        every = [like(cue, x) for x in lines]
        best = max(range(cursor, min(len(lines), cursor + window)), key=lambda k: (every[k], -k), default=-1)
        sure = every[best] if best >= 0 else 0.0
        if sure < 0.9:
            far = max(range(len(lines)), key=lambda k: (every[k], -k), default=-1)
            if far >= 0 and every[far] >= jump and every[far] > sure + 0.2:
                best, sure = far, every[far]
        out.append(best if sure >= least else -1)
        cursor = best + 1 if sure >= least else cursor
    return out


def test_ordered_match_bounds_change_nothing():
    pick = random.Random(3)
    for _ in range(300):
        lines = ["".join(pick.choices("abc ", k=pick.choice([0, 2, 5, 12, 40]))) for _ in range(pick.randint(0, 14))]
        cues = ["".join(c for c in pick.choice(lines or ["abc"]) if pick.random() < pick.choice([0.6, 0.9, 1])) for _ in range(8)]
        assert retrieval.ordered_match_of(cues, lines, window=3) == brute_ordered_match(cues, lines, window=3)


def test_reach_has_no_limit_of_steps_and_ends_on_cycles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (100, 102)]
    got = {(r.root, r.node): r.depth for r in graph.reach(spark.createDataFrame(edges, "a long, b long")).collect()}
    ring = {(100, 100): 0, (100, 101): 1, (100, 102): 1, (101, 101): 0, (101, 102): 1, (101, 100): 2, (102, 102): 0, (102, 100): 1, (102, 101): 2}
    assert got == {(a, b): b - a for a in range(40) for b in range(a, 41)} | ring


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    """Both ways against a plain search; few edges need no rounds."""
    pick = random.Random(11)
    links = [(g, pick.randrange(80), pick.randrange(80)) for g in (0, 1) for _ in range(45)] + [(1, k + 100, k + 101) for k in range(30)]
    ids = [(g, k) for g in (0, 1) for k in range(135)]
    want = {x: x[1] for x in ids}
    for _ in ids:
        for g, a, b in links:
            want[g, a] = want[g, b] = min(want[g, a], want[g, b])
    nodes, edges = spark.createDataFrame(ids, "g int, id long"), spark.createDataFrame(links, "g int, a long, b long")
    got = [graph.components(nodes, edges, ["g"])]
    in_rounds = graph._rounds
    monkeypatch.setattr(graph, "ONE_TASK", 10)
    got.append(graph.components(nodes, edges, ["g"]))
    for df in got:
        assert df.columns == ["g", "id", "component"] and {(r.g, r.id): r.component for r in df.collect()} == want
    monkeypatch.undo()

    def none(*_):
        raise AssertionError("rounds for few edges")

    monkeypatch.setattr(graph, "_rounds", none)
    assert graph.components(nodes, edges, ["g"]).count() == len(ids) and in_rounds is not none


def test_footprints_first_created_wins():
    rows = pd.DataFrame([(0, 0, 10, 10), (1, 0, 11, 10), (50, 50, 60, 60)], columns=["x0", "y0", "x1", "y1"])
    assert regions.footprints_of(rows) == [0, 0, 1]


def test_interval_union_touches_and_contains(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 10, 12), (1, 20, 21), (2, 5, 5)], "k long, t_start long, t_end long")
    got = {tuple(r) for r in intervals.merge_intervals(df, ["k"]).collect()}
    assert got == {(1, 0, 12, 3), (1, 20, 21, 1), (2, 5, 5, 1)}


def test_overlap_pairs_count_once_over_buckets(spark):
    a = spark.createDataFrame([(1, 0, 100)], "k long, t_start long, t_end long")
    b = spark.createDataFrame([(1, 5, 95)], "k long, u_start long, u_end long")
    assert [r.overlap_us for r in intervals.overlap_join(a, b, ["k"], 10).collect()] == [90]


def test_nearest_rank_is_half_even(spark):
    df = spark.createDataFrame([(1, v) for v in (10, 20)] + [(2, None)], "k long, v long")
    assert [tuple(r) for r in times.nearest_rank(df, ["k"], "v", 0.5, "p").collect()] == [(1, 10)]


def test_nearest_rank_orders_few_values(spark, tmp_path, monkeypatch):
    """Against sorting, with null keys, ties, tiny groups and cuts that miss the rank; where cuts hold, few of many values reach the window."""
    pick = random.Random(9)
    data = [(k, x) for k, n in ((1, 20_000), (2, 7), (3, 1), (None, 500)) for x in (pick.choice([float(pick.randint(0, 9)), pick.expovariate(1e-3)]) for _ in range(n))] + [(4, None)]
    df = spark.createDataFrame(data, "k long, v double")
    sizes = []
    kept = times.written
    monkeypatch.setattr(times, "written", lambda t, name: sizes.append(kept(t, name)) or sizes[-1])
    for q in (0.0, 0.37, 0.5, 0.9, 1.0):
        got = {r.k: r.p for r in times.nearest_rank(df, ["k"], "v", q, "p").collect()}
        groups = {k: sorted(x for g, x in data if g == k and x is not None) for k in (1, 2, 3, None)}
        assert got == {k: x[round(q * (len(x) - 1))] for k, x in groups.items()}
    cut = next(r for r in sizes[6].collect() if r["_k"] == 1)
    assert len({x for k, x in data if k == 1 and cut["_lo"] <= x <= cut["_hi"]}) < 100
    off = lambda t, name: kept(t.withColumns({"_lo": F.lit(-2.0), "_hi": F.lit(-1.0)}) if name == "cuts" else t, name)
    monkeypatch.setattr(times, "written", off)
    assert {r.k: r.p for r in times.nearest_rank(df, ["k"], "v", 0.9, "p").collect()} == {k: x[round(0.9 * (len(x) - 1))] for k, x in groups.items()}


def test_grid_has_the_ceilings(spark):
    got = [r.id for r in spark.range(12).where(times.in_grid(F.col("id"), 2, 5)).collect()]
    assert got == [0, 3, 5, 8, 10]


def test_folding_and_containment(spark):
    df = spark.createDataFrame([("ｱｯ", "abc", "xxabcxx"), (None, None, None)], "a string, q string, t string")
    got = df.select(texts.fold(F.col("a")), texts.contained(F.col("q"), F.col("t"))).collect()
    assert tuple(got[0]) == ("アツ", 1.0)
    assert got[1][0] is None


def test_srt_and_ass_come_back(spark, tmp_path):
    cues = spark.createDataFrame([(1_500_000, 3_000_000, ["a", "b"]), (0, 1_000_000, ["first"])], "t_start long, t_end long, lines array<string>")
    subtitles.write_srt(cues, f"{tmp_path}/x.srt")
    got = [(r.n, r.t_start, r.t_end, r.lines) for r in subtitles.read_srt(spark, f"{tmp_path}/x.srt").orderBy("n").collect()]
    assert got == [(1, 0, 1_000_000, ["first"]), (2, 1_500_000, 3_000_000, ["a", "b"])]
    assert subtitles.count_cues(spark, f"{tmp_path}/x.srt") == 2
    subtitles.ass_rows(cues).coalesce(1).write.text(f"{tmp_path}/x.ass")
    assert {(r.t_start, r.t_end, tuple(r.lines)) for r in subtitles.read_ass(spark, f"{tmp_path}/x.ass").collect()} == {(0, 1_000_000, ("first",)), (1_500_000, 3_000_000, ("a", "b"))}


def test_observations_skip_metadata_and_low_confidence(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"_meta": {"fps": 2}}\n{"frame": 1, "t_us": 5, "box": [0, 0, 1, 1], "text": "a", "conf": 0.9}\n{"frame": 2, "t_us": 6, "box": [0, 0, 1, 1], "text": "b", "conf": 0.1}\n')
    assert [(r.t_us, r.text) for r in subtitles.read_obs(spark, f"{tmp_path}/o.jsonl", 0.5).collect()] == [(5, "a")]
