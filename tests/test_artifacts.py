"""Readings, the tracks artifact and script libraries on small planted cases."""

import json

import pytest
from pyspark.sql import functions as F

from glyphstream.functions import readings as R
from glyphstream.operators import artifact, library, runs
from glyphstream.sources import subtitles


def brute_edits(part, whole):
    best = len(part)
    for i in range(len(whole) + 1):
        for j in range(i, len(whole) + 1):
            row = list(range(j - i + 1))
            for a, x in enumerate(part, 1):
                row = [a] + [0] * 0 + _next(row, x, whole[i:j], a)
            best = min(best, row[-1])
    return best


def _next(row, x, text, a):
    out = [a]
    for k, y in enumerate(text, 1):
        out.append(min(row[k] + 1, out[-1] + 1, row[k - 1] + (x != y)))
    return out[1:]


def test_edits_within_a_line():
    for part, whole in [("abc", "xxabcxx"), ("abd", "xxabcxx"), ("acb", "abc"), ("hello", "yellow"), ("zzz", "ab"), ("a", "b")]:
        assert R.edits_within(part, whole) == brute_edits(part, whole)
    assert R.edits_within("", "a") is None


def test_readings():
    assert R.one_reading("裁判の後。", "裁判の後") and R.one_reading("雪だ！ヒュー", "雪だ！ヒューヒュー!") and not R.one_reading("あ", "あい") and not R.one_reading("", "")
    assert R.can_lead("……", "雪だ") and R.can_lead("雪", "雪だ") and not R.can_lead("だ", "雪だ")
    assert R.heads_similarly("飼育展示をみ", "飼育展示を見に行く") and not R.heads_similarly("ab", "abc")
    assert not R.heads_similarly("どうして。", "どうしてユキちゃんは、")
    assert R.left_of("abcdef", "cd") == "abef" and R.left_of("abc", "") == "abc"
    assert R.long_vowels("一ホ一ス") == "一ホース" and R.screen_width("日a") == 1.5
    assert R.reads_alike("a, b", "a b!") and R.library_form("Ａ_b c…") == "Abc"
    assert R.kind_of_change("あつた", "あった") == "kana" and R.kind_of_change("ab c", "abc") == "space" and R.kind_of_change("abcd", "abxd") == "one letter" and R.kind_of_change("a!", "a") == "punctuation"
    assert len(R.gram_numbers("abcdefg")) == 3 and R.gram_numbers("abcde")[0] == R.gram_numbers("xabcde")[1] and not len(R.gram_numbers("abc"))


def test_forms_of_a_cue():
    assert R.without_heads(["Kachina", "Ha, ha"], {"Kachina"}) == (["Ha, ha"], True)
    assert R.without_heads(["Kachina: Ha!"], {"Kachina"}) == (["Ha!"], True)
    assert R.without_heads(["Paimon", "Kachina"], {"Kachina"}) == (["Paimon", "Kachina"], False)
    assert R.forms(["Kachina", "L", "Ha, ha"], {"Kachina"}) == ["LHaha", "Haha"]
    assert R.forms(["one", "two"]) == ["onetwo", "one", "two"]
    assert R.bodies_apart(["together", "together with", "quite another", "third of all"], 5) == 3


def test_runs_choose_their_text():
    texts = ["ab", "abcdef", "ab", "abc"]
    assert [runs.chosen_text(texts, how) for how in ("vote", "longest", "tail")] == ["abcdef", "abcdef", "abc"]
    assert runs.chosen_text(texts, "maxconf", [0.1, 0.2, 0.3, 0.9]) == "abc" and runs.chosen_text(texts, "conf", [0.5, 0.6, 0.5, 0.1]) == "ab"
    assert runs.types_on("日本", "日本語") and not runs.types_on("日本", "英語だ") and not runs.types_on("a", "ab")


def test_files_with_any_line_ends(spark, tmp_path):
    body = "1\n00:00:01,000 --> 00:00:02,500\nfirst\nline\n\n2\n00:00:03,000 --> 00:00:04,000\nsecond\n"
    for name, text in {"a": body, "b": body.replace("\n", "\r\n"), "c": body.replace("\n\n", "\n \t\n\n")}.items():
        (tmp_path / f"{name}.srt").write_bytes(text.encode())
        got = subtitles.read_srt(spark, f"{tmp_path}/{name}.srt").orderBy("n").collect()
        assert [(r.n, r.t_start, r.t_end, r.lines) for r in got] == [(1, 1_000_000, 2_500_000, ["first", "line"]), (2, 3_000_000, 4_000_000, ["second"])]
        assert len(got) == subtitles.count_cues(spark, f"{tmp_path}/{name}.srt")
    both = [f"{tmp_path}/a.srt", f"{tmp_path}/b.srt"]
    assert [r.file for r in subtitles.read_subs(spark, both).orderBy("ord").collect()] == [0, 0, 1, 1]
    assert [r.file for r in subtitles.read_subs(spark, both, by_time=True).orderBy("ord").collect()] == [0, 1, 0, 1]


def document(**change):
    event = lambda k: {"id": k, "region": 0, "t_start": k, "t_end": k + 5, "t_full": k + 1, "text": f"t{k}", "flags": [], "box": [0, 0, 1, 1]}
    doc = {
        "regions": [{"index": 0}],
        "events": [event(0), event(1)],
        "tracks": [
            {"id": "r0", "kind": "region", "cues": [{"id": "c0", "t_start": 0, "t_end": 6, "events": [0, 1], "hide": [1], "partial": []}]},
            {"id": "main", "kind": "main", "cues": [{"id": "c0", "t_start": 0, "t_end": 6, "events": [0], "hide": [], "partial": []}]},
        ],
    }
    return doc | change


def test_artifacts_are_read_checked_and_written(spark, tmp_path):
    good = document()
    bad = document(regions=[], events=[good["events"][0] | {"id": 7, "t_end": -1}])
    for name, doc in {"good": good, "bad": bad}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    t = artifact.load(spark, f"{tmp_path}/good.json")
    assert artifact.violations(t).collect() == [] and sorted((r.track, r.event, r.hide) for r in t["members"].collect()) == [("main", 0, False), ("r0", 0, False), ("r0", 1, True)]
    artifact.dump(t, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/events").count() == 2
    broken = artifact.load(spark, f"{tmp_path}/bad.json")
    assert {r.rule for r in artifact.violations(broken).collect()} == {"ids", "order", "full", "region", "member"}
    with pytest.raises(ValueError, match="rule"):
        artifact.dump(broken, f"{tmp_path}/never")
    lines = artifact.cue_lines(t["members"], t["events"], t["tracks"].select("doc", "track", F.lit("none").alias("text")))
    assert sorted((r.track, r.event) for r in lines.collect()) == [("main", 0), ("r0", 0)]


def test_what_is_shown():
    tiers = {"story": "always", "menu": "on", "log": "off"}
    assert artifact.shown_groups(tiers, "off") == ({"story", "menu"}, False)
    assert artifact.shown_groups(tiers, "on", show=["log"], hide=["menu", "fill"]) == ({"story", "log"}, False)
    assert artifact.shown_groups(tiers, "off", show=["all"]) == (set(tiers), True)
    for show, hide in ((["x"], []), ([], ["story"]), ([], ["all"]), (["menu"], ["menu"])):
        with pytest.raises(ValueError):
            artifact.shown_groups(tiers, "off", show, hide)


def test_heads_of_a_track(spark):
    said = ["completely different", "another sentence here", "something third", "no more of this"]
    rows = [("s", 20_000_000 * k, ["Kachina", x]) for k, x in enumerate(said)]
    rows += [("s", 20_000_000 * k, ["first half of it", "together"[: 3 + k]]) for k in range(4)] + [("s", 0, ["alone"])]
    got = library.head_lines(spark.createDataFrame(rows, "stream string, t_us long, lines array<string>")).collect()
    assert [(r.stream, r["head"]) for r in got] == [("s", "Kachina")]


def test_languages_are_paired(spark):
    rows = lambda n: spark.createDataFrame([(k, f"{n}{k}") for k in range(n)], "id long, text string")
    assert len(library.paired({"ja": rows(3), "en": rows(3)}, "id", "text").collect()) == 3
    with pytest.raises(ValueError):
        library.paired({"ja": rows(3), "en": rows(2)}, "id", "text").collect()
