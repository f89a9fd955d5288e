"""Planted cases of the timing audits."""

from glyphstream.operators import timing

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def members(spark, rows):
    return spark.createDataFrame(rows, f"item long, id long, t_start long, t_full long, item_start long, box {BOX}")


def row(y):
    return (0.0, float(y), 100.0, float(y) + 30)


def test_dragged_starts(spark):
    s = 1_000_000
    rows = [
        (1, 1, 0, s, 0, row(0)), (1, 2, 4 * s, None, 0, row(40)),  # another row three seconds after the first is whole
        (2, 3, 0, 3 * s, 0, row(0)), (2, 4, 4 * s, None, 0, row(40)),  # one second only
        (3, 5, 0, s, 0, row(0)), (3, 6, 9 * s, None, 0, row(2)),  # the same row
        (4, 7, 0, s, 0, row(0)),  # alone
        (5, 8, 0, None, 3 * s, row(0)), (5, 9, 4 * s, None, 3 * s, row(40)),  # whole not before the item begins
        (6, 10, 0, None, 0, row(0)), (6, 11, 0, None, 0, row(80)), (6, 12, 5 * s, None, 0, row(40)),  # two at once: no wait
        (7, 13, 0, None, 0, row(0)), (7, 14, 1_500_000, None, 0, row(40)),  # exactly the least wait
    ]
    got = {tuple(r) for r in timing.dragged_starts(members(spark, rows), ["item"]).collect()}
    assert got == {(1, 1, 2, 3 * s), (7, 13, 14, 1_500_000)}
    assert timing.dragged_starts(members(spark, []), ["item"]).count() == 0


def lines(spark, rows):
    return spark.createDataFrame(rows, "lane long, t long, n_chars long, reveal_us long")


def test_reveal_outliers(spark):
    rows = [(1, t, 11, 1_000_000) for t in range(9)]
    rows[4] = (1, 4, 11, 4_000_000)
    rows[6] = (1, 6, 11, 200_000)
    rows += [(2, 0, 11, 3_500_000), (2, 1, 11, 1_000_000)]  # too few neighbours: against all
    rows += [(1, 20, 3, 90_000_000), (1, 21, 11, 0), (1, 22, None, 1), (1, 23, 11, None)]  # short, at once, nulls
    got = timing.reveal_outliers(lines(spark, rows), ["lane"], ["t"]).select("lane", "t", "side").collect()
    assert {tuple(r) for r in got} == {(1, 4, "slow"), (1, 6, "fast"), (2, 0, "slow")}


def test_reveal_outliers_needs_items(spark):
    rows = [(1, t, 11, 1_000_000 * (1 + 50 * (t == 2))) for t in range(4)]
    assert timing.reveal_outliers(lines(spark, rows), ["lane"], ["t"]).count() == 0
    assert timing.reveal_outliers(lines(spark, []), ["lane"], ["t"]).count() == 0


def test_dwell_outliers(spark):
    s = 1_000_000
    rows = [(1, t, 10, 10 * t * s + s, 10 * t * s) for t in range(8)]
    rows[3] = (1, 3, 10, 36 * s, 30 * s)  # six seconds against one
    rows[5] = (1, 5, 10, 50 * s + s // 9, 50 * s)  # short stays never count
    items = spark.createDataFrame(rows, "lane long, t long, n_chars long, t_end long, shown long")
    assert [tuple(r) for r in timing.dwell_outliers(items, ["lane"], ["t"]).select("lane", "t").collect()] == [(1, 3)]
    quick = items.withColumn("t_end", items.shown + (items.t_end - items.shown) / 10)
    assert timing.dwell_outliers(quick, ["lane"], ["t"]).count() == 0  # under the least dwell
