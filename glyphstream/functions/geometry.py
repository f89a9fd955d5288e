"""Boxes as structs of x0, y0, x1, y1: column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def shared(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Length that two spans share; never negative."""
    return F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def shared_x(a: Column, b: Column) -> Column:
    return shared(a["x0"], a["x1"], b["x0"], b["x1"])


def shared_y(a: Column, b: Column) -> Column:
    return shared(a["y0"], a["y1"], b["y0"], b["y1"])


def iou(a: Column, b: Column) -> Column:
    both = shared_x(a, b) * shared_y(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def x_overlap_ratio(a: Column, b: Column, mutual: bool = False) -> Column:
    """Shared width over the narrower box, or over the wider one if mutual."""
    base = F.greatest(width(a), width(b)) if mutual else F.least(width(a), width(b))
    return F.when(base > 0, shared_x(a, b) / base).otherwise(F.lit(0.0))


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column, floor: float | Column = 0.0) -> Column:
    """Shared length over the shorter span, spans counting as `floor` long at least."""
    least = F.greatest(F.least(a1 - a0, b1 - b0), F.lit(floor) if not isinstance(floor, Column) else floor)
    return F.when(least > 0, shared(a0, a1, b0, b1) / least).otherwise(F.lit(0.0))


def height_ratio(a: Column, b: Column) -> Column:
    return F.greatest(height(a), height(b)) / F.greatest(F.least(height(a), height(b)), F.lit(1e-9))


def same_row(a: Column, b: Column, overlap: float = 0.5, ratio: float = 1.7) -> Column:
    return (shared_y(a, b) >= overlap * F.least(height(a), height(b))) & (height_ratio(a, b) <= ratio)


def boxes_cross(a: Column, b: Column) -> Column:
    return (shared_x(a, b) > 0) & (shared_y(a, b) > 0)


def box_inside(a: Column, b: Column) -> Column:
    """Part of a's area that lies in b."""
    return F.when(area(a) > 0, shared_x(a, b) * shared_y(a, b) / area(a)).otherwise(F.lit(0.0))


def same_plate(a: Column, b: Column) -> Column:
    """Centres within one height across and tops within half a height."""
    high = F.greatest(height(a), height(b))
    return (F.abs(a["x0"] + a["x1"] - b["x0"] - b["x1"]) <= 2 * high) & (F.abs(a["y0"] - b["y0"]) <= high / 2)


def stacked_below(a: Column, b: Column, gap: float = 3.0, edge: float = 2.0) -> Column:
    """b stands below a by at most `gap` heights of a, overlapping in x or with left edges within `edge` heights."""
    return (b["y0"] >= a["y0"]) & (b["y0"] - a["y1"] <= gap * height(a)) & ((shared_x(a, b) > 0) | (F.abs(a["x0"] - b["x0"]) <= edge * height(a)))
