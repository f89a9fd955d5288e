"""Markup of script texts: canonical tags, placeholders, wrapping, escapes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"</?(?:b|i|u|s|color|ruby)(?:=[^>]*)?>"
# Colour names.
COLOURS = {"white": "#ffffff", "black": "#000000", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "cyan": "#00ffff", "magenta": "#ff00ff", "orange": "#ffa500", "grey": "#808080", "gray": "#808080", "purple": "#800080"}
#: Characters that don't begin a line, and that don't end one.
NOT_FIRST, NOT_LAST = "、。，．・：；？！”’）〕］｝〉》」』】,.!?:;)]}", "“‘（〔［｛〈《「『【([{"


def plain(text: Column) -> Column:
    """The text without canonical tags."""
    return F.regexp_replace(text, TAG, "")


def colour(value: Column) -> Column:
    """#rrggbb of a name, of three or six digits, or of eight digits without their last two; else null."""
    v = F.lower(F.trim(value))
    names = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    three = F.regexp_replace(v, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    return F.when(v.rlike("^#[0-9a-f]{6}$"), v).when(v.rlike("^#[0-9a-f]{8}$"), F.substring(v, 1, 7)).when(v.rlike("^#[0-9a-f]{3}$"), three).otherwise(F.element_at(names, v))


def without_placeholders(text: Column) -> Column:
    """{...} placeholders go, with the doubled spaces and lonely commas they leave."""
    t = F.regexp_replace(text, r"\{[^{}]*\}", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([,.!?])", "$1"), r"([,、])(?:\s*[,、])+", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^[,、\s]+", ""), r"  +", " "))


def ass_escape(text: Column) -> Column:
    return F.replace(F.translate(text, "{}", "（）"), F.lit("\n"), F.lit("\\N"))


def wrapped(text: str, width: float) -> list[str]:
    """Lines of at most `width` full characters (half ones count half). Lines break at spaces or between wide characters, and don't begin or end with what mustn't."""
    size = lambda s: sum(1.0 if ord(c) >= 0x2E80 else 0.5 for c in s)
    units = re.findall(r"[^\s⺀-￿]+|[⺀-￿]|\s+", text)
    lines, line = [], ""
    for u in units:
        if line and size(line + u.rstrip()) > width and u[0] not in NOT_FIRST and line.rstrip()[-1:] not in NOT_LAST:
            lines.append(line.rstrip())
            line = ""
        line += u if line or not u.isspace() else ""
    return [*lines, line.rstrip()] if line.strip() else lines


def wrap(text: Column, width: float) -> Column:
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: wrapped(v, width), na_action="ignore")

    return run(text)


def ctc_text(best: Column, letters: str, blank: int = 0) -> Column:
    """Greedy decoding: of indices, repeats and then blanks go; the rest are letters counted from 1."""
    kept = F.filter(best, lambda x, i: (i == 0) | (x != F.get(best, i - 1)))
    return F.array_join(F.transform(F.filter(kept, lambda x: x != blank), lambda x: F.substring(F.lit(letters), x, F.lit(1))), "")
