"""What a reading on screen tells: its content, whether it can be the beginning or a part of a line, and its forms without heads."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import folded

# Characters that aren't content, marks that end a sentence, tiers of content.
NO_CONTENT = "…。、！？!?-―ー.（）()「」『』ッっ・,，:：;；'\"’“”　"
SENTENCE_END = "。！？!?…」』）"
TIERS = ("punctuation", "trivial", "content")
TRIVIAL, BODY, HEAD_MISS, SAME_LEAST = 2, 3, 0.15, 2
INLINE_NAME = re.compile(r"\s*([^:：]{1,16}?)\s*[:：]\s*(\S.*)")
NONWORD = re.compile(r"[\W_]+")


def arrow(of: Callable, kind: str) -> Callable[..., Column]:
    """A plain function of texts as a function of columns, in Arrow batches; null if any argument is."""

    def put(*columns: Column | str) -> Column:
        @F.pandas_udf(kind)
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([None if any(x is None for x in row) else of(*row) for row in zip(*series, strict=True)], dtype=object)

        return run(*columns)

    return put


def content_len(text: Column) -> Column:
    """Characters of content: without line marks, white space and NO_CONTENT."""
    return F.length(F.translate(F.regexp_replace(F.replace(text, F.lit("\\N"), F.lit("")), r"\s+", ""), NO_CONTENT, ""))


def tier(text: Column) -> Column:
    """Which of TIERS a text is in."""
    n = content_len(text)
    return F.when(n == 0, TIERS[0]).when(n <= TRIVIAL, TIERS[1]).otherwise(TIERS[2])


def one_char_apart(a: Column, b: Column) -> Column:
    """One letter changed, missing or too many."""
    return F.levenshtein(a, b) == 1


def n_content(text: str) -> int:
    """content_len() of a string."""
    return sum(c not in NO_CONTENT and not c.isspace() for c in text.replace("\\N", ""))


def screen_width(text: str) -> float:
    """Width in full characters; the others are half as wide."""
    return float(sum(1.0 if unicodedata.east_asian_width(c) in "WFA" else 0.5 for c in text))


def library_form(text: str) -> str:
    """Folded, with nothing but letters and digits."""
    return NONWORD.sub("", folded(text.replace("\\N", "")))


def bare(text: str) -> str:
    """Folded, without white space and punctuation."""
    return "".join(c for c in folded(text) if not c.isspace() and unicodedata.category(c)[0] != "P")


def one_reading(a: str, b: str) -> bool:
    """Whether two readings are of one line: equal when bare, or one of SAME_LEAST letters at least begins the other."""
    short, long_ = sorted((bare(a), bare(b)), key=len)
    return bool(short) and (short == long_ or (len(short) >= SAME_LEAST and long_.startswith(short)))


def can_lead(a: str, b: str) -> bool:
    """Whether the reading a can be how b begins to appear; punctuation alone can always be."""
    return bare(b).startswith(bare(a)) or one_reading(a, b)


def edits_within(part: str, whole: str) -> int | None:
    """The fewest edits that make `part` a substring of `whole`, both bare; None if one is empty."""
    p, w = bare(part), bare(whole)
    if not p or not w:
        return None
    letters, at = np.array(list(w)), np.arange(len(w) + 1)
    cost = np.zeros(len(w) + 1, int)
    for c in p:
        step = np.append(cost[0] + 1, np.minimum(cost[1:] + 1, cost[:-1] + (letters != c)))
        # Letters of `whole` that are skipped cost one each, counted from the cheapest place before.
        cost = np.minimum.accumulate(step - at) + at
    return int(cost.min())


def matched(a: str, b: str) -> int:
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def heads_similarly(a: str, b: str) -> bool:
    """Whether `a` is how `b` begins, but for a misread letter or HEAD_MISS of them. After the end of a sentence nothing may be misread."""
    x, y = "".join(a.split()), "".join(b.split())
    if n_content(x) < BODY:
        return False
    if y.startswith(x):
        return True
    ended = x[-1] in SENTENCE_END and n_content(y[len(x) :]) > 0
    return not ended and matched(x, y[: len(x)]) >= len(x) - max(1, int(HEAD_MISS * len(x)))


def left_of(text: str, used: str) -> str:
    """The letters of a text that a used line doesn't account for."""
    if not used:
        return text
    free = np.ones(len(text), bool)
    for m in SequenceMatcher(None, text, used, autojunk=False).get_matching_blocks():
        free[m.a : m.a + m.size] = False
    return "".join(np.array(list(text), dtype=object)[free]) if text else ""


def long_vowels(text: str) -> str:
    """The numeral one after katakana as the long vowel that it was."""
    return re.sub(r"(?<=[ァ-ヺー])一", "ー", text)


def reads_alike(a: str, b: str) -> bool:
    """Equal but for punctuation and white space."""
    return bare(a) == bare(b)


def shares_of(text: str) -> dict[str, float]:
    """Shares of the character classes of a text; empty for none."""
    kinds = {"kana": "぀-ヿ", "han": "㐀-䶿一-鿿", "latin": "A-Za-zÀ-ɏ", "digit": "0-9"}
    n = len(text)
    return {k: len(re.findall(f"[{v}]", text)) / n for k, v in kinds.items()} if n else {}


def without_heads(lines: Iterable[str], heads: frozenset[str] | set[str]) -> tuple[list[str], bool]:
    """The lines of a cue without heads (names, titles), and whether there were any.

    A head goes if it isn't the last line, or is the only one; in front of a line, before a colon, it goes too.
    """
    own = [x for x in lines if x.strip()]
    out = []
    for k, line in enumerate(own):
        m = INLINE_NAME.fullmatch(line)
        if m and bare(m[1]) in heads:
            out.append(m[2])
        elif bare(line) not in heads or (k == len(own) - 1 and len(own) > 1):
            out.append(line)
    return out, out != own


def forms(lines: Iterable[str], heads: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The readings that a cue can have: without up to three first lines, with and without the last one."""
    own, cut = without_heads(lines, heads)
    keeps_last = cut and bool(own) and n_content(own[-1]) > TRIVIAL
    every = [(i, j) for i in range(min(4, len(own))) for j in (len(own), len(own) - 1) if j > i]
    # Where heads are gone and a body stands last, what is left above it has to be content by itself.
    fit = [own[i:j] for i, j in every if j == len(own) or not keeps_last or any(n_content(x) > TRIVIAL for x in own[i:j])]
    return list(dict.fromkeys(v for v in (bare(" ".join(x)) for x in fit) if v))


def bodies_apart(bodies: Iterable[str], enough: int) -> int:
    """How many bodies differ, counted up to `enough`: from long to short, one that begins another or is 0.6 like it counts no more."""
    kept: list[str] = []
    for b in sorted(set(bodies), key=lambda x: (-len(x), x)):
        if len(kept) < enough and not any(k.startswith(b) or SequenceMatcher(None, b, k, autojunk=False).ratio() >= 0.6 for k in kept):
            kept.append(b)
    return len(kept)


def gram_numbers(text: str, n: int = 5) -> np.ndarray:
    """A 64-bit number for each run of n characters: a polynomial modulo 2**64."""
    codes = np.array([ord(c) for c in text], np.uint64)
    if len(codes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        weights = np.array([pow(0x100000001B3, n - 1 - k, 1 << 64) for k in range(n)], np.uint64)
        return (np.lib.stride_tricks.sliding_window_view(codes, n) * weights).sum(1, dtype=np.uint64)


def kind_of_change(new: str, old: str) -> str:
    """What tells two readings apart: nothing, white space, punctuation, kana size, one letter, or more."""
    if new == old:
        return "same"
    x, y = "".join(new.split()), "".join(old.split())
    if x == y:
        return "space"
    if bare(new) == bare(old):
        return "kana" if len(x) == len(y) and folded(x) == folded(y) else "punctuation"
    a, b = sorted((bare(new), bare(old)), key=len)
    near = len(b) - len(a) <= 1 and (sum(map(str.__ne__, a, b)) == 1 if len(a) == len(b) else any(b[:k] + b[k + 1 :] == a for k in range(len(b))))
    return "one letter" if near else "other"
