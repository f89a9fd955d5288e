"""Statistics of a text's form that classifiers and quality rules share."""

from __future__ import annotations

import numpy as np

from .words import numbered, windows

SYMBOLS = "#*$%&|<>"


def lines_again(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def words_again(numbers: np.ndarray, width: int = 8) -> int:
    """Words inside windows of `width` words that the text has at least twice, the first ones too."""
    own = windows(numbers, width)
    if len(own) < 2:
        return 0
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(numbers) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null is empty."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), lines_again(text), words_again(numbered(words))
