"""BPE encoding and decoding by a tokenisation automaton.

The automaton reads tokens and accepts exactly those sequences that the merges make.
It begins as one state with a loop for every base symbol, and each merge (u, v) -> uv
is a gadget put onto it: wherever an arc u leads to a state p with an arc v, that arc
is led to a copy of p without v, and an arc uv is added beside it that leads to where
v led. All arcs of one label always share their target, so a state is named by the
label that leads to it.

explicit_automaton() puts the gadgets on one after another and holds every arc. For a
vocabulary of 49k merges that would be over 10**9 arcs, so Automaton keeps the states
persistently: a gadget writes one record, which says that from its time on the copy of
the state after u differs from its parent by the arc v that is gone, and that the label
uv has come beside u. What a state has is then read off the records of its ancestors,
newest first; answers stay in the transition table.

Encoding runs over the symbols of a word from left to right through integer tables: one
transition gives the longest token that ends at the symbol, a chain gives the shorter
ones, and the first of them that has an arc from the state of the token before it is the
one token of the accepted path that ends there. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from .words import entering, give_back

END = "</w>"
#: Entries of each generation of the table of chunks (that of words has half of it), and of the tables of transitions.
CHUNKS_KEPT, ARCS_KEPT = 150_000, 300_000
#: White space of the tokenizer's pattern, by its Unicode property.
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r 0-9a-z]+")
#: Characters that str.split() takes for white space and the pattern doesn't.
ODD = re.compile("[\x1c-\x1f]")
SPLIT_ODD = re.compile(f"[{SPACES}]+")
STRIPPED = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
NEVER = 1 << 60
SHIFT = 20
HEAD = 6
# What Unicode 16 added to the letters and numbers, and what 16 and 17 added to the
# lower cases (first and last upper case, distance), as far as the library's tables know it.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D4F), (0x10D50, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
LOWER_17 = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
NEW_LOWER = {c: c + by for first, last, by in LOWER_17 for c in range(first, last + 1)}
NEW_UPPER = re.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")


def _ranges(kind: str) -> str:
    """Code points whose general category begins with `kind`, as ranges of a character class."""
    out: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*out, *{"L": LETTERS_16, "N": NUMBERS_16}[kind]])


@cache
def any_word() -> re.Pattern:
    """The tokenizer's pattern, with the letters and numbers of Unicode 16: Python's own tables and what is newer than version 15.1."""
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


def byte_letters() -> list[str]:
    """A printable letter for each byte: Latin-1's visible ones stand for themselves, the rest follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Automaton:
    """Transitions between labels, which are numbers: the symbols given first, then other base symbols and merges as they come."""

    def __init__(self, merges: list[tuple[str, str]], symbols: list[str] | None = None, kept: int = CHUNKS_KEPT):
        self.kept = kept
        made = {u + v for u, v in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token")
        self.names: list[str] = []
        self.numbers: dict[str, int] = {}
        #: A label's gadget (-1: a base symbol), its two parts, and its length in symbols.
        self.born: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.size: list[int] = []
        #: From which gadget on the state after a label is a copy without an arc, by both labels.
        self.gone: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for x in symbols or []:
            self._label(x)
        for k, (u, v) in enumerate(merges):
            # A merge whose parts never stand together by then puts nothing on the automaton.
            if any(x in made and x not in self.numbers for x in (u, v)):
                continue
            a, b = self._label(u), self._label(v)
            if self._follow(a, b):
                self.gone[a << SHIFT | b] = k
                self._label(u + v, k, a, b)
        self._compile()

    def _label(self, name: str, born: int = -1, left: int = -1, right: int = -1) -> int:
        got = self.numbers.get(name)
        if got is None:
            got = self.numbers[name] = len(self.names)
            self.names.append(name)
            self.born.append(born)
            self.left.append(left)
            self.right.append(right)
            self.size.append(self.size[left] + self.size[right] if born >= 0 else 1)
        return got

    def _symbols(self, label: int) -> list[int]:
        out, rest = [], [label]
        while rest:
            x = rest.pop()
            if self.born[x] < 0:
                out.append(x)
            else:
                rest += [self.right[x], self.left[x]]
        return out

    def _compile(self) -> None:
        """The table that finds tokens by their ends: a tree of all labels' symbols, and for each node the one of its longest ending that is in the tree too."""
        self.step: dict[int, int] = {}
        self.jump: dict[int, int] = {}
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}
        self.fail, self.best = [0], [-1]
        depth: list[list[tuple[int, int, int]]] = []
        node_of = []
        for label in range(len(self.names)):
            node = 0
            for n, s in enumerate(self._symbols(label)):
                key = node << SHIFT | s
                after = self.step.get(key)
                if after is None:
                    after = self.step[key] = len(self.fail)
                    self.fail.append(0)
                    self.best.append(-1)
                    if n == len(depth):
                        depth.append([])
                    depth[n].append((node, s, after))
                node = after
            self.best[node] = label
            node_of.append(node)
        for level in depth:
            for node, s, after in level:
                if node:
                    self.fail[after] = self._step(self.fail[node], s)
                if self.best[after] < 0:
                    self.best[after] = self.best[self.fail[after]]
        #: The next shorter token that ends like a token.
        self.shorter = [self.best[self.fail[n]] for n in node_of]

    def _step(self, node: int, symbol: int) -> int:
        while True:
            got = self.step.get(node << SHIFT | symbol)
            if got is not None or not node:
                return got or 0
            node = self.fail[node]

    def _follow(self, a: int, b: int) -> bool:
        """Whether the state after a has the arc b, by the records: the younger of both labels leads back to the time of its gadget."""
        when, born, gone = NEVER, self.born, self.gone
        while True:
            if gone.get(a << SHIFT | b, NEVER) < when:
                return False
            x, y = born[a], born[b]
            if x > y:
                when, a = x, self.right[a]
            elif y >= 0:
                when, b = y + 1, self.left[b]
            else:
                return True

    def arc(self, a: str, b: str) -> bool:
        """Whether the state after label a has an arc with label b."""
        return self._follow(self._label(a), self._label(b))

    def codes(self, symbols: list[int], head: bytes | None = None) -> list[int]:
        """The labels of the only accepted path over base symbols. Words that begin with the same `head` (the first HEAD symbols, or None) share its transitions."""
        step, jump, best, size, shorter, arcs = self.step, self.jump, self.best, self.size, self.shorter, self.arcs
        ends, node, j = [], 0, 0
        if head is not None:
            begun = self.heads.get(head)
            if begun is not None:
                node, ends, j = begun[0], list(begun[1]), HEAD
                head = None
        for s in symbols[j:] if j else symbols:
            j += 1
            key = node << SHIFT | s
            node = step.get(key)
            if node is None:
                node = jump.get(key)
                if node is None:
                    if len(jump) > ARCS_KEPT:
                        jump.clear()
                    node = jump[key] = self._step(key >> SHIFT, s)
            t = best[node]
            i = j - size[t]
            while i:
                pair = ends[i - 1] << SHIFT | t
                go = arcs.get(pair)
                if go is None:
                    if len(arcs) > ARCS_KEPT:
                        arcs.clear()
                    go = arcs[pair] = self._follow(ends[i - 1], t)
                if go:
                    break
                t = shorter[t]
                i = j - size[t]
            ends.append(t)
            if head is not None and j == HEAD:
                if len(self.heads) >= self.kept:
                    self.heads.clear()
                self.heads[head] = node, tuple(ends)
        out, j = [], len(ends)
        while j:
            t = ends[j - 1]
            out.append(t)
            j -= size[t]
        out.reverse()
        return out

    def path(self, symbols: str, end: str = END) -> list[str]:
        """codes() by names; the last symbol carries the end mark. Symbols that no merge has get labels of their own."""
        own = [*symbols[:-1], symbols[-1] + end] if symbols else []
        for x in own:
            self._label(x)
        if len(self.shorter) < len(self.names):
            self._compile()
        return [self.names[x] for x in self.codes([self.numbers[x] for x in own])]


def explicit_automaton(symbols: list[str], merges: list[tuple[str, str]]) -> tuple[dict[str, int], list[set[str]]]:
    """Every gadget put on in turn: the state after each label, and each state's arcs. State 0 is the start."""
    arcs: list[set[str]] = [set(symbols)]
    after = dict.fromkeys(symbols, 0)
    for u, v in merges:
        if u not in after or v not in after or v not in arcs[after[u]]:
            continue
        uv = u + v
        after[uv] = after[v]
        arcs.append(arcs[after[u]] - {v})
        after[u] = len(arcs) - 1
        for own in arcs:
            if u in own:
                own.add(uv)
    return after, arcs


class Recent(dict):
    """What `make` gives for a key. Two generations of `size` entries: what is asked for again stays."""

    def __init__(self, make: Callable[[str], str], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> str:
        got = self.old.pop(key, None) or self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Coder:
    """Words of a tokenizer file to ids and back to labels. Tables keep the ids alone, as text; labels are read off the ids of a whole text."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int], kept: int = CHUNKS_KEPT):
        self.special = special
        letters = byte_letters()
        # A byte is its own label, and 256 more at a word's end.
        self.automaton = Automaton(merges, letters + [x + END for x in letters], kept)
        self.ids = [str(vocabulary[x]) if x in vocabulary else "" for x in self.automaton.names]
        self.labels = {str(i): x for x, i in (vocabulary | special).items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = Recent(self._word, max(1, kept // 2))
        self.chunks = Recent(self._chunk, kept)

    def _word(self, word: str) -> str:
        """The ids of a word, joined by one space."""
        data = word.encode()
        own = list(data)
        own[-1] += 256
        return " ".join(map(self.ids.__getitem__, self.automaton.codes(own, data[:HEAD] if len(data) > HEAD else None)))

    def _chunk(self, chunk: str) -> str:
        if chunk.isalpha():
            return self._word(chunk)
        words = (ASCII_WORD if chunk.isascii() else any_word()).findall(chunk)
        return " ".join(map(self.words.__getitem__, words))

    def _piece(self, piece: str) -> str:
        """A text without special tokens. No token crosses white space, so whole chunks are looked up."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
            # Lower case goes by single characters: a sigma at a word's end is no other letter.
            piece = "".join([c.lower() for c in piece]) if "Σ" in piece else piece.lower()
            if NEW_UPPER.search(piece):
                piece = piece.translate(NEW_LOWER)
        else:
            piece = piece.lower()
        chunks = SPLIT_ODD.split(piece.strip(STRIPPED)) if ODD.search(piece) else piece.split()
        return "" if chunks == [""] else " ".join(map(self.chunks.__getitem__, chunks))

    def coded(self, text: str) -> tuple[str, str]:
        """The ids and the decoded text, each joined by one space."""
        if self.cut is None or not self.cut.search(text):
            ids = self._piece(text)
        else:
            parts, at = [], 0
            for m in self.cut.finditer(text):
                parts += [self._piece(text[at : m.start()]), str(self.special[m[0]])]
                at = m.end()
            parts.append(self._piece(text[at:]))
            ids = " ".join([x for x in parts if x])
        return ids, self._spelled(ids)

    def _spelled(self, ids: str) -> str:
        return " ".join(map(self.labels.__getitem__, ids.split()))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.coded(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return self._spelled(" ".join(map(str, ids)))


def read_tokenizer(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges and special tokens of a tokenizer file; kinds that Coder can't do raise ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] is not None:
        raise ValueError("a word-end BPE without a decoder is needed")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def coder(path: str, kept: int = CHUNKS_KEPT) -> Coder:
    """One for each Python worker: the transition table and the words seen stay from task to task."""
    made = Coder(*read_tokenizer(path), kept)
    give_back()
    return made


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = False, kept: int = CHUNKS_KEPT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and token_ids, if ids) for each row of docs.

    docs needs doc_id and text; other columns are dropped, so names can't clash. A null or
    empty text has no tokens and the hash of the empty string. Rows are independent: repeated
    rows and null ids give repeated rows and null ids. A text is held whole in one worker. The
    tokenizer file must be at the path on every executor. A worker keeps the ids of 3 * kept
    chunks and words at most: fewer take less memory and more time, the result is the same.
    """
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entering("bpe", coder.cache_clear)
        own = coder(path, kept)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                coded, decoded = own.coded(text or "")
                row = [coded.count(" ") + 1 if coded else 0, hashlib.sha256(coded.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + [[int(x) for x in coded.split()]] * ids)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, schema)
