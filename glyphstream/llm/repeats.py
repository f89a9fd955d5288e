"""Suffix-array dedup by prefix-free parsing.

Removes each byte covered by a string of LENGTH bytes that also starts in a document
with a smaller id.

Parsing. The rolling hash of K bytes triggers at the place where it is least within a
window of LENGTH bytes (the leftmost such place). Windows that follow each other and
have one trigger make a phrase: the bytes that they cover. So phrases overlap by
LENGTH - 1 bytes, every window lies in exactly one phrase occurrence, and equal windows
have equal triggers wherever they stand.

Parse. The parse of a chunk of documents is its list of distinct phrases, each with the
least id. The parse of the corpus, dealt by trigger and sorted by (trigger, phrase),
gives each phrase of the dictionary its first document. In every later document all of
its windows are removed, which settles long repeats phrase by phrase, however often they
occur. As a window never reaches beyond its phrase, the order of the parse's own suffixes
after their first phrase is never asked for, and isn't built.

Dictionary. What is left is a window in the first document of its phrase whose trigger is
found in other phrases too. Only of these phrases are bytes sent, once each: the suffix
array of a trigger's phrases, by their bytes up to LENGTH, together with the first
documents from the parse brings the windows into corpus order, and a window's first
document is the least one among its equals.

All hops between chunks and buckets of triggers carry packed arrays, so a task holds one
chunk (CHUNK_BYTES) or one bucket (a fixed part of the corpus).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut
from .words import entering, give_back, mixed

try:
    import zstandard

    def _press(x: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(x)

    def _unpress(x: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(x)
except ImportError:
    import zlib

    def _press(x: bytes) -> bytes:
        return zlib.compress(x, 1)

    _unpress = zlib.decompress

LENGTH = 50
K = 20
CHUNK_BYTES, BUCKET_BYTES, SEGMENT = 4 << 20, 8 << 20, 1 << 18
#: Strings of a suffix array that are ordered at a time.
PART = 1 << 19
PLACE_BITS, TRIGGER_BITS, PHRASE_BITS = 20, 40, 48
ROWS = "chunk long, kind int, bucket int, data binary"
BLOB, FIRST, SECOND = 0, 1, 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, bytes of equal weight side by side so that they compress."""
    return _press(pickle.dumps([(len(a), np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), a.dtype.str) for a in arrays]))


def unpack(data: bytes) -> list[np.ndarray]:
    own = pickle.loads(_unpress(data))
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, n).T).reshape(-1).view(t) for n, b, t in own]


@cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, powers of an odd base, and powers of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    power, back = np.empty(size, np.uint64), np.empty(size, np.uint64)
    power[0] = back[0] = 1
    done = 1
    while done < size:
        step = min(done, size - done)
        power[done : done + step] = power[:step] * np.uint64(pow(base, done, 1 << 64))
        back[done : done + step] = back[:step] * np.uint64(pow(inverse, done, 1 << 64))
        done += step
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)), power, back


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letters, power, back = _tables(2 * SEGMENT)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * power[: len(data)], out=sums[1:])
    return sums, back


def parse_segment(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the windows that `valid` allows to start: trigger, phrase, first and last start, place of the trigger."""
    sums, back = _sums(data)
    n = len(data) - LENGTH + 1
    grams = mixed((sums[K:] - sums[:-K]) * back[: len(sums) - K])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, LENGTH - K + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    place = (np.minimum(least[:n], least[width - span : width - span + n]) & low).astype(np.int64)
    starts = np.flatnonzero(valid[:n])
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    own = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    phrase = mixed((sums[last + LENGTH] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    # Least hashes are small numbers: mixed again, they are dealt evenly.
    return mixed(grams[own[new]] + np.uint64(1)) >> np.uint64(64 - TRIGGER_BITS), phrase >> np.uint64(64 - PHRASE_BITS), first, last, own[new]


class Chunk:
    """The documents of a chunk and their parse. Rows without an id take no part."""

    def __init__(self, blob: bytes):
        self.table = pa.ipc.open_stream(blob).read_all()
        self.ids = self.table["doc_id"].to_pylist()
        texts = [(x or "").encode() for x in self.table["text"].to_pylist()]
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        known = np.array([x is not None for x in self.ids], bool)
        self.id_of = np.array([x if x is not None else 0 for x in self.ids], np.int64)
        # Starts of windows: those with LENGTH bytes left in a document that has an id.
        valid = np.ones(len(self.data), bool)
        for start, end, k in zip(self.starts.tolist(), self.ends.tolist(), known.tolist(), strict=True):
            valid[max(start, end - LENGTH + 1) if k else start : end] = False
        parts = []
        for at in range(0, len(self.data), SEGMENT):
            part = self.data[at : at + SEGMENT + LENGTH - 1]
            if len(part) >= LENGTH:
                t, f, first, last, place = parse_segment(part, valid[at : at + SEGMENT])
                parts.append((t, f, first + at, last + at, place + at))
        if parts:
            self.trigger, self.phrase, self.first, self.last, self.place = map(np.concatenate, zip(*parts, strict=True))
        else:
            self.trigger = self.phrase = np.empty(0, np.uint64)
            self.first = self.last = self.place = np.empty(0, np.int64)
        self.row = np.searchsorted(self.ends, self.first, side="right")
        self.doc = self.id_of[self.row]
        order = np.lexsort((self.doc, self.phrase, self.trigger))
        t, f = self.trigger[order], self.phrase[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
        #: The distinct phrases, by trigger: an occurrence in the least document each, and of every occurrence the distinct phrase.
        self.one = order[new]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.least = self.doc[self.one]

    def buckets(self, n: int) -> np.ndarray:
        return bucket_of(self.trigger[self.one], n)


def bucket_of(trigger: np.ndarray, n: int) -> np.ndarray:
    return ((trigger * np.uint64(n)) >> np.uint64(TRIGGER_BITS)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """bucket ascends."""
    if not len(bucket):
        return
    own, first = np.unique(bucket, return_index=True)
    for b, lo, hi in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        yield b, slice(lo, hi)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    chunk, kind, bucket, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], ["chunk", "kind", "bucket", "data"])


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents gathered to chunks, each an Arrow stream; bucket has its bytes of text. A chunk is named by its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("repeats")
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(whole)
            blob = sink.getvalue().to_pybytes()
            return _batch([(int.from_bytes(hashlib.sha256(blob).digest()[:8], "big", signed=True), BLOB, size, blob)])

        for batch in batches:
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index("text"))), 0)).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]) + size, CHUNK_BYTES, side="right")))
                held.append(batch.slice(at, upto - at))
                size += int(lengths[at:upto].sum())
                at = upto
                if size >= CHUNK_BYTES * 3 // 4:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, ROWS)


def _parses(chunks: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                own = Chunk(blob.as_py())
                rows = []
                for b, s in _slices(own.buckets(n)):
                    at = own.one[s]
                    t = np.diff(own.trigger[at], prepend=np.uint64(0))
                    f = np.ascontiguousarray(own.phrase[at]).view(np.uint8).reshape(-1, 8)[:, : PHRASE_BITS // 8]
                    rows.append((chunk, FIRST, b, pack(t, np.ascontiguousarray(f).reshape(-1), own.least[s])))
                yield _batch(rows)

    return chunks.mapInArrow(run, ROWS)


def first_documents(trigger: np.ndarray, phrase: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the least document of its phrase, and whether the trigger has phrases that begin in other documents."""
    order = np.lexsort((phrase, trigger))
    t, f, d = trigger[order], phrase[order], doc[order]
    new_t = np.ones(len(t), bool)
    new_t[1:] = t[1:] != t[:-1]
    new = new_t.copy()
    new[1:] |= f[1:] != f[:-1]
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(d, at)
    in_t = np.flatnonzero(new_t[at])
    mixed_t = np.minimum.reduceat(least, in_t) != np.maximum.reduceat(least, in_t)
    of_phrase, of_trigger = np.cumsum(new) - 1, np.cumsum(new_t) - 1
    out_least, out_more = np.empty(len(t), np.int64), np.empty(len(t), bool)
    out_least[order], out_more[order] = least[of_phrase], mixed_t[of_trigger]
    return out_least, out_more


def _answer(table: pa.Table) -> pa.Table:
    """A bucket of the parse: to each chunk, for its entries in the order sent, how much smaller the phrase's first document is, and whether its bytes are needed."""
    chunks = table["chunk"].to_pylist()
    bucket = table["bucket"][0].as_py()
    got = [unpack(x.as_py()) for x in table["data"]]
    sizes = [len(x[0]) for x in got]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, : PHRASE_BITS // 8] = np.concatenate([x[1] for x in got]).reshape(-1, PHRASE_BITS // 8)
    doc = np.concatenate([x[2] for x in got])
    least, more = first_documents(np.concatenate([np.cumsum(x[0]) for x in got]), wide.reshape(-1).view(np.uint64), doc)
    rows, at = [], 0
    for chunk, size in zip(chunks, sizes, strict=True):
        s = slice(at, at + size)
        at += size
        before, needed = least[s] < doc[s], more[s] & (least[s] == doc[s])
        if before.any() or needed.any():
            rows.append((chunk, FIRST, bucket, pack(np.packbits(before), np.packbits(needed), least[s][before])))
    return pa.Table.from_batches([_batch(rows)])


def _settled(own: Chunk, answers: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the phrase's first document, and whether its bytes are needed."""
    least, needed = own.least.copy(), np.zeros(len(own.least), bool)
    for b, s in _slices(own.buckets(n)):
        if b in answers:
            bits, more, docs = unpack(answers[b])
            size = s.stop - s.start
            least[s][np.unpackbits(bits, count=size).astype(bool)] = docs
            needed[s] = np.unpackbits(more, count=size).astype(bool)
    return least, needed


def _bytes_of(own: Chunk, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each entry's phrase, and the phrases' bytes one after another."""
    at = own.one[entries]
    windows = own.last[at] - own.first[at] + 1
    size = windows + LENGTH - 1
    shift = np.repeat(own.first[at] - (np.cumsum(size) - size), size)
    return windows, own.data[np.arange(int(size.sum())) + shift]


def _group(table: pa.Table) -> tuple[list[bytes], dict[int, bytes], dict[int, bytes]]:
    blobs: list[bytes] = []
    first: dict[int, bytes] = {}
    second: dict[int, bytes] = {}
    for kind, bucket, data in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"], strict=True):
        if kind == BLOB:
            blobs.append(data.as_py())
        else:
            (first if kind == FIRST else second)[bucket] = data.as_py()
    return blobs, first, second


def _requested(n: int):
    def run(table: pa.Table) -> pa.Table:
        """The bytes that are needed of a chunk, by bucket. Chunks of equal content send them once."""
        chunk = table["chunk"][0].as_py()
        blobs, first, _ = _group(table)
        rows = []
        if first:
            own = Chunk(blobs[0])
            least, needed = _settled(own, first, n)
            entries = np.flatnonzero(needed)
            for b, s in _slices(bucket_of(own.trigger[own.one[entries]], n)):
                windows, data = _bytes_of(own, entries[s])
                rows.append((chunk, SECOND, b, pack(windows.astype(np.uint8), least[entries[s]], data)))
        return pa.Table.from_batches([_batch(rows)])

    return run


def suffix_array(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings data[at : at + length], and at which places of it a string begins that the one before doesn't equal.

    Eight bytes at a time, as one number whose order is theirs; only strings that are equal so far
    are looked at again. data has eight bytes more than the last string needs.
    """
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    first = words[at].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    for k in range(8, length, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        group, own = np.cumsum(new)[place], order[place]
        word = words[at[own] + k].astype(np.uint64) >> np.uint64(8 * max(0, k + 8 - length))
        by = np.lexsort((word, group))
        order[place], word = own[by], word[by]
        new[place[1:]] |= (group[1:] != group[:-1]) | (word[1:] != word[:-1])
    return order, new


def _parts(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The strings' numbers in ranges of their first two bytes, at most PART in each unless two bytes have more: the suffix array comes range by range."""
    head = data[at].astype(np.uint16) << np.uint16(8) | data[at + 1]
    upto = np.cumsum(np.bincount(head, minlength=1 << 16))
    lo = 0
    while lo < 1 << 16:
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + PART, side="right")))
        own = np.flatnonzero((head >= lo) & (head < hi)) if (lo, hi) != (0, 1 << 16) else np.arange(len(at))
        if len(own):
            yield own
        lo = hi


def places(windows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each window begins, phrase by phrase; numbers of 32 bits if they do, as a bucket's windows are many."""
    kind = np.int32 if int(size.sum(dtype=np.int64)) < 1 << 31 else np.int64
    at = np.repeat(np.cumsum(size - windows, dtype=kind) - (size - windows).astype(kind), windows)
    at += np.arange(len(at), dtype=kind)
    return at


def _ordered(table: pa.Table) -> pa.Table:
    """Windows of a bucket's phrases in the order of their bytes: to each chunk, for its windows, whether an equal one begins in a smaller document."""
    bucket = table["bucket"][0].as_py()
    got = [unpack(x.as_py()) for x in table["data"]]
    counts = [int(w.sum()) for w, _, _ in got]
    windows = np.concatenate([w for w, _, _ in got]).astype(np.int32)
    docs = np.concatenate([d for _, d, _ in got])
    data = np.concatenate([*[x for _, _, x in got], np.zeros(8, np.uint8)])
    del got
    size = windows + (LENGTH - 1)
    phrase = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
    at = places(windows, size)
    again = np.zeros(len(phrase), bool)
    for own in _parts(data, at):
        order, new = suffix_array(data, at[own])
        doc = docs[phrase[own[order]]]
        least = np.minimum.reduceat(doc, np.flatnonzero(new))
        again[own[order]] = least[np.cumsum(new) - 1] < doc
    rows, lo = [], 0
    for chunk, n in zip(table["chunk"].to_pylist(), counts, strict=True):
        if again[lo : lo + n].any():
            rows.append((chunk, SECOND, bucket, pack(np.packbits(again[lo : lo + n]))))
        lo += n
    give_back()
    return pa.Table.from_batches([_batch(rows)])


def removed(own: Chunk, first: dict[int, bytes], second: dict[int, bytes], n: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    least, needed = _settled(own, first, n)
    edge = np.zeros(len(own.data) + 1, np.int32)
    whole = least[own.entry] < own.doc
    np.add.at(edge, own.first[whole], 1)
    np.add.at(edge, own.last[whole] + LENGTH, -1)
    entries = np.flatnonzero(needed)
    # Occurrences in the phrase's first document, entry by entry; one document may have several.
    at_first = np.flatnonzero(~whole & needed[own.entry])
    at_first = at_first[np.argsort(own.entry[at_first], kind="stable")]
    for b, s in _slices(bucket_of(own.trigger[own.one[entries]], n)):
        if b not in second:
            continue
        mine = entries[s]
        count = own.last[own.one[mine]] - own.first[own.one[mine]] + 1
        again = np.unpackbits(unpack(second[b])[0], count=int(count.sum())).astype(bool)
        offset = np.cumsum(count) - count
        lo, hi = np.searchsorted(own.entry[at_first], [mine[0], mine[-1] + 1])
        occurrences = at_first[lo:hi]
        which = np.searchsorted(mine, own.entry[occurrences])
        each = count[which]
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        hit = again[np.repeat(offset[which], each) + inner]
        start = (np.repeat(own.first[occurrences], each) + inner)[hit]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


MORE = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _cleaned(n: int, columns: list[str], length: str | None):
    def run(table: pa.Table) -> pa.Table:
        blobs, first, second = _group(table)
        out = []
        for blob in blobs:
            own = Chunk(blob)
            gone = removed(own, first, second, n)
            texts, rows = [], []
            for start, end in zip(own.starts.tolist(), own.ends.tolist(), strict=True):
                mark = gone[start:end]
                kept = own.data[start:end][~mark].tobytes()
                spans = int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum())
                texts.append(kept.decode(errors="ignore"))
                rows.append((end - start, end - start - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            whole = own.table.set_column(own.table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            if length is not None:
                at = whole.schema.get_field_index(length)
                whole = whole.set_column(at, length, pa.array([len(x) for x in texts], pa.int64()))
            if columns[-len(MORE) :] == MORE and len(columns) > len(whole.schema):
                for name, values in zip(MORE, zip(*rows, strict=True) if rows else [()] * len(MORE), strict=True):
                    whole = whole.append_column(name, pa.array(values, pa.string() if name == "kept_sha256" else pa.int64()))
            out.append(whole.select(columns))
        give_back()
        return pa.concat_tables(out)

    return run


def _passes(docs: DataFrame, schema: T.StructType, length: str | None) -> DataFrame:
    chunks = cut(_chunks(docs), "chunks")
    total = chunks.agg(F.sum(F.col("bucket").cast("long"))).first()[0] or 0
    n = max(1, -(-total // BUCKET_BYTES))
    first = cut(_parses(chunks, n).groupBy("bucket").applyInArrow(_answer, ROWS), "first")
    asked = chunks.unionByName(first).groupBy("chunk").applyInArrow(_requested(n), ROWS)
    second = cut(asked.groupBy("bucket").applyInArrow(_ordered, ROWS), "second")
    every = chunks.unionByName(first).unionByName(second)
    return every.groupBy("chunk").applyInArrow(_cleaned(n, schema.names, length), schema)


def _schema(docs: DataFrame, length: str | None = None) -> T.StructType:
    kinds = {"text": T.StringType(), length: T.LongType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in docs.schema])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the text that is left, n_bytes, n_removed, n_spans and kept_sha256.

    docs needs doc_id and text; all other columns stay, but those of the result's own names are
    replaced. The text is what is left as UTF-8, without bytes of a letter that was cut. A null
    text is empty. A row without an id loses nothing and counts as no other's predecessor; rows
    with one id aren't smaller than each other, so repeated rows keep what no smaller id has.
    """
    docs = docs.drop(*MORE)
    schema = _schema(docs)
    for name in MORE:
        schema = schema.add(name, T.StringType() if name == "kept_sha256" else T.LongType())
    return _passes(docs, schema, None)


def without_repeats(docs: DataFrame, length: str | None = None) -> DataFrame:
    """docs with the text that is left, and all other columns as they are, whatever these are called; `length` names one that gets the text's code points. Rows go as in remove_repeats()."""
    return _passes(docs, _schema(docs, length), length)
