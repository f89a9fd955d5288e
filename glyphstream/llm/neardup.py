"""MinHash near-dedup by a multi-index Hamming join on b-bit signatures.

Every distinct shingle set gets a signature of 64 positions of 32 bits. The positions
are split into chunks. Two signatures that differ in at most THRESHOLD positions have,
by the pigeonhole principle, a chunk in which at most one position differs; every
chunk is therefore looked up with each of its positions left out in turn, which
enumerates the chunk errors allowed. All pairs within the signature distance share a
key. (The chance to share none is about 1e-9 for pairs with a similarity of 0.85, and about
3e-7 at 0.80.)

Keys that one set alone has are dropped. What is left is thinned by an exact bound: a
set linked to another shares `percent` of its shingles with it, so a set with fewer
of its shingles found in other candidates goes. Sets that keys connect, directly or
through others, form a family. Its sets are held against the least one first; what isn't linked
to it is cut into blocks of bounded size, and each pair of blocks counts intersections of
full sets by matrix products in one task, which returns only a spanning forest of the
links: no pair leaves the task otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .links import components
from .store import cut, drop
from .words import give_back, words_begin

#: Positions that may differ, and by that the number of chunks: two errors have to fall into each to miss a pair.
THRESHOLD = 23
CHUNKS = THRESHOLD // 2 + 1
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 512, 400_000, 4096


def _text_key() -> Column:
    return F.xxhash64(F.lit(11), "text")


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the text's hash, the set's name (h1, h2) and its signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_begin()
        for batch in batches:
            sets = [S.shingle_set(x) for x in batch["text"]]
            names = [S.set_name(x) for x in sets]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64").array,
                    "text_key": batch["text_key"],
                    "n_shingles": [len(x) for x in sets],
                    "h1": [x[0] for x in names],
                    "h2": [x[1] for x in names],
                    "signature": [S.signature(x) if len(x) else np.empty(0, np.int32) for x in sets],
                }
            )
        give_back()

    return docs.select("doc_id", "text", _text_key().alias("text_key")).mapInPandas(run, "doc_id long, text_key long, n_shingles long, h1 long, h2 long, signature array<int>")


def _keys(sets: DataFrame) -> DataFrame:
    """(key, rep): a key for every chunk and position left out."""
    bounds = np.linspace(0, S.POSITIONS, CHUNKS + 1).round().astype(int).tolist()
    keys = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for out in range(lo, hi):
            keys.append(F.xxhash64(F.lit(out), *[F.get("signature", F.lit(x)) for x in range(lo, hi) if x != out]))
    return sets.select("rep", F.explode(F.array(*keys)).alias("key"))


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, members) for the wanted ids; a repeated id with several texts has several rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_begin()
        for batch in batches:
            sets = [S.shingle_set(x) for x in batch["text"]]
            names = [S.set_name(x) for x in sets]
            yield pd.DataFrame(
                {"rep": batch["doc_id"], "h1": [x[0] for x in names], "h2": [x[1] for x in names], "members": [x.view(np.int64) for x in sets]}
            )

    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return texts.mapInPandas(run, "rep long, h1 long, h2 long, members array<long>").join(wanted, ["rep", "h1", "h2"], "left_semi")


def _shared_enough(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, h1, h2) of the sets whose members are found in other sets to the percentage needed.

    Members travel with half of the set's name alone. Should two sets ever share that half, they
    count as one with more members shared, so neither is dropped wrongly.
    """
    one = sets.select("h1", F.explode("members").alias("x"))
    again = one.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
    shared = one.join(again, "x", "left_semi").groupBy("h1").agg(F.count("*").alias("n"))
    return sets.select("rep", "h1", "h2", F.size("members").alias("size")).join(shared, "h1").where(100 * F.col("n") >= percent * F.col("size")).select("rep", "h1", "h2")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each of n nodes the least node linked to it."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def block_links(rep: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, as pairs of ids."""
    order = np.argsort(rep, kind="stable")
    rep, sets = rep[order], [sets[i] for i in order]
    n, sizes = len(sets), np.array([len(x) for x in sets])
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(where) > 1
    column = np.cumsum(often) - 1
    row = np.repeat(np.arange(n), sizes)
    keep = often[where]
    row, at = row[keep], column[where[keep]]
    by = np.argsort(at, kind="stable")
    row, at = row[by], at[by]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(often.sum()), COLUMNS):
        part = slice(*np.searchsorted(at, [lo, lo + COLUMNS]))
        own, local = np.unique(row[part], return_inverse=True)
        x = np.zeros((len(own), COLUMNS), np.float32)
        x[local, at[part] - lo] = 1
        both[np.ix_(own, own)] += x @ x.T
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    a, b = np.nonzero(np.triu(100 * both >= percent * union, 1))
    least = _forest(n, a, b)
    return [(int(rep[i]), int(rep[least[i]])) for i in range(n) if least[i] != i]


def _blocks(n: Column, total: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(total / BLOCK_SHINGLES)).cast("int")


def _links(families: DataFrame, percent: int) -> DataFrame:
    """families: (rep, h1, members, family), written. Verified links (a, b), a spanning forest.

    Every set is first held against its family's least one. Sets linked to it need no comparison
    with each other, so only the rest goes on: against itself and against the linked ones, in
    blocks of bounded size, two blocks a task. A large family of copies costs one pass.
    """
    hubs = cut(families.groupBy("family").agg(F.min("rep").alias("least"), F.min_by("members", F.struct("rep", "h1")).alias("hub")), "hubs")
    met = families.join(hubs, "family")
    both = F.size(F.array_intersect("members", "hub"))
    near = 100 * both >= percent * (F.size("members") + F.size("hub") - both)
    marks = cut(met.select("family", "rep", "h1", "least", F.size("members").alias("size"), near.alias("near")), "marks")
    drop(hubs)
    count = lambda c: (F.sum(F.when(c, 1).otherwise(0)), F.sum(F.when(c, F.col("size")).otherwise(0)))
    size = marks.groupBy("family").agg(_blocks(*count(~F.col("near"))).alias("rests"), _blocks(*count(F.col("near"))).alias("nears")).where("rests > 0")
    rows = families.join(marks.join(cut(size, "blocks"), "family").select("rep", "h1", "near", "rests", "nears"), ["rep", "h1"])
    own = F.pmod(F.xxhash64("rep", "members"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("rests"))).cast("int")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    rest = F.transform(upto("rests"), lambda k: place("rest", F.least("own", k), F.greatest("own", k)))
    across = F.transform(upto("nears"), lambda k: place("across", F.col("own"), k))
    linked = F.transform(upto("rests"), lambda k: place("across", k, F.col("own")))
    rows = rows.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("near"), linked).otherwise(F.concat(rest, across))))

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(x, np.int64) for x in batch["members"]]
        return pd.DataFrame(block_links(batch["rep"].to_numpy(), sets, percent) if len(sets) > 1 else [], columns=["a", "b"]).astype(np.int64)

    rows = rows.select("rep", "members", "family", "at.kind", "at.i", "at.j")
    found = rows.groupBy("family", "kind", "i", "j").applyInPandas(run, "a long, b long")
    return found.unionByName(marks.where("near and rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))


def _verdicts(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for each row of docs."""
    signed = cut(_signed(docs), "signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    reps = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    reps = cut(reps, "classes")
    keys = _keys(reps)
    hot = cut(keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select("key"), "hot-keys")
    shared = cut(keys.join(hot, "key").select("key", "rep"), "shared-keys")
    drop(hot)
    wanted = reps.select("rep", "h1", "h2").join(shared.select("rep").distinct(), "rep", "left_semi")
    sets = cut(_full_sets(docs, wanted), "full-sets")
    live = cut(_shared_enough(sets, percent), "live-sets")
    left = shared.join(live.select("rep").distinct(), "rep", "left_semi")
    least = left.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select("key", "least")
    meet = cut(left.join(cut(least, "key-least"), "key").where("rep <> least").select("rep", "least").distinct(), "meet")
    drop(shared)
    family = components(meet, "rep", "least").select(F.col("id").alias("rep"), F.col("component").alias("family"))
    families = cut(sets.join(live, ["rep", "h1", "h2"], "left_semi").join(family, "rep").select("rep", "h1", "members", "family"), "families")
    drop(sets, live, meet)
    links = cut(_links(families, percent), "links")
    drop(families)
    found = components(links, "a", "b").select(F.col("id").alias("rep"), F.col("component"))
    classes = reps.select("h1", "h2", "rep", "copies").join(found, "rep", "left")
    classes = classes.where("copies > 1 or component is not null").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    # Written, so that the rows of a class with very many copies are split over tasks or meet a broadcast table.
    classes = cut(classes, "components")
    drop(reps, links)
    signed = signed.drop("signature")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = signed.where(known).join(classes, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.unionByName(signed.where(~known).withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; sets with a similarity of `percent` or more are linked.

    docs needs doc_id and text; other columns are dropped. Rows with equal shingle sets are
    one class and enter the search once. A null, empty or blank text has no shingles and is
    linked with nothing. Verdicts are of rows: of an id that stands with several texts each
    row gets the component of its own text. A row without an id is linked with nothing: its
    component_id is null and it is kept.
    """
    return _verdicts(docs, percent).drop("text_key")


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps.

    Rows go by id and text together, so an id with a text that no other document has stays with
    that text. Rows that repeat an id and its text are one document and stay together.
    """
    gone = cut(_verdicts(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct(), "near-copies")
    return docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(F.lit(11), docs["text"]) == gone["_gone_key"]), "left_anti")
