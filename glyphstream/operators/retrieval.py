"""Finding lines of a library in what was read: n-gram candidates, exact and prefix claims, ordered matching, repeats."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.texts import grams, pieces, window_hashes
from .intervals import islands


# Bits of the table of grams (4 MB), characters hashed at once.
GRAM_BITS, GRAM_CHARS = 25, 1 << 18


def _chunks(texts: list[str], n: int) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, parts) of up to about GRAM_CHARS characters; the parts have each place where n characters begin once."""
    rows, parts, size = [], [], 0
    for k, text in enumerate(texts):
        for i in range(0, len(text) - n + 1, GRAM_CHARS):
            rows.append(k)
            parts.append(text[i : i + GRAM_CHARS + n - 1])
            size += len(parts[-1])
            if size >= GRAM_CHARS:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _places(whole: str, n: int) -> np.ndarray:
    """The bit of the n characters from each place on."""
    return (window_hashes(whole, n) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - GRAM_BITS)


def gram_table(texts: DataFrame, n: int) -> np.ndarray:
    """A bit set for each n-gram of a text column, 2 ** GRAM_BITS in all. Other grams may have a bit that is set, none of these has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << GRAM_BITS, bool)
        for b in batches:
            for _, parts in _chunks(b.column(0).to_pylist(), n):
                for part in parts:
                    bits[_places(part, n)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bits"])

    table = np.zeros(1 << GRAM_BITS >> 3, np.uint8)
    for r in texts.where(F.col(texts.columns[0]).isNotNull()).coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        table |= np.frombuffer(r.bits, np.uint8)
    return table


def grams_in(table: np.ndarray, library: DataFrame, n: int) -> DataFrame:
    """(item_id, gram) of the library's n-grams with a bit in the table; a gram once or more an item. Characters are hashed as arrays, and only what passes becomes a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, parts in _chunks(b.column("text").to_pylist(), n):
                whole = "".join(parts)
                ends = np.cumsum([len(x) for x in parts])
                at = _places(whole, n)
                at = np.flatnonzero((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                part = np.searchsorted(ends, at, "right")
                # What reaches into the next text is no gram of either.
                inside = at + n <= ends[part]
                at, part = at[inside].tolist(), part[inside]
                if at:
                    ids = b.column("item_id").take(pa.array(np.asarray(rows)[part]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([whole[i : i + n] for i in at], pa.string())], ["item_id", "gram"])

    schema = StructType([StructField("item_id", library.schema["item_id"].dataType), StructField("gram", StringType())])
    return library.select("item_id", "text").where("text is not null").mapInArrow(run, schema)


def ngram_candidates(queries: DataFrame, library: DataFrame, n: int = 5, share: float = 0.25, least: int = 2, top: int = 6, most_df: int | None = None) -> DataFrame:
    """(q_id, item_id, n_shared): the `top` library items sharing most distinct n-grams with each query, at least max(least, share of the query's grams).

    The queries are exploded to grams, and a table of bits of a fixed size tells which of the
    library's grams can be among them; those are joined on the grams themselves, and the shared
    ones are counted before any ranking. With most_df, grams of more library items than that are
    left out on both sides.
    """
    own = queries.select("q_id", F.explode(pieces(F.col("text"), n)).alias("p")).select("q_id", F.explode(grams(F.col("p"), n)).alias("gram")).distinct()
    lib = grams_in(gram_table(queries.select("text"), n), library, n)
    if most_df is not None:
        often = lib.distinct().groupBy("gram").agg(F.count("*").alias("_df")).where(F.col("_df") > most_df).select("gram")
        lib = lib.join(often, "gram", "left_anti")
    size = own.groupBy("q_id").agg(F.count("*").cast("int").alias("n_grams"))
    # Repeats within an item are dropped after the join, when few rows are left.
    shared = own.join(lib, "gram").distinct().groupBy("q_id", "item_id").agg(F.count("*").alias("n_shared"))
    hits = shared.join(size, "q_id").where((F.col("n_shared") >= least) & (F.col("n_shared") >= share * F.col("n_grams")))
    w = Window.partitionBy("q_id").orderBy(F.desc("n_shared"), "item_id")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("q_id", "item_id", "n_shared", "n_grams")


def exact_claims(lines: DataFrame, library: DataFrame) -> DataFrame:
    """Each line's first library line of equal text."""
    first = library.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_library"))
    return lines.join(first, "text")


def prefix_claims(lines: DataFrame, library: DataFrame, key: int = 8) -> DataFrame:
    """Lines of at least `key` characters that begin exactly one library text, and aren't all of it; joined on the first `key` characters."""
    a = lines.where(F.length("text") >= key).withColumn("_k", F.substring("text", 1, key)).withColumnRenamed("text", "line")
    b = library.where(F.length("text") >= key).select("item_id", F.col("text").alias("full"), F.substring("text", 1, key).alias("_k"))
    hits = a.join(b, "_k").where(F.col("full").startswith(F.col("line")) & (F.col("full") != F.col("line")))
    keys = [c for c in lines.columns if c != "text"]
    return hits.groupBy(*keys).agg(F.min("item_id").alias("item_id"), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def ordered_match_of(cues: list[str], lines: list[str], window: int = 10, least: float = 0.5, jump: float = 0.7) -> list[int]:
    """For each cue the line it reads, or -1: near the cursor first; elsewhere only if that is much surer. The cursor follows.

    Whole texts are compared: 1 for equal ones, 0.95 if one begins the other, else the ratio of
    matching blocks over all characters. A ratio is left out only where an upper bound of it,
    from the lengths or the characters in common, shows that it can't decide.
    """
    counts = cache(lambda k: Counter(lines[k]))

    def surest(cue: str, own: Counter, among: range, floor: float) -> tuple[float, int]:
        """The greatest similarity and the first line that has it; (0, -1) if none comes up to floor."""
        best, rest = (0.0, 1), []
        for k in among:
            line = lines[k]
            if cue == line or (min(len(cue), len(line)) >= 3 and (cue.startswith(line) or line.startswith(cue))):
                best = max(best, (1.0 if cue == line else 0.95, -k))
            elif 2 * min(len(cue), len(line)) >= floor * (len(cue) + len(line)):
                rest.append(k)
        bounds = [(2 * (own & counts(k)).total() / (len(cue) + len(lines[k])), -k) for k in rest if (2 * min(len(cue), len(lines[k])) / (len(cue) + len(lines[k])), -k) > best]
        for bound, k in sorted(bounds, reverse=True):
            if bound < floor or (bound, k) < best:
                break
            best = max(best, (SequenceMatcher(None, cue, lines[-k], autojunk=False).ratio(), k))
        return (best[0], -best[1]) if best[1] <= 0 and best[0] >= floor else (0.0, -1)

    cursor, out = 0, []
    for cue in cues:
        own = Counter(cue)
        # What lies below this is neither taken nor sure enough to keep a jump away.
        sure, best = surest(cue, own, range(cursor, min(len(lines), cursor + window)), min(least, jump - 0.2) - 1e-9)
        if sure < 0.9:
            far_sure, far = surest(cue, own, range(len(lines)), max(jump, sure + 0.2))
            if far >= 0 and far_sure > sure + 0.2:
                best, sure = far, far_sure
        if sure >= least and best >= 0:
            cursor = best + 1
            out.append(best)
        else:
            out.append(-1)
    return out


def ordered_match(cues: DataFrame, script: DataFrame) -> DataFrame:
    """cues (unit, ord, text) against script (unit, line, text): (unit, ord, line). A unit's order decides, so a unit is one task."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("ord"), b.sort_values("line")
        got = ordered_match_of([x or "" for x in a["text"]], [x or "" for x in b["text"]])
        numbers = b["line"].tolist()
        return pd.DataFrame({"unit": key[0], "ord": a["ord"].to_numpy(), "line": pd.array([numbers[k] if k >= 0 else None for k in got], "Int64")})

    return cues.groupBy("unit").cogroup(script.groupBy("unit")).applyInPandas(run, "unit long, ord long, line long")


def merge_records(records: DataFrame, keys: list[str], line: str, gap: int) -> DataFrame:
    """Consecutive records of one line at most `gap` apart are one, with the longest reading."""
    w = Window.partitionBy(*keys).orderBy("t_start", "t_end")
    rows = records.withColumns({"_l": F.lag(line).over(w), "_e": F.lag("t_end").over(w)})
    new = F.col("_l").isNull() | (F.col("_l") != F.col(line)) | (F.col("t_start") - F.col("_e") > gap)
    rows = islands(rows, keys, ["t_start", "t_end"], new)
    return rows.groupBy(*keys, "island").agg(
        F.first(line).alias(line), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("n_records"), F.max(F.length("text")).alias("longest")
    ).drop("island")


def echoes(claims: DataFrame, line: str, at: str, order: str, gap: int) -> DataFrame:
    """For claims of one line: 'primary' the first, 'same_time' within `gap` of it, else 'replay'."""
    w = Window.partitionBy(line).orderBy(at, order)
    first = F.min(at).over(Window.partitionBy(line))
    return claims.withColumn("echo", F.when(F.row_number().over(w) == 1, "primary").when(F.col(at) - first <= gap, "same_time").otherwise("replay"))
