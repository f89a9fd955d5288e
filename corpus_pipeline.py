"""From raw documents to token counts: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphstream.llm import bpe, mixing, neardup, quality, repeats
from glyphstream.llm.store import cut, drop, small_batches, table

#: Chunks whose ids a worker keeps: by the time of the last stage the executor's heap has grown to its limit, so workers have less room than op9_bpe's.
WORDS_KEPT = 40_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. A null text is judged like an empty one; a row without an id is judged by its text; repeated rows alike."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; rows without an id or a word stay. Verdicts are of rows (id and text)."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller id has go from the texts; n_chars follows. Every document stays; a null text becomes an empty one."""
    small_batches(spark)
    return repeats.without_repeats(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times. A null text has no words, a null source is a source of its own."""
    small_batches(spark)
    return mixing.sample(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text, a row for each row of the mix; a null text has no tokens."""
    small_batches(spark)
    return bpe.encode_documents(docs, kept=WORDS_KEPT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_to_weights),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Models, signatures and tokenisation can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage reads the table that the one before wrote; tables that nothing reads any more are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
