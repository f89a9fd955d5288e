"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .store import table


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op1_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licence import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import judge

    return judge(table(spark, sf_dir, "documents"))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence": op1_licence,
    "op2_minhash": op2_minhash,
    "op3_vectors": op3_vectors,
    "op4_repeats": op4_repeats,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_outliers": op7_outliers,
    "op8_pages": op8_pages,
    "op9_bpe": op9_bpe,
    "op10_mixing": op10_mixing,
}

#: Exact similarities, cosines and shared strings of all pairs, by brute force; the other queries rest on models, hashes or byte-level coding, which tests hold against brute force, the tokenizers library or held-out labels.
NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
 e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS id, a AS near FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.near),
 c AS (SELECT id, min(near) AS component FROM r GROUP BY 1)
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM s LEFT JOIN c ON c.id = doc_id"""
VECTOR_SQL = """WITH RECURSIVE g AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 v AS (SELECT * FROM g WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
 e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS id, a AS near FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.near),
 c AS (SELECT id, min(near) AS component FROM r GROUP BY 1), n AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)
 SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.id = vec_id"""
REPEAT_SQL = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, h, length(h) // 2 AS n FROM t),
 s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM b, unnest(range(0, n - 49)) AS g(i)),
 f AS (SELECT x, min(doc_id) AS first_doc FROM s GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
 hit AS (SELECT s.doc_id, i, i - lag(i) OVER (PARTITION BY s.doc_id ORDER BY i) AS step FROM s JOIN f USING (x) WHERE first_doc < s.doc_id),
 run AS (SELECT doc_id, i, sum(CASE WHEN step IS NULL OR step > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
 gone AS (SELECT doc_id, k, min(i) AS lo, max(i) + 50 AS hi FROM run GROUP BY 1, 2),
 kept AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM gone UNION ALL SELECT doc_id, max(hi), NULL FROM gone GROUP BY 1),
 rest AS (SELECT b.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS h FROM kept JOIN b USING (doc_id) GROUP BY 1),
 c AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM gone GROUP BY 1)
 SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest.h, b.h))) AS kept_sha256 FROM b LEFT JOIN c USING (doc_id) LEFT JOIN rest USING (doc_id)"""
ORACLE_SQL: dict[str, str] = {"op2_minhash": NEAR_SQL, "op3_vectors": VECTOR_SQL, "op4_repeats": REPEAT_SQL}
