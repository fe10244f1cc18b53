"""The subpackage's queries and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, licenses, neardup, packing, pii, quality, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), *tokenizer_paths())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), k=4)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    digest = F.sha2(pii.named(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], digest, pii.named(F.col("spans")).alias("spans"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_pii that follow from the base patterns alone, which SQL can express."""
    return op8_pii(spark, sf_dir).drop("spans")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_topk, op3_html, op4_packing, op5_toxicity, op6_neardup, op7_decontam, op8_pii, op9_langid, op10_licenses, pii_base)}


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y
), roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM sets JOIN roots ON roots.x = doc_id
"""


# leftmost matches of each base pattern, placed by the texts between them, then what makes them valid
PII_BASE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT row, 0 AS k, 'email' AS kind, regexp_extract_all(text, '{email}') AS m, regexp_split_to_array(text, '{email}') AS g FROM docs WHERE contains(text, '@')
  UNION ALL SELECT row, 1, 'ip', regexp_extract_all(text, '{ip}'), regexp_split_to_array(text, '{ip}') FROM docs
  UNION ALL SELECT row, 2, 'card', regexp_extract_all(text, '{card}'), regexp_split_to_array(text, '{card}') FROM docs
  UNION ALL SELECT row, 3, 'phone', regexp_extract_all(text, '{phone}'), regexp_split_to_array(text, '{phone}') FROM docs WHERE contains(text, '+')
), placed AS (
  SELECT row, k, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM cut WHERE len(m) > 0
), spans AS (
  SELECT row, k, kind, m[i] AS m, regexp_replace(m[i], '[^0-9]', '', 'g') AS d,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM placed
), valid AS (
  SELECT row, k, kind, start, start + length(m) AS stop FROM spans WHERE CASE kind WHEN 'email' THEN TRUE
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS INTEGER), 256) > 255)) = 0
    WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
    ELSE length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
      CASE WHEN j % 2 = 1 THEN CAST(substr(d, length(d) + 1 - j, 1) AS INTEGER) ELSE 2 * CAST(substr(d, length(d) + 1 - j, 1) AS INTEGER) - CASE WHEN substr(d, length(d) + 1 - j, 1) >= '5' THEN 9 ELSE 0 END END)) % 10 = 0 END
), sums AS (
  SELECT row, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM valid GROUP BY row
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM docs LEFT JOIN sums USING (row)
"""
for _kind, _pattern in {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}.items():
    PII_BASE_SQL = PII_BASE_SQL.replace("{" + _kind + "}", _pattern)


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op6_neardup": OP6_SQL, "pii_base": PII_BASE_SQL}
