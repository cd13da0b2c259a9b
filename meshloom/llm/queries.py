"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chaining, decontaminate, html, lines, mixing, negatives, phrases, secrets, simhash, suffix, topk, toxicity, warc


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark, sf_dir):
    return suffix.deduplicated(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op2_secret_scans(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return chaining.passages(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark, sf_dir):
    return html.extracted(table(spark, sf_dir, "pages"))


def op5_mixing(spark, sf_dir):
    kept = mixing.mixed(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("mix_probability", 6).alias("probability"))


def op6_norm_bucketed_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark, sf_dir):
    return lines.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return negatives.mined(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_phrase_collocations(spark, sf_dir):
    return phrases.mined(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {
        "op5_mixing": mixing.mixing_sql(),
        "op11_line_dedup": lines.LINES_SQL,
        "op12_hard_negatives": negatives.NEGATIVES_SQL,
        "op13_phrase_collocations": phrases.PHRASES_SQL,
        "op6_norm_bucketed_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 50 = 0 AND q.vec_id <> p.vec_id AND len(q.v) = len(p.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
        "op7_warc_round_trip": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM m""",
    }
