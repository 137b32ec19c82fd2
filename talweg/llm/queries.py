"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import imatch, jaccard, lattice, licenses, mixing, packing, resampling, suffixes, topk, warc
from talweg.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return kept.select(F.col("id").alias("doc_id"), "log_weight", F.col("noisy").alias("sampling_key"))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokens

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path=tokens.path("byte_bpe_50k.json"), ranks_path=tokens.path("byte_bpe_50k.tiktoken"))


def op3_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("first_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))


def op4_combination_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similarity_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op5_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op6_diagonal_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["is_phrase"])
    joined: Callable[[Column], Column] = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op7_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    slim = plan.withColumn("doc", F.struct("doc.doc_id", "doc.source"))  # texts don't travel to the sort
    place: Callable[[int], Column] = lambda copy: F.round(F.get("positions", F.lit(copy)), 9)
    return mixing.ordered(written(slim)).select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), place(0).alias("position"), place(1).alias("second_position"))


def op9_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokens

    return lattice.score(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path=tokens.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < best THEN best END AS refers_to
FROM m
"""

def _number(x: float) -> str:
    return repr(x) if "e" in repr(x) else f"{x!r}e0"  # a DOUBLE, not a DECIMAL


def _place(copy: int) -> str:
    """SQL of the time at which a source's demand reaches the document's place in its line, second round if ``copy`` is 1."""
    share = f"coalesce(({copy} * source_size + start) / nullif(target, 0), 0)"
    piece = f"(SELECT min(k) FROM pieces x WHERE x.schedule = l.schedule AND (x.c1 > {share} AND x.c1 > x.c0 OR x.is_last))"
    rest = f"greatest({share} - c0, 0)"
    root = f"sqrt(greatest(w0 * w0 + 2 * ((w1 - w0) / (t1 - t0)) * {rest}, 0))"
    return f"(SELECT round(least(t0 + coalesce(2 * {rest} / nullif(w0 + {root}, 0), 0), t1), 9) FROM pieces p WHERE p.schedule = l.schedule AND p.k = {piece})"


_PIECES = ", ".join(
    f"({i}, {k}, {k == len(mixing.segments(schedule)) - 1}, {', '.join(map(_number, piece))})" for i, schedule in enumerate(mixing.DEFAULT_SCHEDULES) for k, piece in enumerate(mixing.segments(schedule))
)
OP8_SQL = rf"""
WITH pieces(schedule, k, is_last, t0, t1, w0, w1, c0, c1) AS (VALUES {_PIECES}
), d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS schedule,
         CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s
), o AS (
  SELECT *, 2.0 * source_size AS cap,
         coalesce(sum(2.0 * source_size) OVER p, 0) AS capped, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER p, 0) AS rest,
         row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS place
  FROM w WINDOW p AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, ((SELECT 1.5 * sum(source_size) FROM w) - capped) / rest AS level FROM o
), f AS (
  SELECT level FROM v WHERE weight * level <= cap ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size, schedule, CAST(coalesce(least(weight * (SELECT level FROM f), cap), cap) AS DOUBLE) AS target FROM o
), n AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || 'mix'), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
), l AS (
  SELECT n.doc_id, n.size, t.source_size, t.schedule, t.target, CAST(n.start AS DOUBLE) AS start,
         (CASE WHEN n.start + n.size / 2.0 < t.target THEN 1 ELSE 0 END) + (CASE WHEN t.source_size + n.start + n.size / 2.0 < t.target THEN 1 ELSE 0 END) AS copies
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN {_place(0)} END AS position, CASE WHEN copies > 1 THEN {_place(1)} END AS second_position
FROM l
"""


def queries() -> dict[str, Query]:
    found = [op1_importance_resampling, op2_pattern_packing, op3_sparse_suffix_dedup, op4_combination_prefix_join, op5_imatch_fingerprints, op6_diagonal_license_scan, op7_norm_bucketed_top_k, op8_curriculum_mixing, op9_lattice_likelihood, op10_warc_zstd]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_norm_bucketed_top_k": OP7_SQL, "op10_warc_zstd": OP10_SQL, "op8_curriculum_mixing": OP8_SQL}
