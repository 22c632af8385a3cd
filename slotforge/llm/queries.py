"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, htmlmain, licenses, linededup, packing, quality, secretscan, simhash, tokenscan
from .common import table, written


def op1_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat token files of all documents are written to the shared folder, then scanned without looking at their manifest."""
    blocks = written(tokenscan.flat_blocks(table(spark, sf_dir, "documents")), "flat-tokens")
    return tokenscan.scan(blocks).withColumnRenamed("id", "doc_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.LineStore.build(docs).apply(docs)
    return kept.select("doc_id", F.col("__sf_lines").alias("n_lines"), F.col("__sf_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, ord, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents)),
hot AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE h.k IS NOT NULL AND l.doc_id <> h.keeper)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.ord) FILTER (WHERE h.k IS NULL OR l.doc_id = h.keeper), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h ON l.k = h.k GROUP BY l.doc_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "quality")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in folders of a hundred below their source: the corpus has no paths of its own."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat(F.lit("d"), F.floor(F.col("doc_id") / 100).cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path"))).withColumnRenamed("id", "doc_id")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ctw_scores, op2_separator_scan, op3_secret_scan, op4_line_dedup, op5_quality_rules, op6_best_fit_packing,
        op7_html_main_text, op8_simhash_near_dedup, op9_license_scan, op10_benchmark_decontamination,
    )
}
ORACLE_SQL = {"op4_line_dedup": OP4_SQL}
