"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import alignment, conversation_repair, decontamination, line_templates, mixing, near_dedup, ngram_join, passages, quality, secrets, token_counts, token_files, urls
from tallymark.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the packed files."""
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), out)
    return token_files.token_digests(spark, out)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.train(urls.labelled_urls(pages))).select("row.page_id", "host", "path", "rule", "verdict", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs: their numbers, and what is left."""
    found = line_templates.drop_templates(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 2-word shingles at 0.8."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=2).drop("tie")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the base spans and all spans."""
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"))
    counts = [secrets.of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document, whole texts in shuffled order, when sources are mixed by the square root of their size."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered(docs)).select("row.doc_id", "row.source", "copy", "place", F.sha2("row.text", 256).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents that repeat a benchmark item."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation after damage; of those that lost all turns, zeros."""
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair_report(conversation_repair.damage(told)).withColumnRenamed("conv_id", "c")
    every = told.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    none = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.drop("c").withColumns(none | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two vocabularies' tokens in every document."""
    return alignment.align(_table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 3-word shingles at 0.9."""
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents")).drop("tie")


QUERIES = {
    "op1_token_files": op1_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_ngram_join": op13_ngram_join,
    "op2_url_filters": op2_url_filters,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mixing": op8_source_mixing,
    "op9_token_counts": op9_token_counts,
}

#: Poisson copies: the cumulative probabilities of each source's rate, counted below each document's uniform number.
_MIXING_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT sum(n) AS docs, sum(pow(n::DOUBLE, 0.5)) AS weights FROM counts),
rates AS (SELECT source, docs * pow(n::DOUBLE, 0.5) / weights / n AS rate FROM counts, totals),
terms AS (
  SELECT source, k, sum(CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END)
    OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, range(0, 123) r(k)),
drawn AS (SELECT doc_id, source, text, ('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
copies AS (
  SELECT d.doc_id, d.source, d.text, count(*) AS n
  FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.c <= d.u GROUP BY ALL)
SELECT doc_id, source, copy::INTEGER AS copy, md5(doc_id::VARCHAR || ':' || copy::VARCHAR || ':mix order') AS place, sha256(text) AS text_sha256
FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM copies)
"""

ORACLE_SQL: dict[str, str] = {"op8_source_mixing": _MIXING_SQL}
