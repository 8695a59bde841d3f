"""Corpus preparation: five stages over ``documents``, each one operator of ``tallymark.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
their input. Nulls, empty texts, repeated rows, empty tables and further columns: as each operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontamination, mixing, near_dedup, quality, token_files
from tallymark.session import cut, shared_dir

#: SQL can't express the joins by hashed paths and the packed files; tests/llm holds the operators against brute force and runs the stages on odd rows.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """7: documents that the rules reject go."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the least id stays."""
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """10: documents with a passage of ``benchmark`` go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """8: each document is repeated by its Poisson count, sources weighted by the square root of their size; in shuffled order."""
    return mixing.mix(docs, mixing.tempered(docs)).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """1: the packed files' content per document: doc_id, start, n_tokens, ids_crc32. Files keep a shuffled order, repeats apart.

    ``docs`` is a table that was written: a row's number in it is the same in every attempt, and tells repeats apart.
    """
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    number = F.monotonically_increasing_id().cast("string")
    token_files.write_tokens(docs, out, order=F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), number)))
    return token_files.token_digests(spark, out)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
