"""Image payloads: files of any store, or base64 text in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def image_payloads(rows: DataFrame, key: str, base64: str) -> DataFrame:
    """(key, content) of base64 text, with or without a data prefix; content is null where the text is not well-formed."""
    plain = F.regexp_replace(F.col(base64), r"^data:[a-z]+/[a-z0-9.+-]+;base64,", "")
    return rows.select(key, F.try_to_binary(plain, F.lit("base64")).alias("content"))
