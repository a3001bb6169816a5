"""Whole-text corpus scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.text import canonical, decode_bytes


def read_corpus(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """One row per text file: contract_id is the file name without its suffix, text is canonical. A file of no bytes gives no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return canonicalise(
        files.select(
            F.expr(f"left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - {len(suffix)})").alias(
                "contract_id"
            ),
            decode_bytes(F.col("content")).alias("text"),
        )
    )


def canonicalise(docs: DataFrame, text: str = "text") -> DataFrame:
    """Canonical text and its length in characters."""
    out = docs.withColumn(text, canonical(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast("long"))
