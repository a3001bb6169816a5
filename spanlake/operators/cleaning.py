"""Table jobs over whole texts: running lines, stable and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import (
    HEADING_LINE,
    RUNNING_MAX_CHARS,
    RUNNING_MIN_CHARS,
    RUNNING_MIN_COUNT,
    WS,
    rejoin_headings,
)


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, f"^{WS}+|{WS}+$", "")


def drop_running_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop the lines a document repeats on every page.

    Candidate lines are counted with map-side combine (a document's lines sit in one task), so only counts move;
    the texts themselves are joined with the few repeated lines and never grouped.
    """
    candidate = F.filter(
        F.transform(F.split(text, "\n"), _stripped),
        lambda s: (F.length(s) >= RUNNING_MIN_CHARS) & (F.length(s) <= RUNNING_MAX_CHARS) & ~s.rlike(HEADING_LINE),
    )
    repeated = (
        docs.select(key, F.explode(candidate).alias("_line"))
        .groupBy(key, "_line")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= RUNNING_MIN_COUNT)
        .groupBy(key)
        .agg(F.collect_list("_line").alias("_drop"))
    )
    kept = F.filter(F.split(text, "\n"), lambda l: ~F.array_contains(F.col("_drop"), _stripped(l)))
    cleaned = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return docs.join(repeated, key, "left").withColumn(text, cleaned).drop("_drop")


def clean_filing(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Filing clean-up: spaces folded, headings rejoined, running lines and spare blank lines dropped."""
    joined = docs.withColumn(text, rejoin_headings(F.col(text)))
    out = drop_running_lines(joined, key, text)
    return out.withColumn(text, F.regexp_replace(text, "\\n{3,}", "\n\n"))


def first_by_hash(rows: DataFrame, strata: list[str], key: str, n: int, salt: str = "") -> DataFrame:
    """The first n rows per stratum by sha1 of salt and key: the same rows on every run.

    `row_number <= n` keeps at most n rows per task before the shuffle, so a hot stratum stays small.
    """
    order = F.sha1(F.concat(F.lit(salt), F.col(key).cast("string")))
    w = Window.partitionBy(*strata).orderBy(order, key)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
