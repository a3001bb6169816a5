"""Matching many phrases in many texts by an equi-join, never by trying every pair.

A phrase occurs in a text with no letter or digit touching its ends exactly when the text holds, from the start of
one letter-digit run to the end of a later one, the phrase's own characters. So texts are exploded into the windows
of as many runs as phrases have, and windows meet phrases by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import has_phrase


def _core(phrase: Column) -> Column:
    return F.regexp_replace(F.lower(phrase), "^[^a-z0-9]+|[^a-z0-9]+$", "")


def windows(text: Column, runs: int) -> Column:
    """Every window of `runs` consecutive letter-digit runs of lower-case `text`, separators included, each once."""
    pattern = (
        "(?<![a-z0-9])(?=([a-z0-9]+" + "(?:[^a-z0-9]+[a-z0-9]+){%d}" % (runs - 1) + ")(?![a-z0-9]))"
    )
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def phrase_matches(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, keep: list[str]) -> DataFrame:
    """Rows of `phrases` with the `keep` columns of each text (lower case) they occur in.

    The run counts that phrases have (a handful) are read first. A phrase that starts or ends with another
    character is found by its core and then checked on the text.
    """
    p = phrases.withColumn("_core", _core(F.col(phrase))).withColumn("_bare", F.col("_core") == F.lower(phrase))
    p = p.where(F.col("_core") != "")
    runs = F.size(F.regexp_extract_all("_core", F.lit("[a-z0-9]+"), F.lit(0)))
    sizes = sorted(r[0] for r in p.select(runs.alias("n")).distinct().collect())
    odd = p.where(~F.col("_bare")).limit(1).count() > 0
    if not sizes:
        return p.drop("_core", "_bare").where(F.lit(False)).select("*", *[F.lit(None).alias(k) for k in keep])
    every = F.concat(*[windows(F.col(text), n) for n in sizes])
    columns = [*keep, F.explode(every).alias("_core")] + ([F.col(text).alias("_whole")] if odd else [])
    hit = texts.select(*columns).join(p, "_core")
    if odd:
        hit = hit.where(F.col("_bare") | has_phrase(F.col("_whole"), F.col(phrase))).drop("_whole")
    return hit.drop("_core", "_bare")
