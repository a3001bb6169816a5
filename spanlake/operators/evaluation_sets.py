"""Samples for review and the checks on what reviewers return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import squash
from spanlake.operators.cleaning import first_by_hash

REVIEW_SAMPLE = 150
MIN_QUOTE_CHARS = 10


def sample_misses(scored: DataFrame, n: int = REVIEW_SAMPLE, seed: int = 0, split: str = "report") -> DataFrame:
    """A reproducible sample of items of one split whose first hit is not relevant."""
    pool = scored.where((F.col("split") == split) & (F.col("mrr_at_10") < 1.0))
    return first_by_hash(pool, ["split"], "item_id", n, salt=f"{seed}|")


def disputed(reply: Column, retrieved: Column) -> Column:
    """A reply that says the retrieved text answers and quotes it word for word, white space aside."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    obj = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "answers boolean, quote string")
    quote = squash(F.trim(F.coalesce(obj["quote"], F.lit(""))))
    says = F.coalesce(obj["answers"], F.lit(False))
    return says & (F.length(quote) >= MIN_QUOTE_CHARS) & F.contains(squash(retrieved), quote)
