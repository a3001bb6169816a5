"""Lexical retrieval: tokens, postings, corpus statistics, ranked rows. Batch search over a stored index is in `lexical_index`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import index_tokens

# Okapi BM25 (Robertson and Zaragoza 2009); idf of a term in more than half the passages is floored.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# Scores are ranked at this many digits, so float noise never decides a tie; ids do.
SCORE_DIGITS = 9


def _tokenised(passages: DataFrame, keep: list[str], body: str, stem: DataFrame | None = None) -> DataFrame:
    tok = passages.select(*keep, index_tokens(F.col(body)).alias("_t"))
    rows = tok.select(*keep, F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("term"))
    if stem is None:
        return rows
    return rows.join(stem, "term", "left").withColumn("term", F.coalesce("stem", "term")).drop("stem")


def postings(passages: DataFrame, keep: list[str], body: str = "body", stem: DataFrame | None = None) -> DataFrame:
    """(passage, term) rows with term frequency and passage length. `stem` maps distinct terms to stems."""
    return _tokenised(passages, keep, body, stem).groupBy(*keep, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def passage_counts(passages: DataFrame, body: str = "body") -> DataFrame:
    """(term, df): in how many passages each term occurs.

    While no passage id repeats, a passage's distinct terms are counted where it is read and only terms are shuffled; else repeated passages are put together
    by their postings, as in `term_statistics`.
    """
    if passages.groupBy("passage_id").count().where("count > 1").limit(1).count():
        return term_statistics(postings(passages, ["passage_id"], body)).select("term", "df")
    terms = passages.select(F.explode(F.array_distinct(index_tokens(F.col(body)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    raw = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def top_k(scored: DataFrame, by: list[str], k: int, order: list | None = None, rank: str = "rank") -> DataFrame:
    """The k best rows per group by score, then passage id. Spark keeps k rows per group and task before shuffling."""
    w = Window.partitionBy(*by).orderBy(*(order or [F.desc("score"), F.asc("passage_id")]))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
