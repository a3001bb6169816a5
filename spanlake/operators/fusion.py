"""Rank fusion, per-leg provenance, reranking and its score cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import query_tokens
from spanlake.operators.search import SCORE_DIGITS, top_k


def tagged_legs(legs: dict[str, DataFrame]) -> DataFrame:
    rows = [d.select("query_id", "passage_id", "rank", "score", F.lit(name).alias("leg")) for name, d in legs.items()]
    return reduce(DataFrame.unionByName, rows)


def reciprocal_rank_fusion(legs: dict[str, DataFrame], k0: int = 60, k: int = 10) -> DataFrame:
    """Fused top-k with each hit's rank and score in every leg (null where the leg did not return it).

    The legs meet in one grouping, so provenance costs no further join.
    """
    stages = []
    for name in legs:
        here = F.col("leg") == name
        stages += [
            F.max(F.when(here, F.col("rank"))).alias(f"{name}_rank"),
            F.max(F.when(here, F.col("score"))).alias(f"{name}_score"),
        ]
    fused = tagged_legs(legs).groupBy("query_id", "passage_id").agg(
        F.round(F.sum(1.0 / (k0 + F.col("rank"))), SCORE_DIGITS + 3).alias("score"), *stages
    )
    return top_k(fused, ["query_id"], k)


def shared_words(query: Column, text: Column) -> Column:
    """The default scorer: how many distinct lower-case words query and text share."""
    def words(c):
        return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))

    return F.size(F.array_intersect(words(query), words(text))).cast("double")


def rerank_head(fused: DataFrame, scores: DataFrame, depth: int, k: int = 10) -> DataFrame:
    """The first `depth` hits reordered by score (ties by passage id), the rest kept in fused order."""
    both = fused.select("query_id", "passage_id", "rank", F.col("score").alias("fused_score")).join(
        scores.select("query_id", "passage_id", F.col("score").alias("pair_score")), ["query_id", "passage_id"], "left"
    )
    both = both.withColumnRenamed("rank", "fused_rank")
    head = F.col("fused_rank") <= depth
    both = both.withColumn("score", F.when(head, F.col("pair_score")).otherwise(F.col("fused_score")))
    order = [
        F.asc(~head),
        F.desc(F.when(head, F.col("pair_score"))),
        F.asc(F.when(head, F.col("passage_id")).otherwise(F.col("fused_rank"))),
    ]
    return top_k(both, ["query_id"], k, order).select("query_id", "rank", "passage_id", "score", "fused_rank")


def pair_key(query: Column, text: Column) -> Column:
    return F.sha1(F.concat(query, F.lit("\x00"), F.sha1(text)))


def score_pairs(pairs: DataFrame, cache: DataFrame, model: str, scorer=shared_words) -> tuple[DataFrame, DataFrame]:
    """Scores for (query_id, passage_id, query, body) pairs, and the cache rows that were new.

    Only distinct pairs the cache lacks for this model are scored.
    """
    keyed = pairs.withColumn("key", pair_key(F.col("query"), F.col("body")))
    cached = cache.where(F.col("model") == model).select("key", F.col("score").alias("cached"))
    todo = keyed.select("key", "query", "body").dropDuplicates(["key"]).join(cached, "key", "left_anti")
    new = todo.select(F.lit(model).alias("model"), "key", scorer(F.col("query"), F.col("body")).alias("score"))
    every = cached.select("key", F.col("cached").alias("score")).unionByName(new.select("key", "score"))
    return keyed.join(every, "key").select("query_id", "passage_id", "score"), new
