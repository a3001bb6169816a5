"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.session import cut_lineage


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """`edges(a, b)` over long nodes -> `(node, component)` for every node that is not its component's smallest one.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest neighbour; the number of
    rounds grows with the logarithm of a component's diameter. Minima are aggregated before they are joined back, so a
    node with very many neighbours is a skewed join that Spark splits, never a gathered group. Self-loops, repeated
    and reversed edges, and rows with a null end are allowed and have no effect of their own. Rounds are written
    to the shared folder, so a lost executor costs one round.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = cut_lineage(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(low.select("a", F.col("m").alias("b")).union(small).distinct())
        after = _digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
