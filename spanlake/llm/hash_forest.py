"""Approximate nearest neighbours by a hash-prefix forest (sorted arrays of long hash strings, one for each tree)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.embedding_dedup import usable
from spanlake.session import cut_lineage


@dataclass(frozen=True)
class Forest:
    """`trees` sorted arrays over one shard of at most about `shard_rows` vectors. A query descends to its longest matching prefix in
    every tree and all trees ascend together, bit by bit, until their matches number `enough` (a vector found by two
    trees counts twice)."""

    trees: int = 32
    bits: int = 24
    enough: int = 5_000
    shard_rows: int = 8192
    query_rows: int = 32_768


class Shard:
    """The forest over one shard's vectors. Inner products are turned into angles: the shard's mean is taken off, which
    changes no order, and one more coordinate fills every vector up to the longest one's length."""

    def __init__(self, vectors: np.ndarray, forest: Forest):
        self.vectors, self.forest = vectors, forest
        centred = vectors - vectors.mean(axis=0)
        squares = (centred**2).sum(axis=1)
        filled = np.column_stack([centred, np.sqrt(np.maximum(squares.max() - squares, 0))])
        self.planes = np.random.default_rng(11).standard_normal((filled.shape[1], forest.trees * forest.bits))
        hashes = self._hashes(filled)
        self.orders = np.argsort(hashes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.orders, axis=0)

    def _hashes(self, filled: np.ndarray) -> np.ndarray:
        bits = (filled @ self.planes > 0).reshape(len(filled), self.forest.trees, self.forest.bits)
        return bits @ (1 << np.arange(self.forest.bits - 1, -1, -1, dtype=np.int64))

    def _ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every query and tree, the range of its array that shares the prefix at which the query stops ascending."""
        f = self.forest
        hashes = self._hashes(np.column_stack([queries, np.zeros(len(queries))]))
        low, high = (np.empty((f.bits + 1, len(queries), f.trees), dtype=np.int32) for _ in range(2))
        for depth in range(f.bits + 1):
            step = 1 << (f.bits - depth)
            first = hashes // step * step
            for t in range(f.trees):
                low[depth, :, t] = np.searchsorted(self.sorted[:, t], first[:, t])
                high[depth, :, t] = np.searchsorted(self.sorted[:, t], first[:, t] + step)
        matches = (high - low).sum(axis=2, dtype=np.int64)
        stop = np.maximum((matches >= f.enough).sum(axis=0) - 1, 0)  # matches only shrink with depth
        at = np.arange(len(queries))
        return low[stop, at], high[stop, at]

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, inner product) of each query's `k` best candidates, and all that tie with the last."""
        out = []
        for start in range(0, len(queries), 512):
            part = queries[start : start + 512]
            lows, highs = self._ranges(part)
            for q, (low, high) in enumerate(zip(lows, highs, strict=True)):
                found = np.zeros(len(self.vectors), dtype=bool)
                for t, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    found[self.orders[a:b, t]] = True
                rows = np.flatnonzero(found)
                scores = self.vectors[rows] @ part[q]
                if len(rows) > k:
                    best = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                    rows, scores = rows[best], scores[best]
                out.append((np.full(len(rows), start + q), rows, scores))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, forest: Forest = Forest(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`(query_id, rank, vec_id, score)`: each query's `k` candidates of largest inner product, nearest first, ties to the smaller id.

    Every row of `vectors` with an id other than the query's is a candidate. Equal vectors are one class with its k + 1 smallest ids,
    which is all that ties can need, and equal queries are searched once. Classes are dealt by hash to shards of a bounded number of rows, each with
    its own forest over all of its rows; each block of a bounded number of queries visits every shard, and what a shard returns is
    about k rows a query. Scores are inner products of the original vectors in double precision. `enough` belongs to a shard,
    so its meaning does not change with the size of the table; a table within one shard and under it is searched exactly.

    Vectors that are null, zero, or hold null or non-finite components take no part, as queries neither; nor do rows
    with a null id. Vectors of different lengths never meet. A repeated id is a candidate for each of its rows.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where("id IS NOT NULL").where(usable("vector"))
    smallest = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    near = Window.partitionBy("vector", "lot").orderBy("id")
    lots = pick(vectors).withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = lots.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    classes = cut_lineage(few.groupBy("vector").agg(smallest.alias("ids")).withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")))
    asked = cut_lineage(pick(queries).select("id", "vector"))
    asking = cut_lineage(asked.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")))
    shards = max(1, -(-classes.count() // forest.shard_rows))
    blocks = max(1, -(-asking.count() // forest.query_rows))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = classes.select("node", "vector", "dims", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.explode(number(blocks)).alias("block"))
    right = asking.select("query", "vector", "dims", F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(number(shards)).alias("shard"))
    keys = ["dims", "shard", "block"]

    def visit(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query": [], "node": [], "score": []})
        rows = rows.sort_values("node", ignore_index=True)
        shard = Shard(np.array(rows["vector"].tolist(), dtype=np.float64), forest)
        q, v, score = shard.nearest(np.array(wanted["vector"].tolist(), dtype=np.float64), k + 1)
        return pd.DataFrame({"query": wanted["query"].to_numpy()[q], "node": rows["node"].to_numpy()[v], "score": score})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(visit, "query long, node long, score double")
    named = found.join(classes.select("node", "ids"), "node").withColumn("first_id", F.element_at("ids", 1))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first_id")
    top = named.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "score", F.explode("ids").alias("id"))
    expanded = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    listed = (
        top.withColumn("n", F.row_number().over(expanded)).where(F.col("n") <= k + 1).groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("hits"))
    )
    answers = asked.join(asking.select("query", "vector"), "vector").join(listed, "query").select(
        F.col("id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits")
    )
    hit = answers.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return hit.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
