"""Embedding caches and exact cosine top-k."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.search import SCORE_DIGITS, top_k
from spanlake.session import cut_lineage

DIM = 384
MAX_TOKENS = 512
# Rows of a block of queries and of a block of vectors, and how many queries a task scores at once.
QUERY_BLOCK = 4096
VECTOR_BLOCK = 16_384
SCORED_AT_ONCE = 256


@lru_cache(maxsize=200_000)
def _slot(token: str) -> int:
    return int(hashlib.sha1(token.encode()).hexdigest(), 16) % DIM


def hashed_words(text: str) -> list[float]:
    """The default embedder: counts of hashed words, scaled to length one."""
    v = [0.0] * DIM
    for token in re.findall("[a-z0-9]+", text.lower()):
        v[_slot(token)] += 1.0
    length = math.sqrt(sum(x * x for x in v))
    if not length:
        v[0] = length = 1.0
    return [x / length for x in v]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_embedder(texts: pd.Series) -> pd.Series:
    return texts.map(hashed_words)


def token_count(text):
    return F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("long") + 2


def missing_embeddings(texts: DataFrame, cache: DataFrame, model: str, text: str = "body") -> DataFrame:
    """Distinct texts without a vector for this model: (sha1, text)."""
    distinct = texts.select(F.sha1(text).alias("sha1"), F.col(text).alias("text")).dropDuplicates(["sha1"])
    return distinct.join(cache.where(F.col("model") == model).select("sha1"), "sha1", "left_anti")


def fill_cache(texts: DataFrame, cache: DataFrame, model: str, embedder=hashed_embedder, text: str = "body") -> DataFrame:
    """New cache rows (model, sha1, n_tokens, vec) for texts not cached yet; the caller appends them."""
    todo = missing_embeddings(texts, cache, model, text)
    return todo.select(
        F.lit(model).alias("model"), "sha1", token_count(F.col("text")).alias("n_tokens"), embedder(F.col("text")).alias("vec")
    )


def build_vectors(passages: DataFrame, cache: DataFrame, model: str, keep: list[str], text: str = "body") -> DataFrame:
    """Passages with their cached vector; null where none is cached (see `vector_report`)."""
    have = cache.where(F.col("model") == model).select("sha1", "n_tokens", "vec")
    return passages.select(*keep, F.sha1(text).alias("sha1")).join(have, "sha1", "left").drop("sha1")


def vector_report(vectors: DataFrame) -> DataFrame:
    """Vector, truncation and gap counts; a table with gaps must not be published."""
    return vectors.agg(
        F.count("vec").alias("vectors"),
        F.count_if(F.col("n_tokens") > MAX_TOKENS).alias("truncated"),
        F.count_if(F.col("vec").isNull()).alias("missing"),
    )


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


@F.arrow_udf(T.BinaryType())
def packed(vecs: pa.Array) -> pa.Array:
    """A vector's length and doubles; of one that is mostly zeros only the other numbers, each with its place."""
    sizes = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy()
    every = vecs.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out: list[bytes | None] = []
    for start, end, known in zip(ends - sizes, ends, vecs.is_valid().to_pylist(), strict=True):
        v = every[start:end]
        at = np.flatnonzero(v)
        head = np.array([len(v)], "<i4").tobytes()
        out.append(None if not known else head + at.astype("<i4").tobytes() + v[at].tobytes() if 3 * len(at) < 2 * len(v) else head + v.tobytes())
    return pa.array(out, pa.binary())


def unpacked(vecs: list[bytes]) -> np.ndarray:
    """The vectors as rows; all have one length."""
    size = int(np.frombuffer(vecs[0], "<i4", 1)[0]) if vecs else 0
    m = np.zeros((len(vecs), size))
    for row, v in zip(m, vecs, strict=True):
        if int(np.frombuffer(v, "<i4", 1)[0]) != size:
            raise ValueError("vectors differ in length")
        if len(v) == 4 + 8 * size:
            row[:] = np.frombuffer(v, "<f8", offset=4)
        else:
            n = (len(v) - 4) // 12
            row[np.frombuffer(v, "<i4", n, 4)] = np.frombuffer(v, "<f8", n, 4 + 4 * n)
    return m


def _best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest scores, largest first, ties to the smaller column, as a stable sort of the whole row gives them; nulls last."""
    m, n = scores.shape
    if n <= k or np.isnan(scores).any():
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    rows, columns = np.nonzero(scores >= least)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(m))[rows]
    return columns[rank < k].reshape(m, k)


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Every query's k best of the vectors with its scope, ties to the smaller id; a few queries are scored at a time."""
    own = vectors.sort_values(["scope", "passage_id"], kind="stable")
    asks = queries[queries["scope"].isin(own["scope"])].sort_values("scope", kind="stable")
    if not len(asks):
        return pd.DataFrame({"query_id": [], "passage_id": [], "score": []})
    ids, pools, asked = own["passage_id"].to_numpy(), _unit(unpacked(own["vec"].tolist())), _unit(unpacked(asks["vec"].tolist()))
    scopes, query_ids = own["scope"].to_numpy(), asks["query_id"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], scopes[1:] != scopes[:-1]]))
    bounds = {g: (x, y) for g, x, y in zip(scopes[first].tolist(), first, [*first[1:], len(scopes)], strict=True)}
    wanted = asks["scope"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1]]))
    found_q, found_p, found_s = [], [], []
    for g, x, y in zip(wanted[start].tolist(), start, [*start[1:], len(wanted)], strict=True):
        low, high = bounds[g]
        pool = pools[low:high].T
        for at in range(x, y, SCORED_AT_ONCE):
            part = slice(at, min(at + SCORED_AT_ONCE, y))
            scores = np.round(asked[part] @ pool, SCORE_DIGITS)
            order = _best_places(scores, k)
            found_q.append(np.repeat(query_ids[part], order.shape[1]))
            found_p.append(ids[low:high][order].ravel())
            found_s.append(np.take_along_axis(scores, order, axis=1).ravel())
    return pd.DataFrame({"query_id": np.concatenate(found_q), "passage_id": np.concatenate(found_p), "score": np.concatenate(found_s)})


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, scope: str | None = None) -> DataFrame:
    """Exact cosine top-k for every (query_id, vec) over (passage_id, vec), optionally inside a shared `scope` value.

    A block join: queries and vectors of a scope are dealt by hash into blocks of bounded size, each block of queries
    meets each block of vectors of its scope in one task, and what leaves a task is k rows a query. Small scopes share a
    task, a scope with any number of rows is many. Nothing passes through the driver and nothing is broadcast by force. Vectors are packed before they
    are sent, once; only the scopes of several blocks are looked up for it.
    """
    key = F.col(scope) if scope else F.lit(0)
    q = queries.select("query_id", "vec", key.alias("scope")).where("scope IS NOT NULL")
    v = vectors.where(F.col("vec").isNotNull()).select("passage_id", "vec", key.alias("scope")).where("scope IS NOT NULL")

    def blocks(df, rows, name):
        return df.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name), F.count(F.lit(1)).alias(name + "_rows"))

    sizes = cut_lineage(blocks(q, QUERY_BLOCK, "q_blocks").join(blocks(v, VECTOR_BLOCK, "v_blocks"), "scope", "full"))
    dealt = sizes.where("q_blocks IS NOT NULL AND v_blocks IS NOT NULL")
    met = F.col("q_blocks").isNotNull() & F.col("v_blocks").isNotNull()
    rows = F.coalesce("q_blocks_rows", F.lit(0)) + F.coalesce("v_blocks_rows", F.lit(0))
    totals = sizes.agg(F.sum(F.when(met, rows)).alias("met"), F.sum(rows).alias("all")).first()
    bins = math.ceil((totals["met"] or 1) / VECTOR_BLOCK)
    if 2 * (totals["met"] or 0) < (totals["all"] or 0):  # most rows have no partner: they are left out first
        partners = cut_lineage(dealt.select("scope"))
        q, v = q.join(partners, "scope", "left_semi"), v.join(partners, "scope", "left_semi")
    large = cut_lineage(dealt.where("q_blocks > 1 OR v_blocks > 1").select("scope", "q_blocks", "v_blocks"))
    one = F.lit(1)

    def sent(df, own, own_blocks, own_name, other_blocks, other_name):
        cut = df.withColumn("vec", packed("vec")).join(large, "scope", "left")
        block = F.pmod(F.xxhash64(own), F.coalesce(own_blocks, one)).cast("int").alias(own_name)
        other = F.explode(F.sequence(F.lit(0), F.coalesce(other_blocks, one) - 1)).alias(other_name)
        return cut.select(own, "vec", "scope", F.pmod(F.xxhash64("scope"), F.lit(bins)).alias("bin"), block, other)

    left = sent(q, "query_id", "q_blocks", "q_block", "v_blocks", "v_block")
    right = sent(v, "passage_id", "v_blocks", "v_block", "q_blocks", "q_block")
    keys = ["bin", "q_block", "v_block"]
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *T.StructType.fromDDL("passage_id long, score double").fields])

    def score(asked, pool):
        return _best(asked, pool, k)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)
    return top_k(found, ["query_id"], k).select("query_id", "rank", "passage_id", "score")
