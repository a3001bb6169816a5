"""The retrieval ladder: eight ways to answer a batch of questions, each one plan over the same index tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.dense import dense_top_k, hashed_embedder
from spanlake.operators.fusion import reciprocal_rank_fusion, rerank_head, score_pairs, shared_words
from spanlake.operators.scope import rewrite, scope_questions
from spanlake.operators.lexical_index import LexicalIndex, build_index, search_index
from spanlake.session import cut_lineage

RUNGS = ("R1", "R2", "R3", "R4", "R5", "R6", "R7", "R6n", "R7n")


@dataclass(frozen=True)
class Settings:
    depth: int = 100
    rrf_k0: int = 10
    rerank_depth: int = 10
    scorer_name: str = "shared-words"


@dataclass(frozen=True)
class Index:
    """The tables a rung reads. `passages` and `expanded` hold indexed passages only (no table of contents); `lexical` and `lexical_expanded` are
    their stored indexes, built for the call where they are missing."""

    passages: DataFrame
    expanded: DataFrame
    vectors: DataFrame
    lexicon: DataFrame | None = None
    aliases: DataFrame | None = None
    common: DataFrame | None = None
    lexical: LexicalIndex | None = None
    lexical_expanded: LexicalIndex | None = None
    embedder: object = hashed_embedder
    scorer: object = shared_words
    cache: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)


def _lexical(index: Index, queries: DataFrame, k: int, scope: str | None, expanded: bool = False) -> DataFrame:
    stored = index.lexical_expanded if expanded else index.lexical
    return search_index(stored or build_index(index.expanded if expanded else index.passages, scope="contract_id"), queries, k, scope)


def _dense(index: Index, queries: DataFrame, k: int, scope: str | None) -> DataFrame:
    asked = queries.where(F.col("text").rlike("[A-Za-z0-9]"))
    scoped = [scope] if scope else []
    vectors = cut_lineage(asked.select("query_id", *scoped, index.embedder(F.col("text")).alias("vec")))
    return dense_top_k(vectors, index.vectors, k, scope)


def run_rung(rung: str, queries: DataFrame, index: Index, k: int = 10, scope: str | None = "contract_id") -> DataFrame:
    """Ranked hits (query_id, rank, passage_id, score, leg ranks where fused) of every query.

    `queries` has query_id, text and, when `scope` is set, the contract the search stays inside. R7 and R7n take
    a nullable `picked` contract instead and find the deal themselves; a question they cannot place runs over the
    whole corpus.
    """
    if rung not in RUNGS:
        raise ValueError(f"unknown rung {rung!r}; expected one of {RUNGS}")
    if rung in ("R7", "R7n"):
        if index.aliases is None:
            raise ValueError(f"{rung} needs an alias table")
        placed = cut_lineage(scope_questions(queries, index.aliases, index.common))
        inner = "R6" if rung == "R7" else "R6n"
        inside = run_rung(inner, placed.where("contract_id IS NOT NULL"), index, k, "contract_id")
        whole = run_rung(inner, placed.where("contract_id IS NULL"), index, k, None)
        return inside.unionByName(whole)
    step = 6 if rung == "R6n" else RUNGS.index(rung) + 1
    if step >= 5 and index.lexicon is None:
        raise ValueError("R5 and above need the lexicon")
    s = index.settings
    asked = cut_lineage(rewrite(queries, index.lexicon)) if step >= 5 else queries
    if step == 1:
        return _lexical(index, asked, k, scope)
    if step == 2:
        return _dense(index, asked, k, scope)
    depth = max(k, s.depth)
    legs = {
        "bm25": _lexical(index, asked, depth, scope, step == 6),
        "dense": _dense(index, asked, depth, scope),
    }
    if step == 3 or rung == "R6n":
        return reciprocal_rank_fusion(legs, s.rrf_k0, k)
    fused = cut_lineage(reciprocal_rank_fusion(legs, s.rrf_k0, 2 * depth))
    head = fused.where(F.col("rank") <= s.rerank_depth).select("query_id", "passage_id")
    pairs = head.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(
        index.passages.select("passage_id", "body"), "passage_id"
    )
    cache = index.cache
    if cache is None:
        cache = pairs.sparkSession.createDataFrame([], "model string, key string, score double")
    scores, _ = score_pairs(pairs, cache, s.scorer_name, index.scorer)
    legs_of = fused.select("query_id", "passage_id", "bm25_rank", "bm25_score", "dense_rank", "dense_score")
    ranked = rerank_head(fused, scores, s.rerank_depth, k)
    return ranked.drop("fused_rank").join(legs_of, ["query_id", "passage_id"])
