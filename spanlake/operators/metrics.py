"""Retrieval metrics over batches of scored items.

`hits`: item_id, rank, contract_id (the hit's), passage_id, start, end; `items`: item_id, contract_id, ...;
`gold`: item_id, contract_id, g0, g1, merged spans of the item's own contract.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.spans import overlap, touches
from spanlake.operators.intervals import merge_spans, overlap_join

K = 10
CUTS = (1, 5, 10)


def own_hits(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Hits inside the item's own contract; a hit elsewhere never matches gold."""
    return hits.join(items.select("item_id", "contract_id"), ["item_id", "contract_id"], "left_semi")


def foreign_hits(hits: DataFrame, items: DataFrame) -> DataFrame:
    return hits.join(items.select("item_id", "contract_id"), ["item_id", "contract_id"], "left_anti")


def relevant_pairs(hits: DataFrame, items: DataFrame, gold: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, g0): gold spans each of the first k own hits touches."""
    h = own_hits(hits, items).where(F.col("rank") <= k)
    g = gold.select("item_id", "g0", "g1")
    return h.join(g, "item_id").where(touches(F.col("start"), F.col("end"), F.col("g0"), F.col("g1"))).select("item_id", "rank", "g0")


def relevant_passages(passages: DataFrame, gold: DataFrame) -> DataFrame:
    """How many of a contract's indexed passages are relevant to each item. `passages`: contract_id, passage_id, start, end."""
    p = passages.select("contract_id", "passage_id", "start", "end")
    met = overlap_join(p, gold.select("contract_id", "item_id", "g0", "g1"), ["contract_id"], ("start", "end"), ("g0", "g1"))
    met = met.where(touches(F.col("start"), F.col("end"), F.col("g0"), F.col("g1")))
    return met.select("item_id", "passage_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("n_relevant"))


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def rank_metrics(hits: DataFrame, items: DataFrame, gold: DataFrame, passages: DataFrame) -> DataFrame:
    """items with recall@1/5/10, mrr@10 and ndcg@10."""
    pairs = relevant_pairs(hits, items, gold)
    found = pairs.groupBy("item_id", "g0").agg(F.min("rank").alias("r")).groupBy("item_id").agg(
        *[F.count_if(F.col("r") <= c).alias(f"_f{c}") for c in CUTS]
    )
    ranks = pairs.groupBy("item_id").agg(F.min("rank").alias("_first"), F.collect_set("rank").alias("_ranks"))
    n_gold = gold.groupBy("item_id").agg(F.count(F.lit(1)).alias("_gold"))
    out = (
        items.join(n_gold, "item_id")
        .join(found, "item_id", "left")
        .join(ranks, "item_id", "left")
        .join(relevant_passages(passages, gold), "item_id", "left")
    )
    dcg = F.aggregate(F.coalesce("_ranks", F.array().cast("array<int>")), F.lit(0.0), lambda a, r: a + _gain(r))
    n = F.least(F.lit(K), F.coalesce("n_relevant", F.lit(0)))
    ideal = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, r: a + _gain(r)))
    for c in CUTS:
        out = out.withColumn(f"recall_at_{c}", F.coalesce(F.col(f"_f{c}"), F.lit(0)) / F.col("_gold"))
    return (
        out.withColumn("mrr_at_10", F.coalesce(1.0 / F.col("_first"), F.lit(0.0)))
        .withColumn("ndcg_at_10", F.coalesce(dcg / ideal, F.lit(0.0)))
        .drop("_gold", "_first", "_ranks", "n_relevant", *[f"_f{c}" for c in CUTS])
    )


def char_metrics(hits: DataFrame, items: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(item_id, k, char_recall, char_precision) over the union of the first k hits' characters.

    A foreign hit covers no gold but its characters count against precision.
    """
    cut = F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))).alias("k")
    mine = own_hits(hits, items).where(F.col("end") > F.col("start")).select("item_id", cut, "start", "end")
    union = merge_spans(mine, ["item_id", "k"])
    total = union.groupBy("item_id", "k").agg(F.sum(F.col("end") - F.col("start")).alias("_own"))
    met = overlap_join(union, gold.select("item_id", "g0", "g1"), ["item_id"], ("start", "end"), ("g0", "g1"))
    covered = met.groupBy("item_id", "k").agg(
        F.sum(overlap(F.col("start"), F.col("end"), F.col("g0"), F.col("g1"))).alias("_covered")
    )
    other = foreign_hits(hits, items).select("item_id", cut, (F.col("end") - F.col("start")).alias("len")).groupBy(
        "item_id", "k"
    ).agg(F.sum("len").alias("_foreign"))
    n_gold = gold.groupBy("item_id").agg(F.sum(F.col("g1") - F.col("g0")).alias("_gold"))
    every = items.select("item_id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).join(n_gold, "item_id")
    out = every
    for part in (total, covered, other):
        out = out.join(part, ["item_id", "k"], "left")
    zero = F.lit(0)
    shown = F.coalesce("_own", zero) + F.coalesce("_foreign", zero)
    return out.select(
        "item_id", "k",
        F.coalesce(F.try_divide(F.coalesce("_covered", zero), F.nullif("_gold", zero)), F.lit(0.0)).alias("char_recall"),
        F.coalesce(F.try_divide(F.coalesce("_covered", zero), F.nullif(shown, zero)), F.lit(0.0)).alias("char_precision"),
    )


def long_metrics(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """Scored items with one row per metric: (metric, value)."""
    keep = [c for c in scored.columns if c not in metrics]
    return scored.unpivot(keep, metrics, "metric", "value")


def slices(scored: DataFrame) -> DataFrame:
    """Every item once overall, once in its split and once in its category: (slice, name)."""
    which = F.array(
        F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("name")),
        F.struct(F.lit("split").alias("slice"), F.col("split").alias("name")),
        F.struct(F.lit("category").alias("slice"), F.col("category").alias("name")),
    )
    return scored.withColumn("_s", F.explode(which)).select("*", "_s.slice", "_s.name").drop("_s")


MISS_CLASSES = ("definition_missing", "right_section_wrong_passage", "unsectioned_gold", "wrong_section")
NO_PASSAGE = "no_passage"


def classify_misses(
    hits: DataFrame, items: DataFrame, gold: DataFrame, passages: DataFrame, defs: DataFrame, k: int = 5
) -> DataFrame:
    """Every gold span the first k hits miss, with why.

    `passages`: contract_id, passage_id, start, end, section_id; `defs`: passage_id, def_start, def_end. A span's
    home is the passage that overlaps it most, the lowest id on a tie; a span that no passage overlaps keeps its row,
    with a class of its own.
    """
    top = own_hits(hits, items).where(F.col("rank") <= k).select("item_id", "passage_id")
    touched = relevant_pairs(hits, items, gold, k).select("item_id", "g0").distinct()
    missed = gold.join(touched, ["item_id", "g0"], "left_anti")
    met = overlap_join(
        passages.select("contract_id", "passage_id", "start", "end", "section_id"),
        missed.select("contract_id", "item_id", "g0", "g1"), ["contract_id"], ("start", "end"), ("g0", "g1"),
    )
    shared = overlap(F.col("start"), F.col("end"), F.col("g0"), F.col("g1"))
    home = met.groupBy("item_id", "g0").agg(F.max_by("section_id", F.struct(shared, -F.col("passage_id"))).alias("home"))
    top_defs = top.join(defs.select("passage_id", "def_start", "def_end"), "passage_id").select("item_id", "def_start", "def_end").distinct()
    in_def = overlap_join(
        missed.select("item_id", "g0", "g1"), top_defs, ["item_id"], ("g0", "g1"), ("def_start", "def_end")
    ).select("item_id", "g0", F.lit(True).alias("in_def")).distinct()
    sections = top.join(passages.select("passage_id", F.col("section_id").alias("home")), "passage_id").where("home <> ''")
    sections = sections.select("item_id", "home", F.lit(True).alias("same_section")).distinct()
    out = (
        missed.join(home, ["item_id", "g0"], "left")
        .join(in_def, ["item_id", "g0"], "left")
        .join(sections, ["item_id", "home"], "left")
    )
    why = (
        F.when(F.col("home").isNull(), NO_PASSAGE)
        .when(F.col("in_def"), MISS_CLASSES[0])
        .when(F.col("same_section"), MISS_CLASSES[1])
        .when(F.col("home") == "", MISS_CLASSES[2])
        .otherwise(MISS_CLASSES[3])
    )
    return out.select("item_id", "g0", "g1", why.alias("miss_class"))


def tuning_grid(legs: dict[str, DataFrame], gold_of, items: DataFrame, depths: tuple[int, ...], k0s: tuple[int, ...], k: int = 10) -> DataFrame:
    """Recall@5 of every (depth, k0): legs are retrieved once at the largest depth and cut per grid point.

    `gold_of` maps fused hits (item_id, rank, passage_id, depth, k0) to relevant pairs (…, g0).
    """
    tagged = reduce(DataFrame.unionByName, [d.select("item_id", "passage_id", "rank") for d in legs.values()])
    point = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(c).alias("k0")) for d in depths for c in k0s])
    grid = tagged.select("*", F.explode(F.filter(point, lambda p: p["depth"] >= F.col("rank"))).alias("p"))
    fused = grid.groupBy("item_id", "p.depth", "p.k0", "passage_id").agg(
        F.round(F.sum(1.0 / (F.col("p.k0") + F.col("rank"))), 12).alias("score")
    )
    w = Window.partitionBy("item_id", "depth", "k0").orderBy(F.desc("score"), "passage_id")
    top = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    pairs = gold_of(top.where(F.col("rank") <= 5))
    found = pairs.select("item_id", "depth", "k0", "g0").distinct().groupBy("item_id", "depth", "k0").agg(F.count(F.lit(1)).alias("f"))
    every = items.select("item_id", "n_gold", F.explode(point).alias("p")).select("item_id", "n_gold", "p.*")
    return (
        every.join(found, ["item_id", "depth", "k0"], "left")
        .groupBy("depth", "k0")
        .agg(F.round(F.avg(F.coalesce("f", F.lit(0)) / F.col("n_gold")), 4).alias("recall_at_5"), F.count(F.lit(1)).alias("n_items"))
    )


def pick_fusion(grid: DataFrame) -> DataFrame:
    """Best recall; ties go to the smaller depth, then the larger k0."""
    return grid.orderBy(F.desc("recall_at_5"), "depth", F.desc("k0")).limit(1)


MAX_P95_MS = 3000.0


def pick_within(settings: DataFrame, limit: float = MAX_P95_MS) -> DataFrame:
    """Best recall among settings within the latency limit, ties to the faster; else the fastest, flagged."""
    ok = F.col("p95_ms") <= limit
    order = [F.desc(ok), F.desc(F.when(ok, F.col("recall_at_5"))), F.asc("p95_ms"), F.asc("name")]
    return settings.orderBy(*order).limit(1).withColumn("live_path_ok", ok)


def best_rung(means: DataFrame) -> DataFrame:
    """The rung with the best report recall@5; a tie goes to the lower rung. `means`: rung, position, recall_at_5."""
    return means.orderBy(F.desc("recall_at_5"), "position").limit(1)
