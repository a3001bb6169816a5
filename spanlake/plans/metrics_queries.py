"""Registered queries: spans, retrieval metrics, tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import split_of
from spanlake.operators import metrics as M
from spanlake.operators.evaluation_sets import disputed, sample_misses
from spanlake.operators.intervals import merge_spans
from spanlake.operators.ordering import index_percentile_rank, nearest_rank, rank_pick
from spanlake.operators.statistics import cluster_bootstrap
from spanlake.operators.terms import passage_definitions
from spanlake.plans.registry import query
from spanlake.plans.retrieval_queries import FUSED, long_line_hits, two_legs
from spanlake.plans.standins import LINES, lines
from spanlake.plans.terms_queries import LINE_DEFS, PASSAGE_DEFS, SPLIT_SQL, USED, line_definitions, line_passages


def islands_sql(source: str, keys: str, out: str) -> str:
    """CTEs that merge the (start, end) spans of `source` per key into `out`."""
    return f"""
    {out}_a AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    {out}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM {out}_a),
    {out} AS (SELECT {keys}, min(start) AS start, max("end") AS "end" FROM {out}_b GROUP BY {keys}, island)"""


def boot_sql(values: str, keys: str, n_boot: int, seed: int = 0) -> str:
    """CTEs from `values` (keys, cluster, value) to `boot` (keys, mean, lo, hi, n_items, n_clusters)."""
    return f"""
    bper AS (SELECT {keys}, cluster, sum(value) AS s, count(*) AS n FROM {values} WHERE value IS NOT NULL GROUP BY ALL),
    bidx AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5(CAST(cluster AS VARCHAR)), cluster) - 1 AS pick FROM bper),
    bsz AS (SELECT {keys}, round(sum(s) / sum(n), 10) AS mean, CAST(sum(n) AS BIGINT) AS n_items, count(*) AS n_clusters FROM bper GROUP BY {keys}),
    bb AS (SELECT *, unnest(range(0, {n_boot})) AS b FROM bsz),
    bdr0 AS (SELECT *, unnest(range(0, n_clusters)) AS i FROM bb),
    bdr AS (SELECT {keys}, b, CAST('0x' || substring(md5('{seed}|' || b || '|' || i), 1, 8) AS BIGINT) % n_clusters AS pick FROM bdr0),
    brep AS (SELECT {keys}, b, round(sum(s) / sum(n), 10) AS stat FROM bdr JOIN bidx USING ({keys}, pick) GROUP BY {keys}, b),
    brank AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY stat) - 1 AS pos0 FROM brep),
    bci AS (SELECT {keys}, max(CASE WHEN pos0 = floor(0.025 * {n_boot}) THEN stat END) AS lo,
                   max(CASE WHEN pos0 = least({n_boot} - 1, floor(0.975 * {n_boot})) THEN stat END) AS hi FROM brank GROUP BY {keys}),
    boot AS (SELECT {keys}, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, n_items, n_clusters FROM bsz JOIN bci USING ({keys}))"""


def round_interval(df):
    out = df
    for c in ("mean", "delta", "lo", "hi", "a_mean", "b_mean"):
        if c in df.columns:
            out = out.withColumn(c, F.round(c, 6))
    return out


def items(t):
    """Every document is an item of its own contract."""
    return t.documents.select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").alias("contract_id"), F.col("lang").alias("category"),
        split_of(F.col("doc_id")).alias("split"), "source",
    )


def item_hits(t):
    """A document's longest lines as its hits; every fourth is another contract's."""
    h = long_line_hits(t).join(lines(t).select("passage_id", "start", "end"), "passage_id")
    other = F.when(F.col("rank") % 4 == 0, F.col("query_id") + 1).otherwise(F.col("query_id"))
    return h.select(F.col("query_id").alias("item_id"), "rank", other.alias("contract_id"), "passage_id", "start", "end")


def gold(t):
    """Gold spans: parts of every second and third line of four, merged."""
    ln = lines(t)
    raw = ln.where("ordinal % 4 = 1").select("doc_id", (F.col("start") + 10).alias("start"), (F.col("end") + 30).alias("end")).unionByName(
        ln.where("ordinal % 4 = 2").select("doc_id", "start", (F.col("start") + 15).alias("end"))
    )
    return merge_spans(raw, ["doc_id"]).select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").alias("contract_id"), F.col("start").alias("g0"), F.col("end").alias("g1")
    )


def line_spans(t):
    return lines(t).select(F.col("doc_id").alias("contract_id"), "passage_id", "start", "end", "ordinal")


ITEMS = f"""
    items AS (SELECT doc_id AS item_id, doc_id AS contract_id, lang AS category, source, {SPLIT_SQL.format('doc_id')} AS split FROM documents),
    ihits AS (SELECT item_id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank % 4 = 0 THEN item_id + 1 ELSE item_id END AS contract_id, passage_id, start, "end"
              FROM (SELECT doc_id AS item_id, passage_id, start, "end", row_number() OVER (PARTITION BY doc_id ORDER BY length(body) DESC, passage_id) AS rank FROM lines) WHERE rank <= 10),
    graw AS (SELECT doc_id AS item_id, start + 10 AS start, "end" + 30 AS "end" FROM lines WHERE ordinal % 4 = 1
             UNION ALL SELECT doc_id, start, start + 15 FROM lines WHERE ordinal % 4 = 2),
    {islands_sql('graw', 'item_id', 'gmerged')},
    gold AS (SELECT item_id, item_id AS contract_id, start AS g0, "end" AS g1 FROM gmerged),
    ngold AS (SELECT item_id, count(*) AS n, sum(g1 - g0) AS chars FROM gold GROUP BY item_id),
    pairs AS (SELECT h.item_id, rank, g0 FROM ihits h JOIN gold g ON g.item_id = h.item_id AND h.contract_id = g.contract_id
              AND greatest(0, least("end", g1) - greatest(start, g0)) >= least(20, g1 - g0)),
    found AS (SELECT item_id, count(*) FILTER (WHERE r <= 1) AS f1, count(*) FILTER (WHERE r <= 5) AS f5, count(*) FILTER (WHERE r <= 10) AS f10
              FROM (SELECT item_id, g0, min(rank) AS r FROM pairs GROUP BY ALL) GROUP BY item_id),
    rel AS (SELECT item_id, count(DISTINCT passage_id) AS n_relevant FROM gold JOIN lines ON doc_id = contract_id
            AND greatest(0, least("end", g1) - greatest(start, g0)) >= least(20, g1 - g0) GROUP BY item_id),
    dcg AS (SELECT item_id, min(rank) AS first, sum(1.0 / log2(rank + 1)) AS dcg FROM (SELECT DISTINCT item_id, rank FROM pairs) GROUP BY item_id),
    scored AS (SELECT items.item_id, items.contract_id, category, split, source, coalesce(f1, 0) / n AS recall_at_1, coalesce(f5, 0) / n AS recall_at_5,
                      coalesce(f10, 0) / n AS recall_at_10, coalesce(1.0 / first, 0) AS mrr_at_10,
                      coalesce(dcg / (SELECT sum(1.0 / log2(r + 1)) FROM range(1, CAST(least(10, n_relevant) AS BIGINT) + 1) x(r)), 0) AS ndcg_at_10
               FROM items JOIN ngold USING (item_id) LEFT JOIN found USING (item_id) LEFT JOIN rel USING (item_id) LEFT JOIN dcg USING (item_id))
"""
METRICS = ["recall_at_1", "recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10"]


def scored_items(t):
    return M.rank_metrics(item_hits(t), items(t), gold(t), line_spans(t))


@query(
    "l5_merge_spans",
    f"""WITH sp AS (SELECT l_orderkey, CAST(l_linenumber * 10 AS BIGINT) AS start, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS "end" FROM lineitem),
    {islands_sql('sp', 'l_orderkey', 'm')} SELECT * FROM m""",
)
def merged(t):
    spans = t.lineitem.select(
        "l_orderkey", (F.col("l_linenumber") * 10).cast("long").alias("start"),
        (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("end"),
    )
    return merge_spans(spans, ["l_orderkey"])


@query("k1_relevant_pairs", f"WITH {LINES}, {ITEMS} SELECT item_id, rank, g0 FROM pairs")
def relevance(t):
    """Which gold spans each hit touches."""
    return M.relevant_pairs(item_hits(t), items(t), gold(t))


def _score_query(name, cols, doc):
    picked = ", ".join(f"round({c}, 6) AS {c}" for c in cols)

    def run(t):
        return scored_items(t).select("item_id", *[F.round(c, 6).alias(c) for c in cols])

    run.__doc__ = doc
    query(name, f"WITH {LINES}, {ITEMS} SELECT item_id, {picked} FROM scored")(run)


_score_query("k2_recall", METRICS[:3], "Recall at 1, 5 and 10 per item.")
_score_query("k3_mrr", ["mrr_at_10"], "Reciprocal rank of the first relevant hit.")
_score_query("k4_ndcg", ["ndcg_at_10"], "nDCG with relevance counted over the contract's passages.")


@query("k4_relevant_passages", f"WITH {LINES}, {ITEMS} SELECT item_id, n_relevant FROM rel")
def n_relevant(t):
    return M.relevant_passages(line_spans(t), gold(t))


CHARS = f"""
    ks AS (SELECT unnest([1, 5, 10]) AS k),
    mine AS (SELECT h.item_id, k, start, "end" FROM ihits h JOIN ks ON rank <= k WHERE contract_id = item_id AND "end" > start),
    {islands_sql('mine', 'item_id, k', 'u')},
    own AS (SELECT item_id, k, sum("end" - start) AS own FROM u GROUP BY ALL),
    cov AS (SELECT u.item_id, k, sum(greatest(0, least("end", g1) - greatest(start, g0))) AS covered FROM u JOIN gold USING (item_id) GROUP BY ALL),
    fo AS (SELECT h.item_id, k, sum("end" - start) AS foreign_chars FROM ihits h JOIN ks ON rank <= k WHERE contract_id <> item_id GROUP BY ALL),
    chars AS (SELECT item_id, k, coalesce(covered, 0) / chars AS char_recall,
                     coalesce(coalesce(covered, 0) / nullif(coalesce(own, 0) + coalesce(foreign_chars, 0), 0), 0) AS char_precision, coalesce(foreign_chars, 0) AS foreign_chars
              FROM (SELECT * FROM items JOIN ngold USING (item_id) CROSS JOIN ks) LEFT JOIN own USING (item_id, k) LEFT JOIN cov USING (item_id, k) LEFT JOIN fo USING (item_id, k))
"""


@query(
    "k5_char_metrics",
    f"WITH {LINES}, {ITEMS}, {CHARS} SELECT item_id, k, round(char_recall, 6) AS char_recall, round(char_precision, 6) AS char_precision FROM chars",
)
def chars(t):
    out = M.char_metrics(item_hits(t), items(t), gold(t), (1, 5, 10))
    return out.select("item_id", "k", F.round("char_recall", 6).alias("char_recall"), F.round("char_precision", 6).alias("char_precision"))


@query("k6_foreign_hits", f"WITH {LINES}, {ITEMS} SELECT item_id, rank, passage_id FROM ihits WHERE contract_id <> item_id")
def foreign(t):
    return M.foreign_hits(item_hits(t), items(t)).select("item_id", "rank", "passage_id")


@query(
    "k7_item_scores",
    f"""WITH {LINES}, {ITEMS}, {CHARS} SELECT item_id, contract_id, category, split, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)},
        round(c.char_recall, 6) AS char_recall_at_5, round(c.char_precision, 6) AS char_precision_at_5 FROM scored JOIN (SELECT * FROM chars WHERE k = 5) c USING (item_id)""",
)
def item_scores(t):
    """One wide row per item: every metric of one rung."""
    c = M.char_metrics(item_hits(t), items(t), gold(t), (5,)).select(
        "item_id", F.round("char_recall", 6).alias("char_recall_at_5"), F.round("char_precision", 6).alias("char_precision_at_5")
    )
    wide = scored_items(t).select("item_id", "contract_id", "category", "split", *[F.round(m, 6).alias(m) for m in METRICS])
    return wide.join(c, "item_id")


K8_BOOT = 100


@query(
    "k8_summary_intervals",
    f"""WITH {LINES}, {ITEMS},
    sl AS (SELECT *, 'overall' AS slice, 'all' AS name FROM scored UNION ALL SELECT *, 'split', split FROM scored UNION ALL SELECT *, 'category', category FROM scored),
    vals AS (UNPIVOT (SELECT slice, name, source AS cluster, {', '.join(METRICS)} FROM sl) ON {', '.join(METRICS)} INTO NAME metric VALUE value),
    {boot_sql('vals', 'slice, name, metric', K8_BOOT)} SELECT * FROM boot""",
)
def summary(t):
    """Every metric overall, by split and by category, with intervals clustered by source."""
    s = M.slices(scored_items(t)).select("slice", "name", "source", *METRICS)
    long = M.long_metrics(s, METRICS)
    return round_interval(cluster_bootstrap(long, ["slice", "name", "metric"], "source", "value", K8_BOOT))


@query(
    "k9_index_percentile",
    """WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x, row_number() OVER w - 1 AS pos0, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n
                  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice))
       SELECT l_returnflag, l_linestatus, max(CASE WHEN pos0 = least(n - 1, floor(0.5 * n)) THEN x END) AS p50, max(CASE WHEN pos0 = least(n - 1, floor(0.95 * n)) THEN x END) AS p95
       FROM r GROUP BY ALL""",
)
def percentile(t):
    return rank_pick(
        t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p50": index_percentile_rank(0.5), "p95": index_percentile_rank(0.95)}
    )


@query(
    "k10_nearest_rank",
    """SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY ALL""",
)
def nearest(t):
    return rank_pick(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p95": nearest_rank(95), "p99": nearest_rank(99)})


@query(
    "k11_context_tokens",
    f"""SELECT l_returnflag AS rung, {SPLIT_SQL.format('l_orderkey')} AS split, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 1) AS context_tokens_mean
        FROM lineitem GROUP BY ALL""",
)
def context_tokens(t):
    """Mean context tokens per rung and split; unmeasured items count for nothing."""
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("rung"), split_of(F.col("l_orderkey")).alias("split"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("tokens"),
    )
    return rows.groupBy("rung", "split").agg(F.round(F.avg("tokens"), 1).alias("context_tokens_mean"))


@query(
    "k12_miss_classes",
    f"""WITH {LINES}, {LINE_DEFS}, {USED}, {PASSAGE_DEFS}, {ITEMS},
    ps AS (SELECT doc_id AS contract_id, passage_id, start, "end", CASE WHEN ordinal % 7 = 0 THEN '' ELSE 'S' || (ordinal // 5) END AS section_id FROM lines),
    top AS (SELECT item_id, passage_id FROM ihits WHERE contract_id = item_id AND rank <= 5),
    missed AS (SELECT * FROM gold WHERE (item_id, g0) NOT IN (SELECT (item_id, g0) FROM pairs WHERE rank <= 5)),
    home AS (SELECT item_id, g0, g1, arg_max(section_id, CAST(least("end", g1) - greatest(start, g0) AS HUGEINT) * 100000000000000000000 - passage_id) AS home
             FROM missed LEFT JOIN ps ON ps.contract_id = missed.contract_id AND start < g1 AND g0 < "end" GROUP BY ALL),
    cls AS (SELECT item_id, g0, g1, CASE WHEN home IS NULL THEN 'no_passage'
        WHEN EXISTS (SELECT 1 FROM top JOIN pdefs USING (passage_id) WHERE top.item_id = home.item_id AND def_start < g1 AND g0 < def_end) THEN 'definition_missing'
        WHEN home <> '' AND EXISTS (SELECT 1 FROM top JOIN ps USING (passage_id) WHERE top.item_id = home.item_id AND ps.section_id = home.home) THEN 'right_section_wrong_passage'
        WHEN home = '' THEN 'unsectioned_gold' ELSE 'wrong_section' END AS miss_class FROM home)
    SELECT * FROM cls""",
)
def misses(t):
    section = F.when(F.col("ordinal") % 7 == 0, "").otherwise(F.concat(F.lit("S"), F.floor(F.col("ordinal") / 5).cast("string")))
    p = line_passages(t)
    return M.classify_misses(
        item_hits(t), items(t), gold(t), line_spans(t).withColumn("section_id", section), passage_definitions(p, line_definitions(t))
    )


@query(
    "k13_miss_sample",
    f"""WITH {LINES}, {ITEMS} SELECT item_id FROM scored WHERE split = 'report' AND mrr_at_10 < 1 ORDER BY sha1('0|' || item_id), item_id LIMIT 150""",
)
def miss_sample(t):
    return sample_misses(scored_items(t)).select("item_id")


DISPUTES = r"""
    dsp AS (SELECT conv_id AS cluster, CAST(turn % 3 <> 0 AND length(regexp_replace(substring(text, length(text) // 2 + 1), '\s', '', 'g')) >= 10 AS DOUBLE) AS value FROM conversations)
"""


def disputes(t):
    """Turns judged by replies that quote their second half; every third reply says no, short quotes do not count."""
    quote = F.substr(F.col("text"), F.floor(F.length("text") / 2).cast("int") + 1)
    reply = F.concat(F.lit("Sure: "), F.to_json(F.struct((F.col("turn") % 3 != 0).alias("answers"), quote.alias("quote"))), F.lit(" done"))
    return t.conversations.select(F.col("conv_id").alias("cluster"), "turn", disputed(reply, F.col("text")).cast("double").alias("value"))


@query("k13_disputed_share", f"WITH {DISPUTES}, {boot_sql('(SELECT 1 AS g, * FROM dsp)', 'g', 200)} SELECT mean, lo, hi, n_items, n_clusters FROM boot")
def disputed_share(t):
    return round_interval(cluster_bootstrap(disputes(t), [], "cluster", "value", 200))


GRID = f"""
    {FUSED}, pts AS (SELECT unnest([5, 10, 20]) AS depth), k0s AS (SELECT unnest([10, 60]) AS k0),
    gsum AS (SELECT query_id, depth, k0, passage_id, round(sum(1.0 / (k0 + rank)), 12) AS score FROM legs, pts, k0s WHERE rank <= depth GROUP BY ALL),
    gtop AS (SELECT *, row_number() OVER (PARTITION BY query_id, depth, k0 ORDER BY score DESC, passage_id) AS rank FROM gsum),
    lab AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    gf AS (SELECT query_id, depth, k0, count(*) AS f FROM gtop JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = passage_id
           WHERE rank <= 5 AND a.label = b.label GROUP BY ALL),
    grid AS (SELECT depth, k0, round(avg(coalesce(f, 0) / n), 4) AS recall_at_5, count(*) AS n_items
             FROM embeddings a JOIN lab USING (label), pts, k0s LEFT JOIN gf ON gf.query_id = vec_id AND gf.depth = pts.depth AND gf.k0 = k0s.k0
             GROUP BY pts.depth, k0s.k0, depth, k0)
"""


def grid(t):
    label = t.embeddings.select("vec_id", "label")
    own, other = label.toDF("item_id", "_l"), label.toDF("passage_id", "_l")
    legs = {n: d.withColumnRenamed("query_id", "item_id") for n, d in two_legs(t).items()}

    def gold_of(top):
        return top.join(own, "item_id").join(other, ["passage_id", "_l"]).withColumn("g0", F.col("passage_id"))

    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("n_gold"))
    every = label.join(sizes, "label").select(F.col("vec_id").alias("item_id"), "n_gold")
    return M.tuning_grid(legs, gold_of, every, (5, 10, 20), (10, 60))


GRID = GRID.replace("GROUP BY pts.depth, k0s.k0, depth, k0)", "GROUP BY 1, 2)").replace("grid AS (SELECT depth, k0,", "grid AS (SELECT pts.depth AS depth, k0s.k0 AS k0,")


@query("k14_tuning_grid", f"WITH {GRID} SELECT depth, k0, recall_at_5, n_items FROM grid")
def tuning(t):
    return grid(t)


@query("k15_pick_fusion", f"WITH {GRID} SELECT depth, k0, recall_at_5, n_items FROM grid ORDER BY recall_at_5 DESC, depth, k0 DESC LIMIT 1")
def fusion_pick(t):
    return M.pick_fusion(grid(t))


def latency_settings(t):
    p = rank_pick(t.lineitem.withColumn("name", F.concat("l_returnflag", "l_linestatus")), ["name"], "l_extendedprice", {"p95_ms": index_percentile_rank(0.95)})
    r = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.round(F.avg("l_discount"), 4).alias("recall_at_5"))
    return r.join(p, "name")


SETTINGS = """
    rk AS (SELECT l_returnflag || l_linestatus AS name, l_discount, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_extendedprice) - 1 AS pos0,
                  count(*) OVER (PARTITION BY l_returnflag || l_linestatus) AS n FROM lineitem),
    st AS (SELECT name, round(avg(l_discount), 4) AS recall_at_5, max(CASE WHEN pos0 = least(n - 1, floor(0.95 * n)) THEN x END) AS p95_ms FROM rk GROUP BY name)
"""


@query("k15_pick_within_limit", f"WITH {SETTINGS} SELECT *, p95_ms <= 99600 AS live_path_ok FROM st ORDER BY p95_ms <= 99600 DESC, CASE WHEN p95_ms <= 99600 THEN recall_at_5 END DESC NULLS LAST, p95_ms, name LIMIT 1")
def limit_pick(t):
    return M.pick_within(latency_settings(t), 99600.0)


@query("k15_pick_fastest", f"WITH {SETTINGS} SELECT *, false AS live_path_ok FROM st ORDER BY p95_ms, name LIMIT 1")
def fastest_pick(t):
    """No setting meets the limit: the fastest is returned and flagged."""
    return M.pick_within(latency_settings(t), 1.0)


@query(
    "k15_best_rung",
    f"""WITH {LINES}, {ITEMS} SELECT category AS rung, CAST(ascii(category) AS INTEGER) AS position, round(avg(recall_at_5), 6) AS recall_at_5
        FROM scored WHERE split = 'report' GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 1""",
)
def best(t):
    means = scored_items(t).where("split = 'report'").groupBy(F.col("category").alias("rung")).agg(
        F.round(F.avg("recall_at_5"), 6).alias("recall_at_5")
    )
    return M.best_rung(means.withColumn("position", F.ascii("rung")))
