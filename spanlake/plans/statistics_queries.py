"""Registered queries: bootstrap intervals, comparisons, rank correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import split_of
from spanlake.operators import statistics as B
from spanlake.plans.metrics_queries import boot_sql, round_interval
from spanlake.plans.registry import query
from spanlake.plans.terms_queries import SPLIT_SQL

ORDER_VALUES = "(SELECT o_orderpriority AS g, o_custkey AS cluster, o_totalprice / 1000 AS value FROM orders)"


@query("b1_cluster_bootstrap", f"WITH {boot_sql(ORDER_VALUES, 'g', 200, 7)} SELECT * FROM boot")
def bootstrap(t):
    """Mean order price per priority with intervals clustered by customer."""
    v = t.orders.select(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("cluster"), (F.col("o_totalprice") / 1000).alias("value"))
    return round_interval(B.cluster_bootstrap(v, ["g"], "cluster", "value", 200, 7))


@query("b1_bootstrap_overall", f"WITH {boot_sql(ORDER_VALUES.replace('o_orderpriority', '1'), 'g', 500)} SELECT mean, lo, hi, n_items, n_clusters FROM boot")
def bootstrap_overall(t):
    v = t.orders.select(F.col("o_custkey").alias("cluster"), (F.col("o_totalprice") / 1000).alias("value"))
    return round_interval(B.cluster_bootstrap(v, [], "cluster", "value", 500))


RUNS = f"""
    runs AS (SELECT o_orderkey AS item_id, o_custkey AS cluster, o_orderstatus AS category, {SPLIT_SQL.format('o_custkey')} AS split,
                    o_totalprice / 500000 AS a, CASE o_orderstatus WHEN 'F' THEN o_totalprice * 1.02 WHEN 'O' THEN o_totalprice * 0.97
                    ELSE o_totalprice + (o_orderkey % 7 - 3) * 100 END / 500000 AS b FROM orders),
    diffs AS (SELECT category, cluster, b - a AS value, a, b FROM runs WHERE split = 'report')
"""


def two_runs(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    changed = F.when(status == "F", price * 1.02).when(status == "O", price * 0.97).otherwise(price + (F.col("o_orderkey") % 7 - 3) * 100)
    r = t.orders.select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("cluster"), status.alias("category"),
        split_of(F.col("o_custkey")).alias("split"), (price / 500000).alias("a"), (changed / 500000).alias("b"),
    ).where("split = 'report'")
    return r.select("item_id", "cluster", "category", F.col("a").alias("value")), r.select("item_id", F.col("b").alias("value"))


@query(
    "b2_paired_bootstrap",
    f"""WITH {RUNS}, mn AS (SELECT category, round(avg(a), 6) AS a_mean, round(avg(b), 6) AS b_mean FROM diffs GROUP BY category), {boot_sql('diffs', 'category', 200)}
    SELECT category, mean AS delta, lo, hi, n_items, n_clusters, a_mean, b_mean,
           CASE WHEN lo > 0 THEN 'helps' WHEN hi < 0 THEN 'hurts' ELSE 'no measurable change' END AS verdict FROM boot JOIN mn USING (category)""",
)
def paired(t):
    """The second run against the first on the same report items, by category, with a verdict."""
    a, b = two_runs(t)
    out = round_interval(B.paired_bootstrap(a, b, ["category"], 200))
    return out.withColumn("verdict", B.verdict(F.col("lo"), F.col("hi")))


@query(
    "b2_unmatched_items",
    """SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS only_first,
              (SELECT count(*) FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)) AS only_second""",
)
def unmatched(t):
    return B.unmatched_items(t.labels.select(F.col("doc_id").alias("item_id")), t.documents.where("lang = 'en'").select(F.col("doc_id").alias("item_id")))


@query("b2_ceiling", f"WITH {boot_sql(ORDER_VALUES.replace('o_totalprice / 1000', '1 - (o_totalprice < 9000)::INT'), 'g', 200)} SELECT g, lo >= 0.95 AS ceiling FROM boot")
def ceiling(t):
    """Priorities whose baseline interval leaves no room for improvement."""
    v = t.orders.select(
        F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("cluster"), (F.col("o_totalprice") >= 9000).cast("double").alias("value")
    )
    return B.cluster_bootstrap(v, ["g"], "cluster", "value", 200).select("g", B.at_ceiling(F.col("lo")).alias("ceiling"))


@query(
    "b3_kendall_tau",
    """WITH p AS (SELECT c_nationkey, c_mktsegment, floor(avg(c_acctbal) / 500) AS x, floor(count(*) / 2) AS y FROM customer GROUP BY ALL),
    s AS (SELECT a.c_nationkey, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment < b.c_mktsegment),
    c AS (SELECT c_nationkey, count(*) FILTER (WHERE dx * dy > 0) AS conc, count(*) FILTER (WHERE dx * dy < 0) AS disc,
                 count(*) FILTER (WHERE dx = 0 AND dy <> 0) AS tx, count(*) FILTER (WHERE dx <> 0 AND dy = 0) AS ty FROM s GROUP BY 1)
    SELECT c_nationkey, round((conc - disc) / nullif(sqrt((conc + disc + tx) * (conc + disc + ty)), 0), 6) AS tau FROM c""",
)
def tau(t):
    """Rank agreement of balance and size over the five segments of every nation."""
    p = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(
        F.floor(F.avg("c_acctbal") / 500).alias("x"), F.floor(F.count(F.lit(1)) / 2).alias("y")
    )
    per = p.groupBy("c_nationkey").agg(F.collect_list(F.struct("x", "y")).alias("pts"))
    return per.select("c_nationkey", F.round(B.tau_b(F.col("pts")), 6).alias("tau"))


RUNGS = ("r1", "r2", "r3")


def tier_rows(t):
    price = F.col("o_totalprice") / 500000
    cols = {
        "r1_human": price, "r1_machine": price * 0.9, "r2_human": price * 1.01 + F.col("o_orderkey") % 5 / 1000,
        "r2_machine": price * 0.91, "r3_human": price * 0.99, "r3_machine": price * 0.9 + F.col("o_orderkey") % 7 / 500,
    }
    return t.orders.select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("cluster"),
        (F.col("o_orderstatus") != "P").cast("double").alias("match"), *[c.alias(n) for n, c in cols.items()],
    )


TIER = """
    tr AS (SELECT o_custkey AS cluster, CAST(o_orderstatus <> 'P' AS DOUBLE) AS match, o_totalprice / 500000 AS r1h, o_totalprice / 500000 * 0.9 AS r1m,
                  o_totalprice / 500000 * 1.01 + o_orderkey % 5 / 1000 AS r2h, o_totalprice / 500000 * 0.91 AS r2m, o_totalprice / 500000 * 0.99 AS r3h,
                  o_totalprice / 500000 * 0.9 + o_orderkey % 7 / 500 AS r3m FROM orders)
"""


@query(
    "b4_tier_means",
    f"""WITH {TIER} SELECT 'r1' AS rung, round(avg(r1h), 6) AS human, round(avg(r1m), 6) AS machine FROM tr
        UNION ALL SELECT 'r2', round(avg(r2h), 6), round(avg(r2m), 6) FROM tr UNION ALL SELECT 'r3', round(avg(r3h), 6), round(avg(r3m), 6) FROM tr""",
)
def tier_means(t):
    return B.tier_report(tier_rows(t), RUNGS, 10)[0].select("rung", F.round("human", 6).alias("human"), F.round("machine", 6).alias("machine"))


@query(
    "b4_tier_report",
    f"""WITH {TIER}, per AS (SELECT cluster, sum(match) AS m, sum(r1h) AS h1, sum(r1m) AS m1, sum(r2h) AS h2, sum(r2m) AS m2, sum(r3h) AS h3, sum(r3m) AS m3, count(*) AS n FROM tr GROUP BY 1),
    idx AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(cluster AS VARCHAR)), cluster) - 1 AS pick FROM per), c AS (SELECT count(*) AS c FROM per),
    dr AS (SELECT b, CAST('0x' || substring(md5('0|' || b || '|' || i), 1, 8) AS BIGINT) % c AS pick FROM (SELECT c, b, unnest(range(0, c)) AS i FROM (SELECT c, unnest(range(0, 200)) AS b FROM c))),
    rp AS (SELECT b, sum(m) AS m, sum(h1) AS h1, sum(m1) AS m1, sum(h2) AS h2, sum(m2) AS m2, sum(h3) AS h3, sum(m3) AS m3, sum(n) AS n FROM dr JOIN idx USING (pick) GROUP BY b
           UNION ALL SELECT -1, sum(m), sum(h1), sum(m1), sum(h2), sum(m2), sum(h3), sum(m3), sum(n) FROM per),
    mn AS (SELECT b, n, m / n AS rate, round(h1 / n, 10) AS h1, round(m1 / n, 10) AS m1, round(h2 / n, 10) AS h2, round(m2 / n, 10) AS m2, round(h3 / n, 10) AS h3, round(m3 / n, 10) AS m3 FROM rp),
    sg AS (SELECT b, n, rate, [sign(h1 - h2) * sign(m1 - m2), sign(h1 - h3) * sign(m1 - m3), sign(h2 - h3) * sign(m2 - m3)] AS z,
                  [sign(h1 - h2), sign(h1 - h3), sign(h2 - h3)] AS dx, [sign(m1 - m2), sign(m1 - m3), sign(m2 - m3)] AS dy FROM mn),
    ta AS (SELECT b, n, rate, len(list_filter(z, lambda v: v > 0)) AS conc, len(list_filter(z, lambda v: v < 0)) AS disc,
                  len(list_filter(list_zip(dx, dy), lambda p: p[1] = 0 AND p[2] <> 0)) AS tx, len(list_filter(list_zip(dx, dy), lambda p: p[1] <> 0 AND p[2] = 0)) AS ty FROM sg),
    tt AS (SELECT b, n, round(rate, 10) AS rate, round(CAST(conc - disc AS DOUBLE) / nullif(sqrt((conc + disc + tx) * (conc + disc + ty)), 0), 10) AS tau FROM ta),
    rk AS (SELECT *, row_number() OVER (ORDER BY rate) - 1 AS ra FROM tt WHERE b >= 0),
    tk AS (SELECT *, row_number() OVER (ORDER BY tau) - 1 AS pos0, count(*) OVER () AS nt FROM tt WHERE b >= 0 AND tau IS NOT NULL)
    SELECT (SELECT CAST(n AS BIGINT) FROM tt WHERE b = -1) AS items, (SELECT round(rate, 6) FROM tt WHERE b = -1) AS match_rate, (SELECT round(tau, 6) FROM tt WHERE b = -1) AS tau,
           (SELECT round(tau, 6) FROM tk WHERE pos0 = floor(0.025 * nt)) AS tau_lo, (SELECT round(tau, 6) FROM tk WHERE pos0 = least(nt - 1, floor(0.975 * nt))) AS tau_hi,
           (SELECT round(rate, 6) FROM rk WHERE ra = floor(0.025 * 200)) AS match_lo, (SELECT round(rate, 6) FROM rk WHERE ra = least(199, floor(0.975 * 200))) AS match_hi,
           (SELECT count(*) FROM tk) AS tau_defined""",
)
def tier_report(t):
    """Match rate of two answer keys and how far they agree on the order of the rungs, with intervals."""
    out = B.tier_report(tier_rows(t), RUNGS, 200)[1]
    return out.select(
        "items", "tau_defined", *[F.round(c, 6).alias(c) for c in ("match_rate", "tau", "tau_lo", "tau_hi", "match_lo", "match_hi")]
    )


@query("b4_rung_order", f"WITH {TIER} SELECT 'human' AS answer_key, 'r2 > r1 > r3' AS \"order\" FROM (SELECT avg(r2h) AS b, avg(r1h) AS a, avg(r3h) AS c FROM tr) WHERE b > a AND a > c")
def order(t):
    return B.rung_order(B.tier_report(tier_rows(t), RUNGS, 10)[0], "human")


@query(
    "b5_majority_baseline",
    f"""SELECT o_orderpriority AS question, arg_min(answer, lpad(CAST(1000000000 - votes AS VARCHAR), 12, '0') || answer) AS majority, CAST(max(votes) AS BIGINT) AS votes FROM (
          SELECT o_orderpriority, o_orderstatus AS answer, count(*) AS votes
          FROM orders WHERE {SPLIT_SQL.format('o_custkey')} = 'tune' GROUP BY ALL) GROUP BY 1""",
)
def majority(t):
    tune = t.orders.where(split_of(F.col("o_custkey")) == "tune").select(F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"))
    return B.majority_answers(tune, "question", "answer")
