"""Registered queries: facts and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import facts as F_
from spanlake.operators.metrics import long_metrics, slices
from spanlake.operators.statistics import cluster_bootstrap
from spanlake.plans.metrics_queries import ITEMS, K8_BOOT, METRICS, boot_sql, scored_items
from spanlake.plans.registry import query
from spanlake.plans.standins import LINES, lines
from spanlake.plans.terms_queries import LINE_DEFS, PASSAGE_DEFS, USED, line_definitions, line_passages
from spanlake.operators.terms import passage_definitions

S = F.concat

SCALARS = f"""WITH {LINES}, {LINE_DEFS}, {USED}, {PASSAGE_DEFS}, n AS (SELECT count(*) AS n FROM lines)
    SELECT 'contracts' AS name, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'chars', CAST(sum(n_chars) AS DOUBLE) FROM documents
    UNION ALL SELECT 'passages', CAST(n AS DOUBLE) FROM n
    UNION ALL SELECT 'passages_with_section_share', round(avg((ordinal % 3 <> 0)::INT), 4) FROM lines
    UNION ALL SELECT 'passages_with_article_share', round(avg((ordinal % 3 = 1)::INT), 4) FROM lines
    UNION ALL SELECT 'terms_defined', CAST(count(*) AS DOUBLE) FROM defs
    UNION ALL SELECT 'defs_per_passage_mean', round(count(*) / any_value(n), 2) FROM pdefs, n
    UNION ALL SELECT 'passages_with_defs_share', round(count(DISTINCT passage_id) / any_value(n), 4) FROM pdefs, n
    UNION ALL SELECT 'label_contracts_with_text', CAST(count(*) AS DOUBLE) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en')"""


@query("f1_scalar_facts", SCALARS)
def scalars(t):
    """Counts, shares, definition statistics and an id-set overlap as named facts."""
    docs, ln = t.documents, lines(t)
    o = F.col("ordinal") % 3
    p = line_passages(t)
    defs = line_definitions(t)
    attached = passage_definitions(p, defs)
    n = ln.agg(F.count(F.lit(1)).alias("n")).scalar()
    per = attached.agg(F.count(F.lit(1)).alias("d"), F.count_distinct("passage_id").alias("p")).select(
        F.round(F.col("d") / n, 2).alias("d"), F.round(F.col("p") / n, 4).alias("p")
    )
    return F_.all_facts(
        [
            F_.named_facts(docs, {"contracts": F.count(F.lit(1)), "chars": F.sum("n_chars")}),
            F_.named_facts(
                ln,
                {
                    "passages": F.count(F.lit(1)), "passages_with_section_share": F.round(F.avg((o != 0).cast("int")), 4),
                    "passages_with_article_share": F.round(F.avg((o == 1).cast("int")), 4),
                },
            ),
            F_.named_facts(defs, {"terms_defined": F.count(F.lit(1))}),
            F_.named_facts(per, {"defs_per_passage_mean": F.max("d"), "passages_with_defs_share": F.max("p")}),
            F_.shared_ids(t.labels, docs.where("lang = 'en'"), "doc_id", "label_contracts_with_text"),
        ]
    )


def summary(t):
    s = slices(scored_items(t)).select("slice", "name", "source", *METRICS)
    return cluster_bootstrap(long_metrics(s, METRICS), ["slice", "name", "metric"], "source", "value", K8_BOOT)


SUMMARY = f"""WITH {LINES}, {ITEMS},
    sl AS (SELECT *, 'split' AS slice, split AS name FROM scored WHERE split = 'report' UNION ALL SELECT *, 'category', category FROM scored),
    vals AS (UNPIVOT (SELECT slice, name, source AS cluster, {', '.join(METRICS)} FROM sl) ON {', '.join(METRICS)} INTO NAME metric VALUE value),
    {boot_sql('vals', 'slice, name, metric', K8_BOOT)}"""
CATEGORIES = {"english": "en", "french": "fr", "latin": "la"}
_CAT = " UNION ALL ".join(f"SELECT '{k}' AS slug, '{v}' AS name" for k, v in CATEGORIES.items())


@query(
    "f2_metric_facts",
    f"""{SUMMARY}, c AS (SELECT slug, b.* FROM ({_CAT}) x LEFT JOIN (SELECT * FROM boot WHERE slice = 'category' AND metric = 'recall_at_5') b USING (name))
    SELECT 'r1_report_' || metric || s AS name, round(v, 4) AS value FROM (SELECT metric, unnest(['', '_lo', '_hi']) AS s, unnest([mean, lo, hi]) AS v FROM boot WHERE slice = 'split')
    UNION ALL SELECT 'r1_cat_' || slug || s, v FROM (SELECT slug, unnest(['_recall_at_5', '_recall_at_5_lo', '_recall_at_5_hi', '_items', '_contracts']) AS s,
        unnest([round(mean, 4), round(lo, 4), round(hi, 4), CAST(coalesce(n_items, 0) AS DOUBLE), CAST(coalesce(n_clusters, 0) AS DOUBLE)]) AS v FROM c)""",
)
def metric_facts(t):
    """Report metrics with their ends and category facts; a category with no items counts zero."""
    return F_.metric_facts(summary(t), CATEGORIES, "recall_at_5")


def stored_and_fresh(t):
    stored = t.customer.select("c_name", "c_acctbal").where("c_acctbal > 0").select(
        S(F.when(F.col("c_acctbal") > 9000, "x_latency_ms_").otherwise("f_"), "c_name").alias("name"), F.when(F.col("c_acctbal") < 8000, F.col("c_acctbal")).alias("value")
    )
    fresh = t.customer.where("c_acctbal < 9500").select(
        S(F.when(F.col("c_acctbal") > 9000, "x_latency_ms_").otherwise("f_"), "c_name").alias("name"),
        F.when(F.col("c_acctbal") < 8500, F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).alias("value"),
    )
    return stored, fresh


@query(
    "f3_facts_diff",
    """WITH s AS (SELECT CASE WHEN c_acctbal > 9000 THEN 'x_latency_ms_' ELSE 'f_' END || c_name AS name, CASE WHEN c_acctbal < 8000 THEN c_acctbal END AS v FROM customer WHERE c_acctbal > 0),
    f AS (SELECT CASE WHEN c_acctbal > 9000 THEN 'x_latency_ms_' ELSE 'f_' END || c_name AS name, CASE WHEN c_acctbal < 8500 THEN c_acctbal + (c_nationkey = 3)::INT END AS v FROM customer WHERE c_acctbal < 9500)
    SELECT name, CASE WHEN f.name IS NULL THEN 'no longer built' WHEN s.name IS NULL THEN 'new' ELSE 'stale' END AS problem FROM s FULL OUTER JOIN f USING (name)
    WHERE name NOT LIKE '%latency_ms%' AND (f.name IS NULL OR s.name IS NULL OR s.v IS DISTINCT FROM f.v)""",
)
def diff(t):
    return F_.facts_diff(*stored_and_fresh(t))


def typed_objects(t, shift: int):
    """One flat object per customer: a whole number written as one or as a decimal, a string, a boolean and a null that turns to a number."""
    k = F.col("c_custkey")
    late = (k + shift) % 5 == 0
    number = F.when(late, S(k.cast("string"), F.lit(".0"))).otherwise(S((k + F.when(k % 7 == 0, shift).otherwise(0)).cast("string")))
    gap = F.when(k % 3 == 0, "null").when(k % 3 == 1, F.lit(str(shift))).otherwise("true" if shift else "1")
    text = S(
        F.lit('{"n": '), number, F.lit(', "segment": "'), F.when(late, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit('", "rich": '),
        (F.col("c_acctbal") > 100 * shift).cast("string"), F.lit(', "gap": '), gap, F.lit(', "list": [1]}'),
    )
    return t.customer.where(F.lit(shift == 0) | (k % 11 != 0)).select(k.alias("c_custkey"), text.alias("json"))


def typed(t, shift: int):
    return F_.typed_facts(typed_objects(t, shift), "json", S(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("_")))


@query(
    "f1_typed_facts",
    """SELECT 'c' || c_custkey || '_' || u.name AS name, u.type AS type, u.value AS value FROM (
         SELECT c_custkey, unnest([{'name': 'n', 'type': 'number', 'value': c_custkey || '.0'}, {'name': 'segment', 'type': 'string',
           'value': CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END}, {'name': 'rich', 'type': 'boolean', 'value': CAST(c_acctbal > 0 AS VARCHAR)},
           {'name': 'gap', 'type': CASE c_custkey % 3 WHEN 0 THEN 'null' ELSE 'number' END, 'value': CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '0.0' ELSE '1.0' END}]) AS u FROM customer)""",
)
def typed_values(t):
    """Facts of all four types from flat JSON objects, numbers read as numbers."""
    number = F.variant_get("value", "$", "double").cast("decimal(20,1)").cast("string")
    shown = F.when(F.col("type") == "number", number).when(F.col("type") != "null", F.variant_get("value", "$", "string"))
    return typed(t, 0).select("name", "type", shown.alias("value"))


@query(
    "f3_typed_diff",
    """WITH k AS (SELECT c_custkey AS k, c_custkey % 11 <> 0 AS kept, c_acctbal AS b FROM customer), u AS (
         SELECT k, kept, unnest(['n', 'segment', 'rich', 'gap']) AS f, unnest([k % 7 = 0 AND (k + 1) % 5 <> 0, (k % 5 = 0) <> ((k + 1) % 5 = 0),
           (b > 0) <> (b > 100), k % 3 <> 0]) AS changed FROM k)
       SELECT 'c' || k || '_' || f AS name, CASE WHEN kept THEN 'stale' ELSE 'no longer built' END AS problem FROM u WHERE changed OR NOT kept""",
)
def typed_difference(t):
    """Facts of four types built again: 7 and 7.0 are one number, 1 and true are not one value."""
    return F_.typed_diff(typed(t, 0), typed(t, 1))


@query(
    "f4_tier_labels",
    """SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 'machine-built' WHEN 1 THEN 'human-labelled (MAUD)' WHEN 2 THEN 'machine-built' WHEN 3 THEN 'human-labelled (MAUD)' WHEN 4 THEN 'machine-built' END AS label FROM customer""",
)
def labels(t):
    k = F.col("c_nationkey") % 6
    name = S(
        F.when(k == 0, "m3_tm_").when(k == 1, "m2_r4_").when(k == 2, "m3_tier_r2_machine_").when(k == 3, "m3_tier_r5_human_")
        .when(k == 4, "m4_cmp_model_big_tmachine_").otherwise("m5_bundle_bytes_"),
        F.col("c_custkey").cast("string"),
    )
    return t.customer.select("c_custkey", F_.tier_label(name).alias("label"))


def copy_texts(t):
    """One published line per document: its length, a rounded share, a percent, a machine-built number and a missing one."""
    n = F.col("n_chars")
    text = S(
        F.lit("1. Holds "), n.cast("string"), F.lit(" chars on [site](https://x.example/99) since 2024-01-05, about "), F.round(n / 1000, 1).cast("string"),
        F.lit(" thousand, `77` and "), F.floor(n / 100).cast("string"), F.lit("%; model v1.5 says 0.123456."), F.when(F.col("lang") == "en", " (machine-built)").otherwise(""),
    )
    return t.documents.select("doc_id", text.alias("text"))


def copy_facts(t):
    n = F.col("n_chars")
    base = t.documents.select(S(F.lit("len_"), F.col("doc_id").cast("string")).alias("name"), n.cast("double").alias("value"))
    thousand = t.documents.select(S(F.lit("m3_tm_"), F.col("doc_id").cast("string")).alias("name"), (n / 1000).alias("value"))
    share = t.documents.select(S(F.lit("share_"), F.col("doc_id").cast("string")).alias("name"), (F.floor(n / 100) / 100).alias("value"))
    return base.unionByName(thousand).unionByName(share)


@query("f5_number_check")
def number_check(t):
    """Every number of every line of every whole text, its published line last, against the facts."""
    published = t.documents.select("doc_id", "text").join(copy_texts(t).withColumnRenamed("text", "_copy"), "doc_id")
    lines_ = F_.published_lines(published.select("doc_id", F.concat_ws("\n", "text", "_copy").alias("text")), "doc_id")
    return F_.check_numbers(lines_, copy_facts(t), ["doc_id", "line"])


@query(
    "f5_exact_lengths",
    """WITH n AS (SELECT n_chars, count(*) AS n FROM documents GROUP BY 1) SELECT doc_id, CAST(n_chars AS VARCHAR) AS raw, 'fact' AS status, n + (SELECT count(*) FROM documents b WHERE b.n_chars / 1000 = a.n_chars) AS n_facts
       FROM documents a JOIN n USING (n_chars)""",
)
def exact_lengths(t):
    """The first number of every line is its own document's length: an exact fact, shared by equal lengths."""
    return F_.check_numbers(copy_texts(t), copy_facts(t), ["doc_id"]).where("at = 0").select("doc_id", "raw", "status", "n_facts")


@query("f5_date_check", "SELECT doc_id, CAST(0 AS INTEGER) AS at, '2024-01-05' AS raw, CASE WHEN n > 0 THEN 'fact' ELSE 'no fact' END AS status, n AS n_facts FROM documents, (SELECT count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-05') AS n FROM events)".replace(" AS at,", ' AS "at",'))
def date_check(t):
    facts = t.events.select(S(F.lit("e"), F.col("event_id").cast("string")).alias("name"), F.date_format("ts", "'on 'yyyy-MM-dd").alias("value"))
    return F_.check_dates(copy_texts(t), facts, ["doc_id"])


SCAN = {"hex token": r"[0-9a-f]{40}", "long number": r"[0-9]{16}", "address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}


@query("f6_secret_scan", " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) AS n FROM documents WHERE regexp_matches(text, '{v}') HAVING count(*) > 0" for k, v in SCAN.items()))
def secrets(t):
    return F_.secret_scan(t.documents, {**F_.SECRET_PATTERNS, **SCAN})


def compared(t):
    ours = t.lineitem.groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_discount") * 100, 2).alias("ours_pct"))
    theirs = t.lineitem.where("l_returnflag = 'R'").groupBy((F.col("l_linenumber") + 1).alias("k")).agg(F.round(F.avg("l_tax") * 100, 2).alias("theirs_pct"))
    return F_.external_comparison(ours, theirs)


EXTERNAL = """
    o AS (SELECT l_linenumber AS k, round(avg(l_discount) * 100, 2) AS ours_pct FROM lineitem GROUP BY 1),
    e AS (SELECT l_linenumber + 1 AS k, round(avg(l_tax) * 100, 2) AS theirs_pct FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
"""


@query("f7_external_comparison", f"WITH {EXTERNAL} SELECT * FROM o JOIN e USING (k)")
def external(t):
    return compared(t)[0]


@query("f7_unmatched_keys", f"WITH {EXTERNAL} SELECT k, 'ours' AS side FROM o WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT k, 'theirs' FROM e WHERE k NOT IN (SELECT k FROM o)")
def unmatched(t):
    return compared(t)[1]
