"""Registered queries: deal identity, amendments, facts in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import company_norm
from spanlake.operators import facts_in_text as A
from spanlake.operators import funnel
from spanlake.operators import identity as I
from spanlake.plans.registry import query
from spanlake.plans.standins import LINES, lines
from spanlake.sources.hits import press_release_url

S = F.concat


@query(
    "e1_preamble",
    """SELECT doc_id, upper(source[1]) || substring(source, 2) || ' Systems, Inc.' AS company, 'Big ' || upper(lang) || ' Holdings Corp.' AS parent,
              make_date(CAST(2000 + doc_id % 25 AS BIGINT), CAST(doc_id % 12 + 1 AS BIGINT), CAST(doc_id % 28 + 1 AS BIGINT)) AS signed,
              lang IN ('fr', 'de') AS amendment, lang = 'de' AS restated FROM documents""",
)
def preamble(t):
    """Documents opened as agreements, amendments and restatements; parties, date and flags read back."""
    months = F.array(*[F.lit(m) for m in I.MONTHS])
    opening = S(
        F.when(F.col("lang") == "fr", "FIRST AMENDMENT\n").when(F.col("lang") == "de", "AMENDED AND RESTATED ").otherwise(""),
        F.lit("AGREEMENT AND PLAN OF MERGER, dated as of "), F.get(months, (F.col("doc_id") % 12).cast("int")), F.lit(" "),
        (F.col("doc_id") % 28 + 1).cast("string"), F.lit(", "), (2000 + F.col("doc_id") % 25).cast("string"),
        F.lit(", by and among "), F.initcap("source"), F.lit(" Systems, Inc., a Delaware corporation (the “Company”), and Big "),
        F.upper("lang"), F.lit(" Holdings Corp., a Nevada corporation (“Parent”). "),
    )
    docs = t.documents.select("doc_id", S(opening, "text").alias("text"))
    return I.preamble(docs).drop("text")


@query(
    "e2_company_norm",
    r"""SELECT passage_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(body || ' & Co. Holdings, Inc.'), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'),
         '\b(?:incorporated|inc|corporation|corp|company|co|ltd|limited|llc|plc|nv|holdings|holding|group|the)\b', ' ', 'g'), ' +', ' ', 'g')) AS name
       FROM (WITH """ + LINES + " SELECT * FROM lines)",
)
def norm(t):
    return lines(t).select("passage_id", company_norm(S("body", F.lit(" & Co. Holdings, Inc."))).alias("name"))


@query(
    "e3_tech_codes",
    """SELECT o_orderkey, (o_custkey + 3000) BETWEEN 3570 AND 3579 OR (o_custkey + 3000) BETWEEN 3661 AND 3679
         OR (o_custkey + 3000) BETWEEN 7370 AND 7379 OR CAST(floor(o_totalprice / 100) AS BIGINT) BETWEEN 3570 AND 3579
         OR CAST(floor(o_totalprice / 100) AS BIGINT) BETWEEN 3661 AND 3679 OR CAST(floor(o_totalprice / 100) AS BIGINT) BETWEEN 7370 AND 7379 AS tech FROM orders""",
)
def tech(t):
    sics = F.array(
        (F.col("o_custkey") + 3000).cast("string"), S(F.lit(" "), F.floor(F.col("o_totalprice") / 100).cast("string")),
        F.col("o_orderstatus"),
    )
    return t.orders.select("o_orderkey", I.any_tech(sics).alias("tech"))


@query(
    "e4_resolve_filer",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN CAST(c_custkey AS VARCHAR) END AS cik FROM customer""",
)
def resolve(t):
    """Filers by segment: a unique equal name, a unique prefix, two equal names, lists that disagree, no match."""
    c, seg = t.customer, F.col("c_mktsegment")
    company = F.when(seg == "AUTOMOBILE", S("c_name", F.lit(" Software Works, Inc."))).when(
        seg == "HOUSEHOLD", F.lit("Somebody Else LLC")
    ).otherwise(S("c_name", F.lit(" Holdings")))
    key = F.col("c_custkey").cast("string")
    twin = F.when(seg == "MACHINERY", S(F.upper("c_name"), F.lit(" CORP /DE/ (CIK 2)"))).otherwise(F.lit("Other Person Co"))
    names = F.array(S("c_name", F.lit(" (TICK) (CIK 1)")), twin)
    ciks = F.when(seg == "FURNITURE", F.array(key)).otherwise(F.array(key, S(key, F.lit("9"))))
    return c.select("c_custkey", I.resolve_filer(company, ciks, names).alias("cik"))


@query(
    "e5_filer_codes",
    """SELECT o_orderkey AS adsh, CASE WHEN o_orderstatus <> 'P' THEN '7371,1' ELSE
              coalesce((SELECT string_agg(s, ',' ORDER BY i) FROM (
                 SELECT 0 AS i, coalesce(CASE WHEN a.c_acctbal >= 0 THEN CAST(3000 + a.c_custkey AS VARCHAR) END, '') AS s WHERE a.c_custkey IS NOT NULL
                 UNION ALL SELECT 1, coalesce(CASE WHEN b.c_acctbal >= 0 THEN CAST(3000 + b.c_custkey AS VARCHAR) END, '') WHERE b.c_custkey IS NOT NULL)), '') END AS sics
       FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey + 1""",
)
def codes(t):
    own = F.array(F.lit("7371"), F.lit("1"))
    filings = t.orders.select(
        F.col("o_orderkey").alias("adsh"), F.array("o_custkey", F.col("o_custkey") + 1).alias("ciks"),
        F.when(F.col("o_orderstatus") != "P", own).otherwise(F.array().cast("array<string>")).alias("sics"),
    )
    registrants = t.customer.select(
        F.col("c_custkey").alias("cik"), F.when(F.col("c_acctbal") >= 0, (3000 + F.col("c_custkey")).cast("string")).alias("sic")
    )
    return I.filer_codes(filings, registrants).select("adsh", F.array_join("sics", ",").alias("sics"))


def filings(t):
    """Orders as agreement documents: one deal per customer, priority class and year; half of the rest amend it."""
    cik = F.when(F.col("o_totalprice") > 250000, F.col("o_custkey")).when(F.col("o_totalprice") > 150000, F.col("o_custkey") + 1)
    return t.orders.select(
        S(F.lit("d-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("adsh"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"),
        S(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(", Inc.")).alias("company"),
        S(F.lit("Buyer & "), F.substring("o_orderpriority", 1, 1), F.lit(" Corp")).alias("parent"),
        F.when(F.col("o_totalprice") > 60000, F.date_format("o_orderdate", "yyyy")).alias("signed"),
        (F.col("o_orderstatus") == "P").alias("amendment"),
        (F.col("o_totalprice") < 200000).alias("restated"),
        cik.alias("target_cik"),
        F.when(F.col("o_orderstatus") == "F", "VOTING AGREEMENT AND PLAN OF MERGER").otherwise("AGREEMENT AND PLAN OF MERGER").alias("text"),
    )


def registrants(t):
    return t.customer.select(
        F.col("c_custkey").alias("cik"), F.when(F.col("c_acctbal") > 2000, "7372").otherwise("2000").alias("sic")
    )


DEALS = """
    fl AS (SELECT 'd-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS adsh, strftime(o_orderdate, '%Y-%m-%d') AS file_date,
                  'customer ' || CAST(o_custkey AS VARCHAR) AS target, 'buyer and ' || substring(o_orderpriority, 1, 1) AS acquirer,
                  CASE WHEN o_totalprice > 60000 THEN strftime(o_orderdate, '%Y') END AS signed, o_orderstatus = 'P' AS amendment,
                  o_totalprice < 200000 AS restated, CASE WHEN o_totalprice > 250000 THEN o_custkey WHEN o_totalprice > 150000 THEN o_custkey + 1 END AS target_cik,
                  o_orderstatus <> 'F' AS is_merger FROM orders),
    orig AS (SELECT * FROM fl WHERE signed IS NOT NULL AND NOT amendment),
    orph AS (SELECT * FROM fl WHERE signed IS NOT NULL AND amendment AND restated
             AND (target, acquirer) NOT IN (SELECT (target, acquirer) FROM orig)),
    mem AS (SELECT *, false AS orphan FROM orig UNION ALL SELECT *, true FROM orph),
    am AS (SELECT target, acquirer, count(*) AS amendments FROM fl WHERE amendment AND adsh NOT IN (SELECT adsh FROM orph) GROUP BY ALL),
    d0 AS (SELECT target, acquirer, signed, first(adsh ORDER BY file_date, adsh) AS canonical, min(file_date) AS file_date, count(*) AS copies,
                  first(target_cik ORDER BY adsh) FILTER (WHERE target_cik IS NOT NULL) AS target_cik,
                  count(DISTINCT target_cik) > 1 AS target_conflict, bool_or(orphan) AS orphan_restated FROM mem GROUP BY ALL),
    deals AS (SELECT d0.*, coalesce(amendments, 0) AS amendments, CASE WHEN c_acctbal > 2000 THEN '7372' WHEN c_custkey IS NOT NULL THEN '2000' END AS target_sic,
                     coalesce(c_acctbal > 2000, false) AS tech
              FROM d0 LEFT JOIN am USING (target, acquirer) LEFT JOIN customer ON c_custkey = target_cik)
"""


@query(
    "e6_group_deals",
    f"""WITH {DEALS} SELECT target, acquirer, signed, target_cik, target_sic, tech, copies, target_conflict, orphan_restated, amendments, canonical, file_date FROM deals""",
)
def deals(t):
    return I.group_deals(filings(t), registrants(t))


@query("e7_orphan_restated", f"WITH {DEALS} SELECT target, acquirer, signed, copies, canonical FROM deals WHERE orphan_restated")
def orphans(t):
    return I.group_deals(filings(t), registrants(t)).where("orphan_restated").select(
        "target", "acquirer", "signed", "copies", "canonical"
    )


SPLIT = "CASE WHEN CAST('0x' || substring(sha1({0}), 1, 2) AS INTEGER) % 10 < 3 THEN 'tune' ELSE 'report' END"


@query(
    "e8_corpus",
    f"""WITH {DEALS},
    al AS (SELECT target, acquirer, count(*) AS n, string_agg('edgar_' || replace(adsh, '-', ''), ',' ORDER BY file_date, adsh) AS ids FROM fl WHERE amendment GROUP BY ALL)
    SELECT 'edgar_' || replace(canonical, '-', '') AS contract_id, target, acquirer, target_cik, signed, coalesce(n, 0) AS n_amendments,
           coalesce(ids, '') AS amendment_ids, {SPLIT.format("'edgar_' || replace(canonical, '-', '')")} AS split
    FROM deals JOIN (SELECT adsh, is_merger FROM fl) ON adsh = canonical LEFT JOIN al USING (target, acquirer)
    WHERE tech AND signed >= '1996' AND is_merger""",
)
def corpus(t):
    docs = filings(t)
    return I.assemble_corpus(I.group_deals(docs, registrants(t)), docs, "1996")[0]


@query(
    "e8_corpus_counts",
    f"""WITH {DEALS} SELECT count(*) AS deals, count(*) FILTER (WHERE is_merger) AS kept, count(*) FILTER (WHERE NOT is_merger) AS excluded_not_merger
    FROM deals JOIN (SELECT adsh, is_merger FROM fl) ON adsh = canonical WHERE tech AND signed >= '1996'""",
)
def corpus_counts(t):
    docs = filings(t)
    return I.assemble_corpus(I.group_deals(docs, registrants(t)), docs, "1996")[1]


def filed_agreements(t):
    key = F.col("c_custkey").cast("string")
    names = F.array(
        S("c_name", F.lit(" INC /DE/ (AB"), key, F.lit(") (CIK 00"), key, F.lit(")")), S("c_mktsegment", F.lit(" GROUP"))
    )
    target = S(F.lit("Customer "), key, F.lit(" Corp"))
    return t.customer.select(
        F.col("c_custkey").alias("contract_id"), I.aliases(target, names).alias("aliases"), target.alias("target"),
        S(F.lit("The Nation "), F.col("c_nationkey").cast("string"), F.lit(" Holdings")).alias("parent"),
    )


ALIASES = """
    fa AS (SELECT c_custkey AS contract_id, list_filter(['customer ' || c_custkey, 'customer ' || substring(c_name, 10), 'ab' || c_custkey, lower(c_mktsegment)],
                  lambda a: length(a) >= 4) AS aliases, 'nation ' || c_nationkey AS parent FROM customer)
"""


@query("e9_aliases", f"WITH {ALIASES} SELECT contract_id, array_to_string(aliases, '|') AS aliases FROM fa")
def alias_lists(t):
    return filed_agreements(t).select("contract_id", F.array_join("aliases", "|").alias("aliases"))


@query(
    "e10_alias_dimension",
    f"""WITH {ALIASES}
    SELECT DISTINCT unnest(aliases) AS alias, contract_id, 'target' AS kind FROM fa UNION SELECT parent, contract_id, 'parent' FROM fa
    UNION SELECT 'supplier ' || substring(s_name, 10), -s_suppkey - 1, 'target' FROM supplier
    UNION SELECT 'nation ' || s_nationkey, -s_suppkey - 1, 'parent' FROM supplier""",
)
def alias_dimension(t):
    labelled = t.supplier.select(
        (-F.col("s_suppkey") - 1).alias("contract_id"), F.col("s_name").alias("company"),
        S(F.lit("Nation "), F.col("s_nationkey").cast("string"), F.lit(", Inc.")).alias("parent"),
    )
    return I.alias_dimension(filed_agreements(t), labelled)


@query(
    "e11_cross_source_duplicates",
    """SELECT s_suppkey AS labelled_id, filed_id FROM supplier JOIN (
         SELECT c_nationkey, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'poor' END AS p, min(c_custkey) AS filed_id FROM customer GROUP BY ALL)
       ON c_nationkey = s_nationkey AND p = CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'poor' END""",
)
def duplicates(t):
    def side(df, prefix, key, balance):
        return df.select(
            F.col(key).alias("contract_id"),
            S(F.lit("The Nation "), F.col(f"{prefix}_nationkey").cast("string"), F.lit(" Co.")).alias("target"),
            F.when(F.col(balance) > 5000, "Rich Corp").otherwise("POOR, Inc.").alias("parent"),
        )

    filed = side(t.customer, "c", "c_custkey", "c_acctbal")
    labelled = side(t.supplier, "s", "s_suppkey", "s_acctbal").withColumnRenamed("target", "company")
    return I.cross_source_duplicates(filed, labelled)


def amending_documents(t):
    """Documents as amendments: every line replaces a numbered section."""
    ln = F.split("text", "\n")
    body = F.array_join(
        F.transform(
            ln,
            lambda x, i: S(
                F.lit("Section "), F.floor(i / 9 + 1).cast("string"), F.lit("."), (i % 9 + 1).cast("string"),
                F.lit("(a) of the Merger Agreement is hereby amended to read: "), x,
            ),
        ),
        "\n",
    )
    head = F.when(F.col("lang") == "en", "AMENDMENT NO. 7\n").when(F.col("lang") == "fr", "Second Amendment\n").otherwise("")
    return t.documents.select("doc_id", "lang", S(head, body).alias("text"))


AMENDING = """
    am0 AS (SELECT doc_id, lang, ordinal AS i, CAST(ordinal // 9 + 1 AS VARCHAR) || '.' || CAST(ordinal % 9 + 1 AS VARCHAR) AS section_id,
                   'Section ' || CAST(ordinal // 9 + 1 AS VARCHAR) || '.' || CAST(ordinal % 9 + 1 AS VARCHAR) || '(a) of the Merger Agreement is hereby amended to read: ' || body AS t,
                   CASE lang WHEN 'en' THEN 16 WHEN 'fr' THEN 17 ELSE 0 END AS h FROM lines),
    am1 AS (SELECT *, CAST(h + coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM am0),
    am2 AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY i), start + length(t)) AS nxt FROM am1)
"""


@query("e12_amended_sections", f"""WITH {LINES}, {AMENDING} SELECT doc_id, section_id, start, least(nxt, start + 4000) AS "end" FROM am2""")
def amended(t):
    return A.amended_sections(amending_documents(t))


@query("e12_amendment_number", "SELECT doc_id, CASE lang WHEN 'en' THEN 7 WHEN 'fr' THEN 2 ELSE doc_id END AS amendment_no FROM documents")
def number(t):
    return amending_documents(t).select("doc_id", A.amendment_number(F.col("text"), F.col("doc_id")).alias("amendment_no"))


@query(
    "e13_superseded",
    f"""WITH {LINES}, {AMENDING} SELECT l.passage_id, 'a' || am2.doc_id AS amendment_id, am2.section_id, am2.start AS amend_start, least(nxt, am2.start + 4000) AS amend_end
    FROM am2 JOIN labels USING (doc_id) JOIN lines l ON l.doc_id = am2.doc_id
      AND CAST(l.ordinal // 9 + 1 AS VARCHAR) || '.' || CAST(l.ordinal % 9 + 1 AS VARCHAR) = am2.section_id""",
)
def superseded(t):
    """Lines of every labelled document whose section its amendment replaces."""
    number = S(F.floor(F.col("ordinal") / 9 + 1).cast("string"), F.lit("."), (F.col("ordinal") % 9 + 1).cast("string"))
    p = lines(t).select(F.col("doc_id").alias("contract_id"), "passage_id", number.alias("section_id"), F.lit("section").alias("kind"))
    amends = A.amended_sections(amending_documents(t).join(t.labels.select("doc_id"), "doc_id")).select(
        F.col("doc_id").alias("contract_id"), "section_id", "start", "end", S(F.lit("a"), F.col("doc_id").cast("string")).alias("amendment_id")
    )
    return A.superseded(p, amends).select("passage_id", "amendment_id", "section_id", "amend_start", "amend_end")


@query(
    "e14_schedule_tags",
    f"""WITH {LINES} SELECT passage_id, 'schedule_ref' AS tag FROM lines WHERE contains(body, ' with ')""",
)
def tags(t):
    body = F.replace("body", F.lit(" with "), F.lit(" set forth\nin Schedule 4 "))
    return A.schedule_tags(lines(t).select("passage_id", F.lit("front").alias("kind"), body.alias("body")))


FAMILIES = {
    "about_with": r"(?i)(?:^|[^\p{L}])with(?:[^\p{L}]|$)",
    "about_les": r"(?i)(?:^|[^\p{L}])les(?:[^\p{L}]|$)",
    "about_numbers": r"[0-9]{3}",
}


@query(
    "e15_hint_blocks",
    f"""WITH {LINES}, hit AS (
      SELECT doc_id, ordinal, body, 'about_with' AS family FROM lines WHERE regexp_matches(body, '(?i)(?:^|[^\\p{{L}}])with(?:[^\\p{{L}}]|$)')
      UNION ALL SELECT doc_id, ordinal, body, 'about_les' FROM lines WHERE regexp_matches(body, '(?i)(?:^|[^\\p{{L}}])les(?:[^\\p{{L}}]|$)')
      UNION ALL SELECT doc_id, ordinal, body, 'about_numbers' FROM lines WHERE regexp_matches(body, '[0-9]{{3}}')),
    r AS (SELECT *, row_number() OVER w AS rn, 2000 - coalesce(sum(length(body) + 7) OVER (PARTITION BY doc_id, family ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
                 count(*) OVER (PARTITION BY doc_id, family) AS n FROM hit WINDOW w AS (PARTITION BY doc_id, family ORDER BY ordinal))
    SELECT doc_id, family, any_value(n) AS n_passages, md5(string_agg(substring(body, 1, CAST(room AS BIGINT)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) FILTER (WHERE room > 0)) AS block_md5,
           bool_or(length(body) > room) OR any_value(n) > 12 AS truncated FROM r WHERE rn <= 12 GROUP BY doc_id, family""",
)
def hints(t):
    return A.hint_blocks(lines(t), FAMILIES, 2000).select(
        "doc_id", "family", "n_passages", F.md5("block").alias("block_md5"), "truncated"
    )


def fee_text():
    return S(
        F.lit("A termination fee equal to $"), F.floor(F.col("o_totalprice") / 10000).cast("string"), F.lit(".5 million; the Termination\nFee of $"),
        F.col("o_custkey").cast("string"), F.lit(",250 shall be paid; a fee of $9 billion; termination fee, if any, of $ 2 bn"),
    )


@query(
    "e16_fee_amounts",
    """SELECT o_orderkey, v AS fee FROM (SELECT DISTINCT o_orderkey, unnest([(CAST(floor(o_totalprice / 10000) AS BIGINT) * 10 + 5) * 100000.0,
         o_custkey * 1000.0 + 250, 2e9]) AS v FROM orders) WHERE v >= 100000""",
)
def fees(t):
    return t.orders.select("o_orderkey", F.explode(A.fee_amounts(fee_text())).alias("fee"))


@query(
    "e17_restated_amounts",
    """SELECT o_orderkey, CAST(floor(o_totalprice * 1.003) AS DOUBLE) AS matched_amount FROM orders WHERE o_orderstatus <> 'P'""",
)
def restated(t):
    """Releases that repeat the order's price within half a percent, except those of pending orders."""
    shown = F.when(F.col("o_orderstatus") == "P", F.floor(F.col("o_totalprice") * 1.03)).otherwise(F.floor(F.col("o_totalprice") * 1.003))
    text = S(F.lit("Cash of $1.5 per share.  The fee is\n$"), shown.cast("string"), F.lit(" in cash, or $"), shown.cast("string"), F.lit(" later."))
    releases = t.orders.select("o_orderkey", text.alias("text"))
    known = t.orders.select("o_orderkey", F.col("o_totalprice").alias("fee"))
    return A.restated_amounts(releases, known, "o_orderkey").select("o_orderkey", "matched_amount")


@query(
    "e18_press_release_link",
    """SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'https://www.sec.gov/p/' || page_id ELSE 'https://www.sec.gov/f/' || page_id || '.htm' END AS url FROM pages""",
)
def link(t):
    """An index table in front of every page: secure sites list a first exhibit after the second."""
    key = F.col("page_id").cast("string")
    index = S(
        F.lit('<TABLE><tr class="r"><td> EX-2.1 </td><td><a href="'), "url", F.lit('">a</a></td></tr><tr><td>EX-99.2</td>\n<td><a href="/ix?doc=/f/'),
        key, F.lit('.htm">b</a></td></tr>'),
        F.when(F.startswith("url", F.lit("https")), S(F.lit('<tr><td> EX-99.1 </td><td><a href="/p/'), key, F.lit('">c</a></td></tr>'))).otherwise(""),
        F.lit("</TABLE>"), "html",
    )
    return t.pages.select("page_id", press_release_url(index).alias("url"))


@query(
    "e19_filing_funnel",
    """SELECT count(*) AS search_docs, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS ex21_docs, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS ex2_bare_docs,
         count(*) FILTER (WHERE m) AS missing, count(*) FILTER (WHERE NOT m) AS fetched, count(*) FILTER (WHERE NOT m AND o_orderstatus = 'F') AS not_merger,
         count(*) FILTER (WHERE NOT m AND o_totalprice > 60000) AS keyed, count(*) FILTER (WHERE NOT m AND o_custkey > 100) AS company_parsed,
         count(*) FILTER (WHERE NOT m AND o_orderstatus = 'P') AS amendment_docs, round(count(*) FILTER (WHERE NOT m AND o_custkey > 100) / count(*) FILTER (WHERE NOT m), 4) AS company_parsed_rate
       FROM (SELECT *, o_totalprice < 20000 AS m FROM orders)""",
)
def filing_funnel(t):
    rows = t.orders.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", " ex-2.01").when(F.col("o_orderpriority") == "2-HIGH", "EX-2 ").otherwise("EX-10").alias("file_type"),
        (F.col("o_totalprice") < 20000).alias("missing"), (F.col("o_orderstatus") == "F").alias("not_merger"),
        (F.col("o_totalprice") > 60000).alias("key_ok"), F.when(F.col("o_custkey") > 100, "x").alias("company"),
        (F.col("o_orderstatus") == "P").alias("amendment"),
    )
    return funnel.filing_funnel(rows)


DEAL_FUNNEL = f"""{DEALS}, g AS (SELECT *, tech AND signed >= '1996' AS gate FROM deals),
    df AS (SELECT count(*) AS deals, count(*) FILTER (WHERE orphan_restated) AS orphan_restated, count(target_cik) AS deals_resolved, count(*) FILTER (WHERE gate) AS tech_deals,
      count(DISTINCT CASE WHEN gate THEN target_cik END) AS tech_targets, count(*) FILTER (WHERE gate AND copies > 1) AS tech_multi_copy,
      count(*) FILTER (WHERE gate AND amendments > 0) AS tech_amended, round(count(target_cik) / count(*), 4) AS target_resolved_rate,
      round(count(*) FILTER (WHERE gate AND copies > 1) / count(*) FILTER (WHERE gate), 4) AS duplicate_rate,
      round(count(*) FILTER (WHERE gate AND amendments > 0) / count(*) FILTER (WHERE gate), 4) AS amendment_rate FROM g)"""


@query("e19_deal_funnel", f"WITH {DEAL_FUNNEL} SELECT * FROM df")
def deal_funnel(t):
    return funnel.deal_funnel(I.group_deals(filings(t), registrants(t)), "1996")


@query(
    "e19_gate_verdict",
    f"""WITH {DEAL_FUNNEL}, sh AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS p, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
    SELECT tech_deals >= 100 AS count_ok, bool_and(p / n >= 0.5) AS families_ok, tech_deals >= 100 AND bool_and(p / n >= 0.5) AS gate_pass FROM sh, df GROUP BY tech_deals""",
)
def gate(t):
    sample = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("family"), (F.col("quality") == 1).alias("present"))
    deals_row = funnel.deal_funnel(I.group_deals(filings(t), registrants(t)), "1996")
    return funnel.gate_verdict(funnel.family_shares(sample), deals_row)


@query(
    "e19_family_shares",
    """SELECT lang AS family, count(*) FILTER (WHERE quality = 1) AS present, count(*) AS n, round(count(*) FILTER (WHERE quality = 1) / count(*), 4) AS share
       FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def shares(t):
    return funnel.family_shares(
        t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("family"), (F.col("quality") == 1).alias("present"))
    )


def order_windows(t):
    span = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    w = span.select(F.explode(I.month_windows(F.col("a"), F.col("b"))).alias("w")).select("w.start", "w.end")
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    calendar = span.select(F.explode(F.sequence(F.date_add("a", -1), F.col("b"))).alias("day"))
    return w, calendar.join(daily, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


WINDOWS = """
    sp AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
    mw AS (SELECT greatest(CAST(m AS DATE), a) AS s, least(last_day(CAST(m AS DATE)), b) AS e
           FROM sp, LATERAL (SELECT unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m))
"""


@query("e20_month_windows", f"""WITH {WINDOWS} SELECT s AS start, e AS "end", count(*) AS n FROM mw JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN s AND e GROUP BY ALL""")
def windows(t):
    w, daily = order_windows(t)
    return I.split_windows(daily, w, 1 << 60).select("start", "end", "n")


@query(
    "e20_split_windows",
    f"""WITH RECURSIVE {WINDOWS}, day AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
    w AS (SELECT s, e, (SELECT coalesce(sum(n), 0) FROM day WHERE d BETWEEN s AND e) AS n FROM mw
          UNION ALL
          SELECT s2, e2, (SELECT coalesce(sum(day.n), 0) FROM day WHERE d BETWEEN s2 AND e2)
          FROM (SELECT unnest([s, s + CAST(floor((e - s) / 2) AS INTEGER) + 1]) AS s2, unnest([s + CAST(floor((e - s) / 2) AS INTEGER), e]) AS e2
                FROM w WHERE n >= 60 AND s < e))
    SELECT s AS start, e AS "end", CAST(n AS BIGINT) AS n, n >= 60 AS still_over FROM w WHERE NOT (n >= 60 AND s < e)""",
)
def split(t):
    """Month windows of orders halved until each holds fewer than sixty."""
    w, daily = order_windows(t)
    return I.split_windows(daily, w, 60)
