"""Registered queries: text cleaning and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import text as X
from spanlake.functions.markup import page_texts, unwrap_submission
from spanlake.operators.cleaning import clean_filing, drop_running_lines, first_by_hash
from spanlake.plans.registry import query

# The white-space class in RE2 spelling.
WS_SQL = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


@query("t1_html_text")
def html_text(t):
    """Every page's visible text."""
    out = page_texts(t.pages, "page_id", "html", F.lit("page.htm"))
    return out.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    "t2_submission_unwrap",
    r"""SELECT page_id, CAST(length(html) AS INTEGER) AS n_chars, md5(html) AS text_md5 FROM pages""",
)
def submission(t):
    """Pages as Latin bytes inside a submission wrapper: decoded by the fallback and unwrapped."""
    body = F.concat(F.lit("<DOCUMENT>\n<TYPE>EX-2.1\n<TEXT>"), "html", F.lit("</TEXT>\n</DOCUMENT>"))
    raw = t.pages.select("page_id", F.encode(body, "ISO-8859-1").alias("content"))
    text = unwrap_submission(X.decode_filing(F.col("content")), F.lit("full.txt"))
    return raw.select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


@query(
    "t3_page_lines",
    r"""WITH r AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10) || chr(10) || '  - 12 -  ' || chr(10)
                   || 'Page 3 of 9' || chr(10)) || chr(10) || '7' || chr(10) AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t\x{A0}]+', ' ', 'g'), '(?m)^ | $', '', 'g') || chr(10) AS t FROM r),
    b AS (SELECT doc_id, regexp_replace(t, '(?m)^[ \t]*(?:-\s*\d{1,3}\s*-|\d{1,3}|Page\s+\d{1,3}(?:\s+of\s+\d{1,3})?)[ \t]*\n', '', 'g') AS t FROM a)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') || chr(10)) AS text_md5 FROM b""",
)
def page_lines(t):
    """Documents with page numbers between their lines, cleaned again."""
    noisy = F.concat(
        F.replace("text", F.lit("\n"), F.lit("\n\n\n  - 12 -  \nPage 3 of 9\n")), F.lit("\n7\n")
    )
    return t.documents.select("doc_id", F.md5(X.strip_page_lines(noisy)).alias("text_md5"))


@query(
    "t4_rejoin_headings",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(t, '[\x{a0}\x{1680}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}]', ' ', 'g'),
              '(?m)^([ \t]*(?:(?:Section|SECTION)[ \t]+)?\d{1,2}\.\d{1,2}\.?)[ \t]*\n+[ \t]*([A-Z])', '\1 \2', 'g')) AS text_md5
    FROM (SELECT doc_id, replace(replace(text, chr(10), chr(10) || 'Section 4.2' || chr(10) || chr(10) || ' '), ' ', chr(160)) AS t FROM documents)""",
)
def headings(t):
    """Documents whose section numbers stand on their own line, with no-break spaces."""
    split_up = F.translate(F.replace("text", F.lit("\n"), F.lit("\nSection 4.2\n\n ")), " ", " ")
    return t.documents.select("doc_id", F.md5(X.rejoin_headings(split_up)).alias("text_md5"))


RUNNING_SQL = r"""
    raw AS (SELECT doc_id, replace(text, chr(10), chr(10) || ' Confidential Draft ' || chr(10) || 'Section 1' || chr(10)) AS text FROM documents),
    ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM raw),
    st AS (SELECT *, trim(line) AS s FROM ln),
    ct AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM st)
"""


@query(
    "t5_running_lines",
    f"""WITH {RUNNING_SQL}
    SELECT doc_id, CAST(count(*) FILTER (WHERE NOT dropped) AS INTEGER) AS lines_kept,
           md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS text_md5
    FROM (SELECT *, n >= 8 AND length(s) BETWEEN 4 AND 79
                 AND NOT regexp_matches(s, '(?i)^(?:(?:section|article)\\b|\\(?[a-z0-9]{{1,4}}\\))') AS dropped FROM ct)
    GROUP BY doc_id""",
)
def running_lines(t):
    """Documents with a running header and a section line after every line."""
    noisy = F.replace("text", F.lit("\n"), F.lit("\n Confidential Draft \nSection 1\n"))
    out = drop_running_lines(t.documents.select("doc_id", noisy.alias("text")))
    return out.select("doc_id", F.size(F.split("text", "\n")).alias("lines_kept"), F.md5("text").alias("text_md5"))


@query(
    "t5_clean_filing",
    f"""WITH {RUNNING_SQL}
    SELECT doc_id, md5(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), ''),
                       '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5
    FROM (SELECT *, n >= 8 AND length(s) BETWEEN 4 AND 79
                 AND NOT regexp_matches(s, '(?i)^(?:(?:section|article)\\b|\\(?[a-z0-9]{{1,4}}\\))') AS dropped FROM ct)
    GROUP BY doc_id""",
)
def whole_clean(t):
    noisy = F.replace("text", F.lit("\n"), F.lit("\n Confidential Draft \nSection 1\n"))
    return clean_filing(t.documents.select("doc_id", noisy.alias("text"))).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "t6_normal_form",
    rf"""SELECT doc_id, md5(trim(regexp_replace(translate(t, '“”‘’–—', '""''''--'), '{WS_SQL}+', ' ', 'g'))) AS text_md5
    FROM (SELECT doc_id, '“' || replace(text, ' ', ' ‘ ') || '—' || chr(8239) || '  ’' AS t FROM documents)""",
)
def normal(t):
    raw = F.concat(F.lit("“"), F.replace("text", F.lit(" "), F.lit(" ‘ ")), F.lit("—   ’"))
    return t.documents.select("doc_id", F.md5(X.normal_form(raw)).alias("text_md5"))


@query(
    "t7_squash",
    rf"""SELECT doc_id, CAST(length(s) AS INTEGER) AS n_chars, md5(s) AS text_md5
    FROM (SELECT doc_id, regexp_replace(text, '{WS_SQL}+', '', 'g') AS s FROM documents)""",
)
def squashed(t):
    s = X.squash(F.col("text"))
    return t.documents.select("doc_id", F.length(s).alias("n_chars"), F.md5(s).alias("text_md5"))


@query(
    "t8_own_title",
    r"""WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'EXHIBIT 2.1' || chr(10) || chr(10) || 'EXHIBIT 2.1  AGREEMENT AND  PLAN OF MERGER' || chr(10)
                                        WHEN 'fr' THEN 'VOTING AGREEMENT AND PLAN OF MERGER' || chr(10)
                                        ELSE '' END || text AS t FROM documents),
    a AS (SELECT doc_id, coalesce(list_filter(string_split(substring(t, 1, 3000), chr(10)),
                 lambda l: length(l) < 160 AND regexp_matches(l, '\b(?:AGREEMENT|PLAN)\b'))[1], substring(t, 1, 200)) AS l FROM r),
    b AS (SELECT doc_id, lower(trim(regexp_replace(l, '\s+', ' ', 'g'))) AS title FROM a),
    c AS (SELECT doc_id, title, regexp_replace(title, '^exhibit\s+[\d.]+\s*', '') AS s FROM b)
    SELECT doc_id, title,
           regexp_matches(s, 'agreement and plan of merger|plan and agreement of merger|agreement of merger|plan of merger|merger agreement')
           AND NOT regexp_matches(s, '^(termination|voting|support|tender|letter)') AS is_merger FROM c""",
)
def title(t):
    lead = (
        F.when(F.col("lang") == "en", "EXHIBIT 2.1\n\nEXHIBIT 2.1  AGREEMENT AND  PLAN OF MERGER\n")
        .when(F.col("lang") == "fr", "VOTING AGREEMENT AND PLAN OF MERGER\n")
        .otherwise("")
    )
    docs = t.documents.select("doc_id", F.concat(lead, "text").alias("text"))
    return docs.select(
        "doc_id", X.own_title(F.col("text")).alias("title"), X.is_merger_agreement(F.col("text")).alias("is_merger")
    )


@query(
    "t9_query_tokens",
    """SELECT doc_id, CAST(len(l) AS INTEGER) AS n_tokens, md5(array_to_string(l, ' ')) AS tokens_md5 FROM (
         SELECT doc_id, list_filter(list_transform(list_sort(list(struct_pack(i := i, t := t))), lambda x: x.t), lambda x: length(x) > 1) AS l
         FROM (SELECT doc_id, t, min(i) AS i FROM (
                 SELECT doc_id, unnest(k) AS t, generate_subscripts(k, 1) AS i
                 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents))
               GROUP BY doc_id, t) GROUP BY doc_id)""",
)
def tokens(t):
    k = X.query_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(k).alias("n_tokens"), F.md5(F.array_join(k, " ")).alias("tokens_md5"))


@query(
    "t10_split_of",
    """SELECT l_orderkey, CASE WHEN CAST('0x' || substring(sha1(CAST(l_orderkey AS VARCHAR)), 1, 2) AS INTEGER) % 10 < 3
              THEN 'tune' ELSE 'report' END AS split, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def split(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).withColumn("split", X.split_of(F.col("l_orderkey")))


@query(
    "t11_stable_sample",
    """SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment
         ORDER BY sha1(CAST(c_custkey AS VARCHAR)), c_custkey) AS rn FROM customer) WHERE rn <= 30""",
)
def stable(t):
    return first_by_hash(t.customer, ["c_mktsegment"], "c_custkey", 30).select("c_mktsegment", "c_custkey")


@query(
    "t12_seeded_sample",
    """SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
         ORDER BY sha1('7|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders) WHERE rn <= 150""",
)
def seeded(t):
    return first_by_hash(t.orders, ["o_orderpriority"], "o_orderkey", 150, salt="7|").select("o_orderpriority", "o_orderkey")
