"""Registered queries: sources, sinks, ledgers, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.plans.registry import query
from spanlake.sources.corpus import canonicalise
from spanlake.sources.hits import flatten_hits, is_agreement_exhibit
from spanlake.sources.labels import clean_labels, contract_names, label_census
from spanlake.sources.ledger import (
    latest_per_key,
    parse_jsonl,
    pending,
    row_digest,
    shared_calls,
    table_fingerprint,
)
from spanlake.sources.publish import agreement_links, currency, missing_references


@query(
    "s1_corpus_scan",
    r"""
    SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
    FROM (SELECT doc_id, regexp_replace(regexp_replace(raw, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g') AS t
          FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN chr(65279) || replace(text, chr(10), chr(13) || chr(10))
                                    WHEN lang = 'fr' THEN replace(text, chr(10), chr(13)) ELSE text END AS raw
                FROM documents))
    """,
)
def corpus_scan(t):
    """Documents re-encoded with BOM, CRLF and CR line ends, scanned back to canonical text."""
    raw = (
        F.when(F.col("lang") == "en", F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n"))))
        .when(F.col("lang") == "fr", F.replace("text", F.lit("\n"), F.lit("\r")))
        .otherwise(F.col("text"))
    )
    docs = canonicalise(t.documents.select("doc_id", raw.alias("text")))
    return docs.select("doc_id", "n_chars", F.md5("text").alias("text_md5"))


def label_rows(t):
    """Label rows from documents and labels: one per labelled document, as two overlapping files."""
    rows = t.documents.join(t.labels, "doc_id").select(
        F.when(F.col("quality") == 1, "main").otherwise("abridged").alias("data_type"),
        F.when(F.col("toxic") == 1, "<RARE_ANSWERS>").otherwise(F.col("source")).alias("contract_name"),
        "text",
        F.col("quality").cast("string").alias("answer"),
        F.concat("lang", F.lit("-Answer (Y/N)")).alias("question"),
        F.lit("").alias("subquestion"),
        F.col("lang").alias("text_type"),
        F.col("lang").alias("category"),
    )
    return rows.unionByName(rows.where("data_type = 'main'"))


LABEL_ROWS_SQL = """
    lr0 AS (SELECT CASE WHEN quality = 1 THEN 'main' ELSE 'abridged' END AS data_type,
                   CASE WHEN toxic = 1 THEN '<RARE_ANSWERS>' ELSE source END AS contract_name, text,
                   CAST(quality AS VARCHAR) AS answer, lang || '-Answer (Y/N)' AS question, '' AS subquestion,
                   lang AS text_type, lang AS category
            FROM documents JOIN labels USING (doc_id)),
    label_rows AS (SELECT * FROM lr0 UNION ALL SELECT * FROM lr0 WHERE data_type = 'main')
"""


@query(
    "s2_label_scan",
    f"""WITH {LABEL_ROWS_SQL}
    SELECT DISTINCT contract_name AS contract_id, md5(text) AS text_md5, question, subquestion, answer, text_type,
           category
    FROM label_rows WHERE data_type = 'main' AND contract_name <> '<RARE_ANSWERS>'""",
)
def label_scan(t):
    rows = clean_labels(label_rows(t))
    return rows.withColumn("text_md5", F.md5("text")).drop("text")


@query(
    "s3_label_census",
    f"""WITH {LABEL_ROWS_SQL}
    SELECT count(*) AS rows, count(DISTINCT CASE WHEN contract_name <> '<RARE_ANSWERS>' THEN contract_name END) AS contracts,
           count(DISTINCT question) AS questions FROM label_rows""",
)
def census(t):
    return label_census(label_rows(t))


@query(
    "s3_contract_names",
    f"""WITH {LABEL_ROWS_SQL}
    SELECT DISTINCT contract_name FROM label_rows WHERE contract_name <> '<RARE_ANSWERS>'""",
)
def names(t):
    return contract_names(label_rows(t))


@query(
    "s4_jsonl_scan",
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
              max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def jsonl_scan(t):
    """Events as JSON lines; the lines of error events are torn and must be ignored; the last row per user wins."""
    body = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    torn = F.when(F.col("event_type") == "error", F.expr("left(body, length(body) - 3)")).otherwise(F.col("body"))
    lines = t.events.withColumn("body", body).select(torn.alias("line"))
    rows = parse_jsonl(lines, "event_id long, user_id long, event_type string, value double")
    return latest_per_key(rows, ["user_id"], ["event_id"])


HITS_SQL = """
    hits AS (SELECT 'acc-' || CAST(o_orderkey AS VARCHAR) AS adsh,
                    'f' || CAST(o_custkey AS VARCHAR) || '.htm' AS filename,
                    CASE o_orderpriority WHEN '1-URGENT' THEN ' ex-2.1 ' WHEN '2-HIGH' THEN 'EX-2.01'
                         ELSE 'EX-99.1' END AS file_type,
                    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS file_date, o_custkey, o_orderstatus
             FROM orders)
"""


def search_responses(t):
    """Orders as nested search responses, one response body per order status and date."""
    source = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("acc-"), F.col("o_orderkey").cast("string"))).alias("adsh"),
        F.when(F.col("o_orderpriority") == "1-URGENT", " ex-2.1 ")
        .when(F.col("o_orderpriority") == "2-HIGH", "EX-2.01")
        .otherwise("EX-99.1")
        .alias("file_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"),
        F.array(F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("ciks"),
    )
    hit = F.struct(
        F.concat(F.lit("acc-"), F.col("o_orderkey").cast("string"), F.lit(":f"), F.col("o_custkey").cast("string"),
                 F.lit(".htm")).alias("_id"),
        source.alias("_source"),
    )
    per_page = t.orders.groupBy("o_orderstatus", "o_orderdate").agg(F.collect_list(hit).alias("hits"))
    return per_page.select(F.to_json(F.struct(F.struct("hits").alias("hits"))).alias("body"))


@query(
    "s5_flatten_hits",
    f"""WITH {HITS_SQL}
    SELECT adsh, filename, file_type, file_date, CAST(0 AS INTEGER) AS n_sics,
           'https://www.sec.gov/Archives/edgar/data/' || CAST(o_custkey AS VARCHAR) || '/' || replace(adsh, '-', '')
             || '/' || filename AS doc_url,
           'https://www.sec.gov/Archives/edgar/data/' || CAST(o_custkey AS VARCHAR) || '/' || replace(adsh, '-', '')
             || '/' || adsh || '-index.htm' AS index_url
    FROM hits WHERE upper(trim(file_type)) IN ('EX-2.1', 'EX-2.01')""",
)
def flat_hits(t):
    rows = flatten_hits(search_responses(t)).where(is_agreement_exhibit(F.col("file_type")))
    return rows.select("adsh", "filename", "file_type", "file_date", F.size("sics").alias("n_sics"), "doc_url", "index_url")


@query(
    "s6_keyed_sink",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def keyed_sink(t):
    """One row per key, the last written kept, in key order: what the keyed sink writes."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    last = latest_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])
    return last.orderBy("l_orderkey", "l_linenumber")


@query(
    "s7_ledger_latest",
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(ts, event_id) AS ts,
              max(event_id) AS event_id FROM events GROUP BY user_id""",
)
def ledger_latest(t):
    return latest_per_key(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["event_id"])


PENDING_SQL = """
    recs AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'runner: timeout' WHEN quality = 0 THEN 'runner: refusal by model'
                                 END AS error FROM labels),
    done AS (SELECT doc_id FROM recs WHERE error IS NULL OR error NOT LIKE 'runner:%' OR error LIKE 'runner: refusal%'
                                           OR error LIKE 'runner: truncated%'),
    todo AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done))
"""


def pending_documents(t):
    error = F.when(F.col("toxic") == 1, "runner: timeout").when(F.col("quality") == 0, "runner: refusal by model")
    records = t.labels.select("doc_id", error.alias("error"))
    return pending(t.documents.select("doc_id", "text"), records, ["doc_id"])


@query("s8_pending_work", f"WITH {PENDING_SQL} SELECT doc_id FROM todo")
def pending_work(t):
    return pending_documents(t).select("doc_id")


@query(
    "s8_shared_calls",
    f"""WITH {PENDING_SQL}
    SELECT substring(sha1(text), 1, 12) AS call_key, count(*) AS n_results, min(doc_id) AS first_result
    FROM todo GROUP BY 1""",
)
def shared(t):
    jobs = pending_documents(t).select("doc_id", F.substring(F.sha1("text"), 1, 12).alias("call_key"))
    return shared_calls(jobs, "call_key", "doc_id")


def fingerprint_sql(name: str, rows: str) -> str:
    """Digest tree over `rows`, a SELECT of (k, v)."""
    return f"""
    SELECT '{name}' AS table_name, sha256(string_agg(d, '' ORDER BY d)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_rows
    FROM (SELECT substring(p, 1, 2) AS p2, sha256(string_agg(d, '' ORDER BY d)) AS d, sum(n) AS n
          FROM (SELECT substring(d, 1, 4) AS p, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n
                FROM (SELECT sha256(CAST(k AS VARCHAR) || '|' || sha256(v)) AS d FROM ({rows})) GROUP BY 1)
          GROUP BY 1)"""


@query("s9_table_fingerprint", fingerprint_sql("documents", "SELECT doc_id AS k, text AS v FROM documents"))
def fingerprint(t):
    return table_fingerprint(t.documents, "doc_id", "text", "documents")


@query(
    "s9_row_fingerprint",
    "SELECT doc_id, substring(sha256(CAST(doc_id AS VARCHAR) || '|' || sha256(text)), 1, 8) AS item_sha FROM documents",
)
def row_fingerprint(t):
    return t.documents.select("doc_id", F.substring(row_digest(F.col("doc_id"), F.col("text")), 1, 8).alias("item_sha"))


@query(
    "s10_publish_checks",
    """SELECT 'labelled documents have text' AS check_name, count(*) AS missing FROM
         (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 400))
       UNION ALL
       SELECT 'ordered parts exist', count(*) FROM
         (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10))""",
)
def publish_checks(t):
    """References from labels to long documents and from line items to large parts that are missing."""
    texts = t.documents.where("n_chars > 400").select("doc_id")
    parts = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return missing_references(
        [
            ("labelled documents have text", t.labels, texts, "doc_id"),
            ("ordered parts exist", t.lineitem, parts, "l_partkey"),
        ]
    )


@query(
    "s11_publish_currency",
    f"""WITH cur AS ({fingerprint_sql("documents", "SELECT doc_id AS k, text AS v FROM documents")}
        UNION ALL {fingerprint_sql("pages", "SELECT page_id AS k, html AS v FROM pages")}),
    man AS ({fingerprint_sql("documents", "SELECT doc_id AS k, text AS v FROM documents")}
        UNION ALL {fingerprint_sql("pages", "SELECT page_id AS k, lower(html) AS v FROM pages")})
    SELECT table_name, cur.n_rows AS n_rows, cur.fingerprint = man.fingerprint AS is_current
    FROM cur JOIN man USING (table_name)""",
)
def publish_currency(t):
    """Documents are unchanged since the manifest, pages were edited."""
    docs = table_fingerprint(t.documents, "doc_id", "text", "documents")
    current = docs.unionByName(table_fingerprint(t.pages, "page_id", "html", "pages"))
    edited = t.pages.withColumn("html", F.lower("html"))
    manifest = docs.unionByName(table_fingerprint(edited, "page_id", "html", "pages"))
    return currency(current, manifest)


@query(
    "s12_agreement_links",
    """SELECT c_custkey AS contract_id,
              CASE WHEN c_mktsegment = 'MACHINERY' THEN 'https://files.example/' || c_name
                   ELSE 'https://mirror.example/contracts/' || CAST(c_custkey AS VARCHAR) || '.txt' END AS filing,
              links, lower(coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, CAST(c_custkey AS VARCHAR))) AS sort_name
       FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || '=' || o_orderpriority, ';'
                                       ORDER BY o_orderkey) AS links FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def links(t):
    """Customers as agreements, their orders as numbered amendments."""
    deals = t.customer.select(
        F.col("c_custkey").alias("contract_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "edgar").otherwise("labels").alias("source"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("target"),
        F.concat(F.lit("https://files.example/"), "c_name").alias("url"),
    )
    amendments = t.orders.select(
        F.col("o_custkey").alias("contract_id"), F.col("o_orderkey").alias("amendment_no"), F.col("o_orderpriority").alias("url")
    )
    out = agreement_links(deals, amendments, "https://mirror.example")
    entries = F.transform(F.map_entries("amendments"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return out.select("contract_id", "filing", F.array_join(entries, ";").alias("links"), "sort_name")
