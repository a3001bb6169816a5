"""Registered queries: the given tables written by this library's writers and read back by its readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanlake.plans.registry import ORACLES, query
from spanlake.plans.sources_queries import fingerprint_sql, label_rows
from spanlake.session import shared_folder
from spanlake.sources.labels import CSV_SCHEMA, clean_labels, read_labels
from spanlake.sources.ledger import append_jsonl, latest_per_key, read_jsonl, table_fingerprint
from spanlake.sources.publish import missing_references, publish


def folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}-{name}"


@query("s2_label_files", ORACLES["s2_label_scan"])
def label_files(t):
    """The label rows as two CSV files, quotes and line breaks inside, scanned and cleaned."""
    rows = label_rows(t)
    columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string").alias(f.name) for f in CSV_SCHEMA]
    paths = [folder(t, "labels-main"), folder(t, "labels-other")]
    for path, kept in zip(paths, ("data_type = 'main'", "data_type <> 'main'"), strict=True):
        kept_rows = rows.select(*columns).where(kept)
        kept_rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return clean_labels(read_labels(t.spark, paths)).withColumn("text_md5", F.md5("text")).drop("text")


@query("s4_jsonl_files", ORACLES["s4_jsonl_scan"])
def jsonl_files(t):
    """Events as files of JSON lines, those of error events torn; the reader drops them and the last row per user wins."""
    body = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    torn = F.when(F.col("event_type") == "error", F.expr("left(body, length(body) - 3)")).otherwise(F.col("body"))
    path = folder(t, "events")
    t.events.withColumn("body", body).select(torn.alias("value")).write.text(path)
    return latest_per_key(read_jsonl(t.spark, path, "event_id long, user_id long, event_type string, value double"), ["user_id"], ["event_id"])


@query("s6_appended_sink", ORACLES["s6_keyed_sink"])
def appended_sink(t):
    """Line items appended to one sink in two overlapping batches; reading keeps the last row of a key."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    path = folder(t, "lineitem")
    append_jsonl(rows, path)
    append_jsonl(rows.where("l_linenumber % 2 = 0"), path)
    back = read_jsonl(t.spark, path, ", ".join(f"{n} {kind}" for n, kind in rows.dtypes))
    return latest_per_key(back, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])


@query(
    "s11_publish_twice",
    f"""WITH m AS ({fingerprint_sql("documents", "SELECT doc_id AS k, text AS v FROM documents")}
        UNION ALL {fingerprint_sql("pages", "SELECT page_id AS k, html AS v FROM pages")})
    SELECT table_name, fingerprint, n_rows, n_rows AS n_written, true AS first_written, false AS second_written FROM m""",
)
def publish_twice(t):
    """Documents and pages published with their checks and manifest; a second run finds them current and writes nothing."""
    root = folder(t, "published")
    current = table_fingerprint(t.documents, "doc_id", "text", "documents").unionByName(table_fingerprint(t.pages, "page_id", "html", "pages"))
    checks = missing_references([("labelled documents exist", t.labels, t.documents, "doc_id")])
    tables = {"documents": t.documents, "pages": t.pages}
    first = publish(tables, checks, current, current.limit(0), root)
    manifest = t.spark.read.parquet(f"{root}/manifest")
    second = publish(tables, checks, current, manifest, f"{root}-again")
    counts = [t.spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("n_written")).select(F.lit(n).alias("table_name"), "n_written") for n in tables]
    return manifest.join(counts[0].unionByName(counts[1]), "table_name").withColumns({"first_written": F.lit(first), "second_written": F.lit(second)})
