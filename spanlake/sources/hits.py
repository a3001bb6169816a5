"""Search-response flattening, filing URLs and link picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE_SCHEMA = (
    "hits struct<total: struct<value: long, relation: string>, hits: array<struct<_id: string, _source: struct<"
    "adsh: string, file_type: string, file_date: string, form: string, ciks: array<string>, "
    "display_names: array<string>, sics: array<string>>>>>"
)

# The exhibit types that hold an agreement, and the archive's address.
AGREEMENT_TYPES = ("EX-2.1", "EX-2.01")
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def is_agreement_exhibit(file_type: Column) -> Column:
    return F.upper(F.trim(file_type)).isin(*AGREEMENT_TYPES)


def folder_url(ciks: Column, adsh: Column) -> Column:
    """Null when a filing names no filer."""
    first = F.try_element_at(ciks, F.lit(1)).cast("long").cast("string")
    return F.concat(F.lit(ARCHIVE), first, F.lit("/"), F.replace(adsh, F.lit("-"), F.lit("")))


def flatten_hits(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per hit: accession and file name split, defaults filled, URLs assembled."""
    hit = (
        responses.select(F.from_json(body, RESPONSE_SCHEMA).alias("r"))
        .select(F.explode("r.hits.hits").alias("h"))
        .select(F.col("h._id").alias("id"), F.col("h._source").alias("s"))
    )
    rows = hit.select(
        F.coalesce("s.adsh", F.substring_index("id", ":", 1)).alias("adsh"),
        F.when(F.col("id").contains(":"), F.expr("substring(id, instr(id, ':') + 1)")).otherwise("").alias("filename"),
        F.coalesce("s.file_type", F.lit("")).alias("file_type"),
        F.coalesce("s.file_date", F.lit("")).alias("file_date"),
        F.coalesce("s.form", F.lit("")).alias("form"),
        F.coalesce("s.ciks", F.array().cast("array<string>")).alias("ciks"),
        F.coalesce("s.display_names", F.array().cast("array<string>")).alias("names"),
        F.coalesce("s.sics", F.array().cast("array<string>")).alias("sics"),
    )
    folder = folder_url(F.col("ciks"), F.col("adsh"))
    return rows.withColumn("doc_url", F.concat(folder, F.lit("/"), "filename")).withColumn(
        "index_url", F.concat(folder, F.lit("/"), "adsh", F.lit("-index.htm"))
    )


def press_release_url(html: Column) -> Column:
    """The link of an index page's EX-99 row; the bare or .1 exhibit wins, then page order."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    typed = F.filter(
        rows, lambda r: r.rlike(r"(?i)>\s*EX-99(\.\d+)?\s*<") & r.rlike(r'href="([^"]+)"')
    )
    picked = F.transform(
        typed,
        lambda r, i: F.struct(
            (~F.regexp_extract(r, r"(?i)>\s*EX-99(\.\d+)?\s*<", 1).isin("", ".1")).alias("late"),
            i.alias("at"),
            F.replace(F.regexp_extract(r, r'href="([^"]+)"', 1), F.lit("/ix?doc="), F.lit("")).alias("href"),
        ),
    )
    href = F.array_min(picked)["href"]
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit("https://www.sec.gov"), href))
