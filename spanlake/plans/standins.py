"""Views that let the given tables play agreements, passages, questions and labels, with the same views in SQL.

Every view keeps whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(t) -> DataFrame:
    """Document lines as passages with offsets: doc_id, ordinal, start, end, passage_id, body."""
    ln = t.documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("ordinal", "body"))
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("body") + 1).over(w), F.lit(0))
    return ln.select(
        "doc_id",
        "lang",
        "source",
        F.col("ordinal").cast("long").alias("ordinal"),
        start.cast("long").alias("start"),
        (start + F.length("body")).cast("long").alias("end"),
        (F.col("doc_id") * 67108864 + F.col("ordinal")).alias("passage_id"),
        "body",
    )


LINES = """
    ln0 AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS body,
                   CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ordinal FROM documents),
    lines AS (SELECT doc_id, lang, source, ordinal, body, doc_id * 67108864 + ordinal AS passage_id,
                     CAST(coalesce(sum(length(body) + 1) OVER w, 0) AS BIGINT) AS start,
                     CAST(coalesce(sum(length(body) + 1) OVER w, 0) + length(body) AS BIGINT) AS "end"
              FROM ln0 WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def _word(line: Column) -> Column:
    w = F.regexp_extract(line, "[A-Z][a-z]+", 0)
    return F.when(w == "", "Term").otherwise(w)


def _number(i: Column) -> Column:
    return F.concat(F.floor(i / 9 + 1).cast("string"), F.lit("."), (i % 9 + 1).cast("string"))


def _clause(line: Column, i: Column) -> Column:
    w = _word(line)
    return (
        F.when(i % 3 == 0, F.concat(F.lit("“"), w, F.lit("” means "), line))
        .when(i % 3 == 1, F.concat(line, F.lit(" (the “"), w, F.lit("”)")))
        .otherwise(F.concat(F.lit('"'), w, F.lit('" has the meaning set forth in '), line))
    )


def agreements(t) -> DataFrame:
    """Documents rewritten as agreements: a table of contents, then one numbered, defining section per line."""
    ln = F.split("text", "\n")
    toc = F.array_join(
        F.transform(ln, lambda x, i: F.concat(F.lit("Section "), _number(i), F.lit(" "), _word(x), F.lit(" Matters"))), "\n"
    )
    body = F.array_join(
        F.transform(
            ln,
            lambda x, i: F.concat(
                F.when(i % 9 == 0, F.concat(F.lit("ARTICLE "), F.floor(i / 9 + 1).cast("string"), F.lit("\n\n"))).otherwise(""),
                F.lit("Section "), _number(i), F.lit(" "), _word(x), F.lit(" Matters. "), _clause(x, i),
            ),
        ),
        "\n\n",
    )
    return t.documents.select("doc_id", "lang", "source", F.concat(toc, F.lit("\n\n"), body).alias("text"))


AGREEMENTS = r"""
    ag0 AS (SELECT doc_id, lang, source, ordinal AS i, body, coalesce(nullif(regexp_extract(body, '[A-Z][a-z]+'), ''), 'Term') AS w,
                   CAST(ordinal // 9 + 1 AS VARCHAR) || '.' || CAST(ordinal % 9 + 1 AS VARCHAR) AS num FROM ln0),
    ag1 AS (SELECT *, CASE i % 3 WHEN 0 THEN '“' || w || '” means ' || body
                                 WHEN 1 THEN body || ' (the “' || w || '”)'
                                 ELSE '"' || w || '" has the meaning set forth in ' || body END AS clause FROM ag0),
    agreements AS (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source,
                   string_agg('Section ' || num || ' ' || w || ' Matters', chr(10) ORDER BY i) || chr(10) || chr(10) ||
                   string_agg(CASE WHEN i % 9 = 0 THEN 'ARTICLE ' || CAST(i // 9 + 1 AS VARCHAR) || chr(10) || chr(10) ELSE '' END
                              || 'Section ' || num || ' ' || w || ' Matters. ' || clause, chr(10) || chr(10) ORDER BY i) AS text
                   FROM ag1 GROUP BY doc_id)
"""
