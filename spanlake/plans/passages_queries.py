"""Registered queries: segmentation and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import passages as P
from spanlake.plans.registry import query
from spanlake.plans.standins import AGREEMENTS, LINES, agreements, lines


@query("g1_segments")
def segments(t):
    """Section-aware passages of every agreement."""
    return P.segment(agreements(t)).select(
        "doc_id", "ordinal", "start", "end", "section_id", "section_title", "kind", "section_path",
        F.md5("body").alias("body_md5"),
    )


@query(
    "g1_sections",
    rf"""WITH {LINES}, {AGREEMENTS},
    h AS (SELECT doc_id, regexp_extract_all(text, '(?:^|\n)Section (\d{{1,2}}\.\d{{1,2}})[ \t]+[A-Z]', 1) AS ids FROM agreements)
    SELECT doc_id, array_to_string(list_slice(ids, CAST(len(ids) / 2 AS BIGINT) + 1, len(ids)), ' ') AS section_ids,
           CAST(len(ids) / 2 AS BIGINT) AS n_sections FROM h""",
)
def sections(t):
    """Section ids in order: the table of contents is skipped."""
    s = P.segment(agreements(t), max_chars=None).where("section_id <> ''")
    per = s.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "section_id"))).alias("l"), F.count(F.lit(1)).alias("n_sections")
    )
    return per.select("doc_id", F.array_join(F.col("l.section_id"), " ").alias("section_ids"), "n_sections")


def _step(rest: str) -> str:
    """Length of the next passage of a text: the longest prefix of its window that ends at a place of a kind, if past the first quarter."""
    ends = [r"^(.*\n\s*\n)", r"^(.*\s)\((?:[a-z]|[ivx]{1,4}|[A-Z])\)\s", r"^(.*[.;:]\s)"]
    sizes = [f"length(regexp_extract(substring({rest}, 1, 600), '(?s){e}', 1))" for e in ends]
    return f"CASE WHEN length({rest}) <= 600 THEN length({rest}) {' '.join(f'WHEN {n} >= 150 THEN {n}' for n in sizes)} ELSE 600 END"


@query(
    "g2_bounded_cut",
    rf"""WITH RECURSIVE cut AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS start, text AS rest, CAST({_step('text')} AS BIGINT) AS len
        FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, ordinal + 1, start + len, more, CAST({_step('more')} AS BIGINT)
        FROM (SELECT doc_id, ordinal, start, len, substring(rest, len + 1) AS more FROM cut WHERE len < length(rest)))
    SELECT doc_id, ordinal, start, start + len AS "end",
           CASE WHEN len(regexp_extract_all(substring(rest, 1, len), '\b\d{{1,2}}\.\d{{1,2}}\b')) >= 5 THEN 'toc' ELSE 'front' END AS kind,
           md5(substring(rest, 1, len)) AS body_md5 FROM cut""",
)
def bounded(t):
    """Whole documents cut at blank lines, sub-clauses or sentence ends, 600 characters at most."""
    s = P.segment(t.documents, max_chars=600)
    return s.select("doc_id", "ordinal", "start", "end", "kind", F.md5("body").alias("body_md5"))


@query(
    "g3_toc_tag",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(t, '\b\d{1,2}\.\d{1,2}\b')) AS INTEGER) AS n_numbers,
           len(regexp_extract_all(t, '\b\d{1,2}\.\d{1,2}\b')) >= 5 AS is_toc
    FROM (SELECT doc_id, replace(text, '. ', ' 12.34 ') AS t FROM documents)""",
)
def toc(t):
    """Documents whose sentence breaks became section numbers."""
    d = t.documents.select("doc_id", F.replace("text", F.lit(". "), F.lit(" 12.34 ")).alias("body"))
    return d.select(
        "doc_id", F.regexp_count("body", F.lit(P.SECTION_NUMBER)).alias("n_numbers"),
        P.is_toc(F.lit("front"), F.col("body")).alias("is_toc"),
    )


@query(
    "g4_articles",
    rf"""WITH {LINES}, {AGREEMENTS}
    SELECT doc_id, num AS section_id, CAST(i // 9 + 1 AS VARCHAR) AS article FROM ag0""",
)
def articles(t):
    """The article each section belongs to."""
    s = P.segment(agreements(t), max_chars=None).where("section_id <> ''")
    return s.select("doc_id", "section_id", F.regexp_extract("section_path", "^Article ([^ ]+) ", 1).alias("article"))


@query(
    "g5_section_paths",
    rf"""WITH {LINES}, {AGREEMENTS}
    SELECT doc_id, 'Article ' || CAST(i // 9 + 1 AS VARCHAR) || ' › ' || num AS section_path, w || ' Matters' AS section_title
    FROM ag0""",
)
def paths(t):
    """Title and path of every section's first passage."""
    s = P.segment(agreements(t), max_chars=None).where("section_id <> ''")
    return s.select("doc_id", "section_path", "section_title")


@query("g6_fixed_chunks")
def chunks(t):
    return P.fixed_chunks(agreements(t), 1700).select(
        "doc_id", "ordinal", "start", "end", "kind", F.md5("body").alias("body_md5")
    )


@query(
    "g7_fixed_size",
    f"""WITH {LINES}, s AS (SELECT length(body) AS len FROM lines),
    r AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS rn, count(*) OVER () AS n FROM s)
    SELECT CAST(len AS BIGINT) AS median_len, CAST(greatest(100, round_even(len / 100.0, 0) * 100) AS BIGINT) AS size
    FROM r WHERE rn = n // 2""",
)
def size(t):
    return P.fixed_size(lines(t).withColumn("kind", F.lit("front")))


@query(
    "g8_passage_ids",
    f"""WITH {LINES}
    SELECT doc_id, ordinal, row_number() OVER (ORDER BY doc_id, ordinal) AS passage_id FROM lines""",
)
def ids(t):
    p = lines(t).select("doc_id", "ordinal")
    return P.passage_ids(p)


@query(
    "g8_contract_ranges",
    f"""WITH {LINES}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, ordinal) AS passage_id FROM lines)
    SELECT doc_id, min(passage_id) AS first_passage_id, max(passage_id) AS last_passage_id FROM ids GROUP BY doc_id""",
)
def ranges(t):
    return P.contract_ranges(P.passage_ids(lines(t).select("doc_id", "ordinal")))


@query(
    "g9_passage_statistics",
    f"""WITH {LINES}, c AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
    SELECT CAST(sum(n) AS BIGINT) AS passages_total, round(avg(n), 1) AS passages_mean, median(n) AS passages_median FROM c""",
)
def statistics(t):
    return P.count_statistics(lines(t))


@query(
    "g10_tiling_faults",
    f"""WITH {LINES}, n AS (SELECT doc_id, "end", lead(start) OVER (PARTITION BY doc_id ORDER BY ordinal) AS nxt FROM lines)
    SELECT doc_id, count(*) FILTER (WHERE nxt > "end") AS gaps, count(*) FILTER (WHERE nxt < "end") AS overlaps
    FROM n WHERE nxt IS NOT NULL GROUP BY doc_id""",
)
def tiling(t):
    """Lines leave a gap of one character (the line feed), passages of the segmenter leave none."""
    return P.tiling_faults(lines(t))


@query(
    "g10_segments_tile",
    """SELECT doc_id, CAST(0 AS BIGINT) AS faults, CAST(length(text) AS BIGINT) AS covered FROM documents WHERE length(text) > 0""",
)
def segments_tile(t):
    """Segments of every document tile it: no fault, and the covered characters are the whole text."""
    p = P.segment(t.documents, max_chars=600).select("doc_id", "ordinal", "start", "end")
    nxt = p.select("doc_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("start").alias("nxt"))
    j = p.join(nxt, ["doc_id", "ordinal"], "left")
    return j.groupBy("doc_id").agg(
        F.count_if(F.col("nxt") != F.col("end")).alias("faults"), F.sum(F.col("end") - F.col("start")).alias("covered")
    )
