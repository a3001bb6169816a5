"""Registered queries: defined terms and lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import query_tokens
from spanlake.operators import terms as D
from spanlake.operators.passages import segment
from spanlake.plans.registry import query
from spanlake.plans.standins import AGREEMENTS, LINES, agreements, lines

TERM_PATTERNS_SQL = """
    SELECT doc_id, unnest(regexp_extract_all(text, '[“"]([A-Z][^”"\\n]{1,80})[”"]\\s+(?:means|shall mean)\\b', 1)) AS term, 'means' AS style FROM agreements
    UNION ALL
    SELECT doc_id, unnest(regexp_extract_all(text, '[“"]([A-Z][^”"\\n]{1,80})[”"]\\s+(?:has the meaning|shall have the meaning)\\b', 1)), 'xref' FROM agreements
    UNION ALL
    SELECT doc_id, unnest(regexp_extract_all(text, '\\((?:the|each,? an?|collectively,? the|together,? the)?\\s*[“"]([A-Z][^”"\\n]{1,80})[”"]\\)', 1)), 'paren' FROM agreements
"""


@query(
    "d1_extract_terms",
    f"""WITH {LINES}, {AGREEMENTS}, x AS ({TERM_PATTERNS_SQL})
    SELECT doc_id, trim(term) AS term, style, count(*) AS n FROM x GROUP BY ALL""",
)
def extract(t):
    """Terms per agreement and style."""
    return D.extract_terms(agreements(t)).groupBy("doc_id", "term", "style").agg(F.count(F.lit(1)).alias("n"))


@query("d2_definition_spans")
def spans(t):
    """Definition span and text of every defining occurrence."""
    d = D.extract_terms(agreements(t)).where("style <> 'xref'")
    return d.select("doc_id", "term", "style", "start", "def_start", "def_end", F.md5("def_text").alias("def_md5"))


@query(
    "d2_means_definitions",
    f"""WITH {LINES}, {AGREEMENTS}
    SELECT doc_id, w AS term, md5(substring(rtrim(clause), 1, 800)) AS def_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS rn FROM ag1 WHERE i % 3 = 0) WHERE rn = 1""",
)
def means(t):
    """The text of every term's first `means` definition."""
    d = D.definitions(D.extract_terms(agreements(t)).where("style = 'means'"))
    return d.select("doc_id", "term", F.md5("def_text").alias("def_md5"))


@query(
    "d3_one_definition",
    f"""WITH {LINES}, {AGREEMENTS}
    SELECT doc_id, w AS term, CASE WHEN min(i % 3) = 0 THEN 'means' ELSE 'paren' END AS style
    FROM ag1 WHERE i % 3 < 2 GROUP BY doc_id, w""",
)
def one(t):
    return D.definitions(D.extract_terms(agreements(t))).select("doc_id", "term", "style")


def line_definitions(t):
    """A document's capitalised words as terms, each defined by the first line it leads."""
    ln = lines(t).withColumn("term", F.regexp_extract("body", "[A-Z][a-z]+", 0)).where("term <> ''")
    best = ln.groupBy("doc_id", "term").agg(F.min_by(F.struct("start", "end", "body"), "start").alias("d"))
    return best.select(
        "doc_id", "term", F.col("d.start").alias("def_start"), F.col("d.end").alias("def_end"), F.col("d.body").alias("def_text")
    )


LINE_DEFS = """
    ld0 AS (SELECT *, regexp_extract(body, '[A-Z][a-z]+') AS term FROM lines),
    defs AS (SELECT doc_id, term, min(start) AS def_start, arg_min("end", start) AS def_end, arg_min(body, start) AS def_text
             FROM ld0 WHERE term <> '' GROUP BY doc_id, term)
"""
USED = """
    rn0 AS (SELECT doc_id, passage_id, start, "end", unnest(k) AS term, generate_subscripts(k, 1) AS pos
            FROM (SELECT *, regexp_extract_all(body, '[A-Za-z0-9]+') AS k FROM lines)),
    used AS (SELECT u.*, row_number() OVER (PARTITION BY passage_id ORDER BY pos) - 1 AS use_rank
             FROM (SELECT doc_id, passage_id, any_value(start) AS start, any_value("end") AS "end", term, min(pos) AS pos
                   FROM rn0 GROUP BY doc_id, passage_id, term) u SEMI JOIN defs USING (doc_id, term))
"""
PASSAGE_DEFS = """
    foreign_use AS (SELECT used.*, def_start, def_end, def_text FROM used JOIN defs USING (doc_id, term)
                    WHERE NOT (start <= def_start AND def_start < "end")),
    np AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
    rare AS (SELECT doc_id, term FROM (SELECT doc_id, term, count(*) AS uses FROM foreign_use GROUP BY ALL) JOIN np USING (doc_id)
             WHERE uses / n <= 0.2),
    pdefs AS (SELECT * FROM (SELECT doc_id, passage_id, term, def_start, def_end, def_text,
                                    row_number() OVER (PARTITION BY passage_id ORDER BY use_rank) - 1 AS rank
                             FROM foreign_use SEMI JOIN rare USING (doc_id, term)) WHERE rank < 6)
"""


def line_passages(t):
    return lines(t).withColumn("kind", F.lit("front"))


@query(
    "d4_terms_used",
    f"""WITH {LINES}, {LINE_DEFS}, {USED} SELECT passage_id, term, CAST(use_rank AS INTEGER) AS use_rank FROM used""",
)
def used(t):
    return D.terms_used(line_passages(t), line_definitions(t)).select("passage_id", "term", "use_rank")


@query(
    "d5_passage_definitions",
    f"""WITH {LINES}, {LINE_DEFS}, {USED}, {PASSAGE_DEFS} SELECT passage_id, rank, term, def_start, def_end FROM pdefs""",
)
def attached(t):
    return D.passage_definitions(line_passages(t), line_definitions(t)).select(
        "passage_id", "rank", "term", "def_start", "def_end"
    )


@query("d5_segment_definitions")
def attached_to_segments(t):
    """Definitions attached to the segmenter's passages of every agreement."""
    docs = agreements(t)
    p = segment(docs).withColumn("passage_id", F.col("doc_id") * 67108864 + F.col("ordinal"))
    return D.passage_definitions(p, D.definitions(D.extract_terms(docs))).select(
        "passage_id", "rank", "term", "def_start", "def_end"
    )


@query(
    "d6_expanded_passages",
    f"""WITH {LINES}, {LINE_DEFS}, {USED}, {PASSAGE_DEFS},
    g AS (SELECT passage_id, string_agg(def_text, chr(10) || chr(10) ORDER BY rank) AS d FROM pdefs GROUP BY 1)
    SELECT passage_id, md5(body || coalesce(chr(10) || chr(10) || d, '')) AS body_md5 FROM lines LEFT JOIN g USING (passage_id)""",
)
def expanded(t):
    p = line_passages(t)
    out = D.expand_passages(p, D.passage_definitions(p, line_definitions(t)))
    return out.select("passage_id", F.md5("body").alias("body_md5"))


SPLIT_SQL = "CASE WHEN CAST('0x' || substring(sha1(CAST({} AS VARCHAR)), 1, 2) AS INTEGER) % 10 < 3 THEN 'tune' ELSE 'report' END"


@query(
    "d7_vocabulary",
    f"""WITH {LINES}, {LINE_DEFS}
    SELECT term, count(DISTINCT doc_id) AS df FROM defs WHERE {SPLIT_SQL.format('doc_id')} = 'tune'
    GROUP BY term ORDER BY df DESC, term LIMIT 400""",
)
def vocab(t):
    return D.vocabulary(line_definitions(t))


def lexicon_entries(t):
    """A lexicon from the questions: each word maps to the two words after it."""
    k = t.benchmark.select("item_id", query_tokens(F.col("text")).alias("k"))
    e = k.select("item_id", F.posexplode("k").alias("i", "phrase"), "k").where(F.col("i") < F.size("k") - 2)
    term = F.concat_ws(" ", F.get("k", F.col("i") + 1), F.get("k", F.col("i") + 2))
    return e.select("phrase", (F.col("item_id") * 67108864 + F.col("i")).alias("pos"), term.alias("term")).groupBy(
        "phrase", "term"
    ).agg(F.min("pos").alias("pos"))


QTOK = """
    qk AS (SELECT item_id, list_filter(list_transform(list_sort(list(struct_pack(i := i, t := t))), lambda x: x.t), lambda x: length(x) > 1) AS k
           FROM (SELECT item_id, t, min(i) AS i FROM (
                   SELECT item_id, unnest(k) AS t, generate_subscripts(k, 1) AS i
                   FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM benchmark)) GROUP BY item_id, t)
           GROUP BY item_id)
"""
LEXICON = f"""
    {QTOK},
    lex0 AS (SELECT item_id, k[i + 1] AS phrase, k[i + 2] || ' ' || k[i + 3] AS term, item_id * 67108864 + i AS pos
             FROM (SELECT item_id, k, unnest(range(0, greatest(len(k) - 2, 0))) AS i FROM qk)),
    lexicon AS (SELECT phrase, term, min(pos) AS pos FROM lex0 GROUP BY ALL)
"""


@query(
    "d8_validate_lexicon",
    f"""WITH {LEXICON},
    tune AS (SELECT lower(text) AS text FROM documents WHERE {SPLIT_SQL.format('doc_id')} = 'tune'),
    terms AS (SELECT DISTINCT term FROM lexicon WHERE length(phrase) >= 3),
    found AS (SELECT term FROM terms WHERE EXISTS (SELECT 1 FROM tune WHERE contains(text, term)
              AND regexp_matches(text, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')))
    SELECT phrase, term, pos FROM lexicon SEMI JOIN found USING (term) WHERE length(phrase) >= 3""",
)
def lexicon(t):
    return D.validate_lexicon(lexicon_entries(t), t.documents)
