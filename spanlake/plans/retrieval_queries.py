"""Registered queries: retrieval, fusion, scoping, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import context as C
from spanlake.operators import dense as V
from spanlake.operators import fusion as U
from spanlake.operators import scope as S
from spanlake.operators import terms as D
from spanlake.operators.lexical_index import search_index, stored_index
from spanlake.operators.search import passage_counts, postings, term_statistics
from spanlake.session import cut_lineage
from spanlake.plans.ladder import Index, Settings, run_rung
from spanlake.plans.registry import query
from spanlake.plans.standins import LINES, lines
from spanlake.plans.terms_queries import (
    LEXICON,
    LINE_DEFS,
    PASSAGE_DEFS,
    USED,
    lexicon_entries,
    line_definitions,
    line_passages,
)

TOKENS = r"""
    tk0 AS (SELECT passage_id, doc_id, regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+') AS k FROM lines),
    tk AS (SELECT passage_id, doc_id, len(k) AS dl, unnest(k) AS term FROM tk0),
    post AS (SELECT passage_id, doc_id, dl, term, count(*) AS tf FROM tk GROUP BY ALL),
    corpus AS (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM tk0),
    dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term)
"""


def bm25_sql(queries: str, scoped: bool = False, k: int = 10) -> str:
    """Ranked rows for `queries`, a SELECT of (query_id, text[, doc_id])."""
    scope = " AND p.doc_id = t.doc_id" if scoped else ""
    doc = ", doc_id" if scoped else ""
    return f"""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (
        SELECT t.query_id, p.passage_id, round(sum(greatest_idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM (SELECT q.*, CASE WHEN n - df + 0.5 > df + 0.5 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS greatest_idf, avgdl
              FROM (SELECT DISTINCT query_id{doc}, term FROM (SELECT query_id{doc}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term
                    FROM ({queries})) WHERE length(term) > 1) q JOIN dfs USING (term), corpus) t
        JOIN post p ON p.term = t.term{scope} GROUP BY ALL)) WHERE rank <= {k}"""


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def own_questions(t):
    """Every document's first line, asked of that document."""
    return lines(t).where("ordinal = 0").select(
        F.col("doc_id").alias("query_id"), "doc_id", F.col("body").alias("text")
    )


def line_index(t):
    """The stored index of all document lines; a document is a scope."""
    return stored_index(lines(t), t.documents, "lines", scope="doc_id")


def expanded_index(t):
    """The stored index of all document lines joined with their definitions."""
    p = line_passages(t)
    return stored_index(D.expand_passages(p, D.passage_definitions(p, line_definitions(t))), t.documents, "expanded-lines", scope="doc_id")


QUESTIONS = "SELECT item_id AS query_id, text FROM benchmark"
OWN_QUESTIONS = "SELECT doc_id AS query_id, doc_id, body AS text FROM lines WHERE ordinal = 0"


def rounded(hits):
    return hits.withColumn("score", F.round("score", 6))


@query(
    "q1_postings",
    f"""WITH {LINES}, {TOKENS} SELECT doc_id, term, count(*) AS n_passages, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(tf * dl) AS BIGINT) AS weighted
    FROM post GROUP BY doc_id, term""",
)
def build_postings(t):
    """The inverted index over document lines, summed per document and term."""
    return postings(lines(t), ["passage_id", "doc_id"]).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum("tf").alias("tf"), F.sum(F.col("tf") * F.col("dl")).alias("weighted")
    )


@query("q1_term_statistics", f"WITH {LINES}, {TOKENS} SELECT term, df, cf FROM dfs")
def statistics(t):
    return term_statistics(postings(lines(t), ["passage_id"]))


@query("q2_bm25_topk", f"WITH {LINES}, {TOKENS} {bm25_sql(QUESTIONS)}")
def lexical(t):
    """Ten best lines of the whole corpus for every benchmark question."""
    return rounded(search_index(line_index(t), questions(t)))


@query("q2_bm25_scoped", f"WITH {LINES}, {TOKENS} {bm25_sql(OWN_QUESTIONS, scoped=True)}")
def lexical_scoped(t):
    """Ten best lines of one document for that document's question, with corpus-wide statistics."""
    return rounded(search_index(line_index(t), own_questions(t), scope="doc_id"))


@query(
    "q3_embedding_cache",
    f"""WITH {LINES}, cached AS (SELECT DISTINCT sha1(body) AS sha1 FROM lines WHERE lang = 'en')
    SELECT sha1(body) AS sha1, CAST(len(regexp_extract_all(any_value(body), '[A-Za-z0-9]+')) + 2 AS BIGINT) AS n_tokens,
           CAST(1.0 AS DOUBLE) AS norm FROM lines WHERE sha1(body) NOT IN (SELECT sha1 FROM cached) GROUP BY 1""",
)
def embedding_cache(t):
    """New cache rows when the English lines are cached already."""
    ln = lines(t)
    cache = ln.where("lang = 'en'").select(F.lit("hashed-words").alias("model"), F.sha1("body").alias("sha1")).distinct()
    new = V.fill_cache(ln, cache, "hashed-words")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return new.select("sha1", "n_tokens", F.round(norm, 3).alias("norm"))


@query(
    "q4_vector_report",
    f"""WITH {LINES}, c AS (SELECT DISTINCT sha1(body) AS sha1, len(regexp_extract_all(body, '[A-Za-z0-9]+')) + 2 AS n FROM lines WHERE lang <> 'de')
    SELECT count(c.sha1) AS vectors, count(*) FILTER (WHERE n > 512) AS truncated, count(*) FILTER (WHERE c.sha1 IS NULL) AS missing
    FROM lines LEFT JOIN c ON c.sha1 = sha1(body)""",
)
def vector_table(t):
    """Lines joined with the cached vectors of all but the German ones; the report shows what is missing."""
    ln = lines(t)
    none = ln.select(F.lit("x").alias("model"), F.lit("x").alias("sha1")).where(F.lit(False))
    cache = V.fill_cache(ln.where("lang <> 'de'"), none, "hashed-words")
    return V.vector_report(V.build_vectors(ln, cache, "hashed-words", ["passage_id", "doc_id"]))


def dense_sql(scoped: bool, k: int) -> str:
    on = "a.label = b.label" if scoped else "true"
    return f"""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS passage_id,
               round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
        FROM embeddings a JOIN embeddings b ON {on})) WHERE rank <= {k}"""


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vec"), "label")


def vector_queries(t):
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")


@query("q5_dense_topk", f"SELECT query_id, rank, passage_id, round(score, 6) AS score FROM ({dense_sql(False, 10)})")
def dense(t):
    """Ten nearest vectors of every vector."""
    return rounded(V.dense_top_k(vector_queries(t), vectors(t)))


@query("q5_dense_scoped", f"SELECT query_id, rank, passage_id, round(score, 6) AS score FROM ({dense_sql(True, 10)})")
def dense_scoped(t):
    """Ten nearest vectors of the same label."""
    return rounded(V.dense_top_k(vector_queries(t), vectors(t), scope="label"))


def two_legs(t, depth=20):
    q, v = vector_queries(t), vectors(t)
    return {"near": V.dense_top_k(q, v, depth), "same": V.dense_top_k(q, v, depth, scope="label")}


FUSED = f"""
    near AS ({dense_sql(False, 20)}), same AS ({dense_sql(True, 20)}),
    legs AS (SELECT *, 'near' AS leg FROM near UNION ALL SELECT *, 'same' FROM same),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (
                SELECT query_id, passage_id, round(sum(1.0 / (10 + rank)), 12) AS score,
                       max(CASE WHEN leg = 'near' THEN rank END) AS near_rank, max(CASE WHEN leg = 'near' THEN score END) AS near_score,
                       max(CASE WHEN leg = 'same' THEN rank END) AS same_rank, max(CASE WHEN leg = 'same' THEN score END) AS same_score
                FROM legs GROUP BY ALL)) WHERE rank <= 20)
"""


@query("q6_rank_fusion", f"WITH {FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, round(score, 6) AS score FROM fused WHERE rank <= 10")
def fusion(t):
    return rounded(U.reciprocal_rank_fusion(two_legs(t), 10, 10)).select("query_id", "rank", "passage_id", "score")


@query(
    "q7_fusion_stages",
    f"""WITH {FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, near_rank, round(near_score, 6) AS near_score,
        same_rank, round(same_score, 6) AS same_score FROM fused WHERE rank <= 10""",
)
def stages(t):
    f = U.reciprocal_rank_fusion(two_legs(t), 10, 10)
    return f.select(
        "query_id", "rank", "passage_id", "near_rank", F.round("near_score", 6).alias("near_score"), "same_rank",
        F.round("same_score", 6).alias("same_score"),
    )


@query(
    "q8_rerank_head",
    f"""WITH {FUSED}, r AS (SELECT query_id, passage_id, rank AS fused_rank,
          CASE WHEN rank <= 8 THEN CAST((passage_id * 7 + query_id) % 11 AS DOUBLE) ELSE round(score, 6) END AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY rank > 8, CASE WHEN rank <= 8 THEN (passage_id * 7 + query_id) % 11 END DESC,
                             CASE WHEN rank <= 8 THEN passage_id ELSE rank END) AS rank FROM fused)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, score, CAST(fused_rank AS INTEGER) AS fused_rank FROM r WHERE rank <= 12""",
)
def rerank(t):
    """The first eight fused hits reordered by a pair score, the rest in fused order."""
    fused = U.reciprocal_rank_fusion(two_legs(t), 10, 20)
    scores = fused.select(
        "query_id", "passage_id", ((F.col("passage_id") * 7 + F.col("query_id")) % 11).cast("double").alias("score")
    )
    return rounded(U.rerank_head(fused, scores, 8, 12))


@query(
    "q9_pair_scores",
    r"""WITH w AS (SELECT conv_id, turn, text, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS k FROM conversations)
    SELECT a.conv_id * 67108864 + a.turn AS query_id, b.conv_id * 67108864 + b.turn AS passage_id,
           CAST(len(list_intersect(a.k, b.k)) AS DOUBLE) + CASE WHEN a.role = 'system' THEN 100 ELSE 0 END AS score
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def pair_scores(t):
    """Each turn scored against the next; the pairs that start with a system turn come from the cache."""
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body"))
    pairs = c.join(nxt, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 67108864 + F.col("turn")).alias("query_id"),
        (F.col("conv_id") * 67108864 + F.col("turn") + 1).alias("passage_id"),
        F.col("text").alias("query"), "body", "role",
    )
    old = pairs.where("role = 'system'").select(
        F.lit("shared-words").alias("model"), U.pair_key(F.col("query"), F.col("body")).alias("key"),
        (U.shared_words(F.col("query"), F.col("body")) + 100).alias("score"),
    ).dropDuplicates(["key"])
    scores, _ = U.score_pairs(pairs, old, "shared-words")
    return scores


@query(
    "q10_lexicon_rewrite",
    f"""WITH {LEXICON},
    q AS (SELECT item_id AS query_id, text, lower(text) AS low FROM benchmark),
    hit AS (SELECT query_id, low, phrase FROM q, (SELECT DISTINCT phrase FROM lexicon) p
            WHERE contains(low, phrase) AND regexp_matches(low, '(^|[^a-z0-9])' || phrase || '([^a-z0-9]|$)')),
    ex AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY length(phrase) DESC, phrase, pos, term) AS rn
           FROM hit JOIN lexicon USING (phrase) WHERE NOT regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')),
    u AS (SELECT query_id, term, min(rn) AS rn FROM ex GROUP BY ALL),
    g AS (SELECT query_id, string_agg(term, ' ' ORDER BY rn) AS extra FROM u GROUP BY query_id)
    SELECT query_id, text || coalesce(' ' || extra, '') AS text FROM q LEFT JOIN g USING (query_id)""",
)
def lexicon_rewrite(t):
    return S.rewrite(questions(t), lexicon_entries(t)).select("query_id", "text")


def alias_table(t):
    """The first two words of a document name it as a target, its third word names it as a parent."""
    from spanlake.functions.text import name_tokens

    first = t.documents.where("text IS NOT NULL").select("doc_id", F.substring_index("text", "\n", 1).alias("body"))
    k = first.select("doc_id", name_tokens(F.col("body")).alias("k")).where(F.size("k") >= 3)
    target = k.select(F.concat_ws(" ", F.get("k", F.lit(0)), F.get("k", F.lit(1))).alias("alias"), F.col("doc_id").alias("contract_id"), F.lit("target").alias("kind"))
    parent = k.select(F.get("k", F.lit(2)).alias("alias"), F.col("doc_id").alias("contract_id"), F.lit("parent").alias("kind"))
    return target.unionByName(parent)


def line_questions(t):
    return lines(t).select(F.col("passage_id").alias("query_id"), F.col("body").alias("text"), "lang", "doc_id")


RESOLVER = r"""
    al0 AS (SELECT doc_id, list_transform(regexp_extract_all(body, '[A-Za-z0-9]+|&'), lambda w: CASE WHEN w = '&' THEN 'and' ELSE lower(w) END) AS k
            FROM lines WHERE ordinal = 0),
    aliases AS (SELECT k[1] || ' ' || k[2] AS alias, 2 AS words, 'target' AS kind, doc_id AS contract_id FROM al0 WHERE len(k) >= 3
                UNION ALL SELECT k[3], 1, 'parent', doc_id FROM al0 WHERE len(k) >= 3),
    qw0 AS (SELECT passage_id AS query_id, regexp_extract_all(body, '[A-Za-z0-9]+|&') AS w,
                   regexp_extract_all(body, '([^A-Za-z0-9&]*)([A-Za-z0-9]+|&)', 1) AS gap FROM lines),
    qw1 AS (SELECT query_id, unnest(w) AS raw, unnest(gap) AS gap, generate_subscripts(w, 1) AS i FROM qw0),
    qw AS (SELECT *, CASE WHEN raw = '&' THEN 'and' ELSE lower(raw) END AS token,
                  lead(CASE WHEN raw = '&' THEN 'and' ELSE lower(raw) END) OVER (PARTITION BY query_id ORDER BY i) AS nxt FROM qw1),
    singles AS (SELECT DISTINCT query_id, token AS alias FROM qw LEFT JOIN (SELECT term FROM dfs WHERE df >= 100) c ON c.term = token
                WHERE regexp_matches(raw, '[A-Z]') AND (regexp_matches(raw, '^[A-Z]') OR NOT regexp_matches(raw, '[a-z]'))
                  AND (NOT regexp_matches(raw, '[a-z]')
                       OR NOT (regexp_matches(gap, '[.?!:]\s*$') OR (i = 1 AND regexp_matches(gap, '^\s*$')))
                       OR coalesce(nxt, '') IN ('inc','incorporated','corp','corporation','co','ltd','limited','llc','plc')
                       OR c.term IS NULL)),
    pairs2 AS (SELECT DISTINCT query_id, token || ' ' || nxt AS alias FROM qw WHERE nxt IS NOT NULL),
    ahits AS (SELECT DISTINCT query_id, kind, words, alias, contract_id FROM aliases JOIN singles USING (alias) WHERE words = 1
              UNION SELECT DISTINCT query_id, kind, words, alias, contract_id FROM aliases JOIN pairs2 USING (alias) WHERE words = 2),
    atop AS (SELECT * FROM (SELECT *, max(CASE WHEN kind = 'target' THEN 1000 ELSE 0 END + words) OVER (PARTITION BY query_id) AS b FROM ahits)
             WHERE CASE WHEN kind = 'target' THEN 1000 ELSE 0 END + words = b),
    resolved AS (SELECT passage_id AS query_id, CASE WHEN n = 1 THEN one END AS contract_id, alias, coalesce(n, 0) AS n_candidates
                 FROM lines LEFT JOIN (SELECT query_id, count(DISTINCT contract_id) AS n, min(contract_id) AS one, min(alias) AS alias
                                       FROM atop GROUP BY query_id) ON query_id = passage_id)
"""


def resolver_parts(t):
    common = S.common_tokens(passage_counts(lines(t)))
    return line_questions(t), alias_table(t), common


@query("q11_resolve_deal", f"WITH {LINES}, {TOKENS}, {RESOLVER} SELECT query_id, contract_id, alias, n_candidates FROM resolved")
def resolve(t):
    """The document every line names, if it names one."""
    return S.resolve(*resolver_parts(t))[0]


@query(
    "q11_candidates",
    f"""WITH {LINES}, {TOKENS}, {RESOLVER}, deals AS (SELECT alias, kind, count(DISTINCT contract_id) AS n_deals FROM aliases GROUP BY ALL)
    SELECT DISTINCT query_id, alias, kind, n_deals FROM atop JOIN deals USING (alias, kind)""",
)
def candidates(t):
    """The best aliases of every line and how many deals bear each; `q11_alias_deals` names the deals."""
    return S.resolve(*resolver_parts(t))[1]


@query("q11_alias_deals", f"WITH {LINES}, {TOKENS}, {RESOLVER} SELECT DISTINCT alias, kind, contract_id FROM aliases")
def alias_deals(t):
    return S.alias_names(alias_table(t)).select("alias", "kind", "contract_id")


@query(
    "q11_name_words",
    r"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|&'),
           lambda w: CASE WHEN w = '&' THEN 'and' ELSE lower(w) END), ' ')) AS tokens_md5 FROM documents""",
)
def name_words(t):
    from spanlake.functions.text import name_tokens

    return t.documents.select("doc_id", F.md5(F.array_join(name_tokens(F.col("text")), " ")).alias("tokens_md5"))


@query("q12_scope_questions")
def scope_questions(t):
    """Lines as questions: English ones inside their own document, the others placed by the names they hold."""
    q, aliases, common = resolver_parts(t)
    q = q.select("query_id", "text", F.when(F.col("lang") == "en", F.col("doc_id")).alias("picked"))
    return S.scope_questions(q, aliases, common)


def ladder_index(t, rung):
    """The index tables a rung reads. Lines are read from the documents again, and expanded ones from their stored index, so neither is written here."""
    p = line_passages(t).withColumn("contract_id", F.col("doc_id"))
    keep = ["passage_id", "contract_id", "body"]
    passages = p.select(*keep)
    expanded = lexicon = vectors = aliases = common = None
    if rung in ("R6", "R6n", "R7", "R7n"):
        defs = D.passage_definitions(p, line_definitions(t))
        expanded = D.expand_passages(p, defs).select(*keep)
    if rung != "R1":
        vectors = cut_lineage(passages.select("passage_id", "contract_id", V.hashed_embedder(F.col("body")).alias("vec")))
    if rung in ("R5", "R6", "R6n", "R7", "R7n"):
        lexicon = cut_lineage(lexicon_entries(t))
    if rung in ("R7", "R7n"):
        aliases = cut_lineage(alias_table(t))
        common = cut_lineage(S.common_tokens(passage_counts(passages)))
    lexical = line_index(t) if expanded is None else None
    return Index(passages, expanded, vectors, lexicon, aliases, common, lexical, expanded and expanded_index(t), settings=Settings(depth=20))


def rung_query(rung: str):
    def run(t):
        q = own_questions(t).select("query_id", F.col("doc_id").alias("contract_id"), "text")
        return rounded(run_rung(rung, q, ladder_index(t, rung)))

    run.__doc__ = f"Rung {rung}: every document's question inside that document."
    return run


def deal_rung_query(rung: str):
    def run(t):
        q = questions(t).select("query_id", "text", F.lit(None).cast("long").alias("picked"))
        return rounded(run_rung(rung, q, ladder_index(t, rung)))

    run.__doc__ = f"Rung {rung}: every benchmark question, placed by the names it holds or asked of the whole corpus."
    return run


# The hashed embedder in SQL: a word's slot is its sha1 modulo 384, from its remainders by 128 (the low seven bits) and by 3
# (the sum of the hex digits, as 16 leaves 1); a text without words has all its weight in slot 0.
EMBEDDED = r"""
    wd0 AS (SELECT DISTINCT unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS w FROM (SELECT body FROM lines UNION ALL SELECT text FROM own)),
    wd1 AS (SELECT w, ('0x' || right(sha1(w), 2))::INTEGER & 127 AS a, CAST(list_sum([('0x' || d)::INTEGER FOR d IN string_split(sha1(w), '')]) % 3 AS INTEGER) AS b FROM wd0),
    slots AS (SELECT w, a + 128 * ((((b - a) * 2) % 3 + 3) % 3) AS slot FROM wd1),
    ln2 AS (SELECT passage_id, doc_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS w FROM lines),
    vec0 AS (SELECT passage_id, doc_id, slot, CAST(count(*) AS DOUBLE) AS x FROM ln2 JOIN slots USING (w) GROUP BY ALL
             UNION ALL SELECT passage_id, doc_id, 0, 1.0 FROM lines WHERE NOT regexp_matches(lower(body), '[a-z0-9]')),
    vec AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY passage_id)) AS v FROM vec0),
    qw2 AS (SELECT query_id, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM own),
    qvec0 AS (SELECT query_id, doc_id, slot, CAST(count(*) AS DOUBLE) AS x FROM qw2 JOIN slots USING (w) GROUP BY ALL),
    qvec AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS v FROM qvec0),
    near0 AS (SELECT query_id, p.passage_id, sum(q.v * p.v) AS s FROM qvec q JOIN vec p ON p.doc_id = q.doc_id AND p.slot = q.slot GROUP BY ALL),
    asked AS (SELECT query_id, doc_id FROM own WHERE regexp_matches(text, '[A-Za-z0-9]')),
    scored AS (SELECT asked.query_id, lines.passage_id, round(coalesce(s, 0.0), 9) AS score FROM asked JOIN lines USING (doc_id)
               LEFT JOIN near0 ON near0.query_id = asked.query_id AND near0.passage_id = lines.passage_id),
    dense_leg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM scored)
"""
REWRITTEN = f"""
    rq AS (SELECT query_id, text, lower(text) AS low FROM ({OWN_QUESTIONS})),
    rhit AS (SELECT query_id, low, phrase FROM rq, (SELECT DISTINCT phrase FROM lexicon) p
             WHERE contains(low, phrase) AND regexp_matches(low, '(^|[^a-z0-9])' || phrase || '([^a-z0-9]|$)')),
    rex AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY length(phrase) DESC, phrase, pos, term) AS rn
            FROM rhit JOIN lexicon USING (phrase) WHERE NOT regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')),
    ru AS (SELECT query_id, term, min(rn) AS rn FROM rex GROUP BY ALL),
    rg AS (SELECT query_id, string_agg(term, ' ' ORDER BY rn) AS extra FROM ru GROUP BY query_id),
    own AS (SELECT query_id, query_id AS doc_id, text || coalesce(' ' || extra, '') AS text FROM rq LEFT JOIN rg USING (query_id))
"""
EXPANDED_TOKENS = TOKENS.replace("FROM lines)", "FROM expanded)")
EXPANDED = f"""{LINE_DEFS}, {USED}, {PASSAGE_DEFS},
    dg AS (SELECT passage_id, string_agg(def_text, chr(10) || chr(10) ORDER BY rank) AS d FROM pdefs GROUP BY 1),
    expanded AS (SELECT passage_id, doc_id, body || coalesce(chr(10) || chr(10) || d, '') AS body FROM lines LEFT JOIN dg USING (passage_id))"""
LADDER_DEPTH = 20


def ladder_sql(rung: str) -> str:
    """What a rung returns for every document's first line, asked of that document."""
    own = f"{LEXICON}, {REWRITTEN}" if rung in ("R5", "R6", "R6n") else f"own AS ({OWN_QUESTIONS})"
    tokens = f"{EXPANDED}, {EXPANDED_TOKENS}" if rung in ("R6", "R6n") else TOKENS
    start = f"WITH {LINES}, {own}, {EMBEDDED}"
    if rung == "R2":
        return f"{start} SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, round(score, 6) AS score FROM dense_leg WHERE rank <= 10"
    lexical = bm25_sql("SELECT query_id, doc_id, text FROM own", scoped=True, k=LADDER_DEPTH).replace("round(score, 6) AS score", "score")
    fused = f"""{start}, {tokens}, lexical_leg AS ({lexical}),
    legs AS (SELECT query_id, passage_id, rank, score, 'bm25' AS leg FROM lexical_leg
             UNION ALL SELECT query_id, passage_id, rank, score, 'dense' FROM dense_leg WHERE rank <= {LADDER_DEPTH}),
    fused AS (SELECT query_id, passage_id, round(sum(1.0 / (10 + rank)), 12) AS score,
                     CAST(max(rank) FILTER (WHERE leg = 'bm25') AS INTEGER) AS bm25_rank, max(score) FILTER (WHERE leg = 'bm25') AS bm25_score,
                     CAST(max(rank) FILTER (WHERE leg = 'dense') AS INTEGER) AS dense_rank, max(score) FILTER (WHERE leg = 'dense') AS dense_score
              FROM legs GROUP BY query_id, passage_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM fused)"""
    if rung in ("R3", "R6n"):
        return f"{fused} SELECT query_id, passage_id, round(score, 6) AS score, bm25_rank, bm25_score, dense_rank, dense_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"
    return fused + r""",
    body_words AS (SELECT passage_id, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) AS k FROM lines),
    asked_words AS (SELECT doc_id AS query_id, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) AS k FROM lines WHERE ordinal = 0),
    pairs AS (SELECT ranked.*, rank <= 10 AS head, CASE WHEN rank <= 10 THEN CAST(len(list_intersect(asked_words.k, body_words.k)) AS DOUBLE) ELSE score END AS s
              FROM ranked JOIN asked_words USING (query_id) JOIN body_words USING (passage_id) WHERE rank <= 40),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, CASE WHEN head THEN s END DESC, CASE WHEN head THEN passage_id ELSE rank END) AS place FROM pairs)
    SELECT query_id, passage_id, CAST(place AS INTEGER) AS rank, round(s, 6) AS score, bm25_rank, bm25_score, dense_rank, dense_score FROM placed WHERE place <= 10"""


for _rung in ("R2", "R3", "R4", "R5", "R6", "R6n"):
    query(f"q13_rung_{_rung.lower()}", ladder_sql(_rung))(rung_query(_rung))
for _rung in ("R7", "R7n"):
    query(f"q13_rung_{_rung.lower()}")(deal_rung_query(_rung))
query("q13_rung_r1", f"WITH {LINES}, {TOKENS} {bm25_sql(OWN_QUESTIONS, scoped=True)}")(rung_query("R1"))


@query("q13_expanded_bm25", f"WITH {LINES}, {EXPANDED}, {EXPANDED_TOKENS} {bm25_sql(QUESTIONS)}")
def expanded_bm25(t):
    """BM25 over passages joined with their definitions."""
    return rounded(search_index(expanded_index(t), questions(t)))


def long_line_hits(t, k=10):
    """A document's longest lines as its question's hits."""
    from spanlake.operators.search import top_k

    p = lines(t).select(F.col("doc_id").alias("query_id"), "passage_id", F.length("body").cast("double").alias("score"))
    return top_k(p, ["query_id"], k)


def amended_lines(t):
    """The first two lines of every labelled document are replaced by its last line, filed by class."""
    ln = lines(t)
    last = ln.groupBy("doc_id").agg(F.max_by("body", "ordinal").alias("amend_text"))
    rows = ln.where("ordinal < 2").join(t.labels, "doc_id").join(last, "doc_id")
    return rows.select(
        "passage_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("amendment_id"),
        (F.col("quality") + 1).cast("long").alias("amendment_no"),
        F.when(F.col("toxic") == 1, "2020-01-01").otherwise("2021-01-01").alias("file_date"), "amend_text",
    )


CONTEXT = f"""
    {LINE_DEFS}, {USED}, {PASSAGE_DEFS},
    hits AS (SELECT * FROM (SELECT doc_id AS query_id, passage_id, CAST(length(body) AS DOUBLE) AS score,
                                   row_number() OVER (PARTITION BY doc_id ORDER BY length(body) DESC, passage_id) AS rank FROM lines) WHERE rank <= 10),
    lastl AS (SELECT doc_id, arg_max(body, ordinal) AS amend_text FROM lines GROUP BY doc_id),
    amended AS (SELECT passage_id, 'a' || CAST(doc_id AS VARCHAR) AS amendment_id, quality + 1 AS amendment_no,
                       CASE WHEN toxic = 1 THEN '2020-01-01' ELSE '2021-01-01' END AS file_date, amend_text
                FROM lines JOIN labels USING (doc_id) JOIN lastl USING (doc_id) WHERE ordinal < 2),
    dg AS (SELECT passage_id, count(*) AS nd, string_agg(def_text, chr(10) || chr(10) ORDER BY rank) AS d,
                  string_agg(def_text, chr(10) ORDER BY rank) AS dl, string_agg(term, ', ' ORDER BY rank) AS dterms FROM pdefs GROUP BY 1),
    shown AS (SELECT h.query_id, h.rank, h.passage_id, l.body, nd, d, dl, amendment_id, amendment_no, file_date, amend_text
              FROM hits h JOIN lines l USING (passage_id) LEFT JOIN dg USING (passage_id) LEFT JOIN amended USING (passage_id) WHERE rank <= 5)
"""


@query(
    "q14_hit_context",
    f"""WITH {LINES}, {CONTEXT}
    SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, CAST(1 + coalesce(nd, 0) + (amend_text IS NOT NULL)::INT AS INTEGER) AS n_parts,
           md5(body || coalesce(chr(10) || chr(10) || d, '') || coalesce(chr(10) || chr(10) || '[Amended by Amendment No. ' || amendment_no::VARCHAR
               || ', filed ' || file_date || ']' || chr(10) || amend_text, '')) AS shown_md5 FROM shown""",
)
def hit_context(t):
    p = line_passages(t)
    c = C.hit_context(long_line_hits(t), p, D.passage_definitions(p, line_definitions(t)), amended_lines(t))
    return c.select(
        "query_id", "rank", "passage_id", F.size("parts").alias("n_parts"), F.md5(C.shown_text(F.col("parts"))).alias("shown_md5")
    )


@query(
    "q14_touched_amendments",
    f"""WITH {LINES}, {CONTEXT}, f AS (SELECT query_id, amendment_id, min(rank) AS r FROM shown WHERE amendment_id IS NOT NULL GROUP BY ALL)
    SELECT query_id, amendment_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS INTEGER) AS position FROM f""",
)
def touched(t):
    return C.touched_amendments(long_line_hits(t), amended_lines(t))


@query(
    "q15_search_listing",
    f"""WITH {LINES}, {CONTEXT}
    SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, score, l.source || '/' || l.lang AS target, 'https://x.example/' || l.doc_id AS link,
           'Line ' || l.ordinal AS section_path, md5(l.body) AS body_md5, coalesce(dterms, '') AS definitions
    FROM hits JOIN lines l USING (passage_id) LEFT JOIN dg USING (passage_id)""",
)
def listing(t):
    p = line_passages(t).withColumn("contract_id", F.col("doc_id")).withColumn(
        "section_path", F.concat(F.lit("Line "), F.col("ordinal").cast("string"))
    )
    deals = t.documents.select(
        F.col("doc_id").alias("contract_id"), F.concat_ws("/", "source", "lang").alias("target"),
        F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("link"),
    )
    out = C.search_listing(long_line_hits(t), p, D.passage_definitions(p, line_definitions(t)), deals)
    return out.select(
        "query_id", "rank", "passage_id", "score", "target", "link", "section_path", F.md5("body").alias("body_md5"), "definitions"
    )


TEMPLATE = "Question: {question}\n\nPassages:\n{passages}\n{choices}Reply with one JSON object.\n"
CHOICES = "Choose one:\n{options}\n"


@query(
    "q16_prompts",
    f"""WITH {LINES}, {CONTEXT},
    b AS (SELECT query_id, string_agg('[P' || rank || '] Line' || chr(10) || body
            || coalesce(chr(10) || 'Definitions used:' || chr(10) || dl, '')
            || coalesce(chr(10) || '[Amended by Amendment No. ' || amendment_no::VARCHAR || ']' || chr(10) || amend_text, ''),
            chr(10) || chr(10) ORDER BY rank) AS blocks FROM shown GROUP BY query_id),
    p AS (SELECT query_id, 'Question: ' || trim(o.body) || chr(10) || chr(10) || 'Passages:' || chr(10) || blocks || chr(10)
            || CASE WHEN o.lang = 'en' THEN 'Choose one:' || chr(10) || '- yes' || chr(10) || '- no' || chr(10) ELSE '' END
            || 'Reply with one JSON object.' || chr(10) AS prompt
          FROM b JOIN lines o ON o.doc_id = query_id AND o.ordinal = 0)
    SELECT query_id, CAST(length(prompt) AS INTEGER) AS n_chars, substring(sha1(prompt), 1, 12) AS prompt_sha FROM p""",
)
def prompts(t):
    p = line_passages(t)
    blocks = C.hit_context(long_line_hits(t), p, D.passage_definitions(p, line_definitions(t)), amended_lines(t))
    blocks = blocks.withColumn("section_path", F.lit("Line"))
    none = F.array().cast("array<string>")
    q = lines(t).where("ordinal = 0").select(
        F.col("doc_id").alias("query_id"), F.col("body").alias("question"),
        F.when(F.col("lang") == "en", F.array(F.lit("yes"), F.lit("no"))).otherwise(none).alias("choices"),
    )
    out = C.render_prompts(q, blocks, TEMPLATE, CHOICES)
    return out.select("query_id", F.length("prompt").alias("n_chars"), "prompt_sha")
