"""Queries whose results SQL can express: licences, mixing, URLs, filter interactions and fill-in-the-middle, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm import fill_in_middle, filter_audit, license_scan, mixing, url_filter
from spanlake.llm.registry import register

_TEMPLATES = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(license_scan.TEMPLATES))
_PLACES = " UNION ALL ".join(
    "SELECT r, i - 1 AS place, '{1}' AS label FROM words, unnest(range(1, n - {2})) AS u(i) WHERE {0}".format(
        " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split())), label, len(phrase.split()) - 2
    )
    for phrase, label in license_scan.PHRASES
)


@register(
    "op4_license_scan",
    "documents",
    rf"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}') AS low FROM documents),
    words AS (SELECT r, doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, len(regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n FROM docs),
    places AS ({_PLACES}),
    base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
    tokens AS (SELECT id, label, regexp_extract_all(lower(text), '[a-z0-9]+') AS tw FROM (VALUES {_TEMPLATES}) AS t(id, label, text)),
    templates AS (SELECT id, label, list_distinct(tw) AS wanted, len(tw) + ceil(len(tw) / 4)::BIGINT AS width, ceil(0.9 * len(list_distinct(tw)) - 1e-9) AS need FROM tokens),
    marked AS (SELECT r, regexp_replace(regexp_replace(low, '([.!?])[\t\n\x0B\f\r ]+', '\1' || chr(30), 'g'), '\n[\t\n\x0B\f\r ]*\n', chr(30), 'g') AS low FROM docs),
    blocks AS (SELECT DISTINCT r, unnest(string_split(low, chr(30))) AS block FROM marked),
    sets AS (SELECT r, regexp_extract_all(block, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS bw FROM blocks WHERE block <> ''),
    near AS (SELECT r, label, wanted, width, need, bw FROM sets, templates WHERE len(list_intersect(list_distinct(bw), wanted)) >= need),
    held AS (SELECT r, label, wanted, need, list_max([len(list_intersect(bw[i:i + width - 1], wanted)) FOR i IN range(1, len(bw) + 1)]) AS h FROM near),
    met AS (SELECT r, label, h / len(wanted) AS c FROM held WHERE h >= need),
    found AS (SELECT r, max(c) AS c FROM met GROUP BY r),
    both_labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM met) GROUP BY r)
    SELECT doc_id, n AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
    FROM words LEFT JOIN base USING (r) LEFT JOIN both_labels USING (r) LEFT JOIN found USING (r)
    """,
)
def op4(documents: DataFrame) -> DataFrame:
    """Licence phrases and notices of every document."""
    found = license_scan.scan(documents)
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.concat_ws(",", "phrase_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
    )


@register(
    "op6_mixing",
    "documents",
    r"""
    WITH docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
        FROM documents),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
    weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sizes),
    leveled AS (
        SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER before_it, 0)) / sum(weight) OVER from_it AS level
        FROM weighed
        WINDOW before_it AS (ORDER BY source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            from_it AS (ORDER BY source_size / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    water AS (SELECT min_by(level, source_size / weight) AS water FROM leveled WHERE level * weight <= 3.0::DOUBLE * source_size),
    goals AS (SELECT source, source_size, least(water * weight, 3.0::DOUBLE * source_size) AS target FROM leveled, water),
    rests AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goals),
    summed AS (
        SELECT docs.*, source_size, target, epochs, target - epochs * source_size AS rest,
            sum(size) OVER (PARTITION BY docs.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM docs JOIN rests ON docs.source IS NOT DISTINCT FROM rests.source),
    cuts AS (SELECT *, upto - sum(size) OVER (PARTITION BY source, h) AS under, row_number() OVER (PARTITION BY source, h) AS number FROM summed)
    SELECT doc_id, size, source_size, target,
        (size * (epochs + CASE WHEN size > 0 AND (upto <= rest OR (under <= rest AND number <= floor((rest - under) / size + 0.5))) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM cuts
    """,
)
def op6(documents: DataFrame) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(documents, keep=["doc_id"]).select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_PATTERNS = ", ".join(f"('{p.name}', '{p.regex}', '{p.verdict}')" for p in url_filter.PATTERNS)
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)


@register(
    "op10_url_filter",
    "pages",
    rf"""
    WITH urls AS (
        SELECT row_number() OVER () AS r, page_id, lower(url) AS low,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    rules AS (SELECT * FROM (VALUES {_RULES}) AS t(h, p, v)),
    fits AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM urls, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
    patterns AS (SELECT * FROM (VALUES {_PATTERNS}) AS t(name, regex, v)),
    met AS (SELECT r, min(name) AS pattern, arg_min(v, name) AS pv FROM urls, patterns WHERE regexp_matches(low, regex) GROUP BY r)
    SELECT page_id, host, path, rule, pattern, coalesce(v, pv, 'allow') AS verdict FROM urls LEFT JOIN fits USING (r) LEFT JOIN met USING (r)
    """,
)
def op10(pages: DataFrame) -> DataFrame:
    """Verdict of every page's URL."""
    return url_filter.judge(pages, RULES)


@register(
    "op11_filter_audit",
    "documents labels",
    r"""
    WITH docs AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    failing AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
        FROM docs LEFT JOIN marks USING (doc_id)),
    sets AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY part, failed),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (
        SELECT filter_order, step::INTEGER AS step, filter_order[step] AS f, '[' || filter_order[1:step] || ']' AS upto, CASE WHEN step > 1 THEN '[' || filter_order[1:step - 1] || ']' ELSE '[-]' END AS before
        FROM orders, unnest(range(1, 6)) AS u(step)),
    counted AS (
        SELECT part, filter_order, step, f,
            sum(n) FILTER (NOT regexp_matches(failed, upto)) AS kept,
            sum(n) FILTER (contains(failed, f) AND NOT regexp_matches(failed, before)) AS removed,
            sum(n) FILTER (contains(failed, f) AND regexp_matches(failed, before)) AS redundant,
            sum(n) FILTER (failed = f) AS unique_fails,
            sum(good) FILTER (contains(failed, f) AND NOT regexp_matches(failed, before)) AS good_lost,
            sum(toxic) FILTER (contains(failed, f) AND NOT regexp_matches(failed, before)) AS toxic_lost
        FROM sets, steps GROUP BY ALL)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
        coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
        coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
    FROM counted
    """,
)
def op11(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters remove from each source, in every order of them."""
    return filter_audit.audit(documents, labels)


@register(
    "op12_fill_in_middle",
    "documents",
    r"""
    WITH docs AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
            sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
        FROM documents),
    drawn AS (
        SELECT *, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
            CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM docs),
    parts AS (
        SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s
        FROM drawn)
    SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op12(documents: DataFrame) -> DataFrame:
    """Every document in its fill-in-the-middle form, and the text rebuilt from that form."""
    made = fill_in_middle.transform(documents)
    rebuilt = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))
