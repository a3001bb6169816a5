"""Evaluation items from label rows, outlines, two-annotator labels and answer sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import split_of
from spanlake.operators.alignment import choose_candidates, place_pieces, split_excerpts
from spanlake.operators.cleaning import first_by_hash
from spanlake.operators.intervals import merge_spans, overlap_join

# The tail of a label question's name, outline and labelling limits.
ANSWER_SUFFIX = r"(?i)[\s-]*\bAnswer\b.*$"
MIN_SECTIONS = 10
CHUNK = 6000
MAX_SECTIONS = 3
STATUSES = ("kept", "absent", "disagree", "one_found", "error")
MAX_OPTIONS = 10

# The lay questions, with and without the company's name.
TEMPLATES = {
    "equity_awards": "What happens to {target} employees' stock options and RSUs in the merger?",
    "termination_fee": "How much does {target} have to pay if the merger agreement is terminated?",
    "employee_benefits": "Will {target} employees keep their pay and benefits after the merger?",
}
BARE_TEMPLATES = {
    "equity_awards": "What happens to employees' stock options and RSUs in the merger?",
    "termination_fee": "How much does the company have to pay if the merger agreement is terminated?",
    "employee_benefits": "Will employees keep their pay and benefits after the merger?",
}
EARNOUT_TEMPLATE = (
    "Is any part of the price for {target} paid later as an earn-out, contingent value right or milestone payment?"
)
NOT_FILED = r"(?i)\b(?:isn't|is not|not) included\b"
SCHEDULE = r"(?i)\b(?:disclosure\s+(?:letter|schedule)|schedule)\b"


def item_queries(rows: DataFrame) -> DataFrame:
    """(contract_id, text_type, query, category): the type and its distinct question stems, sorted."""
    stem = F.regexp_replace("question", ANSWER_SUFFIX, "")
    g = rows.withColumn("_stem", stem).groupBy("contract_id", "text_type").agg(
        F.array_sort(F.collect_set(F.when(F.col("_stem") != F.col("text_type"), F.col("_stem")))).alias("_s"),
        F.min("category").alias("category"),
    )
    return g.select(
        "contract_id", "text_type", F.array_join(F.concat(F.array("text_type"), F.col("_s")), ". ").alias("query"), "category"
    )


def aligned_pieces(rows: DataFrame, docs: DataFrame, toc: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every piece of every distinct excerpt with its placement, and the short pieces left out."""
    keys = ["text_type", "excerpt", "piece_no"]
    ex = rows.select("contract_id", "text_type", F.sha1("text").alias("excerpt"), "text").dropDuplicates(
        ["contract_id", "text_type", "excerpt"]
    )
    ex = ex.join(docs.select("contract_id"), "contract_id", "left_semi")
    parts = split_excerpts(ex, ["contract_id", "text_type", "excerpt"])
    placed = place_pieces(parts.where(~F.col("is_short")), docs, keys, toc)
    return placed, parts.where("is_short")


def build_items(rows: DataFrame, docs: DataFrame, toc: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, gold spans, placements) from label rows: one item per contract and text type with gold."""
    placed, _ = aligned_pieces(rows, docs, toc)
    chosen = choose_candidates(placed, ["contract_id", "text_type", "excerpt"])
    gold = merge_spans(chosen.select("contract_id", "text_type", "start", "end"), ["contract_id", "text_type"])
    queries = item_queries(rows)
    items = queries.join(gold.select("contract_id", "text_type").distinct(), ["contract_id", "text_type"], "left_semi")
    named = F.concat_ws("|", F.col("contract_id").cast("string"), "text_type")
    return (
        items.withColumn("item_id", named).withColumn("split", split_of(F.col("contract_id"))),
        gold.withColumn("item_id", named),
        placed,
    )


def alignment_report(rows: DataFrame, docs: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """(counter, value): what became of label rows, items and pieces."""
    placed, short = aligned_pieces(rows, docs, toc)
    found = F.size("candidates") > 0
    p = placed.agg(
        F.count(F.lit(1)).alias("pieces"),
        F.count_if(F.col("status") == "exact").alias("pieces_exact"),
        F.count_if(F.col("status") == "anchored").alias("pieces_anchored"),
        F.count_if(F.col("status") == "none").alias("pieces_unaligned"),
        F.count_if(F.size("candidates") > 1).alias("pieces_ambiguous"),
        F.count_if(found & F.col("refused")).alias("pieces_toc_rescued"),
        F.count_if(~found & F.col("refused")).alias("pieces_toc_only"),
        F.count_distinct(F.when(found, F.struct("contract_id", "text_type"))).alias("items_scored"),
    )
    s = short.agg(F.count(F.lit(1)).alias("pieces_short"))
    groups = rows.select("contract_id", "text_type").distinct()
    known = docs.select("contract_id", F.lit(True).alias("_known"))
    r = rows.agg(F.count(F.lit(1)).alias("rows"))
    scored = placed.where(found).select("contract_id", "text_type", F.lit(True).alias("_scored")).distinct()
    g = groups.join(known, "contract_id", "left").join(scored, ["contract_id", "text_type"], "left").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("_known").isNull()).alias("items_missing_contract"),
        F.count_if(F.col("_known") & F.col("_scored").isNull()).alias("items_no_gold"),
    )
    parts = [x.unpivot([], x.columns, "counter", "value") for x in (p, s, r, g)]
    return reduce(DataFrame.unionByName, parts)


def outline(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(contract_id, position, section, start, end): runs of one section id, repeated ids numbered `#2`, `#3`.

    A contract with fewer than ten sections is outlined by 6,000-character chunks instead.
    `passages`: contract_id, ordinal, section_id, start, end; only these light columns are ordered.
    """
    w = Window.partitionBy("contract_id").orderBy("ordinal")
    p = passages.where("section_id <> ''").withColumn(
        "_new", F.coalesce((F.lag("section_id").over(w) != F.col("section_id")).cast("int"), F.lit(1))
    )
    p = p.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = p.groupBy("contract_id", "_run", "section_id").agg(F.min_by("start", "ordinal").alias("start"), F.max("end").alias("end"))
    nth = F.row_number().over(Window.partitionBy("contract_id", "section_id").orderBy("_run"))
    runs = runs.withColumn("_nth", nth)
    name = F.when(F.col("_nth") == 1, F.col("section_id")).otherwise(F.concat_ws("#", "section_id", F.col("_nth").cast("string")))
    n = runs.groupBy("contract_id").agg(F.count(F.lit(1)).alias("_sections"))
    whole = n.where(F.col("_sections") >= MIN_SECTIONS)
    by_section = runs.join(whole, "contract_id", "left_semi").select(
        "contract_id", F.col("_run").alias("position"), name.alias("section"), "start", "end", F.lit(False).alias("fallback")
    )
    rest = docs.where(F.length("text") > 0).join(whole, "contract_id", "left_anti")
    size = F.length("text").cast("long")
    at = rest.select("contract_id", size.alias("_n"), F.posexplode(F.expr(f"sequence(0L, cast(length(text) as bigint) - 1, {CHUNK}L)")).alias("i", "start"))
    by_chunk = at.select(
        "contract_id", (F.col("i") + 1).cast("long").alias("position"), F.concat(F.lit("C"), (F.col("i") + 1).cast("string")).alias("section"),
        "start", F.least(F.col("_n"), F.col("start") + CHUNK).alias("end"), F.lit(True).alias("fallback"),
    )
    return by_section.unionByName(by_chunk)


def section_key(raw: Column) -> Column:
    """A section id as the outline spells it: no leading word or sign, first token, no trailing period or colon."""
    t = F.regexp_replace(F.trim(raw), r"^(?:Section\s|section\s|SECTION\s|§)\s*", "")
    return F.regexp_replace(F.substring_index(F.trim(t), " ", 1), "[.:]+$", "")


def picked_sections(replies: DataFrame, outlines: DataFrame, topics: list[str]) -> DataFrame:
    """First replies read as labels: (contract_id, pass, topic, sections, unmatched, error).

    `replies`: contract_id, pass, result (a JSON object topic -> ids); `outlines`: contract_id, section. At most three
    matched sections are kept, unknown ids are counted, and a missing topic or all-unknown list is an error.
    """
    known = outlines.groupBy("contract_id").agg(F.collect_set("section").alias("_known"))
    body = F.when(F.try_parse_json("result").isNotNull(), F.col("result"))
    r = replies.join(known, "contract_id", "left").withColumn("_m", F.from_json(body, "map<string, array<string>>"))
    r = r.select("contract_id", "pass", "_known", "_m", F.explode(F.array(*[F.lit(x) for x in topics])).alias("topic"))
    raw = F.try_element_at("_m", F.col("topic"))
    ids = F.array_distinct(F.filter(F.transform(raw, section_key), lambda x: x != ""))
    matched = F.filter(ids, lambda x: F.array_contains("_known", x))
    r = r.withColumn("_raw", raw).withColumn("_ids", ids).withColumn("_hit", matched)
    return r.select(
        "contract_id", "pass", "topic",
        F.coalesce(F.slice("_hit", 1, MAX_SECTIONS), F.array().cast("array<string>")).alias("sections"),
        F.coalesce(F.size("_ids") - F.size("_hit"), F.lit(0)).alias("unmatched"),
        (F.col("_raw").isNull() | ((F.size("_raw") > 0) & (F.size("_hit") == 0))).alias("error"),
    )


def read_labels_step(picked: DataFrame, replies: DataFrame) -> DataFrame:
    """Second replies read as labels: adds found, quotes (three at most), answer; a shown topic left out is an error.

    `replies`: contract_id, pass, result (topic -> {found, quotes, answer}).
    """
    body = F.when(F.try_parse_json("result").isNotNull(), F.col("result"))
    parsed = replies.select(
        "contract_id", "pass", F.from_json(body, "map<string, struct<found: boolean, quotes: array<string>, answer: string>>").alias("_m")
    )
    j = picked.join(parsed, ["contract_id", "pass"], "left")
    got = F.try_element_at("_m", F.col("topic"))
    asked = F.size("sections") > 0
    return j.withColumn("_g", got).select(
        "contract_id", "pass", "topic", "sections", "unmatched",
        (F.col("error") | (asked & F.col("_g").isNull())).alias("error"),
        (~F.col("error") & F.coalesce(F.col("_g.found"), F.lit(False))).alias("found"),
        F.when(F.col("error"), F.array().cast("array<string>")).otherwise(
            F.coalesce(F.slice(F.col("_g.quotes"), 1, 3), F.array().cast("array<string>"))
        ).alias("quotes"),
        F.when(F.col("error"), "").otherwise(F.coalesce(F.col("_g.answer"), F.lit(""))).alias("answer"),
    )


def annotator_status(a: str, b: str) -> Column:
    """The status of two annotators' labels, each a struct column of error, found, spans and sections (of the spans)."""
    def col(side, f):
        return F.col(f"{side}.{f}")

    has = {s: col(s, "found") & (F.size(col(s, "spans")) > 0) for s in (a, b)}
    share = F.exists(
        col(a, "spans"), lambda x: F.exists(col(b, "spans"), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    )
    section = F.exists(col(a, "sections"), lambda s: (s != "") & F.array_contains(col(b, "sections"), s))
    return (
        F.when(col(a, "error") | col(b, "error"), "error")
        .when(~col(a, "found") & ~col(b, "found"), "absent")
        .when(~(has[a] & has[b]), "one_found")
        .when(share | section, "kept")
        .otherwise("disagree")
    )


def span_sections(spans: DataFrame, passages: DataFrame, keys: list[str]) -> DataFrame:
    """The section each span starts in: spans meet passages by contract and offset bin."""
    point = spans.withColumn("_p0", F.col("start")).withColumn("_p1", F.col("start") + 1)
    p = passages.select("contract_id", "section_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = overlap_join(point, p, ["contract_id"], ("_p0", "_p1"), ("_s", "_e"))
    return met.select("contract_id", *keys, "start", "end", "section_id")


def label_summary(rows: DataFrame) -> DataFrame:
    """Families by status, one column per status."""
    return rows.groupBy("family").pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).fillna(0)


def agreement_rates(summary: DataFrame) -> DataFrame:
    decided = F.col("kept") + F.col("disagree") + F.col("one_found")
    return summary.select("family", F.round(F.try_divide("kept", F.nullif(decided, F.lit(0))), 4).alias("agreement_rate"))


def choice_items(rows: DataFrame, indexed: DataFrame, max_options: int = MAX_OPTIONS) -> tuple[DataFrame, DataFrame]:
    """Multiple-choice items and their exclusion counts.

    One item per (contract, question) with exactly one answer, in an indexed contract, whose question has at most
    `max_options` different answers. Answers are reduced to distinct values before they are listed.
    """
    pairs = rows.groupBy("question", "answer").agg(F.count(F.lit(1)).alias("_n"))
    sizes = pairs.groupBy("question").agg(F.count(F.lit(1)).alias("n_options"))
    narrow = pairs.join(sizes.where(F.col("n_options") <= max_options), "question", "left_semi")
    options = narrow.groupBy("question").agg(F.array_sort(F.collect_list("answer")).alias("choices"))
    types = rows.groupBy("question").agg(F.max("text_type").alias("text_type"))
    asked = rows.groupBy("contract_id", "question").agg(
        F.min("answer").alias("expected"), (F.min("answer") != F.max("answer")).alias("_disputed"), F.max("category").alias("category")
    )
    known = indexed.select("contract_id", F.lit(True).alias("_known"))
    j = asked.join(sizes, "question").join(known, "contract_id", "left")
    why = (
        F.when(F.col("_known").isNull(), "not_indexed")
        .when(F.col("n_options") > max_options, "too_many_options")
        .when(F.col("_disputed"), "disputed")
        .otherwise("kept")
    )
    j = j.withColumn("outcome", why)
    stem = F.trim(F.regexp_replace("question", ANSWER_SUFFIX, ""))
    kind = F.trim("text_type")
    question = (
        F.when(stem == kind, F.col("text_type"))
        .when(F.startswith(F.lower(stem), F.lower(kind)), stem)
        .otherwise(F.concat_ws(": ", "text_type", stem))
    )
    items = (
        j.where("outcome = 'kept'").join(options, "question").join(types, "question").select(
            F.concat_ws("|", F.col("contract_id").cast("string"), "question").alias("item_id"), "contract_id", "category",
            split_of(F.col("contract_id")).alias("split"), question.alias("question_text"), "choices", "expected",
        )
    )
    return items, j.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def template_question(family: Column, target: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    out = F.lit(None).cast("string")
    for name, text in templates.items():
        out = F.when(family == name, F.replace(F.lit(text), F.lit("{target}"), target)).otherwise(out)
    return out


def kept_items(rows: DataFrame, bare: bool = False) -> DataFrame:
    """Rows both annotators agree on as questions that name the company, or not."""
    templates = BARE_TEMPLATES if bare else TEMPLATES
    return rows.where("status = 'kept'").select(
        F.concat_ws("|", F.col("contract_id").cast("string"), "family").alias("item_id"), "contract_id", F.col("family").alias("category"),
        template_question(F.col("family"), F.col("target"), templates).alias("question"),
    )


def absent_items(rows: DataFrame) -> DataFrame:
    """Rows both annotators found nothing for; those that say the text was not filed form their own group."""
    group = F.when(F.concat_ws(" ", "answer_a", "answer_b").rlike(NOT_FILED), "absent_not_filed").otherwise("absent")
    return rows.where("status = 'absent'").select(
        group.alias("abstain_group"), F.col("contract_id").cast("string").alias("subject"), "family",
        template_question(F.col("family"), F.col("target")).alias("question"), F.lit("not_stated").alias("expected"),
    )


def earnout_items(sample: DataFrame, deals: DataFrame) -> DataFrame:
    """Sampled deals without contingent consideration. `sample`: contract_id, present; `deals`: contract_id, target."""
    return sample.where(~F.col("present")).join(deals, "contract_id").select(
        F.lit("earnout").alias("abstain_group"), F.col("contract_id").cast("string").alias("subject"), F.lit("").alias("family"),
        F.replace(F.lit(EARNOUT_TEMPLATE), F.lit("{target}"), F.col("target")).alias("question"), F.lit("not_stated").alias("expected"),
    )


def name_items(resolved: DataFrame, group: str, n: int) -> DataFrame:
    """A stable sample of names the resolver cannot place (`unknown_deal`) or places twice (`ambiguous_deal`).

    `resolved`: name, question, family, contract_id, n_candidates.
    """
    ok = F.col("n_candidates") == 0 if group == "unknown_deal" else F.col("n_candidates") > 1
    pool = resolved.where(ok & (F.col("name") != "")).withColumn("abstain_group", F.lit(group))
    return first_by_hash(pool, ["abstain_group"], "name", n).select(
        "abstain_group", F.col("name").alias("subject"), "family", "question", F.lit("which_deal").alias("expected")
    )


def schedule_items(rows: DataFrame, gold: DataFrame, tagged: DataFrame) -> DataFrame:
    """Kept rows whose answers both point to a schedule and whose gold meets a passage that refers to one.

    `gold`: contract_id, family, g0, g1; `tagged`: contract_id, start, end.
    """
    both = F.col("answer_a").rlike(SCHEDULE) & F.col("answer_b").rlike(SCHEDULE)
    met = overlap_join(gold, tagged, ["contract_id"], ("g0", "g1"), ("start", "end")).select("contract_id", "family").distinct()
    return rows.where((F.col("status") == "kept") & both).join(met, ["contract_id", "family"], "left_semi").select(
        F.lit("schedule").alias("abstain_group"), F.col("contract_id").cast("string").alias("subject"), "family",
        template_question(F.col("family"), F.col("target")).alias("question"), F.lit("unfiled_schedule").alias("expected"),
    )


def scope_report(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolver outcomes by split. `items`: query_id, contract_id, split; `resolved`: query_id, contract_id, n_candidates."""
    got = resolved.select("query_id", F.col("contract_id").alias("_got"), "n_candidates")
    outcome = (
        F.when(F.col("_got") == F.col("contract_id"), "right")
        .when(F.col("_got").isNotNull(), "wrong")
        .when(F.col("n_candidates") > 0, "ambiguous")
        .otherwise("none")
    )
    judged = items.join(got, "query_id").withColumn("outcome", outcome)
    outcomes = ["right", "wrong", "ambiguous", "none"]
    return judged.groupBy("split").pivot("outcome", outcomes).agg(F.count(F.lit(1))).fillna(0)
