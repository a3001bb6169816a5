"""Defined terms: extraction, definition spans, use in passages, vocabulary.

Marks in a text (quoted terms, stops, sentence ends) are rows with positions; a definition's bounds are the nearest marks around a term, and its text is
joined from the blocks of the document that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.spans import many_places, span_texts
from spanlake.functions.text import WS, split_of
from spanlake.operators.phrases import phrase_matches
from spanlake.session import cut_lineage

# How an agreement defines a term, and where a definition ends.
QUOTED = "[“\"]([A-Z][^”\"\n]{1,80})[”\"]"
STYLES = {
    "means": QUOTED + WS + r"+(?:means|shall mean)\b",
    "xref": QUOTED + WS + r"+(?:has the meaning|shall have the meaning)\b",
    "paren": r"\((?:the|each,? an?|collectively,? the|together,? the)?" + WS + "*" + QUOTED + r"\)",
}
MEANS_END = rf"\n{WS}*\n|\n{WS}*[“\"][A-Z]"
NEXT_DEF = QUOTED + WS + r"+(?:means|shall mean|has the meaning|shall have the meaning)\b"
SENTENCE_END = rf"(?<=[.;]){WS}|\n{WS}*\n"
MAX_DEF_CHARS = 800
MAX_DEFS = 6
UBIQUITY = 0.2
TOP_TERMS = 400

# A stop with the white space before it, so that a definition ends at its last character. Looked at first: no visible ASCII
# character but a quote stands there, nor after one space.
STOP = rf"(?=\x20?+[^!#-~])(?!\A)(?<!{WS}){WS}*(?={MEANS_END}|{NEXT_DEF})"


def _nearest(terms: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, name: str, ahead: bool) -> DataFrame:
    """`terms` with `name`: the nearest `mark` at or after column `at`, or at or before it."""
    ord_ = Window.partitionBy(*keys).orderBy("_ord")
    span = ord_.rangeBetween(0, Window.unboundedFollowing) if ahead else ord_.rangeBetween(Window.unboundedPreceding, 0)
    rows = terms.withColumns({"_ord": F.col(at), "_mark": F.lit(None).cast("long")}).unionByName(
        marks.select(*keys, F.col(mark).alias("_ord"), F.col(mark).alias("_mark")), allowMissingColumns=True
    )
    found = (F.min if ahead else F.max)("_mark").over(span)
    return rows.withColumn(name, found).where("_mark IS NULL").drop("_ord", "_mark")


def extract_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, start, end, style, def_start, def_end, def_text): every quoted term with its place, style and, where it defines, its definition.

    A `means` definition runs from the term to the next stop, a `paren` one is the sentence around the term; both hold 800 characters at most. A
    cross-reference defines nothing here. The key tells texts apart; null texts have no term.
    """
    d = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), F.length(text).cast("long").alias("_size"))
    keys = [key, "_size"]
    patterns = {**{s: (p, 1) for s, p in STYLES.items()}, "stop": (STOP, 0), "break": (SENTENCE_END, 0)}
    places = cut_lineage(many_places(d, keys, "_text", patterns).select(*keys, "kind", "start", "end", F.when(F.col("kind").isin(*STYLES), F.col("label")).alias("label")))
    styled = [places.where(F.col("kind") == s).select(*keys, F.regexp_replace("label", f"{WS}+$", "").alias("term"), "start", "end", F.lit(s).alias("style")) for s in STYLES]
    means, xref, paren = styled
    stops, breaks = (places.where(F.col("kind") == kind).select(*keys, "start", "end") for kind in ("stop", "break"))
    means = _nearest(means, stops, keys, "end", "start", "stop", True)
    means = means.select(
        *means.columns[:-1], F.col("start").alias("def_start"), F.least(F.coalesce("stop", "_size"), F.col("start") + MAX_DEF_CHARS).alias("def_end")
    )
    paren = _nearest(paren, breaks, keys, "end", "start", "after", True)
    paren = _nearest(paren, breaks, keys, "start", "end", "before", False)
    low = F.greatest(F.lit(0).cast("long"), F.col("start") - MAX_DEF_CHARS, F.col("before"))
    high = F.coalesce("after", "_size")
    late = F.when(high - low > MAX_DEF_CHARS, F.greatest(low, F.col("end") - MAX_DEF_CHARS // 2)).otherwise(low)
    paren = paren.select(*xref.columns, late.alias("def_start"), F.least(high, late + MAX_DEF_CHARS).alias("def_end"))
    defined = span_texts(means.unionByName(paren), "def_start", "def_end", d, key, "_text", "def_text")
    return defined.unionByName(xref, allowMissingColumns=True).drop("_size")


def definitions(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """One definition per term and document: `means` before `paren`, then the earliest."""
    rank = F.when(F.col("style") == "means", 0).otherwise(1)
    best = (
        terms.where(F.col("style").isin("means", "paren"))
        .groupBy(key, "term")
        .agg(F.min_by(F.struct("style", "def_start", "def_end", "def_text"), F.struct(rank, "start")).alias("d"))
    )
    return best.select(key, "term", "d.*")


def term_places(passages: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """(passage_id, term, from, to): every occurrence of a document's terms in its passages, no letter or digit touching, overlaps included.

    Passages meet terms by a term's first word, and a passage's text travels only to the terms whose first word it holds. A term without a letter or digit
    is not found.
    """
    word = F.lit("[A-Za-z0-9]+")
    names = defs.select(key, "term").distinct().withColumn("_word", F.regexp_extract("term", "[A-Za-z0-9]+", 0)).where("_word <> ''")
    held = passages.select(key, "passage_id", F.explode(F.array_distinct(F.regexp_extract_all("body", word, F.lit(0)))).alias("_word"))
    pairs = held.join(names, [key, "_word"]).select("passage_id", "term")
    quoted = F.concat(F.lit(r"\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    alone = F.concat(F.lit("(?=(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9]))"))
    at_start = F.regexp_like("body", F.concat(F.lit("^"), alone))
    sizes = F.transform(F.split("body", alone, F.lit(-1)), lambda x: F.length(x).cast("long"))  # cut before every occurrence but one at 0
    rows = pairs.join(passages.select("passage_id", "body"), "passage_id").select(
        "passage_id", "term", at_start.alias("_first"), F.posexplode(sizes).alias("_n", "_size")
    )
    past = Window.partitionBy("passage_id", "term").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.coalesce(F.sum("_size").over(past), F.lit(0).cast("long"))).where("_n > 0 OR _first")
    return rows.select("passage_id", "term", "from", (F.col("from") + F.length("term")).alias("to"))


def leftmost_longest(places: DataFrame, keys: list[str]) -> DataFrame:
    """The places (keys, term, from, to) kept when a text is read from the left, the longest is taken where several begin, and the next begins after it.

    Places that hang together by overlaps are one short list, decided on its own; the others stand alone.
    """
    order = Window.partitionBy(*keys).orderBy("from", F.desc("to"))
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = places.withColumn("_new", F.coalesce(F.col("from") >= reach, F.lit(True)).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = run.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct("from", (-F.col("to")).alias("_back"), "term"))).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.slice("_all", 1, 0).alias("kept"))
    taken = F.aggregate("_all", start, lambda s, p: F.when(
        p["from"] >= s["end"], F.struct((-p["_back"]).alias("end"), F.concat(s["kept"], F.array(p)).alias("kept"))
    ).otherwise(s))
    return listed.select(*keys, F.explode(taken["kept"]).alias("p")).select(*keys, "p.term", "p.from", (-F.col("p._back")).alias("to"))


def terms_used(passages: DataFrame, defs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Defined terms each passage uses, in order of use: one row per (passage, term). Of overlapping terms the leftmost, then the longest is used."""
    kept = leftmost_longest(term_places(passages, defs, key), ["passage_id"])
    first = kept.groupBy("passage_id", "term").agg(F.min("from").alias("_from"))
    rank = F.row_number().over(Window.partitionBy("passage_id").orderBy("_from")) - 1
    ranked = first.select("passage_id", "term", rank.alias("use_rank"))
    return passages.select(key, "passage_id", "start", "end", "kind").join(ranked, "passage_id").select(
        key, "passage_id", "start", "end", "kind", "use_rank", "term"
    )


def passage_definitions(passages: DataFrame, defs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Definitions attached to each indexed passage: at most six, in order of use.

    A term used in more than a fifth of its document's passages says nothing, and a term's own defining passage
    is not a use of it.
    """
    used = terms_used(passages, defs, key).join(defs.select(key, "term", "def_start", "def_end", "def_text"), [key, "term"])
    used = used.where(~((F.col("start") <= F.col("def_start")) & (F.col("def_start") < F.col("end"))))
    n = passages.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    uses = used.groupBy(key, "term").agg(F.count(F.lit(1)).alias("_uses"))
    rare = uses.join(n, key).where(F.col("_uses") / F.col("_n") <= UBIQUITY).select(key, "term")
    kept = used.where("kind <> 'toc'").join(rare, [key, "term"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("passage_id").orderBy("use_rank"))
    return (
        kept.withColumn("rank", (rank - 1).cast("long"))
        .where(F.col("rank") < MAX_DEFS)
        .select(key, "passage_id", "rank", "term", "def_start", "def_end", "def_text")
    )


def expand_passages(passages: DataFrame, passage_defs: DataFrame) -> DataFrame:
    """Passage text followed by its definitions, in rank order."""
    listed = passage_defs.groupBy("passage_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "def_text"))).alias("_defs")
    )
    body = F.concat_ws("\n\n", F.col("body"), F.col("_defs.def_text"))
    return passages.join(listed, "passage_id", "left").withColumn("body", body).drop("_defs")


def vocabulary(defs: DataFrame, key: str = "doc_id", top: int = TOP_TERMS) -> DataFrame:
    """The terms most tune-split documents define."""
    tune = defs.where(split_of(F.col(key)) == "tune").select(key, "term").distinct()
    return tune.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(top)


def validate_lexicon(entries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lexicon entries (phrase, pos, term) whose term occurs as a phrase in some tune-split text.

    Keys are trimmed, lower-cased and at least three characters; a term is listed once per phrase.
    """
    e = entries.select(F.lower(F.trim("phrase")).alias("phrase"), "pos", F.trim("term").alias("term")).where(
        (F.length("phrase") >= 3) & (F.length("term") > 0)
    )
    tune = docs.where(split_of(F.col(key)) == "tune").select(key, F.lower(text).alias("_text"))
    terms = e.select("term").distinct()
    found = phrase_matches(tune, "_text", terms, "term", keep=[]).select("term").distinct()
    return e.join(found, "term", "left_semi").groupBy("phrase", "term").agg(F.min("pos").alias("pos"))
