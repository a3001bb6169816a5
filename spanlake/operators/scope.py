"""Query rewriting by a lexicon and scoping of questions to the deal they name."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import has_phrase, name_tokens
from spanlake.operators.phrases import phrase_matches
from spanlake.session import cut_lineage

# Corporate suffixes that follow a name, and how often a word must occur to be ordinary.
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "ltd", "limited", "llc", "plc", "s")
COMMON_MIN_PASSAGES = 100


def rewrite(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Queries with the mapped terms of every lexicon phrase they hold appended.

    Phrases are taken longest first; a term already in the query or already appended is skipped.
    `lexicon` has (phrase, pos, term); queries meet phrases by an equi-join on word windows. A phrase brings its terms as one list, and only those that
    stand in the query at all are looked at for what touches their ends.
    """
    q = queries.withColumn("_low", F.lower("text"))
    entries = lexicon.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("_entries"))
    hit = phrase_matches(q.select("query_id", "_low"), "_low", entries.select("phrase"), "phrase", keep=["query_id", "_low"])
    low = F.col("_low")
    new = F.filter("_entries", lambda e: ~(F.contains(low, F.lower(e["term"])) & has_phrase(low, e["term"])))
    extra = hit.join(entries, "phrase").select("query_id", F.struct((-F.length("phrase")).alias("shorter"), "phrase", new.alias("new")).alias("_hit"))
    found = extra.groupBy("query_id").agg(F.sort_array(F.collect_list("_hit")).alias("_found"))
    every = F.flatten(F.transform("_found", lambda f: F.transform(f["new"], lambda e: F.struct(f["shorter"], f["phrase"], e["pos"], e["term"].alias("term")))))
    listed = found.select("query_id", F.sort_array(every).alias("_e"))
    appended = F.array_join(F.array_distinct(F.col("_e.term")), " ")
    out = queries.join(listed, "query_id", "left")
    return out.withColumn("text", F.when(F.coalesce(F.size("_e"), F.lit(0)) > 0, F.concat_ws(" ", "text", appended)).otherwise(F.col("text"))).drop("_e")


# A word of a name is a run of letters and digits with a capital in front, or of capitals and digits only. What stands before it belongs to the match where the word is
# doubtful: it opens a sentence (or the text, which gets a line feed in front), has a small letter, and no corporate suffix follows.
_AFTER = r"[^A-Za-z0-9&]*+(?i:" + "|".join(s for s in SUFFIXES if s != "s") + r")(?![A-Za-z0-9])"
_OPENS = r"(?:[.?!:]\s*+|\A\s++)[\u0085  ]?+"
_CAPITAL = r"(?:[A-Z][A-Za-z0-9]*+|[0-9]++[A-Z][A-Z0-9]*+(?![a-z]))"
_NAME_WORD = rf"(?:{_OPENS}(?=[A-Z][A-Z0-9]*+[a-z][A-Za-z0-9]*+(?!{_AFTER})))?+(?<![A-Za-z0-9]){_CAPITAL}"


def common_tokens(term_df: DataFrame) -> DataFrame:
    """Ordinary words: tokens in at least a hundred passages. `term_df` is (term, df)."""
    return term_df.where(F.col("df") >= COMMON_MIN_PASSAGES).select(F.col("term").alias("token"))


def name_positions(queries: DataFrame, common: DataFrame | None) -> DataFrame:
    """(query_id, token) words that read as a name: capitalised, and not just an ordinary word opening a sentence."""
    found = F.array_distinct(F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit(_NAME_WORD), F.lit(0)))
    w = queries.select("query_id", F.explode(found).alias("_found")).select(
        "query_id", F.lower(F.regexp_extract("_found", "[A-Za-z0-9]+$", 0)).alias("token"), (~F.col("_found").rlike("^[A-Za-z0-9]")).alias("_doubtful")
    )
    if common is not None:
        ordinary = cut_lineage(common.select("token", F.lit(True).alias("_ordinary")).distinct())
        w = w.join(ordinary, "token", "left").where(~F.col("_doubtful") | F.col("_ordinary").isNull())
    return w.select("query_id", "token").distinct()


def _token_windows(tokens: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))


def alias_names(aliases: DataFrame) -> DataFrame:
    """(alias, kind, words, contract_id) with aliases as token strings, each row once."""
    tok = name_tokens(F.col("alias"))
    a = aliases.select(F.array_join(tok, " ").alias("alias"), "kind", F.size(tok).alias("words"), "contract_id")
    return a.where("words > 0").distinct()


def alias_hits(queries: DataFrame, names: DataFrame, common: DataFrame | None) -> DataFrame:
    """(query_id, kind, words, alias) for every alias a question names, by token-window equality.

    `names` has one row per (alias, kind), so a name that a third of all deals share is still one row here.
    """
    sizes = sorted(r[0] for r in names.select("words").distinct().collect())
    cols = ["query_id", "kind", "words", "alias"]
    if not sizes:
        return names.withColumn("query_id", F.lit(None)).select(cols).where(F.lit(False))
    single = name_positions(queries, common).withColumnRenamed("token", "alias")
    short = single.join(names.where("words = 1"), "alias").select(cols)
    long_sizes = [n for n in sizes if n > 1]
    if not long_sizes:
        return short
    q = queries.select("query_id", name_tokens(F.col("text")).alias("_q"))
    windows = F.concat(*[_token_windows(F.col("_q"), n) for n in long_sizes])
    grams = q.select("query_id", F.explode(F.array_distinct(windows)).alias("alias"))
    return grams.join(names.where("words > 1"), "alias").select(cols).unionByName(short)


def resolve(queries: DataFrame, aliases: DataFrame, common: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The deal each question names, and the candidates it could be.

    Targets beat parents and the longest alias wins; several deals leave the question ambiguous (null contract).
    Returns (query_id, contract_id, alias, n_candidates) for every query, and its best aliases as (query_id, alias, kind,
    n_deals), one row each; `alias_names` lists an alias's deals, and only a reader that wants the pairs joins the two.
    Contracts with the same names of one rank are one class with a count, and a question meets the classes of its best aliases, so an alias
    that a third of all deals share is one row for each different set of names beside it, not one for each deal.
    """
    links = cut_lineage(alias_names(aliases))
    names = links.groupBy("alias", "kind", "words").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((F.col("kind") == "target").cast("int").alias("t"), F.col("words"))
    bearers = links.groupBy("contract_id", rank.alias("_rank")).agg(F.array_sort(F.collect_list(F.struct("alias", "kind"))).alias("_names"))
    classes = bearers.groupBy("_rank", "_names").agg(F.count(F.lit(1)).alias("_n"), F.min("contract_id").alias("_one"))
    classes = cut_lineage(classes.select("_names", F.monotonically_increasing_id().alias("_class"), "_n", "_one"))
    classes = classes.select(F.explode("_names").alias("_name"), "_class", "_n", "_one")
    classes = classes.select("_name.alias", "_name.kind", "_class", "_n", "_one")
    hits = alias_hits(queries, names.select("alias", "kind", "words"), common).where("query_id IS NOT NULL")
    best = hits.withColumn("_best", F.max(rank).over(Window.partitionBy("query_id"))).where(rank == F.col("_best"))
    top = cut_lineage(best.select("query_id", "alias", "kind"))
    met = top.join(classes, ["alias", "kind"])
    met = met.groupBy("query_id", "_class").agg(F.min("alias").alias("alias"), F.first("_n").alias("_n"), F.first("_one").alias("_one"))
    found = met.groupBy("query_id").agg(F.min("alias").alias("alias"), F.sum("_n").alias("n_candidates"), F.min("_one").alias("_one"))
    out = queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.when(F.col("n_candidates") == 1, F.col("_one")).alias("contract_id"), "alias",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )
    return out, top.join(names, ["alias", "kind"]).select("query_id", "alias", "kind", F.col("n").alias("n_deals"))


_WORD = re.compile("[A-Za-z0-9]+|&")


@lru_cache(maxsize=65536)
def _name_pattern(alias: str) -> re.Pattern | None:
    """A pattern for the alias's words in a row and the suffixes behind them; a one-word alias must be capitalised."""
    def word(w):
        whole = rf"(?<![a-z0-9]){w}(?![a-z0-9])"
        return rf"(?:{whole}|&)" if w == "and" else whole

    words = ["and" if w == "&" else w.lower() for w in _WORD.findall(alias)]
    if not words:
        return None
    capital = r"(?=(?-i:[A-Z]|[A-Z0-9]*[A-Z][A-Z0-9]*(?![A-Za-z0-9])))" if len(words) == 1 else ""
    gap = "[^a-z0-9&]*"
    suffixes = rf"(?:{gap}(?<![a-z0-9])(?:{'|'.join(SUFFIXES)})(?![a-z0-9]))*"
    return re.compile(capital + gap.join(map(word, words)) + suffixes, re.I | re.A)


def drop_name(question: str, alias: str) -> str:
    """The question's words without each run of the alias and the corporate suffixes right after it.

    A one-word alias goes only where it is capitalised. The question is unchanged when the alias is absent or
    nothing else would be left.
    """
    pattern = _name_pattern(alias)
    if pattern is None:
        return question
    rest = _WORD.findall(pattern.sub(" ", question))
    return " ".join(rest) if rest and len(rest) < len(_WORD.findall(question)) else question


@F.pandas_udf(T.StringType())
def strip_aliases(questions: pd.Series, aliases: pd.Series) -> pd.Series:
    """Each question without the given aliases, in the order given."""

    def one(q, names):
        for a in names if names is not None else ():
            q = drop_name(q, a) if a is not None else q
        return q

    return pd.Series([one(q, a) for q, a in zip(questions, aliases)])


def scope_questions(queries: DataFrame, aliases: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Every question with the deal it is about and the text to search with.

    A picked deal (`picked`, nullable) is kept and all its aliases dropped, longest first; otherwise the resolver
    decides and only the alias it matched is dropped, when it found exactly one deal.
    """
    picked = queries.where(F.col("picked").isNotNull())
    names = aliases.join(picked.select(F.col("picked").alias("contract_id")).distinct(), "contract_id", "left_semi")
    listed = names.groupBy("contract_id").agg(
        F.array_sort(F.collect_set(F.struct((-F.length("alias")).alias("shorter"), "alias"))).alias("_a")
    )
    by_pick = picked.join(listed.withColumnRenamed("contract_id", "picked"), "picked", "left").select(
        "query_id", F.col("picked").alias("contract_id"), F.lit(None).cast("string").alias("alias"),
        F.lit(0).cast("long").alias("n_candidates"),
        strip_aliases(F.col("text"), F.col("_a.alias")).alias("text"),
    )
    open_ = queries.where(F.col("picked").isNull())
    found, _ = resolve(open_, aliases, common)
    text = F.when(
        F.col("contract_id").isNotNull(), strip_aliases(F.col("text"), F.array("alias"))
    ).otherwise(F.col("text"))
    by_name = open_.join(found, "query_id").select("query_id", "contract_id", "alias", "n_candidates", text.alias("text"))
    return by_pick.unionByName(by_name)
