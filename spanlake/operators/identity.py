"""Deal identity: who the parties are, which filings are copies of one deal, and how a deal is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import company_norm, is_merger_agreement, split_of

# Technology industry codes, and how far a preamble reaches.
TECH_SIC = ((3570, 3579), (3661, 3679), (7370, 7379))
PREAMBLE_CHARS = 15000
DATE_REACH = 1500
FLAG_CHARS = 1500

# How an agreement's opening names its parties and its date.
MONTHS = "January February March April May June July August September October November December".split()
MONTH = "(" + "|".join(MONTHS) + ")"
# Words are taken for good: no word of a name can be the article that follows it, and a run of thousands of words given back one by one overflows the stack.
NAME = r"([A-Z0-9][\w.&+'’\-]*(?:,?\s+(?:[A-Z0-9&][\w.&+'’\-]*|of|and|de|la|the))*+)"
PARTY = (
    r"(?sU)" + NAME + r",?\s+(?:a|an)\s+[A-Za-z .’'\-]{0,80}?"
    r"(?:corporation|company|partnership|trust|N\.V\.|B\.V\.|S\.A\.|plc|Ltd\.?|limited)\b[^()“”\"]{0,120}?"
    "\\(\\s*(?:the\\s+)?[“\"]([A-Z][A-Za-z ]{1,40})[”\"][^()]*\\)"
)
COMPANY_ROLES = ("Company", "Target")
PARENT_ROLES = ("Parent", "Acquiror", "Acquirer", "Buyer", "Purchaser")
DATED_AS_OF = r"(?i)dated\s+as\s+of\s+" + MONTH + r"\s+(\d{1,2}),?\s+(\d{4})"
DATED = r"(?i)dated\s+(?:as\s+of\s+)?" + MONTH + r"\s+(\d{1,2}),?\s+(\d{4})"
DAY_OF = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+day\s+of\s+" + MONTH + r",?\s+(\d{4})"
ABBREVIATIONS = ("corp", "inc", "co", "ltd", "llc", "l.p", "lp", "n.v", "b.v", "s.a", "bros", "no")
PROSE_LEAD = (
    r"(?is)^.*(?:(?<!(?:^|[ ,])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"))\.\s+|[;:]\s+|"
    + MONTH + r"\s+\d{1,2},\s+\d{4},?\s+|\b(?:by\s+and\s+among|by\s+and\s+between|among|between)\s+)"
)
RESTATED = r"(?i)\bAmended\s+and\s+Restated\s+Agreement\s+and\s+Plan\s+of\s+Merger"
AMENDMENT = (
    r"(?i)\bAmendment\s+No\.?\s*\d|\b(?:First|Second|Third)\s+Amendment\b|"
    r"\bAmendment\s+to\s+(?:the\s+)?Agreement\s+and\s+Plan\s+of\s+Merger|"
    r"\bAmended\s+and\s+Restated\s+Agreement\s+and\s+Plan\s+of\s+Merger"
)

# Words no alias may be, the shortest alias, and the first signing date of the corpus.
ALIAS_STOP = ("the", "and", "inc", "corp", "group", "holdings", "company", "parent", "merger")
MIN_ALIAS = 4
CORPUS_START = "2015-01-01"


def _trim_name(name: Column) -> Column:
    """Prose before a party's name is cut off; a period after an abbreviation ends nothing."""
    return F.regexp_replace(F.regexp_replace(name, PROSE_LEAD, ""), "^[ ,]+|[ ,]+$", "")


def _date_in(text: Column) -> Column:
    def made(pattern, month, day):
        words = F.concat_ws(
            " ", F.initcap(F.lower(F.regexp_extract(text, pattern, month))), F.regexp_extract(text, pattern, day),
            F.regexp_extract(text, pattern, 3),
        )
        return F.try_to_date(words, "MMMM d yyyy")

    return (
        F.when(text.rlike(DATED_AS_OF), made(DATED_AS_OF, 1, 2))
        .when(text.rlike(DATED), made(DATED, 1, 2))
        .when(text.rlike(DAY_OF), made(DAY_OF, 2, 1))
    )


def preamble(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds company, parent, signed, amendment and restated, all read from the opening of each text.

    The signing date nearest the first party wins over a date elsewhere in the opening.
    """
    d = docs.withColumn("_head", F.substring(text, 1, PREAMBLE_CHARS))
    for n, g in (("_whole", 0), ("_names", 1), ("_roles", 2)):
        d = d.withColumn(n, F.regexp_extract_all("_head", F.lit(PARTY), F.lit(g)))
    d = d.withColumn("_roles", F.transform("_roles", lambda r: F.trim(r)))

    def named(roles):
        at = [F.nullif(F.array_position("_roles", r), F.lit(0)) for r in roles]
        return _trim_name(F.try_element_at("_names", F.coalesce(*at).cast("int")))

    first = F.position(F.get("_whole", F.lit(0)), F.col("_head")) - 1
    low = F.greatest(F.lit(0), first - DATE_REACH)
    near = F.when(F.size("_whole") > 0, F.substring("_head", low + 1, first + DATE_REACH - low)).otherwise(F.col("_head"))
    flags = F.substring("_head", 1, FLAG_CHARS)
    d = d.withColumn("_near", near)
    return (
        d.withColumn("company", named(COMPANY_ROLES))
        .withColumn("parent", named(PARENT_ROLES))
        .withColumn("signed", F.coalesce(_date_in(F.col("_near")), _date_in(F.col("_head"))))
        .withColumn("amendment", flags.rlike(AMENDMENT))
        .withColumn("restated", flags.rlike(RESTATED))
        .drop("_head", "_whole", "_names", "_roles", "_near")
    )


def is_tech(sic: Column) -> Column:
    n = F.trim(sic.cast("string")).try_cast("int")
    hit = F.lit(False)
    for lo, hi in TECH_SIC:
        hit = hit | n.between(lo, hi)
    return F.coalesce(hit, F.lit(False))


def any_tech(sics: Column) -> Column:
    return F.exists(sics, is_tech)


def display_norm(name: Column) -> Column:
    return company_norm(F.regexp_replace(name, r"\(.*?\)", " "))


def resolve_filer(company: Column, ciks: Column, names: Column) -> Column:
    """The one filer whose name equals the company's or shares a prefix of two or more words; else null.

    Lists of different length never resolve (see `lists_disagree`).
    """
    target = company_norm(company)

    def words(c):
        return F.size(F.split(c, " "))

    def same(z):
        n = display_norm(z["name"])
        short = F.when(words(n) <= words(target), n).otherwise(target)
        long_ = F.when(words(n) <= words(target), target).otherwise(n)
        prefix = F.startswith(long_, F.concat(short, F.lit(" "))) & (words(short) >= 2)
        return (n != "") & ((n == target) | prefix)

    hits = F.filter(F.arrays_zip(ciks.alias("cik"), names.alias("name")), same)
    usable = (F.size(ciks) == F.size(names)) & (target != "")
    return F.when(usable & (F.size(hits) == 1), F.get(hits, F.lit(0))["cik"])


def lists_disagree(ciks: Column, names: Column) -> Column:
    return F.size(ciks) != F.size(names)


def filer_codes(filings: DataFrame, registrants: DataFrame, key: str = "adsh") -> DataFrame:
    """Industry codes of every filing: its own when it lists one per filer, else the registrants'.

    `filings`: key, ciks, sics; `registrants`: cik, sic.
    """
    enough = (F.size("sics") > 0) & (F.size("sics") >= F.size("ciks"))
    lacking = filings.where(~enough).select(key, F.posexplode("ciks").alias("_i", "cik"))
    looked = lacking.join(registrants, "cik").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_i", F.coalesce("sic", F.lit("")).alias("sic")))).alias("_l")
    )
    codes = F.when(enough, F.col("sics")).otherwise(F.coalesce(F.col("_l.sic"), F.array().cast("array<string>")))
    return filings.join(looked, key, "left").withColumn("sics", codes).drop("_l")


def group_deals(docs: DataFrame, registrants: DataFrame) -> DataFrame:
    """Copies grouped into deals.

    `docs`: adsh, file_date, company, parent, signed, amendment, restated, target_cik. A deal's key is the normal
    company and parent names and the signing date; amendments are no deal of their own, unless they restate an
    agreement whose original is absent. Every part combines map-side, so a heavily copied deal costs one row a task.
    """
    d = docs.withColumn("target", company_norm(F.col("company"))).withColumn("acquirer", company_norm(F.col("parent")))
    keyed = d.where((F.col("company") != "") & (F.col("parent") != "") & F.col("signed").isNotNull())
    originals = keyed.where(~F.col("amendment"))
    pairs = originals.select("target", "acquirer").distinct()
    orphans = keyed.where(F.col("amendment") & F.col("restated")).join(pairs, ["target", "acquirer"], "left_anti")
    members = originals.withColumn("orphan", F.lit(False)).unionByName(orphans.withColumn("orphan", F.lit(True)))
    deals = members.groupBy("target", "acquirer", "signed").agg(
        F.min_by("adsh", F.struct("file_date", "adsh")).alias("canonical"),
        F.min("file_date").alias("file_date"),
        F.count(F.lit(1)).alias("copies"),
        F.min(F.when(F.col("target_cik").isNotNull(), F.struct("adsh", "target_cik")))["target_cik"].alias("target_cik"),
        (F.min("target_cik") != F.max("target_cik")).alias("_two"),
        F.max("orphan").alias("orphan_restated"),
    )
    amended = d.where(F.col("amendment") & (F.col("company") != "") & (F.col("parent") != "")).join(
        orphans.select("adsh"), "adsh", "left_anti"
    )
    n = amended.groupBy("target", "acquirer").agg(F.count(F.lit(1)).alias("amendments"))
    out = deals.join(n, ["target", "acquirer"], "left").join(
        registrants.select(F.col("cik").alias("target_cik"), F.col("sic").alias("target_sic")), "target_cik", "left"
    )
    return out.select(
        "target", "acquirer", "signed", "target_cik", "target_sic",
        (F.col("target_cik").isNotNull() & is_tech(F.col("target_sic"))).alias("tech"),
        "copies", F.coalesce("_two", F.lit(False)).alias("target_conflict"), "orphan_restated",
        F.coalesce("amendments", F.lit(0)).alias("amendments"), "canonical", "file_date",
    )


def contract_id_for(adsh: Column) -> Column:
    return F.concat(F.lit("edgar_"), F.replace(adsh, F.lit("-"), F.lit("")))


def assemble_corpus(deals: DataFrame, docs: DataFrame, start: str = CORPUS_START) -> tuple[DataFrame, DataFrame]:
    """The technology deals signed since `start` whose text is a merger agreement, with their amendments by date.

    `docs` also carries text. Returns the corpus and one row of counts. Titles are judged on the canonical texts
    only, and amendments are reduced per (target, acquirer) before they meet the deals.
    """
    wanted = deals.where(F.col("tech") & (F.col("signed") >= start))
    texts = docs.select(F.col("adsh").alias("canonical"), is_merger_agreement(F.col("text")).alias("is_merger"))
    judged = wanted.join(texts, "canonical", "left")
    amends = (
        docs.where(F.col("amendment") & (F.col("company") != "") & (F.col("parent") != ""))
        .groupBy(company_norm(F.col("company")).alias("target"), company_norm(F.col("parent")).alias("acquirer"))
        .agg(F.sort_array(F.collect_list(F.struct("file_date", contract_id_for(F.col("adsh")).alias("contract_id")))).alias("listed"))
    )
    corpus = (
        judged.where(F.coalesce("is_merger", F.lit(False)))
        .join(amends, ["target", "acquirer"], "left")
        .select(
            contract_id_for(F.col("canonical")).alias("contract_id"), "target", "acquirer", "target_cik", "signed",
            F.coalesce(F.size("listed"), F.lit(0)).cast("long").alias("n_amendments"),
            F.coalesce(F.array_join(F.col("listed.contract_id"), ","), F.lit("")).alias("amendment_ids"),
            split_of(contract_id_for(F.col("canonical"))).alias("split"),
        )
    )
    counts = judged.agg(
        F.count(F.lit(1)).alias("deals"),
        F.count_if(F.coalesce("is_merger", F.lit(False))).alias("kept"),
        F.count_if(~F.coalesce("is_merger", F.lit(False))).alias("excluded_not_merger"),
    )
    return corpus, counts


def aliases(target: Column, display_names: Column) -> Column:
    """How questions may name a deal: normal names without parentheses and state suffixes, and ticker symbols."""
    def shown(d):
        return company_norm(F.regexp_replace(d, r"\(.*?\)|/[A-Z]{2,3}/?", " "))

    def tickers(d):
        found = F.regexp_extract_all(d, F.lit(r"\(([A-Z][A-Z0-9.\-]{0,9})\)"), F.lit(1))
        return F.transform(F.filter(found, lambda x: ~x.startswith("CIK")), lambda x: F.lower(x))

    every = F.concat(
        F.array(company_norm(F.coalesce(target, F.lit("")))),
        F.flatten(F.transform(display_names, lambda d: F.concat(F.array(shown(d)), tickers(d)))),
    )
    return F.array_distinct(F.filter(every, lambda a: (F.length(a) >= MIN_ALIAS) & ~a.isin(*ALIAS_STOP)))


def alias_dimension(filed: DataFrame, labelled: DataFrame) -> DataFrame:
    """(alias, contract_id, kind) of both sources. `filed`: contract_id, aliases, parent; `labelled`: contract_id, company, parent."""
    def one(df, name, kind):
        return df.select(company_norm(F.col(name)).alias("alias"), "contract_id", F.lit(kind).alias("kind"))

    rows = (
        filed.select(F.explode("aliases").alias("alias"), "contract_id", F.lit("target").alias("kind"))
        .unionByName(one(filed, "parent", "parent"))
        .unionByName(one(labelled, "company", "target"))
        .unionByName(one(labelled, "parent", "parent"))
    )
    return rows.where(F.length("alias") >= MIN_ALIAS).distinct()


def cross_source_duplicates(filed: DataFrame, labelled: DataFrame) -> DataFrame:
    """(labelled_id, filed_id): labelled agreements that name a filed deal's target and parent; the smallest filed id is kept."""
    def keyed(df, company):
        k = df.select("contract_id", company_norm(F.col(company)).alias("target"), company_norm(F.col("parent")).alias("acquirer"))
        return k.where((F.col("target") != "") & (F.col("acquirer") != ""))

    first = keyed(filed, "target").groupBy("target", "acquirer").agg(F.min("contract_id").alias("filed_id"))
    return keyed(labelled, "company").join(first, ["target", "acquirer"]).select(
        F.col("contract_id").alias("labelled_id"), "filed_id"
    )


def month_windows(first_day: Column, last_day: Column) -> Column:
    """Calendar months from first to last day as (start, end) structs, the last one clipped."""
    months = F.sequence(F.trunc(first_day, "month"), last_day, F.expr("interval 1 month"))
    return F.transform(
        months,
        lambda m: F.struct(F.greatest(m, first_day).alias("start"), F.least(F.last_day(m), last_day).alias("end")),
    )


def split_windows(daily: DataFrame, windows: DataFrame, cap: int) -> DataFrame:
    """Windows (start, end) with their counts; a window at the cap is halved by date until it is under it or one day.

    `daily`: (day, n), one row per calendar day, so its running total is a small ordered table and a window's count
    is the difference of two of its rows. As many halvings are planned as the longest window needs to come down to a day.
    """
    longest = windows.agg(F.max(F.datediff("end", "start"))).first()[0] or 0
    rounds = longest.bit_length()
    upto = daily.select("day", F.sum("n").over(Window.orderBy("day")).alias("upto"))

    def counted(w):
        low = upto.select(F.date_add("day", 1).alias("start"), F.col("upto").alias("_low"))
        high = upto.select(F.col("day").alias("end"), F.col("upto").alias("_high"))
        joined = w.join(low, "start", "left").join(high, "end", "left")
        return joined.select("start", "end", (F.coalesce("_high", F.lit(0)) - F.coalesce("_low", F.lit(0))).alias("n"))

    out = counted(windows)
    for _ in range(rounds):
        over = (F.col("n") >= cap) & (F.col("start") < F.col("end"))
        mid = F.expr("date_add(start, cast(floor(datediff(`end`, start) / 2) as int))")
        halves = out.where(over).select(
            F.explode(
                F.array(
                    F.struct(F.col("start").alias("start"), mid.alias("end")),
                    F.struct(F.date_add(mid, 1).alias("start"), F.col("end").alias("end")),
                )
            ).alias("h")
        )
        out = out.where(~over).unionByName(counted(halves.select("h.start", "h.end")))
    return out.withColumn("still_over", F.col("n") >= cap)
