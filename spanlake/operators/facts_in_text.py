"""Facts read from agreement texts: amended sections, tags, topic hints, money amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.spans import span_finder
from spanlake.functions.text import collapse_spaces

# Amending language, amendment numbers, schedule references.
AMENDS = (
    r"(?i)Section\s+(\d{1,2}\.\d{1,2})(?:\([A-Za-z0-9]+\))*\s+of\s+the\s+(?:Merger\s+)?Agreement\s+"
    r"(?:is|shall\s+be)\s+(?:hereby\s+)?(?:amended|deleted\s+and\s+replaced)"
)
AMEND_SPAN_MAX = 4000
AMENDMENT_NUMBER = r"(?i)Amendment\s+No\.?\s*(\d+)|\b(First|Second|Third|Fourth|Fifth)\s+Amendment\b"
AMENDMENT_SCAN = 2000
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5}
SCHEDULE_REF = (
    r"(?i)\b(?:Company|Parent|Seller|Buyer)\s+Disclosure\s+(?:Letter|Schedule)\b|"
    r"\bset\s+forth\s+(?:in|on)\s+Schedule\s+\d"
)

# The wording that hints at each topic family.
HINTS = {
    "equity_awards": r"(?i)\b(?:Stock\s+Options?|Company\s+Options?|RSUs?|Restricted\s+Stock(?:\s+Units?)?|"
    r"PSUs?|Equity\s+Awards?|Stock\s+Awards?)\b",
    "termination_fee": r"(?i)\b(?:termination\s+fee|break-?up\s+fee)\b",
    "contingent_consideration": r"(?i)\b(?:earn-?outs?|contingent\s+value\s+rights?|CVRs?|"
    r"milestone\s+payments?|contingent\s+consideration)\b",
}
CANDIDATE_HINTS = {
    "employee_benefits": r"(?i)\b(?:Continuing\s+Employees?|Continuation\s+Period|no\s+less\s+favorable|"
    r"(?:substantially\s+)?comparable\s+(?:to|in\s+the\s+aggregate)|Employee\s+Matters|"
    r"severance\s+(?:plans?|benefits?|pay|protection))\b",
    "financing": r"(?i)\b(?:Debt\s+Commitment\s+Letters?|Equity\s+Commitment\s+Letters?|Debt\s+Financing|"
    r"Equity\s+Financing|Financing\s+Sources?|financing\s+cooperation|"
    r"(?:Parent|Reverse)\s+Termination\s+Fee|Commitment\s+Letters?)\b",
    "go_shop": r"(?i)\b(?:Go-?\s?Shop|No-?\s?Shop\s+Period\s+Start\s+Date|Excluded\s+Parties|"
    r"Excluded\s+Party|Window\s+Period)\b",
}
MAX_HINT_PASSAGES = 12
PASSAGE_SEP = "\n\n---\n\n"

# A fee near its phrase, any dollar amount, unit words, the smallest fee, and when two amounts agree.
SCALE = r"(?:\s*(million|billion|mm|bn|m|b)\b)?"
FEE = r"(?is)termination\s+fee[^;]{0,300}?\$\s?(\d[\d,]*(?:\.\d+)?)" + SCALE
DOLLARS = r"(?i)\$\s?(\d[\d,]*(?:\.\d+)?)" + SCALE
MIN_FEE = 100_000
FEE_TOLERANCE = 0.005
SNIPPET = 100

_find_amends = span_finder({"amends": AMENDS})
_find_dollars = span_finder({"dollars": DOLLARS}, whole=True)


def amended_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each amended section's span: up to the next amended section, 4,000 characters at most."""
    d = docs.select(key, F.length(text).alias("_n"), _find_amends(F.col(text)).alias("_h"))
    nxt = F.concat(F.slice(F.col("_h.start"), F.lit(2), F.greatest(F.size("_h"), F.lit(1))), F.array("_n"))
    d = d.select(key, F.explode(F.arrays_zip(F.col("_h").alias("h"), nxt.alias("nxt"))).alias("z")).where("z.h IS NOT NULL")
    return d.select(
        key, F.col("z.h.label").alias("section_id"), F.col("z.h.start").cast("long").alias("start"),
        F.least(F.col("z.nxt"), F.col("z.h.start") + AMEND_SPAN_MAX).cast("long").alias("end"),
    )


def amendment_number(text: Column, fallback: Column) -> Column:
    head = F.substring(text, 1, AMENDMENT_SCAN)
    digits = F.regexp_extract(head, AMENDMENT_NUMBER, 1)
    word = F.lower(F.regexp_extract(head, AMENDMENT_NUMBER, 2))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair]), word).cast("long")
    return F.when(digits != "", digits.cast("long")).when(named.isNotNull(), named).otherwise(fallback)


def superseded(passages: DataFrame, amended: DataFrame) -> DataFrame:
    """Passages whose section an amendment of the same deal replaces.

    `amended`: contract_id, section_id, amendment_id, amendment_no, file_date, start, end.
    """
    p = passages.where("kind <> 'toc' AND section_id <> ''").select("contract_id", "section_id", "passage_id")
    a = amended.withColumnsRenamed({"start": "amend_start", "end": "amend_end"})
    return p.join(a, ["contract_id", "section_id"])


def schedule_tags(passages: DataFrame) -> DataFrame:
    return passages.where("kind <> 'toc'").where(F.col("body").rlike(SCHEDULE_REF)).select(
        "passage_id", F.lit("schedule_ref").alias("tag")
    )


def hint_blocks(passages: DataFrame, families: dict[str, str], cap: int, key: str = "doc_id") -> DataFrame:
    """Per document and topic family: whether any passage hints at it, and the first twelve passages as one block.

    Matches are ranked by position alone; texts are joined only for the passages shown. The block is cut at `cap`
    characters and flagged when anything is left out.
    """
    named = F.filter(
        F.array(*[F.when(F.col("body").rlike(p), F.lit(n)) for n, p in families.items()]), lambda x: x.isNotNull()
    )
    hit = passages.select(key, "ordinal", F.explode(named).alias("family"))
    n = hit.groupBy(key, "family").agg(F.count(F.lit(1)).alias("n_passages"))
    w = Window.partitionBy(key, "family").orderBy("ordinal")
    first = hit.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= MAX_HINT_PASSAGES)
    shown = first.join(passages.select(key, "ordinal", "body"), [key, "ordinal"])
    before = F.coalesce(F.sum(F.length("body") + len(PASSAGE_SEP)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = shown.withColumn("_room", cap - before)
    blocks = shown.groupBy(key, "family").agg(
        F.sort_array(
            F.collect_list(F.when(F.col("_room") > 0, F.struct("_rn", F.expr("left(body, cast(_room as int))").alias("part"))))
        ).alias("_p"),
        F.max(F.length("body") > F.col("_room")).alias("_cut"),
    )
    return n.join(blocks, [key, "family"]).select(
        key, "family", "n_passages", F.array_join(F.col("_p.part"), PASSAGE_SEP).alias("block"),
        (F.col("_cut") | (F.col("n_passages") > MAX_HINT_PASSAGES)).alias("truncated"),
    )


def dollar_value(number: Column, unit: Column) -> Column:
    u = F.lower(F.coalesce(unit, F.lit("")))
    scale = F.when(u.isin("million", "mm", "m"), 1e6).when(u.isin("billion", "bn", "b"), 1e9).otherwise(1.0)
    return F.replace(number, F.lit(","), F.lit("")).cast("double") * scale


def fee_amounts(text: Column) -> Column:
    """Distinct dollar amounts near the fee phrase, in dollars, at least 100,000."""
    numbers = F.regexp_extract_all(text, F.lit(FEE), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(FEE), F.lit(2))
    values = F.transform(F.arrays_zip(numbers.alias("n"), units.alias("u")), lambda z: dollar_value(z["n"], z["u"]))
    return F.array_distinct(F.filter(values, lambda v: v >= MIN_FEE))


def restated_amounts(releases: DataFrame, fees: DataFrame, key: str) -> DataFrame:
    """The first amount in a release within half a percent of one of its deal's fees, with the text around it.

    `releases`: key, text; `fees`: key, fee. Amounts meet fees by logarithmic bucket and its two neighbours, never
    all against all.
    """
    found = releases.select(key, "text", F.explode(_find_dollars(F.col("text"))).alias("m"))
    value = dollar_value(
        F.regexp_extract("m.label", DOLLARS, 1), F.regexp_extract("m.label", DOLLARS, 2)
    )
    amounts = found.select(key, "m.start", "m.end", value.alias("value")).where("value > 0")
    bucket = F.floor(F.ln("value") / F.lit(0.01)).cast("long")
    f = fees.where("fee > 0").select(key, "fee", F.floor(F.ln("fee") / F.lit(0.01)).cast("long").alias("_fb")).distinct()
    f = f.select(key, "fee", F.explode(F.array(F.col("_fb") - 1, F.col("_fb"), F.col("_fb") + 1)).alias("_b"))
    near = amounts.withColumn("_b", bucket).join(f, [key, "_b"]).where(
        F.abs(F.col("value") - F.col("fee")) <= FEE_TOLERANCE * F.col("fee")
    )
    first = near.groupBy(key).agg(F.min(F.struct("start", "end", "value")).alias("m"))
    low = F.greatest(F.lit(0), F.col("m.start") - SNIPPET)
    snippet = F.substring("text", low + 1, F.col("m.end") + SNIPPET - low)
    return releases.join(first, key).select(key, F.col("m.value").alias("matched_amount"), collapse_spaces(snippet).alias("snippet"))
