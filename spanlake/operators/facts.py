"""Named facts, their checks, and scans of published text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import slug

# Labels a fact is shown under, and the fact names each applies to.
MACHINE, HUMAN = "machine-built", "human-labelled (MAUD)"
MACHINE_PREFIXES = (
    "m0_sample_", "m0_candidate_",
    "m2_lexicon_", "m2_llm_rewrite_", "m2_r5_llm_", "m2_cmp_r5_llm_", "m2_machine_disputed_",
    "m3_tm_", "m3_t_", "m3_cmp_t_", "m3_r5_llm_append_", "m3_cmp_r5_llm_append_", "m3_r7_",
    "m3_tier_kept", "m3_tier_match_", "m3_tier_tau", "m3_tier_machine_order",
    "m4_tmachine_", "m4_t_", "m4_cmp_t_", "m4_abstain_", "m4_refute_",
    "m5_calibration_state_agreement",
)
MACHINE_PATTERN = r"^(?:m3_tier_r\d_machine_|m4_cmp_model_[a-z]+_tmachine_)"
HUMAN_PREFIXES = (
    "r1_", "m2_r1_", "m2_r2_", "m2_r3_", "m2_r4_", "m2_r5_", "m2_r6_", "m2_cmp_", "m2_cat_", "m2_fail_",
    "m2_best_corpus", "m2_report_", "m3_tier_human_order", "m4_thuman_", "m4_r6n_", "m4_cmp_r6n_",
    "m4_cmp_model_haiku_thuman_", "m4_cmp_model_sonnet_thuman_", "m5_bundle_r6n_",
    "m5_calibration_accuracy_",
)
HUMAN_PATTERN = r"^m3_tier_r\d_human_"
UNSTABLE = r"latency_ms|load_avg|index_bytes$|rss_mb$|^m5_server_|^m5_e2e_"

# Dates, numbers and the spans that carry no copy numbers in published text.
INLINE = r"`[^`]*`|\]\([^)]*\)|\[\^[^\]]*\]|</?[A-Za-z][^>]*>|https?://\S+"
ORDINAL = r"^(\s*)\d+[.)](?=\s)"
DATE = r"(?<![A-Za-z0-9.-])\d{4}-\d{2}-\d{2}(?![A-Za-z0-9-])"
NUMBER = r"(?<![A-Za-z0-9.-])(-?)(\$?)(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?(%?)(?![A-Za-z0-9%]|\.\d)"

# The key-shaped string no published object may hold.
SECRET_PATTERNS = {"api key": r"sk-ant-[A-Za-z0-9_-]{20,}"}


def named_facts(df: DataFrame, facts: dict[str, Column], prefix: str = "") -> DataFrame:
    """(name, value) rows of several aggregates over one table, in one pass."""
    row = df.agg(*[c.cast("double").alias(prefix + n) for n, c in facts.items()])
    return row.unpivot([], row.columns, "name", "value")


def all_facts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def shared_ids(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """How many ids two tables share."""
    n = a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return n.select(F.lit(name).alias("name"), "value")


def metric_facts(summary: DataFrame, categories: dict[str, str], metric: str, prefix: str = "r1") -> DataFrame:
    """Facts of a summary with intervals.

    `summary`: slice, name, metric, mean, lo, hi, n_items, n_clusters. Every metric of the report split becomes a mean
    and two ends; each category in `categories` (slug -> name) gets its value, ends and counts, and one that was not
    scored counts zero with no value.
    """
    ends = F.array(
        F.struct(F.lit("").alias("s"), F.round("mean", 4).alias("v")),
        F.struct(F.lit("_lo").alias("s"), F.round("lo", 4).alias("v")),
        F.struct(F.lit("_hi").alias("s"), F.round("hi", 4).alias("v")),
    )
    report = summary.where("slice = 'split' AND name = 'report'").select(
        F.concat(F.lit(prefix + "_report_"), "metric").alias("_n"), F.explode(ends).alias("e")
    ).select(F.concat("_n", "e.s").alias("name"), F.col("e.v").cast("double").alias("value"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("slug"), F.lit(v).alias("name")) for k, v in categories.items()]))
    cats = summary.sparkSession.range(1).select(wanted.alias("w")).select("w.slug", "w.name")
    got = cats.join(summary.where((F.col("slice") == "category") & (F.col("metric") == metric)), "name", "left")
    counts = [
        F.struct(F.lit(s).alias("s"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("v"))
        for s, c in (("_items", "n_items"), ("_contracts", "n_clusters"))
    ]
    values = [
        F.struct(F.lit(f"_{metric}{s}").alias("s"), F.round(c, 4).cast("double").alias("v"))
        for s, c in (("", "mean"), ("_lo", "lo"), ("_hi", "hi"))
    ]
    by_cat = got.select(F.concat(F.lit(prefix + "_cat_"), "slug").alias("_n"), F.explode(F.array(*values, *counts)).alias("e")).select(
        F.concat("_n", "e.s").alias("name"), F.col("e.v").alias("value")
    )
    return report.unionByName(by_cat)


def category_slug(name: Column) -> Column:
    return slug(name)


def typed_facts(objects: DataFrame, json: str, prefix: Column) -> DataFrame:
    """(name, type, value) of flat JSON objects: one fact for each entry, its value a VARIANT of type number, string, boolean or null.

    A text that is no JSON object has no fact; entries that hold objects or arrays are no facts.
    """
    spark = objects.sparkSession
    rows = objects.select(prefix.alias("_prefix"), F.try_parse_json(F.col(json)).alias("_v"))
    rows = rows.where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))
    each = spark.sql("SELECT _prefix, key, value FROM {rows}, LATERAL variant_explode(_v)", rows=rows)
    kind = F.schema_of_variant("value")
    type_ = (
        F.when(F.is_variant_null("value"), "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL|FLOAT)"), "number")
    )
    return each.select(F.concat("_prefix", "key").alias("name"), type_.alias("type"), "value").where("type IS NOT NULL")


def number_facts(typed: DataFrame) -> DataFrame:
    """(name, value) of the numbers among typed facts; a boolean is no number."""
    return typed.where("type = 'number'").select("name", F.variant_get("value", "$", "double").alias("value"))


def string_facts(typed: DataFrame) -> DataFrame:
    return typed.where("type = 'string'").select("name", F.variant_get("value", "$", "string").alias("value"))


def typed_diff(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(name, problem): as `facts_diff`, for facts of any type. Numbers are equal by value, however written; values of two types never are."""
    def comparable(facts):
        number = F.when(F.col("type") == "number", F.variant_get("value", "$", "double"))
        other = F.when(F.col("type") != "number", F.to_json("value"))
        return facts.select("name", F.struct("type", number.alias("number"), other.alias("other")).alias("value"))

    return facts_diff(comparable(stored), comparable(fresh))


def facts_diff(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Names whose value changed, is new, or is no longer built; wall-clock facts are ignored."""
    j = stored.select("name", F.col("value").alias("_old"), F.lit(True).alias("_s")).join(
        fresh.select("name", F.col("value").alias("_new"), F.lit(True).alias("_f")), "name", "full_outer"
    )
    j = j.where(~F.col("name").rlike(UNSTABLE))
    kind = (
        F.when(F.col("_f").isNull(), "no longer built").when(F.col("_s").isNull(), "new").when(~F.col("_old").eqNullSafe(F.col("_new")), "stale")
    )
    return j.select("name", kind.alias("problem")).where("problem IS NOT NULL")


def _starts(name: Column, prefixes) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(name, p))


def is_machine_built(name: Column) -> Column:
    return _starts(name, MACHINE_PREFIXES) | name.rlike(MACHINE_PATTERN)


def tier_label(name: Column) -> Column:
    return F.when(is_machine_built(name), MACHINE).when(_starts(name, HUMAN_PREFIXES) | name.rlike(HUMAN_PATTERN), HUMAN)


# What shapes a Markdown text, line by line.
FENCE = r"^\s*(?:```|~~~)"
HEADING = r"^\s{0,3}#{1,6}\s"
ITEM = r"^\s*(?:[-*+]|\d+[.)])\s"
ROW = r"^\s*\|"
REFERENCE = r"^\s*\[[^\]]+\]:\s*\S+.*$"


def published_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, text, labelled): the lines of Markdown texts that carry copy, numbered from 0 as they stand.

    Code between fences and link references are no copy. A line is labelled where its paragraph, list item or table row, or the heading above it, says
    machine-built (a machine-built lexicon does not count). The key tells texts apart; a null text has no line.
    """
    rows = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "text"))
    order = Window.partitionBy(key).orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("text").rlike(FENCE)
    rows = rows.withColumn("_code", fence | (F.sum(fence.cast("int")).over(upto) % 2 == 1))
    head = ~F.col("_code") & F.col("text").rlike(HEADING)
    rows = rows.withColumns({"_head": head, "_gap": F.col("_code") | (F.trim(F.regexp_replace("text", r"\s", " ")) == ""), "_row": F.col("text").rlike(ROW)})
    after = F.lag(F.col("_gap") | F.col("_head") | F.col("_row"), 1, True).over(order)
    begins = F.col("_gap") | F.col("_head") | F.col("_row") | after | F.col("text").rlike(ITEM)
    rows = rows.withColumns({"_block": F.sum(begins.cast("int")).over(upto), "_heading": F.last(F.when(F.col("_head"), F.col("text")), ignorenulls=True).over(upto)})
    copy = rows.where(~F.col("_gap"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    context = F.lower(F.concat_ws("\n", listed, F.max("_heading")))
    blocks = copy.groupBy(key, "_block").agg(F.contains(F.replace(context, F.lit("machine-built lexicon"), F.lit("")), F.lit(MACHINE)).alias("labelled"))
    return copy.where(~F.col("text").rlike(REFERENCE)).join(blocks, [key, "_block"]).select(key, F.col("line").cast("long").alias("line"), "text", "labelled")


def numbers_in(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every number of each text row: raw, digits, places, pct, and whether the row carries the machine-built label (its own `labelled`, if it has one)."""
    prose = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, INLINE, " "), ORDINAL, "$1"), DATE, " ")
    own = F.contains(F.replace(F.lower(text), F.lit("machine-built lexicon"), F.lit("")), F.lit(MACHINE))
    d = texts.select(*keys, prose.alias("_p"), F.col("labelled") if "labelled" in texts.columns else own.alias("labelled"))
    groups = [F.regexp_extract_all("_p", F.lit(NUMBER), F.lit(i)).alias(f"g{i}") for i in range(0, 6)]
    z = d.select(*keys, "labelled", F.posexplode(F.arrays_zip(*groups)).alias("at", "z"))
    frac = F.coalesce(F.col("z.g4"), F.lit(""))
    digits = F.concat(F.replace("z.g3", F.lit(","), F.lit("")), F.regexp_replace(frac, r"^\.", ""))
    return z.select(
        *keys, "at", "labelled", F.col("z.g0").alias("raw"), F.greatest(F.lit(0), F.length(frac) - 1).alias("places"),
        (F.col("z.g5") == "%").alias("pct"), F.length(F.regexp_replace(digits, "^0+", "")).alias("significant"),
        F.concat("z.g1", F.replace("z.g3", F.lit(","), F.lit("")), frac).cast("double").alias("value"),
    )


# Two numbers are the same within this, relative or absolute.
SAME = 1e-9
# From this many decimals on, rounding moves a number by less than SAME, so a number there is "rounded" only if it is exact.
FINE_PLACES = 10


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(SAME) * F.greatest(F.abs(a), F.abs(b)), F.lit(SAME))


def _near_keys(x: Column, reach: int) -> Column:
    """Cells of twice the tolerance that `x` lies in, and their neighbours up to `reach`: on a log scale, and near zero on a plain one.

    Doubles throughout, so a number of any length has a key.
    """
    steps = [F.lit(float(k)) for k in range(-reach, reach + 1)]
    log = F.when(x != 0, F.round(F.log(F.abs(x)) / (2 * SAME)))
    plain = F.when(F.abs(x) <= 2, F.round(x / (2 * SAME)))
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("places"), F.coalesce(c + k, none).alias("cell")) for kind, c in (("log", log), ("plain", plain)) for k in steps]
    return F.filter(F.array(*cells), lambda s: s["cell"].isNotNull())


def _rounded(x: Column) -> Column:
    """(places, value) of `x` at every number of places where rounding can matter."""
    return F.array(*[F.struct(F.lit(p).alias("places"), F.round(x, p).alias("r")) for p in range(FINE_PLACES)])


def check_numbers(texts: DataFrame, facts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Each number in a text with the facts it states exactly or rounded, and whether it needs a label.

    Numbers meet facts by equality of keys, never by trying every pair: the fact rounded to the number's places, or a
    cell of the tolerance within which two numbers are the same. Distinct numbers meet distinct values with their count of facts, so a number that many
    texts hold and a value that many facts have meet once. Numbers of any number of digits and decimals take part.
    """
    n = numbers_in(texts, keys, text)
    number = ["value", "places", "significant", "pct"]
    can_round = (F.col("places") < FINE_PLACES) & (F.col("significant") >= 2)
    own = F.when(can_round, F.array(F.struct(F.lit("round").alias("kind"), F.col("places").cast("int").alias("places"), F.col("value").alias("cell"))))
    asked = n.select(number).distinct()
    asked = asked.withColumn("_k", F.explode(F.concat(F.coalesce(own, F.array().cast("array<struct<kind:string,places:int,cell:double>>")), _near_keys(F.col("value"), 1))))
    valued = facts.where(F.col("value").isNotNull()).select("name", F.col("value").alias("fact")).distinct()
    # Names of one value are counted by value; a name of several values, or none, is one fact whichever of them is met.
    several = F.col("name").isNull() | (F.count(F.lit(1)).over(Window.partitionBy("name")) > 1)
    f = valued.withColumn("_several", several).withColumn("pct", F.explode(F.array(F.lit(False), F.lit(True))))
    shown = F.when(F.col("pct") & ~F.endswith("name", F.lit("_pct")), F.col("fact") * 100).otherwise(F.col("fact"))
    one = ["_several", F.when(F.col("_several"), F.col("name")).alias("_name"), is_machine_built(F.col("name")).alias("_m")]
    f = f.select("pct", shown.alias("shown"), *one).groupBy("pct", "shown", "_several", "_name", "_m").agg(F.count(F.lit(1)).alias("_c"))
    f = f.withColumn("_c", F.when(F.col("_several"), 1).otherwise(F.col("_c")))
    by_rounding = F.transform(_rounded(F.col("shown")), lambda s: F.struct(F.lit("round").alias("kind"), s["places"].alias("places"), s["r"].alias("cell")))
    f = f.withColumn("_k", F.explode(F.concat(by_rounding, _near_keys(F.col("shown"), 0))))
    met = asked.join(f, ["_k", "pct"]).withColumn("_exact", _close(F.col("shown"), F.col("value")))
    met = met.withColumn("_near", (F.col("significant") >= 2) & ((F.col("_k.kind") == "round") | F.col("_exact"))).where("_exact OR _near")
    unit = F.when(~F.col("_several"), F.col("shown")).alias("_shown")
    met = met.groupBy(*number, "_several", "_name", unit, "_m").agg(F.max("_c").alias("_c"), F.max("_exact").alias("_exact"))
    per = met.groupBy(*number).agg(
        F.sum(F.when(F.col("_exact"), F.col("_c")).otherwise(0)).alias("_ne"), F.sum("_c").alias("_nn"),
        F.sum(F.when(F.col("_exact") & F.col("_m"), F.col("_c")).otherwise(0)).alias("_me"), F.sum(F.when(F.col("_m"), F.col("_c")).otherwise(0)).alias("_mn"),
    )
    j = n.join(per, number, "left")
    exact = F.coalesce("_ne", F.lit(0)) > 0
    hits = F.when(exact, F.col("_ne")).otherwise(F.coalesce("_nn", F.lit(0)))
    machine = F.when(exact, F.col("_me")).otherwise(F.coalesce("_mn", F.lit(0)))
    status = (
        F.when((hits > 0) & (machine == hits) & ~F.col("labelled"), "needs machine-built label")
        .when(exact, "fact").when(hits > 0, "rounded").otherwise("no fact")
    )
    return j.select(*keys, "at", "raw", status.alias("status"), hits.alias("n_facts"))


def secret_scan(texts: DataFrame, patterns: dict[str, str] = SECRET_PATTERNS, text: str = "text") -> DataFrame:
    """(pattern, n): how many texts hold each pattern; values are never shown."""
    hit = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return texts.select(F.explode(hit).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def external_comparison(ours: DataFrame, theirs: DataFrame, key: str = "k") -> tuple[DataFrame, DataFrame]:
    """Both sides on the same key list, and the keys only one of them has (must be empty)."""
    lone = ours.join(theirs, key, "left_anti").select(key, F.lit("ours").alias("side")).unionByName(
        theirs.join(ours, key, "left_anti").select(key, F.lit("theirs").alias("side"))
    )
    return ours.join(theirs, key), lone


def check_dates(texts: DataFrame, string_facts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Each date in a text with how many string facts hold it."""
    prose = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, INLINE, " "), ORDINAL, "$1"), r"\s+", " ")
    d = texts.select(*keys, F.posexplode(F.regexp_extract_all(prose, F.lit(DATE), F.lit(0))).alias("at", "raw"))
    held = F.array_distinct(F.regexp_extract_all("value", F.lit(r"(?=(\d{4}-\d{2}-\d{2}))"), F.lit(1)))
    n = string_facts.select("name", F.explode(held).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n_facts"))
    j = d.join(n, "raw", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    return j.select(*keys, "at", "raw", F.when(F.col("n_facts") > 0, "fact").otherwise("no fact").alias("status"), "n_facts")
