"""Replies to claims, the citation gate, and answer scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import collapse_spaces, normal_form
from spanlake.operators.ordering import carried, index_percentile_rank, nearest_rank, rank_pick

# The states a model may give, those worth caching, and the stop rule of a run.
MODEL_STATES = ("answered", "not_stated", "unfiled_schedule")
MAX_CONSECUTIVE = 20
MIN_FOR_RATE = 20
STATE_AGREEMENT_MIN = 0.8
ACCURACY_DIFF_MAX = 0.15

REPLY_SCHEMA = "state string, choice string, claims array<struct<text: string, quote: string, ref: string>>"
WORD = "[\\p{L}\\p{N}_]"


def rate(a, b):
    return F.round(F.try_divide(a, F.nullif(b, F.lit(0))), 4)


def parse_replies(replies: DataFrame, result: str = "result") -> DataFrame:
    """Adds said (the reply's state), choice, claims and error. A reply without a usable answer object is an error row."""
    body = F.regexp_extract(result, r"(?s)\{.*\}", 0)
    listed = F.get_json_object("_body", "$.claims")
    r = replies.withColumn("_body", F.when(F.try_parse_json(body).isNotNull(), body)).withColumn(
        "_o", F.from_json("_body", REPLY_SCHEMA)
    )
    ok = F.coalesce(F.col("_o.state").isin(*MODEL_STATES) & (listed.isNull() | F.startswith(listed, F.lit("["))), F.lit(False))
    empty = F.array().cast("array<struct<text:string,quote:string,ref:string>>")
    return (
        r.withColumn("said", F.when(ok, F.col("_o.state")))
        .withColumn("choice", F.when(ok, F.col("_o.choice")))
        .withColumn("claims", F.when(ok, F.coalesce(F.col("_o.claims"), empty)).otherwise(empty))
        .withColumn("error", F.when(~ok, "parse: no answer object"))
        .drop("_body", "_o", result)
    )


def explode_claims(parsed: DataFrame, key: str = "answer_id") -> DataFrame:
    c = parsed.select(key, F.posexplode("claims").alias("claim_no", "c"))
    blank = F.lit("")
    return c.select(key, "claim_no", *[F.coalesce(F.col(f"c.{x}"), blank).alias(x) for x in ("text", "quote", "ref")])


def _quoted_in(quote: Column, text: Column) -> Column:
    """`quote` occurs in `text`, on token boundaries where it starts or ends with a word character."""
    literal = F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    left = F.when(quote.rlike("^" + WORD), f"(?<!{WORD})").otherwise("")
    right = F.when(quote.rlike(WORD + "$"), f"(?!{WORD})").otherwise("")
    return F.contains(text, quote) & F.rlike(text, F.concat(left, literal, right))


def citation_gate(claims: DataFrame, blocks: DataFrame, key: str = "answer_id") -> DataFrame:
    """Each claim with the passage and part its quote stands in word for word, or the reason it is dropped.

    `blocks`: key, ref_no, passage_id, schedule_ref, parts (array of kind, text, amendment_no). A claim meets exactly
    the block it cites, by an equi-join.
    """
    number = F.regexp_extract(F.trim("ref"), r"^\[?\s*[Pp](\d+)\s*\]?$", 1)
    c = claims.withColumn("_q", normal_form(F.col("quote"))).withColumn("ref_no", F.when(number != "", number.try_cast("long")))
    j = c.join(blocks.withColumn("_found", F.lit(True)), [key, "ref_no"], "left")
    hit = F.get(F.filter("parts", lambda p: _quoted_in(F.col("_q"), normal_form(p["text"]))), F.lit(0))
    j = j.withColumn("_hit", hit)
    reason = (
        F.when(F.col("_q") == "", "empty_quote")
        .when(F.col("_found").isNull(), "bad_ref")
        .when(F.col("_hit").isNull(), "quote_not_found")
    )
    kept = reason.isNull()
    return j.select(
        key, "claim_no", reason.alias("reason"), F.when(kept, F.col("passage_id")).alias("passage_id"),
        F.when(kept, F.col("schedule_ref")).alias("schedule_ref"), F.when(kept, F.col("_hit.kind")).alias("part"),
        F.when(kept, F.col("_hit.amendment_no")).alias("amendment_no"),
    )


def final_states(parsed: DataFrame, gated: DataFrame, key: str = "answer_id") -> DataFrame:
    """The state of every parsed reply after its unsupported claims are gone."""
    kept = gated.where("reason IS NULL").groupBy(key).agg(
        F.count(F.lit(1)).alias("_kept"), F.max("schedule_ref").alias("_sched"), F.max(F.col("part") == "amendment").alias("_amend")
    )
    dropped = gated.where("reason IS NOT NULL").groupBy(key).agg(F.count(F.lit(1)).alias("_dropped"))
    p = parsed.where("error IS NULL").select(key, "said").join(kept, key, "left").join(dropped, key, "left")
    n = F.coalesce("_kept", F.lit(0))
    state = (
        F.when((F.col("said") == "unfiled_schedule") & F.coalesce("_sched", F.lit(False)), "unfiled_schedule")
        .when((F.col("said") == "answered") & (n > 0), "answered")
        .otherwise("not_stated")
    )
    return p.select(
        key, state.alias("state"), n.alias("kept"), F.coalesce("_dropped", F.lit(0)).alias("dropped"),
        ((state == "answered") & F.coalesce("_amend", F.lit(False))).alias("amended"),
    )


def choice_key(c: Column) -> Column:
    return F.lower(collapse_spaces(F.replace(normal_form(c), F.lit('"'), F.lit(""))))


def match_choice(choice: Column, options: Column) -> Column:
    """The one option a choice means: equal after folding, else its quoted segment equal; null when none or several."""
    key = choice_key(choice)
    same = F.filter(options, lambda o: choice_key(o) == key)

    def segment(o):
        parts = F.split(normal_form(o), '"')
        return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1)))

    quoted = F.filter(options, lambda o: F.coalesce(choice_key(segment(o)) == key, F.lit(False)))
    found = F.when(F.size(same) == 1, F.get(same, F.lit(0))).when(F.size(quoted) == 1, F.get(quoted, F.lit(0)))
    return F.when(key != "", found)


def choice_outcomes(items: DataFrame, records: DataFrame, baseline: DataFrame) -> DataFrame:
    """Multiple-choice items with 0/1 columns: accuracy, accuracy_cited, baseline, vs_baseline (null when unanswered).

    `items`: item_id, question, contract_id, split, category, choices, expected; `records`: item_id, answered (false
    for an error), choice, state; `baseline`: question, majority.
    """
    j = items.join(records.withColumn("_rec", F.lit(True)), "item_id", "left").join(baseline, "question", "left")
    matched = match_choice(F.col("choice"), F.col("choices"))
    done = F.col("_rec").isNotNull() & F.col("answered")
    j = j.withColumn("missing", F.col("_rec").isNull()).withColumn("error", F.col("_rec").isNotNull() & ~F.col("answered"))
    j = j.withColumn("_m", F.when(done, matched))
    right = F.coalesce(normal_form(F.col("_m")) == normal_form(F.col("expected")), F.lit(False))
    base = F.coalesce(F.col("majority") == F.col("expected"), F.lit(False))
    one = lambda c: F.when(done, c.cast("double"))
    return j.select(
        "item_id", "contract_id", "split", "category", "missing", "error", (done & F.col("_m").isNull()).alias("out_of_list"),
        one(right).alias("accuracy"), one(right & (F.col("state") == "answered")).alias("accuracy_cited"), one(base).alias("baseline"),
        (one(right) - one(base)).alias("vs_baseline"),
    )


def outcome_counters(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.count_if("missing").alias("missing"), F.count_if("error").alias("errors"),
        F.count_if("out_of_list").alias("out_of_list"), F.count("accuracy").alias("n"),
    )


def judged_outcomes(items: DataFrame, records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Judged items: agree and agree_or_partial (0/1, null when undecided) with what kept the rest from being scored.

    `items`: item_id, split, family, expected (contract); `records`: item_id, answered, contract_id; `verdicts`:
    item_id, verdict (null when the judge's reply was unparsed).
    """
    j = items.join(records.withColumn("_rec", F.lit(True)), "item_id", "left").join(
        verdicts.withColumn("_judged", F.lit(True)), "item_id", "left"
    )
    done = F.col("_rec").isNotNull() & F.col("answered")
    judged = done & F.col("_judged").isNotNull()
    v = F.when(judged, F.col("verdict"))
    return j.select(
        "item_id", "split", "family", F.col("expected").alias("cluster"),
        F.col("_rec").isNull().alias("missing"), (F.col("_rec").isNotNull() & ~F.col("answered")).alias("error"),
        (done & F.coalesce(F.col("contract_id") != F.col("expected"), F.lit(False))).alias("wrong_deal"),
        (done & F.col("_judged").isNull()).alias("not_judged"), (judged & F.col("verdict").isNull()).alias("judge_unparsed"),
        F.coalesce(v == "declined", F.lit(False)).alias("declined"),
        (v == "agree").cast("double").alias("agree"), v.isin("agree", "partial").cast("double").alias("agree_or_partial"),
    )


def judged_counters(scored: DataFrame, keys: list[str]) -> DataFrame:
    flags = ("missing", "error", "wrong_deal", "not_judged", "judge_unparsed", "declined")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), *[F.count_if(f).alias(f"n_{f}") for f in flags], F.count("agree").alias("n"),
        F.round(F.avg("agree"), 4).alias("agree"), F.round(F.avg("agree_or_partial"), 4).alias("agree_or_partial"),
    )


def abstention_scores(items: DataFrame, records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Correct, false and other answers per abstention group, with rates.

    `items`: item_id, abstain_group, expected; `records`: item_id, answered, state; `verdicts` as for judged items.
    In group `absent` a decline is correct and an answer is judged.
    """
    j = items.join(records.withColumn("_rec", F.lit(True)), "item_id", "left").join(
        verdicts.withColumn("_judged", F.lit(True)), "item_id", "left"
    )
    state, v = F.col("state"), F.col("verdict")
    judged = (
        F.when(state == "not_stated", "correct")
        .when(state != "answered", "other")
        .when(F.col("_judged").isNull(), "not_judged")
        .when(v.isNull(), "judge_unparsed")
        .when(v.isin("agree", "partial"), "correct")
        .when(v == "disagree", "false_answer")
        .otherwise("other")
    )
    plain = F.when(state == F.col("expected"), "correct").when(state == "answered", "false_answer").otherwise("other")
    kind = (
        F.when(F.col("_rec").isNull(), "missing")
        .when(~F.col("answered"), "errors")
        .otherwise(F.when(F.col("abstain_group") == "absent", judged).otherwise(plain))
    )
    kinds = ("correct", "false_answer", "other", "errors", "missing", "not_judged", "judge_unparsed")
    out = j.withColumn("kind", kind).groupBy("abstain_group").agg(
        F.count(F.lit(1)).alias("items"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    )
    n = F.col("correct") + F.col("false_answer") + F.col("other")
    return out.where(F.col("items") > F.col("missing")).select(
        "*", n.alias("n"), rate(F.col("correct"), n).alias("correct_rate"), rate(F.col("false_answer"), n).alias("false_answer_rate")
    )


def gate_rates(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Citation-gate pass rate per key and how many claims each reason dropped. `answers`: keys, kept, dropped (array of reasons)."""
    reasons = ("empty_quote", "bad_ref", "quote_not_found")
    kept = F.sum("kept")
    lost = F.sum(F.size("dropped"))
    return answers.groupBy(*keys).agg(
        kept.alias("kept"), (kept + lost).alias("returned"), rate(kept, kept + lost).alias("pass_rate"),
        *[F.sum(_count_reason(k)).alias(k) for k in reasons],
    )


def _count_reason(reason: str) -> Column:
    return F.size(F.filter("dropped", lambda r: r == reason))


def token_means(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Mean tokens of answers that made a call."""
    return answers.where(F.col("tokens_in") > 0).groupBy(*keys).agg(
        F.round(F.avg("tokens_in"), 1).alias("in_mean"), F.round(F.avg("tokens_out"), 1).alias("out_mean"), F.count(F.lit(1)).alias("n")
    )


def weighted_token_means(means: DataFrame, keys: list[str]) -> DataFrame:
    """Means over several sets weighted by their counts."""
    return means.groupBy(*keys).agg(
        F.round(F.sum(F.col("in_mean") * F.col("n")) / F.sum("n"), 1).alias("in_mean"),
        F.round(F.sum(F.col("out_mean") * F.col("n")) / F.sum("n"), 1).alias("out_mean"),
    )


def refutation_survival(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """How many decided claims were not refuted. `verdicts`: keys, refuted (null when unparsed)."""
    stood = F.count_if(~F.col("refuted"))
    return verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"), stood.alias("not_refuted"), F.count_if(F.col("refuted").isNull()).alias("unparsed"),
        rate(stood, F.count("refuted")).alias("survival_rate"),
    )


def calibration_summary(api: DataFrame, cli: DataFrame) -> DataFrame:
    """Two runs of the same items side by side, with a go or stop verdict.

    `api`: item_id, ok, state, right (null when not multiple choice), tokens_in, tokens_out, cost, worst; `cli`:
    item_id, state, right. A failed call is costed at its worst case.
    """
    called = F.col("ok") & (F.col("tokens_in") > 0)
    a = api.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(called).alias("called"), F.count_if(~F.col("ok")).alias("errors"),
        F.round(F.avg(F.when(called, F.col("tokens_in"))), 1).alias("tokens_in_mean"),
        F.round(F.avg(F.when(called, F.col("tokens_out"))), 1).alias("tokens_out_mean"),
        F.round(F.coalesce(F.sum(F.when(called, F.col("cost"))), F.lit(0.0)) + F.coalesce(F.sum(F.when(~F.col("ok"), F.col("worst"))), F.lit(0.0)), 6).alias("cost_usd_total"),
        F.round(F.avg(F.when(called, F.col("cost"))), 6).alias("cost_per_answer_mean"),
        F.round(F.min(F.when(called, F.col("worst") - F.col("cost"))), 6).alias("worst_case_min_margin_usd"),
    )
    tail = rank_pick(api.where(called).withColumn("_k", F.lit(0)), ["_k"], "tokens_out", {"tokens_out_p95": nearest_rank(95), "tokens_out_p99": nearest_rank(99)}).drop("_k")
    both = api.where("ok").select("item_id", F.col("state").alias("_s"), F.col("right").alias("_r")).join(cli, "item_id")
    p = both.agg(
        F.count(F.lit(1)).alias("paired"), F.round(F.avg((F.col("_s") == F.col("state")).cast("double")), 4).alias("state_agreement"),
        F.round(F.avg("_r"), 4).alias("accuracy_api"), F.round(F.avg("right"), 4).alias("accuracy_cli"),
    )
    one = lambda d: d.withColumn("_k", F.lit(0))
    out = one(a).join(one(tail), "_k", "left").join(one(p), "_k").drop("_k")
    diff = F.round(F.col("accuracy_api") - F.col("accuracy_cli"), 4)
    reasons = F.filter(
        F.array(
            F.when(F.col("state_agreement").isNull(), F.lit("no item has both answers")),
            F.when(F.col("state_agreement") < STATE_AGREEMENT_MIN, F.lit("state agreement is too low")),
            F.when(F.abs(diff) > ACCURACY_DIFF_MAX, F.lit("accuracy differs too much")),
            F.when(F.coalesce(F.col("worst_case_min_margin_usd") < 0, F.lit(True)), F.lit("the worst case is below an actual cost")),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("accuracy_diff", diff).withColumn("reasons", F.array_join(reasons, "; ")).withColumn(
        "verdict", F.when(F.size(reasons) == 0, "go").otherwise("stop")
    )


def run_parity(a: DataFrame, b: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Every key of either run with whether all compared columns are equal (a key of one run only is not)."""
    left = a.select(*keys, F.struct(*compare).alias("_a"))
    right = b.select(*keys, F.struct(*compare).alias("_b"))
    return left.join(right, keys, "full_outer").select(*keys, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def parity_summary(parity: DataFrame) -> DataFrame:
    return parity.agg(F.count(F.lit(1)).alias("checked"), F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("differ"))


def latency_summary(log: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Requests and p50/p95 per key, by index percentile. `log` also has `meant` and `served`."""
    n = log.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.col("meant") != F.col("served")).alias("misrouted"))
    p = rank_pick(log, keys, value, {"p50": index_percentile_rank(0.5), "p95": index_percentile_rank(0.95)})
    return n.join(p, keys, "left").select(*keys, "n", "misrouted", F.round("p50", 1).alias("p50"), F.round("p95", 1).alias("p95"))


STOP_CHUNK = 4096


def stop_points(log: DataFrame, run: str, order: str, error: str, max_error_rate: float = 0.05, chunk: int = STOP_CHUNK) -> DataFrame:
    """Per run: finished and failed calls, and the first call at which the run should stop (null if none).

    A run stops at twenty failures in a row, or when after twenty calls the failure rate is over the limit. Calls are
    scanned in chunks of their order column; a chunk learns from one row per earlier chunk how many calls finished and
    failed and where the last success was, so a run of any length is scanned in parallel.
    """
    d = log.select(run, order, F.col(error).cast("int").alias("_e"), F.floor(F.col(order) / chunk).alias("_c"))
    base = carried(d, [run], "_c", {"_n0": (F.count(F.lit(1)), "sum"), "_e0": (F.sum("_e"), "sum")})
    w = Window.partitionBy(run, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    d = d.join(base, [run, "_c"])
    d = d.withColumn("finished", F.count(F.lit(1)).over(w) + F.coalesce("_n0", zero))
    d = d.withColumn("failed", F.sum("_e").over(w) + F.coalesce("_e0", zero))
    ok_at = F.when(F.col("_e") == 0, F.col("finished"))
    last = carried(d, [run], "_c", {"_ok0": (F.max(ok_at), "max")})
    d = d.join(last, [run, "_c"])
    in_a_row = F.col("finished") - F.greatest(F.coalesce(F.max(ok_at).over(w), zero), F.coalesce("_ok0", zero))
    bad = (in_a_row >= MAX_CONSECUTIVE) | ((F.col("finished") >= MIN_FOR_RATE) & (F.col("failed") / F.col("finished") > max_error_rate))
    d = d.withColumn("_bad", bad)
    return d.groupBy(run).agg(
        F.max("finished").alias("finished"), F.max("failed").alias("failed"), F.min(F.when(F.col("_bad"), F.col("finished"))).alias("stop_at")
    )
