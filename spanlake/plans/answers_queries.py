"""Registered queries: replies, citation gate, answer scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import split_of
from spanlake.operators import answers as A
from spanlake.operators.statistics import cluster_bootstrap, majority_answers
from spanlake.plans.cleaning_queries import WS_SQL
from spanlake.plans.labels_queries import CHOICES, choice_rows, indexed_suppliers
from spanlake.operators.labels import choice_items
from spanlake.plans.metrics_queries import boot_sql, round_interval
from spanlake.plans.registry import query
from spanlake.plans.terms_queries import SPLIT_SQL

S = F.concat


def replies(t):
    """Every conversation as one answer: each turn is a claim that quotes a turn, some loosely, some not at all."""
    turn = F.col("turn")
    quote = F.when(turn % 5 == 4, F.upper("text")).when(turn % 5 == 3, F.lit(" ")).otherwise(F.substring_index("text", " ", 3))
    ref = F.when(turn % 4 == 3, S(F.lit("Z"), turn.cast("string"))).otherwise(S(F.lit("[p"), turn.cast("string"), F.lit(" ]")))
    claim = F.struct(F.lit("claim").alias("text"), F.replace(quote, F.lit(" "), F.lit("  ")).alias("quote"), ref.alias("ref"))
    per = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", claim.alias("c")))), lambda x: x["c"]).alias("claims"))
    kind = F.col("conv_id") % 5
    state = F.when(kind == 0, "unfiled_schedule").when(kind == 1, "unsure").when(kind == 2, "not_stated").otherwise("answered")
    body = F.to_json(F.struct(state.alias("state"), F.lit("Yes").alias("choice"), "claims"))
    result = F.when(F.col("conv_id") % 7 == 0, S(F.lit("Here it is: "), body, F.lit("\nDone."))).when(F.col("conv_id") % 11 == 1, "I cannot say").otherwise(body)
    return per.select(F.col("conv_id").alias("answer_id"), result.alias("result"))


def blocks(t):
    """A conversation's turns as numbered blocks: the turn with a definition and, for system turns, an amendment."""
    def part(kind, text, no):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(no).cast("long").alias("amendment_no"))

    passage = part("passage", S(F.lit("Intro – "), "role"), None)
    parts = F.when(F.col("turn") % 2 == 0, F.array(passage, part("definition", F.col("text"), None))).otherwise(
        F.array(passage, part("amendment", F.col("text"), 2))
    )
    return t.conversations.select(
        F.col("conv_id").alias("answer_id"), F.col("turn").alias("ref_no"), (F.col("conv_id") * 67108864 + F.col("turn")).alias("passage_id"),
        (F.col("turn") == 0).alias("schedule_ref"), parts.alias("parts"),
    )


ANSWERS = rf"""
    cv AS (SELECT conv_id, turn, text, trim(regexp_replace(translate(text, '“”‘’–—', '""''''--'), '{WS_SQL}+', ' ', 'g')) AS nt,
                  conv_id % 11 = 1 AND conv_id % 7 <> 0 AS refused, conv_id % 5 AS kind FROM conversations),
    ok AS (SELECT *, CASE kind WHEN 0 THEN 'unfiled_schedule' WHEN 2 THEN 'not_stated' ELSE 'answered' END AS said FROM cv WHERE NOT refused AND kind <> 1),
    cq AS (SELECT *, CASE WHEN turn % 5 = 4 THEN upper(text) WHEN turn % 5 = 3 THEN ' ' ELSE array_to_string(string_split(text, ' ')[1:3], ' ') END AS quote FROM ok),
    cn AS (SELECT *, trim(regexp_replace(translate(quote, '“”‘’–—', '""''''--'), '{WS_SQL}+', ' ', 'g')) AS q FROM cq),
    gate AS (SELECT conv_id AS answer_id, CAST(turn AS INTEGER) AS claim_no, said, CASE WHEN q = '' THEN 'empty_quote' WHEN turn % 4 = 3 THEN 'bad_ref'
               WHEN NOT regexp_matches(nt, CASE WHEN regexp_matches(q, '^[\p{{L}}\p{{N}}_]') THEN '(^|[^\p{{L}}\p{{N}}_])' ELSE '' END || regexp_escape(q)
                                       || CASE WHEN regexp_matches(q, '[\p{{L}}\p{{N}}_]$') THEN '([^\p{{L}}\p{{N}}_]|$)' ELSE '' END) THEN 'quote_not_found' END AS reason, turn FROM cn)
"""


@query(
    "a1_parse_replies",
    f"WITH {ANSWERS}, n AS (SELECT conv_id, count(*) AS n, any_value(refused OR kind = 1) AS bad, any_value(kind) AS kind FROM cv GROUP BY conv_id) "
    "SELECT conv_id AS answer_id, CASE WHEN NOT bad THEN CASE kind WHEN 0 THEN 'unfiled_schedule' WHEN 2 THEN 'not_stated' ELSE 'answered' END END AS said, "
    "CAST(CASE WHEN bad THEN 0 ELSE n END AS INTEGER) AS n_claims, bad AS is_error FROM n",
)
def parse(t):
    p = A.parse_replies(replies(t))
    return p.select("answer_id", "said", F.size("claims").alias("n_claims"), F.col("error").isNotNull().alias("is_error"))


def gated(t):
    return A.citation_gate(A.explode_claims(A.parse_replies(replies(t))), blocks(t))


@query(
    "a2_citation_gate",
    f"""WITH {ANSWERS} SELECT answer_id, claim_no, reason, CASE WHEN reason IS NULL THEN answer_id * 67108864 + turn END AS passage_id,
        CASE WHEN reason IS NULL THEN CASE WHEN turn % 2 = 0 THEN 'definition' ELSE 'amendment' END END AS part FROM gate""",
)
def gate(t):
    return gated(t).select("answer_id", "claim_no", "reason", "passage_id", "part")


@query(
    "a3_final_state",
    f"""WITH {ANSWERS}, g AS (SELECT answer_id, any_value(said) AS said, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason IS NOT NULL) AS dropped,
              coalesce(bool_or(turn = 0) FILTER (WHERE reason IS NULL), false) AS sched, coalesce(bool_or(turn % 2 = 1) FILTER (WHERE reason IS NULL), false) AS am FROM gate GROUP BY answer_id),
    s AS (SELECT *, CASE WHEN said = 'unfiled_schedule' AND sched THEN 'unfiled_schedule' WHEN said = 'answered' AND kept > 0 THEN 'answered' ELSE 'not_stated' END AS state FROM g)
    SELECT answer_id, state, kept, dropped, state = 'answered' AND am AS amended FROM s""",
)
def states(t):
    return A.final_states(A.parse_replies(replies(t)), gated(t))


@query(
    "a4_match_choice",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'The “' || c_name || '” rule' WHEN 'MACHINERY' THEN 'Yes, ' || c_name
              WHEN 'FURNITURE' THEN 'The “' || c_name || '” rule' END AS matched FROM customer""",
)
def match(t):
    """Choices by segment: quotes dropped, other case and spacing, the quoted segment alone, a double match, none."""
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    options = F.array(S(F.lit("The “"), name, F.lit("” rule")), S(F.lit("Yes, "), name), F.lit("No"), F.lit("no"))
    choice = (
        F.when(seg == "BUILDING", S(F.lit("the  "), F.upper(name), F.lit(" RULE"))).when(seg == "MACHINERY", S(F.lit(" yes, "), F.lower(name)))
        .when(seg == "FURNITURE", F.lower(name)).when(seg == "AUTOMOBILE", F.lit("NO"))
    )
    return t.customer.select("c_custkey", A.match_choice(choice, options).alias("matched"))


def choice_scores(t):
    items, _ = choice_items(choice_rows(t), indexed_suppliers(t))
    items = items.withColumn("question", F.substring_index("item_id", "|", -1))
    n = F.col("contract_id")
    records = items.where(n % 10 != 0).select(
        "item_id", (n % 10 != 1).alias("answered"), F.when(n % 5 == 2, "Elsewhere").when(n % 5 == 3, F.upper("expected")).otherwise("yes").alias("choice"),
        F.when(n % 2 == 0, "answered").otherwise("not_stated").alias("state"),
    )
    base = majority_answers(items.where("split = 'tune'"), "question", "expected").select("question", "majority")
    return A.choice_outcomes(items, records, base)


SCORED = f"""{CHOICES},
    it AS (SELECT contract_id || '|' || question AS item_id, contract_id, question, category, {SPLIT_SQL.format('contract_id')} AS split, choices, got[1] AS expected FROM oc WHERE outcome = 'kept'),
    vt AS (SELECT question, expected, count(*) AS n FROM it WHERE split = 'tune' GROUP BY ALL),
    bs AS (SELECT question, first(expected ORDER BY n DESC, expected) AS majority FROM vt GROUP BY question),
    sc0 AS (SELECT it.*, majority, contract_id % 10 = 0 AS missing, contract_id % 10 = 1 AS error, contract_id % 2 = 0 AS cited,
                   CASE WHEN contract_id % 5 = 2 THEN 'elsewhere' WHEN contract_id % 5 = 3 THEN lower(expected) ELSE 'yes' END AS choice FROM it LEFT JOIN bs USING (question)),
    sc1 AS (SELECT *, list_filter(choices, lambda o: lower(o) = choice)[1] AS matched FROM sc0),
    sco AS (SELECT *, NOT missing AND NOT error AND matched IS NULL AS out_of_list, CASE WHEN NOT missing AND NOT error THEN CAST(coalesce(matched = expected, false) AS DOUBLE) END AS accuracy,
                   CASE WHEN NOT missing AND NOT error THEN CAST(coalesce(matched = expected, false) AND cited AS DOUBLE) END AS accuracy_cited,
                   CASE WHEN NOT missing AND NOT error THEN CAST(coalesce(majority = expected, false) AS DOUBLE) END AS baseline FROM sc1)
"""


@query(
    "a5_choice_counters",
    f"""WITH {SCORED} SELECT split, count(*) AS items, count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE error) AS errors,
        count(*) FILTER (WHERE out_of_list) AS out_of_list, count(accuracy) AS n FROM sco GROUP BY split""",
)
def choice_counters(t):
    return A.outcome_counters(choice_scores(t), ["split"])


@query(
    "a5_choice_intervals",
    f"""WITH {SCORED}, vals AS (SELECT split, 'accuracy' AS metric, contract_id AS cluster, accuracy AS value FROM sco UNION ALL SELECT split, 'accuracy_cited', contract_id, accuracy_cited FROM sco
         UNION ALL SELECT split, 'baseline', contract_id, baseline FROM sco UNION ALL SELECT split, 'vs_baseline', contract_id, accuracy - baseline FROM sco), {boot_sql('vals', 'split, metric', 200)} SELECT * FROM boot""",
)
def choice_intervals(t):
    """Accuracy, cited accuracy, majority baseline and their difference by split, with intervals by contract."""
    long = choice_scores(t).unpivot(["split", "contract_id"], ["accuracy", "accuracy_cited", "baseline", "vs_baseline"], "metric", "value")
    return round_interval(cluster_bootstrap(long, ["split", "metric"], "contract_id", "value", 200))


@query(
    "a6_judged_scores",
    f"""WITH j AS (SELECT {SPLIT_SQL.format('o_custkey')} AS split, o_orderpriority AS family, o_orderkey % 10 = 0 AS missing, o_orderkey % 10 = 1 AS error,
                         o_orderkey % 10 > 1 AND o_custkey % 9 = 0 AS wrong_deal, o_orderkey % 10 > 1 AND o_orderkey % 7 = 0 AS not_judged,
                         o_orderkey % 10 > 1 AND o_orderkey % 7 = 1 AS judge_unparsed, CASE WHEN o_orderkey % 10 > 1 AND o_orderkey % 7 > 1 THEN
                         CASE o_orderkey % 7 WHEN 2 THEN 'declined' WHEN 3 THEN 'partial' WHEN 4 THEN 'disagree' ELSE 'agree' END END AS v FROM orders)
    SELECT split, family, count(*) AS items, count(*) FILTER (WHERE missing) AS n_missing, count(*) FILTER (WHERE error) AS n_error, count(*) FILTER (WHERE wrong_deal) AS n_wrong_deal,
           count(*) FILTER (WHERE not_judged) AS n_not_judged, count(*) FILTER (WHERE judge_unparsed) AS n_judge_unparsed, count(*) FILTER (WHERE v = 'declined') AS n_declined, count(v) AS n,
           round(avg((v = 'agree')::INT), 4) AS agree, round(avg((v IN ('agree', 'partial'))::INT), 4) AS agree_or_partial FROM j GROUP BY ALL""",
)
def judged(t):
    k = F.col("o_orderkey")
    items = t.orders.select(k.alias("item_id"), split_of(F.col("o_custkey")).alias("split"), F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("expected"))
    records = t.orders.where(k % 10 != 0).select(
        k.alias("item_id"), (k % 10 != 1).alias("answered"), F.when(F.col("o_custkey") % 9 == 0, F.lit(-1)).when(F.col("o_custkey") % 9 != 1, F.col("o_custkey")).alias("contract_id")
    )
    v = F.when(k % 7 == 2, "declined").when(k % 7 == 3, "partial").when(k % 7 == 4, "disagree").when(k % 7 > 4, "agree")
    verdicts = t.orders.where(k % 7 != 0).select(k.alias("item_id"), v.alias("verdict"))
    return A.judged_counters(A.judged_outcomes(items, records, verdicts), ["split", "family"])


@query(
    "a7_abstention_scores",
    """WITH k AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'absent' WHEN '2-HIGH' THEN 'earnout' WHEN '3-MEDIUM' THEN 'schedule' ELSE 'unknown_deal' END AS g, o_orderkey AS k,
                       CASE o_orderkey % 4 WHEN 0 THEN 'answered' WHEN 1 THEN 'not_stated' WHEN 2 THEN 'which_deal' ELSE 'unfiled_schedule' END AS st FROM orders),
    e AS (SELECT *, CASE g WHEN 'schedule' THEN 'unfiled_schedule' WHEN 'unknown_deal' THEN 'which_deal' ELSE 'not_stated' END AS ex FROM k),
    d AS (SELECT g, CASE WHEN k % 9 = 0 THEN 'missing' WHEN k % 9 = 1 THEN 'errors' WHEN g = 'absent' THEN
                 CASE WHEN st = 'not_stated' THEN 'correct' WHEN st <> 'answered' THEN 'other' WHEN k % 5 = 0 THEN 'not_judged' WHEN k % 5 = 1 THEN 'judge_unparsed'
                      WHEN k % 5 = 2 THEN 'correct' WHEN k % 5 = 3 THEN 'false_answer' ELSE 'other' END
                 ELSE CASE WHEN st = ex THEN 'correct' WHEN st = 'answered' THEN 'false_answer' ELSE 'other' END END AS kind FROM e),
    c AS (SELECT g AS abstain_group, count(*) AS items, count(*) FILTER (WHERE kind = 'correct') AS correct, count(*) FILTER (WHERE kind = 'false_answer') AS false_answer, count(*) FILTER (WHERE kind = 'other') AS other,
                 count(*) FILTER (WHERE kind = 'errors') AS errors, count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'not_judged') AS not_judged, count(*) FILTER (WHERE kind = 'judge_unparsed') AS judge_unparsed FROM d GROUP BY g)
    SELECT *, correct + false_answer + other AS n, round(correct / (correct + false_answer + other), 4) AS correct_rate, round(false_answer / (correct + false_answer + other), 4) AS false_answer_rate FROM c""",
)
def abstention(t):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    group = F.when(p == "1-URGENT", "absent").when(p == "2-HIGH", "earnout").when(p == "3-MEDIUM", "schedule").otherwise("unknown_deal")
    expected = F.when(group == "schedule", "unfiled_schedule").when(group == "unknown_deal", "which_deal").otherwise("not_stated")
    state = F.when(k % 4 == 0, "answered").when(k % 4 == 1, "not_stated").when(k % 4 == 2, "which_deal").otherwise("unfiled_schedule")
    verdict = F.when(k % 5 == 2, "agree").when(k % 5 == 3, "disagree").when(k % 5 == 4, "declined")
    items = t.orders.select(k.alias("item_id"), group.alias("abstain_group"), expected.alias("expected"))
    records = t.orders.where(k % 9 != 0).select(k.alias("item_id"), (k % 9 != 1).alias("answered"), state.alias("state"))
    return A.abstention_scores(items, records, t.orders.where(k % 5 != 0).select(k.alias("item_id"), verdict.alias("verdict")))


@query(
    "a8_gate_rates",
    f"""WITH {ANSWERS} SELECT answer_id % 3 AS split, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) AS returned, round(count(*) FILTER (WHERE reason IS NULL) / count(*), 4) AS pass_rate,
        count(*) FILTER (WHERE reason = 'empty_quote') AS empty_quote, count(*) FILTER (WHERE reason = 'bad_ref') AS bad_ref, count(*) FILTER (WHERE reason = 'quote_not_found') AS quote_not_found FROM gate GROUP BY 1""",
)
def gate_rates(t):
    per = gated(t).groupBy("answer_id").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.collect_list("reason").alias("dropped"))
    return A.gate_rates(per.withColumn("split", F.col("answer_id") % 3), ["split"])


TOKENS = f"""
    tk AS (SELECT l_returnflag AS model, l_linestatus AS set_name, {SPLIT_SQL.format('l_orderkey')} AS split, CAST(l_quantity AS BIGINT) AS i, l_linenumber AS o FROM lineitem WHERE l_quantity > 5),
    tm AS (SELECT model, set_name, split, round(avg(i), 1) AS in_mean, round(avg(o), 1) AS out_mean, count(*) AS n FROM tk GROUP BY ALL)
"""


def called(t):
    i = F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(0).cast("long")
    return t.lineitem.select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("set_name"), split_of(F.col("l_orderkey")).alias("split"),
        i.alias("tokens_in"), F.col("l_linenumber").alias("tokens_out"),
    )


@query("a9_token_means", f"WITH {TOKENS} SELECT * FROM tm")
def tokens(t):
    return A.token_means(called(t), ["model", "set_name", "split"])


@query("a9_weighted_means", f"WITH {TOKENS} SELECT model, split, round(sum(in_mean * n) / sum(n), 1) AS in_mean, round(sum(out_mean * n) / sum(n), 1) AS out_mean FROM tm GROUP BY ALL")
def weighted(t):
    return A.weighted_token_means(A.token_means(called(t), ["model", "set_name", "split"]), ["model", "split"])


@query(
    "a10_refutation",
    """SELECT event_type, count(*) AS claims, count(*) FILTER (WHERE user_id % 3 = 0) AS not_refuted, count(*) FILTER (WHERE user_id % 3 = 2) AS unparsed,
              round(count(*) FILTER (WHERE user_id % 3 = 0) / count(*) FILTER (WHERE user_id % 3 < 2), 4) AS survival_rate FROM events GROUP BY event_type""",
)
def refutation(t):
    refuted = F.when(F.col("user_id") % 3 == 0, F.lit(False)).when(F.col("user_id") % 3 == 1, F.lit(True))
    return A.refutation_survival(t.events.select("event_type", refuted.alias("refuted")), ["event_type"])


@query(
    "a11_calibration",
    """WITH a AS (SELECT *, o_orderkey % 50 <> 0 AS ok, CAST(floor(o_totalprice / 100) AS BIGINT) * (o_orderkey % 13 <> 0)::INT AS ti, CAST(o_orderkey % 900 AS BIGINT) AS tou, o_totalprice / 1e6 AS cost, o_totalprice / 9e5 AS worst FROM orders),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok AND ti > 0) AS called, count(*) FILTER (WHERE NOT ok) AS errors, round(avg(ti) FILTER (WHERE ok AND ti > 0), 1) AS tokens_in_mean,
                 round(avg(tou) FILTER (WHERE ok AND ti > 0), 1) AS tokens_out_mean, round(sum(cost) FILTER (WHERE ok AND ti > 0) + sum(worst) FILTER (WHERE NOT ok), 4) AS cost_usd_total,
                 round(avg(cost) FILTER (WHERE ok AND ti > 0), 6) AS cost_per_answer_mean, round(min(worst - cost) FILTER (WHERE ok AND ti > 0), 6) AS worst_case_min_margin_usd,
                 quantile_disc(tou, 0.95) FILTER (WHERE ok AND ti > 0) AS tokens_out_p95, quantile_disc(tou, 0.99) FILTER (WHERE ok AND ti > 0) AS tokens_out_p99,
                 count(*) FILTER (WHERE ok AND o_custkey % 4 <> 0) AS paired, round(avg((o_orderkey % 6 <> 0)::INT) FILTER (WHERE ok AND o_custkey % 4 <> 0), 4) AS state_agreement,
                 round(avg((o_orderkey % 3 = 0)::INT) FILTER (WHERE ok AND o_custkey % 4 <> 0 AND o_orderstatus = 'F'), 4) AS accuracy_api,
                 round(avg((o_orderkey % 2 = 0)::INT) FILTER (WHERE ok AND o_custkey % 4 <> 0 AND o_orderstatus = 'F'), 4) AS accuracy_cli FROM a)
    SELECT *, round(accuracy_api - accuracy_cli, 4) AS accuracy_diff, CASE WHEN abs(round(accuracy_api - accuracy_cli, 4)) > 0.15 THEN 'accuracy differs too much' ELSE '' END AS reasons,
           CASE WHEN abs(round(accuracy_api - accuracy_cli, 4)) > 0.15 THEN 'stop' ELSE 'go' END AS verdict FROM c""",
)
def calibration(t):
    k, choice = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    api = t.orders.select(
        k.alias("item_id"), (k % 50 != 0).alias("ok"), F.when(k % 6 == 0, "not_stated").otherwise("answered").alias("state"),
        F.when(choice, (k % 3 == 0).cast("double")).alias("right"), F.when(k % 13 != 0, F.floor(F.col("o_totalprice") / 100)).otherwise(0).alias("tokens_in"),
        (k % 900).alias("tokens_out"), (F.col("o_totalprice") / 1e6).alias("cost"), (F.col("o_totalprice") / 9e5).alias("worst"),
    )
    cli = t.orders.where(F.col("o_custkey") % 4 != 0).select(k.alias("item_id"), F.lit("answered").alias("state"), F.when(choice, (k % 2 == 0).cast("double")).alias("right"))
    return A.calibration_summary(api, cli).withColumn("cost_usd_total", F.round("cost_usd_total", 4))


def two_prompt_runs(t):
    key = F.col("conv_id") * 67108864 + F.col("turn")
    a = t.conversations.where("role <> 'system'").select(key.alias("item_id"), F.substring(F.sha1("text"), 1, 12).alias("prompt_sha"), F.split("text", " ").alias("ids"))
    changed = F.when(F.col("turn") % 5 == 1, S("text", F.lit(" !"))).otherwise(F.col("text"))
    b = t.conversations.where("turn < 6").select(key.alias("item_id"), F.substring(F.sha1(changed), 1, 12).alias("prompt_sha"), F.split(changed, " ").alias("ids"))
    return a, b


@query("a12_run_parity", "SELECT conv_id * 67108864 + turn AS item_id, role <> 'system' AND turn < 6 AND turn % 5 <> 1 AS same FROM conversations WHERE role <> 'system' OR turn < 6")
def parity(t):
    """Prompt hash and ranked ids of two runs, item by item."""
    return A.run_parity(*two_prompt_runs(t), ["item_id"], ["prompt_sha", "ids"])


@query(
    "a12_parity_summary",
    """SELECT count(*) AS checked, count(*) FILTER (WHERE s) AS same, count(*) FILTER (WHERE NOT s) AS differ
       FROM (SELECT role <> 'system' AND turn < 6 AND turn % 5 <> 1 AS s FROM conversations WHERE role <> 'system' OR turn < 6)""",
)
def parity_summary(t):
    return A.parity_summary(parity(t))


@query(
    "a13_latency_summary",
    """WITH l AS (SELECT event_type AS route, CASE WHEN user_id % 3 = 0 THEN 'cache' ELSE 'live' END AS served, CASE WHEN event_id % 4 = 0 THEN 'cache' ELSE 'live' END AS meant, value AS ms FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY route, served ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY route, served) AS n FROM l)
    SELECT route, served, any_value(n) AS n, count(*) FILTER (WHERE meant <> served) AS misrouted, round(max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN ms END), 1) AS p50,
           round(max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN ms END), 1) AS p95 FROM r GROUP BY route, served""",
)
def latency(t):
    log = t.events.select(
        F.col("event_type").alias("route"), F.when(F.col("user_id") % 3 == 0, "cache").otherwise("live").alias("served"),
        F.when(F.col("event_id") % 4 == 0, "cache").otherwise("live").alias("meant"), F.col("value").alias("ms"),
    )
    return A.latency_summary(log, ["route", "served"])


@query(
    "a14_stop_points",
    """WITH e AS (SELECT user_id // 10 AS run, event_id, (event_type = 'error')::INT AS e FROM events),
    c AS (SELECT *, row_number() OVER w AS finished, sum(e) OVER w AS failed FROM e WINDOW w AS (PARTITION BY run ORDER BY event_id)),
    k AS (SELECT *, finished - coalesce(max(CASE WHEN e = 0 THEN finished END) OVER (PARTITION BY run ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS streak FROM c)
    SELECT run, max(finished) AS finished, CAST(max(failed) AS BIGINT) AS failed, min(CASE WHEN streak >= 20 OR (finished >= 20 AND failed / finished > 0.22) THEN finished END) AS stop_at FROM k GROUP BY run""",
)
def stops(t):
    log = t.events.select(F.floor(F.col("user_id") / 10).alias("run"), "event_id", (F.col("event_type") == "error").alias("e"))
    return A.stop_points(log, "run", "event_id", "e", 0.22, 1024)
