"""Spend, limits and cache in batch: costs, totals, admission, lifecycles, rate limits, serving decisions.

Amounts that decide something are whole micro-dollars or cents and times whole microseconds, so a decision never
depends on the order in which floats were added.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.chunked_scan import chunked_scan
from spanlake.operators.ordering import carried
from spanlake.session import cut_lineage

# Price unit, characters a token is assumed to hold, how old an open reservation may be, cacheable states.
PER_TOKENS = 1_000_000
CHARS_PER_TOKEN = 3
STALE_SECONDS = 600
CACHEABLE = ("answered", "not_stated", "unfiled_schedule")
MICRO = 1_000_000
DAY = 86_400 * MICRO


def cost_usd(prefix: str = "") -> Column:
    """Cost of a call from its four counters and its price row; a missing counter counts as zero."""
    def part(counter, price):
        return F.coalesce(F.col(prefix + counter), F.lit(0)) * F.col(price)

    return (
        part("input_tokens", "input") + part("output_tokens", "output") + part("cache_creation_tokens", "cache_write")
        + part("cache_read_tokens", "cache_read")
    ) / PER_TOKENS


def worst_case_usd(prompt_chars: Column, max_tokens: Column) -> Column:
    return (prompt_chars / CHARS_PER_TOKEN * F.col("input") + max_tokens * F.col("output")) / PER_TOKENS


def priced(usage: DataFrame, prices: DataFrame, key: str = "model") -> DataFrame:
    return usage.join(prices, key)


def counted_spend() -> Column:
    """What a ledger row counts: its worst case while open, its booked amount after."""
    return F.when(F.col("status") == "open", F.col("worst")).otherwise(F.col("usd"))


def spend_totals(ledger: DataFrame, unit: str) -> DataFrame:
    """(period, spent) per UTC `day` or `month`."""
    pattern = "yyyy-MM-dd" if unit == "day" else "yyyy-MM"
    return ledger.groupBy(F.date_format("ts", pattern).alias("period")).agg(F.round(F.sum(counted_spend()), 6).alias("spent"))


def settle_stale(ledger: DataFrame, now: Column) -> DataFrame:
    """Open reservations older than ten minutes belong to dead calls: settled at their worst case."""
    stale = (F.col("status") == "open") & (F.col("ts") < now - F.expr(f"INTERVAL {STALE_SECONDS} SECONDS"))
    return ledger.withColumn("usd", F.when(stale, F.col("worst")).otherwise(F.col("usd"))).withColumn(
        "status", F.when(stale, "settled").otherwise(F.col("status"))
    )


def reservation_states(events: DataFrame) -> DataFrame:
    """Final status of every reservation from its events.

    `events`: id, seq, op (reserve, settle, release), worst, usd (null when unknown). A settle books its amount, or
    the worst case when unknown; a release only frees an open reservation; a settle after a release, or without a
    reservation, is invalid. The first of settle and release decides, so each reservation is one combinable group.
    """
    closing = F.col("op").isin("settle", "release")
    settle = F.col("op") == "settle"
    g = events.groupBy("id").agg(
        F.max(F.when(F.col("op") == "reserve", F.col("worst"))).alias("worst"),
        F.min(F.when(closing, F.struct("seq", "op")))["op"].alias("_first"),
        F.max(F.when(settle, F.struct("seq", "usd")))["usd"].alias("_usd"),
        F.count_if(settle).alias("_settles"),
    )
    known = F.col("worst").isNotNull()
    status = F.when(~known, "unknown").when(F.col("_first").isNull(), "open").when(F.col("_first") == "release", "released").otherwise("settled")
    return g.select(
        "id", status.alias("status"), "worst",
        F.when(status == "settled", F.coalesce("_usd", "worst")).otherwise(0.0).alias("usd"),
        F.when(~known | (F.col("_first") == "release"), F.col("_settles")).otherwise(0).alias("invalid_settles"),
    )


def budget_state(month_left: Column, day_left: Column, min_call: Column) -> Column:
    return F.when((month_left < min_call) | (day_left < min_call), "reached").otherwise("ok")


def admit(requests: DataFrame, month_cap: int, day_cap: int, chunk: int = 6 * 3600 * MICRO) -> DataFrame:
    """Requests in arrival order, each admitted only if what was admitted before it this month and this day leaves room.

    `requests`: id, t (microseconds since 1970, UTC), worst (whole units). `chunk` divides a day.
    """
    at = F.timestamp_micros("t")
    rows = requests.select(
        F.date_format(at, "yyyy-MM").alias("key"), F.floor(F.col("t") / chunk).alias("chunk"), "t", "id", F.col("worst").alias("x")
    )

    demand = cut_lineage(rows.groupBy("key", "chunk").agg(F.sum("x").alias("_all"), F.min("x").alias("_least")))

    def step(state, t, x):
        if len(state) < 3:
            state.extend([0] * (3 - len(state)))
        month, day, added = state
        if month + added + x > month_cap or day + added + x > day_cap:
            return 0
        state[2] = added + x
        return 1

    def finish(state, chunk_no):
        return state[2:]

    def effective(spent, cap):
        """Zero when the chunk fits whole, the cap when nothing in it fits: what was spent matters in between only."""
        fits, shut = spent + F.col("_all") <= cap, spent + F.col("_least") > cap
        return F.when(fits, F.lit(0)).when(shut, F.lit(cap)).otherwise(spent).cast("bigint")

    def carry(table):
        added = F.coalesce(F.get("out", F.lit(0)), F.lit(0))
        before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        today = Window.partitionBy("key", F.floor(F.col("chunk") * chunk / DAY)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        spent = table.join(demand, ["key", "chunk"]).select(
            "*", F.coalesce(F.sum(added).over(before), F.lit(0)).alias("_m"), F.coalesce(F.sum(added).over(today), F.lit(0)).alias("_d")
        )
        month, day = effective(F.col("_m"), month_cap), effective(F.col("_d"), day_cap)
        shut = (month == month_cap) | (day == day_cap)
        return spent.select(
            "key", "chunk",
            F.when(shut, F.array(F.lit(month_cap).cast("bigint"), F.lit(day_cap).cast("bigint"))).otherwise(F.array(month, day)).alias("state"),
        )

    out = chunked_scan(rows, step, finish, carry)
    return out.select("id", F.col("key").alias("month"), "t", F.col("x").alias("worst"), (F.col("out") == 1).alias("admitted"))


def rate_limit(calls: DataFrame, per_window: int, window: int, key: str = "key", chunk: int | None = None) -> DataFrame:
    """A sliding log: at most `per_window` accepted calls per key in any `window` microseconds.

    `calls`: key, id, t. Returns (key, id, accepted, retry_after_s): zero when accepted, else the seconds until the
    oldest accepted call leaves the window.
    """
    if per_window == 0:
        return calls.select(key, "id", F.lit(False).alias("accepted"), F.lit(window / MICRO).alias("retry_after_s"))
    size = chunk or 8 * window
    rows = calls.select(F.col(key).alias("key"), F.floor(F.col("t") / size).alias("chunk"), "t", "id", F.lit(0).cast("long").alias("x"))

    def step(log, t, x):
        while log and log[0] <= t - window:
            log.pop(0)
        if len(log) < per_window:
            log.append(t)
            return 0
        return max(log[0] + window - t, 1000)

    def finish(log, chunk_no):
        return [t for t in log if t > (chunk_no + 1) * size - window]

    def carry(table):
        w = Window.partitionBy("key").orderBy("chunk")
        came = F.coalesce(F.lag("out").over(w), F.array().cast("array<bigint>"))
        out = table.withColumn("_s", came).withColumn("_from", F.col("chunk") * size - window)
        return out.select("key", "chunk", F.filter("_s", lambda x: x > F.col("_from")).alias("state"))

    out = chunked_scan(rows, step, finish, carry)
    return out.select(
        F.col("key").alias(key), "id", (F.col("out") == 0).alias("accepted"), (F.col("out") / MICRO).alias("retry_after_s")
    )


@F.pandas_udf(T.StringType())
def client_key(hosts: pd.Series) -> pd.Series:
    """The address a limit counts: IPv4 as is, IPv6 by its /64, a mapped IPv4 as IPv4, anything else unchanged."""

    def one(host):
        try:
            ip = ipaddress.ip_address(host)
        except ValueError:
            return host
        if ip.version == 4:
            return str(ip)
        return str(ip.ipv4_mapped or ipaddress.ip_network((int(ip) >> 64 << 64, 64)))

    return hosts.map(one)


def cache_rows(answers: DataFrame) -> DataFrame:
    """The cache after these answers: cacheable states only, the latest per (model, prompt_sha)."""
    kept = answers.where(F.col("state").isin(*CACHEABLE))
    return kept.groupBy("model", "prompt_sha").agg(F.max_by(F.struct("state", "payload"), "created").alias("c"), F.max("created").alias("created")).select(
        "model", "prompt_sha", "c.state", "c.payload", "created"
    )


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("model", "prompt_sha", F.col("state").alias("cached_state"), "payload"), ["model", "prompt_sha"], "left")


def serving_decision(cached_state: Column, budget: Column) -> Column:
    """What a request gets: a cached answer, a notice that the budget is spent, or a fresh call."""
    return (
        F.when(cached_state.isNotNull() & (budget == "reached"), "budget_cached")
        .when(cached_state.isNotNull(), cached_state)
        .when(budget == "reached", "budget_reached")
        .otherwise("fresh")
    )


def smallest_gap(log: DataFrame, ts: str = "t", chunk: int = 60 * MICRO) -> DataFrame:
    """Requests and the smallest spacing between two neighbours, over the whole log.

    Neighbours inside a minute are compared there; between minutes only first and last times meet, so no task sees
    more than one minute of requests.
    """
    d = log.select(F.col(ts).alias("t"), F.floor(F.col(ts) / chunk).alias("_c"))
    inner = F.col("t") - F.lag("t").over(Window.partitionBy("_c").orderBy("t"))
    inside = d.withColumn("_g", inner).groupBy("_c").agg(
        F.min("_g").alias("g"), F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n")
    )
    days = inside.withColumn("_d", F.floor(F.col("_c") / 1440))
    before = carried(days, ["_d"], "_c", {"_prev": (F.max("last"), "last")})
    daily = days.groupBy("_d").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    across = daily.select("_d", (F.col("first") - F.lag("last").over(Window.orderBy("_d"))).alias("g")).agg(F.min("g").alias("g"))
    within = days.join(before, ["_d", "_c"]).agg(
        F.least(F.min("g"), F.min(F.col("first") - F.col("_prev"))).alias("g"), F.sum("n").alias("requests")
    )
    return within.select("requests", F.round(F.least(F.col("g"), across.scalar()) / MICRO, 3).alias("min_gap_s"))
