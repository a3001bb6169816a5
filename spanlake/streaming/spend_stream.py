"""Spend totals, capped admission and stale reservations as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanlake.operators.spend import DAY, STALE_SECONDS, counted_spend


def spend_by_day(ledger: DataFrame, delay: str = "1 day") -> DataFrame:
    """Spend per UTC day in update mode; a day's state is dropped once the watermark passes it."""
    return (
        ledger.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.round(F.sum(counted_spend()), 6).alias("spent"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("period"), "spent")
    )


def admit_stream(requests: DataFrame, month_cap: int, day_cap: int) -> DataFrame:
    """Capped admission per UTC month: requests (id, t in microseconds, worst) decided in arrival order.

    State per month is three numbers. Requests of one micro-batch are ordered by time, then id.
    """

    def decide(key, batches, state: GroupState):
        month, day, spent = state.get if state.exists else (0, -1, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        admitted = []
        for t, worst in zip(rows["t"], rows["worst"]):
            today = int(t) // DAY
            spent = spent if today == day else 0
            day = today
            ok = month + worst <= month_cap and spent + worst <= day_cap
            month, spent = (month + int(worst), spent + int(worst)) if ok else (month, spent)
            admitted.append(ok)
        state.update((month, day, spent))
        yield pd.DataFrame({"id": rows["id"], "month": key[0], "t": rows["t"], "worst": rows["worst"], "admitted": admitted})

    keyed = requests.withColumn("month", F.date_format(F.timestamp_micros("t"), "yyyy-MM"))
    return keyed.groupBy("month").applyInPandasWithState(
        decide, "id long, month string, t long, worst long, admitted boolean", "month_spent long, day long, day_spent long",
        "append", GroupStateTimeout.NoTimeout,
    )


def settle_stale_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Reservations that stay open for ten minutes of event time, emitted as settled at their worst case.

    `events`: id, ts, op (reserve, settle, release), worst. A closed reservation leaves no state behind.
    """

    def watch(key, batches, state: GroupState):
        if state.hasTimedOut:
            worst = state.get[0]
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "status": ["settled"], "usd": [worst]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        if (rows["op"] != "reserve").any():
            if state.exists:
                state.remove()
            return
        first = rows.iloc[0]
        state.update((float(first["worst"]),))
        state.setTimeoutTimestamp(int(first["ts"].timestamp() * 1000) + STALE_SECONDS * 1000)
        yield from ()

    return (
        events.withWatermark("ts", delay)
        .groupBy("id")
        .applyInPandasWithState(watch, "id long, status string, usd double", "worst double", "append", GroupStateTimeout.EventTimeTimeout)
    )
