"""The sliding-log rate limit as a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanlake.operators.spend import MICRO


def rate_limit_stream(calls: DataFrame, per_window: int, window: int, key: str = "key", key_type: str = "string") -> DataFrame:
    """At most `per_window` accepted calls per key in any `window` microseconds.

    `calls`: key, id, t. State per key is the accepted times still inside the window, never more than `per_window`.
    """

    def decide(group, batches, state: GroupState):
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        waits = []
        for t in rows["t"]:
            t = int(t)
            log = [x for x in log if x > t - window]
            if len(log) < per_window:
                log.append(t)
                waits.append(0)
            else:
                waits.append(max(log[0] + window - t, 1000) if log else window)
        state.update((log,))
        yield pd.DataFrame(
            {key: group[0], "id": rows["id"].to_numpy(), "accepted": [w == 0 for w in waits], "retry_after_s": [w / MICRO for w in waits]}
        )

    return calls.groupBy(key).applyInPandasWithState(
        decide, f"{key} {key_type}, id long, accepted boolean, retry_after_s double", "log array<long>", "append", GroupStateTimeout.NoTimeout
    )
