"""A keyed cache with a lifetime, as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, ts timestamp, hit boolean, value string"


def cached(requests: DataFrame, ttl_s: int, late: str = "10 minutes") -> DataFrame:
    """`requests`: key, ts, value (what a fetch at that time would give). A request
    within `ttl_s` of the last fetch of its key is a hit and gets what that
    fetch gave; any other one fetches. State is one value per key, dropped when
    the watermark passes its end. Requests may be late by `late`."""
    if ttl_s <= 0:
        raise ValueError("a cache needs a positive lifetime")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, held = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "value"])
        for ts, value in zip(rows["ts"], rows["value"]):
            micros = int(ts.value // 1000)
            hit = at is not None and micros < at + ttl_s * 1_000_000
            if not hit:
                at, held = micros, value
            out.append((key[0], ts, hit, held))
        state.update((at, held))
        state.setTimeoutTimestamp(max(at // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "value"])

    return requests.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, OUT, "at long, held string", "append", GroupStateTimeout.EventTimeTimeout)
