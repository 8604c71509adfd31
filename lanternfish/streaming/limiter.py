"""Token-bucket admission of a stream of requests, with the bucket as keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanternfish.operators.limiter import step

OUT = "identity string, ts double, cost double, admitted boolean, retry_after double"


class BucketProcessor(StatefulProcessor):
    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A bucket that was full and untouched for two windows says nothing: it may go.
        self.bucket = handle.getValueState("bucket", "tokens double, last double", ttlDurationMs=int(2000 * self.window))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.bucket.get()) if self.bucket.exists() else None
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")  # one micro-batch of one identity
        waits = []
        for t, c in zip(frame["ts"], frame["cost"], strict=True):
            state, wait = step(state, float(t), min(float(c), self.limit), self.limit, self.limit / self.window)
            waits.append(wait)
        if state is not None:
            self.bucket.update(state)
        yield pd.DataFrame({"identity": key[0], "ts": frame["ts"].to_numpy(), "cost": frame["cost"].to_numpy(), "admitted": [w is None for w in waits], "retry_after": pd.Series(waits, dtype="float64").to_numpy()})

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """requests (identity string, ts double, cost double) with admitted and retry_after; needs the RocksDB state store."""
    return requests.groupBy("identity").transformWithStateInPandas(BucketProcessor(limit, window), outputStructType=OUT, outputMode="append", timeMode="processingTime")
