"""Token-bucket admission over a table of requests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bucket:
    """limit tokens per window seconds, refilled continuously; a rejected request spends nothing."""

    def __init__(self, limit: int, window: float):
        self.limit, self.rate = limit, limit / window if window else 0.0
        self.state: dict = {}

    def check(self, identity, now: float, cost: float = 1) -> float | None:
        """Seconds to wait, or None if admitted. limit 0 admits everything."""
        if self.limit <= 0:
            return None
        tokens, wait = step(self.state.get(identity), now, min(cost, self.limit), self.limit, self.rate)
        if wait is None:
            self.state[identity] = tokens
        return wait


def step(state, now: float, cost: float, limit: float, rate: float):
    """((tokens, time), None) after an admission, or (state, seconds to wait)."""
    tokens, last = state or (float(limit), now)
    tokens = min(float(limit), tokens + (now - last) * rate)
    if tokens < cost:
        return state, round((cost - tokens) / rate, 3)
    return (tokens - cost, now), None


def admit(requests: DataFrame, limit: int, window: float, identity: str = "identity", ts: str = "ts", tie: str | None = None, cost: str | None = None) -> DataFrame:
    """requests with admitted and retry_after (null if admitted), in order of ts (seconds) and tie per identity.

    Identities are dealt to tasks and sorted; a task streams its rows and holds one bucket at a time, so an
    identity of any size needs no memory. Its own requests depend on each other and stay in one task.
    """
    if limit <= 0:
        return requests.withColumns({"admitted": F.lit(True), "retry_after": F.lit(None).cast("double")})
    rate = limit / window
    order = [identity, ts, *([tie] if tie else [])]
    width = len(requests.columns)
    names = [*requests.columns, "admitted", "retry_after"]

    def run(batches):
        now_of, state = object(), None
        for batch in batches:
            ids, times, costs = (c.to_pylist() for c in batch.columns[width:])
            waits = []
            for i, t, c in zip(ids, times, costs, strict=True):
                if i != now_of:
                    now_of, state = i, None
                state, wait = step(state, t, min(c, limit), limit, rate)
                waits.append(wait)
            cols = [*batch.columns[:width], pa.array([w is None for w in waits]), pa.array(waits, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    dealt = requests.repartition(identity).sortWithinPartitions(*order)
    price = F.col(cost) if cost else F.lit(1)
    wide = dealt.select(*requests.columns, F.col(identity).cast("string").alias("_i"), F.col(ts).cast("double").alias("_t"), price.cast("double").alias("_c"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return wide.mapInArrow(run, f"{fields}, admitted boolean, retry_after double")
