"""Token bucket of a stream in event time: late requests within the watermark, and clients that go quiet.

A request waits in its client's state until the watermark has passed its arrival, so that whoever
came earlier is there, whatever batch brought it; then requests are granted in order of arrival,
as the batch form does.  A timer at the earliest waiting arrival asks for that.  Once nobody waits
and the bucket is full again, which a timer tells too, the client's state goes: a full bucket is
what a new client starts with, so nothing is forgotten that matters.

Needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB one, as every
``transformWithState`` does.  Requests behind the watermark are dropped, as event time has it; a
null client is a client; without arrival or tokens a request is an error at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .limits import OUT, grant

_COLUMNS = ["client", "request_id", "arrival", "tokens"]
_GIVEN = ["client", "request_id", "arrival", "granted", "wait", "error"]


def due(arrival: float) -> int:
    """Millisecond of event time at which nobody can come before ``arrival`` any more."""
    return ceil(arrival * 1000)


class Bucket(StatefulProcessor):
    def __init__(self, per_minute: float):
        self.capacity, self.rate = max(1.0, per_minute), per_minute / 60.0

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "level double, at double")
        self.waiting = handle.getListState("waiting", "request_id long, arrival double, tokens double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))[_COLUMNS]
        odd = came["arrival"].isna() | came["tokens"].isna()
        if odd.any():
            yield came[odd].assign(granted=None, wait=None, error="tokens must be positive")[_GIVEN]
            came = came[~odd]
        if len(came):
            self.waiting.appendList([(int(i), float(a), float(t)) for i, a, t in came[["request_id", "arrival", "tokens"]].itertuples(index=False)])
            self.handle.registerTimer(due(float(came["arrival"].min())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = [r for r in waiting if due(r[1]) <= mark]
        left = [r for r in waiting if due(r[1]) > mark]
        level, at = self.bucket.get() if self.bucket.exists() else (self.capacity, None)
        if ready:
            rows = pd.DataFrame(ready, columns=["request_id", "arrival", "tokens"]).assign(client=key[0])
            out, level, at = grant(rows, self.capacity, self.rate, level, float(rows["arrival"].min()) if at is None else at)
            self.bucket.update((level, at))
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            yield out
        if left:
            self.handle.registerTimer(min(due(r[1]) for r in left))
        elif at is not None:
            full = due(at + (self.capacity - level) / self.rate)
            if full <= mark:
                self.bucket.clear()
            else:
                self.handle.registerTimer(full)

    def close(self) -> None:
        pass


def token_bucket_events(requests: DataFrame, per_minute: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """(client, request_id, arrival, granted, wait, error) of a stream of (client, request_id, arrival, tokens)."""
    rows = requests.select(F.col("client").cast("string").alias("client"), F.col("request_id").cast("long").alias("request_id"), F.col("arrival").cast("double").alias("arrival"), F.col("tokens").cast("double").alias("tokens"))
    rows = rows.withColumn("at", F.timestamp_micros((F.col("arrival") * 1_000_000).cast("long"))).withWatermark("at", delay)
    return rows.groupBy("client").transformWithStateInPandas(Bucket(per_minute), OUT, "append", "EventTime")
