"""Token bucket: when each request may go, per client; over a table, and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.storage import materialise

OUT = "client string, request_id long, arrival double, granted double, wait double, error string"


def grant(requests: pd.DataFrame, capacity: float, rate: float, level: float, at: float) -> tuple[pd.DataFrame, float, float]:
    """Grant times of requests in arrival order; the bucket's level and time afterwards.

    A request waits for what is missing; those behind it wait for it.
    """
    rows = []
    for r in requests.sort_values(["arrival", "request_id"]).itertuples():
        if not 0 < r.tokens <= capacity:
            problem = "tokens must be positive" if r.tokens <= 0 else "requested tokens exceed bucket capacity"
            rows.append((r.client, r.request_id, r.arrival, None, None, problem))
            continue
        now = max(at, r.arrival)
        level, at = min(capacity, level + (now - at) * rate), now
        if level < r.tokens:
            at += (r.tokens - level) / rate
            level = r.tokens
        level -= r.tokens
        rows.append((r.client, r.request_id, r.arrival, at, at - r.arrival, None))
    return pd.DataFrame(rows, columns=["client", "request_id", "arrival", "granted", "wait", "error"]), level, at


def token_bucket(requests: DataFrame, per_minute: float = 60.0, block: float = 3600.0) -> DataFrame:
    """Batch form over (client, request_id, arrival, tokens), by running sums and maxima alone.

    After request n the bucket is full again at V(n) = max(arrival, V(n - 1)) + tokens / rate,
    which is S(n) / rate + the largest arrival(k) - S(k - 1) / rate so far, S being the tokens
    asked for.  A request goes when it has come, those before it have gone, and V(n - 1) is no
    further off than what it leaves in the bucket takes to refill.

    Windows run within ``block`` seconds of a client and a row a block carries their ends on,
    so a client with very many requests is spread over tasks.
    """
    capacity, rate = max(1.0, per_minute), per_minute / 60.0
    error = F.when(F.col("tokens") <= 0, "tokens must be positive").when(F.col("tokens") > capacity, "requested tokens exceed bucket capacity")
    rows = requests.select(F.col("client").cast("string").alias("client"), F.col("request_id").cast("long").alias("request_id"), F.col("arrival").cast("double").alias("arrival"), F.col("tokens").cast("double").alias("tokens"))
    rows = rows.withColumn("error", F.when(F.col("tokens").isNull(), "tokens must be positive").otherwise(error)).withColumn("block", F.floor(F.col("arrival") / block))
    rows = rows.withColumn("asked", F.when(F.col("error").isNull(), F.col("tokens")).otherwise(0.0))
    key = ("client", "block")
    inside = Window.partitionBy(*key).orderBy("arrival", "request_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("client").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def joined(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        same = [rows[c].eqNullSafe(blocks[c]) for c in key]
        return rows.join(blocks, same[0] & same[1], "left").drop(*(blocks[c] for c in key))

    lead = F.when(F.col("error").isNull(), F.col("arrival") - (F.col("total") - F.col("asked")) / rate)
    rows = rows.withColumn("total", F.sum("asked").over(inside)).withColumn("lead", F.max(lead).over(inside))
    rows = materialise(rows, "requests")
    blocks = rows.groupBy(*key).agg(F.sum("asked").alias("in_block"), F.max("lead").alias("far"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("in_block").over(earlier), F.lit(0.0))).withColumn("prior", F.max(F.col("far") - F.col("before") / rate).over(earlier))
    rows = joined(rows, blocks.select(*key, "before", "prior"))
    full = (F.col("before") + F.col("total") - F.col("asked")) / rate + F.greatest(F.col("prior"), F.col("lead") - F.col("before") / rate)
    ready = F.when(F.col("error").isNull(), F.greatest(F.col("arrival"), full + (F.col("tokens") - capacity) / rate))
    rows = materialise(rows.withColumn("ready", F.max(ready).over(inside)), "ready")
    blocks = rows.groupBy(*key).agg(F.max("ready").alias("last")).withColumn("gone", F.max("last").over(earlier))
    granted = F.when(F.col("error").isNull(), F.greatest("ready", "gone"))
    out = joined(rows, blocks.select(*key, "gone")).withColumn("granted", granted)
    return out.select("client", "request_id", "arrival", "granted", (F.col("granted") - F.col("arrival")).alias("wait"), "error")


def token_bucket_stream(requests: DataFrame, per_minute: float = 60.0) -> DataFrame:
    """Streaming form: the bucket's level and time are each client's state."""
    capacity, rate = max(1.0, per_minute), per_minute / 60.0

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        level, at = state.get if state.exists else (capacity, float(pdf["arrival"].min()))
        out, level, at = grant(pdf, capacity, rate, level, at)
        state.update((level, at))
        yield out

    return requests.groupBy("client").applyInPandasWithState(run, OUT, "level double, at double", "append", GroupStateTimeout.NoTimeout)


def registry_stream(entries: DataFrame, path: str, checkpoint: str):
    """Keeps a registry table up to date with a stream of entries (skill_id, seq, ...): last wins.

    Each micro-batch writes a new version beside the old one and then points to it, so a
    failure between leaves the old version in force.
    """
    from ..operators.registry import upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = at("x").getFileSystem(hadoop)
        versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if fs.exists(at(f"{s.getPath().getName()}/_SUCCESS"))) if fs.exists(jvm.org.apache.hadoop.fs.Path(path)) else []
        older = [v for v in versions if v < number + 1]
        old = spark.read.parquet(f"{path}/v{older[-1]}") if older else None
        new = batch if old is None else old.unionByName(batch)
        upsert(None, new.withColumn("_seq", F.col("seq")), seq="_seq").write.mode("overwrite").parquet(f"{path}/v{number + 1}")

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
