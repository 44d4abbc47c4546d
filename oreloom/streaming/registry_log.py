"""The registry as a log: each batch adds its own entries, reading puts them together.

A folder holds ``base-N`` (all entries up to batch N, one row a key) and ``delta-N`` (what batch N
brought, the last of each key).  A batch writes its delta alone, so what it writes goes with the
batch and not with the registry.  When the deltas hold more than ``SHARE`` of the base's rows,
they are folded into a new base: each row is then rewritten a bounded number of times as the
registry doubles.  Every folder counts once its ``_SUCCESS`` is there, so a writer that fails
leaves the registry as it was, and a batch that is run again writes the same delta anew.

``statistics`` of a delta (rows, least and greatest key) stand in a small file beside its rows; a
lookup opens only deltas whose range holds its key.

Defined cases: an empty or missing folder has no entries; a null key is dropped; entries of one
batch with equal ``seq`` count by their other columns' order; deltas older than the base are left
for readers that are under way, and go with the next fold.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARE = 0.5


class RegistryLog:
    def __init__(self, spark: SparkSession, path: str, key: str = "skill_id", seq: str = "seq"):
        self.spark, self.path, self.key, self.seq = spark, path.rstrip("/"), key, seq

    def _at(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> list[tuple[str, int]]:
        """(kind, batch) of the folders that are whole, by batch."""
        fs = self._fs()
        if not fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at())]
        found = [(n.split("-")[0], int(n.split("-")[1])) for n in names if n.split("-")[0] in ("base", "delta")]
        return sorted((f for f in found if fs.exists(self._at(f"{f[0]}-{f[1]}/_SUCCESS"))), key=lambda f: (f[1], f[0]))

    def in_force(self) -> tuple[int | None, list[int]]:
        """The base, and the deltas after it."""
        base = max((n for kind, n in self.folders() if kind == "base"), default=None)
        return base, [n for kind, n in self.folders() if kind == "delta" and (base is None or n > base)]

    def _statistics(self, number: int) -> dict:
        stream = self._fs().open(self._at(f"delta-{number}/_statistics.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _last(self, rows: DataFrame, by: list[Column]) -> DataFrame:
        columns = [c for c in rows.columns if c != "_batch"]
        found = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("r"))
        return found.select("r.*")

    def append(self, batch: DataFrame, number: int) -> None:
        """Writes a batch's entries, last of each key; folds the log when its deltas have grown."""
        rows = batch.where(F.col(self.key).isNotNull())
        rest = [F.col(c) for c in rows.columns if c != self.seq and not rows.schema[c].dataType.typeName() in ("map", "variant")]
        target = f"delta-{number}"
        self._last(rows, [F.col(self.seq), *rest]).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/{target}")
        found = self.spark.read.parquet(f"{self.path}/{target}").agg(F.count("*").alias("rows"), F.min(self.key).cast("string").alias("least"), F.max(self.key).cast("string").alias("greatest")).first().asDict()
        stream = self._fs().create(self._at(f"{target}/_statistics.json"), True)
        stream.write(bytearray(json.dumps(found).encode()))
        stream.close()
        base, deltas = self.in_force()
        held = self.spark.read.parquet(f"{self.path}/base-{base}").count() if base is not None else 0
        if sum(self._statistics(n)["rows"] for n in deltas) > max(SHARE * held, 1):
            self.fold()

    def read(self) -> DataFrame | None:
        """All entries, the last of each key; None if there is none yet."""
        base, deltas = self.in_force()
        parts = ([("base", base)] if base is not None else []) + [("delta", n) for n in deltas]
        if not parts:
            return None
        read = [self.spark.read.parquet(f"{self.path}/{kind}-{n}").withColumn("_batch", F.lit(n)) for kind, n in parts]
        if len(read) == 1:
            return read[0].drop("_batch")
        new = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read[1:] if base is not None else read)
        new = self._last(new, [F.col("_batch")])
        if base is None:
            return new
        # the base stays where it is: only keys of the deltas are taken out of it
        return read[0].drop("_batch").join(new.select(self.key), self.key, "left_anti").unionByName(new, allowMissingColumns=True)

    def lookup(self, key: str) -> DataFrame | None:
        """The entry of one key, from the newest delta that holds it, else the base."""
        base, deltas = self.in_force()
        for n in reversed(deltas):
            known = self._statistics(n)
            if known["rows"] and known["least"] <= key <= known["greatest"]:
                found = self.spark.read.parquet(f"{self.path}/delta-{n}").where(F.col(self.key) == key)
                if not found.isEmpty():
                    return found
        return None if base is None else self.spark.read.parquet(f"{self.path}/base-{base}").where(F.col(self.key) == key)

    def fold(self) -> None:
        """Writes a new base of everything; what it replaces stays for readers, what that replaced goes."""
        rows = self.read()
        base, deltas = self.in_force()
        if rows is None or not deltas:
            return
        rows.repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/base-{deltas[-1]}")
        for kind, n in self.folders():
            if (kind == "base" and base is not None and n < base) or (kind == "delta" and base is not None and n <= base):
                self._fs().delete(self._at(f"{kind}-{n}"), True)


def registry_log_stream(entries: DataFrame, path: str, checkpoint: str, key: str = "skill_id", seq: str = "seq"):
    """Keeps a registry log up to date with a stream of entries; later batches win, within a batch the highest ``seq``."""
    append = lambda batch, number: RegistryLog(batch.sparkSession, path, key, seq).append(batch, number)
    return entries.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
