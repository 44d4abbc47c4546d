"""Cutting lineage with tables that every executor can reach."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local applications that set none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local application without one gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    name = spark.sparkContext.applicationId
    if name not in _OWN:
        _OWN[name] = "file://" + tempfile.mkdtemp(prefix="oreloom-checkpoint-")
    return _OWN[name]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone; the folder is scratch space
        pass


#: Rows of a batch that goes to Python while a table is written, unless the session's setting is less.
BATCH_ROWS = 1000


#: Tasks that share a core's part of a table, at least, where work costs far more per row than reading it.
ROUNDS = 4


@contextmanager
def _set(spark: SparkSession, name: str, value: str | None) -> Iterator[None]:
    """A setting for a while, unless ``value`` is None; the session's comes back."""
    if value is None:
        yield
        return
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what executors and their Python workers hold of wide rows; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _set(spark, name, None if 0 < int(spark.conf.get(name)) <= BATCH_ROWS else str(BATCH_ROWS)):
        yield


def materialise(df: DataFrame, tag: str, rounds: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return it reread.

    A lost executor later costs a reread, not a recomputation, and values made from
    task-local state (row numbers) stay fixed.  The table is removed by ``release``, or at
    driver exit.  With ``rounds`` the files that ``df`` reads are dealt to so many tasks a core,
    unless a task would get less than opening a file counts for: with hardly more tasks than
    cores most cores wait for the last ones.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    with _small_batches(spark), _set(spark, "spark.sql.files.minPartitionNum", rounds and str(rounds * spark.sparkContext.defaultParallelism)):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._oreloom_path = path
    return out


def scratch(spark: SparkSession, tag: str) -> str:
    """A folder name below the shared one that nothing uses yet; what is written there goes at driver exit."""
    path = f"{shared_dir(spark)}/oreloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage, which lets shuffle files of jobs that are over go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame | None) -> None:
    """Removes tables that ``materialise`` wrote; nothing that is still to run may read them."""
    for table in tables:
        if path := getattr(table, "_oreloom_path", None):
            _remove(table.sparkSession, path)


def bounded_rows(df: DataFrame, limit: int) -> int | None:
    """Row count if at most ``limit``, else None; reads no more than it must."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


#: Rows of a task whose work costs far more per row than moving the row.
TASK_ROWS = 50_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` over all cores and in tasks of about ``rows`` rows, as it is if its scan has as many partitions.

    For work that costs far more per row than moving the row: a few unsplittable files
    would otherwise leave most cores idle, and tasks would grow with the table.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def ranges(df: DataFrame, key: str, weight: Column, most: int) -> list[DataFrame]:
    """``df`` in ranges of a key that weigh about ``most`` each, as it is if it weighs no more.

    For work that leaves more behind than a disk should hold at once.  Of a table in the key's order
    each range reads its own row groups alone; rows of one key stay together, nulls come first.
    Rows of a range are spread over all cores.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0
    n = -(-int(total) // most)
    if n < 2:
        return [spread(df)]
    cuts = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 100 * n)).first()[0]
    cuts = [None, *sorted(set(cuts)), None]
    tasks = df.sparkSession.sparkContext.defaultParallelism * ROUNDS
    inside = lambda low, high: (F.lit(True) if low is None else F.col(key) > low) & (F.lit(True) if high is None else F.col(key) <= high)
    found = [df.where(inside(low, high) if low is not None else F.col(key).isNull() | inside(low, high)) for low, high in zip(cuts, cuts[1:])]
    return [one.repartition(tasks) for one in found]
