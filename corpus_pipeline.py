"""The corpus pipeline: five stages over documents, each one an operator of oreloom.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.llm.language import keep_known
from oreloom.llm.near_copies import keep_distinct
from oreloom.llm.pii import redact
from oreloom.llm.quality import keep_good
from oreloom.llm.repacking import op10
from oreloom.plans.storage import BATCH_ROWS, materialise


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's batches to Python to ``BATCH_ROWS`` rows at most: whole documents are wide rows, and a stage's result is written by whoever asks for it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted; removes boilerplate lines."""
    _small_batches(spark)
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of unknown language."""
    _small_batches(spark)
    return keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (Jaccard 0.8 or more of five-word shingles)."""
    return keep_distinct(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in training sequences."""
    return op10(docs, special=True, words=120_000)  # executors hold what earlier stages have taken, too


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: No SQL can train the recurrent network, fit the labelers or pack best-fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
    return docs
