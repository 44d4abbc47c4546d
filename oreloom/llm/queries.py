"""Queries over the driver's tables, one per operator; oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import spread
from . import filter_audit, vector_codes
from .byte_bpe import op8
from .filter_audit import op12
from .kmeans_tree import op4
from .language import op9
from .licenses import scan_licenses
from .pii import op1
from .piece_bpe import op13
from .quality import op5
from .repacking import op10
from .simhash import op6
from .token_packing import pack_tokens
from .urls import op7
from .vector_codes import op11


#: What the operators read of each table.
_COLUMNS = {"documents": ("doc_id", "text", "lang", "source"), "embeddings": ("vec_id", "embedding", "label"), "pages": ("page_id", "url", "html")}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*_COLUMNS[name]))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1(_table(spark, sf_dir, "documents"))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4(_table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(_table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(_table(spark, sf_dir, "pages"), plain_forms=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(_table(spark, sf_dir, "documents"))


def op10_repacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(_table(spark, sf_dir, "documents"), special=True)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_token_packing, op3_licenses, op4_kmeans_tree, op5_quality, op6_simhash, op7_urls, op8_byte_bpe, op9_language, op10_repacking, op11_vector_codes, op12_filter_audit, op13_piece_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": vector_codes.SQL, "op12_filter_audit": filter_audit.SQL}
