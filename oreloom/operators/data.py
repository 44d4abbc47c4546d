"""The data computations: components of edge lists, sequence content, numeric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, strip


def parse_edges(rows: DataFrame, column: str = "edge", delimiter: str = ",", keep: tuple[str, ...] = ()) -> DataFrame:
    """(left, right, error) of delimited text: exactly two non-empty parts, trimmed; columns in ``keep`` come first."""
    parts = F.transform(F.split(column, rf"\Q{delimiter}\E", -1), strip)
    good = (F.size(parts) == 2) & ~F.array_contains(parts, "")
    return rows.select(*keep, F.when(good, parts[0]).alias("left"), F.when(good, parts[1]).alias("right"), F.when(~F.coalesce(good, F.lit(False)), "edge must have two parts").alias("error"))


def parse_json_edges(rows: DataFrame, column: str = "edges") -> DataFrame:
    """The same of JSON lists of pairs."""
    pairs = F.from_json(column, "array<array<string>>")
    out = rows.select(pairs.alias("p"), F.explode_outer(pairs).alias("pair"))
    good = (F.size("pair") == 2) & ~F.exists("pair", lambda x: x.isNull())
    bad = F.col("p").isNull() | (F.col("pair").isNotNull() & ~F.coalesce(good, F.lit(False)))
    return out.where(F.col("p").isNull() | F.col("pair").isNotNull()).select(
        F.when(good, F.col("pair")[0]).alias("left"), F.when(good, F.col("pair")[1]).alias("right"), F.when(bad, "edge must have two parts").alias("error")
    )


def gc_content(sequence: Column | str) -> Column:
    """Share of G and C in either case; 0 for an empty sequence."""
    s = col(sequence)
    return F.when(F.length(s) == 0, 0.0).otherwise(F.regexp_count(F.upper(s), F.lit("[GC]")) / F.length(s))


def reverse_complement(sequence: Column | str) -> Column:
    """Complement read backwards, case kept; other characters stay as they are."""
    return F.reverse(F.translate(col(sequence), "ACGTacgt", "TGCAtgca"))


def summarize_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max, mean) of numeric columns; a column of nulls gives no row."""
    long = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "v").where("v is not null")
    return long.groupBy("column").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))


def summarize_json(rows: DataFrame, column: str, include: list[str] | None = None, exclude: list[str] | None = None, allow_numeric_strings: bool = False, count_booleans: bool = False) -> DataFrame:
    """(column, min, max, mean) per key of JSON objects; other values than numbers are passed over."""
    if set(include or ()) & set(exclude or ()):
        raise ValueError("include and exclude must not overlap")
    variant = rows.select(F.try_parse_json(column).alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    cells = variant.lateralJoin(variant.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    number = F.when(kind.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get("value", "$", "double"))
    if allow_numeric_strings:
        number = F.coalesce(number, F.when(kind == "STRING", strip(F.try_variant_get("value", "$", "string")).try_cast("double")))
    if count_booleans:
        number = F.coalesce(number, F.when(kind == "BOOLEAN", F.try_variant_get("value", "$", "boolean").cast("double")))
    out = cells.select(F.col("key").alias("column"), number.alias("x")).where("x is not null")
    if include:
        out = out.where(F.col("column").isin(*include))
    if exclude:
        out = out.where(~F.col("column").isin(*exclude))
    return out.groupBy("column").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))
