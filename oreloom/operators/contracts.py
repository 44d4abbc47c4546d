"""Field rules of records: each gives the first broken rule of a row, null if none is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, col, strip

SKILL_ID = r"^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?\z"
FILENAME = r"^[A-Za-z0-9](?:[A-Za-z0-9_.-]{0,118}[A-Za-z0-9])?\z"


def unsafe_path(path: Column | str) -> Column:
    """Whether a path is absolute or climbs; back slashes are slashes."""
    flat = F.translate(col(path), "\\", "/")
    return F.startswith(flat, F.lit("/")) | F.array_contains(F.split(flat, "/"), "..")


def node_error() -> Column:
    """Over the columns of a node."""
    lists = ("scope_path", "annotations", "imports", "dependencies")
    required = ("node_id", "language", "node_type", "name", "signature")
    out = F.when(F.lit(False), "")
    for c in required:
        out = out.when(blank(c), f"{c} must be non-empty")
    out = out.when(blank("raw_code"), "raw_code must be non-empty")
    out = out.when(F.col("file_path").isNotNull() & blank("file_path"), "file_path must be non-empty when supplied")
    out = out.when(F.coalesce(unsafe_path("file_path"), F.lit(False)), "file_path must be a safe project-relative path")
    for c in lists:
        out = out.when(F.exists(c, lambda x: blank(x)), "tuple entries must be non-empty strings")
    out = out.when((F.col("start_byte") < 0) | (F.col("end_byte") <= F.col("start_byte")), "end_byte must be greater than start_byte")
    return out.when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "end_line must be greater than or equal to start_line")


def normalised_docstring(docstring: Column | str) -> Column:
    return F.nullif(strip(docstring), F.lit(""))


def skill_id_error(skill_id: Column | str) -> Column:
    x = col(skill_id)
    return F.when(~x.rlike(SKILL_ID), "skill_id must use lower-kebab-case without a skill_ prefix").when(
        F.startswith(x, F.lit("skill-")) | F.startswith(x, F.lit("skill_")), "skill_id must not start with skill_ or skill-"
    )


def decision_error() -> Column:
    """Over decision, skill_id and the three scores."""
    has = F.col("skill_id").isNotNull()
    scores = [F.col(c).between(0.0, 1.0) for c in ("reusable_boundary_score", "domain_value_score", "coupling_score")]
    return (
        F.when(~F.col("decision").isin("extract", "skip"), "decision must be extract or skip")
        .when((F.col("decision") == "extract") & ~has, "extract decisions require skill_id")
        .when((F.col("decision") == "skip") & has, "skip decisions must not include skill_id")
        .when(~(scores[0] & scores[1] & scores[2]), "scores must lie in 0..1")
        .otherwise(skill_id_error("skill_id"))
    )


def script_error() -> Column:
    """Over a script's skill_id, filename, description, runtime_hint, example_command and script_text."""
    long = lambda c, n: F.length(c) > n
    return F.coalesce(
        skill_id_error("skill_id"),
        F.when(~F.col("filename").rlike(FILENAME) | long("filename", 80), "filename must be a safe single-file script or source filename")
        .when(F.startswith("filename", F.lit("skill_")), "filename must not start with skill_")
        .when(blank("script_text"), "script_text must contain source text")
        .when(blank("description") | long("description", 512), "description must have 1 to 512 characters")
        .when(long("runtime_hint", 64), "runtime_hint must be 64 characters or fewer")
        .when(long("example_command", 512), "example_command must be 512 characters or fewer"),
    )


def split_valid(rows: DataFrame, error: Column, stage: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rejects of the others)."""
    marked = rows.withColumn("_error", error)
    bad = marked.where("_error is not null").select(F.lit(stage).alias("stage"), F.col(key).alias("key"), F.col("_error").alias("error"))
    return marked.where("_error is null").drop("_error"), bad
