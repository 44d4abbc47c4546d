"""The registry of packaged skills: rows, and last-wins merge by skill_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALIDATION = "passed: boolean, static_errors: array<string>, security_findings: array<string>, help_exit_code: int, example_exit_code: int, stdout_sample: string, stderr_sample: string"
ENTRY = (
    "skill_id: string, script: string, doc: string, language: string, runtime_hint: string, source: string, source_file: string, source_span: map<string,int>, "
    f"tags: array<string>, dependencies: array<string>, status: string, validation: struct<{VALIDATION}>"
)


def entries(packages: DataFrame) -> DataFrame:
    """Registry rows of validated packages, with their place in run order as ``seq``."""
    none = F.lit(None)
    return packages.select(
        "skill_id", F.concat("skill_id", F.lit("/scripts/"), "filename").alias("script"), F.concat("skill_id", F.lit("/SKILL.md")).alias("doc"), "language", "runtime_hint", "source",
        F.col("file_path").alias("source_file"), F.create_map(F.lit("start_line"), F.col("start_line").cast("int"), F.lit("end_line"), F.col("end_line").cast("int")).alias("source_span"),
        "tags", F.col("dep_names").alias("dependencies"), F.when(F.col("passed"), "active").otherwise("failed-validation").alias("status"),
        F.struct("passed", "static_errors", "security_findings", "help_exit_code", none.cast("int").alias("example_exit_code"), none.cast("string").alias("stdout_sample"), none.cast("string").alias("stderr_sample")).alias("validation"),
        F.struct(F.split("file_path", "/"), "start_byte", "ordinal").alias("seq"),
    )


def upsert(existing: DataFrame | None, new: DataFrame, key: str = "skill_id", seq: str = "seq") -> DataFrame:
    """Rows of ``existing`` and ``new``; of each key the new row with the highest ``seq``, else the old one.

    max_by combines before its shuffle, so a key that comes very often stays cheap.
    """
    latest = lambda df: df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != seq)), F.col(seq)).alias("r")).select("r.*")
    fresh = latest(new)
    if existing is None:
        return fresh
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def document(rows: DataFrame, generated_at: Column) -> DataFrame:
    """One row: the registry file's JSON, skills sorted by skill_id.

    Collects all entries into one value; a registry file is one document by nature.
    """
    by_id = lambda a, b: F.when(a["skill_id"] < b["skill_id"], -1).when(a["skill_id"] > b["skill_id"], 1).otherwise(0)
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), by_id).alias("skills"))
    return listed.select(F.to_json(F.struct(F.lit(1).alias("version"), generated_at.alias("generated_at"), "skills"), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))
