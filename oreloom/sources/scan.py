"""Source scans: trees of files to decoded rows, with a row for every reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import lines, strip, suffix
from .tree import read_tree, readable

FILE = "path string, text string"


def shebang_sniff(content: Column) -> Column:
    """Whether binary content looks like a script: starts ``#!``, no NUL in its first 256 bytes."""
    head = F.substring(content, 1, 256)
    return F.startswith(head, F.lit(b"#!")) & ~F.contains(head, F.lit(b"\x00"))


def safe_relative_path(path: Column, root: str) -> Column:
    """Below ``root`` the relative path, else the base name; null if it would climb out."""
    root = root.rstrip("/") + "/"
    inside = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(F.substring_index(path, "/", -1))
    return F.when(~F.array_contains(F.split(inside, "/"), ".."), inside)


def scan_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, content) of files with a known suffix, or without one but with a shebang.

    Other files aren't opened (``sources.tree``), but for roots in a store that only Spark's
    readers know: there the binary reader reads every file, and passes over hidden names.
    """
    if readable(root):
        return read_tree(spark, root, dims.SUFFIXES, **options).select("path", "content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), "^[a-z]+:/+", "/")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    files = files.select(plain.alias("full"), "content", F.regexp_replace(base, "/+$", "").alias("base"))
    relative = F.expr("substring(full, length(base) + 2)")
    files = files.withColumn("path", F.when(F.startswith("full", F.concat("base", F.lit("/"))), relative).otherwise(F.substring_index("full", "/", -1)))
    ending = F.lower(suffix("path"))
    known = ending.isin(dims.SUFFIXES)
    return files.where(known | ((ending == "") & shebang_sniff(F.col("content")))).select("path", "content")


def decode(files: DataFrame) -> DataFrame:
    """(path, text, error): strict UTF-8, a byte-order mark is kept."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    out = files.select("path", text.alias("text"))
    return out.withColumn("error", F.when(F.col("text").isNull(), "not UTF-8").when(strip("text") == "", "empty source"))


def with_runtime(files: DataFrame) -> DataFrame:
    """Adds language, display, runtime_hint, command: by suffix, else by shebang, else generic."""
    spark = files.sparkSession
    first = F.get(lines("text"), F.lit(0))
    words = F.split(strip(F.substring(first, F.lit(3), F.length(first))), r"\s+")
    base = F.substring_index(F.element_at(words, 1), "/", -1)
    interpreter = F.when(F.startswith(first, F.lit("#!")), F.when(base == "env", F.element_at(words, -1)).otherwise(base))
    out = files.withColumn("suffix", F.lower(suffix("path"))).withColumn("interpreter", interpreter)
    out = out.join(F.broadcast(dims.suffixes(spark)), "suffix", "left").join(F.broadcast(dims.shebangs(spark)), "interpreter", "left")
    out = out.withColumn("language", F.coalesce("suffix_language", "shebang_language", F.lit("generic")))
    table = dims.runtimes(spark).select("language", "display", "runtime_hint", "command")
    return out.join(F.broadcast(table), "language").drop("suffix_language", "shebang_language", "interpreter", "suffix")


def ordered(files: DataFrame) -> DataFrame:
    """Files in path order by component, as a tree walk sorts them."""
    return files.orderBy(F.split("path", "/"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a registry file; empty if it is missing or no valid registry."""
    from ..operators.registry import ENTRY

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], ENTRY)
    found = spark.read.schema(f"version int, generated_at string, skills array<struct<{ENTRY}>>").json(path, multiLine=True, mode="PERMISSIVE")
    return found.where("skills is not null").select(F.explode("skills").alias("s")).select("s.*")


def list_workspace(spark: SparkSession, root: str, most: int = 200) -> DataFrame:
    """Sorted paths below a folder, folders with a final slash, cut at ``most`` with a marker row."""
    return shown_entries(read_tree(spark, root, content=False), most)


def shown_entries(listed: DataFrame, most: int = 200) -> DataFrame:
    """``list_workspace`` of a listing (path)."""
    names = listed.select(F.col("path").alias("entry"))
    shown = names.orderBy("entry").limit(most)
    more = names.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.concat(F.lit("... "), F.col("n") - most, F.lit(" more")).alias("entry"))
    return shown.unionByName(more)


def read_workspace_text(content: Column, most: int = 24_000) -> Column:
    """Lossy UTF-8 text of binary content, cut at ``most`` characters with a marker."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(f"\n...[truncated after {most} characters]"))).otherwise(text)


def mounts(listed: DataFrame) -> DataFrame:
    """(skill, size) of a listing (path, length): its folders directly below the root that hold a SKILL.md."""
    inside = listed.where(F.col("path").rlike(r"\A[^/._][^/]*/SKILL\.md\z"))
    return inside.select(F.substring_index("path", "/", 1).alias("skill"), F.col("length").alias("size"))


def skill_folders(spark: SparkSession, root: str) -> DataFrame:
    """(skill, size) of the folders directly below ``root`` that hold a SKILL.md; error if there is none."""
    if readable(root):  # Spark's file index would hold every file of the tree in the driver
        rows = mounts(read_tree(spark, root, content=False))
        if rows.isEmpty():
            raise ValueError(f"skill directory contains no immediate SKILL.md entries: {root}")
        return rows
    found = spark.read.format("binaryFile").option("pathGlobFilter", "SKILL.md").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/").split("://")[-1].lstrip("/"))
    inside = F.expr("substring(regexp_replace(path, '^[a-z]+:/+', ''), length(base) + 2)")
    rows = found.select("path", "length", base.alias("base")).select(inside.alias("inside"), "length")
    rows = rows.where(F.size(F.split("inside", "/")) == 2).select(F.split("inside", "/")[0].alias("skill"), F.col("length").alias("size"))
    if rows.isEmpty():
        raise ValueError(f"skill directory contains no immediate SKILL.md entries: {root}")
    return rows
