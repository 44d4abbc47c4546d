"""Dependency context: import classes, coupling and side effects of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import let
from ..functions.text import ordered_distinct
from ..plans.storage import bounded_rows, materialise

BROADCAST_MODULES, HEAVY = 200_000, 1000


def root_module(line: Column, language: Column) -> Column:
    """First part of the module an import names; null if there is none."""
    name = r"([A-Za-z0-9_.-]+)"
    quoted = F.regexp_extract(line, r"""["'][@]?([@A-Za-z0-9_./-]+)["']""", 1)
    word = F.regexp_extract(line, rf"\b(?:import|from|using|use|require|include|package|namespace)\s+{name}", 1)
    simple = F.regexp_extract(line, r"\b([A-Za-z_][A-Za-z0-9_]*)\b", 1)
    first = lambda x: F.substring_index(F.substring_index(x, "/", 1), ".", 1)
    generic = F.when(quoted != "", first(F.regexp_replace(quoted, "^@+", ""))).when(word != "", first(word)).otherwise(simple)
    python = F.when(line.rlike(r"^from\s+\.+\s*import\b"), "").when(line.rlike(r"^from\s+\."), first(F.regexp_extract(line, r"^from\s+\.+\s*([\w.]+)", 1)))
    python = F.coalesce(python, F.when(line.rlike(r"^(?:import|from)\s+\w"), F.regexp_extract(line, r"^(?:import|from)\s+(\w+)", 1)), generic)
    java = F.trim(F.substring_index(line, ".", 1))
    return F.nullif(F.when(language == "python", python).when(language == "java", java).otherwise(generic), F.lit(""))


def internal_modules(paths: DataFrame) -> DataFrame:
    """(module) names that resolve to a file of the tree: m.suffix, m/index.suffix, m/__init__.py."""
    paths = paths.where(F.substring_index("path", "/", 2) == F.col("path"))  # of others no name is without a slash
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    base = F.expr("substring(path, 1, length(path) - length(regexp_extract(path, '([.][^./]+)$', 1)))")
    found = paths.where(ending.isin(dims.SUFFIXES)).select("path", base.alias("base"))
    package = F.when(F.endswith("path", F.lit("/__init__.py")), F.regexp_replace("path", "/__init__[.]py$", "")).when(F.endswith("base", F.lit("/index")), F.regexp_replace("base", "/index$", ""))
    names = found.select(F.explode(F.array_compact(F.array(F.col("base"), package))).alias("module"))
    return names.where(~F.contains("module", F.lit("/"))).distinct()


def classify_imports(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(node_id, ord, import, module, kind): standard before internal before third-party.

    The standard names are a broadcast dimension.  Internal names grow with the tree: up to
    ``BROADCAST_MODULES`` they are broadcast; beyond, modules with over a ``HEAVY``-th of all
    imports (so fewer than that) are looked up apart by a broadcast, and the rest are joined.
    """
    spark = nodes.sparkSession
    rows = nodes.select("node_id", "language", F.posexplode(F.array_distinct("imports")).alias("ord", "import"))
    rows = rows.withColumn("module", root_module(F.col("import"), F.col("language"))).where("module is not null")
    known = F.broadcast(dims.stdlib(spark).withColumn("standard", F.lit(True)))
    own = internal_modules(paths).withColumn("internal", F.lit(True))
    rows = rows.join(known, "module", "left")
    if bounded_rows(own, BROADCAST_MODULES) is not None:
        rows = rows.join(F.broadcast(own), "module", "left")
    else:
        rows, own = materialise(rows, "imports"), materialise(own, "modules")
        heavy = rows.groupBy("module").agg(F.count("*").alias("n")).where(F.col("n") * HEAVY > rows.count()).select("module")
        heavy = F.broadcast(materialise(heavy.join(own, "module", "left").withColumn("heavy", F.lit(True)), "heavy"))
        apart = rows.join(heavy, "module", "left")
        rest = apart.where("heavy is null").drop("heavy", "internal").join(own, "module", "left")
        rows = apart.where("heavy").drop("heavy").unionByName(rest)
    kind = F.when(F.col("standard"), "stdlib").when(F.col("internal"), "internal").otherwise("pip")
    return rows.select("node_id", "ord", "import", "module", kind.alias("kind"))


def coupling(code: Column, imports: Column) -> Column:
    """Labels of business coupling in fixed order."""
    return let(F.lower(code), lambda low: let(F.lower(F.array_join(imports, "\n")), lambda names: _coupling(code, low, names)))


def _coupling(code: Column, low: Column, names: Column) -> Column:
    found = [F.when(F.contains(names, F.lit(t)) | F.contains(low, F.lit(t)), label) for t, label in dims.FRAMEWORKS]
    found.append(F.when(F.contains(code, F.lit("os.environ")), dims.ENVIRONMENT))
    found.append(F.when(F.contains(low, F.lit("settings.")) | F.contains(low, F.lit("config.")), dims.SETTINGS))
    found.append(F.when(F.contains(code, F.lit("self.")), dims.INSTANCE))
    return F.array_compact(F.array(*found))


def side_effects(code: Column) -> Column:
    """Labels of side effects in fixed order."""
    return F.array_compact(F.array(*(F.when(F.contains(code, F.lit(t)), label) for t, label, _ in dims.SIDE_EFFECTS)))


def has_hard_effects(effects: Column) -> Column:
    return F.arrays_overlap(effects, F.array(*(F.lit(label) for _, label, hard in dims.SIDE_EFFECTS if hard)))


def dependency_names(pip_imports: Column) -> Column:
    """Lower-cased roots of from and import lines, first occurrences."""
    name = lambda x: F.nullif(F.lower(F.regexp_extract(x, r"^(?:from|import)\s+([A-Za-z0-9_]+)", 1)), F.lit(""))
    return ordered_distinct(F.transform(pip_imports, name))


def with_dependencies(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes with stdlib_imports, pip_imports, internal_imports, business_coupling, side_effects.

    Lists of imports are classified once each, and nodes, which are wide, stay where they are while those are few.
    """
    of = lambda kind: F.transform(F.filter("classes", lambda c: c["kind"] == kind), lambda c: c["import"])
    lists = materialise(nodes.select("language", "imports").where(F.size("imports") > 0).distinct().withColumn("node_id", F.monotonically_increasing_id()), "lists")
    classes = classify_imports(lists, paths).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("ord", "import", "kind"))).alias("classes"))
    classes = materialise(lists.join(classes, "node_id").select("language", "imports", "classes"), "classes")
    out = nodes.join(classes, ["language", "imports"], "left").select(*nodes.columns, "classes")
    out = out.withColumn("classes", F.coalesce("classes", F.array().cast("array<struct<ord:int,import:string,kind:string>>")))
    return out.withColumns(
        {f"{k}_imports": of(k) for k in ("stdlib", "pip", "internal")} | {"business_coupling": coupling(F.col("raw_code"), F.col("imports")), "side_effects": side_effects(F.col("raw_code"))}
    ).drop("classes")


def internal_blocks(nodes: DataFrame, files: DataFrame, most: int = 4000) -> DataFrame:
    """(node_id, path, block): head of each internal file that a node imports."""
    base = F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/(?:__init__|index)$", "")
    blocks = files.select(base.alias("module"), "path", F.substring("text", 1, most).alias("block"))
    wanted = classify_imports(nodes, files.select("path")).where("kind = 'internal'").select("node_id", "module").distinct()
    return wanted.join(blocks, "module").select("node_id", "path", "block")
