"""Candidate decisions: one ordered ladder of reasons to skip, tags and names of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, lines, slugify
from .dependencies import dependency_names, has_hard_effects

EXTRACT = "source logic has a reusable standalone boundary and can be packaged as a source-language skill"
INVALID = "generated script failed validation"
# Verbs that say nothing about a capability.
STOP_VERBS = ("get", "set", "run", "make", "build", "compute")


def tags(name: Column, path: Column) -> Column:
    """Name words but for stop verbs, then hints of the path; the first eight, then distinct."""
    low, where = F.lower(name), F.lower(F.coalesce(path, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*STOP_VERBS))
    hints = F.array_compact(
        F.array(
            F.when(F.contains(where, F.lit("graph")), "graph"),
            F.when(F.contains(where, F.lit("sequence")) | F.contains(low, F.lit("dna")), "bioinformatics"),
            F.when(F.contains(where, F.lit("table")), "table"),
        )
    )
    first = F.slice(F.concat(words, hints), 1, 8)
    return F.array_distinct(F.when(F.size(first) > 0, first).otherwise(F.array(F.lit("utility"))))


def source_name(path: Column, name: Column) -> Column:
    """module.path.name; the path loses its last suffix."""
    plain = F.replace(F.coalesce(path, F.lit("<memory>")), F.lit("\\"), F.lit("/"))
    return F.concat(F.replace(F.regexp_replace(plain, r"(?s)\.[^.]*\z", ""), F.lit("/"), F.lit(".")), F.lit("."), name)


def trivial() -> Column:
    """Over node columns and the parser's facts."""
    bare = F.coalesce(F.col("docstring"), F.lit("")) == ""
    n = F.size(lines("raw_code"))
    spoken = F.size(F.filter(lines("raw_code"), lambda x: ~blank(x)))
    python = (
        F.when(F.col("parse_error").isNotNull(), (n <= 3) & bare)
        .when(F.col("n_statements").isNull(), False)
        .otherwise(F.col("only_pass") | ((F.col("n_statements") <= 1) & (n <= 3) & bare))
    )
    return F.when(F.col("node_type") == "file", (n <= 2) & bare).when(F.col("language") != "python", (spoken <= 3) & bare).otherwise(python)


def skip_reason() -> Column:
    """First reason not to extract, else null; needs the columns of with_dependencies and facts."""
    python = (F.col("language") == "python") & (F.col("node_type") != "file")
    yes = lambda c: python & F.coalesce(F.col(c), F.lit(False))
    listed = lambda c: F.array_join(c, ", ")
    return (
        F.when(F.startswith("name", F.lit("_")), "private helper functions are not promoted to public skills")
        .when(yes("is_async"), "async functions require event-loop specific CLI design")
        .when(yes("has_varargs"), "varargs or kwargs require custom CLI design")
        .when(yes("bound"), "class-bound methods depend on instance or class state")
        .when(F.size("business_coupling") > 0, F.concat(F.lit("business coupling detected: "), listed("business_coupling")))
        .when(has_hard_effects(F.col("side_effects")), F.concat(F.lit("unsafe or hard-to-sandbox side effects detected: "), listed("side_effects")))
        .when(trivial(), "function is too trivial to justify a reusable skill")
    )


def decide(nodes: DataFrame) -> DataFrame:
    """Nodes with decision, reason, skill_id, source, tags, dep_names and the three scores.

    A name whose slug starts ``skill-`` can't be registered; it is skipped with a reason.
    """
    slug = slugify("name")
    reason = F.coalesce(skip_reason(), F.when(F.startswith(slug, F.lit("skill-")), "skill_id must not start with skill-"))
    out = nodes.withColumn("skip", reason)
    go = F.col("skip").isNull()
    none = F.array().cast("array<string>")
    score = lambda yes, no: F.when(go, yes).otherwise(no)
    return out.withColumns(
        {
            "decision": F.when(go, "extract").otherwise("skip"),
            "reason": F.coalesce("skip", F.lit(EXTRACT)),
            "skill_id": F.when(go, slug),
            "source": source_name(F.col("file_path"), F.col("name")),
            "tags": F.when(go, tags(F.col("name"), F.col("file_path"))).otherwise(none),
            "dep_names": F.when(go, dependency_names(F.col("pip_imports"))).otherwise(none),
            "reusable_boundary_score": score(0.85, 0.0),
            "domain_value_score": score(0.70, 0.0),
            "coupling_score": score(0.05, 1.0),
        }
    ).drop("skip")
