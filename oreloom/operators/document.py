"""Skill documents, front matter and model context, as templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_first, rstrip_of, strip, title_words


def _input_example(p: Column) -> Column:
    """Example of an argument by its type and words in its name."""
    has = lambda *words: F.greatest(*(F.contains(p["name"], F.lit(w)) for w in (*words, words[0])))
    json = F.when(has("edge"), '[["A","B"],["B","C"],["D","E"]]').when(has("row", "table"), '[{"value": 1}, {"value": 2}]').when(has("sequence", "dna"), '"ACGTACGT"').otherwise("{}")
    text = F.when(has("sequence", "dna"), "ACGTACGT").when(has("path", "file"), "input.json").when(has("column"), "value").otherwise("sample")
    kind = p["value_type"]
    return F.when(kind == "json", json).when(kind == "int", "10").when(kind == "float", "1.0").when(kind == "bool", "true").otherwise(text)


def _input_line(p: Column) -> Column:
    default = F.coalesce(F.nullif(p["default"], F.lit("")), F.when(p["value_type"] == "bool", "false").otherwise("none"))
    need = F.when(p["required"], "required").otherwise(F.concat(F.lit("optional, default: "), default))
    return F.concat(F.lit("- `"), p["flag"], F.lit("` ("), need, F.lit("): "), p["help"], F.lit(" Example: `"), _input_example(p), F.lit("`."))


def skill_document() -> Column:
    """Body of SKILL.md from a script's columns."""
    c, path = F.col, F.concat(F.lit("scripts/"), F.col("filename"))
    cli = F.size("cli_arguments") > 0
    helped = F.concat(
        F.lit("1. Run help:\n   ```bash\n   python "), path, F.lit(" --help\n   ```\n\n2. Run with example input:\n   ```bash\n   "), c("example_command"),
        F.lit("\n   ```\n\n3. Read stdout as result. Check stderr only on failure."),
    )
    plain = F.concat(
        F.lit("1. Inspect the packaged source file and confirm the runtime hint matches the target sandbox.\n\n2. Execute the script with the matching runtime or sandbox command:\n   ```bash\n   "),
        c("example_command"), F.lit("\n   ```\n\n3. Read stdout as result. Check stderr for runtime or compilation failures."),
    )
    listed = F.concat(
        F.array_join(F.transform("cli_arguments", _input_line), "\n"),
        F.lit("\n- `--output` (optional, default: json): Output format. Use `json` for machine-readable stdout or `text` for human-readable stdout."),
    )
    passed = F.concat(
        F.lit("- Pass task-specific inputs through the `"), c("runtime_hint"), F.lit("` runtime or sandbox targeting `"), F.coalesce("entry_symbol", F.lit("the file entrypoint")),
        F.lit("`.\n- Preserve the packaged source file path under `scripts/` so the runtime can compile or interpret it directly."),
    )
    json_note = F.when(
        F.exists("cli_arguments", lambda p: p["value_type"] == "json"), "- Quote JSON argument values correctly for the active shell before passing them to `--*-json` flags."
    )
    entry_note = F.when(
        c("entry_symbol").isNotNull() & ~cli, F.concat(F.lit("- The packaged source artifact preserves the original entry symbol `"), c("entry_symbol"), F.lit("` for sandbox invocation."))
    )
    notes = F.array_compact(F.array(json_note, entry_note))
    summary = F.regexp_replace(c("description"), r"\.+\z", "")
    body = F.concat(
        F.lit("# "), title_words(F.replace(c("skill_id"), F.lit("-"), F.lit(" "))), F.lit("\n\n## Quick start\n\n"), F.when(c("supports_help"), helped).otherwise(plain),
        F.lit("\n\n## Scripts\n\n- `"), path, F.lit("` - "), c("description"), F.lit("\n- Runtime hint: `"), c("runtime_hint"), F.lit("`\n"),
        F.when(c("entry_symbol").isNotNull(), F.concat(F.lit("- Entry symbol: `"), c("entry_symbol"), F.lit("`"))).otherwise(""),
        F.lit("\n- Example command: `"), c("example_command"), F.lit("`\n\n## Inputs\n\n"), F.when(cli, listed).otherwise(passed),
        F.lit(
            "\n\n## Output\n\nThe script writes normal results to stdout. Error details, runtime failures, or sandbox execution failures go to stderr.\n\n```text\n"
            "stdout: result payload or language-native program output\nstderr: runtime or argument errors\n```\n\n## When to use\n\nUse when: a task needs to "
        ),
        lower_first(summary), F.lit(".\n\nDo not use when: the task requires hidden project state, private infrastructure, or behavior outside the packaged source artifact.\n"),
        F.when(F.size(notes) > 0, F.concat(F.lit("\n## Notes\n\n"), F.array_join(notes, "\n"), F.lit("\n"))).otherwise(""), F.lit("\n"),
    )
    return strip(body)


def routing_description() -> Column:
    """What a router reads: use, and the first five tags."""
    triggers = F.when(F.size("tags") > 0, F.array_join(F.slice("tags", 1, 5), ", ")).otherwise(F.replace(F.col("skill_id"), F.lit("-"), F.lit(", ")))
    use = lower_first(F.regexp_replace("description", r"\.+\z", ""))
    return F.concat(F.lit("Use when a task needs to "), use, F.lit(". Triggers on: "), triggers, F.lit("."))


def yaml_text(x: Column) -> Column:
    """A YAML scalar on one line: plain where that is safe, else in single quotes."""
    unsafe = x.rlike(r"(?s)^[\s\-?:,\[\]{}#&*!|>'\"%@`]|:\s|:\z|\s#|^\s|\s\z|[\n\t]") | F.lower(x).isin("", "null", "true", "false", "yes", "no", "on", "off", "~") | x.rlike(r"^[0-9.+-]+\z")
    return F.when(unsafe, F.concat(F.lit("'"), F.replace(F.regexp_replace(x, r"\s*\n\s*", " "), F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(x)


def skill_file() -> Column:
    """Whole SKILL.md: front matter and body."""
    return F.concat(F.lit("---\nname: "), yaml_text(F.col("skill_id")), F.lit("\ndescription: "), yaml_text(routing_description()), F.lit("\n---\n\n"), strip("instructions"), F.lit("\n"))


def node_context(most: int = 4000) -> Column:
    """Context of a node for a model: what is known, then its code, cut at ``most`` characters."""
    c = F.col
    line = lambda label, value: F.concat(F.lit(label + ": "), value)
    some = lambda label, column, glue=", ": F.when(F.size(column) > 0, line(label, F.array_join(column, glue)))
    text = lambda label, column: F.when(F.coalesce(c(column), F.lit("")) != "", line(label, c(column)))
    span = lambda label, a, b: F.concat(F.lit(label + ": "), c(a), F.lit("-"), c(b))
    code = F.when(F.length("raw_code") > most, F.concat(F.substring("raw_code", 1, most), F.lit("\n# ... truncated by the length limit"))).otherwise(c("raw_code"))
    parts = F.array(
        line("Node", c("name")), line("Language", c("language")), line("Type", c("node_type")), line("Signature", c("signature")), span("Lines", "start_line", "end_line"),
        span("Bytes", "start_byte", "end_byte"), text("File", "file_path"), some("Scope", "scope_path", " > "), text("Docstring", "docstring"), some("Annotations", "annotations"),
        some("Dependencies", "dependencies"), F.concat(F.lit("```"), c("language"), F.lit("\n"), code, F.lit("\n```")),
    )
    return F.array_join(F.array_compact(parts), "\n")


def slice_contexts(nodes: DataFrame, most: int = 4000) -> DataFrame:
    """(slice_id, context) of slices: title, summary, source_files, warnings, references and nodes in order."""
    head = F.array(
        F.concat(F.lit("# Capability Slice: "), F.col("title")), F.concat(F.lit("Slice ID: "), F.col("slice_id")), F.when(F.col("summary") != "", F.concat(F.lit("Summary: "), F.col("summary"))),
        F.when(F.size("source_files") > 0, F.concat(F.lit("Source files: "), F.array_join("source_files", ", "))), F.when(F.size("warnings") > 0, "Warnings:"),
    )
    dashed = lambda column: F.transform(column, lambda x: F.concat(F.lit("- "), x))
    names = F.array_sort(F.map_keys("references"))
    parts = F.concat(head, dashed("warnings"), F.array(F.when(F.size("references") > 0, "References:")), dashed(names), F.array(F.lit("Extracted nodes:")))
    rows = nodes.select("slice_id", "ordinal", F.array_compact(parts).alias("head"), node_context(most).alias("context"))
    out = rows.groupBy("slice_id").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("ordinal", "context"))).alias("nodes"))
    return out.select("slice_id", F.array_join(F.concat("head", F.col("nodes.context")), "\n\n").alias("context"))
