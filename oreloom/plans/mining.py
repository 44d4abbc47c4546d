"""The mining plan: source tree to packaged, validated skills, rejects and skips as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import node_error, script_error, split_valid
from ..operators.decide import INVALID, decide
from ..operators.dependencies import with_dependencies
from ..operators.document import skill_document, skill_file
from ..operators.extract import mine
from ..operators.prompts import python_script
from ..operators.registry import entries
from ..operators.script import native_scripts, python_scripts
from ..operators.structured import Transport, ask_scripts, decide_with_model, manuals_with_model, validate_either
from ..operators.validate import document_error, validate_scripts
from ..sources.scan import decode, scan_tree, with_runtime
from .storage import ROUNDS, materialise

SCRIPT = (
    "node_id", "ordinal", "file_path", "language", "node_type", "name", "start_byte", "start_line", "end_line", "decision", "reason", "skill_id", "source", "tags", "dep_names",
    "filename", "runtime_hint", "description", "script_text", "entry_symbol", "cli_arguments", "kept_imports", "example_command", "supports_help",
)


@dataclass
class Mined:
    """Tables of one run.  Nodes, decisions and scripts are written once: the later branches read them."""

    nodes: DataFrame
    decisions: DataFrame
    packages: DataFrame
    skipped: DataFrame
    rejects: DataFrame
    seen: dict[str, Observation]

    @property
    def counts(self) -> dict[str, dict[str, int]]:
        """Counts that were taken while the tables were written."""
        return {name: dict(found.get) for name, found in self.seen.items()}

    @property
    def registry(self) -> DataFrame:
        return entries(self.packages)


def mine_files(files: DataFrame, transport: Transport | None = None, partial: bool = False, **call) -> Mined:
    """All stages over (path, text, error) rows; lazy after the checked scripts.

    With a ``transport`` a model judges what the rules let pass, writes Python scripts and
    manuals.  A script of the model's goes through the same rules as the template's, which is
    taken where the model's breaks one; so does a manual.  Rows whose answer doesn't hold go on
    as without a model.  With ``partial`` sound functions of Python files that don't parse are
    mined, beside the reject.
    """
    seen = {name: Observation(name) for name in ("nodes", "decisions", "scripts")}
    rows = F.count(F.lit(1)).alias("rows")
    good = files.where("error is null").select("path", "text")
    parsed = materialise(mine(with_runtime(good), partial).observe(seen["nodes"], rows, F.count("error").alias("faults")), "nodes")
    nodes, broken = split_valid(parsed.where("error is null").drop("error"), node_error(), "node", "node_id")
    bad = files.where("error is not null").select(F.lit("decode").alias("stage"), F.col("path").alias("key"), "error")
    rejects = bad.unionByName(parsed.where("error is not null").select(F.lit("parse").alias("stage"), F.col("file_path").alias("key"), "error"))
    decided = decide(with_dependencies(nodes, files.select("path")))
    decided = decided.observe(seen["decisions"], rows, F.count(F.when(F.col("decision") == "extract", 1)).alias("extracted"))
    decisions = materialise(decide_with_model(decided, transport, **call) if transport else decided, "decisions", ROUNDS)
    chosen = decisions.where("decision = 'extract'")
    # a Python script needs a function; a suffix-less one found by its shebang goes whole
    distilled = (F.col("language") == "python") & F.col("core_source").isNotNull()
    chosen = chosen.withColumn("runtime_hint", F.lit(None).cast("string"))
    prompt = F.when(F.col("language") == "python", python_script(F.to_json(F.struct("decision", "reason", "tags")))) if transport else F.lit(None)
    chosen, columns = chosen.withColumn("prompt", prompt), (*SCRIPT, "prompt")
    scripts = python_scripts(chosen.where(distilled)).select(*columns).unionByName(native_scripts(chosen.where(~F.coalesce(distilled, F.lit(False))), good).select(*columns))
    if transport:
        scripts = ask_scripts(scripts, F.col("prompt"), transport, **call)
    # written, so that rules don't make the script's text anew wherever they look at it
    template = materialise(scripts.drop("prompt"), "scripts", ROUNDS)
    scripts, unfit = split_valid(template.drop("_content"), script_error(), "script", "node_id")
    checked = validate_either(template) if transport else validate_scripts(scripts.withColumn("writer", F.lit("template")))
    checked = materialise(checked.observe(seen["scripts"], rows, F.count(F.when(F.col("passed"), 1)).alias("passed")), "checked", ROUNDS)
    passed = checked.where("passed").withColumn("instructions", skill_document())
    if transport:
        passed = materialise(manuals_with_model(passed, transport, **call), "manuals", ROUNDS)
    else:
        passed = passed.withColumn("doc_error", document_error("instructions"))
    packages = passed.where("doc_error is null").withColumn("skill_md", skill_file())
    undocumented = passed.where("doc_error is not null").select(F.lit("document").alias("stage"), F.col("node_id").alias("key"), F.col("doc_error").alias("error"))
    skipped = decisions.where("decision = 'skip'").select("node_id", "source", "reason").unionByName(checked.where("not passed").select("node_id", "source", F.lit(INVALID).alias("reason")))
    return Mined(nodes, decisions, packages, skipped, rejects.unionByName(broken).unionByName(unfit).unionByName(undocumented), seen)


def mine_tree(spark: SparkSession, root: str) -> Mined:
    return mine_files(decode(scan_tree(spark, root)))
