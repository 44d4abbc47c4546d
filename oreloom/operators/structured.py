"""Structured model answers: call, check against a schema, repair once, else fall back.

The transport is injected; rows whose answer doesn't hold keep their deterministic value.  Rows
stay in their task while a model is asked: answers are never joined to what they answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, once
from ..functions.text import col
from ..plans.storage import materialise
from . import prompts
from .agent import request, with_answers
from .contracts import FILENAME, script_error
from .validate import first_document, first_verdict, matches_script_error, predicted_help_failure, validate_other_scripts, validated

Transport = Callable[[str], str]
#: Field -> JSON type of the answers asked for; a type that ends in ? may be missing or null.
DECISION = {
    "decision": "string", "reason": "string", "skill_id": "string?", "source": "string?", "tags": "array?", "dependencies": "array?",
    "reusable_boundary_score": "number?", "domain_value_score": "number?", "coupling_score": "number?",
}
SCRIPT = {"script_text": "string", "description": "string?", "filename": "string?", "cli_arguments": "array?", "example_command": "string?", "supports_help": "boolean?"}
MANUAL = {"instructions": "string"}
ARGUMENTS = "array<struct<name:string,flag:string,value_type:string,required:boolean,default:string,help:string>>"
VALUE_TYPES = ("str", "int", "float", "bool", "json")
_IS = {"string": "^STRING", "array": "^ARRAY", "number": "^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN", "object": "^OBJECT"}


def schema_json(fields: dict[str, str]) -> str:
    """The JSON schema that a request carries."""
    kinds = {name: {"type": kind.rstrip("?")} for name, kind in fields.items()}
    return json.dumps({"type": "object", "properties": kinds, "required": [n for n, k in fields.items() if not k.endswith("?")], "additionalProperties": False})


def schema_error(content: Column | str, fields: dict[str, str]) -> Column:
    """First field of a JSON object that is missing or of another type, else null."""
    return let(F.from_json(col(content), "map<string,variant>"), lambda raw: _schema_error(raw, fields))


def _schema_error(raw: Column, fields: dict[str, str]) -> Column:
    found = []
    for name, kind in fields.items():
        value = F.try_element_at(raw, F.lit(name))
        absent = value.isNull() | F.is_variant_null(value)
        wrong = F.when(~absent & ~F.schema_of_variant(value).rlike(_IS[kind.rstrip("?")]), f"{name}: must be a JSON {kind.rstrip('?')}")
        found.append(wrong if kind.endswith("?") else F.when(absent, f"{name}: field required").otherwise(wrong))
    return F.coalesce(*found)


def _distinct(pairs: list[tuple]) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key stands twice")
    return found


def _refused(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def _at(value: object, *path: str | int) -> object:
    """Value below a JSON value, None where there is none."""
    for step in path:
        if not isinstance(value, dict if isinstance(step, str) else list):
            return None
        value = value.get(step) if isinstance(step, str) else value[step] if step < len(value) else None
    return value


def _text(value: object) -> str | None:
    """A JSON value as a string column has it."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


_TYPES = {"string": str, "array": list, "number": (int, float), "boolean": bool, "object": dict}


def answer_fault(response: str, fields: dict[str, str], rule: Callable[[dict], str | None] | None = None) -> tuple[str | None, str | None]:
    """(content, first fault) of a chat response: what ``response_error`` and ``schema_error`` find, then ``rule``.

    Both texts are parsed once, where expressions would for every field and rule.
    """
    try:
        body = json.loads(response)
    except (ValueError, RecursionError):
        body = None
    content = _text(_at(body, "choices", 0, "message", "content"))
    if _at(body, "choices", 0) is None:
        return content, "chat completion response missing choices"
    if _at(body, "choices", 0, "message") is None:
        return content, "chat completion choice missing message"
    if not (content or "").strip():
        return content, "chat completion message missing JSON content"
    content = content.encode("utf-8", "replace").decode("utf-8")  # half of a surrogate pair can't leave Python
    try:
        said = json.loads(content, object_pairs_hook=_distinct, parse_constant=_refused)
    except (ValueError, RecursionError):
        return content, "chat completion content was not strict JSON"
    if not isinstance(said, dict):
        return content, "chat completion JSON content must be an object"
    if extra := said.keys() - fields.keys():
        return content, "provider returned unexpected fields: " + ", ".join(sorted(extra))
    for name, kind in fields.items():
        value, plain = said.get(name), kind.rstrip("?")
        if value is None and not kind.endswith("?"):
            return content, f"{name}: field required"
        if value is not None and (not isinstance(value, _TYPES[plain]) or isinstance(value, bool) and plain == "number"):
            return content, f"{name}: must be a JSON {plain}"
    return content, rule(said) if rule else None


def ask(rows: DataFrame, prompt: Column, transport: Transport, name: str, fields: dict[str, str], repairs: int = 1, rule: Callable[[dict], str | None] | None = None, **call) -> DataFrame:
    """Rows with ``_content`` and ``_fault`` of a model's answers to their prompts, both null where there is none.

    An answer that breaks its schema, or for which ``rule`` of its content gives an error, is
    sent back with its fault, ``repairs`` times; a call that failed for good is not.  To be
    written before it is read twice: every reading asks anew.
    """
    schema = schema_json(fields)

    def answer(prompt: str, send: Callable) -> tuple[str | None, str | None]:
        for _ in range(repairs + 1):
            response, error = send(request(prompt, name, schema))
            if error is not None:
                return None, error
            content, fault = answer_fault(response or "", fields, rule)
            if fault is None:
                break
            prompt = prompts.repair_text(content or "", fault, schema)
        return content, fault

    out = with_answers(rows, prompt, answer, transport, **call)
    return out.withColumns({"_content": F.col("_said.content"), "_fault": F.col("_said.fault")}).drop("_said")


def answers(asked: DataFrame, transport: Transport, name: str, fields: dict[str, str], repairs: int = 1, rule: Callable[[dict], str | None] | None = None, **call) -> DataFrame:
    """(id, content, fault) of (id, prompt) rows, by ``ask``."""
    said = ask(asked.select("id", "prompt"), F.col("prompt"), transport, name, fields, repairs, rule, **call)
    return materialise(said.select("id", F.col("_content").alias("content"), F.col("_fault").alias("fault")), "answers")


def decide_with_model(decisions: DataFrame, transport: Transport, **call) -> DataFrame:
    """Decisions in which a model judged what the rules let pass; where its answer fails the rules' decision stays."""
    context = F.to_json(F.struct("stdlib_imports", "pip_imports", "internal_imports", "business_coupling", "side_effects"))
    said = ask(decisions, F.when(F.col("decision") == "extract", prompts.candidate(context)), transport, "CandidateDecision", DECISION, **call)
    value = F.when(F.col("_fault").isNull(), F.try_parse_json("_content"))
    got = lambda name, kind="string": F.try_variant_get("_value", f"$.{name}", kind)
    kinds = {n: {"array": "array<string>", "number": "double"}.get(k.rstrip("?"), "string") for n, k in DECISION.items()}
    out = said.withColumn("_value", once(value)).withColumn("_m", once(F.when(F.col("_value").isNotNull(), F.struct(*(got(n, k).alias(n) for n, k in kinds.items())))))
    m = lambda name: F.col(f"_m.{name}")
    sound = ((m("decision") == "extract") & m("skill_id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & ~F.startswith(m("skill_id"), F.lit("skill-"))) | ((m("decision") == "skip") & m("skill_id").isNull())
    out = out.withColumn("_own", once(F.coalesce(sound, F.lit(False))))
    names = {"dep_names": "dependencies"} | {n: n for n in DECISION if n != "dependencies"}
    put = {n: F.when(F.col("_own"), F.coalesce(m(k), F.col(n))).otherwise(F.col(n)) for n, k in names.items()} | {"skill_id": F.when(F.col("_own"), m("skill_id")).otherwise(F.col("skill_id"))}
    return out.select(*(put[c].alias(c) if c in put else F.col(c) for c in decisions.columns))


def _arguments(content: Column) -> Column:
    return F.from_json(F.get_json_object(content, "$.cli_arguments"), ARGUMENTS)


_FLAG, _NAME = re.compile(r"--[A-Za-z0-9][A-Za-z0-9_-]*"), re.compile(FILENAME.removesuffix(r"\z"))


def script_answer_fault(said: dict) -> str | None:
    """First thing in a script answer that can't be packaged: a flag, a value type, a file name; else None."""
    arguments = [{k: _text(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in said.get("cli_arguments") or ()]
    name = said.get("filename")
    if not all(_FLAG.fullmatch(p.get("flag") or "") for p in arguments):
        return "cli_arguments: flags must start with --"
    if not all(p.get("name") and p.get("help") for p in arguments):
        return "cli_arguments: name and help must be non-empty"
    if not all(p.get("value_type") in VALUE_TYPES for p in arguments):
        return f"cli_arguments: value_type must be one of {', '.join(VALUE_TYPES)}"
    if name is not None and not (_NAME.fullmatch(name) and name.endswith(".py")):
        return "filename must be a safe single-file Python script"
    return None


def ask_scripts(scripts: DataFrame, prompt: Column, transport: Transport, **call) -> DataFrame:
    """Scripts with ``_content``, a model's sound answer to their prompt, else null."""
    said = ask(scripts, prompt, transport, "GeneratedScript", SCRIPT, rule=script_answer_fault, **call)
    return said.withColumn("_content", F.when(F.col("_fault").isNull(), F.col("_content"))).drop("_fault")


def _own_script() -> dict[str, Column]:
    """A script's columns by a model's answer (``_content``).

    Flags, file name and example command are the model's own: those of the template don't fit a
    text that it didn't write.  The skill_id stays the decision's.
    """
    got = lambda name: F.get_json_object("_content", f"$.{name}")
    filename = F.coalesce(got("filename"), "filename")
    return {
        "script_text": got("script_text"), "description": F.coalesce(got("description"), "description"), "filename": filename, "entry_symbol": F.lit("core_function"), "runtime_hint": F.lit("python"),
        "cli_arguments": F.coalesce(_arguments(F.col("_content")), F.array().cast(ARGUMENTS)), "kept_imports": F.array().cast("array<string>"), "supports_help": F.coalesce(got("supports_help") == "true", F.lit(True)),
        "example_command": F.coalesce(got("example_command"), F.concat(F.lit("python scripts/"), filename, F.lit(" --output json"))),
    }


def validate_either(scripts: DataFrame) -> DataFrame:
    """``validate_scripts`` of each row's script by a model (``_content``) if that passes, else of the row's own.

    Adds ``writer``, model or template.  A row whose own script breaks a field's rule, and whose
    model's doesn't pass, is left out.
    """
    other = scripts.where("language <> 'python'").where(script_error().isNull()).drop("_content")
    rows = scripts.where("language = 'python'")
    put = _own_script()
    taken = lambda rows, at: rows.withColumns({n: F.col(f"{at}.{n}") for n in put})
    # struct by struct, so that neither is made anew for each of its fields
    rows = rows.withColumns({"_mine": F.struct(*put), "_fits": script_error().isNull()})
    own = taken(rows.withColumn("_own", once(F.when(F.col("_content").isNotNull(), F.struct(*(c.alias(n) for n, c in put.items()))))), "_own")
    fit = F.col("_own").isNotNull() & script_error().isNull() & ~(F.col("supports_help") & predicted_help_failure())
    own = own.withColumn("_fit", once(F.coalesce(fit, F.lit(False)))).where("_fit or _fits")
    told = first_verdict(own, F.when(F.col("_fit"), F.col("script_text")), F.col("entry_symbol"), F.when(F.col("_fits"), F.col("_mine.script_text")), F.col("_mine.entry_symbol"))
    told = taken(told.withColumn("_best", once(F.when(F.col("first"), F.col("_own")).otherwise(F.col("_mine")))).where("first or _fits"), "_best")
    told = validated(told).withColumn("writer", F.when(F.col("first"), "model").otherwise("template")).drop("_content", "_mine", "_fits", "_own", "_fit", "_best", "first")
    return told.unionByName(validate_other_scripts(other).withColumn("writer", F.lit("template")))


def manuals_with_model(passed: DataFrame, transport: Transport, **call) -> DataFrame:
    """Scripts whose ``instructions`` are a model's where those hold and fit the script, else as they came; and the first error of those as ``doc_error``."""
    prompt = prompts.manual(F.to_json(F.struct("skill_id", "filename", "description", "example_command", "cli_arguments", "script_text")))
    said = ask(passed, prompt, transport, "SkillDocument", MANUAL, **call)
    said = said.withColumnRenamed("instructions", "_mine").withColumn("instructions", once(F.when(F.col("_fault").isNull(), F.get_json_object("_content", "$.instructions"))))
    told = said.withColumn("_told", first_document(F.when(matches_script_error().isNull(), F.col("instructions")), F.col("_mine")))
    told = told.withColumn("instructions", F.when(F.col("_told.first"), F.col("instructions")).otherwise(F.col("_mine")))
    return told.withColumn("doc_error", F.col("_told.fault")).select(*passed.columns, "doc_error")
