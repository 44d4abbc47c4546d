"""Prompts of the optional model steps; every one has a deterministic path beside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .document import node_context


def _prompt(task: str, rules: tuple[str, ...], *parts: Column) -> Column:
    head = "\n".join([task, "", *(f"- {r}" for r in rules)])
    return F.concat_ws("\n\n", F.lit(head), *parts)


def candidate(dependencies: Column) -> Column:
    """Asks whether a node should be extracted; ``dependencies`` is JSON of its context."""
    rules = (
        "Extract code with clear inputs and outputs that stands alone and is useful in other projects.",
        "Skip code that needs sessions, requests, settings or instance state, that is trivial, or that can't run safely.",
        "skill_id is lower-kebab-case and doesn't start with skill- or skill_.",
    )
    return _prompt("Decide whether this capability becomes a reusable skill.", rules, F.concat(F.lit("Dependency context:\n"), dependencies), F.concat(F.lit("Capability context:\n"), node_context(3000)))


def python_script(decision: Column) -> Column:
    """Asks for a stand-alone script around a node's logic."""
    rules = ("Define core_function with type hints and main with argparse.", "Print results to stdout and errors to stderr.", "Use no network, subprocess, deletion or absolute path.")
    return _prompt("Write one Python script for this capability.", rules, F.concat(F.lit("Decision:\n"), decision), F.concat(F.lit("Capability context:\n"), node_context(5000)))


def manual(script: Column) -> Column:
    """Asks for the SKILL.md body of a script."""
    rules = ("Use the sections Quick start, Scripts, Inputs, Output and When to use.", "Number the quick start 1., 2., 3.", "Document every flag and --output.", "Use ASCII.")
    return _prompt("Write the SKILL.md body of this script.", rules, F.concat(F.lit("Script:\n"), script))


def review(draft: Column) -> Column:
    """Asks to revise an instruction draft."""
    return _prompt("Revise these instructions.", ("Keep every script and reference path.", "Avoid the first person.", "Number steps without gaps."), F.concat(F.lit("Draft:\n"), draft))


#: What a repair starts with; and its parts, with how many characters of each it holds.
MEND = "The response didn't match the schema. Return one corrected JSON object."
PARTS = {"Error": 2000, "Schema": 3000, "Response": 4000}


def repair(payload: Column, error: Column, schema: Column) -> Column:
    """Asks to mend a response that failed its schema; excerpts are bounded."""
    return F.concat_ws("\n\n", F.lit(MEND), *(F.concat(F.lit(f"{name}:\n"), F.substring(x, 1, most)) for (name, most), x in zip(PARTS.items(), (error, schema, payload), strict=True)))


def repair_text(payload: str, error: str, schema: str) -> str:
    """``repair`` of texts, for a task that has just seen the fault."""
    return "\n\n".join([MEND, *(f"{name}:\n{x[:most]}" for (name, most), x in zip(PARTS.items(), (error, schema, payload), strict=True))])
