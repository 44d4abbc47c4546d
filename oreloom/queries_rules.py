"""Queries, with DuckDB twins, for readers, parsers' details and rules that need made-up inputs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import agent, data, dependencies, extract, legacy, script, structured, validate
from .queries import _DEF, _FILES, _PATH, _PRIVATE, _ASYNC, _STATIC, CODE, _code, _lines, _mixed, _table, query
from .operators.decide import decide
from .plans.mining import mine_files
from .plans.skill_folders import SKILL_BYTES, SkillFolders, remove_tree
from .plans.storage import materialise, ranges, scratch, spread, sweep
from .sources import scan
from .sources.tree import read_tree


def _by(number: str, *values: str) -> str:
    """SQL of one of the values, by the remainder of a number."""
    return f"case {number} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _text(*rows: str) -> str:
    """SQL of rows of plain text."""
    return _lines(*("'" + row.replace("'", "''") + "'" for row in rows))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in tasks of bounded size: what is made of a row costs far more than moving it."""
    return spread(_table(spark, sf_dir, "events"))


# --- readers ----------------------------------------------------------------------------

_FILE = "regexp_extract(path, '[^/]+$', 0)"
_STEM = "regexp_replace({}, '[.][^.]*$', '')".format(_FILE)


@query(f"""
select event_id, {_by("event_id", *(f"'{x}'" for x in ("javascript", "shell", "python", "javascript", "lua", "generic", "csharp", "java")))} as language,
  {_by("event_id", *(f"'{x}'" for x in ("JavaScript", "Shell", "Python", "JavaScript", "Lua", "Generic Source", "C#", "Java")))} as display,
  {_by("event_id", *(f"'{x}'" for x in ("node", "bash", "python", "node", "lua", "sandbox", "dotnet-script", "java")))} as runtime_hint,
  {_by("event_id", *(f"'{x}'" for x in (".js", ".sh", ".py", ".js", ".lua", ".txt", ".cs", ".java")))} as extension,
  {_by("event_id", *(f"'{a}scripts/' || {_FILE} || {b}" for a, b in (("node ", "''"), ("bash ", "''"), ("python ", "' --help'"), ("node ", "''"), ("lua ", "''"), ("sandbox-run --language generic --script ", "' --entry main'"), ("dotnet script ", "''"), ("javac ", f"' && java -cp scripts ' || {_STEM}"))))} as command
from {CODE}""")
def runtime_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime by suffix or first line, its example command, and a language's first suffix."""
    files = scan.with_runtime(_code(spark, sf_dir))
    file = F.concat(F.lit("scripts/"), F.regexp_extract("path", "[^/]+$", 0))
    return files.select("event_id", "language", "display", "runtime_hint", script.default_extension(F.col("language")).alias("extension"), script.example_command("command", file, F.lit(None).cast("string")).alias("command"))


_FULL = _by("doc_id", "'/data/in/' || source || '/a' || doc_id || '.py'", "'/other/' || source || '/b' || doc_id || '.R'", "'/data/in/../c' || doc_id", "'/data/in/deep/er/d.' || lang")


@query(f"""select doc_id, {_by("doc_id", "source || '/a' || doc_id || '.py'", "'b' || doc_id || '.R'", "null", "'deep/er/d.' || lang")} as path,
  {_by("doc_id", "array_length(string_split(source, '/')) + 1 <= 2", "true", "null::boolean", "false")} as flat from documents""")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a root; null where one would climb out; and whether a bundle may hold them."""
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_FULL} as full").select("doc_id", scan.safe_relative_path(F.col("full"), "/data/in").alias("path"))
    return rows.withColumn("flat", validate.flat_bundle("path"))


@query(f"""select doc_id, {_by("doc_id", "text", "null", "' '", "'#!/bin/sh' || chr(10) || text", "text")} as text, {_by("doc_id", "null", "'not UTF-8'", "'empty source'", "null", "null")} as error,
  doc_id % 5 = 3 as sniffed, {_by("doc_id", *["case when length(text) > 60 then substr(text, 1, 60) || chr(10) || '...[truncated after 60 characters]' else text end"] * 5)} as shown from documents""")
def strict_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict decoding with a row for every fault, first-line sniffing, and texts cut for display."""
    content = _by("doc_id", "encode(text, 'UTF-8')", "concat(encode(text, 'UTF-8'), X'c328')", "X'20'", "encode('#!/bin/sh' || chr(10) || text, 'UTF-8')", "encode(text, 'UTF-8')")
    files = _table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(doc_id as string) as path", f"{content} as content", "encode(text, 'UTF-8') as plain")
    shown = files.select("path", "doc_id", scan.shebang_sniff(F.col("content")).alias("sniffed"), scan.read_workspace_text(F.col("plain"), 60).alias("shown"))
    return scan.decode(files).join(shown, "path").select("doc_id", "text", "error", "sniffed", "shown")


# --- parsers ----------------------------------------------------------------------------


def _function(k: int, name: str, signature: str, start: str, end: str, doc: str = "null", annotations: str = "''", imports: str = "''") -> str:
    return f"select path as file_path, {name} as name, {signature} as signature, {doc} as docstring, {annotations} as annotations, {imports} as imports, ({start})::bigint as start_byte, ({end})::bigint as end_byte from f where k = {k}"


# files whose lines end in three ways, with form feeds and separators that end none
_ODD_BREAK = _by("event_id", "chr(10)", "chr(13) || chr(10)", "chr(13)") + " as nl"
_ODD_FEED = "case when event_id % 2 = 0 then chr(12) else '' end as ff"
_ODD_PATH = "'odd/e' || event_id || '.py' as path"
_ODD_TEXT = "'x = 1' || nl || ff || 'def odd(a):' || nl || '    \"\"\"Two" + " " + "lines.\"\"\"' || nl || '    return a' || nl as text"
_ODD_LINES = f"select {_ODD_PATH}, nl, ff from (select event_id, {_ODD_BREAK}, {_ODD_FEED} from events)"


@query(f"with {_FILES} " + " union all ".join((
    _function(0, "n", "'def ' || n || '(rows: list, limit: int = 3) -> list'", _DEF, "length(text) - 1", "'Keep the first ' || t || ' rows.'", imports="'import math;import numpy as np'"),
    _function(1, "n", "'def ' || n || '(self, value = 1)'", f"{_STATIC} - 4", f"{_ASYNC} - 2", annotations="'@staticmethod'"),
    _function(1, "'fetch'", "'async def fetch(url)'", _ASYNC, "length(text) - 1"),
    _function(2, "'wipe_' || t", "'def wipe_' || t || '(path)'", _DEF, "length(text) - 1", imports="'import os'"),
    _function(3, "n", "'def ' || n || '(*args, **kwargs)'", "0", f"{_PRIVATE} - 1"),
    _function(3, "'_private'", "'def _private(x)'", _PRIVATE, "length(text) - 1"),
    f"select path, 'odd', 'def odd(a)', 'Two\u2028lines.', '', '', 5 + length(nl) + length(ff), 5 + length(nl) + length(ff) + 11 + length(nl) + 22 + length(nl) + 12 from ({_ODD_LINES})",
)))
def python_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, decorators, imports and byte spans of Python functions."""
    odd = _events(spark, sf_dir).selectExpr("event_id", _ODD_BREAK, _ODD_FEED).selectExpr(_ODD_PATH, _ODD_TEXT)
    nodes = extract.python_nodes(_mixed(spark, sf_dir).where("path like '%.py'").select("path", "text").unionByName(odd)).where("error is null")
    joined = lambda c, by: F.array_join(c, by).alias(c)
    return nodes.select("file_path", "name", "signature", "docstring", joined("annotations", ","), joined("imports", ";"), "start_byte", "end_byte")


_BROKEN = _by("event_id", *(_text(*rows).replace("{}", "' || event_type || '") for rows in (
    ("import math", "", "@wraps", "def first_{}(a):", "    return a", "def broken(:", "    pass", "def last(b):", "    return b", ""),
    ("class Box:", "    size = (1,", "    def good_{}(self):", "        return 1", "    def bad(self:", "        return 2", "def outer(x):", "    return x", ""),
    ("def only_{}(a):", "    return '(' + a", "value = (1,", ""), ("def fine_{}(a):", "    return a", ""), ("x = (", "y = )", ""),
)))


@query("with e as (select 'p/e' || event_id || '.py' as file_path, event_id % 5 as k, event_type as t from events) " + " union all ".join(
    f"select file_path, {name} as name, '{scope}' as scope, {code} as raw_code, '{imports}' as imports, '{parser}' as parser, null as error from e where k = {k}" for k, name, scope, code, imports, parser in (
        (0, "'first_' || t", "", _text("@wraps", "def first_{}(a):", "    return a").replace("{}", "' || t || '"), "import math", "python-partial"), (0, "'last'", "", _text("def last(b):", "    return b"), "import math", "python-partial"),
        (1, "'good_' || t", "Box", _text("def good_{}(self):", "        return 1").replace("{}", "' || t || '"), "", "python-partial"), (1, "'outer'", "", _text("def outer(x):", "    return x"), "", "python-partial"),
        (2, "'only_' || t", "", _text("def only_{}(a):", "    return '(' + a").replace("{}", "' || t || '"), "", "python-partial"), (3, "'fine_' || t", "", _text("def fine_{}(a):", "    return a").replace("{}", "' || t || '"), "", "python-ast-fallback"),
    )) + " union all select file_path, null, '', null, '', null, 'SyntaxError' from e where k <> 3")
def partial_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of files of which some don't parse: what stands sound in those, and their errors."""
    files = _events(spark, sf_dir).selectExpr("'p/e' || event_id || '.py' as path", f"{_BROKEN} as text")
    nodes = extract.python_nodes(files, partial=True)
    joined = lambda c, by: F.coalesce(F.array_join(c, by), F.lit(""))
    return nodes.select("file_path", "name", joined("scope_path", ".").alias("scope"), "raw_code", joined("imports", ";").alias("imports"), F.col("metadata")["parser"].alias("parser"), F.regexp_extract("error", "^[A-Za-z]+", 0).alias("error"))


_USER = _text("import os", "import numpy as np", "from helper{} import run", "from . import sibling", "from .json import z", "import os", "def use(x):", "    return run(x)", "").replace("{}", "' || event_id % 3 || '")
_HELPERS = (("helper0.py", "x = 0"), ("helper1.js", "let x = 1;"), ("helper2/__init__.py", "x = 2"))


@query(f"""select 'app' || event_id || '.py' as file_path, 'import os;from .json import z' as stdlib, 'import numpy as np' as pip, 'from helper' || event_id % 3 || ' import run' as internal, 'numpy' as names,
  {_by("event_id", *(f"'{path}'" for path, _ in _HELPERS))} as block_path, {_by("event_id", *(f"'{x}'" for _, x in _HELPERS))} as block from events""")
def dependency_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import classes of Python nodes, among them files of the same tree, whose heads are attached."""
    events = _events(spark, sf_dir).selectExpr("'app' || event_id || '.py' as path", f"{_USER} as text")
    files = events.unionByName(spark.createDataFrame(list(_HELPERS), "path string, text string"))
    nodes = materialise(extract.python_nodes(events), "nodes")
    known, blocks = dependencies.with_dependencies(nodes, files.select("path")), dependencies.internal_blocks(nodes, files)
    joined = lambda c: F.array_join(f"{c}_imports", ";").alias(c)
    rows = known.select("node_id", "file_path", joined("stdlib"), joined("pip"), joined("internal"), F.array_join(dependencies.dependency_names(F.col("pip_imports")), ",").alias("names"))
    return rows.join(blocks.select("node_id", F.col("path").alias("block_path"), "block"), "node_id", "left").drop("node_id")


# --- rules ------------------------------------------------------------------------------

_CORE = ("def core_function(x: int) -> int:", "    return x")
_SCRIPTS = (
    _text(*_CORE, "def main():", "    print(core_function(1))"), _text(*_CORE), _text("def core_function(x, *, y: int = 1):", "    return x", "def main(): pass"), _text("import subprocess, json", "import shutil as s", *_CORE, "def main():", "    eval('1')"),
    _text("def core_function(:", "    pass"), _text(*_CORE, "def main():", "    print('/etc/hosts', 'C:/x')"),
)


@query(f"""select event_id, {_by("event_id", "''", "'missing main'", "'core_function argument missing type hint: x;core_function missing return type hint'", "''", "'syntax error: invalid syntax at line 1'", "''")} as errors,
  {_by("event_id", "''", "''", "''", "'banned import: shutil;banned import: subprocess;eval: dynamic eval is not allowed'", "''", f"'{validate.PATH_FOUND}'")} as findings, {_by("event_id", "0", "null", "null", "null", "null", "null")} as help_exit_code, event_id % 6 = 0 as passed from events""")
def python_script_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, findings and the help check of Python scripts."""
    none = "cast(array() as array<struct<name:string,flag:string,value_type:string,required:boolean,default:string,help:string>>) as cli_arguments", "cast(array() as array<string>) as kept_imports"
    rows = _events(spark, sf_dir).selectExpr("event_id", "'python' as language", f"{_by('event_id', *_SCRIPTS)} as script_text", "'core_function' as entry_symbol", "true as supports_help", *none)
    return validate.validate_scripts(rows).select("event_id", F.array_join("static_errors", ";").alias("errors"), F.array_join("security_findings", ";").alias("findings"), "help_exit_code", "passed")


_MANUAL = ("# Tool", "", "## Quick start", "", "1. Run scripts/run.py --help", "2. Read the result", "", "## Scripts", "- scripts/run.py", "", "## Inputs", "- none", "", "## Output", "- text", "", "## When to use", "- often")
_PAYLOADS = (  # name, description, instructions, scripts; errors
    ("'tool-' || event_id", "'Use when needed.'", _text(*_MANUAL), "run.py", "''"),
    ("'Bad_Name'", "'Use when needed.'", _text(*_MANUAL, "See references/gone.md."), "run.py", "'name: must match ^[a-z0-9-]+$|instructions: referenced file does not exist: references/gone.md'"),
    ("'tool'", "'Use <b>when</b> needed.'", _text(*_MANUAL), "other.py", "'description: must not contain XML tags|instructions: must mention packaged script scripts/other.py|instructions: referenced file does not exist: scripts/run.py'"),
    ("''", "'Für dich.'", _text(*_MANUAL), "run.py", "'name: must be non-empty|description: must use ASCII text and punctuation only'"),
    ("'tool'", "''", _text(*_MANUAL), "sub/run.py", "'description: must be non-empty|scripts: sub/run.py must be a safe filename|instructions: must mention packaged script scripts/sub/run.py|instructions: referenced file does not exist: scripts/run.py'"),
)


@query(f"select event_id, {_by('event_id', *(p[4] for p in _PAYLOADS))} as errors from events")
def payload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of payloads: names, descriptions, files, and what instructions mention."""
    rows = _events(spark, sf_dir).selectExpr(
        "event_id", *(f"{_by('event_id', *(p[i] for p in _PAYLOADS))} as {c}" for i, c in enumerate(("name", "description", "instructions"))),
        "map(" + _by("event_id", *(f"'{p[3]}'" for p in _PAYLOADS)) + ", 'x = 1') as scripts_dict", "cast(map() as map<string,string>) as references_dict",
    )
    return rows.select("event_id", F.array_join(validate.payload_errors(), "|").alias("errors"))


_NL = "chr(10)"
#: Parts of an instruction body, each there or not by another remainder; the steps stand last.
_BODY = " || ".join((
    f"case when event_id % 13 = 0 then '' else '# ' || event_type || {_NL} end", f"case when event_id % 11 = 1 then '' else '## Helper Scripts Available' || {_NL} end", f"case when event_id % 2 = 0 then '- scripts/' || event_type || '.py' || {_NL} else '- none' || {_NL} end",
    f"case when event_id % 7 = 2 then '' else '## Running Bundled Scripts' || {_NL} end", f"case when user_id % 5 = 3 then '' else 'Ask with --help.' || {_NL} end", f"case user_id % 4 when 0 then '' when 1 then 'Then --kwargs-json.' || {_NL} else 'Then --args-json.' || {_NL} end",
    f"case when user_id % 17 = 4 then 'Für alle.' || {_NL} else '' end", f"case when event_id % 19 = 5 then 'Hand it to us.' || {_NL} else '' end", f"case when event_id % 23 = 6 then '' else '## Quick Start' || {_NL} end",
    f"case when user_id % 9 = 0 then '' else '1. Look' || {_NL} || case when user_id % 6 = 1 then '3' else '2' end || '. Run' || {_NL} end",
))
_ROUTE = "case when event_id % 3 = 0 then 'For ' else 'Use When ' end || event_type || case when event_id % 5 = 0 then '. ' else '. DO NOT use otherwise.' end || case when user_id % 7 = 0 then ' nötig' else '' end"


@query(f"""
with t as (select event_id, {_BODY} as body, {_ROUTE} as route from events),
s as (select *, list_transform(regexp_extract_all(case when contains(body, '## Quick Start') then body[position('## Quick Start' in body):] else '' end, '(?m)^[0-9]+[.]'), lambda x: rtrim(x, '.')::int) as steps, contains(body, 'scripts/') as scripts from t)
select event_id, case when not regexp_matches(body, '[^ \\n]') then 'instructions must be non-empty' when regexp_matches(body, '[^\\x00-\\x7F]') then 'instructions must use ASCII text and punctuation only'
  when not regexp_matches(body, '(?m)^# ') then 'instructions must include a top-level markdown heading' when not contains(body, '## Helper Scripts Available') then 'instructions must include a ''## Helper Scripts Available'' section'
  when not contains(body, '## Quick Start') then 'instructions must include a ''## Quick Start'' section' when scripts and not contains(body, '## Running Bundled Scripts') then 'instructions that reference scripts must include a ''## Running Bundled Scripts'' section'
  when scripts and not contains(body, '--help') then 'instructions that reference scripts must tell the agent to run --help first'
  when scripts and not contains(body, '--args-json') and not contains(body, '--kwargs-json') then 'instructions that reference scripts must include JSON invocation examples' when len(steps) = 0 then 'Quick Start must include chronological numbered steps'
  when steps <> range(1, len(steps) + 1)::int[] then 'instruction steps must be chronologically numbered without gaps' when regexp_matches(body, '\\bus\\b') then 'instructions must avoid first-person phrasing' end as body_error,
  case when regexp_matches(route, '[^\\x00-\\x7F]') then 'description must use ASCII text and punctuation only' when not contains(lower(route), 'use when') then 'description must include an explicit ''Use when'' trigger'
  when not contains(lower(route), 'do not use') then 'description must include a negative ''Do not use'' constraint' end as route_error from s""")
def instruction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First errors of instruction bodies and of routing descriptions, made of parts that come and go."""
    rows = _events(spark, sf_dir).selectExpr("event_id", f"{_BODY} as body", f"{_ROUTE} as route")
    return rows.select("event_id", validate.instruction_error("body").alias("body_error"), validate.description_error("route").alias("route_error"))


_MANUAL = " || ".join((
    "'Manual. '", "case when event_id % 5 = 0 then '' else 'See scripts/' || event_type || '.py. ' end", "case when event_id % 4 = 1 then '' else 'Run python scripts/' || event_type || '.py --n' || user_id || '. ' end",
    "case when user_id % 7 = 2 then '' else 'Ask --help. ' end", "case when user_id % 3 = 0 then '' else 'Give --n' || user_id || ' and --m. ' end", "case when event_id % 11 = 3 then '' else 'Choose --output.' end",
))


@query(f"""
with t as (select event_id, {_MANUAL} as body, 'scripts/' || event_type || '.py' as path, '--n' || user_id as flag, event_id % 2 = 0 as helps, event_id % 6 <> 5 as flags from events)
select event_id, case when not contains(body, path) then 'SKILL.md must mention generated script path ' || path when not contains(body, 'python ' || path || ' ' || flag) then 'SKILL.md must mention the example execution command'
  when helps and not contains(body, '--help') then 'SKILL.md must mention --help for scripts that support it' when flags and not contains(body, flag) then 'SKILL.md must document CLI flag ' || flag
  when flags and not contains(body, '--m') then 'SKILL.md must document CLI flag --m' when flags and not contains(body, '--output') then 'SKILL.md must document --output for CLI-driven scripts' end as error from t""")
def manual_fits_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First way in which a manual, made of parts that come and go, doesn't fit its script."""
    rows = _events(spark, sf_dir).selectExpr(
        "event_id", f"{_MANUAL} as instructions", "event_type || '.py' as filename", "'python scripts/' || event_type || '.py --n' || user_id as example_command", "event_type as skill_id", "event_id % 2 = 0 as supports_help",
        "case when event_id % 6 <> 5 then array(named_struct('flag', '--n' || user_id), named_struct('flag', '--m')) else cast(array() as array<struct<flag:string>>) end as cli_arguments",
    )
    return rows.select("event_id", validate.matches_script_error().alias("error"))


@query("""
with c as (select value as a, user_id as b, event_id % 3 = 0 as c from events)
select 'a' as "column", min(a) as min, max(a) as max, round(avg(a), 6) as mean from c union all select 'b', min(b)::double, max(b)::double, round(avg(b), 6) from c
union all select 'c', min(c::int)::double, max(c::int)::double, round(avg(c::int), 6) from c""")
def numeric_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric summary that counts numeric strings and booleans and leaves a key out."""
    json = "'{\"a\":' || value || ',\"b\":\" ' || user_id || ' \",\"c\":' || (event_id % 3 = 0) || ',\"d\":' || event_id || ',\"e\":\"x\",\"f\":null}' as row"
    rows = _events(spark, sf_dir).selectExpr(json)
    found = data.summarize_json(rows, "row", exclude=["d"], allow_numeric_strings=True, count_booleans=True)
    return found.withColumn("mean", F.round("mean", 6))


# --- workspaces and models --------------------------------------------------------------

_ASKED = _by("event_id", "'/workspace/output/a' || event_id || '.txt'", "'logs/b.txt'", "'/etc/passwd'", "'../x'", "' '", "'sub/./c.txt'", "'/workspace/input/d.txt'")


@query(f"""select event_id, {_by("event_id", "'/workspace/output/a' || event_id || '.txt'", "'/workspace/logs/b.txt'", *["null"] * 5)} as writable,
  {_by("event_id", "'output/a' || event_id || '.txt'", "'output/logs/b.txt'", "null", "null", "null", "null", "'input/d.txt'")} as captured,
  {_by("event_id", "null", "null", "'output_file must stay under /workspace: /etc/passwd'", "'output_file contains an unsafe path segment: ../x'", "'output_file must be non-empty'", "'output_file contains an unsafe path segment: sub/./c.txt'", "null")} as error from events""")
def workspace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run's files may be written, and where its output is captured."""
    rows = _events(spark, sf_dir).selectExpr("event_id", f"{_ASKED} as asked")
    captured, error = agent.capture_path("asked")
    return rows.select("event_id", agent.writable_path("asked").alias("writable"), captured.alias("captured"), error.alias("error"))


@query("""
with p as (select doc_id, rpad('name-' || source, 64, 'x') as name from documents), r as (select *, row_number() over (partition by name order by doc_id) as n from p)
select doc_id, case when n = 1 then name else rtrim(substr(name, 1, 64 - length('-' || n)), '-') || '-' || n end as unique_name from r""")
def payload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique names of payloads, 64 characters at most."""
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id", "rpad('name-' || source, 64, 'x') as name")
    return legacy.payload_names(rows, "doc_id").select("doc_id", "unique_name")


#: A decision whose fields are there, null, or of another type, each by another remainder.
_ANSWER = "'{' || " + " || ',' || ".join((
    """case event_id % 5 when 0 then '"decision":' || user_id when 1 then '"decision":null' when 2 then '"x":1' else '"decision":"' || event_type || '"' end""",
    """case event_id % 7 when 0 then '"reason":["' || event_type || '"]' when 1 then '"y":{}' else '"reason":"r' || user_id || '"' end""",
    """case user_id % 6 when 0 then '"tags":"a"' when 1 then '"tags":null' when 2 then '"z":[]' when 3 then '"tags":{"a":1}' else '"tags":["' || event_type || '"]' end""",
    """case user_id % 4 when 0 then '"coupling_score":0.' || event_id when 1 then '"coupling_score":"high"' when 2 then '"coupling_score":1' else '"v":true' end""",
    """case event_id % 3 when 0 then '"skill_id":7' when 1 then '"skill_id":"s' || event_id || '"' else '"skill_id":null' end""",
)) + " || '}'"


def _field(name: str, kinds: str, label: str, required: bool = False) -> str:
    at = f"json_type(content, '$.{name}')"
    missing = f"when coalesce({at}, 'NULL') = 'NULL' then '{name}: field required' " if required else ""
    return f"{missing}when {at} <> 'NULL' and {at} not in ({kinds}) then '{name}: must be a JSON {label}'"


@query(f"""select event_id, case {_field("decision", "'VARCHAR'", "string", True)} {_field("reason", "'VARCHAR'", "string", True)} {_field("skill_id", "'VARCHAR'", "string")} {_field("tags", "'ARRAY'", "array")}
  {_field("coupling_score", "'UBIGINT', 'BIGINT', 'DOUBLE'", "number")} end as error from (select event_id, ({_ANSWER})::json as content from events)""")
def answer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of model answers against the schema of a decision."""
    rows = _events(spark, sf_dir).selectExpr("event_id", f"{_ANSWER} as content")
    return rows.select("event_id", structured.schema_error("content", structured.DECISION).alias("error"))


_SYSTEM = "case event_id % 3 when 0 then ' Be brief. ' when 1 then '' else cast(null as varchar(9)) end"
_FIXED = "'Return exactly one JSON object that validates against the requested schema.' || chr(10) || 'Do not include markdown, code fences, commentary, or extra keys.' || chr(10) || 'Use double-quoted JSON strings and no trailing commas.'"


@query(f"""
with t as (select event_id, trim({_SYSTEM}) as system, '  Judge ' || event_type || chr(10) as prompt, coalesce(nullif(regexp_replace(substr('Answer ' || event_type || user_id, 1, 64), '[^A-Za-z0-9_-]', '_', 'g'), ''), 'StructuredResponse') as name from events)
select event_id, name, case when coalesce(system, '') <> '' then system || chr(10) else '' end || {_FIXED} as system_text,
  'Judge ' || regexp_replace(trim(prompt), 'Judge |\n', '', 'g') || chr(10) || chr(10) || 'Required response schema name: ' || name || chr(10) || 'Required JSON schema:' || chr(10) || '{{"id":' || event_id || '}}' as user_text from t""")
def model_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two messages of a structured request."""
    name = agent.schema_name(F.concat(F.lit("Answer "), F.col("event_type"), F.col("user_id")))
    rows = _events(spark, sf_dir).withColumn("name", name).withColumn("system", F.expr(_SYSTEM.replace("varchar(9)", "string")))
    found = agent.messages(F.concat(F.lit("  Judge "), F.col("event_type"), F.lit("\n")), F.col("name"), F.concat(F.lit('{"id":'), F.col("event_id"), F.lit("}")), F.col("system"))
    return rows.select("event_id", "name", found.alias("m")).select("event_id", "name", F.col("m")[0]["content"].alias("system_text"), F.col("m")[1]["content"].alias("user_text"))


# --- trees on disk ----------------------------------------------------------------------

_FILE_OF = "'d' || doc_id || " + _by("doc_id", "'.py'", "'.java'", "'.bin'", "''", "'.PY'")
_HELD = _by("doc_id", "coalesce(text, '')", "coalesce(text, '')", "coalesce(text, '')", "'#!/bin/sh' || chr(10) || coalesce(text, '')", "coalesce(text, '')")


#: Bytes of folders that are written at once; those before them may still be on their way out.
TREE_BYTES = 1 << 30


@query(f"""
with f as (select 'd' || doc_id as skill, {_FILE_OF} as file, {_HELD} as held, doc_id % 5 as k from documents),
e as (select unnest([skill || '/', skill || '/SKILL.md', skill || '/scripts/', skill || '/scripts/' || file]) as entry from f)
select 'file' as kind, skill || '/scripts/' || file as name, octet_length(encode(held))::bigint as size, md5(held) as digest from f where k <> 2
union all select 'mount', skill, length('# ' || skill), null from f
union all (select 'entry', entry, null, null from e order by entry limit 200)
union all select 'entry', '... ' || (count(*) - 200) || ' more', null, null from e having count(*) > 200""")
def skill_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders written by commit, one a document; what a scan keeps of them, what mounts find, and the listing.

    A folder takes far more of a disk than its document does of the table.  So a large table's
    folders are written, read and removed range by range; what is read of them stays.
    """
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id", "'d' || doc_id as skill_id", f"{_FILE_OF} as filename", f"{_HELD} as script_text", "'# d' || doc_id as skill_md")
    spark.dataSource.register(SkillFolders)
    parts, files, listed, gone = ranges(rows, "doc_id", F.octet_length("script_text") + SKILL_BYTES, TREE_BYTES), [], [], None
    slices = 2 * spark.sparkContext.defaultParallelism if len(parts) > 1 else 0
    with ThreadPoolExecutor(1) as other:
        for k, part in enumerate(parts):
            root = scratch(spark, "tree")
            part.drop("doc_id").write.format(SkillFolders.name()).mode("append").save(root)
            kept = scan.scan_tree(spark, root, slices=slices).select(F.lit("file").alias("kind"), F.col("path").alias("name"), F.length("content").cast("long").alias("size"), F.md5("content").alias("digest"))
            files.append(materialise(kept, "files"))
            listed.append(materialise(read_tree(spark, root, content=False, slices=slices).select("path", "length"), "listed"))
            if gone:
                gone.result()
            if k < len(parts) - 1:  # while the next is written; the last goes at driver exit
                gone = other.submit(remove_tree, spark, root)
                sweep(spark)
    names, none = reduce(DataFrame.union, listed), F.lit(None)
    mounts = scan.mounts(names).select(F.lit("mount"), "skill", "size", none.cast("string"))
    return reduce(DataFrame.union, files).union(mounts).union(scan.shown_entries(names).select(F.lit("entry"), "entry", none.cast("long"), none.cast("string")))


# --- a model's scripts ------------------------------------------------------------------

_TAKER = "'def take_rows_' || event_id || '(rows: list, limit: int = 3) -> list:' || chr(10) || '    \"\"\"Keep rows of ' || event_type || '.\"\"\"' || chr(10) || '    kept = rows[:limit]' || chr(10) || '    return kept' || chr(10)"


def _said(name: str, flag: str, text: str) -> str:
    import json

    own = {"name": "rows", "flag": flag, "value_type": "json", "required": True, "help": "Rows."}
    content = {"script_text": text, "description": f"Take {name}.", "filename": f"{name}_own.py", "cli_arguments": [own], "example_command": f"python scripts/{name}_own.py {flag} [] --output json", "supports_help": True}
    return json.dumps({"choices": [{"message": {"content": json.dumps(content)}}]})


def _stub(body: str) -> str:
    """A model that answers by the number in a node's name: soundly, dangerously, without JSON, with a flag that it mends when asked, without main, or not at all."""
    import json
    import re

    text = json.loads(body)["messages"][1]["content"]
    script = "def core_function(rows: list) -> list:\n    return rows\n\n\ndef main() -> None:\n    {0}\n"
    if found := re.search(r"take_rows_(\d+)_own\.py", text):  # a manual, or a script to mend
        name = f"take_rows_{found[1]}"
        if "corrected JSON object" in text:
            return _said(name, "--rows-json", script.format("print(core_function([]))"))
        path = f"scripts/{name}_own.py"
        manual = "\n\n".join((
            "# Own", "## Quick start", f"1. Run `python {path} --rows-json [] --output json`, or --help.", "## Scripts", f"- {path}", "## Inputs", "- --rows-json, --output", "## Output", "stdout and stderr.",
            "## When to use", "Use when: rows are many.", "Do not use when: none are there.",
        ))
        manual = manual if int(found[1]) % 4 else manual.replace("## Inputs", "## In")
        return json.dumps({"choices": [{"message": {"content": json.dumps({"instructions": manual})}}]})
    found = re.search(r"Node: take_rows_(\d+)", text)
    if not found or "Write one Python script" not in text or int(found[1]) % 6 == 5:
        raise ConnectionError("no line")
    name, kind = f"take_rows_{found[1]}", int(found[1]) % 6
    if kind == 2:
        return "no JSON"
    return _said(name, "rows" if kind == 3 else "--rows-json", script.format("eval('1')" if kind == 1 else "pass").replace("main", "start" if kind == 4 else "main"))


@query("""select 'm/e' || event_id || '.py' as file_path, 'take-rows-' || event_id as skill_id, case when own then 'model' else 'template' end as writer,
  'take_rows_' || event_id || case when own then '_own.py' else '.py' end as filename, case when own then '--rows-json' else '--rows-json,--limit' end as flags,
  case when own then 'Take take_rows_' || event_id || '.' else 'Keep rows of ' || event_type || '.' end as description,
  'python scripts/take_rows_' || event_id || case when own then '_own.py --rows-json []' else '.py --rows-json ''{}'' --limit ''10''' end || ' --output json' as example_command, own and event_id % 4 <> 0 as own_manual
from (select *, event_id % 6 in (0, 3) as own from events)""")
def model_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mining with a model that answers well, badly, dangerously or not at all: the template's script and manual stand in."""
    files = _events(spark, sf_dir).selectExpr("'m/e' || event_id || '.py' as path", f"{_TAKER} as text", "cast(null as string) as error")
    found = mine_files(files, _stub, retries=0).packages
    flags = F.array_join(F.col("cli_arguments.flag"), ",").alias("flags")
    return found.select("file_path", "skill_id", "writer", "filename", flags, "description", "example_command", F.startswith("instructions", F.lit("# Own")).alias("own_manual"))


def _judge(body: str) -> str:
    """A model that decides by the number in a node's name: extracts under its own id, skips, breaks a rule, says nothing."""
    import json
    import re

    number = int(re.search(r"take_rows_(\d+)", json.loads(body)["messages"][1]["content"])[1])
    said = (
        {"decision": "extract", "reason": f"of use {number}", "skill_id": f"taker-{number}", "tags": ["rows"], "coupling_score": 0.25}, {"decision": "skip", "reason": "of no use"}, {"decision": "extract", "reason": "r", "skill_id": "Bad Id"},
        {"decision": 1}, {"decision": "skip", "reason": "r", "skill_id": "has-one"},
    )
    return json.dumps({"choices": [{"message": {"content": json.dumps(said[number % 5])}}]})


@query("""select 'm/e' || event_id || '.py' as file_path, case event_id % 5 when 1 then 'skip' else 'extract' end as decision, case event_id % 5 when 0 then 'taker-' || event_id when 1 then null else 'take-rows-' || event_id end as skill_id,
  event_id % 5 in (0, 1) as own, case event_id % 5 when 0 then 'of use ' || event_id when 1 then 'of no use' end as own_reason, event_id % 5 = 0 as own_score from events""")
def model_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a model where they keep the rules, else the rules' own."""
    files = _events(spark, sf_dir).selectExpr("'m/e' || event_id || '.py' as path", f"{_TAKER} as text")
    nodes = materialise(extract.python_nodes(files), "nodes")  # read for imports and for decisions, parsed once
    rules = materialise(decide(dependencies.with_dependencies(nodes, files.select("path"))), "rules")
    found = structured.decide_with_model(rules, _judge, retries=0)
    before = rules.select("node_id", F.col("reason").alias("was"))
    own = F.col("reason") != F.col("was")
    return found.join(before, "node_id").select("file_path", "decision", "skill_id", own.alias("own"), F.when(own, F.col("reason")).alias("own_reason"), (F.col("coupling_score") == 0.25).alias("own_score"))
