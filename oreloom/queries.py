"""Queries over the driver's tables for every operator, with DuckDB twins where SQL can say it.

The tables hold no code, so ``CODE`` makes source files out of events, by string
expressions that both dialects read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dims, text
from .operators import agent, bundle, data, decide, dependencies, document, extract, registry, validate
from .operators.components import connected_components as components
from .plans.mining import mine_files
from .plans.storage import materialise, spread
from .sources.scan import with_runtime
from . import twins
from .streaming.limits import token_bucket

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


_NAME = "replace(event_type, '-', '_') || '_' || cast(user_id % 50 as string)"
_TEXTS = [
    _lines("'// ' || event_type || ' helper'", "'//  second line  '", "''", "'import x from \"lodash/fp\";'", "'import y from \"./util\";'", "'export function f() { return ' || cast(user_id as string) || '; }'"),
    _lines("'#!/usr/bin/env bash'", "'# cleanup of ' || event_type", "'rm -rf ./tmp'", "'curl example'", "''"),
    _lines("'import os'", "'import json'", "'from mod3 import helper'", "'import numpy as np'", "'import os'", "'def ' || " + _NAME + " || '(x):'", "'    return open(x)'", "''"),
    _lines("'use strict;'", "'require fs'", "'const a = settings.value'", "'const b = 1'", "'const c = \"/etc/hosts\"'"),
    _lines("''", "'-- query for flask'", "'-- ' || event_type", "'select 1'", "'from t'", "''"),
    "'x = ' || cast(user_id as string)",
    _lines("'% note'", "'using System;'", "'class A { void Run() { System.exit(1); } }'", "'subprocess.run(a)'", "'include <x>'"),
    _lines("'package p;'", "'import java.util.List;'", "'import java.util.Map;'", "'public class T7 {'", "'  public List run(int a) { new ProcessBuilder(\"x\"); return null; }'", "'}'"),
]
_TEXT = "case event_id % 8 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_TEXTS)) + " end"
_SUFFIX = "case event_id % 8 when 0 then '.js' when 1 then '' when 2 then '.PY' when 3 then '.mjs' when 4 then '.lua' when 5 then '.zz' when 6 then '.cs' else '.java' end"
_PATH = "'src/' || event_type || '/' || case when event_id % 24 = 3 then '_' else '' end || " + _NAME + " || '_' || cast(event_id as string) || " + _SUFFIX
#: Source files, as a DuckDB table expression; Spark evaluates the same expressions.
CODE = f"(select event_id, {_PATH} as path, {_TEXT} as text from events)"


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))
    return events.selectExpr("event_id", f"{_PATH} as path", f"{_TEXT} as text")


_DOC_PATH = "source || '/' || lang || '/doc_' || cast(doc_id as string) || case doc_id % 6 when 0 then '.py' when 1 then '.java' when 2 then '.tsx' when 3 then '.R' when 4 then '.unknown' else '' end"
_SLUG = "coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '^-+|-+$', '', 'g'), ''), 'generated-skill')"
_ID = "path || ':0-' || n_bytes || ':' || name || ':' || substr(sha1(path || ':0:' || n_bytes || ':' || name), 1, 12)"


def _suffix_values() -> str:
    return "(values " + ", ".join(f"('{s}','{r[0]}','{r[3]}')" for r in dims.RUNTIMES for s in r[2]) + ") rt(suffix, language, runtime_hint)"


@query(f"""
with f as (select {_DOC_PATH} as path, text from documents),
s as (select path, text, lower(regexp_extract(path, '[^./](\\.[^./]+)$', 1)) as suffix, octet_length(encode(text)) as n_bytes,
  replace(regexp_extract(path, '([^/]+?)(\\.[^./]+)?$', 1), '.', '_') as name from f)
select coalesce(language, 'generic') as language, coalesce(runtime_hint, 'sandbox') as runtime_hint, count(*) as files, sum(n_bytes)::bigint as total_bytes,
  sum(length(text) - length(replace(text, chr(10), '')) + 1)::bigint as total_lines, min({_ID}) as first_node, max({_SLUG.format(x='name')}) as last_slug
from s left join {_suffix_values()} using (suffix) group by 1, 2""")
def scan_runtime_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime lookup, whole-file nodes, node ids and slugs, by language."""
    files = _table(spark, sf_dir, "documents").selectExpr(f"{_DOC_PATH} as path", "text")
    nodes = extract.generic_nodes(with_runtime(files)).withColumn("runtime_hint", F.col("metadata")["runtime_hint"])
    return nodes.groupBy("language", "runtime_hint").agg(
        F.count("*").alias("files"), F.sum("end_byte").alias("total_bytes"), F.sum("end_line").alias("total_lines"), F.min("node_id").alias("first_node"), F.max(text.slugify("name")).alias("last_slug")
    )


@query(f"""
with s as (select path, text, octet_length(encode(text)) as n_bytes, replace(regexp_extract(path, '([^/]+?)(\\.[^./]+)?$', 1), '.', '_') as name from {CODE})
select {_ID} as node_id, path as file_path, name, n_bytes::bigint as end_byte, (length(text) - length(replace(text, chr(10), '')) + 1)::bigint as end_line,
  {_SLUG.format(x='name')} as slug from s""")
def node_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, spans and slugs of whole-file nodes."""
    return extract.generic_nodes(with_runtime(_code(spark, sf_dir))).select("node_id", "file_path", "name", "end_byte", "end_line", text.slugify("name").alias("slug"))


_IMPORTS = "(" + " union all ".join(
    f"select event_id, {i} as k, unnest(regexp_extract_all(text, '(?m)^\\s*{w}\\s+.+$')) as line from {CODE}" for i, w in enumerate(extract.IMPORT_WORDS)
) + ")"


@query(f"select event_id, trim(line, ' ' || chr(10)) as line from {_IMPORTS} group by 1, 2")
def generic_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import lines of source files, distinct."""
    return _code(spark, sf_dir).select("event_id", F.explode(extract.generic_imports("text")).alias("line"))


_COMMENT = f"""
l as (select event_id, unnest(range(1, 13)) as pos, string_split(text, chr(10)) as ls from {CODE}),
s as (select event_id, pos, trim(ls[pos]) as s from l where pos <= len(ls)),
c as (select *, regexp_matches(s, '^(#|//|--|;|/\\*|\\*|%)') as isc, trim(rtrim(ltrim(s, '#/;-*% '), '*/ ')) as clean from s),
k as (select *, coalesce(sum(case when isc and clean <> '' then 1 else 0 end) over (partition by event_id order by pos rows between unbounded preceding and 1 preceding), 0) as prev from c),
stop as (select event_id, min(pos) as p from k where (s = '' and prev > 0) or (s <> '' and not isc) group by 1),
comment as (select event_id, string_agg(clean, ' ' order by pos) as docstring from k left join stop using (event_id) where isc and clean <> '' and pos < coalesce(p, 99) group by 1)"""


@query(f"with {_COMMENT} select event_id, docstring from {CODE} left join comment using (event_id)")
def leading_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment at the head of each source file."""
    return _code(spark, sf_dir).select("event_id", extract.leading_comment("text").alias("docstring"))


@query(f"""
with i as (select distinct event_id, trim(line, ' ' || chr(10)) as line from {_IMPORTS}),
q as (select *, regexp_extract(line, '["''][@]?([@A-Za-z0-9_./-]+)["'']', 1) as quoted,
  regexp_extract(line, '\\b(?:import|from|using|use|require|include|package|namespace)\\s+([A-Za-z0-9_.-]+)', 1) as word,
  regexp_extract(line, '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1) as simple from i),
m as (select event_id, line, nullif(case when quoted <> '' then split_part(split_part(quoted, '/', 1), '.', 1)
  when word <> '' then split_part(split_part(word, '/', 1), '.', 1) else simple end, '') as module from q)
select module, case when module in ({', '.join(f"'{m}'" for m in dims.STDLIB)}) then 'stdlib' else 'pip' end as kind, count(*) as imports
from m where module is not null group by 1, 2""")
def import_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import lines by root module and class."""
    nodes = extract.generic_nodes(with_runtime(_code(spark, sf_dir))).withColumn("language", F.lit("generic"))
    found = dependencies.classify_imports(nodes, _code(spark, sf_dir).select("path"))
    return found.groupBy("module", "kind").agg(F.count("*").alias("imports"))


def _labels(rules: list[tuple[str, str]], low: bool) -> str:
    subject = "lower(text)" if low else "text"
    return ", ".join(f"case when contains({subject}, '{t}') then '{label}' end" for t, label in rules)


_COUPLING = f"""list_filter([{_labels(dims.FRAMEWORKS, True)}, case when contains(text, 'os.environ') then '{dims.ENVIRONMENT}' end,
  case when contains(lower(text), 'settings.') or contains(lower(text), 'config.') then '{dims.SETTINGS}' end, case when contains(text, 'self.') then '{dims.INSTANCE}' end], lambda x: x is not null)"""
_EFFECTS = f"list_filter([{_labels([(t, label) for t, label, _ in dims.SIDE_EFFECTS], False)}], lambda x: x is not null)"
_HARD = "list_has_any(effects, [" + ", ".join(f"'{label}'" for _, label, hard in dims.SIDE_EFFECTS if hard) + "])"


@query(f"select event_id, array_to_string({_COUPLING}, '; ') as coupling, array_to_string({_EFFECTS}, '; ') as effects from {CODE}")
def coupling_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business coupling and side effects of source files."""
    return _code(spark, sf_dir).select(
        "event_id",
        F.array_join(dependencies.coupling(F.col("text"), extract.generic_imports("text")), "; ").alias("coupling"),
        F.array_join(dependencies.side_effects(F.col("text")), "; ").alias("effects"),
    )


_DECISIONS = f"""with {_COMMENT},
f as (select event_id, path, text, docstring, replace(regexp_extract(path, '([^/]+?)(\\.[^./]+)?$', 1), '.', '_') as name,
  {_COUPLING} as coupling, {_EFFECTS} as effects, len(string_split(rtrim(text, chr(10)), chr(10))) as n_lines from {CODE} left join comment using (event_id)),
d as (select *, case when name like '\\_%' escape '\\' then 'private helper functions are not promoted to public skills'
  when len(coupling) > 0 then 'business coupling detected: ' || array_to_string(coupling, ', ')
  when {_HARD} then 'unsafe or hard-to-sandbox side effects detected: ' || array_to_string(effects, ', ')
  when n_lines <= 2 and docstring is null then 'function is too trivial to justify a reusable skill' end as skip from f)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-file decisions: every file is read as one generic node."""
    files = _code(spark, sf_dir)
    nodes = extract.generic_nodes(with_runtime(files))
    for name, kind in (("is_async", "boolean"), ("has_varargs", "boolean"), ("bound", "boolean"), ("parse_error", "string"), ("n_statements", "int"), ("only_pass", "boolean")):
        nodes = nodes.withColumn(name, F.lit(None).cast(kind))
    return decide.decide(dependencies.with_dependencies(nodes, files.select("path")))


@query(f"""{_DECISIONS}
select path as file_path, case when skip is null then 'extract' else 'skip' end as decision, coalesce(skip, '{decide.EXTRACT}') as reason,
  case when skip is null then {_SLUG.format(x='name')} end as skill_id, replace(regexp_replace(path, '\\.[^.]*$', ''), '/', '.') || '.' || name as source,
  case when skip is null then 0.85 else 0.0 end::double as reusable_boundary_score, case when skip is null then 0.05 else 1.0 end::double as coupling_score from d""")
def candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision ladder over whole-file nodes."""
    return _decided(spark, sf_dir).select("file_path", "decision", "reason", "skill_id", "source", "reusable_boundary_score", "coupling_score")


@query(f"{_DECISIONS} select coalesce(skip, '{decide.EXTRACT}') as reason, count(*) as n from d group by 1")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason decides."""
    return _decided(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""
with n as (select event_id, 'get_' || event_type || '_run_' || case when event_id % 3 = 0 then 'dna_' else '' end || (user_id % 7) as name,
  case event_id % 4 when 0 then 'lib/graph_tools.py' when 1 then 'lib/sequence.py' when 2 then 'Table/x.py' else 'a.py' end as path from events),
w as (select event_id, name, path, list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: w not in ('get', 'set', 'run', 'make', 'build', 'compute')) as ws from n),
t as (select event_id, list_concat(ws, case when contains(path, 'graph') then ['graph'] else [] end,
  case when contains(path, 'sequence') or contains(name, 'dna') then ['bioinformatics'] else [] end, case when contains(lower(path), 'table') then ['table'] else [] end) as tags from w)
select event_id, array_to_string(tags, ',') as tags from t""")
def tag_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of function names and paths."""
    rows = _table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "'get_' || event_type || '_run_' || case when event_id % 3 = 0 then 'dna_' else '' end || (user_id % 7) as name",
        "case event_id % 4 when 0 then 'lib/graph_tools.py' when 1 then 'lib/sequence.py' when 2 then 'Table/x.py' else 'a.py' end as path",
    )
    return rows.select("event_id", F.array_join(decide.tags(F.col("name"), F.col("path")), ",").alias("tags"))


@query("""select page_id, contains(u, ':/') or contains(u, '"/') or contains(u, '''/') as url_path, contains(h, ':/') or contains(h, '"/') or contains(h, '''/') as html_path
from (select page_id, replace(url, '\\', '/') as u, replace(html, '\\', '/') as h from pages)""")
def absolute_path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute path literals in urls and pages."""
    return _table(spark, sf_dir, "pages").select("page_id", validate.absolute_path("url").alias("url_path"), validate.absolute_path("html").alias("html_path"))


def _danger(patterns: list[str], label: str) -> str:
    return ", ".join(f"case when regexp_matches(trim(text), '{p}') then '{label}{p}' end" for p in patterns)


_PATH_HIT = f"case when contains(t, ':/') or contains(t, '\"/') or contains(t, '''/') then '{validate.PATH_FOUND}' end"


@query(f"""
with x as (select event_id, text, replace(text, '\\', '/') as t from {CODE})
select event_id, array_to_string(list_sort(list_filter([{_danger(dims.JAVA_DANGER, 'dangerous java pattern detected: ')}, {_PATH_HIT}], lambda x: x is not null)), '; ') as java,
  array_to_string(list_sort(list_filter([{_danger(dims.GENERIC_DANGER, 'dangerous pattern detected: ')}, {_PATH_HIT}], lambda x: x is not null)), '; ') as generic,
  contains(text, 'class ') or contains(text, 'interface ') or contains(text, 'record ') as typed from x""")
def danger_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static script rules of Java and of other languages."""
    return _code(spark, sf_dir).select(
        "event_id", F.array_join(validate.java_findings("text"), "; ").alias("java"), F.array_join(validate.generic_findings("text"), "; ").alias("generic"), (F.size(validate.java_errors("text")) == 0).alias("typed")
    )


_MENTIONS = "'Use scripts/' || event_type || '.py, then references/' || event_type || '-' || (user_id % 9) || '.md. Not myscripts/x.py; see scripts/extra' || (event_id % 3) || '.py.'"
_BUNDLE = "select distinct event_id as id, unnest(['scripts/' || event_type || '.py', 'references/' || event_type || '-' || (user_id % 4) || '.md', 'scripts/extra1.py']) as path from events"


@query(f"""
with m as (select event_id as id, unnest(regexp_extract_all({_MENTIONS}, '(?:^|[^A-Za-z0-9_.-])((?:scripts|references)/[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)*)', 1)) as referenced from events),
b as ({_BUNDLE})
select distinct m.id, m.referenced from m left join b on m.id = b.id and m.referenced = b.path where b.path is null""")
def bundle_reference_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentioned files that a bundle lacks."""
    events = _table(spark, sf_dir, "events")
    docs = events.selectExpr("event_id as id", f"{_MENTIONS} as instructions")
    files = events.selectExpr("event_id as id", "explode(array('scripts/' || event_type || '.py', 'references/' || event_type || '-' || (user_id % 4) || '.md', 'scripts/extra1.py')) as path")
    return validate.missing_references(docs, files)


_GUIDE = _lines(
    "'# ' || event_type", "'## Quick start'", "'1. first'", "case event_id % 4 when 0 then '2. second' when 1 then '3. third' when 2 then '2) second' else 'text' end",
    "case event_id % 3 when 0 then '3. last' else 'note' end", "'## Scripts'", "case when event_id % 5 = 0 then 'none.' else 'scripts/run.py' end", "'## Inputs'", "'x'", "'## Output'",
    "case when event_id % 7 = 0 then 'stdout only' else 'stdout and stderr' end", "'## When to use'", "'Use when: a. Do not use when: b.'", "'9. outside'",
)


@query(f"""
with l as (select event_id as id, unnest(string_split({_GUIDE}, chr(10))) as line, generate_subscripts(string_split({_GUIDE}, chr(10)), 1) as pos from events),
m as (select *, last_value(case when line = '## Quick start' then 1 when line like '## %' then 0 end ignore nulls) over (partition by id order by pos rows between unbounded preceding and current row) as inside from l)
select id, line as step, row_number() over (partition by id order by pos) as expected, regexp_extract(line, '^([0-9]+)', 1)::int as number, regexp_matches(line, '^[0-9]+\\.') as dotted
from m where inside = 1 and regexp_matches(line, '^[0-9]+[.)]\\s+\\S')""")
def quick_start_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of quick starts against their expected numbers."""
    return validate.numbering_table(_table(spark, sf_dir, "events").selectExpr("event_id as id", f"{_GUIDE} as instructions"))


_STEPS = "[x for x in string_split(split_part(split_part(g, '## Quick start' || chr(10), 2), chr(10) || '## ', 1), chr(10)) if regexp_matches(x, '^[0-9]+[.)]\\s+\\S')]"


@query(f"""
with d as (select event_id, {_GUIDE} as g from events), s as (select event_id, g, {_STEPS} as steps from d)
select event_id, case when regexp_matches(g, '(?im)^\\s*(none|n/a|not applicable)\\.?\\s*$') then 'SKILL.md body must omit empty sections instead of using None or N/A'
  when not contains(split_part(split_part(g, '## Scripts' || chr(10), 2), chr(10) || '## ', 1), 'scripts/') then 'Scripts section must list the generated script path'
  when list_bool_or([not regexp_matches(x, '^[0-9]+\\.\\s+\\S') for x in steps]) then 'Quick start steps must use ''1.'' numbering, not ''1)'''
  when list_bool_or([regexp_extract(x, '^([0-9]+)', 1)::int <> i for x, i in steps]) then 'Quick start steps must be numbered without gaps'
  when event_id % 7 = 0 then 'Output section must describe stdout and stderr behavior' end as error from s""")
def doc_section_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fault of skill documents."""
    return spread(_table(spark, sf_dir, "events").select("event_id", "event_type")).selectExpr("event_id", f"{_GUIDE} as g").select("event_id", validate.document_error("g").alias("error"))


@query("""
select p_partkey, len(n) > 64 as too_long, not regexp_matches(n, '^[a-z0-9-]+$') as bad, contains(lower(n), 'claude') or contains(lower(n), 'anthropic') as reserved
from (select p_partkey, case when p_partkey % 11 = 0 then p_name || ' claude' when p_partkey % 7 = 0 then repeat(lower(replace(p_name, ' ', '-')), 4) else lower(replace(replace(p_name, ' ', '-'), '#', '')) end as n from part)""")
def payload_name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name rules of skill payloads."""
    rows = _table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "case when p_partkey % 11 = 0 then p_name || ' claude' when p_partkey % 7 = 0 then repeat(lower(replace(p_name, ' ', '-')), 4) else lower(replace(replace(p_name, ' ', '-'), '#', '')) end as n"
    )
    errors = validate.name_errors("n")
    has = lambda start: F.exists(errors, lambda e: F.startswith(e, F.lit(start)))
    return rows.select("p_partkey", has("name: must be 64").alias("too_long"), has("name: must match").alias("bad"), has("name: must not contain reserved").alias("reserved"))


@query("""
select event_type || '-' || user_id as skill_id, arg_max(event_id, event_id) as event_id, arg_max(value, event_id) as value, count(*)::bigint as versions from events group by 1""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-wins merge of skill packages: a third of them are old entries."""
    rows = _table(spark, sf_dir, "events").selectExpr("event_type || '-' || user_id as skill_id", "event_id", "value", "event_id as seq")
    cut = rows.agg(F.expr("percentile_approx(seq, 0.33)").alias("cut"))
    old = rows.join(F.broadcast(cut)).where("seq <= cut").drop("cut")
    new = rows.join(F.broadcast(cut)).where("seq > cut").drop("cut")
    merged = registry.upsert(registry.upsert(None, old), new)
    return merged.join(rows.groupBy("skill_id").agg(F.count("*").alias("versions")), "skill_id").select("skill_id", "event_id", "value", "versions")


@query("""
with c as (select doc_id, source, lower(substr(regexp_replace(text, '[^a-zA-Z]', '', 'g'), 1, 2)) || '.md' as candidate from documents),
n as (select *, row_number() over (partition by source, candidate order by doc_id) as k from c)
select doc_id, source, case when k = 1 then candidate else split_part(candidate, '.', 1) || '-' || k || '.md' end as unique_name from n""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique file names in each folder."""
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "lower(substr(regexp_replace(text, '[^a-zA-Z]', ''), 1, 2)) || '.md' as candidate")
    return bundle.unique_names(docs, "source", "doc_id").select("doc_id", "source", "unique_name")


@query(f"""
with {_COMMENT}, f as (select event_id, path, text, docstring, octet_length(encode(text)) as n_bytes, replace(regexp_extract(path, '([^/]+?)(\\.[^./]+)?$', 1), '.', '_') as name,
  length(text) - length(replace(text, chr(10), '')) + 1 as n from {CODE} left join comment using (event_id))
select path as file_path, 'Node: ' || name || chr(10) || 'Language: ' || l || chr(10) || 'Type: file' || chr(10) || 'Signature: ' || d || ' source file ' || regexp_extract(path, '[^/]+$') || chr(10)
  || 'Lines: 1-' || n || chr(10) || 'Bytes: 0-' || n_bytes || chr(10) || 'File: ' || path || chr(10) || coalesce('Docstring: ' || docstring || chr(10), '') || '```' || l || chr(10) || text || chr(10) || '```' as context
from (select *, case event_id % 8 when 0 then 'javascript' when 1 then 'shell' when 2 then 'python' when 3 then 'javascript' when 4 then 'lua' when 6 then 'csharp' when 7 then 'java' else 'generic' end as l,
  case event_id % 8 when 0 then 'JavaScript' when 1 then 'Shell' when 2 then 'Python' when 3 then 'JavaScript' when 4 then 'Lua' when 6 then 'C#' when 7 then 'Java' else 'Generic Source' end as d from f)""")
def llm_context_render_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model context of the nodes of all eight kinds of source files."""
    return extract.generic_nodes(with_runtime(_code(spark, sf_dir))).select("file_path", document.node_context().alias("context"))


@query("""
select conv_id, turn, coalesce(len(h), 0)::bigint as before, coalesce(array_to_string(h, '|'), '') as history from (
  select conv_id, turn, list(text) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as h from conversations)""")
def history_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that each turn sees."""
    turns = agent.history(_table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", F.coalesce(F.array_size("history"), F.lit(0)).cast("long").alias("before"), F.coalesce(F.array_join("history", "|"), F.lit("")).alias("history"))


@query("""select conv_id, turn, (sum(coalesce(length(text), 0)) over w - coalesce(length(text), 0))::bigint as start, coalesce(length(text), 0)::bigint as length, (count(text) over w - (text is not null)::int)::bigint as before
from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)""")
def history_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn lies in its conversation: what it sees without writing that out."""
    return agent.history_spans(_table(spark, sf_dir, "conversations")).drop("text")


@query("""
select event_id, '--event-type ' || event_type || case when event_id % 2 = 0 then ' --verbose' else '' end || ' --ids ' || user_id || ' --ids 7' || ' --rows-json [' || user_id || ',7] --props {"k":' || json_extract_string(props, '$.k') || '}' as argv
from events""")
def cli_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument vectors of JSON arguments."""
    args = F.expr(
        "'{\"event_type\":\"' || event_type || '\",\"verbose\":' || case when event_id % 2 = 0 then 'true' else 'false' end || ',\"skip\":null,\"ids\":[' || user_id || ',7],\"rows_json\":[' || user_id || ',7],\"props\":' || props || '}'"
    )
    return spread(_table(spark, sf_dir, "events")).select("event_id", F.array_join(agent.named_arguments(args), " ").alias("argv"))


@query("""select r_regionkey, i as attempt, least(1.0 * power(2.0, i), 30.0)::double as wait from region, unnest(range(0, r_regionkey + 3)) t(i)""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before retries, more for later regions."""
    out = None
    for retries in range(3, 8):
        part = _table(spark, sf_dir, "region").where(F.col("r_regionkey") + 3 == retries).select("r_regionkey", F.posexplode(agent.backoff_schedule(retries)).alias("attempt", "wait"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("attempt", F.col("attempt").cast("long"))


_BODY = """case event_id % 6 when 0 then '{"choices":[]}' when 1 then '{"choices":[{"x":1}]}' when 2 then '{"choices":[{"message":{"content":""}}]}'
when 3 then '{"choices":[{"message":{"content":"[1]"}}]}' when 4 then '{"choices":[{"message":{"content":"{\\"name\\":1,\\"zeta\\":2,\\"extra\\":3}"}}]}' else '{"choices":[{"message":{"content":"{\\"name\\":1}"}}]}' end"""


@query("""select event_id, case event_id % 6 when 0 then 'chat completion response missing choices' when 1 then 'chat completion choice missing message' when 2 then 'chat completion message missing JSON content'
when 3 then 'chat completion JSON content must be an object' when 4 then 'provider returned unexpected fields: extra, zeta' end as error,
case when user_id % 600 = 429 then 'rate_limited' when user_id % 600 >= 500 then 'transient' when user_id % 600 >= 400 then 'rejected' else 'ok' end as status from events""")
def response_payload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of chat responses, and what their status means."""
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 600 as code", _BODY.replace('\\"', '\\\\"') + " as body")
    return rows.select("event_id", validate.response_error("body", ("name", "value")).alias("error"), validate.status_class("code").alias("status"))


@query("""with recursive e as (select distinct 'p' || l_partkey as x, 's' || l_orderkey as y from lineitem), ends as (select x as n, y as m from e union all select y, x from e),
c(node, root) using key (node) as (
  select distinct n, n from ends
  union (select ends.m, min(c.root) from c join ends on ends.n = c.node join recurring.c as r on r.node = ends.m where c.root < r.root group by ends.m)
)
select node, root from c""")
def connected_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over every row of lineitem, ids as they are; the twin passes least labels on until none changes."""
    edges = _table(spark, sf_dir, "lineitem").selectExpr("'p' || l_partkey || ' , s' || l_orderkey as edge")
    parsed = data.parse_edges(edges).where("error is null")
    return components(parsed.select(F.col("left").alias("a"), F.col("right").alias("b")))


_EDGE = "case l_linenumber % 6 when 0 then ' p' || l_partkey || ' , s' || l_orderkey || ' ' when 1 then 'p' || l_partkey when 2 then 'p' || l_partkey || ',s,' || l_orderkey when 3 then ' ,s' || l_orderkey when 4 then 'p' || l_partkey || ',p' || l_partkey else cast(null as varchar(9)) end"


@query(f"""select l_orderkey, l_linenumber, case when good then trim(p[1]) end as "left", case when good then trim(p[2]) end as "right", case when not coalesce(good, false) then 'edge must have two parts' end as error
from (select *, len(p) = 2 and trim(p[1]) <> '' and trim(p[2]) <> '' as good from (select l_orderkey, l_linenumber, string_split({_EDGE}, ',') as p from lineitem))""")
def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges read from delimited text, and the rows that hold none."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_EDGE} as edge")
    return data.parse_edges(rows, keep=("l_orderkey", "l_linenumber"))


#: Whole texts folded to bases.
_WHOLE = "translate(regexp_replace(text, '[^a-zA-Z]', ''{g}), 'bdefhijklmnopqrsuvwxyzBDEFHIJKLMNOPQRSUVWXYZ', 'acgtacgtacgtacgtacgtacACGTACGTACGTACGTACGTAC')"


@query(f"""select doc_id, case when length(s) = 0 then 0.0 else (length(s) - length(regexp_replace(upper(s), '[GC]', '', 'g')))::double / length(s) end as gc from (select doc_id, {_WHOLE.format(g=", 'g'")} as s from documents)""")
def gc_content_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GC content of whole texts."""
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", _WHOLE.format(g="") + " as s").select("doc_id", data.gc_content("s").alias("gc"))


@query(f"""select doc_id, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) as rc from (select doc_id, {_WHOLE.format(g=", 'g'")} as s from documents)""")
def reverse_complement_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complements of whole texts."""
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", _WHOLE.format(g="") + " as s").select("doc_id", data.reverse_complement("s").alias("rc"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" union all ".join(f'select \'{c}\' as "column", min({c}) as "min", max({c}) as "max", round(avg({c}), 6) as "mean" from lineitem' for c in _NUMBERS))
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum, maximum and mean of numeric columns."""
    return data.summarize_columns(_table(spark, sf_dir, "lineitem"), list(_NUMBERS)).withColumn("mean", F.round("mean", 6))


@query("""select 'k' as "column", min(v) as "min", max(v) as "max", round(avg(v), 6) as "mean" from (select json_extract_string(props, '$.k')::double as v from events)
union all select 'user', min(user_id)::double, max(user_id)::double, round(avg(user_id), 6) from events where event_id % 3 = 0""")
def numeric_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over JSON objects with texts, booleans and nulls among the numbers."""
    row = "'{\"k\":' || json_tuple_k || ',\"user\":' || case event_id % 3 when 0 then cast(user_id as string) when 1 then '\"' || user_id || '\"' else 'true' end || ',\"none\":null}'"
    rows = _table(spark, sf_dir, "events").withColumn("json_tuple_k", F.get_json_object("props", "$.k")).select(F.expr(row).alias("row"))
    return data.summarize_json(rows, "row").withColumn("mean", F.round("mean", 6))


@query("""select event_id, case event_id % 5 when 0 then 'ok out' when 1 then 'Sandbox execution succeeded with stderr output.' || chr(10) || chr(10) || 'stdout:' || chr(10) || 'ok out' || chr(10) || chr(10) || 'stderr:' || chr(10) || 'warn'
when 2 then 'Sandbox execution failed with exit code 2.' || chr(10) || chr(10) || 'stdout:' || chr(10) || 'ok out' || chr(10) || chr(10) || 'stderr:' || chr(10) || 'warn'
when 3 then 'Sandbox execution timed out after command start.' || chr(10) || chr(10) || 'stdout:' || chr(10) || 'ok out' else 'Sandbox execution failed with exit code 1.' || chr(10) || chr(10) || 'stdout:' || chr(10) || 'ok out' end as shown,
case event_id % 4 when 0 then '/workspace/a/c' when 1 then null when 2 then '/workspace/out/' || user_id else '/workspace' end as path,
'https://api.example.com/v' || (user_id % 3) || '/chat/completions' as url from events""")
def sandbox_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted run results, guarded paths and completion urls."""
    rows = _table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "case event_id % 5 when 2 then 2 when 4 then 1 else 0 end as rc",
        "case when event_id % 5 in (1, 2) then ' warn ' else '' end as err",
        "event_id % 5 = 3 as late",
        "case event_id % 4 when 0 then 'a/./b/../c' when 1 then '../etc/passwd' when 2 then '/workspace/out/' || user_id else ' ' end as raw",
        "'https://api.example.com/v' || (user_id % 3) || case event_id % 3 when 0 then '/' when 1 then '/chat/completions' else '' end as base",
    )
    return rows.select(
        "event_id", agent.format_result(F.col("rc"), F.lit(" ok out\n"), F.col("err"), F.col("late")).alias("shown"), agent.workspace_path("raw").alias("path"), agent.completions_url("base").alias("url")
    )


@query("""select event_id, 'docker run --rm --name c' || event_id || ' --workdir /workspace/skills/' || event_type || ' --volume /tmp/w:/workspace:rw --env PYTHONUNBUFFERED=1 --network none --memory 1g --cpus 1.0 --pids-limit 256 --cap-drop ALL --security-opt no-new-privileges python:3.12-slim '
|| case event_id % 4 when 0 then 'python ' when 1 then 'bash ' when 2 then 'pwsh -File ' else '' end || '/workspace/skills/' || event_type || '/scripts/run' || case event_id % 4 when 0 then '.py' when 1 then '.SH' when 2 then '.ps1' else '.bin' end || ' --n ' || user_id as command from events""")
def sandbox_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container commands of script runs."""
    rows = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "user_id", "'c' || event_id as name", "'scripts/run' || case event_id % 4 when 0 then '.py' when 1 then '.SH' when 2 then '.ps1' else '.bin' end as script"
    )
    command = agent.sandbox_command(F.col("name"), F.lit("/tmp/w"), F.col("event_type"), F.col("script"), F.array(F.lit("--n"), F.col("user_id").cast("string")))
    return rows.select("event_id", F.array_join(command, " ").alias("command"))


@query("""
with a as (select user_id % 5 || '' as client, event_id as request_id, (event_id // 40)::double as arrival from events),
s as (select *, row_number() over w as n, max(arrival) over w as latest from a window w as (partition by client order by arrival, request_id)),
v as (select *, max(arrival - (n - 1) * 2.0) over (partition by client order by n) as far from s),
h as (select *, greatest(arrival, (n - 1) * 2.0 + far + (1.0 - 30.0) * 2.0) as ready from v),
g as (select *, max(ready) over (partition by client order by n) as granted from h)
select client, request_id, arrival, granted, granted - arrival as wait, null::varchar as error from g""")
def token_bucket_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grant times and waits of all events."""
    rows = _table(spark, sf_dir, "events").selectExpr("cast(user_id % 5 as string) as client", "event_id as request_id", "cast(event_id div 40 as double) as arrival", "1.0D as tokens")
    return token_bucket(rows, 30.0)


# --- parsers ----------------------------------------------------------------------------

_PYTHON = [
    _lines("'import math'", "'import numpy as np'", "''", "'def ' || " + _NAME + " || '(rows: list, limit: int = 3) -> list:'", "'    \"\"\"Keep the first ' || event_type || ' rows.\"\"\"'", "'    kept = rows[:limit]'", "'    return kept'", "''"),
    _lines("'class Runner:'", "'    @staticmethod'", "'    def ' || " + _NAME + " || '(self, value=1):'", "'        return self.x + value'", "''", "'async def fetch(url):'", "'    return url'", "''"),
    _lines("'import os'", "'def wipe_' || event_type || '(path):'", "'    os.remove(path)'", "'    eval(path)'", "'    return requests.get(path)'", "''"),
    _lines("'def ' || " + _NAME + " || '(*args, **kwargs):'", "'    return args'", "'def _private(x):'", "'    pass'", "''"),
    "'def broken('",
]
_JAVA = _lines(
    "'package p;'", "'import java.util.List;'", "'public class Box' || cast(user_id % 9 as string) || ' {'", "'  /** Runs ' || event_type || '. */'", "'  @Override'",
    "'  public List<String> run' || cast(user_id % 9 as string) || '(int a) throws IOException {'", "'    if (a > 0) { System.exit(a); }'", "'    return null;'", "'  }'", "'}'",
)
_MIXED = "case event_id % 7 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_PYTHON)) + f" when 5 then {_JAVA} else {_TEXTS[0]} end"
_MIXED_PATH = "'lib/' || event_type || '_graph/m' || cast(event_id as string) || case event_id % 7 when 5 then '.java' when 6 then '.js' else '.py' end"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))
    return events.selectExpr(f"{_MIXED_PATH} as path", f"{_MIXED} as text").withColumn("error", F.lit(None).cast("string"))


@query(f"""
with e as (select event_id, event_id % 7 as k, {_MIXED_PATH} as path, {_NAME} as n, event_type, user_id from events where event_id % 7 < 4),
f as (select event_id, path, n as name, 4 as start_line, 7 as end_line, false as is_async, false as has_varargs, '' as scope from e where k = 0
union all select event_id, path, n, 2, 4, false, false, 'Runner' from e where k = 1 union all select event_id, path, 'fetch', 6, 7, true, false, '' from e where k = 1
union all select event_id, path, 'wipe_' || event_type, 2, 5, false, false, '' from e where k = 2
union all select event_id, path, n, 1, 2, false, true, '' from e where k = 3 union all select event_id, path, '_private', 3, 4, false, false, '' from e where k = 3)
select path as file_path, name, start_line::bigint as start_line, end_line::bigint as end_line, is_async, has_varargs, scope from f""")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of Python files with their spans and facts."""
    nodes = extract.python_nodes(_mixed(spark, sf_dir).where("path like '%.py'")).where("error is null")
    return nodes.select("file_path", "name", "start_line", "end_line", "is_async", "has_varargs", F.array_join("scope_path", ".").alias("scope"))


@query(f"""
with e as (select {_MIXED_PATH} as path, event_type, user_id % 9 as u from events where event_id % 7 = 5)
select path as file_path, 'run' || u as name, 'public List<String> run' || u || '(int a) throws IOException' as signature, 'Runs ' || event_type || '.' as docstring,
  4::bigint as start_line, 9::bigint as end_line, 'Box' || u as scope, '@Override' as annotations, 'java.util.List' as dependencies from e""")
def java_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of Java files."""
    nodes = extract.java_nodes(_mixed(spark, sf_dir).where("path like '%.java'")).where("error is null")
    joined = lambda c: F.array_join(c, ",").alias({"scope_path": "scope"}.get(c, c))
    return nodes.select("file_path", "name", "signature", "docstring", "start_line", "end_line", joined("scope_path"), joined("annotations"), joined("dependencies"))


@query(f"""
with e as (select {_MIXED_PATH} as path, event_id % 7 as k from events)
select path as file_path, unnest(['python-delete-file', 'python-eval', 'python-http-timeout']) as rule_id, unnest(['high', 'critical', 'medium']) as severity, unnest([3, 4, 5])::bigint as line from e where k = 2
union all select path, 'java-system-exit', 'medium', 7 from e where k = 5""")
def security_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security findings of Python and Java nodes."""
    nodes = materialise(extract.mine(with_runtime(_mixed(spark, sf_dir))).where("error is null"), "nodes")
    found = bundle.findings(nodes)
    return found.join(nodes.select("node_id", "file_path"), "node_id").select("file_path", "rule_id", "severity", "line")


#: Source files of the mining queries with what their texts are made of.
_FILES = f"f as (select event_id, event_id % 7 as k, {_MIXED_PATH} as path, {_MIXED} as text, {_NAME} as n, event_type as t, user_id, user_id % 50 || '' as u, user_id % 9 || '' as v from events)"


def _node_id(start: str, end: str, name: str) -> str:
    return f"path || ':' || ({start}) || '-' || ({end}) || ':' || {name} || ':' || substr(sha1(path || ':' || ({start}) || ':' || ({end}) || ':' || {name}), 1, 12)"


def _bundled(k: int, name: str, start: str, end: str, kind: str, file: str, content: str) -> str:
    return f"select replace(replace(replace(path, '/', '-'), '_', '-'), '.', '-') as slice_id, {_node_id(start, end, name)} as node_id, '{kind}' as kind, {file} as name, {content} as content from f where k = {k}"


def _helper(name: str, lines: str, file: str, code: str, imports: str = "''") -> str:
    return twins.filled(twins.HELPER, path="path", lines=f"'{lines}'", file=file, imports=imports, code=code, n=name)


#: 1-based position of a text in a file, as the byte before it: the texts are ASCII.
_AT = "(strpos(text, '{}') - 1)"
_DEF, _PRIVATE, _STATIC, _ASYNC, _DOC = (_AT.format(x) for x in ("def ", "def _private", "@staticmethod", "async def", "/**"))


@query(f"with {_FILES} " + " union all ".join((
    _bundled(0, "n", _DEF, "length(text) - 1", "script", "replace(n, '_', '-') || '.py'", _helper("n", "4-7", "replace(n, '_', '-') || '.py'", f"rtrim(substr(text, {_DEF} + 1), chr(10))", "'import math' || chr(10) || 'import numpy as np' || chr(10) || chr(10)")),
    _bundled(1, "n", f"{_STATIC} - 4", f"{_ASYNC} - 2", "method", "'method-' || replace(n, '_', '-') || '.md'", twins.filled(twins.METHOD, path="path", n="n")),
    _bundled(1, "'fetch'", _ASYNC, "length(text) - 1", "script", "'fetch.py'", _helper("'fetch'", "6-7", "'fetch.py'", f"rtrim(substr(text, {_ASYNC} + 1), chr(10))")),
    _bundled(2, "'wipe_' || t", _DEF, "length(text) - 1", "quarantine", "'quarantined-wipe-' || t || '.md'", twins.filled(twins.WIPE, t="t")),
    _bundled(3, "n", "0", f"{_PRIVATE} - 1", "script", "replace(n, '_', '-') || '.py'", _helper("n", "1-2", "replace(n, '_', '-') || '.py'", f"substr(text, 1, {_PRIVATE} - 1)")),
    _bundled(3, "'_private'", _PRIVATE, "length(text) - 1", "script", "'private.py'", _helper("'_private'", "3-4", "'private.py'", f"rtrim(substr(text, {_PRIVATE} + 1), chr(10))")),
    _bundled(5, "'run' || v", _DOC, "length(text) - 2", "quarantine", "'quarantined-run' || v || '.md'", twins.filled(twins.JAVA, t="t", u="v")),
    _bundled(6, "'m' || event_id", "0", "length(text)", "source", "'m' || event_id || '.md'", twins.filled(twins.SOURCE, path="path", n="'m' || event_id", t="t", user="user_id || ''")),
)))
def code_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, references and quarantined code of nodes."""
    nodes = materialise(extract.mine(with_runtime(_mixed(spark, sf_dir))).where("error is null").withColumn("slice_id", text.slugify("file_path")), "nodes")
    return bundle.bundle(nodes, bundle.findings(nodes))


@query(f"""
with {_FILES}
select {_node_id(_DEF, "length(text) - 1", "n")} as node_id, replace(n, '_', '-') as skill_id, 'python' as language, n || '.py' as filename,
  'python scripts/' || n || '.py --rows-json ''{{}}'' --limit ''10'' --output json' as example_command,
  {twins.filled(twins.PYTHON_SCRIPT, id="replace(n, '_', '-')", path="path", t="t")} as script_text,
  {twins.filled(twins.PYTHON_MANUAL, id="replace(n, '_', '-')", n="n", t="t", u="u", title="upper(t[1]) || t[2:] || ' ' || u")} as skill_md from f where k = 0
union all select {_node_id("0", "length(text)", "'m' || event_id")}, 'm' || event_id, 'javascript', 'm' || event_id || '.js', 'node scripts/m' || event_id || '.js', text || chr(10),
  {twins.filled(twins.FILE_MANUAL, n="'m' || event_id", t="t", title="'M' || event_id")} from f where k = 6""")
def mined_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mining plan: packaged skills with script and document."""
    return mine_files(_mixed(spark, sf_dir)).packages.select("node_id", "skill_id", "language", "filename", "example_command", "script_text", "skill_md")


@query(f"""
with e as (select {_MIXED_PATH} as path, event_id % 7 as k, {_NAME} as n, event_type, user_id % 9 as u from events),
r as (select 'class-bound methods depend on instance or class state' as reason from e where k = 1 union all select 'async functions require event-loop specific CLI design' from e where k = 1
union all select 'unsafe or hard-to-sandbox side effects detected: performs HTTP request, deletes files' from e where k = 2 union all select 'varargs or kwargs require custom CLI design' from e where k = 3
union all select 'private helper functions are not promoted to public skills' from e where k = 3
union all select 'generated script failed validation' from e where k = 5)
select reason, count(*) as n from r group by 1""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why nodes of the mining plan were left out."""
    return mine_files(_mixed(spark, sf_dir)).skipped.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"select stage, count(*) as n from (select 'parse' as stage from events where event_id % 7 = 4) group by 1")
def mining_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no parser reads."""
    return mine_files(_mixed(spark, sf_dir)).rejects.groupBy("stage").agg(F.count("*").alias("n"))


@query(f"""
with {_FILES}
select replace(n, '_', '-') as skill_id, replace(n, '_', '-') || '/scripts/' || n || '.py' as script, replace(n, '_', '-') || '/SKILL.md' as doc, 'python' as language, 'python' as runtime_hint,
  replace(max(path)[:-4], '/', '.') || '.' || n as source, max(path) as source_file, '{{"start_line":4,"end_line":7}}' as source_span, any_value(t) || ',' || any_value(u) || ',graph' as tags, 'numpy' as dependencies,
  'active' as status, '{{"passed":true,"static_errors":[],"security_findings":[],"help_exit_code":0}}' as validation from f where k = 0 group by n
union all select 'm' || event_id, 'm' || event_id || '/scripts/m' || event_id || '.js', 'm' || event_id || '/SKILL.md', 'javascript', 'node', replace(path[:-4], '/', '.') || '.m' || event_id, path, '{{"start_line":1,"end_line":6}}',
  'm' || event_id || ',graph', 'x', 'active', '{{"passed":true,"static_errors":[],"security_findings":[]}}' from f where k = 6""")
def skill_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries of the mined skills, last wins."""
    rows = registry.upsert(None, mine_files(_mixed(spark, sf_dir)).registry)
    return rows.withColumns({"source_span": F.to_json("source_span"), "validation": F.to_json("validation"), "tags": F.array_join("tags", ","), "dependencies": F.array_join("dependencies", ",")})


from . import queries_rules  # noqa: E402, F401  (registers its queries; it needs what stands above)
