"""Plumbing around execution as pure functions: histories, argument vectors, commands, guards."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import col, strip, suffix
from .names import running


def history(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Adds ``history``: the texts before each turn, null for the first as after a reset."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.collect_list(text).over(before)
    return turns.withColumn("history", F.when(F.size(found) > 0, found))


def history_spans(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, order, text, start, length, before): where a turn lies in its conversation's text, and how many turns come before.

    What a turn sees is the conversation's first ``start`` characters, so nothing is written
    twice: linear in the turns, where ``history`` is quadratic.  A null text has length 0 and
    counts as no turn, as ``history`` leaves nulls out.  A conversation may span tasks.
    """
    rows = turns.select(key, order, text).withColumn("length", F.coalesce(F.length(text), F.lit(0)).cast("long"))
    out = running(rows, [key], [order], {"_end": F.col("length"), "_seen": F.col(text).isNotNull().cast("long")})
    return out.select(key, order, text, (F.col("_end") - F.col("length")).alias("start"), "length", (F.col("_seen") - F.col(text).isNotNull().cast("long")).alias("before"))


def expand_history(spans: DataFrame, wanted: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, order, history) of ``wanted`` (key, order) turns alone, in the form of ``history``."""
    asked = spans.join(wanted.select(key, order), [key, order], "left_semi").select(F.col(key).alias("_k"), F.col(order).alias("_o"))
    earlier = asked.join(spans, F.col("_k").eqNullSafe(F.col(key)) & (F.col(order) < F.col("_o")) & F.col(text).isNotNull(), "left")
    found = earlier.groupBy("_k", "_o").agg(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text)))).alias("h"))
    return found.select(F.col("_k").alias(key), F.col("_o").alias(order), F.when(F.size("h") > 0, F.col(f"h.{text}")).alias("history"))


def backoff_schedule(retries: int = 3, initial: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    """Waits before each retry, without jitter."""
    return F.transform(F.sequence(F.lit(0), F.lit(retries - 1)), lambda i: F.least(F.lit(initial) * F.pow(F.lit(factor), i), F.lit(most)))


def jittered(wait: Column, share: float = 0.1) -> Column:
    return wait * (1 + (F.rand() * 2 - 1) * share)


#: What every request for an object of a schema starts with.
FIXED = "Return exactly one JSON object that validates against the requested schema.\nDo not include markdown, code fences, commentary, or extra keys.\nUse double-quoted JSON strings and no trailing commas."


def request(prompt: str, schema_name: str, schema: str) -> str:
    """Body with the two ``messages`` of a prompt."""
    import json

    user = f"{prompt.strip()}\n\nRequired response schema name: {schema_name}\nRequired JSON schema:\n{schema}"
    return json.dumps({"messages": [{"role": "system", "content": FIXED}, {"role": "user", "content": user}], "stream": False}, ensure_ascii=False, separators=(",", ":"))


def messages(prompt: Column, schema_name: Column, schema: Column, system: Column | None = None) -> Column:
    """System and user message that ask for one JSON object of a schema."""
    fixed = F.lit(FIXED)
    head = fixed if system is None else F.concat_ws("\n", F.nullif(strip(system), F.lit("")), fixed)
    user = F.concat(strip(prompt), F.lit("\n\nRequired response schema name: "), schema_name, F.lit("\nRequired JSON schema:\n"), schema)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", head), message("user", user))


def schema_name(name: Column | str) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(col(name), "[^A-Za-z0-9_-]", "_"), 1, 64), F.lit("")), F.lit("StructuredResponse"))


def completions_url(base: Column | str) -> Column:
    plain = F.regexp_replace(col(base), "/+$", "")
    return F.when(F.endswith(plain, F.lit("/chat/completions")), plain).otherwise(F.concat(plain, F.lit("/chat/completions")))


def slot_time(number: int, per_minute: float) -> float:
    """Seconds after the start at which a token bucket that is full then lets call ``number`` (from 0) go."""
    return max(0.0, (number + 1 - max(1.0, per_minute)) / (per_minute / 60.0))


class Pace:
    """Waits of one of ``places`` callers that share one bucket without talking to each other.

    Call k of the bucket's schedule belongs to caller k mod ``places``; each attempt, a repeated
    one too, takes its caller's next.  Turns that a full bucket would have let lapse by now are
    passed over, so whatever stalls, no minute sees more than the bucket allows, and a caller that
    has much to do isn't held to a share that others leave idle beyond its own turns.
    """

    def __init__(self, start: float, per_minute: float, place: int, places: int, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.start, self.per_minute, self.place, self.places, self.clock, self.sleep = start, per_minute, place, places, clock, sleep
        self.next = place

    def wait(self) -> None:
        now = self.clock() - self.start
        lapsed = ceil(now * self.per_minute / 60.0 - 1)  # turns before this one are older than a full bucket
        if self.next < lapsed:
            self.next = lapsed + (self.place - lapsed) % self.places
        due = slot_time(self.next, self.per_minute)
        self.next += self.places
        if due > now:
            self.sleep(due - now)


def attempts(transport: Callable[[str], str], body: str, retries: int, initial_wait: float, pace: Pace | None, sleep: Callable[[float], None]) -> tuple[str | None, str | None]:
    """(answer, error) of one body: each attempt waits for its turn, after a failure also for its back-off."""
    import random

    error = None
    for attempt in range(retries + 1):
        if pace:
            pace.wait()
        try:
            return transport(body), None
        except Exception as problem:  # the transport's own; kept as the row's error
            error = f"{type(problem).__name__}: {problem}"
            if attempt < retries:
                sleep(min(initial_wait * 2.0**attempt, 30.0) * random.uniform(0.9, 1.1))
    return None, error


def call_model(rows: DataFrame, transport: Callable[[str], str], retries: int = 3, rate_per_minute: float | None = None, initial_wait: float = 1.0) -> DataFrame:
    """(id, response, error) of (id, body) rows through an injected transport, in Arrow batches.

    A failed call waits ``initial_wait`` seconds, twice as long each time, 30 at most, a tenth
    more or less by chance.  With a rate the rows are dealt evenly over as many tasks as run at
    once, and these take turns of one token bucket (``Pace``; clocks of executors must agree).
    Nothing here opens a connection.
    """
    places, start = callers(rows, rate_per_minute), time.time()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = _own_pace(start, rate_per_minute, places)
        for pdf in batches:
            out = [(one.id, *attempts(transport, one.body, retries, initial_wait, pace, time.sleep)) for one in pdf.itertuples()]
            yield pd.DataFrame(out, columns=["id", "response", "error"])

    asked = rows.select("id", "body")
    return (asked.repartition(places) if places else asked).mapInPandas(run, "id string, response string, error string")


def callers(rows: DataFrame, rate_per_minute: float | None) -> int:
    """Tasks that take turns of a rate; 0 without one."""
    return rows.sparkSession.sparkContext.defaultParallelism if rate_per_minute else 0


def _own_pace(start: float, rate_per_minute: float | None, places: int) -> Pace | None:
    from pyspark import TaskContext

    context = TaskContext.get()
    return Pace(start, rate_per_minute, (context.partitionId() if context else 0) % places, places, time.time, time.sleep) if places else None


def with_answers(rows: DataFrame, prompt: Column, answer: Callable[[str, Callable], tuple[str | None, str | None]], transport: Callable[[str], str], retries: int = 3, rate_per_minute: float | None = None, initial_wait: float = 1.0) -> DataFrame:
    """Rows with ``_said``, struct(content, fault) of what ``answer`` makes of a prompt, null where that is null.

    ``answer`` gets the prompt and a call, which sends a body as ``call_model`` does and gives
    (response, error).  Rows stay where they are, so no answer has to be joined to its row.
    """
    places, start = callers(rows, rate_per_minute), time.time()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pace = _own_pace(start, rate_per_minute, places)
        call = lambda body: attempts(transport, body, retries, initial_wait, pace, time.sleep)
        for prompts in batches:
            said = [None if one is None else answer(one, call) for one in prompts.to_pylist()]
            parts = [pa.array([one and one[k] for one in said], pa.string()) for k in (0, 1)]
            yield pa.StructArray.from_arrays(parts, ["content", "fault"], mask=pa.array([one is None for one in said], pa.bool_()))

    said = F.arrow_udf(run, "struct<content:string,fault:string>").asNondeterministic()
    return (rows.repartition(places) if places else rows).withColumn("_said", said(prompt))


def named_arguments(args: Column | str) -> Column:
    """Argument vector of a JSON object, in the object's order.

    True is a bare flag, false and null are left out, a list repeats its flag (or is JSON if
    the flag ends ``-json``), an object is JSON.
    """

    def one(key: Column, v: Column, of: Column) -> Column:
        flag = F.concat(F.lit("--"), F.replace(key, F.lit("_"), F.lit("-")))
        text = F.try_variant_get(v, "$", "string")
        items = F.try_variant_get(v, "$", "array<string>")
        listed = F.flatten(F.transform(items, lambda x: F.array(flag, x)))
        whole = F.array(flag, F.to_json(v))
        none = F.array().cast("array<string>")
        return (
            F.when(v.isNull() | F.is_variant_null(v), none)
            .when(of == "BOOLEAN", F.when(text == "true", F.array(flag)).otherwise(none))
            .when(F.startswith(of, F.lit("ARRAY")), F.when(F.endswith(flag, F.lit("-json")), whole).otherwise(listed))
            .when(F.startswith(of, F.lit("OBJECT")), whole)
            .otherwise(F.array(flag, text))
        )

    def vector(args: Column, raw: Column) -> Column:
        return F.flatten(F.transform(F.json_object_keys(args), lambda key: let(F.try_element_at(raw, key), lambda v: let(F.schema_of_variant(v), lambda of: one(key, v, of)))))

    return let(col(args), lambda x: let(F.from_json(x, "map<string,variant>"), lambda raw: vector(x, raw)))


def interpreter(script: Column | str) -> Column:
    """Command that runs a script, by its suffix."""
    script = col(script)
    end = F.lower(suffix(script))
    run = lambda *head: F.array(*map(F.lit, head), script)
    return (
        F.when(end == ".py", run("python"))
        .when(end.isin(".sh", ".bash"), run("bash"))
        .when(end == ".js", run("node"))
        .when(end == ".ps1", run("pwsh", "-File"))
        .when(end.isin(".bat", ".cmd"), run("cmd", "/c"))
        .otherwise(F.array(script))
    )


def sandbox_command(
    name: Column, workspace: Column, skill: Column, script: Column, arguments: Column, image: str = "python:3.12-slim", cli: str = "docker", network: bool = False,
    memory: str | None = "1g", cpus: float | None = 1.0, pids: int | None = 256, extra: tuple[str, ...] = (), inside: str = "/workspace",
) -> Column:
    """Container command of one script run; the container's name is a parameter."""
    root = F.concat(F.lit(f"{inside}/skills/"), skill)
    fixed = lambda *x: F.array(*map(F.lit, x))
    limits = [] if network else ["--network", "none"]
    limits += ["--memory", memory] if memory else []
    limits += ["--cpus", str(cpus)] if cpus is not None else []
    limits += ["--pids-limit", str(pids)] if pids is not None else []
    limits += ["--cap-drop", "ALL", "--security-opt", "no-new-privileges", *extra, image]
    return F.concat(
        fixed(cli, "run", "--rm", "--name"), F.array(name), fixed("--workdir"), F.array(root), fixed("--volume"), F.array(F.concat(workspace, F.lit(f":{inside}:rw"))),
        fixed("--env", "PYTHONUNBUFFERED=1"), fixed(*limits), interpreter(F.concat(root, F.lit("/"), script)), arguments,
    )


def format_result(return_code: Column, stdout: Column, stderr: Column, timed_out: Column) -> Column:
    """What an agent reads of a run: its output alone if all is well, else status and both streams."""
    out, err = strip(stdout), strip(stderr)
    head = (
        F.when(timed_out, "Sandbox execution timed out after command start.")
        .when(return_code == 0, "Sandbox execution succeeded with stderr output.")
        .otherwise(F.concat(F.lit("Sandbox execution failed with exit code "), return_code, F.lit(".")))
    )
    full = F.array_join(F.array_compact(F.array(head, F.when(out != "", F.concat(F.lit("stdout:\n"), out)), F.when(err != "", F.concat(F.lit("stderr:\n"), err)))), "\n\n")
    return F.when(~timed_out & (return_code == 0) & (err == ""), out).otherwise(full)


def split_output_file(args: Column, keys: tuple[str, ...] = ("output_file", "output_path", "save_to")) -> tuple[Column, Column]:
    """(arguments without the first output key that is set, that key's value) of a string map."""
    first = F.coalesce(*(F.when(args[k].isNotNull(), F.lit(k)) for k in keys))
    return F.map_filter(args, lambda k, v: ~k.eqNullSafe(first)), F.try_element_at(args, first)


def workspace_path(path: Column | str, root: str = "/workspace") -> Column:
    """Absolute path with . and .. resolved; null if it leaves the workspace."""
    raw = F.coalesce(F.nullif(strip(path), F.lit("")), F.lit(root))
    whole = F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.concat(F.lit(root + "/"), raw))
    none = F.filter(F.array(F.lit("")), lambda x: F.lit(False))
    parts = F.aggregate(
        F.split(whole, "/"), none, lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    out = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when((out == root) | F.startswith(out, F.lit(root + "/")), out)


def writable_path(path: Column | str, root: str = "/workspace") -> Column:
    """Where a text file may be written: below the workspace's output or logs, else null."""
    whole = workspace_path(path, root)
    return F.when(F.startswith(whole, F.lit(f"{root}/output/")) | F.startswith(whole, F.lit(f"{root}/logs/")), whole)


def capture_path(requested: Column | str, root: str = "/workspace") -> tuple[Column, Column]:
    """(path below the workspace that stdout is captured to, error) of a requested output file."""
    plain = strip(F.translate(col(requested), "\\", "/"))
    inside = F.startswith(plain, F.lit(f"{root}/"))
    relative = F.when(inside, F.substring(plain, F.lit(len(root) + 2), F.length(plain))).otherwise(F.concat(F.lit("output/"), plain))
    unsafe = F.exists(F.split(relative, "/"), lambda part: part.isin("", ".", ".."))
    error = (
        F.when(F.coalesce(plain, F.lit("")) == "", "output_file must be non-empty")
        .when(F.startswith(plain, F.lit("/")) & ~inside, F.concat(F.lit(f"output_file must stay under {root}: "), col(requested)))
        .when(unsafe, F.concat(F.lit("output_file contains an unsafe path segment: "), col(requested)))
    )
    return F.when(error.isNull(), relative), error


def trimmed(text: Column | str, most: int = 24_000) -> Column:
    text = col(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(f"\n...[truncated after {most} characters]")))
