"""One rate for all tasks, histories as spans, imports of a tree where one module is everywhere."""

import random

import pandas as pd
import pytest

from oreloom.operators import agent, dependencies
from oreloom.streaming.limits import grant


class Clock:
    def __init__(self, at=0.0):
        self.now = at

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_slots_are_what_a_bucket_grants():
    for per_minute in (0.5, 1.0, 7.0, 90.0):
        want, _, _ = grant(pd.DataFrame({"client": "c", "request_id": range(200), "arrival": 0.0, "tokens": 1.0}), max(1.0, per_minute), per_minute / 60, max(1.0, per_minute), 0.0)
        assert [agent.slot_time(k, per_minute) for k in range(200)] == pytest.approx(want["granted"].tolist())


@pytest.mark.parametrize("loads", [[100, 100, 100, 100], [400, 0, 0, 0], [250, 5, 40, 0]])
def test_the_total_rate_is_held_whatever_the_load(loads):
    per_minute, calls, ends = 60.0, [], []
    for place, load in enumerate(loads):
        clock = Clock()
        pace = agent.Pace(0.0, per_minute, place, len(loads), clock, clock.sleep)
        for _ in range(load):
            pace.wait()
            calls.append(clock())
            clock.sleep(random.Random(place).choice([0.1, 0.5]))
        ends.append(clock())
    calls.sort()
    for i, at in enumerate(calls):  # no window holds more than a full bucket and what flows in meanwhile
        inside = sum(at <= c <= at + 60.0 for c in calls[i:])
        assert inside <= per_minute + 60.0 * per_minute / 60 + 1
    if max(loads) == min(loads):  # an even load uses the whole rate
        assert max(ends) <= (sum(loads) - per_minute) / (per_minute / 60) + len(loads) + 1


def test_a_stalled_caller_does_not_save_turns_up():
    clock = Clock()
    pace = agent.Pace(0.0, 60.0, 1, 4, clock, clock.sleep)
    pace.wait()
    clock.sleep(3600.0)
    times = []
    for _ in range(60):
        pace.wait()
        times.append(clock() - 3600.0)
    assert sum(t <= 1.0 for t in times) <= 60 / 4 + 1 and all(b - a >= -1e-9 for a, b in zip(times, times[1:]))


def test_attempts_take_a_turn_each():
    clock, seen = Clock(), []

    def transport(body):
        seen.append(clock())
        if len(seen) < 3:
            raise ValueError("no")
        return body + "!"

    pace = agent.Pace(0.0, 1.0, 0, 2, clock, clock.sleep)
    assert agent.attempts(transport, "a", 3, 0.0, pace, clock.sleep) == ("a!", None)
    assert seen == [0.0, 120.0, 240.0]  # one a minute for two callers


def test_a_rate_through_spark(spark):
    rows = spark.createDataFrame([(str(k), f"b{k}") for k in range(9)], "id string, body string")
    got = agent.call_model(rows, str.upper, rate_per_minute=600.0).collect()
    assert {(r.id, r.response) for r in got} == {(str(k), f"B{k}") for k in range(9)}


def test_spans_hold_what_histories_hold(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice([None, "", "é", "some words"])) for c in (1, 2, None) for t in range(12) if r.random() < 0.8]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, text string").repartition(3)
    spans = agent.history_spans(turns)
    for s in spans.collect():
        earlier = [x for c, t, x in sorted(rows, key=lambda q: (str(q[0]), q[1])) if c == s.conv_id and t < s.turn and x is not None]
        assert (s.start, s.before, s.length) == (sum(map(len, earlier)), len(earlier), len(s.text or ""))
    want = {(x.conv_id, x.turn): x.history for x in agent.history(turns).where("conv_id is not null").collect()}
    got = {(x.conv_id, x.turn): x.history for x in agent.expand_history(spans, turns.where("turn % 2 = 1 and conv_id is not null")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) == sum(t % 2 for c, t, _ in rows if c is not None)


def test_imports_that_are_everywhere_are_looked_up_apart(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{k}", "python", ["import numpy", "import own1" if k % 2 else "import own9", f"import m{k}", "import os"]) for k in range(300)], "node_id string, language string, imports array<string>")
    paths = spark.createDataFrame([(f"own{k}.py",) for k in range(8)], "path string")
    rows = lambda: sorted(map(tuple, dependencies.classify_imports(nodes, paths).collect()))
    plain = rows()
    monkeypatch.setattr(dependencies, "BROADCAST_MODULES", 3)
    monkeypatch.setattr(dependencies, "HEAVY", 10)
    assert rows() == plain and {r[3]: r[4] for r in plain if not r[3].startswith("m")} == {"numpy": "pip", "own1": "internal", "own9": "pip", "os": "stdlib"}


def test_scripts_that_share_pieces_are_parsed_by_piece(monkeypatch):
    """what a template puts in every script is parsed once a task; odd cuts are read whole."""
    import ast

    from oreloom.operators import validate

    core = 'def core_function(a: int) -> int:\n    return eval(a)\n\n\n'
    tail = 'def main() -> None:\n    pass\n\n\nif __name__ == "__main__":\n    main()\n'
    seen, parse = [], ast.parse
    monkeypatch.setattr(validate.ast, "parse", lambda text, *more: seen.append(len(text)) or parse(text, *more))
    known, held = {}, [0]
    for k in range(100):
        errors, findings = validate.check_python(f'"""Skill {k}."""\n\n{core}{tail}', "core_function", known, held)
        assert errors == [] and len(findings) == 1 and findings[0].startswith("eval")
    assert sum(seen) < 100 * len('"""Skill 10."""\n\n') + len(core + tail)
    odd = ["try:\n    f()\n\nexcept E:\n    pass\n\nfinally:\n    g()\n", 's = """\n\nif x:\n"""\n', "@d\n\ndef main(): pass\n", "x = (\n\ndef y(): pass\n", "def main():\n    pass\n\nif x:\n    pass\n\nelse:\n    eval(1)\n"]
    for text in odd:
        assert validate.check_python(text, "core_function", known, held) == validate.check_python(text, "core_function")
        try:
            parse(text)
        except SyntaxError as fault:
            assert validate.check_python(text, None, known, held)[0] == [f"syntax error: {fault.msg} at line {fault.lineno}"]


def test_facts_are_told_once_of_functions_that_differ_in_name():
    """only the name differs, so the code is unparsed once."""
    from oreloom.operators.extract import _Facts, python_functions

    facts = _Facts()
    code = 'def {0}(rows: list, n: int = 3) -> list:\n    """Keep."""\n    return {1}(rows)[:n]\n'
    found = [python_functions(code.format(f"take_{k}", "sorted"), "p", None, facts)[0] for k in range(9)]
    assert len(facts.known) == 1 and [f["name"] for f in found] == [f"take_{k}" for k in range(9)]
    recursive = python_functions(code.format("again", "again"), "p", None, facts)[0]
    assert recursive == python_functions(code.format("again", "again"), "p")[0] and "return again(rows)" in recursive["core_source"]
