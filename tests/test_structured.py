"""Model answers, repair and fallbacks; workspaces and older layouts."""

import json

import pytest
from pyspark.sql import functions as F

from oreloom.operators import java, legacy, structured
from oreloom.plans import sink
from oreloom.plans.mining import mine_files


def test_answers_are_repaired_once(spark):
    def transport(body):
        import json

        chat = lambda **content: json.dumps({"choices": [{"message": {"content": json.dumps(content)}}]})
        text = json.loads(body)["messages"][1]["content"]
        if "corrected JSON object" in text:
            return chat(decision="skip", reason="mended") if "mend me" in text else chat(decision=2)
        if "fails" in text:
            raise RuntimeError("no line")
        return chat(decision="extract", reason="fine") if "good" in text else chat(decision="mend me") if "bad" in text else chat(decision=1)

    asked = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "worse"), ("4", "fails")], "id string, prompt string")
    got = {r.id: r for r in structured.answers(asked, transport, "D", structured.DECISION, retries=1, initial_wait=0.01).collect()}
    assert json.loads(got["1"].content)["reason"] == "fine" and got["1"].fault is None
    assert json.loads(got["2"].content) == {"decision": "skip", "reason": "mended"} and got["2"].fault is None
    assert got["3"].fault == "decision: must be a JSON string" and got["4"].fault == "RuntimeError: no line"


def test_a_model_decides_and_writes_and_the_rules_stand_in(spark):
    code = lambda name: f"def {name}(rows: list) -> list:\n    kept = list(rows)\n    return kept\n"
    files = spark.createDataFrame([(f"lib/{n}.py", code(n), None) for n in ("take_rows", "drop_rows", "keep_rows", "_hidden")], "path string, text string, error string")

    def transport(body):
        import json

        chat = lambda **content: json.dumps({"choices": [{"message": {"content": json.dumps(content)}}]})
        text = json.loads(body)["messages"][1]["content"]
        if "Write one Python script" in text:
            return chat(script_text="import os\n\n\ndef core_function(rows: list) -> list:\n    return rows\n\n\ndef main() -> None:\n    pass\n") if "Node: take_rows" in text else "no JSON at all"
        assert "_hidden" not in text  # what the rules skip is never asked about
        if "Node: drop_rows" in text:
            return chat(decision="skip", reason="of no use elsewhere")
        return chat(decision="extract", reason="useful", skill_id="row-taker", tags=["rows"]) if "Node: take_rows" in text else chat(decision="extract", reason="no id")

    mined = mine_files(files, transport, retries=0, initial_wait=0.0)
    by = {r.name: r for r in mined.decisions.collect()}
    assert (by["take_rows"].skill_id, by["take_rows"].reason, by["take_rows"].tags) == ("row-taker", "useful", ["rows"])
    assert by["drop_rows"].decision == "skip" and by["drop_rows"].reason == "of no use elsewhere" and by["drop_rows"].skill_id is None
    assert by["keep_rows"].skill_id == "keep-rows" and by["_hidden"].decision == "skip"
    texts = {r.skill_id: r.script_text for r in mined.packages.collect()}
    assert texts["keep-rows"].startswith("#!/usr/bin/env python3") and texts.get("row-taker", "import os").startswith("import os")
    assert mined.counts["nodes"] == {"rows": 4, "faults": 0} and mined.counts["decisions"] == {"rows": 4, "extracted": 3} and mined.counts["scripts"]["rows"] == 2
    plain = {r.name: r.skill_id for r in mine_files(files).decisions.collect()}
    assert plain == {"take_rows": "take-rows", "drop_rows": "drop-rows", "keep_rows": "keep-rows", "_hidden": None}


def test_workspace_files(tmp_path):
    (tmp_path / "skill" / "__pycache__").mkdir(parents=True)
    (tmp_path / "skill" / "SKILL.md").write_text("x")
    (tmp_path / "skill" / "__pycache__" / "a.pyc").write_text("x")
    target = sink.copy_skill(str(tmp_path / "skill"), str(tmp_path / "w"))
    assert [p.name for p in target.iterdir()] == ["SKILL.md"] and sink.copy_skill(str(tmp_path / "skill"), str(tmp_path / "w")) == target
    assert sink.write_workspace_text(str(tmp_path / "w"), "output/a/b.txt", "é").read_text(encoding="utf-8") == "é"
    for path in ("input/a", "../a", "output/../../a", "output", "/etc/a"):
        with pytest.raises(ValueError, match="output or logs"):
            sink.write_workspace_text(str(tmp_path / "w"), path, "x")
    for name in ("scripts", "skills", "skill_old", "find-rows"):
        (tmp_path / "out" / name).mkdir(parents=True)
    assert sink.clean_legacy(str(tmp_path / "out")) == ["scripts", "skill_old", "skills"] and [p.name for p in (tmp_path / "out").iterdir()] == ["find-rows"]


def test_payload_names_stay_short(spark):
    long = "a" * 64
    names = [long, long, long, "b", "b", "b-2", "b", "a" * 62 + "-2"]
    rows = spark.createDataFrame(list(enumerate(names)), "ordinal int, name string")
    got = [r.unique_name for r in legacy.payload_names(rows).orderBy("ordinal").collect()]
    assert got == [long, "a" * 62 + "-2", "a" * 62 + "-3", "b", "b-2", "b-2-2", "b-3", "a" * 62 + "-4"]
    assert len(set(got)) == 8 and all(len(n) <= 64 for n in got)


JAVA = """\
package a.b;
import java.util.List;
import java.util.Map;
import static java.lang.Math.*;
/** Type. */
public class Foo<T extends Comparable<T>> implements Baz {
  private static final Map<String, List<int[]>> m = new HashMap<>() {{ put("a{", null); }};
  int[] a = {1, 2}; // note }
  static { init(); }
  /** Old. */
  // plain
  /**
   * Runs it.
   *   More.
   */
  @Override
  @Named(value = "x(", other = @In("y"))
  public <K, V> Map<K, List<V>> run(final int a, String... b) throws IOException, Bad {
    if (a > 0) { helper(a); }
    char c = '{'; String s = "}}\\"{"; String t = \"\"\"
      } " {
      \"\"\";
    Runnable r = new Runnable() { public void inner() { go(); } };
    return null;
  }
  Foo() { super(); }
  abstract int[] bare(List<? super T> x)[];
  enum E { A(1) { int h() { return 2; } }, B(2); final int v; E(int v) { this.v = v; } }
  record P(int x, int y) { int sum() { return x + y; } }
  Supplier<Integer> sup = () -> { return call(); };
"""


def test_java_declarations():
    rows = {r["name"]: r for r in java.java_methods(JAVA, "F.java")}
    assert list(rows) == ["run", "inner", "Foo", "bare", "h", "E", "sum"]
    run = rows["run"]
    assert run["signature"] == "public <K, V> Map<K, List<V>> run(final int a, String... b) throws IOException, Bad" and run["docstring"] == "Runs it.\nMore."
    assert run["annotations"] == ["@Override", '@Named(value = "x(", other = @In("y"))'] and run["dependencies"] == ["java.util.List", "java.util.Map"]
    assert run["raw_code"].startswith("/**\n   * Runs it.") and run["raw_code"].endswith("return null;\n  }") and run["scope_path"] == ["Foo"] and (run["start_line"], run["end_line"]) == (12, 25)
    assert rows["Foo"]["node_type"] == "constructor" and rows["E"]["node_type"] == "constructor" and rows["inner"]["node_type"] == "method"
    assert rows["bare"]["raw_code"] == "abstract int[] bare(List<? super T> x)[];" and rows["sum"]["scope_path"] == ["Foo", "E", "P"]
    for text in ("", "class", "class A {", "class A { void f() {", "class A { void f(", "} ) ]", "@", "class A { @X", "class A { void f() { new B(", '"'):
        java.java_methods(text, "x")
    assert [r["name"] for r in java.java_methods("class A { void f() { g(", "x")] == ["f"]


def test_service_command(tmp_path, monkeypatch):
    from oreloom.plans import service

    for name in service.MOUNTS:
        (tmp_path / name).mkdir()
    made = service.Service(**{n: tmp_path / n for n in service.MOUNTS}, image="image", module="serve", port=9000, cpus=2.0)
    command = made.command()
    mounts = [command[i + 1] for i, x in enumerate(command) if x == "-v"]
    assert [m.rsplit(":", 2)[1:] for m in mounts] == [["/workspace/input", "ro"], ["/workspace/skills", "ro"], ["/workspace/output", "rw"], ["/workspace/logs", "rw"]]
    assert command[-4:] == ["image", "python", "-m", "serve"] and "127.0.0.1:9000:8765" in command and made.url == "http://127.0.0.1:9000"
    assert "MODEL_API_KEY" in command and command[command.index("--cpus") + 1] == "2.0" and command[command.index("--memory") + 1] == "4g"
    monkeypatch.delenv("MODEL_API_KEY", raising=False)
    assert {f.split(":")[0] for f in made.faults()} >= {"missing API key", "skills directory contains no immediate SKILL.md entries"}
    with pytest.raises(ValueError, match="port"):
        service.Service(**{n: tmp_path for n in service.MOUNTS}, image="i", module="m", port=0)
    assert service.unique_name() != service.unique_name()


def test_helpers_of_packaged_scripts():
    import argparse
    import json
    from typing import Any

    from oreloom.operators.script import HELPERS

    space = {"json": json, "argparse": argparse, "Any": Any}
    exec(HELPERS + "\n    pass\n", space)
    assert space["_read_json"]("[1]", "--x") == [1] and [space["_truth"](t) for t in (" Yes", "1", "ON", "n", "False")] == [True, True, True, False, False]
    with pytest.raises(ValueError, match="--x must be valid JSON"):
        space["_read_json"]("{", "--x")
    with pytest.raises(argparse.ArgumentTypeError, match="expected a boolean value"):
        space["_truth"]("maybe")
    assert space["_plain"]({1: {3, 1, 2}, "b": (1, [{2}])}) == {"1": [1, 2, 3], "b": [1, [[2]]]} and space["_plain"]("x") == "x"


def test_a_refused_script_gives_way_to_the_template(spark):
    def transport(body):
        import json

        text = json.loads(body)["messages"][1]["content"]
        if "Write one Python script" not in text:
            raise ConnectionError
        return json.dumps({"choices": [{"message": {"content": json.dumps({"script_text": "def core_function(rows: list) -> list:\n    return rows\n\n\ndef main() -> None:\n    eval('1')\n"})}}]})

    files = spark.createDataFrame([("lib/a.py", "def add_rows(rows: list) -> list:\n    kept = list(rows)\n    return kept\n", None)], "path string, text string, error string")
    mined = mine_files(files, transport, retries=0, initial_wait=0.0)
    package = mined.packages.collect()
    assert [p.skill_id for p in package] == ["add-rows"] and package[0].writer == "template" and "eval" not in package[0].script_text and [a.flag for a in package[0].cli_arguments] == ["--rows-json"]
    assert mined.skipped.count() == 0 and mined.rejects.count() == 0
    assert package[0].script_text == mine_files(files).packages.first().script_text


def test_a_revision_that_keeps_the_rules_replaces_the_draft(spark):
    from oreloom.operators import extract

    def transport(body):
        import json

        text = json.loads(body)["messages"][1]["content"]
        draft = text.partition("Draft:\n")[2].partition("\n\nRequired response schema name")[0]
        if "Zebra" in draft:
            return json.dumps({"choices": [{"message": {"content": json.dumps({"instructions": "I think so."})}}]})
        return json.dumps({"choices": [{"message": {"content": json.dumps({"instructions": draft + "\n\n- Revised."})}}]})

    code = "def take(rows: list) -> list:\n    kept = list(rows)\n    return kept\n"
    files = spark.createDataFrame([("a.py", code), ("b.py", code.replace("take", "keep_me"))], "path string, text string")
    nodes = extract.python_nodes(files).withColumns({"slice_id": F.col("file_path"), "title": F.when(F.col("name") == "take", "Taker").otherwise("Zebra"), "summary": F.lit("Takes rows.")})
    plain = {r.slice_id: r for r in legacy.payloads(nodes).collect()}
    found = {r.slice_id: r for r in legacy.payloads(nodes, transport, retries=0).collect()}
    assert found["b.py"].instructions == plain["b.py"].instructions
    assert found["a.py"].instructions.strip() == plain["a.py"].instructions.strip() + "\n\n- Revised."
