"""A model's answers stay in the row that asked: no joins, the rules of the expressions, the same rows."""

import json
import random

from pyspark.sql import functions as F

from oreloom.operators import prompts, structured
from oreloom.operators.agent import messages, request
from oreloom.operators.validate import response_error
from oreloom.plans.mining import mine_files
from oreloom.plans.storage import materialise


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _chat(content) -> str:
    return json.dumps({"choices": [{"message": {"content": content}}]})


def test_answers_are_not_joined_to_their_rows(spark, monkeypatch):
    """each model step shuffled all rows to meet their answers, and wrote the answers twice."""
    from oreloom.plans import mining

    seen, plain = {}, materialise
    monkeypatch.setattr(mining, "materialise", lambda df, tag, *more: seen.setdefault(tag, _plan(df)) and plain(df, tag, *more))
    files = spark.createDataFrame([("a.py", "def take(rows: list) -> list:\n    kept = list(rows)\n    return kept\n", None)], "path string, text string, error string")

    def transport(body):
        raise ConnectionError

    assert mine_files(files, transport, retries=0).packages.count() == 1
    assert set(seen) == {"nodes", "decisions", "scripts", "checked", "manuals"}
    assert not any("node_id#" in line for tag in ("decisions", "scripts", "checked", "manuals") for line in seen[tag].splitlines() if "Join" in line)


def test_faults_are_those_of_the_expressions(spark, table):
    r = random.Random(5)
    pick = lambda *x: r.choice(x)
    responses = ["no JSON", "", "[]", "{}", '{"choices":[]}', '{"choices":{}}', '{"choices":[{}]}', '{"choices":[{"message":{}}]}', '{"choices":[{"message":{"content":null}}]}', '{"choices":[{"message":{"content":{"decision":"skip","reason":"r"}}}]}']
    responses += [_chat(c) for c in ("", " \n", "x", "[1]", "3", "null", '{"decision":NaN,"reason":"r"}', '{"a":1,"decision":"skip","B":2}', '{"decision":"a","decision":"b","reason":"r"}', "{'decision':'a','reason':'r'}")]
    for _ in range(150):
        said = {n: pick("a", "é ", None, 1, 2.5, True, ["x"], {"k": 1}, []) if r.random() < 0.2 else {"string": "a", "array": ["x"], "number": pick(1, 0.5)}[k.rstrip("?")] for n, k in structured.DECISION.items() if r.random() < 0.9}
        responses.append(_chat(json.dumps(said, ensure_ascii=pick(True, False))))
    rows = table(list(enumerate(responses)), "i int, response string")
    content = F.get_json_object("response", "$.choices[0].message.content")
    fault = F.coalesce(response_error("response", tuple(structured.DECISION)), structured.schema_error(content, structured.DECISION))
    want = {x.i: (x.content, x.fault) for x in rows.select("i", content.alias("content"), fault.alias("fault")).collect()}
    assert {i: structured.answer_fault(t, structured.DECISION) for i, t in enumerate(responses)} == want and sum(f is None for _, f in want.values()) > 20
    # Spark's parser leaves what follows the object unread, the reference's doesn't
    assert structured.answer_fault(_chat('{"decision":"skip","reason":"r"} x'), structured.DECISION)[1] == "chat completion content was not strict JSON"


def test_requests_are_those_of_the_expressions(spark, table):
    texts = [" a ", '"q" \\ \n\t  é', "\x1c x", "y" * 5000]
    rows = table(list(enumerate(texts)), "i int, t string")
    body = F.to_json(F.struct(messages(F.col("t"), F.lit("N"), F.lit("{}")).alias("messages"), F.lit(False).alias("stream")))
    got = {x.i: x for x in rows.select("i", body.alias("b"), prompts.repair(F.col("t"), F.col("t"), F.lit("{}")).alias("r")).collect()}
    for i, t in enumerate(texts):
        assert json.loads(request(t, "N", "{}")) == json.loads(got[i].b) and prompts.repair_text(t, t, "{}") == got[i].r


def test_script_answers_that_cannot_be_packaged():
    own = {"name": "rows", "flag": "--rows", "value_type": "json", "required": True, "help": "Rows."}
    fault = structured.script_answer_fault
    assert fault({"script_text": "x"}) is None and fault({"cli_arguments": [own], "filename": "a.py"}) is None and fault({"cli_arguments": None}) is None
    assert fault({"cli_arguments": [own, own | {"flag": "rows"}]}) == "cli_arguments: flags must start with --" == fault({"cli_arguments": [{}]})
    assert fault({"cli_arguments": [own | {"help": ""}]}) == "cli_arguments: name and help must be non-empty"
    assert fault({"cli_arguments": [own | {"value_type": "text"}]}) == "cli_arguments: value_type must be one of str, int, float, bool, json"
    assert all(fault({"filename": name}) == "filename must be a safe single-file Python script" for name in ("a/b.py", "a.sh", "a.py\n", ""))


def test_a_template_that_breaks_a_field_rule_gives_way_to_the_models_script(spark):
    """Its own reject stays; where the model's fails as well nothing is packaged."""
    core = "def core_function(rows: list) -> list:\n    return rows\n\n\ndef main() -> None:\n    {}\n"

    def transport(body):
        text = json.loads(body)["messages"][1]["content"]
        if "Write one Python script" not in text:
            raise ConnectionError
        bad = "eval('1')" if "Node: b" in text else "pass"
        return json.dumps({"choices": [{"message": {"content": json.dumps({"script_text": core.format(bad), "filename": "own.py", "example_command": "python scripts/own.py"})}}]})

    files = spark.createDataFrame([(f"{n}.py", f"def {n}{'_x' * 60}(rows: list) -> list:\n    kept = list(rows)\n    return kept\n", None) for n in "ab"], "path string, text string, error string")
    mined = mine_files(files, transport, retries=0)
    # of names of over 64 letters the id is cut, the file name goes with it
    found = {p.file_path: (p.writer, p.filename) for p in mined.packages.collect()}
    assert found["a.py"] == ("model", "own.py") and mined.decisions.count() == 2
    assert found.get("b.py", ("template",))[0] == "template" and ("b.py" in found) == (mined.rejects.count() == 0)


def test_a_table_is_read_by_several_tasks_a_core(spark, tmp_path):
    wide = spark.range(400_000).selectExpr("id", "sha2(cast(id as string), 512) as a").repartition(24)
    wide.write.parquet(f"{tmp_path}/wide")
    plain, fine = (materialise(spark.read.parquet(f"{tmp_path}/wide"), "t", rounds) for rounds in (None, 4))
    parts = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert parts(plain) < parts(fine) and fine.count() == 400_000 and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_sources_that_differ_in_a_functions_name_are_parsed_once(monkeypatch):
    """every event's file was parsed though only the name differs; where more differs, or may, it still is."""
    from oreloom.operators import extract

    seen, parse = [], extract.ast.parse
    monkeypatch.setattr(extract.ast, "parse", lambda text, *more: seen.append(text) or parse(text, *more))
    one = 'def {0}(rows: list, n: int = 3) -> list:\n    """Keep."""\n    return {1}(rows)[:n]\n'
    shapes = [
        one, "\n" + one, one.replace('"""Keep."""', "x = 1"), one + "import os\n", one + "def more():\n    pass\n", "def {0}(a, b=(1,\n 2)): '''é''' ; return a", "def {0}(a): 'd'; return a  # end",
        one + "\n\nclass A:\n    def f(self): pass\n", "async " + one, one.replace("return", "def inner(x): return x\n    return"), "def {0}(a):\r\n    'd'\r\n    return é\r\n",
    ]
    for shape in shapes:
        facts = extract._Facts()
        for name in ("take", "take_rows_2", "t", "{0}x".format("y" * 70)):
            text = shape.format(name, "sorted")
            assert extract.python_functions(text, f"{name}.py", None, facts) == extract.python_functions(text, f"{name}.py"), text
    facts = extract._Facts()
    seen.clear()
    for k in range(50):
        extract.python_functions(one.format(f"take_{k}", "sorted"), "p", None, facts)
    assert len(seen) == 2  # the file, and its function for its facts
    for bad in ("if", "None"):
        try:
            extract.python_functions(one.format(bad, "sorted"), "p", None, facts)
            raise AssertionError(bad)
        except SyntaxError:
            pass
