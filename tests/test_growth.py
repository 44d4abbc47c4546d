"""What keeps work in step with the input: bounded tasks, texts parsed once, inputs read once."""

from pyspark.sql import functions as F

from oreloom.functions import text
from oreloom.operators import agent, bundle, dependencies, extract, structured, validate
from oreloom.plans.storage import spread
from oreloom.queries import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _events(spark, tmp_path, n):
    rows = [(i, "a-b", i % 60, "{\"k\":1}") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_tasks_grow_in_number_and_not_in_rows(spark, tmp_path):
    spark.range(100_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spread(spark.read.parquet(f"{tmp_path}/t"), 10_000)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 11_000 and sum(sizes) == 100_000


def test_queries_of_rules_leave_one_task(spark, tmp_path):
    at = _events(spark, tmp_path, 40)
    for name in ("payload_rules", "instruction_rules", "partial_functions"):
        assert QUERIES[name](spark, at).rdd.getNumPartitions() >= 4, name


def test_copies_of_a_text_are_parsed_once_and_differ_in_id_and_path(spark, table, tmp_path):
    log = f"{tmp_path}/parsed"
    source = "def f(x):\n    return x\n"

    def counting(source, path):
        with open(log, "a") as file:
            file.write("x")
        return extract.python_functions(source, path)

    files = table([(f"d/{i}.py", source if i % 2 else "def (") for i in range(400)], "path string, text string").coalesce(1)
    got = extract._parsed(files, counting).collect()
    with open(log) as file:
        assert len(file.read()) == 2
    want = {f"d/{i}.py": extract.python_functions(source, f"d/{i}.py")[0]["node_id"] if i % 2 else None for i in range(400)}
    assert {r.file_path: r.node_id for r in got} == want and sum(r.error is not None for r in got) == 200


def test_more_texts_than_the_pool_holds(spark, table, monkeypatch):
    monkeypatch.setattr(extract, "POOL", 3)
    files = table([(f"d/{i}.py", f"def f{i % 9}(x):\n    return x\n") for i in range(60)], "path string, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = extract.python_nodes(files).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.file_path, r.name) for r in got) == sorted((f"d/{i}.py", f"f{i % 9}") for i in range(60))


def test_findings_read_nodes_a_fixed_number_of_times(spark, table):
    code = "def f():\n    eval('1')\n    requests.get(1)\n    requests.delete(2, timeout=1)\n"
    java = "class A { void f() { System.exit(1);\n\nSystem.exit(2); } }"
    nodes = extract.python_nodes(table([("a.py", code)], "path string, text string")).unionByName(extract.java_nodes(table([("A.java", java)], "path string, text string")))
    nodes = table([tuple(r) for r in nodes.collect()], nodes.schema)
    found = bundle.findings(nodes)
    assert _plan(found).count("Relation") <= 3
    assert sorted((r.rule_id, r.line) for r in found.collect()) == [("java-system-exit", 1), ("java-system-exit", 3), ("python-eval", 2), ("python-http-delete", 4), ("python-http-timeout", 3)]


def test_texts_are_stripped_and_cut_as_python_does(spark, table):
    texts = ["", " 　a b\x1c", "a\r\nb\rc\n", "\x85x\xa0", "\n", "x\x0c\n\n", " é  ", "a​ "]
    got = table([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.strip("t").alias("s"), text.rstrip("t").alias("r"), text.lines("t").alias("l")).collect()
    assert {r.i: (r.s, r.r, r.l) for r in got} == {i: (t.strip(), t.rstrip(), t.splitlines()) for i, t in enumerate(texts)}


def test_a_value_is_computed_once_in_rules(spark):
    """Each parse, cut and lower-casing stands once in an expression; copies would cost a parse for every rule."""
    times = lambda column, what: str(column._jc if hasattr(column, "_jc") else column).count(what)
    c = F.col("c")
    assert times(agent.named_arguments("c"), "from_json") == 1
    assert times(structured.schema_error("c", structured.DECISION), "from_json") == 1
    assert times(dependencies.coupling(c, c), "lower(") == 2
    assert times(validate.document_error("c"), "trim(TRIM") <= 9 and times(validate.java_findings("c"), "trim") == 1 and times(validate.generic_findings("c"), "trim") == 1


def test_a_document_is_read_once_for_all_its_rules(spark, table):
    """F8: rules over documents were some twenty text expressions, each a pass over the text."""
    import random

    shown = str(validate.document_error("c")._jc if hasattr(validate.document_error("c"), "_jc") else validate.document_error("c"))
    assert "trim" not in shown.lower() and "replace" not in shown.lower()
    r = random.Random(8)
    pieces = ["## Output", " ## Output ", "## Output x", "## Scripts", "##", "", "a", "\x1fb", "## Quick start\x0c1. x", "c\r", "\x85", "1. y", "# T"]
    texts = ["\n".join(r.choices(pieces, k=r.randrange(9))) for _ in range(300)]
    rows = table(list(enumerate(texts)), "i int, t string")
    for heading in ("## Output", "## Scripts"):
        want = rows.select("i", F.transform(validate.section("t", heading), text.strip).alias("s")).collect()
        assert {x.i: x.s for x in want} == {i: validate._under([line.strip() for line in t.splitlines()], heading) for i, t in enumerate(texts)}


def test_nodes_stay_where_they_are_for_their_imports(spark, table):
    """nodes with all their columns were shuffled and sorted to meet their imports."""
    lists = [["import os", "import a", "import numpy", "import os"], [], ["from a import b"], ["import os", "import a", "import numpy", "import os"], ["import java.util"]]
    nodes = table([(f"n{i}", "java" if i == 4 else "python", x, "code") for i, x in enumerate(lists)], "node_id string, language string, imports array<string>, raw_code string")
    out = dependencies.with_dependencies(nodes, table([("a.py",), ("x/y/numpy.py",)], "path string"))
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString() and out.columns[:4] == nodes.columns
    got = {r.node_id: (r.stdlib_imports, r.internal_imports, r.pip_imports) for r in out.collect()}
    first = (["import os"], ["import a"], ["import numpy"])
    assert got == {"n0": first, "n1": ([], [], []), "n2": ([], ["from a import b"], []), "n3": first, "n4": ([], [], ["import java.util"])}


def test_files_are_parsed_once_for_a_models_decisions(spark, tmp_path, monkeypatch):
    """nodes were parsed for their imports and again for the decisions."""
    seen, plain = [], dependencies.with_dependencies
    monkeypatch.setattr(dependencies, "with_dependencies", lambda nodes, paths: seen.append(_plan(nodes)) or plain(nodes, paths))
    assert QUERIES["model_decisions"](spark, _events(spark, tmp_path, 10)).count() == 10
    assert seen and "MapInArrow" not in seen[0]
