"""The registry log, skill folders by commit, and the bucket in event time."""

import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oreloom.operators.registry import upsert
from oreloom.plans import skill_folders
from oreloom.streaming.arrivals import due, token_bucket_events
from oreloom.streaming.limits import token_bucket
from oreloom.streaming.registry_log import RegistryLog, registry_log_stream


def size_of(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_a_small_batch_writes_little_and_reading_equals_upsert(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = RegistryLog(spark, path)
    first = spark.range(200_000).select(F.format_string("k%09d", "id").alias("skill_id"), F.rand(1).alias("v"), F.lit(0).alias("seq"))
    log.append(first, 0)
    assert log.in_force() == (0, [])
    before = size_of(path)
    new = spark.createDataFrame([("k000000007", 1.5, 2), ("k000000007", 2.5, 3), ("new", 3.0, 1), (None, 1.0, 1)], "skill_id string, v double, seq int")
    log.append(new, 1)
    assert log.in_force() == (0, [1]) and size_of(path) - before < 0.01 * before
    want = {tuple(r) for r in upsert(first.select("skill_id", "v"), new.where("skill_id is not null")).collect()}
    assert {(r.skill_id, r.v) for r in log.read().collect()} == want
    assert log.lookup("k000000007").first().v == 2.5 and log.lookup("k000000008").count() == 1 and log.lookup("none").count() == 0
    log.fold()
    assert log.in_force() == (1, []) and {(r.skill_id, r.v) for r in log.read().collect()} == want


def test_many_batches_with_a_failed_one(spark, tmp_path):
    r, path, want = random.Random(4), f"{tmp_path}/log", {}
    log = RegistryLog(spark, path)
    assert log.read() is None and log.lookup("a") is None
    for number in range(7):
        rows = [(f"k{r.randrange(30)}", number * 100 + k, k) for k in range(r.choice([0, 1, 6, 20]))]
        frame = spark.createDataFrame(rows, "skill_id string, v int, seq int")
        log.append(frame, number)
        if number == 3:  # a batch that is run again, and one that broke off
            log.append(frame, number)
            (Path(path) / "delta-99").mkdir()
            (Path(path) / "delta-99" / "part-0.parquet").write_bytes(b"half")
        want |= {k: v for k, v, _ in rows}
        assert {x.skill_id: x.v for x in log.read().collect()} == want
    assert any(kind == "base" for kind, _ in log.folders())


def test_a_stream_of_entries(spark, tmp_path):
    schema = "skill_id string, v int, seq long"
    for rows in ([("a", 1, 1), ("b", 1, 2)], [("a", 2, 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        registry_log_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/r", f"{tmp_path}/c").awaitTermination(120)
    assert {(r.skill_id, r.v) for r in RegistryLog(spark, f"{tmp_path}/r").read().collect()} == {("a", 2), ("b", 1)}


def skills(spark, names, bad=None):
    rows = spark.createDataFrame([(n, f"{n}.py", f"# {n}\n", f"# {n} é\n") for n in names], "skill_id string, filename string, script_text string, skill_md string").repartition(3)
    return rows.withColumn("skill_md", F.when(F.col("skill_id") == bad, F.raise_error(F.lit("broken row"))).otherwise(F.col("skill_md"))) if bad else rows


def put(spark, rows, target, replace=False):
    spark.dataSource.register(skill_folders.SkillFolders)
    rows.write.format("oreloom_skills").option("replace", str(replace).lower()).mode("append").save(target)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_folders_appear_together(spark, tmp_path, scheme):
    target = tmp_path / "out"
    put(spark, skills(spark, ["a", "b", "c"]), scheme + str(target))
    files = sorted(str(p.relative_to(target)) for p in target.rglob("*") if p.is_file())
    assert files == ["a/SKILL.md", "a/scripts/a.py", "b/SKILL.md", "b/scripts/b.py", "c/SKILL.md", "c/scripts/c.py"] and (target / "b" / "SKILL.md").read_text(encoding="utf-8") == "# b é\n"
    assert [p.name for p in sorted(target.iterdir())] == ["a", "b", "c"]
    with pytest.raises(Exception, match="FileExistsError"):
        put(spark, skills(spark, ["d", "b"]), scheme + str(target))
    assert [p.name for p in sorted(target.iterdir())] == ["a", "b", "c"]
    put(spark, skills(spark, ["d", "b"]), scheme + str(target), replace=True)
    assert [p.name for p in sorted(target.iterdir())] == ["a", "b", "c", "d"]


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    target = tmp_path / "out"
    put(spark, skills(spark, ["a"]), str(target))
    with pytest.raises(Exception, match="broken row"):
        put(spark, skills(spark, [f"s{k}" for k in range(30)], bad="s7"), str(target), replace=True)
    assert [p.name for p in target.iterdir()] == ["a"]


def test_a_move_that_fails_brings_old_folders_back(tmp_path, monkeypatch):
    writer = skill_folders.FolderWriter({"path": str(tmp_path), "replace": "true"}, ["skill_id", "filename", "script_text", "skill_md"])
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text("old")
    message = writer.write(iter([(n, "x.py", "x", "new") for n in ("a", "b", "c")]))
    real = skill_folders.file_system(str(tmp_path))[0]

    class Failing:
        def __getattr__(self, name):
            return getattr(real, name)

        def move(self, source, target):
            if target.endswith("/c"):
                raise OSError("no")
            real.move(source, target)

    monkeypatch.setattr(writer, "_system", lambda: (Failing(), str(tmp_path)))
    with pytest.raises(OSError):
        writer.commit([message, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"] and {(tmp_path / n / "SKILL.md").read_text() for n in ("a", "b")} == {"old"}


def test_late_requests_get_what_the_batch_form_grants(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        r = random.Random(8)
        rows = [("c" if k % 3 else "d", k, 1000.0 + r.randrange(0, 2400) / 8, r.choice([1.0, 1.0, 2.0, 9.0, 0.0])) for k in range(60)]
        schema = "client string, request_id long, arrival double, tokens double"
        batches = [[], [], []]
        for row in rows:  # up to five minutes late
            batches[min(2, int((row[2] - 1000) // 100 + r.choice([0, 0, 1, 2])))].append(row)
        batches += [[("z", 900, 20_000.0, 1.0)], [("z", 901, 20_001.0, 1.0)], [("z", 902, 40_000.0, 1.0)]]
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = token_bucket_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3.0, "10 minutes")
            q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            q.awaitTermination(300)
        got = {x.request_id: x for x in spark.read.parquet(f"{tmp_path}/out").collect()}
        want = {x.request_id: x for x in token_bucket(spark.createDataFrame(rows, schema), 3.0).collect()}
        assert set(want) <= set(got)
        for k, x in want.items():
            assert got[k].error == x.error and (x.granted is None or abs(got[k].granted - x.granted) < 1e-6), k
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def test_due_is_never_early():
    assert due(1.0) == 1000 and due(1.0000001) == 1001 and isinstance(pd.Series([due(0.5)])[0], object)
