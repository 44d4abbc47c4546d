"""Queries over whole tables, against brute force on small ones."""

import random

from oreloom.queries import QUERIES, _code


def test_components_take_every_row_and_id(spark, tmp_path):
    rng = random.Random(1)
    # one component of 3,000 orders, pairs, and ids that equal each other modulo 1200 and 1100
    rows = [(k // 2 + 1, k // 2 + 1 + k % 2, k % 7 + 1) for k in range(6000)]
    rows += [(100_000 + k, 100_000 + k, 2) for k in range(300)] + [(rng.randrange(200_000, 200_400), rng.randrange(200_000, 200_400), rng.randrange(1, 8)) for _ in range(300)] + [(5, None, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for order, part, _ in rows:
        if part is not None:
            a, b = sorted((find(f"p{part}"), find(f"s{order}")))
            parent[b] = a
    got = [tuple(r) for r in QUERIES["connected_components_all"](spark, str(tmp_path)).select("node", "root").collect()]
    assert sorted(got) == sorted((x, find(x)) for x in parent)


def test_bases_of_whole_texts(spark, tmp_path):
    texts = {1: "a" * 400 + "c" * 1200, 2: "bd " * 5000 + "G", 3: "", 4: "é 12", 5: "f" * 399 + "ée"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fold = str.maketrans("bdefhijklmnopqrsuvwxyzBDEFHIJKLMNOPQRSUVWXYZ", "acgtacgtacgtacgtacgtacACGTACGTACGTACGTACGTAC")
    bases = {i: "".join(c for c in t if c.isascii() and c.isalpha()).translate(fold) for i, t in texts.items()}
    gc = {r.doc_id: r.gc for r in QUERIES["gc_content_whole"](spark, str(tmp_path)).collect()}
    assert gc == {i: sum(c in "GCgc" for c in s) / len(s) if s else 0.0 for i, s in bases.items()}
    rc = {r.doc_id: r.rc for r in QUERIES["reverse_complement_whole"](spark, str(tmp_path)).collect()}
    assert rc == {i: s.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1] for i, s in bases.items()}


def test_bucket_grants_every_event(spark, tmp_path):
    events = [(i, f"t{i % 3}", i * 7 % 11) for i in range(1, 900)]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    want, state = {}, {}
    for i, _, user in events:
        # 30 tokens at most, one in two seconds; grants follow each other
        level, at = state.get(user % 5, (30.0, 0.0))
        arrival = float(i // 40)
        now = max(at, arrival)
        level = min(30.0, level + (now - at) * 0.5)
        wait = max(0.0, 1.0 - level) / 0.5
        state[user % 5] = (max(level, 1.0) - 1.0, now + wait)
        want[i] = (str(user % 5), arrival, now + wait, now + wait - arrival, None)
    got = {r.request_id: (r.client, r.arrival, r.granted, r.wait, r.error) for r in QUERIES["token_bucket_grants"](spark, str(tmp_path)).collect()}
    assert got == want and max(w[3] for w in want.values()) > 100


def test_context_of_every_kind_of_file(spark, tmp_path):
    events = [(i, "t-x", 50 + i) for i in range(16)]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    kinds = [
        ("javascript", "JavaScript", ".js", "t-x helper second line"), ("shell", "Shell", "", "!/usr/bin/env bash cleanup of t-x"), ("python", "Python", ".PY", None), ("javascript", "JavaScript", ".mjs", None),
        ("lua", "Lua", ".lua", "query for flask t-x"), ("generic", "Generic Source", ".zz", None), ("csharp", "C#", ".cs", "note"), ("java", "Java", ".java", None),
    ]
    texts = {r.path: r.text for r in _code(spark, str(tmp_path)).collect()}
    got = {r.file_path: r.context for r in QUERIES["llm_context_render_all"](spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) and len(got) == 16
    for i, _, user in events:
        language, display, suffix, comment = kinds[i % 8]
        stem = f"t_x_{user % 50}_{i}"
        path = next(p for p in texts if p.endswith(f"{stem}{suffix}"))
        text = texts[path]
        file = path.rsplit("/", 1)[-1]
        name = file.removesuffix(suffix) if suffix else file
        lines = [f"Node: {name}", f"Language: {language}", "Type: file", f"Signature: {display} source file {file}", f"Lines: 1-{text.count(chr(10)) + 1}", f"Bytes: 0-{len(text.encode())}", f"File: {path}"]
        lines += [f"Docstring: {comment}"] if comment else []
        assert got[path] == "\n".join([*lines, f"```{language}", text, "```"])
