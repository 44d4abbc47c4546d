"""Recall on vectors without structure, and on the shapes a table may have."""

import numpy as np

from oreloom.llm import kmeans_tree

VECTORS = "vec_id long, embedding array<float>, rank int, score double"


def recall_of(found, ids, x, queries, k=10):
    hits = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[ids == ids[q]] = np.inf
        want = set(ids[np.lexsort((ids, d))[:k]].tolist())
        got = sorted((r for r in found if r.query_id == ids[q]), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, k + 1)) and [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        assert all(abs(r.score - d[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in got)
        hits += len(want & {r.vec_id for r in got})
    return hits / (k * len(queries))


def test_recall_without_structure(table):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10_000, 24)).astype(np.float32)
    ids = np.arange(10_000)
    rows = [(int(i), [float(v) for v in r], 1, 0.5) for i, r in zip(ids, x)]
    found = kmeans_tree.op4(table(rows, VECTORS)).collect()
    assert len(found) == 1000 and recall_of(found, ids, x.astype(np.float64), range(0, 10_000, 100)) >= 0.93


def test_large_values_keep_exact_order(table):
    """Far from the origin products of matrices round; what is returned doesn't."""
    rng = np.random.default_rng(7)
    x = (1e5 + rng.normal(size=(600, 6))).astype(np.float32)
    rows = [(int(i), [float(v) for v in r], 1, 0.5) for i, r in enumerate(x)]
    found = kmeans_tree.search(table(rows, VECTORS), kmeans_tree.F.col("vec_id") % 100 == 0, recall=1.0).collect()
    assert recall_of(found, np.arange(600), x.astype(np.float64), range(0, 600, 100)) >= 0.99
