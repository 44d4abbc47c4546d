"""Codes against all distances in whole numbers, the tree against brute force, and odd tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oreloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _salt int, error long, part int"


def brute(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """(vec_id, code, error, label_error) of (vec_id, vector, label) rows, and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    x = [[int(np.floor(256 * float(v))) for v in r[1]] for r in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[list(cut[i][p]) for i in [i for i, r in enumerate(rows) if r[0] is not None][:entries]] for p in range(parts)]
    away = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    def nearest(p, v):
        return min((away(v, c), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut[i][p] for i in range(len(cut)) if found[i][p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = [], {}
    for r, v in zip(rows, cut, strict=True):
        got = [nearest(p, v[p]) for p in range(parts)]
        error = sum(d for d, _ in got)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{k:02x}" for _, k in got), error, r[2]))
    return [(i, c, e, by_label[label]) for i, c, e, label in out], np.array(books)


def same(found, rows):
    want, books = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in found], key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in found} == {V.digest(books)}


def put(table, rows):
    return table([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, 2, 3) for i, v, label in rows], SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=60), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=30), st.integers(1, 9))
def test_tree_finds_the_first_nearest_entry_among_many_ties(entries, queries, leaf):
    entries, queries = np.array(entries, np.int64), np.array(queries, np.int64)
    at, best = V.VantageTree(entries, leaf).nearest(queries)
    away = ((queries[:, None, :] - entries) ** 2).sum(axis=2)
    assert at.tolist() == away.argmin(axis=1).tolist() and best.tolist() == away.min(axis=1).tolist()


@pytest.mark.parametrize("size", [1, 1000, 2**26])
def test_tree_on_distances_that_square_roots_round(size):
    rng = np.random.default_rng(size)
    entries, queries = rng.integers(-size, size + 1, (64, 4)), rng.integers(-size, size + 1, (3000, 4))
    at, best = V.VantageTree(entries).nearest(queries)
    away = ((queries[:, None, :] - entries) ** 2).sum(axis=2)
    assert (at == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()


def test_tree_leaves_most_entries_out():
    rng = np.random.default_rng(3)
    entries = rng.normal(0, 300, (64, 4)).astype(np.int64)
    tree, seen = V.VantageTree(entries), []
    tree.entries = type("Seen", (), {"__getitem__": lambda s, own: (seen.append(len(own)), entries[own])[1]})()
    for q in entries[:40] + 3:
        tree.nearest(q[None])
    assert sum(seen) < 40 * 32


def test_codes_equal_brute_force(table):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=32).astype(np.float32), int(label)) for i, label in zip(rng.permutation(700), rng.integers(0, 5, 700))]
    same(V.op11(put(table, rows)).collect(), rows)


def test_odd_vectors_labels_and_ids(table):
    rng = np.random.default_rng(2)
    vector = lambda: rng.integers(-2, 3, 16).astype(np.float32)
    good = [(k // 2, vector(), None if k % 3 == 0 else k % 4) for k in range(150)] + [(None, vector(), 1), (900, np.full(16, 1e4, np.float32), None), (901, vector() * 0, 2), (901, vector() * 0, 2)]
    bad = [(5, None, 1), (-7, [1.0] * 15 + [None], 1), (-6, [1.0] * 15 + [float("nan")], 1), (-5, [1.0] * 15 + [float("inf")], 1), (-4, [], 1), (-3, [1.0] * 7, 1), (902, [1.0] * 32, 1), (903, [1e30] * 16, 1)]
    same(V.op11(put(table, good + bad)).collect(), good)


def test_few_vectors_and_none(table):
    rows = [(k, np.arange(16) * 0.5 * k, None) for k in (3, 1, 2)]
    found = V.op11(put(table, rows)).collect()
    same(found, rows)
    assert {r.error for r in found} == {0}
    for empty in ([], [(None, [1.0] * 16, 1)], [(1, None, 1)]):
        got = V.op11(put(table, empty))
        assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_labels_beyond_what_is_broadcast(table, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=16), k // 3 or None) for k in range(120)] + [(500 + k, rng.normal(size=16), 7) for k in range(60)]
    monkeypatch.setattr(V, "BROADCAST_LABELS", 5)
    same(V.op11(put(table, rows)).collect(), rows)
