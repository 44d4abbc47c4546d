"""Components against union-find: odd rows, long chains, hubs, small chunks."""

import random

import pyarrow as pa
import pytest

from oreloom.operators import components as C


def brute(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root.setdefault(a, a), root.setdefault(b, b)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def same(spark, edges, kind="string", **how):
    found = C.connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(3), **how).collect()
    want = brute(edges)
    assert len(found) == len(want) and {r.node: r.root for r in found} == want


def test_contraction_leaves_a_star():
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(7, 7), (900, 900), (901, 901), (901, 902)]
    out = C.contracted(pa.chunked_array([[a for a, _ in edges]]), pa.chunked_array([[b for _, b in edges]])).to_pylist()
    want = brute(edges)
    assert {r["a"]: r["b"] for r in out} == {n: root for n, root in want.items() if n != root or sum(x == root for x in want.values()) == 1} and len(out) == len({r["a"] for r in out})


@pytest.mark.parametrize("chunk", [2, 1_000_000])
def test_components_of_odd_edges(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    r = random.Random(2)
    names = [f"n{k}é" for k in range(120)]
    same(spark, [(r.choice(names), r.choice(names)) for _ in range(90)] + [("z", "z"), ("y", None), (None, "y"), ("n1é", "n1é"), ("", "q"), ("q", "")])
    same(spark, [(k, k + 1) for k in range(400)] + [(9000, 9000)], "long")


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 2)
    monkeypatch.setattr(C, "HUBS", 4)
    same(spark, [(f"a{k % 3}", f"b{k}") for k in range(300)] + [(f"b{k}", f"c{k}") for k in range(0, 300, 7)], hub=20)


def test_no_edges(spark):
    same(spark, [])
    same(spark, [(None, None)])


def test_edges_shrink_with_every_round(spark, monkeypatch):
    """nodes go to neighbours, so a round's edges are a part of the last one's; stars kept as many as there were nodes."""
    sizes, count = [], C._picked
    monkeypatch.setattr(C, "CHUNK", 50)
    monkeypatch.setattr(C, "_picked", lambda edges, salt: sizes.append(edges.count()) or count(edges, salt))
    r = random.Random(5)
    same(spark, [(f"p{r.randrange(60)}", f"s{k // 4}") for k in range(1600)])
    assert len(sizes) > 1 and sum(sizes) < 3 * sizes[0], sizes
