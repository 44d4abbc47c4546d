"""Connected components by contraction, within tasks and to random neighbours.

First each task contracts the edges it has: a union-find over ``CHUNK`` edges at a time leaves a
star around the least node of each piece, at most one edge a node, before anything is shuffled.
Then each node goes to the first of itself and its neighbours in an order that hashes give, another
one each round; the edges between what nodes went to are contracted in their tasks again and go on.
A node goes to itself or to one that others may share, so nodes shrink by the number of neighbours where
these are many, and by a quarter at least on average: the rounds together shuffle a few times the edges.
At last the steps are followed back and each component gets its least node.  Every step is a grouped
minimum (combined before the shuffle) and an equi-join.

Hubs: a node with over ``limit`` neighbours is joined apart, by a broadcast of the hubs' minima.
The limit is a ``HUBS``-th of the edges and ``HUB`` at least, so there are at most 2 * ``HUBS`` of
them, and no key of the other join is larger.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import bounded_rows, materialise, release

CHUNK = 1_000_000
HUB, HUBS = 1_000_000, 2_000
#: Nodes of which a step's table may be broadcast.
SMALL = 200_000


def contracted(left: pa.ChunkedArray, right: pa.ChunkedArray) -> pa.RecordBatch:
    """Edges (a, b) from every node to the least one that the given edges connect it to; that one has a loop only if it is alone."""
    coded = pa.chunked_array([*left.chunks, *right.chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[coded.indices.to_numpy()]
    x, y = codes[: len(left)], codes[len(left) :]
    label = np.arange(len(order))
    while True:
        of_x, of_y = label[x], label[y]
        apart = of_x != of_y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(of_x, of_y)[apart], np.minimum(of_x, of_y)[apart])
        while True:  # every node to its root
            further = label[label]
            if (further == label).all():
                break
            label = further
    joined = np.zeros(len(label), bool)
    joined[label[label != np.arange(len(label))]] = True
    kept = np.flatnonzero(~joined | (label != np.arange(len(label))))  # a root that others point to needs no row
    take = lambda at: coded.dictionary.take(pa.array(order[at]))
    return pa.RecordBatch.from_arrays([take(kept), take(label[kept])], ["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= CHUNK:
            table = pa.Table.from_batches(held)
            yield contracted(table["a"], table["b"])
            held, rows = [], 0
    if rows:
        table = pa.Table.from_batches(held)
        yield contracted(table["a"], table["b"])


def _with_least(rows: DataFrame, least: DataFrame, total: int, hub: int) -> DataFrame:
    """``rows`` with m of their node a in ``least`` (a, m, n); n is the node's number of edges, ``total`` that of all."""
    limit = max(hub, total // HUBS)
    if total <= limit:
        return rows.join(least, "a")
    least = least if hasattr(least, "_oreloom_path") else materialise(least, "least")
    heavy = F.broadcast(least.where(F.col("n") > limit).select(F.col("a").alias("hub"), F.col("m").alias("of_hub")))
    known = rows.join(heavy, F.col("a") == F.col("hub"), "left")
    rest = known.where("hub is null").select(*rows.columns).join(least.where(F.col("n") <= limit), "a").select(*rows.columns, "m")
    return known.where("hub is not null").select(*rows.columns, F.col("of_hub").alias("m")).unionByName(rest)


def _picked(edges: DataFrame, salt: int) -> DataFrame:
    """(a, m, n) of each node: the first of itself and its neighbours in an order of its own for each ``salt``, and its number of edges."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    place = lambda x: F.struct(F.xxhash64(F.lit(salt), x).alias("h"), F.col(x).alias("x"))
    found = both.groupBy("a").agg(F.min(place("b")).alias("first"), F.count("*").alias("n"))
    return found.select("a", F.least(place("a"), F.col("first"))["x"].alias("m"), "n")


def _rooted(steps: list[DataFrame]) -> DataFrame:
    """(b, a) of each node of the first step and what the steps, one after the other, lead it to."""
    found = None
    for step in reversed(steps):
        step = step.select(F.col("a").alias("b"), F.col("m").alias("a"))
        if found is None:
            found = step
            continue
        later = found.select(F.col("b").alias("a"), F.col("a").alias("_to"))
        later = F.broadcast(later) if bounded_rows(later, SMALL) is not None else later
        found = materialise(step.join(later, "a", "left").select("b", F.coalesce("_to", "a").alias("a")), "led")
    return found


def connected_components(edges: DataFrame, rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, root) of each node of ``edges`` (columns a, b of one orderable type).

    ``root`` is the least node of the component.  Self-loops give a component of their
    own node, rows with a null end are dropped, direction and repeats don't matter.
    """
    edges = edges.select("a", "b")
    schema = edges.schema
    loops = F.col("a") == F.col("b")
    # a node with nothing but a loop keeps it: without an edge it would leave no row
    halves = edges.where("a is not null and b is not null").mapInArrow(_contract, schema)
    first = materialise(halves, "edges")
    alone = materialise(first.where(loops).select(F.col("a").alias("node")).distinct(), "alone")
    last, now, steps = first, first.where(~loops), []
    for salt in range(rounds):
        total = now.count()
        if not total:
            break
        picked = materialise(_picked(now, salt), "picked")
        steps.append(picked)
        moved = _with_least(now, picked, total, hub).select(F.col("m").alias("b"), F.col("b").alias("a"))
        moved = _with_least(moved, picked, total, hub).select(F.col("m").alias("a"), "b").where(~loops)
        now = materialise(moved.mapInArrow(_contract, schema), "edges")
        release(last)
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not steps:
        return alone.select("node", F.col("node").alias("root"))
    found = _rooted(steps)
    least = found.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    found = _with_least(found, least, steps[0].count(), hub).select(F.col("b").alias("node"), F.col("m").alias("root"))
    lonely = alone.join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(lonely)
