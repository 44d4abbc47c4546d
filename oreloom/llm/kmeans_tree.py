"""Approximate nearest neighbours by a hierarchical k-means tree.

Method: k-means splits a bounded sample again and again into a tree; every row descends to
a leaf.  A query walks the tree best bin first: a priority queue holds the unopened
children by the distance of their centre, and the leaves it reaches in turn are visited.
How many leaves is calibrated: for ``CALIBRATION`` rows the true neighbours among all rows
are known, and visits widen until they would find ``RECALL`` of them.  Vectors without
structure take visits to a large share of the leaves; that share is what the method costs.

Bounds: the tree is fitted on at most ``SAMPLE_FLOATS`` numbers, so it and everything sent
to all executors (tree, calibration vectors, rows per leaf) is bounded; rows are not.
Neighbouring leaves are searched as one group; groups of many rows are dealt into blocks
and groups of many queries into parts, so no task grows with the data.  Each query gets at
most k rows from a block.

Distances are Euclidean, in double precision on the original vectors; ties go to the
smaller vec_id.  In a group they are first taken from products of matrices, and exactly
for those that rounding leaves a chance to be among the k nearest.  The row that is the query is left out by its vec_id.

Defined cases: rows with a null vec_id, or a vector that is null, empty, zero, of another
length than the most frequent one of all rows, or that holds null or non-finite numbers
take no part; repeated vectors are separate candidates; repeated vec_ids are separate
rows with the same id, none of which is its own query's neighbour; fewer candidates than k
give them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise

K = 10
SAMPLE_FLOATS = 8_000_000
SAMPLE_ROWS = 60_000
BRANCHES = 8
LEAF_ROWS = 128
CALIBRATION = 300
RECALL = 0.96
#: Rows of a group, and queries of a group, that one task compares at once.
BLOCK, PART = 4096, 4096
SEED = 11


@dataclass
class Tree:
    """Nodes by number: the children's numbers and centres; leaves are numbered apart."""

    children: list[np.ndarray]
    centres: list[np.ndarray]
    leaf: list[int]
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by always the nearest centre."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                nearest = _squares(x[rows], self.centres[node]).argmin(axis=1)
                todo += [(int(child), rows[nearest == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            far = ((self.centres[node] - q) ** 2).sum(axis=1)
            for distance, child in zip(far.tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (distance, child))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1) - 2 * (x @ centres.T)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Up to k distinct centres; one if all rows are equal."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        own = _squares(x, centres).argmin(axis=1)
        used = np.unique(own)
        centres = np.stack([x[own == i].mean(axis=0) for i in used])
    return centres


def grow(sample: np.ndarray, leaf_sample: float, branches: int = BRANCHES) -> Tree:
    """Tree over a sample; nodes of at most ``leaf_sample`` rows, or of equal rows, are leaves."""
    rng = np.random.default_rng(SEED)
    tree = Tree([np.zeros(0, np.int64)], [np.zeros((0, sample.shape[1]))], [-1], 0)
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        part = sample[rows]
        if len(rows) > max(leaf_sample, 1):
            centres = _kmeans(part, branches, rng)
            own = _squares(part, centres).argmin(axis=1)
            if len(np.unique(own)) > 1:
                first = len(tree.leaf)
                tree.children[node], tree.centres[node] = np.arange(first, first + len(centres)), centres
                for i in range(len(centres)):
                    tree.children.append(np.zeros(0, np.int64))
                    tree.centres.append(np.zeros((0, sample.shape[1])))
                    tree.leaf.append(-1)
                    todo.append((first + i, rows[own == i]))
                continue
        tree.leaf[node] = tree.leaves
        tree.leaves += 1
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, v in doubles."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _hashed(n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("vec_id"), F.lit(n)), F.lit(1 << 30))


def _nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least by (distance, id)."""
    if len(ids) > 4 * k:
        some = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], distance[some]))[:k]]


def _starts(held: np.ndarray, most: int) -> np.ndarray:
    """1 where a new group of neighbouring leaves starts: groups hold ``most`` rows, or one leaf."""
    out, total = np.zeros(len(held), np.int64), most
    for i, n in enumerate(held.tolist()):
        if total + n > most:
            out[i], total = 1, 0
        total += n
    out[:1] = 1
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _calibrate(indexed: DataFrame, tree: Tree, width: int, rows: int, k: int, recall: float) -> int:
    """Leaf visits that find ``recall`` of the true neighbours of a bounded set of rows."""
    chosen = indexed.where(_hashed(2) < max(1, CALIBRATION * (1 << 30) // rows)).select("vec_id", "v").limit(2 * CALIBRATION).toArrow()
    if not len(chosen):
        chosen = indexed.select("vec_id", "v").limit(CALIBRATION).toArrow()
    ids, queries = chosen["vec_id"].to_numpy(), _matrix(chosen["v"].combine_chunks(), width)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, own, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)
            out = []
            for query_id, q in zip(ids.tolist(), queries, strict=True):
                distance = np.sqrt(((x - q) ** 2).sum(axis=1))
                distance[own == query_id] = np.inf
                best = _nearest(distance, own, k)
                out += [(query_id, int(own[i]), float(distance[i]), int(leaf[i])) for i in best.tolist() if np.isfinite(distance[i])]
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "vec_id", "score", "leaf"), r, strict=True)) for r in out], schema=schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int64())])
    best = _top(indexed.select("leaf", "vec_id", "v").mapInArrow(truth, "query_id long, vec_id long, score double, leaf long"), k)
    wanted: dict[int, list[int]] = {}
    for row in best.select("query_id", "leaf").collect():  # k rows a calibration query
        wanted.setdefault(row[0], []).append(row[1])
    order = {i: {leaf: n for n, leaf in enumerate(tree.visits(q))} for i, q in zip(ids.tolist(), queries, strict=True)}
    places = np.array([order[i][leaf] for i, leaves in wanted.items() for leaf in leaves])
    visits = 1
    while len(places) and (places < visits).mean() < recall:
        visits += max(1, visits // 8)
    return visits


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where ``is_query``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return empty
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()["w"]
    rows = rows.where(F.size("v") == width)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_FLOATS // width))
    sample = rows.where(_hashed(1) <= min(1.0, most / n) * (1 << 30)).select("v").limit(2 * most).toArrow()
    if not len(sample):
        sample = rows.select("v").limit(most).toArrow()
    points = _matrix(sample["v"].combine_chunks(), width)
    tree = grow(points, LEAF_ROWS * len(points) / n)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "vec_id", "v"])

    indexed = materialise(rows.mapInArrow(index, "leaf long, vec_id long, v array<double>"), "tree")
    held = np.zeros(tree.leaves, np.int64)
    for row in indexed.groupBy("leaf").count().collect():  # a row a leaf
        held[row[0]] = row[1]
    visits = _calibrate(indexed, tree, width, n, k, recall)

    # neighbouring leaves share a group, so that a query meets a group once; a leaf that
    # fills one alone is dealt into blocks
    group = np.cumsum(_starts(held, BLOCK)) - 1
    rows_in = np.bincount(group, weights=held).astype(np.int64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups, leaves, which = batch.column(0), [], [], []
            for i, q in enumerate(_matrix(batch.column(1), width)):
                seen, candidates = [], 0
                for leaf in tree.visits(q):
                    if len(seen) >= visits and candidates > k:
                        break
                    seen.append(leaf)
                    candidates += int(held[leaf])
                seen = np.array(sorted(x for x in seen if held[x]), np.int64)
                own = np.unique(group[seen])
                groups += own.tolist()
                leaves += [seen[group[seen] == g] for g in own]
                which += [i] * len(own)
            at = pa.array(which, pa.int64())
            columns = [pa.array(groups, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), ids.take(at), batch.column(1).take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "leaves", "query_id", "q"])

    queries = indexed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    walked = materialise(queries.mapInArrow(walk, "grp long, leaves array<long>, query_id long, q array<double>"), "visits")
    asked = {row[0]: row[1] for row in walked.groupBy("grp").count().collect()}  # a row a group
    if not asked:
        return empty
    shares = [(g, max(1, -(-int(rows_in[g]) // BLOCK)), -(-count // PART)) for g, count in asked.items()]
    plan = F.broadcast(spark.createDataFrame(shares, "grp long, blocks long, parts long"))
    place = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "leaf long, grp long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = indexed.join(place, "leaf").join(plan, "grp").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    left = left.select("grp", "block", every("parts").alias("part"), "leaf", "vec_id", "v")
    right = walked.join(plan, "grp").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    right = right.select("grp", every("blocks").alias("block"), "part", "leaves", "query_id", "q")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(a) and len(b):
            ids, leaf, x = a["vec_id"].to_numpy(), a["leaf"].to_numpy(), _matrix(a["v"].combine_chunks(), width)
            visited, norms, queries = np.zeros(len(held), bool), (x**2).sum(axis=1), _matrix(b["q"].combine_chunks(), width)
            asked, leaves_of = b["query_id"].to_pylist(), b["leaves"].to_pylist()
            for at in range(0, len(asked), 64):
                some = queries[at : at + 64]
                rough = norms - 2 * (some @ x.T)
                for query_id, leaves, q, near in zip(asked[at : at + 64], leaves_of[at : at + 64], some, rough, strict=True):
                    visited[leaves] = True
                    rows = np.flatnonzero(visited[leaf] & (ids != query_id))
                    visited[leaves] = False
                    if len(rows) > 4 * k:
                        near, slack = near[rows], 1e-9 * (norms[rows].max() + (q**2).sum())
                        rows = rows[near <= np.partition(near, k - 1)[k - 1] + slack]
                    distance = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
                    best = _nearest(distance, ids[rows], k)
                    out.append((np.full(len(best), query_id), ids[rows[best]], distance[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    keys = ("grp", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 100 == 0)
