"""Vector compression: each part of a vector becomes the index of its codebook's nearest entry.

Components become integers (``floor(SCALE * x)``), so every distance, sum and mean below is
exact.  A codebook per part position starts at that part of the vectors with the smallest
ids and is refined by rounds of assignment and componentwise floor means.

Nearest entries come from a vantage-point tree per part position.  A node holds an entry,
its vantage point, and two children with the least and the largest distance of their
entries to it; the triangle inequality then bounds from below how near a child's entries
can be.  Radii are whole numbers, rounded down and up by more than a square root can be off;
a child is visited unless its bound *exceeds* the best distance so far, as an equal one
may hold a lower index; and every entry that is met is measured in integers.  So the tree
gives what all comparisons would.  Many vectors walk a tree at once, in two groups a node:
those nearer to the inner child, and the others.

Per round one scan, sums of a task before anything is shuffled, and ``entries`` times the
vector's length rows to the driver.  Codebooks travel to tasks with the function.

Defined cases: vectors that are null or hold a null or non-finite component are dropped.  The
length of the rest is that of the smallest vec_id among those whose length is a multiple of
``parts`` and not zero; vectors of another length can't be cut alike and are dropped, as are
components so large (``largest``) that a squared distance might not fit 64 bits.  A null
vec_id is coded but opens no codebook; rows that repeat a vec_id count each, in the order of
their vectors; if no vec_id is left there are no codebooks and no rows; fewer vectors than
entries make smaller codebooks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import bounded_rows, materialise
from .rows import released

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Entries that are measured without further branching.
LEAF = 8
#: Vectors that walk the trees together.
TOGETHER = 8192
#: Labels whose sums may be broadcast; beyond, the sums are joined on salted labels.
BROADCAST_LABELS = 100_000
SALTS = 16

_FAR = np.iinfo(np.int64).max


class VantageTree:
    """Exact nearest entries of one part position; entries are the rows of an int64 matrix."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray):
        if len(own) <= max(2, self.leaf):
            return own
        spread = ((self.entries[own] - self.entries[own[0]]) ** 2).sum(axis=1)
        point = own[spread.argmax()]
        rest = own[own != point]
        away = ((self.entries[rest] - self.entries[point]) ** 2).sum(axis=1)
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        children = []
        for part in (order[:half], order[half:]):
            least, most = isqrt(int(away[part].min())), isqrt(int(away[part].max())) + 1
            children.append((least, most, self._build(np.sort(rest[part]))))
        return int(point), int(away[order[half]]), children

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry (the lowest index of equals) and the squared distance to it."""
        best, at = np.full(len(parts), _FAR), np.zeros(len(parts), np.int64)

        def measure(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
            away = ((parts[rows, None, :] - self.entries[own]) ** 2).sum(axis=2)
            first = away.argmin(axis=1)  # own is ascending
            least, index = away[np.arange(len(rows)), first], own[first]
            better = (least < best[rows]) | ((least == best[rows]) & (index < at[rows]))
            best[rows[better]], at[rows[better]] = least[better], index[better]
            return least

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                measure(rows, node)
                return
            point, middle, children = node
            away = measure(rows, np.array([point]))
            root = np.sqrt(away.astype(np.float64)).astype(np.int64)
            low, high = root - 1, root + 2
            gaps = [np.maximum(np.maximum(least - high, low - most), 0) ** 2 for least, most, _ in children]
            inner = away < middle
            for first, group in ((0, np.flatnonzero(inner)), (1, np.flatnonzero(~inner))):
                for child in (first, 1 - first):
                    own = rows[group]
                    visit(children[child][2], own[gaps[child][group] <= best[own]])

        visit(self.root, np.arange(len(parts)))
        return at, best


def _integers(column: pa.Array, length: int) -> np.ndarray:
    """Vectors of a batch as int64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, length)


def _assigned(column: pa.Array, trees: list[VantageTree], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, parts, codes, squared distances) of slices of a batch; the last three by part position first."""
    for at in range(0, len(column), TOGETHER):
        cut = _integers(column.slice(at, TOGETHER), length)
        cut = np.ascontiguousarray(cut.reshape(len(cut), len(trees), -1).swapaxes(0, 1))
        found = [tree.nearest(part) for tree, part in zip(trees, cut, strict=True)]
        yield at, cut, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


def _sums(codebooks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums: (part, entry, place, total, n)."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(c) for c in codebooks]
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, cut, codes, _ in _assigned(batch.column(0), trees, parts * width):
                for p in range(parts):
                    n[p] += np.bincount(codes[p], minlength=entries)
                    order = np.argsort(codes[p], kind="stable")
                    used, start = np.unique(codes[p][order], return_index=True)
                    total[p, used] += np.add.reduceat(cut[p][order], start, axis=0)
        part, entry, place = (x.ravel() for x in np.indices(total.shape))
        some = np.repeat(n.ravel(), width) > 0
        columns = [part[some], entry[some], place[some], total.ravel()[some], np.repeat(n.ravel(), width)[some]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "place", "total", "n"])

    return lambda batches: released(run(batches))


def _codes(codebooks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(c) for c in codebooks]
        for batch in batches:
            for at, _, codes, away in _assigned(batch.column(2), trees, parts * width):
                rows = codes.shape[1]
                text = np.ascontiguousarray(codes.T.astype(np.uint8)).tobytes().hex()
                code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array(code, pa.string()), pa.array(away.sum(axis=0))], ["vec_id", "label", "code", "error"])

    return lambda batches: released(run(batches))


def largest(length: int, parts: int = PARTS) -> float:
    """Size of a component below which ``parts`` squared distances of parts sum up within 63 bits."""
    return isqrt((1 << 61) // max(1, length)) / SCALE


def kept_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, list]:
    """(vec_id, label, embedding) of the vectors that are coded, and those of the smallest ids, in their order."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    size = F.size("embedding")
    finite = lambda most: F.coalesce(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < most, F.lit(False))), F.lit(False))  # noqa: E731  NaN is greater than any
    whole = rows.where((size > 0) & (size % parts == 0) & finite(float("inf")))
    # one row decides the length, so the scan that finds it carries no vectors
    first = whole.where("vec_id is not null").select(F.min(F.struct("vec_id", size.alias("size"))).alias("first")).first()["first"]
    if first is None:
        return whole.limit(0), []
    kept = whole.where((size == first["size"]) & finite(largest(first["size"])))
    return kept, kept.where("vec_id is not null").orderBy("vec_id", "embedding").select("embedding").limit(entries).collect()


def fit(kept: DataFrame, first: list, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` rounds; at most entries * length rows come to the driver a round."""
    start = np.floor(SCALE * np.array([r["embedding"] for r in first], np.float64)).astype(np.int64)
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, -1).swapaxes(0, 1))
    for _ in range(rounds):
        sums = kept.select("embedding").mapInArrow(_sums(codebooks), "part long, entry long, place long, total long, n long")
        found = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        at = tuple(found[c].to_numpy() for c in ("part", "entry", "place"))
        codebooks = codebooks.copy()
        codebooks[at] = found["total"].to_numpy() // found["n"].to_numpy()
    return codebooks


def encode(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error); map-only."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kept.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.select("vec_id", "label", "embedding").mapInArrow(_codes(codebooks), schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over the rows of its label; nulls are one label."""
    names = ["vec_id", "label", "code", "error", "label_error"]
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if bounded_rows(sums, BROADCAST_LABELS) is not None:
        return coded.join(F.broadcast(sums), same).select(*names)
    # a label may hold a third of all rows: each is dealt over SALTS places
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    sums = sums.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(sums, same & (F.col("_salt") == F.col("_place"))).select(*names)


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op11(vectors: DataFrame) -> DataFrame:
    """The contract's columns: vec_id, code, error, label_error, codebooks_sha256."""
    kept, first = kept_vectors(vectors)
    if not first:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codebooks = fit(kept, first)
    coded = with_label_error(materialise(encode(kept, codebooks), "vectorcodes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignment by codebooks c{n}, and what they become, c{n + 1}."""
    return f"""
), a{n} as (
  select vec_id, part, p, arg_min(entry, struct_pack(d := d, entry := entry)) as entry, min(d) as d
  from (select x.vec_id, x.part, x.p, c.entry, list_sum(list_transform(generate_series(1, len(x.p)), lambda i: (x.p[i] - c.p[i]) * (x.p[i] - c.p[i])))::bigint as d from parts x join c{n} c using (part))
  group by all
), m{n} as (
  select part, entry, list(mean order by place) as p
  from (select part, entry, place, floor(sum(p[place])::double / count(*))::bigint as mean from a{n}, (select unnest(generate_series(1, (select max(len(p)) from parts))) as place) group by all)
  group by part, entry
), c{n + 1} as (
  select part, entry, coalesce(m{n}.p, c{n}.p) as p from c{n} left join m{n} using (part, entry)"""


#: The same by all distances.
SQL = f"""
with q as (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from embeddings
  where len(embedding) > 0 and len(embedding) % {PARTS} = 0 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), parts as (
  select vec_id, part, q[part * (len(q) // {PARTS}) + 1 : (part + 1) * (len(q) // {PARTS})] as p from q, (select unnest(range({PARTS})) as part)
), c0 as (
  select part, dense_rank() over (order by vec_id) - 1 as entry, p from parts where vec_id in (select vec_id from q order by vec_id limit {ENTRIES})
{"".join(_round_sql(n) for n in range(ROUNDS))}
{_round_sql(ROUNDS)}
), e as (
  select vec_id, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by vec_id
), h as (
  select sha256(string_agg(x, ',' order by part, entry)) as codebooks_sha256 from (select part, entry, array_to_string(p, ',') as x from c{ROUNDS})
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e join q using (vec_id), h
"""
