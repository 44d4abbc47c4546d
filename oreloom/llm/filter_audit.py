"""How five document filters interact: what each removes at each place of every order.

A document's failures are five bits.  A table of 32 failure sets by 120 orders holds the
step at which the document goes (5: never), so one lookup a document answers all orders.
Tasks look their rows up and count removals by part, order and step, and by label, with
``np.bincount``; what leaves a task is one row of arrays a part, and these are summed.
The rest follows from those counts: what fails a filter goes at step 1 where the filter
comes first, what fails it alone goes at step 5 where it comes last.

Copies are told by SHA-256 of the whole text.  Rows that share text, part and labels become
one row with a count and the smallest id's rows apart, before a text's first id is looked
up, so a text with millions of copies is a few rows there.

Defined cases: null text is empty, and all empty texts are copies of each other; a null
source is the empty part; a null doc_id has no labels, is no copy and makes none; rows that
repeat a doc_id count each, and don't make each other copies; a document with several label
rows has a label if any of them has it; very long texts are read whole; an empty table
gives no rows; other columns are ignored, as are columns of labels beside the three.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rows import chunks, released

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
CELLS = len(ORDERS) * STEPS
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Parts of which a task holds counts at a time.
PARTS_HELD = 1000
ROWS_HELD = 16_384


def first_failures() -> np.ndarray:
    """(32, 120): the step, from 0, at which a failure set (bit k: filter k) meets its first failure; 5 for none."""
    order = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] >> order) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def failures(text: str) -> int:
    """Bits A to D of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * len(text)) << 2 | (len(raw.translate(None, b"#$%&*|")) < len(raw)) << 3


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, same, fails) of every row: ``same`` tells equal texts, ``fails`` holds bits A to D; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for start, end, texts in chunks(batch):
                own = batch.slice(start, end - start)
                same = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(same, pa.binary()), pa.array(map(failures, texts), pa.int32())], ["doc_id", "part", "same", "fails"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: released(run(batches)), "doc_id long, part string, same binary, fails int")


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, flags): bit 0 for quality = 1, bit 1 for toxic = 1; one row an id."""
    bit = lambda column, value: F.max(F.when(F.col(column) == 1, value).otherwise(0))
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    return rows.groupBy("doc_id").agg((bit("quality", 1) + bit("toxic", 2)).alias("flags"))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, flags, n): documents by all five bits and labels; a row stands for copies of one text."""
    rows = marked(docs).join(label_flags(labels), "doc_id", "left")
    keys = ["same", "part", "fails", "flags"]
    rows = rows.withColumn("flags", F.coalesce("flags", F.lit(0))).withColumn("same", F.when(F.col("doc_id").isNotNull(), F.col("same")))
    by_id = rows.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))  # the join has dealt rows by id
    groups = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.when(F.col("same").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    first = groups.where("same is not null").groupBy("same").agg(F.min("least.doc_id").alias("first"))
    groups = groups.join(first, "same", "left")
    passes = F.when(F.col("same").isNull(), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0).cast("long"))
    split = F.array(F.struct(F.col("fails"), passes.alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - passes).alias("n")))
    return groups.select("part", "flags", F.explode(split).alias("x")).select("part", "x.fails", "flags", "x.n").where("n > 0")


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's (part, total, removed, good, toxic); the last three hold orders by steps."""
    table = first_failures()
    cell = np.arange(len(ORDERS)) * (STEPS + 1)
    names: dict[str, int] = {}
    held = np.zeros((3, PARTS_HELD, len(ORDERS) * (STEPS + 1)), np.int64)

    def given() -> pa.RecordBatch:
        n = len(names)
        every = held[:, :n].reshape(3, n, len(ORDERS), STEPS + 1)
        lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * CELLS, pa.array(x[:, :, :STEPS].ravel())) for x in every]
        return pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(every[0, :, 0].sum(axis=1)), *lists], ["part", "total", "removed", "good", "toxic"])

    for batch in batches:
        for at in range(0, len(batch), ROWS_HELD):
            own = batch.slice(at, ROWS_HELD)
            part = own.column(0).dictionary_encode()
            fails, flags, n = (own.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
            values, code = part.dictionary.to_pylist(), part.indices.to_numpy()
            for first in range(0, len(values), PARTS_HELD // 2):
                some = values[first : first + PARTS_HELD // 2]
                if len(names) + len(some) > PARTS_HELD:
                    yield given()
                    names.clear()
                    held[:] = 0
                place = np.array([names.setdefault(v, len(names)) for v in some])
                rows = np.flatnonzero((code >= first) & (code < first + len(some)))
                # rows of one part, failure set and labels are looked up together
                key, inverse = np.unique(place[code[rows] - first] << 7 | flags[rows] << 5 | fails[rows], return_inverse=True)
                weight = np.bincount(inverse, n[rows])
                where = ((key >> 7) * held.shape[2])[:, None] + cell + table[key & 31]
                for k, label in enumerate((np.ones(len(key), bool), key >> 5 & 1, key >> 6 & 1)):
                    mine = np.flatnonzero(label)
                    found = np.bincount(where[mine].ravel(), np.repeat(weight[mine], len(ORDERS)), len(names) * held.shape[2])  # counts below 2^53 are exact
                    held[k, : len(names)] += found.astype(np.int64).reshape(len(names), -1)
    if names:
        yield given()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    partial = counted(docs, labels).mapInArrow(lambda batches: released(_removals(batches)), "part string, total long, removed array<long>, good array<long>, toxic array<long>")
    cells = partial.select("part", "total", F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("cell", "x"))
    sums = cells.groupBy("part", "cell").agg(*(F.sum(c).alias(a) for c, a in (("total", "total"), ("x.removed", "removed"), ("x.good", "good_lost"), ("x.toxic", "toxic_lost"))))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("cell") / STEPS) + 1).cast("int"))
    rows = sums.withColumn("filter_order", order).withColumn("step", (F.col("cell") % STEPS + 1).cast("int"))
    rows = rows.withColumn("_filter", F.expr("substring(filter_order, step, 1)"))
    same_filter, so_far = Window.partitionBy("part", "_filter"), Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at_step = lambda k: F.max(F.when(F.col("step") == k, F.col("removed"))).over(same_filter)
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", (at_step(1) - F.col("removed")).alias("redundant"), at_step(STEPS).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(same_filter).alias("shapley"),
    )


op12 = audit

#: The same by plain set logic: every document, order and step.
SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), f as (
  select part, doc_id,
    len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e
  from d
), l as (
  select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x), orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), sets as (
  select part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails, a::int + b::int + c::int + d::int + e::int as n_fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n
  from f left join l using (doc_id) group by all
), steps as (
  select part, filter_order, step, fails[substr(filter_order, step, 1)] as fails_here,
    list_bool_or([fails[substr(filter_order, k, 1)] for k in range(1, step)]) as earlier, n_fails, good, toxic, n
  from sets, orders, (select unnest(range(1, 6)) as step)
), sums as (
  select part, filter_order, step::int as step,
    coalesce(sum(n) filter (not coalesce(earlier, false) and not fails_here), 0)::bigint as kept,
    coalesce(sum(n) filter (not coalesce(earlier, false) and fails_here), 0)::bigint as removed,
    coalesce(sum(n) filter (coalesce(earlier, false) and fails_here), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails_here and n_fails = 1), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (not coalesce(earlier, false) and fails_here and good), 0)::bigint as good_lost,
    coalesce(sum(n) filter (not coalesce(earlier, false) and fails_here and toxic), 0)::bigint as toxic_lost
  from steps group by part, filter_order, step
)
select *, (sum(removed) over (partition by part, substr(filter_order, step, 1)))::bigint as shapley from sums
"""
