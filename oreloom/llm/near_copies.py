"""Near copies by SimHash with pivot distance tables, verified by exact similarity.

Two texts are near copies if the Jaccard similarity of their distinct ``SHINGLE``-word
shingles is ``SIMILARITY`` or more; a group is whatever such links connect.

Which texts meet: shingles have one order for the whole corpus, rare ones first.  Two sets
of similarity t share one of the first n - ceil(t n) + 1 shingles of either, so those are a
text's keys, and no pair is lost.  The order comes from the counts of ``BUCKETS`` hash
buckets over all texts, which keeps shingles that many texts share (passages, notices) out
of the keys of texts that have others.

Among the texts of a key, a pair is discarded if the sizes rule the similarity out, if a
coordinate of the pivot tables (Hamming distances of the fingerprints to ``PIVOTS``
reference fingerprints) differs by more than ``DISTANCE``, or if the fingerprints do.  At
similarity 0.8 a bit differs with probability 0.15, so of 64 more than 28 differ for one
pair in 10^8; sets of under ``SMALL`` shingles, for which that estimate is loose, skip the
test.  A second fingerprint holds the parity of the shingles in each of ``PARITIES`` hash
buckets: its Hamming distance never exceeds the number of shingles that only one text has,
so a pair beyond what the similarity allows is discarded without loss.  In the first round it is
looked up for the proposed pairs alone, later few keys are left and carry it.  Survivors are
verified on the whole sets.

Rounds keep groups linear: at first a text proposes one partner a key, the first of its
order, so that a group of copies proposes little more than a star.  Proposals are verified
and groups joined.  Only keys in which a text has partners left go into the next round, in
which texts that are still apart propose eight times as many, until none is left.  Keys of
more than ``MOST`` texts are dealt into blocks, and every pair of blocks is compared.

Keys that only one text has are dropped before they travel with it: of the others a bitmap is
broadcast, and what passes it is joined.  The bitmap has 8 bits a key and more, from 2^24 up to
2^28 (at most 67 MB as rows); beyond 2^25 keys more pass it in vain, which costs a shuffle and no pair.

Keys that hold the same texts would propose the same pairs, so of those one is kept.
Texts with the same set are one class (told by a 64-bit hash of the set), so exact copies
meet nothing.  Only keys, fingerprints and the sets of proposed pairs travel.

Defined cases: words are lower-cased (A-Z) and split at ASCII white space; a text of fewer
than five words is one shingle; null, empty and blank texts are one class; repeated rows
are one document; rows with a null doc_id can't be told apart and stay; an id that
stands on several rows stays with all of them if one is its group's first; very long texts
are read whole; an empty table gives no rows; other columns are kept as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.storage import bounded_rows, materialise, release, sweep
from .rows import chunks
from .simhash import pivots

SHINGLE = 5
SIMILARITY = 0.8
DISTANCE = 28
PIVOTS = 16
SMALL = 64
PARITIES = 512
BITMAP = 1 << 24, 1 << 28
BUCKETS = 1 << 18
#: Texts of one key compared in one group.
MOST = 2048
#: Proposed pairs that a task holds to leave out repeats.
HELD = 1 << 18
#: Rows of ids or keys that may be broadcast; beyond, they are joined.
BROADCAST_ROWS = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Hashes of each whole text's shingles, in order."""
    from xxhash import xxh3_64_intdigest

    words = [t.encode("utf-8", "replace").lower().split() if t else [] for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(count.sum()))
    out = np.full(len(hashes), size, np.uint64)
    for k in range(min(size, len(out))):  # all texts at once; what reaches over a text's end is cut away
        out[: len(out) - k] = _mixed((out[: len(out) - k] + hashes[k:]) * _ODD)
    end = np.cumsum(count)
    found = [out[b - n : b - size + 1] for b, n in zip(end.tolist(), count.tolist(), strict=True)]
    for i in np.flatnonzero((count > 0) & (count < size)).tolist():  # the whole sequence
        one = np.full(1, count[i], np.uint64)
        for k in range(end[i] - count[i], end[i]):
            one = _mixed((one + hashes[k]) * _ODD)
        found[i] = one
    return found


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    hashes = np.sort(hashes)
    return hashes[np.append(True, hashes[1:] != hashes[:-1])] if len(hashes) else hashes


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of distinct shingles; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        counts += np.unpackbits(hashes[at : at + 255].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def parities(hashes: np.ndarray) -> bytes:
    """Parity of the distinct shingles in each of ``PARITIES`` hash buckets."""
    count = np.bincount((hashes >> np.uint64(40)).astype(np.int64) & (PARITIES - 1), minlength=PARITIES)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def _hashed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of batches (text last) with the shingles of their texts; a piece holds a bounded number of characters."""
    for batch in batches:
        for start, end, texts in chunks(batch):
            yield batch.slice(start, end - start), shingles(texts, size)


def _class_of(hashes: np.ndarray) -> int:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64)


def bucket_counts(docs: DataFrame, size: int = SHINGLE, buckets: int = BUCKETS) -> np.ndarray:
    """Number of shingles of each hash bucket, over all texts; at most ``buckets`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, found in _hashed(batches, size):
            total += np.bincount((np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    rows = materialise(docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "buckets").toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def sign(docs: DataFrame, counts: np.ndarray, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, cid, fp, n, bits, keys) of every row: its class, fingerprint, number of shingles, parities, and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _hashed(batches, size):
            found, keys = list(map(_distinct, found)), []
            for hashes in found:
                often = counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)]
                most = len(hashes) - ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
                keys.append(hashes[np.argsort(often, kind="stable")[:most]].view(np.int64))  # hashes are sorted, so ties go by them
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            columns = [
                batch.column(0), pa.array(np.array([_class_of(x) for x in found], np.int64)), pa.array(np.array([simhash(x) for x in found], np.uint64).view(np.int64)),
                pa.array(np.array([len(x) for x in found], np.int64)), pa.array([parities(x) for x in found], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "cid", "fp", "n", "bits", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, cid long, fp long, n long, bits binary, keys array<long>")


def _partners(most: int, similarity: float, distance: int, with_bits: bool):
    """mapInArrow function over rows (key, part, cid, fp, n, root, and bits if there), sorted by the first three.

    Each row proposes its first ``most`` partners of other roots in its key and part: pairs
    (a, b) with a < b.  A key in which a row has more left is told in ``left``.
    """
    names = ["a", "b", "left"]
    alone = (1 - similarity) / (1 + similarity)  # of all shingles of two texts, those that only one may have

    def propose(group: np.ndarray, key: np.ndarray, cid: np.ndarray, fp: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray | None, references: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.bincount(group)
        start = (np.cumsum(sizes) - sizes)[group]
        table = np.stack([np.bitwise_count(fp ^ p).astype(np.int16) for p in references])
        active, given = np.flatnonzero(np.arange(len(group)) > start), np.zeros(len(group), np.int64)
        step = 0
        while True:
            active = active[(start[active] + step < active) & (given[active] <= most)]
            if not len(active):
                break
            hub = start[active] + step
            i, j = hub[root[hub] != root[active]], active[root[hub] != root[active]]
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            fits = low >= similarity * high - 1e-9
            i, j, low = i[fits], j[fits], low[fits]
            for row in table:
                near = (np.abs(row[i] - row[j]) <= distance) | (low < SMALL)
                i, j, low = i[near], j[near], low[near]
            close = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) | (low < SMALL)
            i, j = i[close], j[close]
            if bits is not None:
                even = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= alone * (n[i] + n[j]) + 1e-9
                i, j = i[even], j[even]
            given[j] += 1
            more = given[j] > most
            if more.any():
                left = np.unique(key[j[more]])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.int64()), pa.array(left)], names)
            if not more.all():
                i, j = i[~more], j[~more]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j])), pa.nulls(len(i), pa.int64())], names)
            step += 1

    def distinct(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ``found`` without repeats among up to ``HELD`` of them: a pair shares many keys."""
        held, rows = [], 0
        for batch in found:
            held.append(batch)
            rows += len(batch)
            if rows >= HELD:
                held = pa.Table.from_batches(held).group_by(names).aggregate([]).to_batches()
                rows = sum(map(len, held))
                if rows >= HELD // 2:
                    yield from held
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).group_by(names).aggregate([]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from distinct(proposed(batches))

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def offered(rows: list[np.ndarray]) -> tuple:
            key, _, cid, fp, n, root, *bits = rows
            return key, cid, fp.view(np.uint64), n, root, bits[0] if bits else None, references

        references, kept = pivots(PIVOTS), [np.zeros(0, np.int64)] * 6 + [np.zeros((0, PARITIES // 64), np.uint64)] * with_bits
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:6]]
            if with_bits:
                new.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, PARITIES // 64))
            rows = [np.concatenate(pair) for pair in zip(kept, new, strict=True)]
            if not len(rows[0]):
                continue
            group = np.concatenate([[0], np.cumsum((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))])
            whole = group < group[-1]  # the last group may go on in the next batch
            if whole.any():
                yield from propose(group[whole], *offered([r[whole] for r in rows]))
            kept = [r[~whole] for r in rows]
        if len(kept[0]):
            yield from propose(np.zeros(len(kept[0]), np.int64), *offered(kept))

    return run


def _told_apart(held: DataFrame) -> DataFrame:
    """Rows of one key of all that hold the same texts, the least: the others would propose the same pairs.

    Copies with a few changes share most of their keys, so without this a group proposes each of its
    pairs once a key.  Sets are told apart by 128 bits of hashes and their size.
    """
    sets = held.groupBy("key").agg(F.bit_xor(F.xxhash64("cid")).alias("_x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("_y"), F.count("*").alias("_n"))
    least = materialise(sets.groupBy("_x", "_y", "_n").agg(F.min("key").alias("key")).select("key"), "sets")
    return held.join(_few(least), "key", "left_semi")


def _few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is small, else as it is."""
    return F.broadcast(df) if bounded_rows(df, BROADCAST_ROWS) is not None else df


def _living(keys: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose key is one of ``live``, with its columns."""
    if bounded_rows(live, BROADCAST_ROWS) is not None:
        return keys.join(F.broadcast(live), "key")
    size = min(BITMAP[1], max(BITMAP[0], 1 << (8 * live.count() - 1).bit_length()))
    # the order of keys goes by their low bits, so those would fill a part of the bitmap only
    place = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = live.withColumn("_place", place).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    words = F.broadcast(materialise(words, "bitmap"))  # size / 64 rows at most
    some = keys.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(words, "_word")
    some = some.where(F.col("_bits").bitwiseAND(bit) != 0).select(*keys.columns)
    return some.join(live, "key")


def _possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose parities leave the similarity possible; only 64 bytes a text travel."""
    of = lambda side: classes.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = (1 - similarity) / (1 + similarity)
        for batch in batches:
            if not len(batch):
                continue
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(batch), -1) for k in (4, 5))
            apart = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)
            good = np.flatnonzero(apart <= alone * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + 1e-9)
            yield batch.select([0, 1]).take(pa.array(good))

    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInArrow(run, "a long, b long")


def _deal(rows: DataFrame) -> DataFrame:
    """Rows with their ``part`` of the key: 0, or every pair of its ``parts`` blocks that holds the row's own."""
    own = F.pmod(F.xxhash64("cid"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda t: F.least(own, t) * (1 << 31) + F.greatest(own, t))
    return rows.withColumn("part", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(pairs)))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Proposed pairs (a, b) and ``linked``: whether their whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _hashed(batches, size):
            found = list(map(_distinct, found))
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["cid", "own"])

    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "least"), "cid"), "wanted")
    ids = wanted.where(F.col("least").isNotNull()).select(F.col("least").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = texts.join(_few(ids), "doc_id", "left_semi").unionByName(texts.where(F.col("doc_id").isNull()).distinct())
    sets = some.select("text").mapInArrow(run, "cid long, own array<long>")
    # a class may come more than once, where rows repeat an id; sets are wide, so pairs are told apart afterwards
    sets = materialise(sets.join(_few(wanted.select("cid")), "cid", "left_semi"), "sets")
    of = lambda side: sets.join(_few(pairs.select(F.col(side).alias("cid")).distinct()), "cid", "left_semi").select(F.col("cid").alias(side), F.col("own").alias(f"of_{side}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    out = materialise(both.select("a", "b", (shared >= similarity * (F.size("of_a") + F.size("of_b") - shared) - 1e-9).alias("linked")).distinct(), "verified")
    release(wanted, sets)
    sweep(docs.sparkSession)
    return out


def near_copies(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(doc_id, cid, group) of every row; group is the smallest doc_id that links reach."""
    signed = materialise(sign(docs, bucket_counts(docs, size), size, similarity), "signed")
    classes = signed.groupBy("cid").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")
    sweep(docs.sparkSession)
    # of the rows of one class one has keys
    copies = classes.where("copies > 1").select("cid", "least", F.lit(True).alias("again"))
    marked = signed.join(_few(copies), "cid", "left").where("again is null or least is null or doc_id = least").select("cid", "fp", "n", "keys", "again")
    single = marked.where("again is null").drop("again").unionByName(marked.where("again").drop("again").dropDuplicates(["cid"]))
    keys = single.select("cid", "fp", "n", F.explode("keys").alias("key"))
    live = single.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count("*") / most).alias("parts"), F.count("*").alias("texts")).where("texts > 1").select("key", "parts")
    live = materialise(live, "livekeys")
    sweep(docs.sparkSession)
    held = _living(keys, live).select("key", "parts", "cid", "fp", "n")
    every = materialise(held, "live")
    held = materialise(_told_apart(every), "apart")
    release(every)
    # keys are most of what was signed; from here on members are enough
    members = materialise(signed.select("doc_id", "cid"), "members")
    release(signed, live)
    sweep(docs.sparkSession)
    linked = verified = roots = None
    offers = 1
    while True:
        rows = held.withColumn("root", F.col("cid"))
        if roots is not None:
            rows = held.join(roots, held["cid"] == roots["node"], "left").select(*held.columns, F.coalesce("root", "cid").alias("root"))
        bits = [c for c in held.columns if c == "bits"]
        dealt = _deal(rows).select("key", "part", "cid", "fp", "n", "root", *bits).repartition("key", "part").sortWithinPartitions("key", "part", "cid")
        found = materialise(dealt.mapInArrow(_partners(offers, similarity, distance, bool(bits)), "a long, b long, left long").distinct(), "proposed")
        new = found.where("left is null").select("a", "b")
        new = materialise(new.join(verified.select("a", "b"), ["a", "b"], "left_anti"), "new") if verified is not None else new
        if bounded_rows(new, 0) is None:
            # what parities rule out here isn't proposed again: later rounds carry them
            likely = new if bits else materialise(_possible(new, classes, similarity), "likely")
            done = _verified(docs, classes, likely, size, similarity)
            verified = done if verified is None else verified.unionByName(done)
            more = done.where("linked").select("a", "b")
            if bounded_rows(more, 0) is None:
                linked = more if linked is None else linked.unionByName(more)
                roots = materialise(connected_components(linked), "roots")
        left = found.where("left is not null").select(F.col("left").alias("key"))
        if bounded_rows(left, 0) is not None:
            break
        some = held.join(_few(left), "key", "left_semi")
        last, held = held, materialise(some if bits else some.join(classes.select("cid", "bits"), "cid"), "held")
        release(last, found)
        offers *= 8
    if roots is not None:
        named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
        named = materialise(named, "named")
        first = named.groupBy("root").agg(F.min("least").alias("group"))
        named = named.join(first, "root").select("cid", "group")
    else:
        named = classes.select("cid", F.col("least").alias("group"))
    return members.join(named, "cid").select("doc_id", "cid", "group")


def keep_distinct(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Documents in their own columns, of each group the one with the smallest doc_id."""
    found = near_copies(docs, size, similarity, distance, most).where(F.col("doc_id").isNotNull())
    ids = materialise(found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("group")).alias("first"), F.count("*").alias("n")), "ids")
    of = lambda rows, ids, how: rows.join(_few(ids) if bounded_rows(ids, BROADCAST_ROWS) is not None else ids.hint("merge"), "doc_id", how).select(*docs.columns)
    out = of(docs, ids.where("not first").select("doc_id"), "left_anti")
    again = ids.where("first and n > 1").select("doc_id")
    if bounded_rows(again, 0) is not None:
        return out
    return of(out, again, "left_anti").unionByName(of(out, again, "left_semi").dropDuplicates(["doc_id", "text"]))
