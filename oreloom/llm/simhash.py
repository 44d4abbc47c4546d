"""SimHash fingerprints linked by pivot distance tables.

Method: a table holds each fingerprint's Hamming distances to ``PIVOTS`` reference
fingerprints.  By the triangle inequality two fingerprints at distance d differ by at most
d in every coordinate, so a pair whose largest coordinate difference exceeds the limit is
discarded unseen; survivors are verified exactly.

Which pairs meet: 64 bits are cut into 6 blocks.  At most 4 differing bits leave at least
2 blocks equal, so each pair to be found shares one of 15 two-block keys of 20 to 22 bits.  Beyond
``MANY`` fingerprints those keys hold too many by chance; then 8 blocks, of which 4 stay equal,
give 70 keys of 32 bits.  Both cuts find every pair.  Inside a key fingerprints are sorted by their first coordinate and only neighbours within the limit
are compared.  Keys with more than ``most`` fingerprints are dealt into blocks, and every
pair of blocks is compared, so no key lands in one task and no pair is lost.

Only a spanning forest of the links leaves a task: pairs already connected are skipped.
Equal fingerprints are one node.  All of it works on fingerprints, never on texts.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other;
texts under four words hash their whole sequence; repeated rows share everything; an
empty table gives no rows; a null doc_id is kept, and counts for no component's smallest
doc_id (a component of nulls has a null id); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .rows import chunks
from ..plans.storage import bounded_rows, materialise

SHINGLE = 4
DISTANCE = 4
PIVOTS = 32
SEED = 42
#: (lowest bit, bits) of the six blocks, of the eight, and fingerprints from which on there are eight.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
EIGHT = tuple((8 * k, 8) for k in range(8))
MANY = 1 << 24
#: Fingerprints of one key compared in one group.
MOST = 4096
#: Keys with more than ``MOST`` fingerprints that may be broadcast; beyond, they are joined.
BROADCAST_KEYS = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for _, _, texts in chunks(batch) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed random ones, the same for every corpus."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64)


def _forest(fps: np.ndarray, table: np.ndarray, first: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among rows; ``first`` numbers each row's group.

    Rows are sorted by (group, table[0]).
    """
    parent = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    for shift in range(1, len(fps)):
        left = left[left + shift < len(fps)]
        right = left + shift
        near = (first[left] == first[right]) & (table[0, right] - table[0, left] <= distance)
        left = left[near]  # sorted: a row out of reach stays so for larger shifts
        if not len(left):
            break
        i, j = left, left + shift
        for k in range(1, len(table)):
            open_ = np.abs(table[k, i] - table[k, j]) <= distance
            if k == 1:
                open_ &= parent[i] != parent[j]
            i, j = i[open_], j[open_]
        close = np.bitwise_count(fps[i] ^ fps[j]) <= distance
        if not close.any():
            continue
        for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True):
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return edges


def _link_keys(distance: int):
    """mapInArrow function: links within each (key, part); input sorted by them."""

    def forests(keys: np.ndarray, fps: np.ndarray, references: np.ndarray) -> Iterator[pa.RecordBatch]:
        """keys: number of each row's group."""
        sizes = np.bincount(keys)
        held = sizes[keys] > 1
        keys, fps = keys[held], fps[held]
        if not len(fps):
            return
        table = np.stack([np.bitwise_count(fps ^ p).astype(np.int16) for p in references])
        order = np.lexsort((table[0], keys))
        keys, fps, table = keys[order], fps[order], table[:, order]
        big = sizes[keys] > 64
        parts = [np.flatnonzero(~big)]
        if big.any():
            at = np.flatnonzero(big)
            parts += np.split(at, np.flatnonzero(np.diff(keys[at])) + 1)
        for rows in parts:
            found = _forest(fps[rows], table[:, rows], keys[rows], distance)
            if found:
                a, b = np.array(found).T
                own = fps[rows].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references, kept = pivots(), [np.zeros(0, np.int64)] * 3
        for batch in batches:
            key, part, fp = (np.concatenate([k, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, batch.columns, strict=True))
            if not len(key):
                continue
            new = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(part) != 0))])
            whole = new < new[-1]  # the last group may go on in the next batch
            yield from forests(new[whole], fp[whole].view(np.uint64), references)
            kept = [key[~whole], part[~whole], fp[~whole]]
        if len(kept[0]):
            yield from forests(np.zeros(len(kept[0]), np.int64), kept[2].view(np.uint64), references)

    return run


def _keys(blocks: tuple[tuple[int, int], ...], equal: int) -> list:
    """Keys of column fp, one for each choice of ``equal`` blocks, as longs that differ between choices."""
    out = []
    for k, chosen in enumerate(combinations(blocks, equal)):
        key = F.lit(k).cast("long")
        for low, bits in chosen:
            key = key * (1 << bits) + F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << bits) - 1))
        out.append(key)
    return out


def link(fps: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Edges (a, b) with the components of all links at ``distance`` or less among distinct ``fp``."""
    if distance > 4:
        raise ValueError("equal blocks are certain up to 4 differing bits only")
    cut = _keys(BLOCKS, 2) if fps.count() <= MANY else _keys(EIGHT, 4)
    rows = fps.select(F.explode(F.array(*cut)).alias("key"), "fp")
    hot = materialise(rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).alias("parts")), "hotkeys")
    # every row learns its key's number of blocks, then goes to each pair of blocks that includes its own
    known = rows.join(F.broadcast(hot) if bounded_rows(hot, BROADCAST_KEYS) is not None else hot, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda t: F.least(own, t) * (1 << 31) + F.greatest(own, t))
    dealt = known.select("key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("part"), "fp")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_link_keys(distance), "a long, b long")


def simhash_components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable."""
    own = materialise(with_fingerprint(docs), "fingerprints")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = connected_components(link(classes.select("fp"), distance)).withColumnRenamed("node", "fp")
    # classes without a link keep their own smallest doc_id
    member = materialise(classes.join(found, "fp"), "linked")
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(smallest, "root").select("fp", "component_id")
    alone = classes.join(member.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return own.join(linked.unionByName(alone), "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Documents in their own columns, of each component the one with the smallest doc_id.

    Rows that repeat its doc_id and text are one document; rows with a null doc_id can't
    be told apart and stay.
    """
    found = simhash_components(docs, distance).where(F.col("doc_id") == F.col("component_id"))
    kept = materialise(found.groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # the ids grow with the documents, so they are never broadcast
    of = lambda ids: docs.join(ids.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    out = of(kept.where("n = 1")).unionByName(docs.where(F.col("doc_id").isNull()))
    again = kept.where("n > 1")
    return out.unionByName(of(again).dropDuplicates(["doc_id", "text"])) if bounded_rows(again, 0) is None else out


def op6(docs: DataFrame) -> DataFrame:
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
