"""Bound-certified repacking of tokenised documents into as few rows as possible.

Method: pieces are dealt at random into groups of bounded size and packed by best-fit
decreasing.  A dual-feasible-function lower bound certifies each group whose bin count
meets it.  Groups with a gap give up all their unfilled bins, certified groups their
least filled one and those under ``OPEN_FILL`` full, which other groups' pieces might
fill; the pieces so released are dealt into fewer groups and packed again, until one group
holds them all or a round saves nothing.

Only lengths travel: texts are read once, ids reduced to lengths and checksums.  Pieces
that fill a row are rows already and are never shuffled.

Defined cases: null text counts as empty; an empty text is the end id alone (length 1);
texts over the capacity become full pieces and a last shorter one; repeated rows are
packed each on its own; an empty table gives no rows; other columns are ignored; doc_id
may be null; the text of a special token is plain text, or that token with ``special``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binpack import best_fit_decreasing, lower_bound
from .rows import chunks, per_worker, task_base
from ..plans.storage import materialise
from .word_tokens import WordEncoder

CAPACITY = 4096
#: Rows' worth of tokens, and pieces, in a group: few, so that thousands of documents already make several.
GROUP_ROWS = 128
GROUP_PIECES = 200_000
END_ID = 1
#: Words that a worker remembers in each of two generations, some 200 bytes each; fewer are encoded anew more often.
WORDS = 400_000
#: A bin less full than this is open to pieces of other groups, certified or not.
OPEN_FILL = 0.9

_PIECE = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", grp long, bin long, offset long, fill long, bins long, bound long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, special: bool = False, words: int = WORDS) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32) of each document's pieces; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid, end, step = per_worker((WordEncoder.__name__, path, special, words), lambda: WordEncoder(path, words, special)), task_base(), END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for first, _, texts in chunks(batch):
                for doc_id, raw in zip(ids[first:], encoder.encode_bytes(texts), strict=False):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        for column, value in zip(rows, (uid, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                        uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PIECE, strict=True)], schema=_PIECE)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


def _pack_group(capacity: int):
    schema = pa.schema([*_PIECE, ("grp", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("bins", pa.int64()), ("bound", pa.int64())])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")  # the result depends on the pieces alone, not on their arrival
        lengths = table["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        n, grp = len(bins), np.full(len(bins), key[0].as_py())
        extra = [grp, bins, offsets, fill[bins], np.full(n, len(fill)), np.full(n, lower_bound(lengths, capacity))]
        return pa.Table.from_arrays([*(table[f.name] for f in _PIECE), *map(pa.array, extra)], schema=schema)

    return pack


def _round(pieces: DataFrame, tokens: int, count: int, capacity: int, group_rows: int, number: int) -> tuple[DataFrame, int]:
    """Pieces dealt and packed, and the number of groups."""
    groups = max(1, -(-tokens // (capacity * group_rows)), -(-count // GROUP_PIECES))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.col("uid"), F.lit(number)), F.lit(groups)))
    return materialise(dealt.groupBy("grp").applyInArrow(_pack_group(capacity), PLACED), f"packed{number}"), groups


def repack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group_rows: int = GROUP_ROWS, rounds: int = 8, special: bool = False, words: int = WORDS) -> DataFrame:
    """One row per piece: where it lies (sequence_id, offset), how its bin was certified.

    ``group_bins`` and ``group_bound`` are the bin count and the lower bound of the group
    that placed the piece; equal numbers prove that group optimal.
    """
    pieces = materialise(cut_pieces(docs, capacity, path, special, words), "pieces")
    whole = pieces.where(F.col("length") == capacity).select(
        *_PIECE.names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("group_bins"), F.lit(1).cast("long").alias("group_bound")
    )
    final = [whole]
    keep = lambda placed, number: placed.select(
        *_PIECE.names, (F.lit(number << 58) + F.col("grp") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset", F.col("bins").alias("group_bins"), F.col("bound").alias("group_bound")
    )
    todo = pieces.where(F.col("length") < capacity)
    tokens, count = todo.agg(F.sum("length"), F.count("*")).first()
    placed, groups = _round(todo, tokens or 0, count, capacity, group_rows, 0)
    for number in range(rounds):
        # a bin's first piece stands for it: one row a bin, so the least fill needs no window over pieces
        heads = placed.where(F.col("offset") == 0)
        least = heads.groupBy("grp").agg(F.min_by("bin", F.struct("fill", "bin")).alias("least"))
        open_ = placed.join(least, "grp").withColumn("gives", (F.col("fill") < capacity) & ((F.col("bins") > F.col("bound")) | (F.col("bin") == F.col("least")) | (F.col("fill") < OPEN_FILL * capacity)))
        freed = open_.where("gives").agg(F.sum("length"), F.count(F.when(F.col("offset") == 0, 1)), F.count("*")).first()
        if groups == 1 or number + 1 == rounds or not freed[0] or freed[1] <= -(-freed[0] // capacity):
            break
        again, fewer = _round(open_.where("gives").select(*_PIECE.names), freed[0], freed[2], capacity, group_rows, number + 1)
        if again.where(F.col("offset") == 0).count() >= freed[1]:
            break
        final.append(keep(open_.where(~F.col("gives")), number))
        placed, groups = again, fewer
    final.append(keep(placed, number))
    out = final[0]
    for part in final[1:]:
        out = out.unionByName(part)
    return out


def op10(docs: DataFrame, special: bool = False, words: int = WORDS) -> DataFrame:
    """The contract's columns, then each piece's group certificate."""
    return repack(docs, special=special, words=words).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group_bins", "group_bound")
