"""Best-fit-decreasing packing of token ids into fixed-width matrices.

Method: documents are encoded, ended by a separator, and cut losslessly when longer than
a row; each task packs its pieces by best-fit decreasing with a segment tree over
residual capacities.  No shuffle: packing needs no key, so tasks pack what they read.

Memory is bounded: a task holds at most ``window_tokens`` unpacked ids.  When the window
fills, it is packed, rows at least ``keep_fill`` full leave, and the rest stays for the
next window.

Defined cases: null text counts as empty; an empty document is its separator alone; very
long documents become several pieces; repeated rows are packed each on its own; an empty
table gives no rows; other columns are ignored; doc_id may be null.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binpack import best_fit_decreasing
from .rows import chunks, task_base

WIDTH = 4096
WINDOW_TOKENS = 8_000_000

SCHEMA = "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"
_ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("n_segments", pa.int32()),
        ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_ids", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
    ]
)


def byte_encoder(path: str | None = None):
    """(encode to an id array, separator id) of a rank file; by default the public byte-level one."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=()), max(ranks.values()) + 1


class _Window:
    """Pieces waiting to be packed in one task."""

    def __init__(self, width: int, dtype: np.dtype, pad: int, base: int):
        self.width, self.dtype, self.pad, self.next = width, dtype, pad, base
        self.pieces: list[tuple[int | None, int, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.width):
            self.pieces.append((doc_id, start, ids[start : start + self.width]))
        self.tokens += len(ids)

    def pack(self, least: int) -> Iterator[dict]:
        """Rows filled to ``least`` ids or more; the other pieces stay."""
        bins, _, fill = best_fit_decreasing(np.array([len(p[2]) for p in self.pieces], np.int64), self.width)
        order = np.argsort(bins, kind="stable")
        edges = np.searchsorted(bins[order], np.arange(len(fill) + 1))
        rest = []
        for b in range(len(fill)):
            members = [self.pieces[i] for i in order[edges[b] : edges[b + 1]].tolist()]
            if fill[b] < least:
                rest += members
                continue
            ids, positions = np.full(self.width, self.pad, self.dtype), np.zeros(self.width, self.dtype)
            cuts = [0]
            for _, _, piece in members:
                at = cuts[-1]
                ids[at : at + len(piece)] = piece
                positions[at : at + len(piece)] = np.arange(len(piece))
                cuts.append(at + len(piece))
            yield {
                "sequence_id": self.next, "n_tokens": cuts[-1], "n_segments": len(members), "ids": ids.tobytes(), "cu_seqlens": cuts,
                "position_ids": positions.tobytes(), "doc_ids": [m[0] for m in members], "starts": [m[1] for m in members],
            }
            self.next += 1
        self.pieces, self.tokens = rest, sum(len(p[2]) for p in rest)


def _batches(rows: Iterator[dict], size: int = 128) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def pack_tokens(
    docs: DataFrame,
    width: int = WIDTH,
    path: str | None = None,
    window_tokens: int = WINDOW_TOKENS,
    keep_fill: float = 0.999,
) -> DataFrame:
    """One row per packed sequence.

    ``ids`` holds ``width`` little-endian ids (16 bits if the vocabulary allows, else 32),
    padded with the separator; ``cu_seqlens`` the cumulative segment lengths from 0;
    ``position_ids`` restarts at 0 with each segment (0 in the padding); ``doc_ids`` and
    ``starts`` say which piece of which document a segment is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, separator = byte_encoder(path)
        dtype = np.dtype("<u2" if max(separator, width) < 1 << 16 else "<u4")
        window = _Window(width, dtype, separator, task_base())
        end = np.array([separator], np.uint32)

        def rows() -> Iterator[dict]:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for start, _, texts in chunks(batch):
                    for doc_id, text in zip(doc_ids[start:], texts, strict=False):
                        ids = np.concatenate([encode(text), end]) if text else end
                        window.add(doc_id, ids.astype(dtype))
                        if window.tokens >= window_tokens:
                            yield from window.pack(int(width * keep_fill))
                            if window.tokens >= window_tokens // 2:  # nothing more to gain by waiting
                                yield from window.pack(0)
            yield from window.pack(0)

        yield from _batches(rows())

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)


def shards(packed: DataFrame, rows: int = 256, width: int = WIDTH) -> DataFrame:
    """Packed rows as ``.npy`` matrices: (shard_id, n_rows, ids, position_ids), map-only.

    Each matrix has at most ``rows`` rows of one partition; write the result with any sink.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = task_base()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows).to_pydict()
                blobs = []
                for name in ("ids", "position_ids"):
                    kind = f"<u{len(part[name][0]) // width}"
                    np.save(out := io.BytesIO(), np.stack([np.frombuffer(x, kind) for x in part[name]]))
                    blobs.append(out.getvalue())
                yield pa.RecordBatch.from_pydict({"shard_id": [shard], "n_rows": [len(part["ids"])], "ids": [blobs[0]], "position_ids": [blobs[1]]})
                shard += 1

    return packed.select("ids", "position_ids").mapInArrow(run, "shard_id long, n_rows long, ids binary, position_ids binary")
