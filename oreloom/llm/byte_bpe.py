"""Byte-level BPE by a lazily determinised transducer, and its streaming inverse.

Method: the merge ranks are compiled into a finite-state transducer that reads bytes left
to right.  Two facts make that possible: every prefix of a piece has its own encoding, and
a row of tokens is an encoding exactly if each neighbouring pair is one.  So the last token
of a prefix is the one token ending there that fits the last token of what stands before
it.  A state holds the starts from which a longer token may still grow, each with the token
before it and its place in the trie of all tokens; a move puts out the last token of the
prefix read so far.  Which of those belong to the piece's encoding is certain after a
lookahead bounded by the longest token; reading them from the end picks them.

Pieces are read side by side in numpy arrays: a step looks up all their moves at once, and
moves that no piece met before are determinised together.  States are kept while they fit a
bound; a reset costs time, never results.  Pieces over ``LONG`` bytes are read alone, by
the same rule without making states, so that no piece fills the tables; the ids are those
that the states would give.

Decoding feeds token bytes to an incremental UTF-8 state machine, which lets out complete
characters only.  A piece of a text holds whole characters, so what its ids decode to is
remembered with them.

Defined cases: null text counts as empty (no ids); an empty text gives no ids; very long
texts are read whole, with one word of a million bytes as well; repeated rows are encoded
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import chunks, per_worker

#: Pieces over this many bytes are read alone.
LONG = 256
#: Bytes of pieces read side by side, counting each as long as the longest.
BLOCK = 1 << 20
#: Characters of texts whose pieces are looked up at once: all of an executor's workers hold as much, those that wait as well.
TEXTS = 500_000


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: merge the neighbours of least rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 62:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Table:
    """Numbers of distinct non-negative 64-bit keys, by open addressing, many at a time."""

    def __init__(self, room: int = 1024):
        self._make(room)

    def _make(self, room: int) -> None:
        self.bits, self.held = max(10, (2 * room).bit_length()), 0
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is unknown."""
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there, want = self.keys[at[todo]], keys[todo]
            hit = there == want
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and unknown."""
        if (self.held + len(keys)) * 2 > len(self.keys):
            old, was = self.keys, self.values
            self._make(self.held + len(keys))
            self.put(old[old >= 0], was[old >= 0])
        self.held += len(keys)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several for one place, one gets it
            own = self.keys[at] == keys[todo]
            self.values[at[own]] = values[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) & (len(self.keys) - 1)


class Column:
    """A growing array."""

    def __init__(self, values: list[int]):
        self.data, self.n = np.zeros(1024, np.int64), 0
        self.add(np.array(values, np.int64))

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Transducer:
    """Bytes to token ids; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 400_000):
        self.ranks, self.most = ranks, most_states
        self.tokens = {i: t for t, i in ranks.items()}
        # trie of all tokens: child[node] maps a byte to a node, token[node] is an id or -1
        none: dict = {}  # most nodes have nothing below
        child: list[dict[int, int]] = [{}]
        token = [-1]
        for one, rank in ranks.items():
            at = 0
            for byte in one:
                below = child[at].get(byte)
                if below is None:
                    below = child[at][byte] = len(child)
                    child.append({})
                    token.append(-1)
                at = below
            token[at] = rank
        # what a byte leads to: (node, its id or -1, whether longer tokens follow)
        self.next = [{byte: (below, token[below], bool(child[below])) for byte, below in c.items()} if c else none for c in child]
        self.token, self.grows = np.array(token, np.int64), np.array([bool(c) for c in child])
        steps = np.array([(node << 8 | byte, below) for node, c in enumerate(child) for byte, below in c.items()], np.int64)
        self.trie = Table(len(steps))
        self.trie.put(steps[:, 0], steps[:, 1])
        self.length = np.zeros(max(self.tokens) + 2, np.int64)
        self.length[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.pairs, self.salt = Table(100_000), 1
        self.edges: dict[int, tuple[list, list]] = {}
        self._reset()

    def _reset(self) -> None:
        # state s holds the starts first[s] to first[s + 1], longest first: the token before each
        # and the trie node of what follows it; the last is the end of the prefix itself
        self.first, self.before, self.node = Column([0, 1]), Column([-1]), Column([0])
        self.known, self.moves = Table(), Table()

    @property
    def states(self) -> int:
        return self.first.n - 1

    def _edge(self, token: int) -> tuple[list, list]:
        """What stands at the token's right, and left, edge while it is merged.

        Each is a list of (part, rank of the merge that takes the part up), from the edge's
        byte to the token itself, which nothing takes up.
        """
        known = self.edges.get(token)
        if known is None:
            whole, ranks = self.tokens[token], self.ranks
            parts = [whole[i : i + 1] for i in range(len(whole))]
            right, left = [[parts[-1], 1 << 62]], [[parts[0], 1 << 62]]
            while len(parts) > 1:
                best, at = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at + 1 == len(parts):
                    right[-1][1] = best
                    right.append([parts[-1], 1 << 62])
                if at == 0:
                    left[-1][1] = best
                    left.append([parts[0], 1 << 62])
            known = self.edges[token] = (right, left) if len(parts) == 1 else ([], [])
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether plain BPE leaves the two tokens, side by side, as they are.

        It does unless two parts that meet at the border merge before either is taken up.
        Of two merges of one rank the one further left comes first.
        """
        before, after = self._edge(left)[0], self._edge(right)[1]
        fits, i, j = bool(before and after), 0, 0
        while fits:
            (a, taken_a), (b, taken_b) = before[i], after[j]
            meets = self.ranks.get(a + b, 1 << 62)
            if meets < taken_a and meets <= taken_b:
                return False
            if taken_a == taken_b == 1 << 62:
                break
            if taken_a <= taken_b:
                i += 1
            else:
                j += 1
        return fits

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fits`` of many pairs; anything fits the start of a piece (-1)."""
        keys = (left + 1) * len(self.length) + right
        found = np.where(left < 0, 1, self.pairs.get(keys))
        new = np.unique(keys[found < 0])
        if len(new):
            if self.pairs.held > 2_000_000:
                self.pairs = Table(100_000)
            fits = [self._fits(k // len(self.length) - 1, k % len(self.length)) for k in new.tolist()]
            self.pairs.put(new, np.array(fits, np.int64))
            open_ = found < 0
            found[open_] = np.array(fits, np.int64)[np.searchsorted(new, keys[open_])]
        return found == 1

    def _determinise(self, at: np.ndarray, byte: np.ndarray) -> bool:
        """Makes the moves of (state, byte) pairs; false if two states share a hash."""
        n = self.first.data[at + 1] - self.first.data[at]
        move = np.repeat(np.arange(len(at)), n)
        index = np.arange(len(move)) + np.repeat(self.first.data[at] - (np.cumsum(n) - n), n)
        below = self.trie.get(self.node.data[index] << 8 | byte[move])
        alive = below >= 0
        move, before, below = move[alive], self.before.data[index[alive]], below[alive]
        rank = self.token[below]
        # the last token of the new prefix: of the tokens that end here, the longest that fits what stands before it
        last, todo = np.full(len(at), -1, np.int64), np.flatnonzero(rank >= 0)
        while len(todo):
            head = np.concatenate([[True], np.diff(move[todo]) != 0])
            some = todo[head]
            some = some[self._fit(before[some], rank[some])]
            last[move[some]] = rank[some]
            todo = todo[~head & (last[move[todo]] < 0)]
        assert (last >= 0).all(), "each prefix has an encoding"
        grows = self.grows[below]
        order = np.argsort(np.concatenate([2 * move[grows], 2 * np.arange(len(at)) + 1]), kind="stable")
        before = np.concatenate([before[grows], last])[order]
        node = np.concatenate([below[grows], np.zeros(len(at), np.int64)])[order]
        size = np.bincount(move[grows], minlength=len(at)) + 1
        first = np.cumsum(size) - size
        place = np.arange(len(node)) - np.repeat(first, size)
        mixed = (((before + 1) << 24 | node).astype(np.uint64) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(self.salt)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        name = (np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), first) >> np.uint64(1)).astype(np.int64)
        state = self.known.get(name)
        names, some = np.unique(name[state < 0], return_index=True)
        some = np.flatnonzero(state < 0)[some]
        if len(some):
            inside = np.zeros(len(at), bool)
            inside[some] = True
            # kept in the order of ``at``
            some = np.flatnonzero(inside)
            own = np.repeat(inside, size)
            fresh = np.arange(len(some)) + self.states
            self.first.add(self.before.n + np.cumsum(size[some]))
            self.before.add(before[own])
            self.node.add(node[own])
            self.known.put(name[some], fresh)
            state = self.known.get(name)
        begin = self.first.data[state]
        if (self.first.data[state + 1] - begin != size).any():
            return False
        there = np.repeat(begin, size) + place
        if (self.before.data[there] != before).any() or (self.node.data[there] != node).any():
            return False
        self.moves.put(at << 8 | byte, state)
        return True

    def _run(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces, longest first, read side by side."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, offset = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths
        state, last = np.zeros(len(pieces), np.int64), np.zeros((int(lengths[0]) + 1, len(pieces)), np.int32)
        for t in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t))
            key = state[:live] << 8 | data[offset[:live] + t]
            after = self.moves.get(key)
            new = np.flatnonzero(after < 0)
            if len(new):
                missing = np.unique(key[new])
                if not self._determinise(missing >> 8, missing & 255):
                    self.salt += 2  # other hashes, from the start
                    self._reset()
                    return self._run(pieces)
                after[new] = self.moves.get(key[new])
            state[:live] = after
            last[t + 1, :live] = self.before.data[self.first.data[after + 1] - 1]
        # the last token of the whole, of what stands before it, and so on
        steps, at, live = [], lengths.copy(), np.arange(len(pieces))
        while len(live):
            token = last[at[live], live]
            steps.append((live, token))
            at[live] -= self.length[token]
            live = live[at[live] > 0]
        count = np.bincount(np.concatenate([rows for rows, _ in steps]), minlength=len(pieces))
        end = np.cumsum(count)
        flat = np.zeros(int(end[-1]), np.int64)
        for k, (rows, token) in enumerate(steps):
            flat[end[rows] - 1 - k] = token
        ids, end = flat.tolist(), end.tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *end], end, strict=False)]

    def _long(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one long piece, byte by byte without making states; what is certain leaves at once."""
        root, pairs = self.next[0], {}
        out: list[int] = []
        before, starts = -1, [(None, root)]  # (path, what may follow); a path is (path before, token)
        for byte in piece:
            new, grown = None, []
            for path, below in starts:
                found = below.get(byte)
                if found is None:
                    continue
                node, rank, grows = found
                if new is None and rank >= 0:
                    left = path[1] if path else before
                    fits = left < 0 or pairs.get((left, rank))
                    if fits is None:
                        fits = pairs[left, rank] = self._fits(left, rank)
                    if fits:
                        new = (path, rank)
                if grows:
                    grown.append((path, self.next[node]))
            if not grown:  # nothing older can still grow
                out += _tokens(new)
                before, new = new[1], None
            grown.append((new, root))
            starts = grown
        return (*out, *_tokens(starts[-1][0]))

    def encode_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece."""
        out: list = [(whole,) if (whole := self.ranks.get(p)) is not None else () if len(p) <= LONG else self._long(p) for p in pieces]
        todo = sorted((i for i, p in enumerate(pieces) if p and not out[i]), key=lambda i: -len(pieces[i]))
        while todo:
            if self.states > self.most:
                self._reset()
            rows, todo = todo[: max(1, BLOCK // len(pieces[todo[0]]))], todo[max(1, BLOCK // len(pieces[todo[0]])) :]
            for i, ids in zip(rows, self._run([pieces[i] for i in rows]), strict=True):
                out[i] = ids
        return out

    def encode(self, piece: bytes) -> tuple[int, ...]:
        return self.encode_all([piece])[0]


def _tokens(path: tuple | None) -> list[int]:
    out = []
    while path:
        path, one = path
        out.append(one)
    return out[::-1]


#: Texts of these characters are split by ``_PLAIN_PIECES``, which says for them what the
#: general pattern says, in the faster standard engine.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+").findall


class Encoder:
    """Whole texts to ids; remembers distinct pieces in two generations of up to ``most`` each.

    ``entry`` makes what is remembered of a piece from its ids.
    """

    def __init__(self, path: str | None = None, pattern: str | None = None, most: int = 150_000, entry: Callable[[tuple[int, ...]], object] | None = None):
        import public_tokenizers
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.pieces = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.plain = pattern is None
        self.most, self.entry = most, entry
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def entries(self, texts: list[str | None]) -> Iterator[list]:
        """What is remembered of each text's pieces, in turn; null and empty texts have none."""
        split = [() if not t else _PLAIN_PIECES(t) if self.plain and _PLAIN(t) else self.pieces(t) for t in texts]
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        new = set().union(*split).difference(self.known) if split else set()
        again = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        new = sorted(new - again)
        ids = self.transducer.encode_all([p.encode("utf-8") for p in new])
        self.known.update(zip(new, map(self.entry, ids) if self.entry else ids, strict=True))
        for pieces in split:
            yield list(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(next(iter(self.entries([text])))))


def _utf8_states() -> tuple[list[list[int]], int]:
    """(state, byte) -> state of the UTF-8 machine; 0 stands between characters, the last rejects."""
    # a state is what may come: (bytes left, least, most of the next byte)
    names, table = [(0, 0, 0)], []
    at = 0
    reject = (-1, 0, 0)

    def after(state: tuple[int, int, int], byte: int) -> tuple[int, int, int]:
        left, least, most = state
        if left == 0:
            if byte < 0x80:
                return (0, 0, 0)
            if 0xC2 <= byte <= 0xDF:
                return (1, 0x80, 0xBF)
            if 0xE0 <= byte <= 0xEF:  # no overlong forms, no surrogates
                return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
            if 0xF0 <= byte <= 0xF4:
                return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
            return reject
        if left < 0 or not least <= byte <= most:
            return reject
        return (left - 1, 0x80, 0xBF) if left > 1 else (0, 0, 0)

    while at < len(names):
        row = []
        for byte in range(256):
            state = after(names[at], byte)
            if state not in names:
                names.append(state)
            row.append(names.index(state))
        table.append(row)
        at += 1
    return table, names.index(reject)


class Decoder:
    """Streaming decoder: ids in, complete UTF-8 characters out."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.table, self.reject = _utf8_states()
        self.open = frozenset(i for i, token in tokens.items() if self._run(0, token)[0] != 0)
        self.state, self.held = 0, b""

    def _run(self, state: int, data: bytes) -> tuple[int, int]:
        """State after ``data``, and how many of its bytes end a complete character."""
        whole = 0
        for k, byte in enumerate(data):
            state = self.table[state][byte]
            if state == 0:
                whole = k + 1
        return state, whole

    def feed(self, ids: Iterable[int]) -> bytes:
        """Bytes of the characters that ``ids`` complete; the rest waits."""
        ids = ids if isinstance(ids, list) else list(ids)
        token, out, done = self.tokens.__getitem__, [], 0
        open_ = [] if self.open.isdisjoint(ids) else [i for i, one in enumerate(ids) if one in self.open]
        for at in [*open_, len(ids)]:
            if self.state and done < at:
                done = self._step(ids, done, out)
            if done < at:  # whole characters only
                out.append(b"".join(map(token, ids[done:at])))
                done = at
            if done == at < len(ids):
                done = self._step(ids, at, out)
        return b"".join(out)

    def _step(self, ids: list[int], at: int, out: list[bytes]) -> int:
        """Go on byte by byte until no character is open; the position reached."""
        while at < len(ids):
            data = self.tokens[ids[at]]
            state, whole = self._run(self.state, data)
            if state == self.reject:
                raise ValueError("the ids don't decode to UTF-8")
            if whole:
                out.append(self.held + data[:whole])
                self.held = data[whole:]
            else:
                self.held += data
            self.state = state
            at += 1
            if state == 0:
                break
        return at

    def finish(self) -> None:
        """End of the text: no character may be open."""
        held, self.state, self.held = self.state, 0, b""
        if held:
            raise ValueError("the ids end inside a character")


SCHEMA = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker((Encoder.__name__, path), lambda: Encoder(path))
        for batch in batches:
            for start, end, texts in chunks(batch, most=TEXTS):
                ids = pa.array([list(chain.from_iterable(found)) for found in encoder.entries(texts)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give an empty text; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder({i: t for t, i in read_ranks(path).items()})
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                texts.append(decoder.feed(ids or []).decode("utf-8"))
                decoder.finish()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


class _Digester(Encoder):
    """Remembers the decimal ids of a piece, the bytes they decode to, and their number."""

    def __init__(self, path: str | None = None):
        super().__init__(path, entry=self._entry)
        self.decoder = Decoder(self.transducer.tokens)
        self.text_of = {i: str(i) for i in self.transducer.tokens}.__getitem__

    def _entry(self, ids: tuple[int, ...]) -> tuple[str, bytes, int]:
        decoded = self.decoder.feed(ids)
        self.decoder.finish()
        return " ".join(map(self.text_of, ids)), decoded, len(ids)


def op8(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of what they decode to; ids never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digester = per_worker((_Digester.__name__, path), lambda: _Digester(path))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for _, _, texts in chunks(batch, most=TEXTS):
                for found in digester.entries(texts):
                    decimals, decoded, counts = zip(*found, strict=True) if found else ((), (), ())
                    for column, value in zip(rows, (sum(counts), sha(" ".join(decimals).encode()), sha(b"".join(decoded))), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), *(pa.array(r, pa.string()) for r in rows[1:])], [x.split()[0] for x in DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, DIGESTS)
