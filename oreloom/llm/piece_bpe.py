"""Pieces of the public byte-fallback BPE model by vectorised merge rounds, and decoding.

A text becomes ``▁`` + text with spaces as ``▁``, and words: no piece holds ``▁`` behind
another character, nor a character that is in no longer piece together with others, so no
merge crosses there.  Words that a worker hasn't met are merged together, as one flat array
of symbols.  A round takes each word's least pair rank (``np.minimum.reduceat``), merges all
its pairs of that rank from the left, without overlap, and compacts the arrays; a word without
pairs is done.  In words of over ``LONG`` symbols a pair counts as least if none within the
longest piece's length on either side is lower, so that rounds don't grow with the word.

The library merges one pair at a time, the best first, the left one of equals.  Rounds give the
same unless a merge makes a pair as good as itself or better, which the sequence would take
before the round's other merges to the right.  Each merge's new pairs are looked up before the
round is applied; where one is as good, the merges behind it in the word wait for the next round
(in long words those behind it as far as merges follow each other within the longest piece's
length, which is as far as one can matter to another).

Runs of ``▁`` all rank alike in the vocabulary at hand and below every other piece, so a run is cut
into longest ones from the left beforehand, as the sequence would (held against it when a model
is read).

What is assumed of a model (no normalisation beyond spaces, a leading ``▁``, byte fallback, words
as said) is checked when it is read; another kind of model is refused.

Decoding looks ids up in a table of byte strings; bytes of byte pieces that form no character
become U+FFFD, one each; the end id and the other control ids give nothing, and the
first piece's leading ``▁`` goes.

Defined cases: null text is empty; an empty text is the end id alone and decodes to nothing; very
long texts are read whole, a bounded number of characters of unknown words at once; repeated rows
are encoded each; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import chunks, per_worker, released

SPACE = "▁"
LONG = 64
#: Symbols that are merged together, and words remembered in each of two generations.
TOGETHER = 200_000
WORDS = 100_000
#: Longer words are not remembered.
WORD_CHARS = 64

_NONE = np.iinfo(np.int32).max


class PieceModel:
    """Vocabulary of a model: pair table, ranks, byte pieces and what ids decode to."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.size, self.end, self.unknown = library.get_piece_size(), library.eos_id(), library.unk_id()
        names = [library.id_to_piece(i) for i in range(self.size)]
        own = [i for i in range(self.size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.ids = {names[i]: i for i in own}
        longer = [p for p in self.ids if len(p) > 1]
        self.inner = set("".join(longer))
        self.byte_of = {i: int(names[i][3:5], 16) for i in range(self.size) if library.is_byte(i)}
        bytes_at = {b: i for i, b in self.byte_of.items()}
        runs = [p for p in longer if not p.strip(SPACE)]
        self.longest_run = max(map(len, runs), default=1)
        scores = {p: library.get_score(i) for p, i in self.ids.items()}
        if (
            len(bytes_at) != 256 or any(SPACE in p[1:] for p in longer if p not in runs) or len({scores[p] for p in runs}) > 1
            or any(scores[p] <= scores[runs[0]] for p in longer if p not in runs and runs)
        ):
            raise ValueError("this model's words can't be told by spaces, or it has no byte pieces")

        # symbols: ids of pieces; beyond, code points that are no pieces
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        of = lambda p: self.ids.get(p) if len(p) > 1 else int(self.symbol[ord(p)])
        rank_of = {s: k for k, s in enumerate(sorted({scores[p] for p in longer}, reverse=True))}
        table = {}
        for p in longer:
            for cut in range(1, len(p)):
                left, right = of(p[:cut]), of(p[cut:])
                if left is not None and right is not None:
                    table[left << 32 | right] = (rank_of[scores[p]], self.ids[p])
        keys = np.array(sorted(table), np.int64)
        self.pairs = keys
        self.ranks = np.array([table[k][0] for k in keys.tolist()] + [_NONE], np.int32)
        self.merged = np.array([table[k][1] for k in keys.tolist()] + [0], np.int32)
        self.reach = max(map(len, longer), default=1)

        self.char_ids = {}
        self.bytes_at = bytes_at
        control = {i for i in range(self.size) if library.is_control(i)}
        shown = lambda i: b"" if i in control else bytes([self.byte_of[i]]) if i in self.byte_of else library.decode([i]).encode() if i == self.unknown else names[i].replace(SPACE, " ").encode()
        self.shown = list(map(shown, range(self.size)))
        self.decimal = [str(i).encode() for i in range(self.size)]
        self.words = re.compile(f" {{{self.longest_run}}}(?= )| {{1,{self.longest_run}}}[{self._class()}]*|[{self._class()}]+|[^ {self._class()}]+").findall
        self._check(library)

    def _class(self) -> str:
        return re.escape("".join(sorted(self.inner - {SPACE})))

    def _check(self, library) -> None:
        merger = Merger(self)
        alone = lambda n: merger.merge(self.symbol[np.full(n, ord(SPACE))], np.zeros(n, np.int64))[1].tolist()
        longest = alone(self.longest_run)
        if len(longest) > 1 or any(alone(self.longest_run + n) != longest + (alone(n) if n else []) for n in range(self.longest_run + 1)):
            raise ValueError("this model's runs of spaces aren't cut from the left")
        for text in ("", " ", "a  b ", " \tAÅﬁ①\n", f"{SPACE}x{SPACE}{SPACE}", "Å" + " " * 40 + "é", "<s>\x00​"):
            found = merger.encode([text])[0].tolist()
            if found + [self.end] != library.encode(text, add_eos=True) or self.decode(found) != library.decode(found).encode():
                raise ValueError("this model normalises texts in another way")

    def bytes_of(self, char: int) -> list[int]:
        """Byte pieces of a code point that is no piece."""
        return [self.bytes_at[b] for b in chr(char).encode("utf-8", "surrogatepass")]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of what the ids stand for."""
        found = b"".join(map(self.shown.__getitem__, ids))
        try:
            found.decode()
        except UnicodeDecodeError:
            parts, held = [], bytearray()
            for i in [*ids, self.end]:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                parts += [*_characters(bytes(held)), self.shown[i]]
                held.clear()
            found = b"".join(parts)
        first = next((i for i in ids if self.shown[i]), None)  # bytes and the unknown piece keep their blanks
        return found[1:] if first is not None and first not in self.byte_of and first != self.unknown and found.startswith(b" ") else found


def _characters(raw: bytes) -> Iterator[bytes]:
    """The characters of a run of bytes; a byte that begins none is U+FFFD."""
    at = 0
    while at < len(raw):
        for n in range(1, 5):
            part = raw[at : at + n]
            try:
                part.decode()
            except UnicodeDecodeError:
                continue
            break
        else:
            part, n = "�".encode(), 1
        yield part
        at += n


class Merger:
    """``encode(texts)``: each text's ids, without the end id."""

    def __init__(self, model: PieceModel, words: int = WORDS):
        self.model, self.most = model, words
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the pair table; the last one for pairs that are no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.model.pairs, key)
        at[at == len(self.model.pairs)] = 0
        return np.where(self.model.pairs[at] == key, at, len(self.model.pairs))

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and their words; ``word`` ascends, before and after."""
        ranks, merged, none = self.model.ranks, self.model.merged, len(self.model.pairs)
        out = [(word[:0], symbols[:0])]
        pair = np.full(len(symbols), none)
        pair[:-1] = self._pairs(symbols[:-1], symbols[1:])
        pair[:-1][word[:-1] != word[1:]] = none
        while len(symbols):
            rank = ranks[pair]
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(start, len(word)))
            least = np.minimum.reduceat(rank, start)
            going = least != _NONE
            if not going.all():
                stay = np.repeat(going, count)
                out.append((word[~stay], symbols[~stay]))
                symbols, word, pair, rank = symbols[stay], word[stay], pair[stay], rank[stay]
                least, count = least[going], count[going]
                if not len(symbols):
                    break
            limit = np.repeat(least, count)
            if count.max() > LONG:
                wide = np.repeat(count > LONG, count)
                limit[wide] = self._around(rank)[wide]
            at, new = self._chosen(pair, rank, (rank == limit) & (rank != _NONE))
            # what each merge finds beside it: its predecessor's result or the symbol on its left, the symbol on its right
            last, size = np.append(-9, at[:-1]), len(symbols)
            left_at, right_at = np.maximum(at - 1, 0), np.minimum(at + 2, size - 1)
            left = np.where(last == at - 2, np.append(0, new[:-1]), symbols[left_at])
            left_pair = np.where((at > 0) & (word[left_at] == word[at]), self._pairs(left, new), none)
            right_pair = np.where((at + 2 < size) & (word[right_at] == word[at]), self._pairs(new, symbols[right_at]), none)
            bad = np.minimum(ranks[left_pair], ranks[right_pair]) <= rank[at]
            if bad.any():  # the sequence would go on with the new pair: what is to the right and near waits
                own, wide = word[at], np.repeat(count > LONG, count)[at]
                group = np.cumsum((own != np.append(-1, own[:-1])) | (wide & (at - last > self.model.reach + 2)))
                before = np.cumsum(bad) - bad
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                go = before == before[first][group - 1]
                at, new, left_pair, right_pair = at[go], new[go], left_pair[go], right_pair[go]
            symbols[at] = new
            inside = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
            stay = np.ones(size, bool)
            stay[at + 1] = False
            symbols, word, pair = symbols[stay], word[stay], pair[stay]
            at -= np.arange(len(at))  # each earlier merge has taken a symbol away
            pair[at] = right_pair
            pair[at[inside] - 1] = left_pair[inside]
        word, symbols = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        order = np.argsort(word, kind="stable")
        return word[order], symbols[order]

    def _chosen(self, pair: np.ndarray, rank: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the round's merges and what they make: of pairs of one rank that overlap, every other, from the left.

        In a run of such pairs one counts only if all before it do.
        """
        at = np.flatnonzero(least)
        begins = (at == 0) | (rank[np.maximum(at - 1, 0)] != rank[at])
        head = np.maximum.accumulate(np.where(begins | np.append(True, np.diff(at) != 1), np.arange(len(at)), 0))
        at = at[begins[head] & ((np.arange(len(at)) - head) % 2 == 0)]
        return at, self.model.merged[pair[at]]

    def _around(self, rank: np.ndarray) -> np.ndarray:
        """Least rank within the longest piece's length on either side."""
        low, width = rank.copy(), 1
        while width <= self.model.reach:  # windows of the next ``width`` places, doubling
            step = min(width, self.model.reach + 1 - width)
            if not step:
                break
            low[:-step] = np.minimum(low[:-step], low[step:].copy())
            width += step
        both = low.copy()
        both[self.model.reach :] = np.minimum(low[self.model.reach :], low[: -self.model.reach] if self.model.reach < len(low) else low[:0])
        for k in range(1, min(self.model.reach, len(low))):  # the first places have shorter windows to their left
            both[k] = min(both[k], rank[:k].min())
        return both

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words, as little-endian 32-bit integers."""
        model = self.model
        text = "".join(words).replace(" ", SPACE)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = model.symbol[chars]
        count = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), count)
        word, symbols = self.merge(symbols, word)
        odd = np.flatnonzero(symbols >= model.size)
        if len(odd):
            chars, inverse = np.unique(symbols[odd] - model.size, return_inverse=True)
            ids = [model.bytes_of(c) for c in chars.tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[odd] = np.array([len(i) for i in ids])[inverse]
            start = np.cumsum(sizes) - sizes
            word, symbols = np.repeat(word, sizes), np.repeat(symbols, sizes)
            for k in range(4):
                some = np.array([i[k] if k < len(i) else -1 for i in ids], np.int32)[inverse]
                symbols[start[odd][some >= 0] + k] = some[some >= 0]
        ends = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        raw = symbols.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        found, start, total = {}, 0, 0
        for k, word in enumerate(words):
            total += len(word)
            if total >= TOGETHER or k + 1 == len(words):
                part = words[start : k + 1]
                found.update(zip(part, self._merged(part), strict=True))
                start, total = k + 1, 0
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.model.words(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        words = set().union(*split)
        known = {w: found for w in words if (found := self.cache.get(w) or self.older.get(w))}
        new = self._learn(sorted(words.difference(known)))
        known.update(new)
        self.cache.update((w, ids) for w, ids in known.items() if len(w) <= WORD_CHARS)
        return [np.frombuffer(b"".join(map(known.__getitem__, s)), "<i4") for s in split]


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every text, the end id last; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, ids, merger in _encoded(batches, path):
            decoded = [merger.model.decode(i.tolist()).decode() for i in ids]
            ids = [np.append(i, merger.model.end).astype(np.int32) for i in ids]
            yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return _read(docs).mapInArrow(lambda batches: released(run(batches)), "doc_id long, ids array<int>, decoded string")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[tuple[pa.Array, list[np.ndarray], Merger]]:
    merger = per_worker((Merger.__name__, path), lambda: Merger(PieceModel(path)))
    for batch in batches:
        for start, end, texts in chunks(batch):
            yield batch.column(0).slice(start, end - start), merger.encode(texts), merger


def op13(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, found, merger in _encoded(batches, path):
            n, ids_sha, decoded_sha = [], [], []
            decimal, end = merger.model.decimal, merger.model.end
            for ids in found:
                ids = [*ids.tolist(), end]
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                decoded_sha.append(hashlib.sha256(merger.model.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _read(docs).mapInArrow(lambda batches: released(run(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
