"""Ids of the public lower-casing word tokenizer, with a bounded cache of words.

The tokenizer normalises (NFC, white space, lower case), splits into words, digits and
symbol runs, and encodes each on its own.  For texts of ASCII and Latin-1 letters those
steps are local, so words can be split here and looked up; any other text goes whole to
the library.  Both ways give the library's ids.

``special`` says what becomes of a special token's own text (``<|endoftext|>``): with it,
that token's id, as the library's defaults have it, without it plain text.
"""

from __future__ import annotations

import re

import numpy as np

#: Texts for which splitting here equals the tokenizer's own: no character outside these.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall


class WordEncoder:
    """``encode_bytes(texts)``: each text's ids as little-endian unsigned 32-bit integers.

    Words are remembered in two generations of up to ``most_words`` each.
    """

    def __init__(self, path: str | None = None, most_words: int = 120_000, special: bool = False):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.tokenizer.encode_special_tokens = not special
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()}) if special else []
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = most_words

    def _learn(self, words: list[str]) -> None:
        """Encode unknown words together and cut the ids at word ends."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            edges = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(edges) == len(part) and edges[-1] == len(ids):
                raw = ids.tobytes()
                self.cache.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip([0, *edges], edges, strict=False)), strict=True))
            else:  # some word doesn't end in an end token
                for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.cache[word] = np.array(e.ids, "<u4").tobytes()

    def _words(self, text: str | None) -> list[str] | None:
        """Words of a text that may be split here, else None."""
        if not text or not _PLAIN(text):
            return None
        low = text.lower()
        return None if any(t in low for t in self.special) else _WORDS(low)

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        split = list(map(self._words, texts))
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        unknown = set().union(*(s for s in split if s)).difference(self.cache)
        again = unknown.intersection(self.older)
        self.cache.update((w, self.older[w]) for w in again)
        if unknown := unknown - again:
            self._learn(sorted(unknown))
        out, known = [], self.cache.__getitem__
        for text, words in zip(texts, split, strict=True):
            if words is not None:
                out.append(b"".join(map(known, words)))
            elif text:
                ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                out.append(np.array(ids, "<u4").tobytes())
            else:
                out.append(b"")
        return out
