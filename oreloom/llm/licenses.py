"""License texts in documents by patience alignment.

Method: words of the text and of a template are aligned on words that occur once in
either; the longest increasing subsequence of those anchors is kept, and the gaps between
anchors are aligned in turn, equal words at their ends included.  The alignment is cut
where more than ``GAP`` template lengths of text lie between two aligned words, which parts
repeated copies and words that only happen to stand in order; coverage is the share of the
template's words in its largest part, however long that part is in the text.

Where a gap has no word that occurs once (a license that stands twice in a text has none),
windows around each occurrence of the template's rarest words are tried too, best first by
shared words, and the best aligned one counts.  Of n template places, a copy with coverage
c misses at most floor((1 - c) n), so windows around one more place than that leave no copy
out.  Windows count the template's words only, so what else a text puts between them has no
bearing; of those they reach half a template, and a whole one, beyond the copy.

``coverage`` is the best of all templates, also where it misses the threshold ``COVERAGE``
and the license is null.  A template of whose words the whole text has under ``REPORT``
(counted with repeats) can't reach that share; it is passed over and counts as 0.

Defined cases: null, empty and blank texts have no license and coverage 0; very long
texts are read whole; among equal coverages the longer template wins, then the name first
in order; of equal copies the first counts; repeated rows are scanned alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import chunks

COVERAGE = 0.8
#: Share of a template's words that a text must have at all to be aligned with it.
REPORT = 0.5
#: Template lengths of text between two aligned words of one copy.
GAP = 2
#: Clauses that licenses share (fixed values: public license wordings).
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
_ISC_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)
_GNU_REST = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along "
    "with this program. If not, see https://www.gnu.org/licenses/."
)
#: Template texts (fixed values: public license wordings).  Those of a grant alone find texts that leave the rest away.
TEMPLATES = {
    "agpl-3.0-notice": _GNU.format("Affero ") + _GNU_REST.format("Affero "),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": _BSD + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD + _BSD_NAMES + _BSD_DISCLAIMER,
    "bsd-disclaimer": _BSD,
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-full-notice": _GNU.format("") + _GNU_REST.format(""),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": _GNU.format(""),
    "isc": _ISC,
    "isc-full": _ISC + _ISC_DISCLAIMER,
    "lgpl-3.0-notice": _GNU.format("Lesser ") + _GNU_REST.format("Lesser "),
    "mit": _MIT,
    "mit-full": _MIT + _MIT_DISCLAIMER,
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act "
        "of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
}
_WORDS = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*").findall


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first number, whose second numbers rise."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists by patience."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    """Coverage of each template by a text."""

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.least = coverage
        self.templates = {name: words_of(text) for name, text in (templates or TEMPLATES).items()}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.vocabulary = frozenset().union(*self.templates.values())

    @staticmethod
    def _part(own: list[tuple[int, str]], template: list[str]) -> list[tuple[int, int]]:
        """Largest part of the alignment of (position, word) pairs, as (position, template place)."""
        best: list[tuple[int, int]] = []
        part: list[tuple[int, int]] = []
        for i, j in align([w for _, w in own], template):
            if part and own[i][0] - part[-1][0] > GAP * len(template):
                part = []
            part.append((own[i][0], j))
            if len(part) > len(best):
                best = part
        return best

    @staticmethod
    def _shared(own: list[tuple[int, str]], need: Counter, windows: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """Template words that each window holds, repeats as often as the template has them; windows go forward at both ends."""
        counts, total, a, b, out = Counter(), 0, 0, 0, {}
        for lo, hi in windows:
            while b < hi:
                word = own[b][1]
                counts[word] += 1
                total += counts[word] <= need[word]
                b += 1
            while a < lo:
                word = own[a][1]
                total -= counts[word] <= need[word]
                counts[word] -= 1
                a += 1
            out[lo, hi] = total
        return out

    def _best(self, text: list[tuple[int, str]], name: str) -> list[tuple[int, int]]:
        """Best aligned copy of a template in (position, word) pairs."""
        template, need = self.templates[name], self.counts[name]
        own = [(p, w) for p, w in text if w in need]
        n, best, have = len(template), self._part(own, template), Counter(w for _, w in own)
        if len(best) == sum((have & need).values()):
            return best
        # a copy over the threshold misses fewer template places than these, so it holds one of them
        places: dict[str, list[int]] = {}
        for at in sorted(range(n), key=lambda at: (have[template[at]], at))[: n - ceil(self.least * n - 1e-9) + 1]:
            places.setdefault(template[at], []).append(at)
        begins = sorted({k - at for k, (_, w) in enumerate(own) for at in places.get(w, ())})
        shared: dict[tuple[int, int], int] = {}
        for slack in (n // 2, n):
            shared |= self._shared(own, need, [(max(0, k - slack), min(len(own), k + n + slack)) for k in begins])
        for lo, hi in sorted((x for x in shared if shared[x] >= self.least * n), key=lambda x: (-shared[x], x)):
            if shared[lo, hi] <= len(best):
                break
            best = max(best, self._part(own[lo:hi], template), key=len)
        return best

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(name, aligned words, template words, first and last word position) of each template aligned, best first."""
        own = [(i, w) for i, w in enumerate(words_of(text)) if w in self.vocabulary] if text else []
        have, out = Counter(w for _, w in own), []
        for name, template in self.templates.items():
            if own and sum(min(n, have[w]) for w, n in self.counts[name].items()) >= REPORT * len(template):
                if found := self._best(own, name):
                    out.append((name, len(found), len(template), found[0][0], found[-1][0]))
        return sorted(out, key=lambda x: (-x[1] / x[2], -x[2], x[0]))


SCHEMA = "doc_id long, license string, coverage double, matched_words long, template_words long, start_word long, end_word long, licenses array<string>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: its best covered template, its license if that reaches the threshold, and the names of all that do; map-only."""
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), *((c, pa.int64()) for c in ("matched_words", "template_words", "start_word", "end_word")), ("licenses", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            rows = []
            for _, _, texts in chunks(batch):
                for found in map(scanner.scan, texts):
                    name, matched, words, first, last = found[0] if found else (None, 0, None, None, None)
                    over = [x[0] for x in found if x[1] >= coverage * x[2]]
                    rows.append((name if over else None, matched / words if words else 0.0, matched, words, first, last, over))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)] if rows else [pa.array([], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)
