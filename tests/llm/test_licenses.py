"""Patience alignment against brute force; coverage of altered, stretched and repeated copies."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oreloom.llm import licenses

WORDS = licenses.words_of(licenses.TEMPLATES["mit"])


@given(ys=st.lists(st.integers(0, 12), max_size=9, unique=True))
@settings(max_examples=300, deadline=None)
def test_longest_increasing_subsequence(ys):
    pairs = list(enumerate(ys))
    found = licenses._increasing(pairs)
    longest = max((len(c) for n in range(len(ys) + 1) for c in itertools.combinations(ys, n) if list(c) == sorted(c)), default=0)
    assert len(found) == longest and all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(found)) and set(found) <= set(pairs)


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return row[-1]


@given(a=st.lists(st.sampled_from("abcdefgh"), max_size=14), b=st.lists(st.sampled_from("abcdefgh"), max_size=14))
@settings(max_examples=400, deadline=None)
def test_alignments_are_common_subsequences(a, b):
    found = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(found))
    assert len(found) <= common_length(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):  # all words are anchors
        assert len(found) == common_length(a, b)


def scanned(text, name="mit"):
    return {x[0]: x for x in licenses.Scanner().scan(text)}.get(name)


@pytest.mark.parametrize("seed", range(6))
def test_coverage_of_altered_copies_is_exact(seed):
    rng = random.Random(seed)
    gone = set(rng.sample(range(len(WORDS)), rng.randint(0, len(WORDS) // 3)))
    copy = [f"zz{i}" if i in gone else w for i, w in enumerate(WORDS)]
    text = " ".join(["qq"] * 40 + copy + ["qq"] * 40)
    name, matched, words, first, last = scanned(text)
    # words that only stand elsewhere are no part of an alignment, so it is a common subsequence of nearly all that is left
    assert words == len(WORDS) and len(WORDS) - len(gone) - 3 <= matched <= common_length(copy, WORDS)
    assert first >= 40 and last < 40 + len(copy)


def test_foreign_words_do_not_hide_a_copy():
    block = " ".join([*WORDS[:40], *["foreign"] * 150, *WORDS[40:]])
    spread = " ".join(w + (" foreign other" if i % 2 else "") for i, w in enumerate(WORDS))
    for text in (block, spread, block + " " + spread):
        assert scanned(text)[1] == len(WORDS)
    stretched = " ".join(w + " foreign" * 4 for w in [*WORDS, *WORDS])  # two copies, each five times as long
    assert scanned(stretched)[1] == len(WORDS) and scanned(stretched)[4] < 5 * len(WORDS)


def test_coverage_below_the_threshold_is_reported(table):
    part = " ".join(WORDS[: int(0.7 * len(WORDS))])
    rows = {r.doc_id: r for r in licenses.scan_licenses(table([(1, part), (2, "released some time ago, " + "and " * 40 + "under the sea " + "so " * 40 + " the MIT campus"), (3, None)], "doc_id long, text string")).collect()}
    assert rows[1].license is None and rows[1].licenses == [] and abs(rows[1].coverage - int(0.7 * len(WORDS)) / len(WORDS)) < 0.02
    assert rows[2].license is None and rows[2].coverage <= 0.6 and rows[3].coverage == 0


def test_ties_go_to_the_longer_template_then_the_name():
    scanner = licenses.Scanner({"b": "one two three four", "a": "five six seven eight", "c": "one two three four nine ten"})
    assert [x[0] for x in scanner.scan("five six seven eight. one two three four nine ten")][:3] == ["c", "a", "b"]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_its_own_best(name):
    found = licenses.Scanner().scan("some text. " + licenses.TEMPLATES[name] + " more text")
    best = [x[0] for x in found if x[1] == x[2]]
    assert name in best and (found[0][0] == name or licenses.TEMPLATES[found[0][0]] in licenses.TEMPLATES[name])
