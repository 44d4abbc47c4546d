"""Line frequency and verdicts against brute force."""

import random
import re
from collections import Counter

import pytest

from oreloom.llm import quality

DOCS = "doc_id long, text string, source string, kept boolean, lines array<string>, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+").findall


def normal(line):
    return " ".join(WORDS(line)).lower()


def brute(rows, least=10, share=0.01, left=0.3):
    """Frequent lines of each host, and (left_words, depleted, kept) by doc_id, with plain sets."""
    hosts = {}
    for _, text, source in rows:
        lines = frozenset(normal(x) for x in (text or "").split("\n") if WORDS(x))
        hosts.setdefault(source, set()).add(lines)
    frequent = {}
    for source, documents in hosts.items():
        counts = Counter(line for lines in documents for line in lines)
        frequent[source] = {line: n for line, n in counts.items() if n >= least and n >= share * len(documents)}
    out = {}
    for doc_id, text, source in rows:
        words = WORDS(text or "")
        rest = [x for x in (text or "").split("\n") if normal(x) not in frequent[source]]
        n_left = sum(len(WORDS(x)) for x in rest)
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        base_failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        depleted = n_left < left * len(words)
        out[doc_id] = (n_left, depleted, not base_failed and not depleted)
    return frequent, out


def corpus(rng, copies):
    vocabulary = ["".join(rng.choice("abcdefÉß") for _ in range(6)) for _ in range(3000)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, doc_id = [], 0
    for source in ("h1", "h2", "", None, "=", "h5"):
        shared = [line(rng.randint(1, 12)) for _ in range(rng.choice([1, 4, 20]))]
        for _ in range(rng.choice([9, 30, 70])):
            some = [x if rng.random() < 0.8 else f"  {x.upper()}\t" for x in shared if rng.random() < rng.choice([0.3, 0.9])]
            text = "\n".join(rng.sample([*some, *(line(rng.randint(3, 15)) for _ in range(rng.randint(0, 6)))], k=len(some)) if len(some) > 6 else [*some, *(line(rng.randint(3, 15)) for _ in range(rng.randint(0, 6)))])
            for _ in range(rng.choice([1, 1, 1, copies])):
                rows.append((doc_id, text, source))
                doc_id += 1
        rows += [(doc_id, None, source), (doc_id + 1, "", source), (doc_id + 2, " \n\t\n", source)]
        doc_id += 3
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 200_000), (2, 0)])
def test_verdicts_equal_brute_force(table, monkeypatch, seed, most):
    monkeypatch.setattr(quality, "BROADCAST_LINES", most)  # 0: removed lines are joined
    rows = corpus(random.Random(seed), 25)
    docs = table([(i, t, s, False, [], 1) for i, t, s in rows], DOCS)
    frequent, want = brute(rows)
    found = quality.frequent_lines(docs).collect()
    assert Counter((r.host, r.documents) for r in found) == Counter((s, n) for s, lines in frequent.items() for n in lines.values())
    assert {r.doc_id: (r.left_words, r.depleted, r.kept) for r in quality.op5(docs).collect()} == want
    assert any(w[1] for w in want.values()) and any(w[2] for w in want.values())
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, w in want.items() if w[2]}


def test_hosts_with_many_shared_lines_lose_all_of_them(table):
    """40 hosts of 300 different documents, each with the host's 20 shared lines and 2 of its own."""
    rows = []
    for host in range(40):
        shared = [f"menu entry {k} of site {host}" for k in range(20)]
        rows += [(host * 1000 + i, "\n".join([*shared, f"own text {i} of {host}", f"second own line {i} {host}"]), f"h{host}", None, None, None) for i in range(300)]
    found = quality.frequent_lines(table(rows, DOCS)).collect()
    assert Counter((r.host, r.documents) for r in found) == {(f"h{k}", 300): 20 for k in range(40)}


def test_null_and_empty_sources_are_two_hosts(table):
    rows = [(i, f"shared line here\nown {i}", None if i % 2 else "", None, None, None) for i in range(18)]
    assert quality.frequent_lines(table(rows, DOCS)).count() == 0  # nine documents each
    rows += [(100, "shared line here\nown text", None, None, None, None)]
    assert [(r.host, r.documents) for r in quality.frequent_lines(table(rows, DOCS)).collect()] == [(None, 10)]


def test_empty_table(table):
    docs = table([], DOCS)
    assert quality.op5(docs).count() == 0 and quality.keep_good(docs).count() == 0 and quality.frequent_lines(docs).count() == 0
