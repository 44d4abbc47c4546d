"""Secrets, overlaps and redaction of span-dense texts against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from oreloom.llm import pii

DOCS = "doc_id long, text string, lang string, n_chars long, found string"


def parsed(spans):
    return [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def replaced(text, spans):
    """Brute force: a mark where a span starts outside those before it, and no character of any."""
    out, far = [], 0
    starts = {}
    for a, k, b in spans:
        if a >= far:
            starts[a] = k
        far = max(far, b)
    inside = [False] * len(text)
    for a, _, b in spans:
        for i in range(a, b):
            inside[i] = True
    for i, c in enumerate(text):
        if i in starts:
            out.append(f"<{starts[i].upper()}>")
        if not inside[i]:
            out.append(c)
    return "".join(out)


def corpus(seed, n):
    rng = random.Random(seed)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    bits = [
        "a@b.com", "joe (at) example (dot) com", "ssn 123-45-6789", "call 555-234-1234", "+1 (555) 234-1234", "4111 1111 1111 1111", "1.2.3.4", "Mr. John Smith", "word", "é🎉", "\n", "12", "-", "@",
        "123-45-6789@x.org", "x@555-234-1234.com",
    ]
    texts = []
    for _ in range(n):
        texts.append(" ".join(rng.choice(bits) if rng.random() < 0.9 else f'token = "{hexes()}"' for _ in range(rng.randint(0, 60))))
    return texts


def test_spans_and_redaction_equal_brute_force(table):
    texts = corpus(2, 300)
    docs = table([(i, t, "en", len(t), "x") for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: r for r in pii.op1(docs).collect()}
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    found = pii.candidates(docs)
    model = pii.train(found)
    names = ("start", "rank", "end", "format")
    scored = found.select("row.doc_id", F.explode("found").alias("x")).select("doc_id", *(F.col(f"x.{c}").alias(c) for c in names), pii.chosen(F.col("x"), model).alias("yes")).collect()
    want = {i: ([], []) for i in range(len(texts))}
    for r in scored:
        if r.rank < 4:
            want[r.doc_id][0].extend([(r.start, r.rank, r.end)] if r.format == 2 else [])
        elif r.yes:
            want[r.doc_id][1].append((r.start, r.rank, r.end))
    for i, text in enumerate(texts):
        base, more = want[i]
        free = [m for m in more if pii.KINDS[m[1]] == "secret" or not any(b[0] < m[2] and m[0] < b[2] for b in base)]
        spans = [(a, pii.KINDS[k], b) for a, k, b in sorted(base + free)]
        assert parsed(rows[i].spans) == spans
        assert clean[i].text == replaced(text, spans) and clean[i].n_chars == len(clean[i].text) and clean[i].found == "x"
    assert any(k == "secret" for r in rows.values() for _, k, _ in parsed(r.spans))
    assert sum(len(want[i][1]) for i in want) > sum(1 for i in want for s in parsed(rows[i].spans) if s[1] not in pii.BASE_KINDS)


def test_secrets_go_and_plain_words_stay(table):
    rng = random.Random(4)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f'some words here token = "{k}" and more', "en", 1, "x") for i, k in enumerate(keys)]
    rows += [(100 + i, f"see commit {k} of the checksum list", "en", 1, "x") for i, k in enumerate(keys[:20])]
    rows += [(200, "Donaudampfschifffahrtsgesellschaft ist ein langes Wort", "de", 1, "x"), (201, "AKIA" + "Q7ZX2PLM9KDE4RTB" + " was my access key", "en", 1, "x")]
    rows += [(202, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1 is no key", "en", 1, "x"), (203, "x" * 50_000 + "1", "en", 1, "x")]
    found = {r.doc_id: parsed(r.spans) for r in pii.op1(table(rows, DOCS)).collect()}
    assert all((25, "secret", 65) in found[i] for i in range(60)) and found[1] == [(25, "secret", 65)]
    assert not any(s[1] == "secret" for i in range(20) for s in found[100 + i]) and not found[200] and not found[202] and not found[203]
    assert [s[1] for s in found[201]] == ["secret"]


def test_dense_and_long_texts_stay_cheap(table):
    dense = "".join(f"é{i}@mail.example.com, " for i in range(16_000))
    long = ("plain words é " * 100_000) + "a@b.com" + (" more words" * 50_000)
    docs = table([(1, dense, "en", 1, "x"), (2, long, "en", 1, "x"), (3, None, None, None, None), (4, "", "", 0, "")], DOCS)
    began = time.time()
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[1] == "é<EMAIL>, " * 16_000 and out[2] == long.replace("a@b.com", "<EMAIL>") and out[3] is None and out[4] == ""
    assert time.time() - began < 60


@pytest.mark.parametrize("make", [pii.redact, pii.op1])
def test_empty_tables(table, make):
    assert make(table([], DOCS)).count() == 0
