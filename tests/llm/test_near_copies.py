"""Near copies against all pairs."""

import random

import pytest

from oreloom.llm import near_copies

DOCS = "doc_id long, text string, cid string, key long, root string"


def shingles_of(text, size=5):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def groups_of(texts, similarity=0.8):
    sets, parent = [shingles_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus(rng):
    """Texts with copies at all similarities around the threshold, chains, and passages that many share."""
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(5)) for _ in range(400)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = line(60), [None, "", " \n", "one", "One", "a b c", "A  b\nc", "a b c d e", "a b c d e f"]
    for _ in range(25):
        words = line(rng.choice([12, 40, 150]))
        for _ in range(rng.choice([1, 2, 6])):
            some = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                some[rng.randrange(len(some))] = rng.choice(vocabulary)
            texts.append(" ".join(some))
    chain = line(100)
    for _ in range(12):  # each like the one before, the ends unlike
        chain = chain[4:] + line(4)
        texts.append(" ".join(chain))
    for _ in range(40):  # a shared passage between own words, similar to no other
        own = line(rng.choice([25, 30, 120]))
        texts.append(" ".join([*own, *passage]))
    star = line(80)
    for k in range(30):  # a group of near copies, each with a word of its own
        texts.append(" ".join([*star[:k], f"own{k}", *star[k:]]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "most", "rows"), [(1, 2048, 300_000), (2, 7, 0)])
def test_groups_equal_all_pairs(table, monkeypatch, seed, most, rows):
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", rows)  # 0: everything is joined
    texts = corpus(random.Random(seed))
    docs = table([*((i, t, "c", 1, "r") for i, t in enumerate(texts)), (11, texts[11], "c", 1, "r"), (None, texts[5], "c", 1, "r")], DOCS)
    want = groups_of(texts)
    found = near_copies.near_copies(docs, most=most).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        assert r.group == want[5 if r.doc_id is None else r.doc_id]
    kept = near_copies.keep_distinct(docs, most=most)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want)) and kept.where("doc_id is null").count() == 1


def test_likeness_short_of_the_threshold_takes_rounds(table):
    """Many texts that all pass the tests for candidates and are not similar: each pair is verified, none linked."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(24)]
    texts = [" ".join([*common, *(f"x{k}_{i}" for i in range(3))]) for k in range(25)]
    want = groups_of(texts)
    assert len(set(want)) == 25
    rng.shuffle(texts)
    found = near_copies.near_copies(table([(i, t, "c", 1, "r") for i, t in enumerate(texts)], DOCS)).collect()
    assert all(r.group == r.doc_id for r in found)


def test_nothing_and_one_text(table):
    assert near_copies.keep_distinct(table([], DOCS)).count() == 0
    assert near_copies.keep_distinct(table([(4, "only text", None, None, None)], DOCS)).count() == 1
    assert near_copies.keep_distinct(table([(i, "word " * 30_000 + "end", None, None, None) for i in range(3)], DOCS)).count() == 1


def test_keys_that_hold_the_same_texts_propose_once(spark):
    """Pairs of near copies share many keys: they left a task once a key."""
    import numpy as np
    import pyarrow as pa

    from oreloom.llm.near_copies import PARITIES, _partners, _told_apart

    rows = [(k, 1, c, 0, 100) for k in range(50) for c in range(20)] + [(k, 1, c, 0, 100) for k in (60, 61) for c in range(19)] + [(70, 1, 3, 0, 100)]
    held = spark.createDataFrame(rows, "key long, parts long, cid long, fp long, n long")
    kept = _told_apart(held)
    assert sorted(map(tuple, kept.groupBy("key").count().collect())) == [(0, 20), (60, 19), (70, 1)]

    def batches():
        for k in range(50):
            cid = np.arange(20)
            full = lambda x: pa.array(np.full(20, x))
            bits = pa.array([bytes(PARITIES // 8)] * 20, pa.binary())
            yield pa.RecordBatch.from_arrays([full(k), full(0), pa.array(cid), full(0), full(100), pa.array(cid), bits], ["key", "part", "cid", "fp", "n", "root", "bits"])

    found = pa.Table.from_batches(list(_partners(30, 0.8, 28, True)(batches())))
    assert len(found) == 20 * 19 // 2
