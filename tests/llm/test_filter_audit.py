"""The audit against every order walked document by document."""

import random
from itertools import permutations

import pytest

from oreloom.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, source string, quality int, toxic int, part string, total long"
LABELS = "doc_id long, quality int, toxic int, source string, flags int"


def fails(docs):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, source in docs:
        text = text or ""
        words = text.encode().split()
        yield doc_id, source or "", {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and doc_id > first[text],
        }


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows, out = list(fails(docs)), {}
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                shapley[name] += len(gone)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[name] for _, f in own) - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {(*k, *v) for k, v in out.items()}


def same(table, docs, labels):
    found = A.op12(table([(i, t, "x", s, 1, 1, "p", 9) for i, t, s in docs], DOCS), table([(i, q, t, "y", 3) for i, q, t in labels], LABELS))
    rows = found.collect()
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(rows) == len(set(map(tuple, rows))) and {tuple(r) for r in rows} == brute(docs, labels)


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "A", "a | b"]
    for _ in range(n):
        text = " ".join(r.choice(words[: r.choice([20, 400])]) for _ in range(r.choice([10, 49, 50, 80])))
        texts.append((text.upper() if r.random() < 0.2 else text) + r.choice(["", "", " #", " é", "\x0bX"]))
    return [(k, r.choice(texts), r.choice([None, "", "a", "b", "b", "b"])) for k in range(n)]


def test_table_of_first_failures():
    table = A.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and sorted(set(A.ORDERS)) == A.ORDERS
    assert table[0b10010, A.ORDERS.index("ACEDB")] == 2


def test_every_order_of_every_document(table):
    docs = corpus(300, 1)
    r = random.Random(2)
    same(table, docs, [(r.randrange(400), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(300)])


def test_odd_rows(table):
    docs = corpus(40, 3) + [(None, "a b", "a"), (None, "a b", "a"), (7, "a b", "a"), (7, "a b", "a"), (3, "a b", "b"), (8, "a b", None), (9, "w " * 100_000, "a"), (None, None, None)]
    same(table, docs, [(7, 1, 0), (7, 0, 1), (None, 1, 1), (3, None, None)])
    same(table, docs, [])


def test_empty_tables(table):
    same(table, [], [])
    same(table, [], [(1, 1, 1)])


def test_more_parts_than_a_task_holds(table, monkeypatch):
    monkeypatch.setattr(A, "PARTS_HELD", 4)
    monkeypatch.setattr(A, "ROWS_HELD", 50)
    docs = [(k, f"text {k % 17} #" * (k % 40), f"s{k % 11}") for k in range(200)]
    same(table, docs, [(k, 1, k % 2) for k in range(0, 200, 3)])


@pytest.mark.parametrize("text", ["a\x1cb", "a b", "a\x85b", "퟿", "a\x00b c"])
def test_words_end_at_ascii_white_space_only(text):
    from re import findall

    long = " ".join([text] * 60)
    words = findall(r"[^\x20\x09-\x0D]+", long)
    assert A.failures(long) & 3 == (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words))
