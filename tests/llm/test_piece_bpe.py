"""Ids and texts against the library, on texts made to break the order of merges."""

import hashlib
import random
import time

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from oreloom.llm import piece_bpe as P


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def merger():
    return P.Merger(P.PieceModel())


def same(library, merger, texts):
    for text, found in zip(texts, merger.encode(texts), strict=True):
        want = library.encode(text)
        assert found.tolist() == want, text[:200]
        assert merger.model.decode(want + [merger.model.end]).decode() == library.decode(want), text[:200]


def test_texts_of_pieces_and_letters(library, merger):
    r = random.Random(1)
    names = [library.id_to_piece(i) for i in range(259, 32_000)]
    for most in (300, 3000, len(names)):
        same(library, merger, ["".join(r.choice(names[:most]) for _ in range(r.randint(0, 40))) for _ in range(1500)])
    same(library, merger, ["".join(r.choice("abcdeinrst ") for _ in range(r.randint(0, 60))) for _ in range(1500)])


def test_spaces_and_repeats(library, merger):
    r = random.Random(2)
    same(library, merger, [" " * n for n in range(120)] + [" " * n + "the" for n in range(60)] + ["a" + " " * n + "\n" for n in range(60)])
    same(library, merger, [r.choice("aeo-=*_.x") * r.randint(1, 700) + r.choice(["", "the", "é"]) for _ in range(800)])
    same(library, merger, ["".join(r.choice([" ", "  ", "a", "\n", " " * r.randint(1, 50), "▁"]) for _ in range(30)) for _ in range(800)])


def test_long_words(library, merger):
    """Words of over LONG symbols are merged by windows."""
    r = random.Random(3)
    names = [library.id_to_piece(i).replace("▁", "") for i in range(259, 900)]
    same(library, merger, ["".join(r.choice(names) for _ in range(r.randint(30, 900))) for _ in range(300)])
    same(library, merger, ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(60, 3000))) for _ in range(200)])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, merger, text):
    same(library, merger, [text.encode("utf-8", "replace").decode()])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 258)), max_size=14))
def test_any_ids_decode_as_the_library_does(library, merger, ids):
    assert merger.model.decode(ids).decode() == library.decode(ids)


def test_time_grows_with_the_text(merger):
    r = random.Random(4)
    for make in (lambda n: "ab" * (n // 2), lambda n: " " * n, lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), lambda n: "intheer" * (n // 7)):
        took = []
        for n in (100_000, 400_000):
            start = time.perf_counter()
            merger.encode([make(n)])
            took.append(time.perf_counter() - start)
        assert took[1] < 12 * took[0] + 0.5


def test_few_remembered_words_change_nothing(library, merger):
    own = P.Merger(merger.model, words=3)
    for text in ("one two three four five six", "six seven one", "one two nine ten eleven", "", "one"):
        same(library, own, [text, text + " again"])


def test_table_of_odd_rows(library, table):
    texts = [None, "", " ", "plain words", "plain words", "<s>x</s><unk><0x41>", "é\x00\U0001f600 ▁", "word " * 50_000, "你好" * 5000, "q" * 70_000]
    rows = [(k if k != 3 else None, t, "x", 7, "y") for k, t in enumerate(texts)]
    found = P.op13(table(rows, "doc_id long, text string, ids_sha256 string, n_tokens int, lang string"))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        row = got[doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    again = {r.doc_id: r for r in P.encode_pieces(table(rows, "doc_id long, text string, ids string, n int, decoded string")).collect()}
    assert all(again[i].ids == library.encode(t or "", add_eos=True) and again[i].decoded == library.decode(again[i].ids) for i, t, *_ in rows)
    assert P.op13(table([], "doc_id long, text string")).count() == 0


def test_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: library.encode(r.text or "", add_eos=True) for r in docs.select("doc_id", "text").collect()}
    got = P.op13(docs).collect()
    assert len(got) == len(want) == 1000
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest() for r in got)
    assert all(r.decoded_sha256 == hashlib.sha256(library.decode(want[r.doc_id]).encode()).hexdigest() for r in got)


def test_other_kinds_of_models_are_refused(monkeypatch):
    monkeypatch.setattr("sentencepiece.SentencePieceProcessor.is_byte", lambda self, i: False)
    with pytest.raises(ValueError):
        P.PieceModel()
