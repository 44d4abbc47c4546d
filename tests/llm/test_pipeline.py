"""The pipeline's stages on odd tables, and the whole against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+").findall


@pytest.mark.parametrize("stage", range(4))
def test_stages_of_nothing_and_of_odd_rows(spark, table, stage):
    _, run = corpus_pipeline.STAGES[stage]
    empty = run(spark, table([], DOCUMENTS), "")
    assert empty.columns == [c.split()[0] for c in DOCUMENTS.split(", ")] and empty.count() == 0
    names = DOCUMENTS + ", row string, kept boolean, key long, cid long, found string, base string, cleaned string, score double, group string"
    extra = ("r", True, 1, 2, "f", "b", "c", 0.5, "g")
    rows = [(None, None, None, None, None, *extra), (1, None, None, None, 0, *extra), (2, "", "en", "", 0, *extra), (2, "", "en", "", 0, *extra), (3, "x" * 100_000, None, "s", None, *extra), (None, "a b c", "en", "s", 5, *extra)]
    out = run(spark, table(rows, names), "")
    assert out.columns == [c.split()[0] for c in names.split(", ")]
    assert all(tuple(r)[5:] == extra for r in out.collect())


def shingles(text):
    words = WORDS("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_hand(rows):
    """Ids and texts that quality and near-dedup keep, by plain loops over all pairs."""
    normal = lambda line: " ".join(WORDS(line)).lower()
    hosts = {}
    for _, text, _, source, _ in rows:
        hosts.setdefault(source, set()).add(frozenset(normal(x) for x in text.split("\n") if WORDS(x)))
    frequent = {s: {x for x, n in Counter(x for d in ds for x in d).items() if n >= 10 and n >= 0.01 * len(ds)} for s, ds in hosts.items()}
    good = []
    for doc_id, text, _, source, _ in rows:
        words = WORDS(text)
        rest = "\n".join(x for x in text.split("\n") if normal(x) not in frequent[source])
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words) and len(WORDS(rest)) >= 0.3 * len(words):
            good.append((doc_id, rest))
    root = {i: i for i, _ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t) for i, t in good}
    for i, _ in good:
        for j, _ in good:
            if j < i and (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: t for i, t in good if find(i) == i}


def test_the_whole_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    parts = {"aa": ["the", "ing", "and", "er", "wh", "on"], "bb": ["sch", "ung", "ein", "ü", "keit", "der"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(2, 5)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows, notice = [], {"aa": line("aa", 9), "bb": line("bb", 9)}
    for i in range(150):
        lang = "aa" if i % 3 else "bb"
        text = "\n".join([*(line(lang, 12) for _ in range(rng.choice([2, 6, 9]))), *([notice[lang]] if i % 2 else [])])
        rows.append((i, text, lang, f"host {i % 2}", len(text)))
    for i in range(150, 220):  # copies, nearly all of them near
        _, text, lang, source, _ = rows[rng.randrange(150)]
        words = text.split(" ")
        for _ in range(rng.choice([0, 1, 3, 12])):
            words[rng.randrange(len(words))] = word(lang)
        rows.append((i, " ".join(words), lang, source, 1))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    want = kept_by_hand(rows)
    assert 100 < len(want) < 200
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    crc = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in want.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == crc and len(got) == len(crc)
