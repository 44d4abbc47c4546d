"""The recurrent network against a naive pass, byte by byte."""

import math
import random

import numpy as np

from oreloom.llm import language

DOCS = "doc_id long, text string, lang string, row string, score double"


def gru(model, side, data):
    """States over bytes, one number at a time."""
    h, w = model.hidden, model.weights
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    state, out = [0.0] * h, []
    for byte in data:
        x = w[f"in_{side}"][byte]
        u = [sum(state[i] * w[f"re_{side}"][i][j] for i in range(h)) for j in range(3 * h)]
        z = [sigmoid(x[j] + u[j]) for j in range(h)]
        r = [sigmoid(x[h + j] + u[h + j]) for j in range(h)]
        n = [math.tanh(x[2 * h + j] + r[j] * (u[2 * h + j] + w[f"c_{side}"][j])) for j in range(h)]
        state = [n[j] + z[j] * (state[j] - n[j]) for j in range(h)]
        out.append(state)
    return out


def naive_sums(model, data, core, warm):
    """Sums over a text cut between characters into windows, each warmed up on either side."""
    k, cuts = len(model.languages), [0]
    while (at := len(cuts) * (core - 3)) < len(data):
        while data[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    out = [0.0] * (2 * k) + [len(data)]
    for a, b in zip(cuts, [*cuts[1:], len(data)]):
        lo, hi = max(0, a - warm), min(len(data), b + warm)
        forward, backward = gru(model, "f", data[lo:b])[a - lo :], gru(model, "b", data[a:hi][::-1])[::-1]
        for p in range(b - a):
            both = [*forward[p], *backward[p]]
            scores = [sum(both[i] * model.weights["out"][i][c] for i in range(len(both))) + model.weights["bias"][c] for c in range(k)]
            total = math.log(sum(map(math.exp, scores)))
            for c in range(k):
                out[c] += scores[c] - total
                out[k + c] += math.exp(scores[c] - total)
    return out


def test_sums_equal_a_naive_pass(monkeypatch):
    monkeypatch.setattr(language, "CORE", 24)
    monkeypatch.setattr(language, "WARM", 7)
    rng = np.random.default_rng(3)
    model = language.ByteGRU(["a", "b", "c"], hidden=4)
    model.weights = {k: v + 0.5 * rng.normal(size=v.shape) for k, v in model.weights.items()}
    for text in ("a", "short words here", "日本語の文章には空白がありません。" * 4, "x" * 100, "naïve café " * 9, "é" * 31):
        data = text.encode()
        assert np.allclose(model.sums([data])[0], naive_sums(model, data, 24, 7), atol=1e-9)


def test_side_by_side_texts_do_not_mix():
    model = language.ByteGRU(["a", "b"], hidden=4)
    texts = [b"one text", b"another one that is longer", b"x", b"and " * 700]
    alone = np.concatenate([model.sums([t]) for t in texts])
    assert np.allclose(model.sums(texts), alone, rtol=1e-5)


def test_state_crosses_words():
    model = language.ByteGRU(["a", "b"], hidden=4)
    assert not np.allclose(model.sums([b"ab cd"])[0, :4] + model.sums([b" ef"])[0, :4], model.sums([b"ab cd ef"])[0, :4], atol=1e-7)


def test_runs_hold_every_byte_and_whole_characters():
    text = "añ🎉日" * 100 + "x" * 500
    parts = language.runs(text)
    assert b"".join(parts) == text.encode() and all(0 < len(p) <= language.RUN and p.decode() for p in parts)


def test_languages_without_spaces_and_long_words(table):
    rng = random.Random(2)
    kana, han = "あいうえおかきくけこさしすせそ", "的一是不了人我在有他这中大来上"
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, text((kana, han, "abcdefghij")[i % 3], 400), ("ja", "zh", "xx")[i % 3], "r", 0.5) for i in range(90)]
    rows += [(500, text(han, 30_000), None, "r", None), (501, text("abcdefghij", 100_000), None, "r", None)]
    found = {r.doc_id: r.lang_pred for r in language.op9(table(rows, DOCS)).collect()}
    assert all(found[i] == ("ja", "zh", "xx")[i % 3] for i in range(90)) and found[500] == "zh" and found[501] == "xx"
    kept = language.keep_known(table(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "row", "score"] and kept.count() == 92
    assert language.keep_known(table([], DOCS)).count() == 0


def test_windows_change_no_language_of_long_texts(spark):
    """Against one pass over each whole text, its state carried from end to end, for real documents of over 5,000 bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    texts = [r.text for r in docs.where("length(text) > 5000 and lang is not null").orderBy("doc_id").limit(24).collect()]
    assert len(texts) == 24
    k, largest = len(model.languages), 0.0
    for text, (lang, score) in zip(texts, language.predict(model, texts)):
        codes = np.frombuffer(text.encode(), np.uint8)[None]
        both = np.concatenate([model._states(codes, "f"), model._states(codes[:, ::-1], "b")[::-1]], axis=2)[:, 0]
        scores = both @ model.weights["out"] + model.weights["bias"]
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = int(np.log(odds).sum(axis=0).argmax())
        assert model.languages[best] == lang and k > 1
        largest = max(largest, abs(float(odds[:, best].mean()) - score))
    assert largest < 0.002, largest


def test_training_runs_are_bounded(table, monkeypatch):
    rng = random.Random(4)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, text(("abcdefgh ", "opqrstuv ")[i % 2], 400_000 if i == 4 else 300), "xy"[i % 2], "r", 0.5) for i in range(60)]
    docs, held = table(rows, DOCS), []
    real = language.ByteGRU.fit
    monkeypatch.setattr(language.ByteGRU, "fit", lambda self, pieces, labels, **how: held.append((len(pieces), labels.tolist())) or real(self, pieces, labels, **how))
    monkeypatch.setattr(language, "RUNS", 150)
    model = language.train(docs)
    n, labels = held[0]
    assert 200 <= n <= 400 and labels.count(0) < 250  # the text of 400,000 bytes alone has over 4,000
    assert [language.predict(model, [r[1]])[0][0] for r in rows[:20]] == [r[2] for r in rows[:20]]
