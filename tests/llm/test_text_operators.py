"""PII, licenses, quality, near copies, language, urls, vectors against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oreloom.llm import kmeans_tree, language, licenses, pii, quality, simhash, urls

DOCS = "doc_id long, text string, source string, lang string, kept string, row string, score double"


def make(table, rows):
    """(doc_id, text, source, lang) rows with columns named like results."""
    return table([(i, t, s, lang, "k", "r", 0.5) for i, t, s, lang in rows], DOCS)


# --- PII (op1) ---


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_equal_brute_force(table):
    rng = random.Random(5)
    bits = ["1", "2", "45", "0", ".", ".", " ", "-", "+", "@", "a", "(", ")", "_", "é", "🎉", "4111111111111111", "a@b.c", "+1 (555) 555-1234", "\n", "1.2.3.4"]
    texts = [None, "", "x", *("".join(rng.choice(bits) for _ in range(rng.choice([5, 30, 300]))) for _ in range(250)), "a.b@c.d " * 600, "1" * 3000, "a@" + "b." * 3000 + "c"]
    docs = make(table, [*((i, t, "s", "en") for i, t in enumerate(texts)), (3, texts[3], "s", "en"), (None, "a@b.cd", None, None)])
    rows = pii.op1(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = base_spans(texts[r.doc_id] or "") if r.doc_id is not None else "email:0:6"
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert r.n_email == want.count("email:") and r.n_ip == want.count("ip:") and r.n_card == want.count("card:") and r.n_phone == want.count("phone:")


def test_more_kinds_and_redaction(table):
    text = "Contact Mr. John Smith, ssn 123-45-6789, joe (at) example (dot) com or call 555-234-1234, mail a@b.com."
    docs = make(table, [(1, text, "s", "en"), (2, "Plain words 12-34 only.", "s", "en"), (3, None, "s", "en")])
    kinds = Counter(s.split(":")[0] for r in pii.op1(docs).collect() for s in r.spans.split(",") if s)
    assert kinds == {"name": 1, "ssn": 1, "email_spelled": 1, "phone_local": 1, "email": 1}
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "Contact <NAME>, ssn <SSN>, <EMAIL_SPELLED> or call <PHONE_LOCAL>, mail <EMAIL>."
    assert out[2].text == "Plain words 12-34 only." and out[3].text is None and out[1].kept == "k"
    assert pii.op1(docs.limit(0)).count() == 0


def test_em_learns_from_agreement():
    counts = [(0, 2, 2, 2, 4, 300), (0, 2, 2, 0, 4, 200), (0, 1, 1, 0, 4, 300), (0, 1, 1, 1, 4, 100), (0, 2, 1, 0, 4, 20)]
    model = pii.fit(counts)
    assert model.reliability[0, 1, 2] > 0.9 and model.reliability[0, 0, 1] > 0.8 and model.votes[0, 2] > 0 > model.votes[0, 1]


# --- licenses (op3) ---


def test_patience_alignment():
    a, b = "x a b q c d y".split(), "a b c d".split()
    assert licenses.align(a, b) == [(1, 0), (2, 1), (4, 2), (5, 3)]
    assert licenses.align("a b a b".split(), []) == []
    pairs = [(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]
    assert [y for _, y in licenses._increasing(pairs)] in ([1, 2, 4], [1, 2, 5])


def test_license_scan(table):
    mit = licenses.TEMPLATES["mit"]
    texts = ["word " * 50 + mit + " more", mit + " and again " + mit, mit.replace("Software", "Program"), "Licensed under the Apache License, Version 2.0.\nx", "the of and to a " * 500, None, "", "the software " * 9000]
    rows = {r.doc_id: r for r in licenses.scan_licenses(make(table, [(i, t, "s", "en") for i, t in enumerate(texts)])).collect()}
    assert [rows[i].license for i in range(8)] == ["mit", "mit", "mit", "apache-2.0-line", None, None, None, None]
    assert rows[0].coverage == 1.0 and rows[0].start_word == 50 and 0.8 <= rows[2].coverage < 1 and rows[5].coverage == 0
    assert licenses.scan_licenses(make(table, [])).count() == 0


def test_license_copy_without_its_rarest_word():
    scanner = licenses.Scanner()
    filler = "nothing here says much " * 300
    text = "released " + filler + "under the license and the license " * 3 + filler + "Published under the MIT License. " + filler + "under the license"
    start = len(licenses.words_of(text[: text.index("under the MIT")]))
    assert [x for x in scanner.scan(text) if x[0] == "mit-line"] == [("mit-line", 4, 5, start, start + 3)]
    # one altered word in five, another one each time, with the altered word elsewhere
    words = licenses.words_of(licenses.TEMPLATES["isc"])
    for k in range(5):
        altered = range(k, len(words), 5)[: len(words) // 5]
        copy = [f"x{i}" if i in altered else w for i, w in enumerate(words)]
        text = " ".join([*words[::-1], *["zz"] * 500, *copy, *["zz"] * 500, *words[::-1]])
        assert [x[0] for x in scanner.scan(text)] == ["isc"], k


# --- quality (op5) ---


def base_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if count[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_base_equals_brute_force(table):
    rng = random.Random(2)
    bits = ["a", "bb", "é", " ", "  ", "\n", "\t", "\x0b", " ", "#", "<", "x y z ", "x y z ", "🎉"]
    texts = [None, "", " \n ", *("".join(rng.choice(bits) for _ in range(rng.choice([3, 40, 400]))) for _ in range(200)), "a " * 60_000]
    docs = make(table, [*((i, t, None if i % 3 else "s", "en") for i, t in enumerate(texts)), (5, texts[5], "s", "en")])
    rows = quality.op5(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = base_of(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_boilerplate_goes_and_copies_stay(table):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    line = lambda n: " ".join(word() for _ in range(n))
    boiler, clean = "Subscribe to our  NEWSLETTER now " + line(60), "\n".join(line(12) for _ in range(6))
    rows = [(i, "\n".join([line(30), boiler, line(30)]), "h", "en") for i in range(40)]
    rows += [(100 + i, boiler.lower() + "\n" + line(8), "h", "en") for i in range(20)]  # depleted
    rows += [(200 + i, clean, "h", "en") for i in range(60)]  # exact copies of a clean text
    rows += [(300, boiler + "\n" + line(60), "other", "en")]  # one document of another host
    docs = make(table, rows)
    out = {r.doc_id: r for r in quality.op5(docs).collect()}
    assert all(out[i].kept and out[i].left_words == 60 for i in range(40))
    assert all(out[100 + i].depleted and not out[100 + i].kept for i in range(20))
    assert all(out[200 + i].kept and out[200 + i].left_words == 72 for i in range(60))
    assert out[300].kept and out[300].left_words == out[300].n_words
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == 101 and not good.where("doc_id < 40 and lower(text) like '%newsletter%'").count()


def test_lines_count_distinct_documents(table):
    """Shared blocks and single lines don't fold different documents; copies count once, for hosts too."""
    block = [f"menu entry {k}" for k in range(20)]
    rows = [(i, "\n".join([*block, f"own line {i}"]), "blocks", "en") for i in range(1000)]
    rows += [(2000 + i, f"Header\nsame words\nown {i}\nsame words", "pairs", "en") for i in range(12)]
    rows += [(3000 + i, f"Header\nonly {i % 9}", "copies", "en") for i in range(90)]
    rows += [(4000 + i, f"Rare\nonly {i}", "size", "en") for i in range(10)] + [(5000 + i, "one text", "size", "en") for i in range(2000)]
    rows += [(9000, None, "blocks", "en"), (9001, "", "blocks", "en")]
    found = quality.frequent_lines(make(table, rows)).collect()
    assert Counter((r.host, r.documents) for r in found) == {("blocks", 1000): 20, ("pairs", 12): 2, ("size", 10): 1}


# --- near copies (op6) ---


def fingerprint_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    count = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(parts))


def components_of(fps):
    """Least index reachable by links of 4 bits or fewer, over all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(table):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(5)) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(30)]
    texts = [None, "", " \n", "One", "one", "a b c", "A  b\tc", "a b c d"]
    for words in base:
        for _ in range(5):
            some = list(words)
            some[rng.randrange(len(some))] = rng.choice(vocabulary)
            texts.append(" ".join(some))
    docs = make(table, [*((i, t, "s", "en") for i, t in enumerate(texts)), (9, texts[9], "s", "en"), (None, texts[10], None, None)])
    rows = simhash.op6(docs).collect()
    fps = [fingerprint_of(t) for t in texts]
    root = components_of(fps)
    assert len(rows) == len(texts) + 2
    for r in rows:
        i = 10 if r.doc_id is None else r.doc_id
        assert r.fingerprint == f"{fps[i]:016x}" and r.component_id == root[i]
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted(set(root))
    assert simhash.op6(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4, 4096])
def test_dense_groups_lose_no_component(spark, table, most):
    """Fingerprints within few bits of a centre meet in hot keys; blocks of them are compared pairwise."""
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for centre in list(fps)[:4]:
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    root = components_of(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.link(table([(x,) for x in signed], "fp long"), most=most).collect()
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        parent[find(a)] = find(b)
    groups = {}
    for x, r in zip(signed, root):
        groups.setdefault(find(x), set()).add(r)
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(root))


# --- language (op9) ---

SYLLABLES = {"aa": ["the", "ing", "and", "er", "wh"], "bb": ["sch", "ung", "ein", "ü", "keit"], "cc": ["ción", "que", "ado", "ñ", "los"]}


def prose(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_documents(table):
    rng = random.Random(9)
    langs = sorted(SYLLABLES)
    rows = [(i, prose(langs[i % 3], rng, 80), "s", langs[i % 3]) for i in range(240)]
    rows += [(1000, None, "s", "aa"), (1001, "123 !? --", "s", "aa"), (1002, "", "s", None), (None, prose("bb", rng, 40), None, "bb"), (1003, prose("cc", rng, 20_000), "s", None), (7, rows[7][1], "s", rows[7][3])]
    found = language.op9(make(table, rows)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i in range(240):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in range(240) if by[i].held_out]
    assert np.mean([by[i].lang_pred == langs[i % 3] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"] and by[None].lang_pred == "bb" and not by[None].held_out


def test_language_without_labels_or_rows(table):
    docs = make(table, [(1, "some words", "s", None)])
    assert [r.lang_pred for r in language.op9(docs).collect()] == ["und"]
    assert language.op9(docs.limit(0)).count() == 0


def test_gradients_equal_differences():
    model = language.ByteGRU(["a", "b", "c"], hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    words, labels = [b" ab ", b" c ", b" abcde "], np.array([0, 1, 2])

    def loss():
        out = model.sums(words)
        return -sum(out[i, labels[i]] for i in range(3)) / out[:, 6].sum()

    grads = model._gradients(words, labels)
    for name in ("out", "bias", "re_f", "re_b", "c_f", "in_b"):
        w = model.weights[name]
        at = (97, 2) if name.startswith("in_") else tuple(n - 1 for n in w.shape)
        was, step = w[at], 1e-2
        w[at] = was + step
        up = loss()
        w[at] = was - step
        down = loss()
        w[at] = was
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3


# --- urls (op7) ---


def rule_of(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules_and_aliases(table):
    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://Example.COM/en/a", ""), (2, "https://www.example.com/en/a", None), (3, "http://shop.example.com/en", ""), (4, "http://x.net/es/", ""), (5, "HTTP://y.org/p?q#f", ""),
        (6, None, "x"), (7, "no-scheme.com/en/", ""), (8, "http://net/fr/1", ""), (9, "http://alias.org/1", link.format("http://bad.net/es/1")), (10, "http://alias.org/2", refresh.format("http://alias.org/1")),
        (11, "http://mixed.org/1", link.format("http://bad.net/fr/9")), (12, "http://mixed.org/2", link.format("http://mixed.org/1")), (13, "http://good.com/9", link.format("http://mixed.org/2")),
        (14, "https://www.alias.org/1.html?utm_source=f#top", ""), (15, "http://z.org", link.format("/rel")), (16, "://odd.net/fr/x", ""), (10, "http://alias.org/2", refresh.format("http://alias.org/1")),
        (17, "http://" + "a" * 5000 + ".org/" + "b" * 20_000, "<link " * 3000),
    ]
    rows = urls.op7(table(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages)
    by = {r.page_id: r for r in rows}
    for page_id, url, _ in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        assert (by[page_id].host, by[page_id].path) == (host, path)
        rule, verdict = rule_of(host, path)
        assert by[page_id].rule == rule and (rule is None or by[page_id].verdict == verdict)
    assert [by[i].verdict for i in (5, 6, 7, 9, 10, 11, 12, 14, 15)] == ["allow", "allow", "allow", "block", "block", "allow", "allow", "block", "allow"]
    assert urls.op7(table([], "page_id long, url string, html string")).count() == 0


def test_long_tags_give_edges(table):
    long = "x" * 30_000
    pages = [
        (1, "http://one.org/a", f'<link href="http://bad.net/es/{long}" rel="canonical">'), (2, "http://two.org/a", f'<LINK data-a="{long}" rel=canonical data-b="{long}" href="http://bad.net/fr/2">'),
        (3, "http://three.org/a", f"<meta charset=x><meta data-a='{long}' content='0; url=http://bad.net/es/3' http-equiv=refresh>"), (4, "http://four.org/a", f'<link href="http://bad.net/es/4" data-a="{long}" rel="icon">'),
        (5, "http://five.org/a", "<link " * 200_000 + 'href="http://bad.net/es/5" rel="canonical"'),
    ]
    rows = urls.op7(table(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


# --- vectors (op4) ---


def nearest_of(ids, x, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    d[ids == ids[i]] = np.inf
    return np.lexsort((ids, d))[:k], d


def test_kmeans_tree_recall_and_scores(table, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "BLOCK", 50)
    monkeypatch.setattr(kmeans_tree, "PART", 3)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 8))).astype(np.float32)
    x[100:400] = x[100]  # a third are one vector
    ids = np.arange(900)
    rows = [(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x)]
    odd = [(1000, None, 0), (1100, [0.0] * 8, 0), (1200, [float("nan")] * 8, 0), (1300, [1.0] * 7 + [None], 0), (None, [1.0] * 8, 0), (1400, [float("inf")] + [1.0] * 7, 0)]
    found = kmeans_tree.op4(table([*rows, *odd], "vec_id long, embedding array<float>, label int")).collect()
    hit = total = 0
    y = x.astype(np.float64)
    for q in range(0, 900, 100):
        want, d = nearest_of(ids, y, q, 10)
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in got)
        hit, total = hit + len({int(i) for i in want} & {r.vec_id for r in got}), total + 10
    assert len(found) == 90 and hit / total >= 0.9


def test_kmeans_tree_few_rows(table):
    few = kmeans_tree.op4(table([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1, 2), (0, 2, 1)]
    assert kmeans_tree.op4(table([], "vec_id long, embedding array<float>")).count() == 0
    assert kmeans_tree.op4(table([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


# --- all together ---


def test_pipeline_stages(spark, table, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    texts = {i: "\n".join(prose("aa" if i % 2 else "bb", rng, 12) for _ in range(8)) for i in range(40)}
    rows = [(i, t, "aa" if i % 2 else "bb", "s", len(t)) for i, t in texts.items()]
    rows += [(100, texts[0], "bb", "s", 1), (101, texts[0] + " ein", "bb", "s", 1), (102, "short", "aa", "s", 5), (103, texts[5] + "\nmail me@site.com now", "aa", "s", 1), (104, None, "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    ids = {r.doc_id for r in docs.collect()}
    assert set(range(40)) - ids == set() and not ids & {100, 102, 104}
    assert not docs.where(F.contains("text", F.lit("@"))).count()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "PII", "best-fit packing"]


def test_both_cuts_of_fingerprints_find_every_pair(spark, monkeypatch):
    """Pairs at 0 to 5 differing bits, wherever the bits lie, by two of six and by four of eight blocks."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 64, 60, np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for bits in (1, 2, 3, 4, 4, 4, 5):
            for at in rng.choice(64, bits, replace=False).tolist():
                x ^= 1 << at
            fps.add(x)
    fps = sorted(fps)
    want = union_find([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4], fps)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for many in (1 << 24, 0):
        monkeypatch.setattr(simhash, "MANY", many)
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.link(frame).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in links) and union_find(links, fps) == want


def union_find(edges, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_window_counts_slide():
    rng = random.Random(3)
    own = [(k, rng.choice("abcdef")) for k in range(300)]
    need = licenses.Counter("aabccdd")
    windows = [(max(0, k - 5), min(300, k + 9)) for k in sorted(rng.sample(range(300), 80))]
    got = licenses.Scanner._shared(own, need, windows)
    assert got == {(a, b): sum((licenses.Counter(w for _, w in own[a:b]) & need).values()) for a, b in windows}
