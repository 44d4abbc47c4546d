"""Aliases against union-find over parsed html."""

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from oreloom.llm import urls

PAGES = "page_id long, url string, html string, host string, verdict string"


class Parsed(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__()
        self.to, self.template = [], 0

    def handle_starttag(self, tag, attrs):
        self.template += tag == "template"
        attrs = dict(reversed(attrs))
        if self.template:
            return
        if tag == "link" and "canonical" in (attrs.get("rel") or "").lower().split():
            self.to.append((attrs.get("href") or "").strip())
        if tag == "meta" and (attrs.get("http-equiv") or "").lower() == "refresh":
            m = re.search(r"(?i)url\s*=\s*['\"]?([^'\"]*)", attrs.get("content") or "")
            self.to.append(m[1].strip() if m else "")

    def handle_endtag(self, tag):
        self.template -= tag == "template"


def key(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^#]*)", url)
    return m[1].lower() + m[2] if m else None


def rule_of(node):
    host, path = re.match(r"([^/?#]*)([^?]*)", node).groups()
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def verdicts(pages):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, url, html, *_ in pages:
        if url and "://" in url:
            parsed = Parsed()
            parsed.feed(html or "")
            parsed.close()
            for to in parsed.to:
                if to and "://" in (whole := urljoin(url, to)):
                    parent[find(key(whole))] = find(key(url))
    members = {}
    for x in list(parent):
        members.setdefault(find(x), set()).add(rule_of(x)[1])
    out = {}
    for page_id, url, *_ in pages:
        if not url or "://" not in url:
            out[page_id] = "allow"
            continue
        own = rule_of(key(url))[1]
        found = members.get(find(key(url)), set())
        out[page_id] = own or ("block" if "block" in found and "allow" not in found else "allow")
    return out


def test_components_equal_union_find(table):
    rng = random.Random(6)
    forms = [
        '<link rel="canonical" href="{}">', "<LINK HREF='{}' REL='alternate  Canonical'/>", "<link href={} rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">',
        "<META content=\"5;URL='{}'\" HTTP-EQUIV=Refresh>", '<link rel="icon" href="{}">', "<!-- <link rel=canonical href={}> -->", "<script>x = '<link rel=canonical href={}>';</script>", "<style><meta http-equiv=refresh content='0;url={}'></style>",
        "<meta name=description content='url={}'>", '<link data-rel="canonical" href="{}">', "<template><link rel=canonical href='{}'></template>", "<meta charset=x><p>canonical refresh</p>", '<link rel="canonical" data-href="x" href="{}">',
    ]
    sites = [f"http://s{i}.org/p" for i in range(160)] + ["http://bad.net/es/1", "http://bad.net/fr/2", "https://www.example.com/en/x", "http://shop.example.com/en/y", "http://good.com/z"]
    pages = []
    for i in range(400):
        url = rng.choice(sites)
        to = lambda: rng.choice(sites) if rng.random() < 0.8 else rng.choice(["/p", "p", "//s3.org/p", "mailto:x@y", ""])
        pages.append((i, url, "<html>" + "".join(rng.choice(forms).format(to()) for _ in range(rng.choice([0, 0, 1, 2]))) + "<p>text</p>", "h", "v"))
    ring = [f"http://ring{i}.org/" for i in range(50)]  # a cycle with a block in it
    pages += [(1000 + i, u, f'<link rel=canonical href="{ring[(i + 1) % 50]}">', None, None) for i, u in enumerate(ring)]
    pages += [(1100, ring[7], "<meta http-equiv=refresh content='0;url=http://bad.net/es/9'><meta http-equiv=refresh content='0;url=http://other.org/'>", None, None), (1101, "http://other.org/", None, None, None)]
    chain = [f"http://chain{i}.org/" for i in range(40)]  # a chain from a block to an explicit allow
    pages += [(1200 + i, u, f"<link rel=canonical href={chain[i + 1] if i < 39 else 'http://good.com/q'}>", None, None) for i, u in enumerate(chain)]
    pages += [(1300, "http://bad.net/fr/8", f"<link rel=canonical href={chain[0]}>", None, None), (1400, None, "x", None, None), (1401, "x", None, None, None)]
    want = verdicts(pages)
    found = {r.page_id: r.verdict for r in urls.judge(table(pages, PAGES)).collect()}
    assert found == want
    assert found[1101] == found[1000] == "block" and found[1220] == "allow" and found[1300] == "block"


def test_every_tag_counts_and_plain_forms_do_not(table):
    pages = [
        (1, "http://a.org/1", '<meta http-equiv=refresh content="30"><meta http-equiv=refresh content="0;url=http://bad.net/es/1">', None, None),
        (2, "http://b.org/1", '<link rel=canonical href="http://b.org/2"><link rel=canonical href="http://bad.net/es/a?x=1&amp;y=2">', None, None),
        (3, "http://bad.net/fr/3.html", "", None, None), (4, "https://www.c.org/1/", "<link rel=canonical href=http://c.org/1>", None, None),
        (5, "http://open.org/", "<!-- never closed <link rel=canonical href=http://bad.net/es/1>", None, None), (6, "http://script.org/", "<script " * 50_000 + "<link rel=canonical href=http://bad.net/es/1>", None, None),
        (7, "http://comment.org/", "<!--" * 100_000 + "canonical", None, None),
    ]
    rows = {r.page_id: r.verdict for r in urls.judge(table(pages, PAGES)).collect()}
    assert rows == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    same = [(1, "http://www.d.org/x.html", "<link rel=canonical href=http://bad.net/es/1>", None, None), (2, "http://d.org/x", "", None, None)]
    assert {r.page_id: r.verdict for r in urls.judge(table(same, PAGES)).collect()} == {1: "block", 2: "allow"}
    assert {r.page_id: r.verdict for r in urls.judge(table(same, PAGES), plain_forms=True).collect()} == {1: "block", 2: "block"}
    assert urls.judge(table([], PAGES)).count() == 0
