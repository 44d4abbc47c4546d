"""URL filter with redirect equivalence.

Method: rules decide the urls they fit, the longest rule winning.  Urls that stand for one
page are joined by edges: every redirect (meta refresh) and every canonical link in a
page's html.  Distributed connected components over these edges carry a block to all
aliases: a url without a rule is blocked if its component has a blocked url and no
explicitly allowed one.  A rule of the url's own always comes first.

A node is a url without scheme and fragment, its host in lower case.  Tags count where a
browser would read them: not inside of comments, scripts, styles and templates, of which an
unclosed one takes the rest.  A tag ends at its first ``>``.  With ``plain_forms``, urls are
also joined to their plain form (no www. or m. label, tracking parameters, closing slash or
.html); no link or redirect says so, so ``judge`` and the registered query leave it off.

Only keys and rules travel, never html; a key with very many aliases is one node.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and no
alias, and is allowed; null or empty html has no edges; very long urls, tags and html are
read whole, in linear time; repeated rows are judged alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.storage import materialise

#: (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _UPPER.lower())


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty without a ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return _lower(part(1)), part(2)


def decide(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null.  For up to some hundred rules."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*(F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in order), F.lit(None))


def _key(url: Column) -> Column:
    """A url without scheme and fragment, host in lower case; null without a ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^#]*)"
    return F.when(F.contains(url, F.lit("://")), F.concat(_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)))


def _plain(key: Column) -> Column:
    """The form that aliases of one page share."""
    steps = (
        (r"^(?:www|m)\.", ""),
        (r"(?<=[?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*(?:&|$)", ""),
        (r"[?&]+$", ""),
        (r"(?:/index)?\.html?(?=\?|$)", ""),
        (r"/+(?=\?|$)", ""),
    )
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, key)


#: What browsers don't read tags in: comments, and the bodies of some elements.
_UNREAD = r"(?is)<!--(?:.*?-->|.*+)|<(script|style|template)\b[^>]*+(?:>(?:.*?</\1\b[^>]*+>?|.*+))?"


def _absolute(raw: Column, url: Column) -> Column:
    """The url that ``raw`` means on the page ``url``, null if none."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when((raw == "") | raw.isNull(), None)
        .when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), raw)
        .when(raw.startswith("//"), F.concat(scheme, raw))
        .when(raw.startswith("/"), F.concat(site, raw))
        .when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), raw))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of a name, empty without one."""
    value = F.regexp_extract(tag, rf"""(?i)[\s"'/]{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)""", 1)
    value = F.regexp_replace(value, r"""^["']|["']$""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"(?i)&amp;|&#0*+38;|&#x0*+26;", "&"), r"[\t\n\r]", " "))


def targets(html: Column, url: Column) -> Column:
    """Urls that a page's canonical links and refreshes point to, all of them."""
    read = F.regexp_replace(html, _UNREAD, " ")
    # an open tag takes all that follows, so that each text is read once
    tags = lambda name: F.filter(F.regexp_extract_all(read, F.lit(rf"(?i)<{name}\b[^>]*+>?"), F.lit(0)), lambda t: t.endswith(">"))
    links = F.filter(tags("link"), lambda t: _attribute(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"))
    metas = F.filter(tags("meta"), lambda t: _attribute(t, "http-equiv").rlike("(?i)^refresh$"))
    refreshed = lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"""(?i)url\s*+=\s*+["']?([^"']*+)""", 1))
    raw = F.concat(F.transform(links, lambda t: _attribute(t, "href")), F.transform(metas, refreshed))
    # most pages have neither word, so most html is only searched
    return F.when(html.rlike("(?i)canonical|refresh"), F.transform(raw, lambda r: _absolute(r, url)))


def edges(pages: DataFrame, plain_forms: bool = False) -> DataFrame:
    """(a, b): keys of urls that stand for one page."""
    url = F.col("url")
    to = F.concat(F.array(url), F.coalesce(targets(F.col("html"), url), F.array().cast("array<string>")))
    found = pages.where(F.contains("url", F.lit("://"))).select(_key(url).alias("a"), F.explode(to if plain_forms else targets(F.col("html"), url)).alias("to"))
    out = found.select("a", _key(F.col("to")).alias("b")).where(F.col("b").isNotNull())
    if plain_forms:
        out = out.unionByName(out.select(F.col("b").alias("a"), _plain(F.col("b")).alias("b")))
    return out.where(F.col("a") != F.col("b"))


def judge(pages: DataFrame, rules: tuple = RULES, plain_forms: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = split_url(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), _key(F.col("url")).alias("key")).withColumn("d", decide(F.col("host"), F.col("path"), rules))
    own = materialise(own, "pages")
    parts = materialise(connected_components(edges(pages, plain_forms)), "aliases")
    # a node's own decision, by the same rules
    node_host, node_path = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), F.regexp_extract("node", r"(?s)^[^/?#]*([^?]*)", 1)
    known = parts.withColumn("verdict", decide(node_host, node_path, rules)["verdict"])
    spread = known.groupBy("root").agg(F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed"))
    blocked = spread.where(F.col("blocked") & ~F.coalesce(F.col("allowed"), F.lit(False))).select("root")
    aliases = parts.join(blocked, "root").select(F.col("node").alias("key"), F.lit(True).alias("alias"))
    out = own.join(aliases, "key", "left")
    verdict = F.coalesce("d.verdict", F.when(F.col("alias"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("d.rule").alias("rule"), verdict.alias("verdict"))


def op7(pages: DataFrame, plain_forms: bool = True) -> DataFrame:
    return judge(pages, plain_forms=plain_forms)
