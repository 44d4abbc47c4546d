"""Personal data and secrets by weak supervision, in DataFrame expressions only.

Method: patterns propose candidate spans of each kind.  Three labelers vote on every
candidate: one checks its format (digits, checksum, ranges, mix of characters), one looks
parts of it up in gazetteers (domains, issuers, country codes, given names, prefixes of
keys), one reads the ``NEAR`` characters before it.  Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is for a kind, and its
posteriors train a logistic span classifier over votes and shape.

The patterns read each text once: candidates are written with what is carried of their
rows, and both training and labelling read them back.  What leaves the executors is a
count per (kind, votes, shape): at most ``len(KINDS) * 27 * 16`` rows whatever the corpus,
so training sees every candidate of every text.  Labelling and redaction happen inside
each row: no shuffle, no Python.

Base spans (email, ip, card, phone in their valid form) always stay; the classifier adds
spans of the other kinds that overlap none of them, and secrets, as digits inside of one
may look like a base span.

Offsets count code points.  Running sums, the test for overlaps and redaction work in
blocks, so the cost is linear in the text and its spans.

Defined cases: null text counts as empty and has no span; very long texts, words and
matches are read whole; repeated rows are labelled alike; spans that overlap are redacted
as one stretch with the marks of those that start in it outside an earlier one; a
candidate without a vote for it is never added; an empty table gives no rows and untrained
weights that follow the labelers; other columns are ignored or kept as they came.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..plans.storage import materialise

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "name", "email_spelled", "phone_local", "secret")
THRESHOLD = 0.5
#: Characters before a candidate that the context labeler reads.
NEAR = 40

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Given names of the gazetteer (fixed values).
NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Hans Peter Klaus Ursula Wolfgang Jean Pierre Marie Philippe Nathalie Juan Carlos Carmen Antonio Dolores"
).split()
#: Patterns that read each text once: quantifiers are possessive and start only where a
#: run starts (or the last match ended), which leaves the leftmost matches unchanged.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}})(?:(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]++(?: [A-Z][a-z]++)?|(?:{'|'.join(NAMES)}) [A-Z][a-z]++)(?!\p{{L}})",
    "email_spelled": rf"(?<!{_LOCAL}){_LOCAL}++ ?[(\[]at[)\]] ?{_LABEL}++(?: ?(?:[(\[]dot[)\]]|\.) ?{_LABEL}++)++",
    "phone_local": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    # a run of 20 and more with a letter and a digit
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
}
#: Text without this can't hold the kind.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-", "phone_local": "-", "email_spelled": "at"}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words before a span that speak for its kind, and words that speak against any kind.
CUES = {
    "email": r"\b(?:e-?mail|contact|write|reach|courriel|correo)\b",
    "ip": r"\b(?:ip|host|server|client|address|login)\b",
    "card": r"\b(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|call|tel|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
    "ssn": r"\b(?:ssn|social security|tax id)\b",
    "name": r"\b(?:name is|named|contact|signed|regards|author|patient|dear)\b",
    "email_spelled": r"\b(?:e-?mail|contact|write|reach|courriel|correo)\b",
    "phone_local": r"\b(?:phone|call|tel|mobile|fax|telefon)\b",
    "secret": r"(?:\b|_)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|authorization|bearer|credentials?)\b",
}
_AGAINST = r"\b(?:version|isbn|issn|doi|order|invoice|part no|serial|build|rfc|release|commit|checksum|digest|revision|uuid|md5|sha-?[0-9]+)\b"
#: Prefixes that issuers give their keys (fixed values).
_KEY_PREFIXES = "AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abprs]-|ya29|eyJ|npm_|hf_"
_BLOCK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Checksum test; every second digit from the right counts twice, less 9 if over 9."""
    turned = F.reverse(digits)
    digit = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _vote(condition: Column, otherwise: int) -> Column:
    """2 speaks for, 1 against, 0 abstains."""
    return F.when(condition, 2).otherwise(otherwise)


def _format_vote(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _vote(m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 1)
    if kind == "card":
        return _vote(_luhn(_digits(m)), 1)
    if kind == "phone":
        return _vote(F.length(_digits(m)).between(9, 15), 1)
    if kind == "ssn":
        return _vote(~m.rlike("^(?:000|666|9..)|-00-|0000$"), 1)
    if kind == "name":
        return _vote(m.rlike(r"^\w+\."), 0)
    if kind == "phone_local":
        return _vote(_digits(m).rlike("^[2-9]..[2-9]"), 1)
    if kind == "secret":  # many different characters in a mix of cases; hex may be a secret or a digest
        varied = F.size(F.array_distinct(F.split(m, ""))) >= 10
        mixed = m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9].*[0-9]")
        return F.when(varied & m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), 0).otherwise(_vote(varied & mixed, 1))
    return F.lit(2)


def _gazetteer_vote(kind: str, m: Column) -> Column:
    if kind in ("email", "email_spelled"):
        return _vote(m.rlike(r"(?i)[^a-z](?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"), 0)
    if kind == "ip":
        return _vote(~m.rlike(r"^(?:0|10|127|255|192\.168|169\.254)\."), 1)
    if kind == "card":
        return _vote(_digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1)
    if kind == "phone":
        return _vote(_digits(m).rlike("^(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 0)
    if kind == "name":
        return _vote(m.rlike(rf"^(?:{'|'.join(NAMES)}) "), 0)
    if kind == "secret":
        return _vote(m.rlike(rf"^(?:{_KEY_PREFIXES})"), 0)
    return F.lit(0)


def _context_vote(kind: str, before: Column) -> Column:
    return F.when(before.rlike("(?i)" + CUES[kind]), 2).when(before.rlike("(?i)" + _AGAINST), 1).otherwise(0)


def _shape(m: Column, before: Column, after: Column) -> Column:
    """0..15: length in four classes, letter or digit right before, and right after."""
    n = F.length(m)
    size = F.when(n < 12, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3)
    edge = lambda x, at: F.when(x.rlike(at), 1).otherwise(0)
    return size * 4 + edge(before, r"[\p{L}0-9]$") * 2 + edge(after, r"^[\p{L}0-9]")


def _scan(items: Column, state, step) -> Column:
    """``step(state, item)`` -> (next state, output) along ``items``; the outputs.

    Blocks of ``_BLOCK`` keep the growing arrays short: the cost is linear in the items.
    """
    empty = F.filter(F.array(step(state, F.get(items, F.lit(0)))[1]), lambda x: F.lit(False))

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["at"], x)
        return F.struct(after.alias("at"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        inner = F.aggregate(F.slice(items, first, _BLOCK), F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    none = F.filter(F.array(empty), lambda x: F.lit(False))
    blocks = F.sequence(F.lit(1), F.size(items), F.lit(_BLOCK))
    return F.flatten(F.aggregate(blocks, F.struct(state.alias("at"), none.alias("out")), block)["out"])


def _placed(items: Column, out) -> Column:
    """Running sum over ``items`` (skip, size): out(start, end, item) of each."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["skip"]
        return start + x["size"], out(start, start + x["size"], x)

    return _scan(items, F.lit(0), step)


def _items(kind: str, text: Column) -> Column:
    """Votes and shape of each match in ``text``, with the lengths that place it; null for none."""

    def item(held: Column):
        def one(m: Column, i: Column) -> Column:
            before, after = F.get(held["parts"], i), F.get(held["parts"], i + 1)
            near, beyond = F.substring(before, -NEAR, NEAR), F.substring(after, 1, 1)
            votes = (_format_vote(kind, m).alias("format"), _gazetteer_vote(kind, m).alias("gazetteer"), _context_vote(kind, near).alias("context"))
            return F.struct(F.length(before).alias("skip"), F.length(m).alias("size"), *votes, _shape(m, near, beyond).alias("shape"))

        return F.transform(held["matches"], one)

    def split(matches: Column) -> Column:
        held = F.struct(matches.alias("matches"), F.split(text, PATTERNS[kind], -1).alias("parts"))
        return F.when(F.size(matches) > 0, let(held, item))

    hits = let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), split)
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), hits) if kind in _NEEDS else hits


def candidates(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry``, all by default) and ``found``: candidates (start, rank, end, format, gazetteer, context, shape)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns))
    out = docs.select(row.alias("row"), *(_items(kind, text).alias(f"_i_{kind}") for kind in KINDS))
    placed = []
    for rank, kind in enumerate(KINDS):
        step = lambda start, end, x, rank=rank: F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), *(x[c].alias(c) for c in ("format", "gazetteer", "context", "shape"))
        )
        placed.append(let(F.col(f"_i_{kind}"), lambda items, step=step: F.when(items.isNotNull(), _placed(items, step))))
    return out.select("row", F.flatten(F.array_compact(F.array(*placed))).alias("found"))


@dataclass
class SpanModel:
    """Reliability of each labeler, and the classifier's weights by code."""

    reliability: np.ndarray  # [labeler, class, vote]
    prior: np.ndarray  # [kind]
    kind: np.ndarray
    votes: np.ndarray  # [labeler, vote]
    shape: np.ndarray


class KindModels:
    """A model for each kind, as a labeler that is sound for one kind may say nothing of another."""

    def __init__(self, models: list[SpanModel]):
        self.models = models

    def logit(self, x: Column) -> Column:
        table = lambda weights, at: F.element_at(F.array(*(F.lit(round(float(w), 12)) for w in weights)), at + 1)
        out = table([m.kind[i] for i, m in enumerate(self.models)], x["rank"])
        out = out + table([w for m in self.models for w in m.shape], x["rank"] * 16 + x["shape"])
        for k, name in enumerate(("format", "gazetteer", "context")):
            out = out + table([w for m in self.models for w in m.votes[k]], x["rank"] * 3 + x[name])
        return out


def fit(counts: list[tuple[int, int, int, int, int, int]], rounds: int = 60, steps: int = 400) -> SpanModel:
    """EM, then logistic regression on its posteriors.

    ``counts`` holds (kind, format, gazetteer, context, shape, number) of each pattern.
    Every parameter starts from, and is smoothed towards, labelers that are mostly right.
    A labeler that abstains says nothing, and a pattern of abstentions alone teaches nothing.
    """
    table = np.array(counts, np.float64).reshape(-1, 6)
    kinds, votes, shapes = table[:, 0].astype(int), table[:, 1:4].astype(int), table[:, 4].astype(int)
    n = table[:, 5] * votes.any(axis=1)

    def evidence() -> np.ndarray:  # [labeler, vote]: log odds of a vote, given that the labeler votes
        given = reliability / reliability[:, :, 1:].sum(axis=2, keepdims=True)
        return np.log(given[:, 1] / given[:, 0]) * [0, 1, 1]

    belief = np.array([[0.4, 0.5, 0.1], [0.3, 0.05, 0.65]])  # [class, vote]
    smooth = 20 * np.stack([belief] * 3)
    reliability, prior = smooth / 20, np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        odds = np.log(prior[kinds] / (1 - prior[kinds]))
        odds = odds + sum(said[votes[:, k]] for k, said in enumerate(evidence()))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        reliability = smooth.copy()
        for k in range(3):
            np.add.at(reliability[k, 1], votes[:, k], n * posterior)
            np.add.at(reliability[k, 0], votes[:, k], n * (1 - posterior))
        reliability /= reliability.sum(axis=2, keepdims=True)
        up, all_ = np.full(len(KINDS), 5.0), np.full(len(KINDS), 10.0)
        np.add.at(up, kinds, n * posterior)
        np.add.at(all_, kinds, n)
        prior = up / all_
    # the classifier starts at what the labelers' reliabilities say and fits the posteriors
    model = SpanModel(reliability, prior, np.log(prior / (1 - prior)), evidence(), np.zeros(16))
    if not n.sum():
        return model
    weight = n / n.sum()
    for _ in range(steps):
        odds = model.kind[kinds] + model.shape[shapes] + sum(model.votes[k, votes[:, k]] for k in range(3))
        wrong = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - posterior)
        for target, at in ((model.kind, kinds), (model.shape, shapes), *((model.votes[k], votes[:, k]) for k in range(3))):
            step = np.zeros_like(target)
            np.add.at(step, at, wrong)
            target -= 2.0 * (step + 1e-4 * target)
    model.votes[:, 0] = 0
    return model


def train(found: DataFrame) -> KindModels:
    """Fit on all candidates, kind by kind; collects one row per pattern, at most len(KINDS) * 27 * 16."""
    names = ("rank", "format", "gazetteer", "context", "shape")
    x = found.select(F.explode("found").alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in names))
    rows = sorted(tuple(r) for r in x.groupBy(*names).agg(F.count("*").alias("n")).collect())
    return KindModels([fit([r for r in rows if r[0] == kind]) for kind in range(len(KINDS))])


def chosen(x: Column, model: KindModels, least: float = 0.0) -> Column:
    """Whether the classifier takes a candidate; without a vote for it there is nothing to go by."""
    return F.greatest(x["format"], x["gazetteer"], x["context"]).eqNullSafe(2) & (model.logit(x) >= least)


def spans(found: DataFrame, model: KindModels, threshold: float = THRESHOLD) -> DataFrame:
    """``row``, ``base`` and ``all``: spans (start, rank, end), sorted."""
    bare = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))
    least = float(np.log(threshold / (1 - threshold)))
    base = F.transform(F.filter("found", lambda x: (x["rank"] < len(BASE_KINDS)) & (x["format"] == 2)), bare)
    more = F.transform(F.filter("found", lambda x: (x["rank"] >= len(BASE_KINDS)) & chosen(x, model, least)), bare)
    both = F.struct(F.array_sort(base).alias("base"), more.alias("more"))
    of_base = lambda x: x["rank"] < len(BASE_KINDS)
    stays = lambda x: of_base(x) | (x["rank"] == KINDS.index("secret"))

    def ahead(far: Column, x: Column) -> tuple[Column, Column]:  # far: where the base spans before x end
        return F.when(of_base(x), F.greatest(far, x["end"])).otherwise(far), F.struct(*(x[c].alias(c) for c in ("start", "rank", "end")), (stays(x) | (far <= x["start"])).alias("free"))

    def behind(near: Column, x: Column) -> tuple[Column, Column]:  # near: where the next base span starts
        return F.when(of_base(x), x["start"]).otherwise(near), F.struct(bare(x).alias("x"), (stays(x) | (x["free"] & (near >= x["end"]))).alias("free"))

    def joined(x: Column) -> Column:
        swept = lambda every: let(_scan(every, F.lit(0), ahead), lambda y: let(F.reverse(y), lambda z: _scan(z, F.lit((1 << 31) - 1), behind)))
        free = lambda every: F.reverse(F.transform(F.filter(swept(every), lambda y: y["free"]), lambda y: y["x"]))
        sole = F.array_sort(F.concat(x["base"], x["more"]))
        every = F.when(F.size(x["more"]) == 0, x["base"]).when(F.size(x["base"]) == 0, sole).otherwise(let(sole, free))
        return F.struct(x["base"].alias("base"), every.alias("all"))

    return found.select("row", let(both, joined).alias("_s")).select("row", F.col("_s.base").alias("base"), F.col("_s.all").alias("all"))


def _listed(column: str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(kind, x["rank"] + 1), x["start"], x["end"])), ",")


def label(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row``, ``base``, ``all``: every document with its spans.  Trains on the same documents."""
    found = materialise(candidates(docs, carry), "candidates")
    return spans(found, train(found))


def _replaced(text: Column, offset: Column, stretches: Column, sizes: tuple[int, ...] = (1 << 20, 1 << 14)) -> Column:
    """``text``, which stands at ``offset``, with its stretches (start, end, mark) replaced; block by block, as cutting costs what stands before."""
    if sizes:
        at = lambda i: offset + i * sizes[0]
        own = lambda b, i: let(F.filter(stretches, lambda s: (s["start"] < at(i) + sizes[0]) & (s["end"] > at(i))), lambda s: F.when(F.size(s) == 0, b).otherwise(_replaced(b, at(i), s, sizes[1:])))
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{sizes[0]}}}+"), F.lit(0)), own), "")

    def piece(s: Column, i: Column) -> Column:
        before = F.greatest(offset, F.coalesce(F.get(stretches, i - 1)["end"], offset))
        gap = F.substring(text, before - offset + 1, F.greatest(s["start"] - before, F.lit(0)))
        return F.concat(gap, F.when(s["start"] >= offset, s["mark"]).otherwise(""))

    rest = F.substring(text, F.element_at(stretches, -1)["end"] - offset + 1, F.length(text))
    return F.concat(F.array_join(F.transform(stretches, piece), ""), rest)


def redact(docs: DataFrame) -> DataFrame:
    """Documents in their own columns with each span's text replaced by ``<KIND>``; n_chars refreshed."""
    mark = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def stretch(far: Column, x: Column) -> tuple[Column, Column]:  # what of x the spans before it leave
        start, named = F.greatest(far, x["start"]), F.when(x["start"] >= far, F.element_at(mark, x["rank"] + 1)).otherwise("")
        return F.greatest(far, x["end"]), F.struct(start.alias("start"), F.greatest(start, x["end"]).alias("end"), named.alias("mark"))

    def clean(x: Column) -> Column:
        own = F.filter(_scan(x["all"], F.lit(0), stretch), lambda s: s["start"] < s["end"])
        return F.when(F.size(x["all"]) == 0, x["text"]).otherwise(let(own, lambda s: _replaced(x["text"], F.lit(0), s)))

    out = label(docs).select("row", let(F.struct(F.col("row.text").alias("text"), F.col("all").alias("all")), clean).alias("text"))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op1(docs: DataFrame) -> DataFrame:
    out = label(docs.select("doc_id", "text"), ["doc_id"])
    of = lambda r: lambda x: x["rank"] == r
    counts = [F.size(F.filter("base", of(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(BASE_KINDS)]
    return out.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"))
