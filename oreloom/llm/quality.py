"""Document quality rules: base heuristics and cross-document line frequency.

Method: each line with a word is normalised (white space collapsed, lower case) and
hashed; for every host (column ``source``) the distinct documents holding the hash are
counted.  A line above the host's limit is boilerplate and is removed; a document that
loses too many of its words is depleted and rejected.

What a distinct document is: a set of normalised lines, told from others by a hash of the
whole set, so exact copies count once, for a line and for its host's size alike.  A near
copy is a document of its own: by its lines alone it can't be told from one that shares
boilerplate.

Counting explodes lines once and combines before each shuffle, so a hot host or line is
summed where it is read.  The removed lines of a host reach its documents by a broadcast
of checked size, else by a join that adaptive execution may split; texts move only then.

Defined cases: null and blank texts have no words and fail the base rule; a null source
is a host of its own, and so is an empty one; very long texts are read whole; repeated rows count as one document
for the limits and each get a row; an empty table gives no rows; other columns don't
matter, even if named as a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, once
from .rows import pieces, released
from ..plans.storage import bounded_rows, materialise

#: A line is above its host's limit from this many distinct documents ...
LEAST_DOCUMENTS = 10
#: ... and this share of the host's documents.
SHARE = 0.01
#: A document is depleted with less than this share of its words left.
LEFT = 0.3
#: Removed lines that may be broadcast; beyond, they are joined.
BROADCAST_LINES = 200_000

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_NAMES = [x.split()[0] for x in BASE.split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    pair = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # three numbers no longer fit one integer
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[again + k] = True
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _measures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Structs of ``measure``; only texts go to Python, and only numbers come back."""

    def found() -> Iterator[pa.Array]:
        for array in texts:
            columns = list(zip(*(measure(t) for some in pieces(array) for t in some), strict=True)) or [()] * len(_NAMES)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)

    yield from released(found())


def _line_hash(line: Column) -> Column:
    """Hash of a normalised line; null for a line without a word."""
    flat = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    return F.when(flat != "", F.xxhash64(F.lower(flat)))


def _host(source: str) -> Column:
    """A key of the host that tells a null source from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _line_hashes(text: str) -> Column:
    """Hashes of a text's distinct lines, sorted; none for a null text."""
    hashes = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, "\n"), _line_hash), lambda h: h.isNotNull())))
    return F.coalesce(hashes, F.array().cast("array<long>"))


def frequent_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """(host, line, documents) of the lines above their host's limit."""
    rows = docs.select(_host("source").alias("host"), _line_hashes("text").alias("all"))
    # the null line stands for the document itself: its count is the host's size
    held = rows.select("host", F.xxhash64("all").alias("document"), F.explode(F.concat("all", F.array(F.lit(None).cast("long")))).alias("line"))
    once = held.groupBy("host", "line", "document").agg(F.lit(1).alias("one"))
    counted = once.groupBy("host", "line").agg(F.count("*").alias("documents")).where((F.col("documents") >= least) | F.col("line").isNull())
    counted = materialise(counted, "counts")
    hosts = counted.where(F.col("line").isNull()).select("host", F.col("documents").alias("size"))
    return counted.where(F.col("line").isNotNull()).join(hosts, "host").where(F.col("documents") >= F.col("size") * share).select(F.when(F.col("host") != "", F.substr("host", F.lit(2))).alias("host"), "line", "documents")


def assess(docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """``row`` (the document as it came) with its measures, verdict and cleaned text.

    Adds n_words .. n_repeat_words, left_words (after removal), base_failed, depleted,
    kept, and cleaned: the text without removed lines, null if none was removed.
    """
    found = materialise(frequent_lines(docs, least, share).select(_host("host").alias("host"), "line"), "lines")
    rows = docs.select(F.struct("*").alias("row")).withColumn("host", _host("row.source"))
    if bounded_rows(found, BROADCAST_LINES) is not None:
        rows = rows.join(F.broadcast(found.groupBy("host").agg(F.collect_set("line").alias("removed"))), "host", "left")
    else:  # lines meet line by line; a text then gets those of its own that go, and moves once
        rows = rows.withColumn("document", F.xxhash64(_line_hashes("row.text")))
        lines = docs.select(_host("source").alias("host"), _line_hashes("text").alias("all")).select("host", F.xxhash64("all").alias("document"), F.explode("all").alias("line"))
        hits = lines.groupBy("host", "line", "document").agg(F.lit(1).alias("one")).join(found, ["host", "line"])
        rows = rows.join(hits.groupBy("host", "document").agg(F.collect_list("line").alias("removed")), ["host", "document"], "left")
    held = F.struct(F.split("row.text", "\n").alias("lines"), F.col("removed").alias("removed"))

    def strip(held: Column) -> Column:
        def without(hit: Column) -> Column:
            left = F.filter(held["lines"], lambda x: ~F.coalesce(F.array_contains(hit, _line_hash(x)), F.lit(False)))
            words = lambda t: F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
            return F.when(F.size(hit) > 0, let(F.array_join(left, "\n"), lambda t: F.struct(t.alias("text"), words(t).alias("words"))))

        return let(F.array_intersect(F.transform(held["lines"], _line_hash), held["removed"]), without)

    # not deterministic, as far as the optimizer may think: it would measure again in filters
    base = F.arrow_udf(_measures, ", ".join(x.replace(" ", ": ") for x in BASE.split(", ")).join(("struct<", ">"))).asNondeterministic()
    # the stripped text first, so that it is made once, below the measures that come from Python
    rows = rows.select("row", once(let(held, strip)).alias("less")).withColumn("base", base("row.text"))
    left_words = F.coalesce("less.words", "base.n_words").alias("left_words")
    out = rows.select("row", F.col("less.text").alias("cleaned"), *(F.col(f"base.{c}").alias(c) for c in _NAMES), left_words)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("depleted", F.col("cleaned").isNotNull() & (F.col("left_words") < left * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Kept documents in their own columns, boilerplate lines removed and n_chars refreshed."""
    text = F.coalesce("cleaned", "row.text")
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return assess(docs).where("kept").select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op5(docs: DataFrame) -> DataFrame:
    out = assess(docs.select("doc_id", "text", "source"))
    return materialise(out.select(F.col("row.doc_id").alias("doc_id"), *_NAMES, "base_failed", "kept", "left_words", "depleted"), "quality")
