"""Text functions as Column expressions, with Python's notion of white space and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

#: What str.strip() and \s of Python take for white space, as a Java character class.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same, one by one.
_SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.trim(col(x), F.lit(_SPACES))


def rstrip(x: Column | str) -> Column:
    return F.rtrim(col(x), F.lit(_SPACES))


def blank(x: Column | str) -> Column:
    """True for null and for white space alone."""
    # from the left alone: from the right Spark would look at every character
    return F.coalesce(F.ltrim(col(x), F.lit(_SPACES)), F.lit("")) == ""


def lines(x: Column | str) -> Column:
    """str.splitlines(): no empty piece after a final line break; none for an empty text."""
    # split would compile a pattern of more than one character for every row; of a class, characters are one table, each range is a test more
    odd = lambda text: F.when(text.rlike(r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028-\u2029]"), F.regexp_replace(text, _BREAK, "\n")).otherwise(text)
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return let(col(x), lambda text: let(F.split(odd(text), "\n", -1), cut))


def lstrip_of(x: Column, characters: str) -> Column:
    return F.regexp_replace(x, f"^[{characters}]+", "")


def rstrip_of(x: Column, characters: str) -> Column:
    return F.regexp_replace(x, rf"[{characters}]+\z", "")


def slugify(x: Column | str, most: int = 64) -> Column:
    """Lower-case words joined by hyphens, at most ``most`` characters, never empty."""
    words = F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-")
    whole = F.coalesce(F.nullif(F.trim(words, F.lit("-")), F.lit("")), F.lit("generated-skill"))
    cut = F.trim(F.substring(whole, 1, most), F.lit("-"))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("generated-skill"))


def file_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """Suffix with its dot as pathlib has it: none for a leading or final dot."""
    return F.regexp_extract(file_name(path), r"(?s)[^.].*?(\.[^.]+)\z", 1)


def stem(path: Column | str) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def node_id(path: Column, start: Column, end: Column, name: Column) -> Column:
    """path:start-end:name: and 12 digits of the SHA-1 of path:start:end:name."""
    digest = F.substring(F.sha1(F.concat_ws(":", path, start, end, name)), 1, 12)
    return F.concat(path, F.lit(":"), start, F.lit("-"), end, F.lit(":"), name, F.lit(":"), digest)


def normalise_spaces(x: Column | str) -> Column:
    return strip(F.regexp_replace(col(x), rf"{SPACE}+", " "))


def lower_first(x: Column) -> Column:
    return F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))


def title_words(x: Column) -> Column:
    """str.title() of ASCII text: a letter is upper-case exactly if no letter precedes it."""
    marked = F.regexp_replace(F.lower(x), r"(?<![a-z])([a-z])", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.concat_ws("", F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))))


def ordered_distinct(x: Column) -> Column:
    """First occurrences in order, nulls dropped."""
    return F.array_distinct(F.array_compact(x))
