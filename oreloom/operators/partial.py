"""Functions that stand sound in a Python file that doesn't parse.

Lines are cut into blocks by indentation: a block begins at its level's indentation, outside of
strings, and holds what is indented below it, with its decorators before and its clauses (else,
except, a closing bracket) after.  An open bracket doesn't hold a line back that begins like a
definition or an import, as it is often what is broken.  Blocks that parse by themselves stay; of a
class that doesn't, the header stays and its body is cut in the same way; everything else is blanked.
What is left has every line where it was, so places in it are places in the file.

Each level parses its text once, so the work is that of parsing times the depth of broken classes.
"""

from __future__ import annotations

import ast
import re
import textwrap
from bisect import bisect_right

LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+").findall
#: Comments and strings; one that isn't closed ends with its line, or with the file if it is tripled.
_TOKEN = re.compile(r'#[^\r\n]*|("""|\'\'\')(?:\\.|(?!\1).)*(?:\1|\Z)|"(?:\\.|[^"\\\r\n])*"?|\'(?:\\.|[^\'\\\r\n])*\'?', re.DOTALL)
_BRACKET = re.compile(r"[()\[\]{}]")
_BEGINS = re.compile(r"(?:async\s+def|def|class|import|from)\b|@")
_CLAUSE = re.compile(r"(?:else|elif|except|finally|case)\b|[)\]}]")
_CLASS = re.compile(r"class\b")


def _held(lines: list[str]) -> list[bool]:
    """Whether each line begins inside of a string, an open bracket or a continued line; definitions close brackets."""
    text, out, depth = "".join(lines), [], 0
    starts, total = [], 0
    for x in lines:
        starts.append(total)
        total += len(x)
    inside = set()  # lines that a string reaches into
    for m in _TOKEN.finditer(text):
        inside.update(range(bisect_right(starts, m.start()), bisect_right(starts, max(m.start(), m.end() - 1))))
    masked = _TOKEN.sub(lambda m: re.sub(r"[^\r\n]", "_", m[0]), text)  # brackets in strings and comments don't count
    blank = [masked[a : a + len(x)] for a, x in zip(starts, lines, strict=True)]
    carried = False
    for line, x in enumerate(blank):
        begins = line not in inside and bool(_BEGINS.match(x.lstrip(" \t\f")))
        if begins:
            depth = 0
        out.append(line in inside or carried or depth > 0)
        for mark in _BRACKET.findall(x):
            depth = max(0, depth + (1 if mark in "([{" else -1))
        carried = line not in inside and x.rstrip("\r\n").endswith("\\")
    return out


def _indent(line: str) -> int:
    body = line.lstrip("\f")
    return len(body) - len(body.lstrip(" \t"))


def _parses(lines: list[str]) -> bool:
    try:
        ast.parse(textwrap.dedent("".join(lines)))
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True


def sound_source(source: str) -> str:
    """``source`` with everything blanked that isn't part of a sound block; as it is if it parses."""
    lines = LINES(source)
    held = _held(lines)
    plain = [not h and bool(x.strip()) and not x.lstrip(" \t\f").startswith("#") for x, h in zip(lines, held, strict=True)]
    kept = [False] * len(lines)

    def cut(first: int, last: int) -> None:
        level = min((_indent(lines[k]) for k in range(first, last) if plain[k]), default=None)
        if level is None:
            return
        heads, decorated = [], False
        for k in range(first, last):
            if plain[k] and _indent(lines[k]) == level:
                body = lines[k].lstrip(" \t\f")
                if not decorated and not _CLAUSE.match(body):
                    heads.append(k)
                decorated = body.startswith("@")
        for a, b in zip(heads, [*heads[1:], last], strict=True):
            if _parses(lines[a:b]):
                kept[a:b] = [True] * (b - a)
                continue
            head = next(k for k in range(a, b) if plain[k] and not lines[k].lstrip(" \t\f").startswith("@"))
            if _CLASS.match(lines[head].lstrip(" \t\f")) and _parses([*lines[a : head + 1], lines[head][: _indent(lines[head])] + "    pass\n"]):
                cut(head + 1, b)
                if any(kept[head + 1 : b]):
                    kept[a : head + 1] = [True] * (head + 1 - a)

    cut(0, len(lines))
    return "".join(x if k else re.sub(r"[^\r\n]", "", x) for x, k in zip(lines, kept, strict=True))
