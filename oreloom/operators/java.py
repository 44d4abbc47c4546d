"""Java declarations: a tokenizer, and a walk over the bodies of types.

The walk keeps to members: it goes through the body of each type, takes what ends in a
block or a semicolon, and says whether that is a type, a method or something else.  Blocks
are only searched for types that stand in them (local and anonymous classes).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""
    (?P<comment> /\*.*?(?:\*/|\Z) | //[^\n]* )
  | (?P<text> \"\"\".*?(?:(?<!\\)\"\"\"|\Z) | "(?:\\.|[^"\\\n])*"? | '(?:\\.|[^'\\\n])*'? )
  | (?P<word> [^\W\d][\w$]* | \$[\w$]* )
  | (?P<number> \d[\w.]* )
  | (?P<mark> \S )
    """,
    re.DOTALL | re.VERBOSE,
)
# Words of the language.
_TYPES = frozenset(("class", "interface", "enum", "record"))
_MODIFIERS = frozenset("public protected private static final abstract synchronized native strictfp default transient volatile sealed non".split())
_STATEMENTS = frozenset("if for while switch catch return new else do try finally throw assert yield case this super instanceof import package".split())
_CLOSED_BY = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


class Source:
    """Tokens of a source, with the closing partner of each bracket."""

    def __init__(self, text: str):
        every = [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.text = text
        #: Comments by the number of the token that follows them.
        self.comments: dict[int, list[Token]] = {}
        self.tokens: list[Token] = []
        for token in every:
            if token.kind == "comment":
                self.comments.setdefault(len(self.tokens), []).append(token)
            else:
                self.tokens.append(token)
        self.partner: dict[int, int] = {}
        open_: list[int] = []
        for i, token in enumerate(self.tokens):
            if token.kind != "mark":
                continue
            if token.text in _CLOSED_BY:
                open_.append(i)
            elif token.text in ")]}":
                while open_ and _CLOSED_BY[self.tokens[open_[-1]].text] != token.text and token.text == "}":
                    open_.pop()  # a bracket left open inside of a block
                if open_ and _CLOSED_BY[self.tokens[open_[-1]].text] == token.text:
                    self.partner[open_.pop()] = i

    def __getitem__(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def close(self, i: int) -> int:
        """Number of the token that closes the bracket at ``i``, or of the last one."""
        return self.partner.get(i, len(self.tokens) - 1)


@dataclass
class Method:
    name: str
    first: int  # its first token, annotations included
    head: int  # its first token after the annotations
    stop: int  # the brace or semicolon that ends its head
    last: int  # its last token
    annotations: list[tuple[int, int]]


def _annotation(source: Source, i: int) -> int | None:
    """The token after the annotation that starts at ``i``, None if none does."""
    if source[i] != "@" or not source.word(i + 1) or source[i + 1] == "interface":
        return None
    i += 2
    while source[i] == "." and source.word(i + 1):
        i += 2
    return source.close(i) + 1 if source[i] == "(" else i


def _angles(source: Source, i: int) -> int:
    """The token after the type arguments that start at ``i``."""
    depth = 0
    while i < len(source.tokens):
        depth += (source[i] == "<") - (source[i] == ">")
        i += 1
        if depth == 0 or source[i - 1] in "{};":
            break
    return i


def _member_end(source: Source, i: int, stop: int) -> int:
    """The brace or semicolon that ends the head of the member at ``i``; ``stop`` if none does."""
    assigned = False
    while i < stop:
        mark = source[i] if source.tokens[i].kind == "mark" else ""
        if mark in ("(", "[") or (mark == "{" and assigned):  # a value may hold blocks
            i = source.close(i)
        elif mark in ("{", ";"):
            return i
        assigned |= mark == "="
        i += 1
    return stop


def _as_method(source: Source, first: int, stop: int) -> Method | None:
    """The method or constructor whose head stands from ``first`` to its end at ``stop``."""
    at, annotations = first, []
    while (after := _annotation(source, at)) is not None:
        annotations.append((at, after))
        at = after
    head = at
    while source[at] in _MODIFIERS or _annotation(source, at) is not None:
        at = _annotation(source, at) or at + 1
    if source[at] == "<":
        at = _angles(source, at)
    # a type and a name, or a constructor's name alone
    words: list[int] = []
    while at < stop and (source.word(at) or source[at] in (".", "[", "<", "@")):
        if source[at] == "<":
            at = _angles(source, at)
        elif source[at] == "[":
            at = source.close(at) + 1
        elif source[at] == "@":
            at = _annotation(source, at) or at + 1
        else:
            if source.word(at) and source[at - 1] != ".":
                words.append(at)
            at += 1
    if source[at] != "(" or not 1 <= len(words) <= 2 or words[-1] != at - 1 or any(source[w] in _STATEMENTS for w in words):
        return None
    after = source.close(at) + 1
    while source[after] == "[":
        after = source.close(after) + 1
    if after != stop and source[after] not in ("throws", "default"):
        return None
    return Method(source[words[-1]], first, head, stop, source.close(stop) if source[stop] == "{" else stop, annotations)


def _type_in(source: Source, first: int, stop: int) -> bool:
    """Whether the head from ``first`` to ``stop`` declares a type."""
    return any(source[i] in _TYPES and source.word(i + 1) and source[i - 1] != "." for i in range(first, stop))


def _members(source: Source, first: int, stop: int, constants: bool = False) -> Iterator[Method]:
    """Methods of a type's body (tokens first to stop), and of the types inside of it."""
    at = first
    if constants:  # an enum's constants end at a semicolon; their bodies are bodies of types
        while at < stop and source[at] != ";":
            if source[at] == "{":
                yield from _members(source, at + 1, source.close(at))
            at = source.close(at) + 1 if source[at] in _CLOSED_BY else at + 1
        at += 1
    while at < stop:
        end = _member_end(source, at, stop)
        if _type_in(source, at, end) and source[end] == "{":
            kind = next(source[i] for i in range(at, end) if source[i] in _TYPES and source.word(i + 1))
            yield from _members(source, end + 1, source.close(end), kind == "enum")
        elif end < stop:
            method = _as_method(source, at, end)
            if method:
                yield method
                yield from _blocks(source, method.stop, method.last)
            else:
                yield from _blocks(source, at, source.close(end) if source[end] == "{" else end)
        at = (source.close(end) if source[end] == "{" else end) + 1


def _blocks(source: Source, first: int, stop: int) -> Iterator[Method]:
    """Methods of the types that stand in a block or an expression."""
    at = first
    while at < stop:
        if source[at] in _TYPES and source.word(at + 1) and source[at - 1] != ".":
            end = _member_end(source, at, stop)
            if end < stop and source[end] == "{":
                yield from _members(source, end + 1, source.close(end), source[at] == "enum")
                at = source.close(end)
        elif source[at] == "new" and source.word(at + 1):
            after = at + 1
            while source.word(after) or source[after] in (".", "<"):
                after = _angles(source, after) if source[after] == "<" else after + 1
            if source[after] == "(":
                yield from _blocks(source, after + 1, source.close(after))
                after = source.close(after) + 1
                if source[after] == "{":
                    yield from _members(source, after + 1, source.close(after))
                    after = source.close(after) + 1
                at = after - 1
        at += 1


def _javadocs(source: Source, method: Method) -> list[Token]:
    """Javadoc comments among a declaration's annotations, back to the first comment of another kind."""
    found: list[Token] = []
    for i in range(method.first, method.head + 1):
        for comment in source.comments.get(i, ()):
            found = [*found, comment] if comment.text.startswith("/**") and len(comment.text) > 4 else []
    return found


def _doc_text(comment: str) -> str | None:
    rows = (row.strip().removeprefix("*").strip() for row in comment.removeprefix("/**").removesuffix("*/").splitlines())
    return "\n".join(filter(None, rows)) or None


def _imports(source: Source) -> list[str]:
    out, at = [], 0
    while at < len(source.tokens):
        if source[at] == "import" and source[at - 1] in ("", ";", "}"):
            end = at
            while end < len(source.tokens) and source[end] != ";":
                end += 1
            out.append("".join(source[i] for i in range(at + 1 + (source[at + 1] == "static"), end)))
            at = end
        at += 1
    return out


def java_methods(text: str, path: str) -> list[dict]:
    """Methods and constructors of a Java source in order of appearance.

    A declaration starts at its javadoc or first annotation.  Its scope names the types
    declared before it; it depends on the imports whose simple names its code holds.
    """
    source, out = Source(text), []
    imports = _imports(source)
    simple = {name.rpartition(".")[2]: name for name in imports if not name.endswith("*")}
    types = [source.tokens[i + 1] for i in range(len(source.tokens) - 1) if source[i] in _TYPES and source[i + 1][:1].isupper() and source[i - 1] != "."]
    for method in sorted(_members(source, 0, len(source.tokens)), key=lambda m: m.first):
        docs, head, stop = _javadocs(source, method), source.tokens[method.head].start, source.tokens[method.stop].start
        start = min([source.tokens[method.first].start, *(d.start for d in docs)])
        end = source.tokens[method.last].end if method.last < len(source.tokens) - 1 or source[method.last] in "};" else len(text)
        code = text[start:end]
        first_byte = len(text[:start].encode())
        last_byte = first_byte + len(code.encode())
        scope = [t.text for t in types if t.end <= start]
        words = set(re.findall(r"\w+", code))
        digest = hashlib.sha1(f"{path}:{first_byte}:{last_byte}:{method.name}".encode()).hexdigest()[:12]
        out.append(
            {
                "node_id": f"{path}:{first_byte}-{last_byte}:{method.name}:{digest}", "language": "java", "node_type": "constructor" if scope and scope[-1] == method.name else "method",
                "name": method.name, "signature": " ".join(text[head:stop].split()), "raw_code": code, "docstring": _doc_text(docs[-1].text) if docs else None, "file_path": path,
                "start_byte": first_byte, "end_byte": last_byte, "start_line": text.count("\n", 0, start) + 1, "end_line": text.count("\n", 0, end) + 1, "scope_path": scope,
                "annotations": [text[source.tokens[a].start : source.tokens[b - 1].end] for a, b in method.annotations], "imports": imports,
                "dependencies": sorted(full for name, full in simple.items() if name in words and "A" <= name[:1] <= "Z"), "metadata": [("parser", "java-regex-fallback")],
            }
        )
    return out
