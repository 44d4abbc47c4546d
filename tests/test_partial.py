"""What stands sound in broken Python files."""

import ast
import random

import pytest

from oreloom.operators.extract import python_functions, sound_functions
from oreloom.operators.partial import sound_source


def names(source):
    return [(".".join(f["scope_path"]), f["name"]) for f in sound_functions(source, "x.py")]


@pytest.mark.parametrize(
    "source, want",
    [
        ("def a():\n    return 1\n\nx = (1,\n", [("", "a")]),
        ("x = (1,\ndef a():\n    return 1\n", [("", "a")]),
        ("def a(:\n    pass\n@d\n@e(1)\nasync def b():\n    def c(): pass\n", [("", "b"), ("b", "c")]),
        ("class A(B):\n    def f(self): return 1\n    def g(self: return 2\n    class C:\n        def h(self): pass\n        def i(\n\ndef j(): pass\n", [("A", "f"), ("A.C", "h"), ("", "j")]),
        ("class A:\n    def g(self: return 2\n", []),
        ("def a():\n    '''\ndef no(): pass\n'''\n    return ')'\n\ndef b(\n", [("", "a")]),
        ("def a():\n    '''\ndef no(): pass\n", []),
        ("def a():\n    try:\n        x\n    except E:\n        y\nif z:\n    pass\nelse:\n    def b(): pass\nfoo bar\n", [("", "a"), ("", "b")]),
        ("def a():\n\treturn 1\n   def b(): pass\n", []),
        ("", []), ("\x00", []), ("#only\n(", []), ("def a(x,\n  y):\n    return [\n1]\nz = }\n", [("", "a")]),
        ("def a():\r\n    return 1\r\n)\r\ndef b():\r    return 2\r", [("", "b")]),
    ],
)
def test_sound_functions(source, want):
    assert names(source) == want


def test_places_are_places_in_the_file():
    source = "import os\n\x0c\nbad bad\nclass K:\n    é = 'ü'\n    @p\n    def f(self):\n        return 'é'\n    def g(:\n"
    (f,) = sound_functions(source, "x.py")
    data = source.encode()
    assert data[f["start_byte"] : f["end_byte"]].decode() == f["raw_code"] == "    @p\n    def f(self):\n        return 'é'" or f["raw_code"].lstrip() == "@p\n    def f(self):\n        return 'é'"
    assert f["imports"] == ["import os"] and (f["start_line"], f["end_line"]) == (6, 8) and f["annotations"] == ["@p"]


def test_a_cut_file_yields_what_was_whole():
    """Whatever is cut off or struck out, what comes out parses and keeps every line in its place."""
    source = open(__file__, encoding="utf-8").read()
    whole = {(f["name"], f["raw_code"]) for f in python_functions(source, "x")}
    r = random.Random(1)
    for _ in range(60):
        a, new, gone = r.randrange(len(source)), r.choice(["", "(", "'''", "]", " = = "]), r.choice([0, 1, 40])
        broken = source[:a] + new + source[a + gone :]
        sound = sound_source(broken)
        ast.parse(sound)
        assert broken.count("\n") == sound.count("\n")
        if not set("'\"") & set(new + source[a - 2 : a + gone + 2]):  # a quote turns strings and code around
            found = {(f["name"], f["raw_code"]) for f in sound_functions(broken, "x")}
            assert len(found & whole) >= len(whole) - 1
