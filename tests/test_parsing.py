"""Parsers of the core: validity and the place at fault."""

import pytest

from codeweft.parsing.derivatives import Grammar, Parser
from codeweft.parsing.validity import check, parses

VALID = {
    "python": ["x = 1\n", "def f(a, *, b=2):\n    return [i for i in a if i]\n", ""],
    "javascript": ["let a = b?.c ?? 1;", "(x) => { return x }", "class A { #p = 1; static { } get q() { return this.#p } }", "a = b\n++c"],
    "c": ["int f(int a) { return a ? 1 : 2; }", "#if 0\nint = ;\n#endif\nint x;"],
    "cpp": ["template <class T> T f(T a) { return a; }", "auto g = [](int x) -> int { return x; };"],
}
BROKEN = {
    "python": [("x = (1,\n", "token"), ("def f(:\n    pass\n", "token"), ("return = 2\n", "token")],
    "javascript": [("let = ;", "token"), ("f(", "cut off"), ("<<<<<<< HEAD\nlet a;\n", "token"), ("'open", "cut off")],
    "c": [("int = 4;", "token"), ("int f() { return 1;", "cut off"), ("int = a 5;", "token")],
    "cpp": [("return return x;", "token"), ("class A { int x;", "cut off")],
}


@pytest.mark.parametrize(("language", "text"), [(g, x) for g, xs in VALID.items() for x in xs])
def test_valid(language, text):
    assert parses(text, language) and check(text, language) is None


@pytest.mark.parametrize(("language", "text", "verdict"), [(g, *x) for g, xs in BROKEN.items() for x in xs])
def test_broken(language, text, verdict):
    assert not parses(text, language) and check(text, language)[0] == verdict


def test_derivatives_place():
    p = Parser(Grammar("s: 'a' s 'b' | 'a' 'b'", "s"))
    ids = {n[1]: i for n, i in Grammar("s: 'a' s 'b' | 'a' 'b'", "s").ids.items() if n[0] == "'"}
    parse = lambda w: p.parse([ids[c] for c in w])
    assert parse("aabb") == -1 and parse("aabbb") == 4 and parse("aab") == 3
