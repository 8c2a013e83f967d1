"""Validity of a text in its language, and the place of the token at fault, by parsing with derivatives."""

from __future__ import annotations

import functools

from codeweft.functions.source_tokens import is_balanced
from codeweft.parsing import grammars as G
from codeweft.parsing.derivatives import Grammar, Parser
from codeweft.parsing.lexers import CLexer, JavaScriptLexer, PythonLexer

LANGUAGES = ("python", "javascript", "c", "cpp")


@functools.lru_cache(maxsize=8)
def _tools(language: str):
    if language == "python":
        g = Grammar(G.PYTHON, "file")
        return PythonLexer(g), Parser(g)
    if language == "javascript":
        g = Grammar(G.JAVASCRIPT, "program", {"_ns": (G.JAVASCRIPT_SPINE, {"'{'", "'function'", "'class'"}), "_nb": (G.JAVASCRIPT_SPINE, {"'{'"})})
        return JavaScriptLexer(g), Parser(g, inserted="ASI")
    g = Grammar(G.C if language == "c" else G.CPP, "unit")
    return CLexer(g, language == "cpp"), Parser(g)


def check(text: str | None, language: str) -> tuple[str, int] | None:
    """None for a valid text, else (verdict, place): 'token' at the place of the token at fault, 'cut off' at the end."""
    if not text or not text.strip():
        return None
    lexer, parser = _tools(language)
    kinds, at = lexer.lex(text)
    bad = parser.parse(kinds)
    if bad < 0:
        return None
    if bad >= len(kinds):
        return "cut off", len(text)
    return ("cut off" if kinds[bad] == lexer.open else "token"), at[bad]


def parses(text: str, language: str) -> bool:
    """Whether a text is valid: Python by its own parser, the other languages by derivatives."""
    return is_balanced(text, language) if language == "python" else check(text, language) is None
