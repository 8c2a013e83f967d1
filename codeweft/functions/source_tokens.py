"""A light reader of brace languages: tokens, matching brackets, functions and calls.

It needs no grammar and tolerates broken text: an unmatched bracket closes at the end.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

_TOKENS = re.compile(
    r"(?P<com>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<pre>^[ \t]*#(?:[^\\\n]|\\\r?\n|\\.)*)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|::|->|\.\.\.|[^\s\w])",
    re.S | re.M,
)
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "return", "sizeof", "function", "else", "do", "new", "typeof", "await", "throw", "case", "delete", "defined", "alignof", "decltype", "static_assert"}


@dataclass
class Found:
    """One function: names and places are those of its text as it stands in the file (bytes of UTF-8)."""

    name: str
    start: int
    end: int


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens(text: str, language: str) -> list[Token]:
    out = []
    for m in _TOKENS.finditer(text):
        kind = m.lastgroup
        if kind == "com" or kind == "pre" and language in ("c", "cpp"):
            continue
        out.append(Token(kind, m[0], m.start(), m.end()))
    return out


def brackets(toks: list[Token]) -> dict[int, int]:
    pairs, stack = {}, []
    closing = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(toks):
        if t.kind != "op":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in closing:
            while stack and toks[stack[-1]].text != closing[t.text]:
                pairs[stack.pop()] = i
            if stack:
                j = stack.pop()
                pairs[j], pairs[i] = i, j
    for j in stack:
        pairs[j] = len(toks) - 1
    return pairs


def _bound_name(toks: list[Token], i: int) -> str | None:
    """Name that the expression at token i is given: declared name, assigned target text, or key."""
    j = i - 1
    if j < 0:
        return None
    if toks[j].text == "=":
        k = j - 1
        while k >= 0 and (toks[k].kind == "name" or toks[k].text == ".") and toks[k].text not in ("const", "let", "var"):
            k -= 1
        target = "".join(t.text for t in toks[k + 1 : j])
        return target or None
    if toks[j].text == ":" and j and toks[j - 1].kind in ("name", "str"):
        return toks[j - 1].text.strip("\"'")
    return None


def javascript_functions(text: str) -> list[Found | None]:
    toks = tokens(text, "javascript")
    pair = brackets(toks)
    out: list[Found] = []
    skip = -1  # inside a function without a name nothing is looked for
    holder: list[tuple[int, bool]] = []  # (closing token, whether members stand there)
    for i, t in enumerate(toks):
        while holder and i > holder[-1][0]:
            holder.pop()
        if t.text == "{":
            before = toks[i - 1].text if i else ""
            k, is_class = i - 1, False
            while k >= 0 and i - k < 8 and (toks[k].kind == "name" or toks[k].text == "."):
                is_class = is_class or toks[k].text == "class"
                k -= 1
            holder.append((pair.get(i, len(toks)), is_class or before in ("=", "(", ",", ":", "[", "return")))
        if i <= skip:
            continue
        first = i - 1 if i and toks[i - 1].text == "async" else i
        name = body = None
        if t.text == "function":
            k = i + 1
            if k < len(toks) and toks[k].text == "*":
                k += 1
            if k < len(toks) and toks[k].kind == "name":
                name, k = toks[k].text, k + 1
            else:
                name = _bound_name(toks, first)
            if k < len(toks) and toks[k].text == "(":
                k = pair.get(k, len(toks)) + 1
                if k < len(toks) and toks[k].text == "{":
                    body = (k, pair.get(k, len(toks) - 1))
        elif t.text == "=>" and i:
            p = pair.get(i - 1, i - 1) if toks[i - 1].text == ")" else i - 1
            first = p - 1 if p and toks[p - 1].text == "async" else p
            name = _bound_name(toks, first)
            if i + 1 < len(toks) and toks[i + 1].text == "{":
                body = (i + 1, pair.get(i + 1, len(toks) - 1))
            else:
                k = i + 1
                while k < len(toks) and toks[k].text not in (",", ";", ")", "]", "}"):
                    k = pair[k] + 1 if toks[k].text in "([{" and k in pair else k + 1
                body = (i + 1, k - 1)
        elif t.kind == "name" and t.text not in _CONTROL and holder and holder[-1][1] and i + 1 < len(toks) and toks[i + 1].text == "(":
            before = toks[i - 1].text if i else ""
            k = pair.get(i + 1, len(toks)) + 1
            if before in ("{", "}", ",", ";", "async", "get", "set", "static", "*") and k < len(toks) and toks[k].text == "{":
                name, body = t.text, (k, pair.get(k, len(toks) - 1))
                while first and toks[first - 1].text in ("async", "get", "set", "static", "*"):
                    first -= 1
        if body is None:
            continue
        if name is None:
            skip = max(skip, body[1])
            continue
        out.append(Found(name, toks[first].start, toks[min(body[1], len(toks) - 1)].end))
    return out


def c_functions(text: str, language: str) -> list[Found]:
    toks = tokens(text, language)
    pair = brackets(toks)
    out: list[Found] = []
    i, begin = 0, 0
    while i < len(toks):
        t = toks[i]
        if t.text in (";", "}"):
            begin = i + 1
        elif t.text == "{":
            head = [x.text for x in toks[begin:i]]
            if not {"namespace", "class", "struct", "extern", "union"} & set(head) or "(" in head:
                i = pair.get(i, len(toks) - 1)  # no function of interest inside a block
                begin = i + 1
            else:
                begin = i + 1
        elif t.kind == "name" and t.text not in _CONTROL and i + 1 < len(toks) and toks[i + 1].text == "(":
            k = pair.get(i + 1, len(toks)) + 1
            depth = k
            while depth < len(toks) and (toks[depth].text in ("const", "noexcept", "override", "final", "->", "&", "::", "<", ">", "*") or toks[depth].kind == "name" and toks[depth].text != "try"):
                depth += 1
            if depth < len(toks) and toks[depth].text == ":" and language == "cpp":
                while depth < len(toks) and toks[depth].text not in ("{", ";"):
                    depth = pair[depth] + 1 if toks[depth].text == "(" and depth in pair else depth + 1
            if depth < len(toks) and toks[depth].text == "{" and i > begin:
                end = pair.get(depth, len(toks) - 1)
                out.append(Found(t.text, toks[begin].start, toks[end].end))
                i, begin = end, end + 1
            else:
                i = k - 1 if k - 1 > i else i
        i += 1
    return out


_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)", re.M)


def python_functions(text: str) -> list[Found]:
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    out: list[Found] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        marks = list(_DEF.finditer(text))
        for m in marks:
            indent, at = len(m[1].expandtabs()), text.find("\n", m.end())
            end = at if at >= 0 else len(text)
            while at >= 0:
                nxt = text.find("\n", at + 1)
                line = text[at + 1 : nxt if nxt >= 0 else len(text)]
                if line.strip() and len(line.expandtabs()) - len(line.expandtabs().lstrip()) <= indent:
                    break
                if line.strip():
                    end = at + 1 + len(line.rstrip())
                at = nxt
            out.append(Found(m[2], m.start() + len(m[1]), max(end, m.end())))
        return out

    def place(line: int, byte: int) -> int:
        row = text[starts[line - 1] : starts[line]]
        return starts[line - 1] + len(row.encode()[:byte].decode(errors="replace"))

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(Found(child.name, place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)))
            walk(child)

    walk(tree)
    return out


def find_functions(text: str, language: str) -> list[Found]:
    """Named functions in order of their beginnings; functions without a name and what they hold are left out."""
    if language == "python":
        found = python_functions(text)
    elif language == "javascript":
        found = javascript_functions(text)
    elif language in ("c", "cpp"):
        found = c_functions(text, language)
    else:
        found = []
    return sorted(found, key=lambda f: (f.start, -f.end))


_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\s*(?:\?\.|\.|->|::)\s*[A-Za-z_$][\w$]*)*)\s*\(")
_DECLARES = re.compile(r"(?:\bdef|\bfunction\s*\*?|\bclass)\s+$")


def call_names(code: str, language: str) -> list[str]:
    """Callee texts in order, nested functions included; a definition's own name is none."""
    if language == "python":
        clean = re.sub(r"(?s)\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*", lambda m: " " * len(m[0]), code)
    else:
        clean = re.sub(r"(?s)//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", lambda m: " " * len(m[0]), code)
    out = []
    for m in _CALL.finditer(clean):
        name = re.sub(r"\s|\?", "", m[1])
        if name in _CONTROL or _DECLARES.search(clean, max(0, m.start() - 12), m.start()):
            continue
        out.append(name)
    if language in ("c", "cpp") and out:
        head = re.match(r"[^({;]*?([A-Za-z_~]\w*)\s*\(", clean)
        if head and out[0].split("::")[-1] == head[1]:
            out = out[1:]
    return out


def is_balanced(text: str, language: str) -> bool:
    """Whether brackets pair up and no literal or block comment stays open. For Python: whether it parses."""
    if language == "python":
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return False
        return True
    stack = []
    for t in tokens(text, language):
        if t.kind == "str" and (len(t.text) < 2 or t.text[-1] != t.text[0] or t.text.endswith("\\" + t.text[0]) and not t.text.endswith("\\\\" + t.text[0])):
            return False
        if t.kind == "op" and t.text in "([{":
            stack.append(t.text)
        elif t.kind == "op" and t.text in ")]}":
            if not stack or stack.pop() + t.text not in ("()", "[]", "{}"):
                return False
    return not stack and text.count("/*") <= text.count("*/")
