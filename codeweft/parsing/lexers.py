"""Token streams of Python, JavaScript, C and C++ for the derivative parser.

A lexer gives token numbers of its grammar and their places. What is no token of the language gives the token BAD, which
no grammar knows, so the parse fails there; an open literal or comment at the end gives OPEN.
"""

from __future__ import annotations

import re

from codeweft.parsing.derivatives import NEWLINE_BEFORE, Grammar

_NAME = r"[^\W\d]\w*"


class Lexer:
    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.bad, self.open = grammar.token("BAD"), grammar.token("OPEN")
        self.words = {n[1:-1]: i for n, i in grammar.ids.items() if n[0] == "'"}


class PythonLexer(Lexer):
    _string = (
        r"(?P<pre>[rRbBuU]{0,2}|[rR][bB]|[bB][rR])(?:\"\"\"(?:[^\"\\]|\\(?:.|\n)|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\(?:.|\n)|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\(?:.|\n))*\"|'(?!'')(?:[^'\\\n]|\\(?:.|\n))*')"
    )
    _token = re.compile(
        r"(?P<ws>[ \t\f]+)|(?P<fs>(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|\"|'))|(?P<str>" + _string + r")|(?P<name>" + _NAME + r")"
        r"|(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
        r"|(?P<nl>\r\n?|\n)|(?P<com>#[^\r\n]*)|(?P<cont>\\(?:\r\n?|\n))|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])"
    )
    _after_number = {"and", "else", "for", "if", "in", "is", "not", "or"}

    def __init__(self, grammar: Grammar):
        super().__init__(grammar)
        t = grammar.token
        self.NAME, self.NUMBER, self.STRING, self.NEWLINE, self.INDENT, self.DEDENT = (t(x) for x in ("NAME", "NUMBER", "STRING", "NEWLINE", "INDENT", "DEDENT"))
        self.FSTART, self.FEND, self.FOPEN, self.FCLOSE, self.FEQ, self.FCONV, self.FCOLON = (t(x) for x in ("FSTART", "FEND", "FOPEN", "FCLOSE", "FEQ", "FCONV", "FCOLON"))

    def lex(self, text: str) -> tuple[list[int], list[int]]:
        kinds: list[int] = []
        at: list[int] = []
        text = text.removeprefix("\ufeff")
        pos, n, depth = 0, len(text), 0
        levels = [(0, 0)]
        fresh = True  # at the start of a logical line
        match, words, NAME = self._token.match, self.words, self.NAME
        while pos < n:
            if fresh:
                end = pos
                while end < n and text[end] in " \t\f":
                    end += 1
                if end < n and text[end] in "\r\n#":
                    m = re.compile(r"(?:#[^\r\n]*)?(?:\r\n?|\n|$)").match(text, end)
                    pos = m.end()
                    continue
                if end >= n:
                    break
                if text[end] != "\\":
                    col = alt = 0
                    for c in text[pos:end]:
                        if c == "\t":
                            col, alt = (col // 8 + 1) * 8, alt + 1
                        elif c == "\f":
                            col = alt = 0
                        else:
                            col, alt = col + 1, alt + 1
                    pos = end
                    if col == levels[-1][0] and alt != levels[-1][1] or (col > levels[-1][0]) != (alt > levels[-1][1]):
                        kinds.append(self.bad)
                        at.append(pos)
                        return kinds, at
                    if col > levels[-1][0]:
                        levels.append((col, alt))
                        kinds.append(self.INDENT)
                        at.append(pos)
                    else:
                        while col < levels[-1][0]:
                            levels.pop()
                            kinds.append(self.DEDENT)
                            at.append(pos)
                        if (col, alt) != levels[-1]:
                            kinds.append(self.bad)
                            at.append(pos)
                            return kinds, at
                fresh = False
                continue
            m = match(text, pos)
            if m is None:
                kinds.append(self.open if text[pos] in "\"'" else self.bad)
                at.append(pos)
                return kinds, at
            what, start, pos = m.lastgroup, pos, m.end()
            if what == "name":
                kinds.append(words.get(m[0], NAME))
                at.append(start)
                if pos < n and text[pos] in "\"'" and m[0].lower() in ("r", "b", "u", "br", "rb", "f", "fr", "rf"):
                    kinds.append(self.open)
                    at.append(pos)
                    return kinds, at
            elif what == "op":
                op = m[0]
                if op in "([{":
                    depth += 1
                elif op in ")]}":
                    depth = max(0, depth - 1)
                kinds.append(words.get(op, self.bad))
                at.append(start)
            elif what in ("str", "pre"):
                kinds.append(self.STRING)
                at.append(start)
            elif what == "num":
                kinds.append(self.NUMBER)
                at.append(start)
                v = m[0]
                if pos < n and (text[pos].isalnum() or text[pos] == "_"):
                    w = re.compile(r"\w+").match(text, pos)[0]
                    if w not in self._after_number:
                        kinds[-1] = self.bad
                        return kinds, at
                if len(v) > 1 and v[0] == "0" and v.replace("_", "").isdigit() and v.strip("0_"):
                    kinds[-1] = self.bad
                    return kinds, at
            elif what == "nl":
                if not depth:
                    kinds.append(self.NEWLINE)
                    at.append(start)
                    fresh = True
            elif what == "fs":
                pos = self._fstring(text, start, pos, m[0], kinds, at)
                if pos < 0:
                    return kinds, at
            elif what == "cont" and pos >= n:
                kinds.append(self.bad)
                at.append(start)
                return kinds, at
        if kinds and not fresh:
            kinds.append(self.NEWLINE)
            at.append(n)
        kinds += [self.DEDENT] * (len(levels) - 1)
        at += [n] * (len(levels) - 1)
        return kinds, at

    def _fstring(self, text: str, start: int, pos: int, head: str, kinds: list[int], at: list[int]) -> int:
        """Tokens of an f-string from after its opening quotes; its end, or -1 after an error token."""
        quote = head.lstrip("fFrR")
        raw = "r" in head.lower()
        kinds.append(self.FSTART)
        at.append(start)
        end = self._fbody(text, pos, quote, raw, kinds, at, spec=False)
        if end >= 0:
            kinds.append(self.FEND)
            at.append(end)
            return end + len(quote)
        return -1

    def _fbody(self, text: str, pos: int, quote: str, raw: bool, kinds: list[int], at: list[int], spec: bool) -> int:
        n = len(text)
        while pos < n:
            c = text[pos]
            if text.startswith(quote, pos) and not spec:
                return pos
            if spec and c == "}":
                return pos
            if c == "\\":
                pos += 2
            elif c in "\r\n" and (len(quote) == 1 or spec and len(quote) == 1):
                break
            elif c == "{":
                if text.startswith("{{", pos) and not spec:
                    pos += 2
                    continue
                pos = self._field(text, pos, quote, raw, kinds, at)
                if pos < 0:
                    return -1
            elif c == "}":
                if text.startswith("}}", pos):
                    pos += 2
                    continue
                kinds.append(self.bad)
                at.append(pos)
                return -1
            elif spec and text.startswith(quote, pos):
                break
            else:
                pos += 1
        kinds.append(self.open)
        at.append(min(pos, n))
        return -1

    def _field(self, text: str, pos: int, quote: str, raw: bool, kinds: list[int], at: list[int]) -> int:
        kinds.append(self.FOPEN)
        at.append(pos)
        pos, n, depth = pos + 1, len(text), 0
        while pos < n:
            c = text[pos]
            if not depth and c == "}":
                kinds.append(self.FCLOSE)
                at.append(pos)
                return pos + 1
            if not depth and c == "=" and re.compile(r"=\s*[!:}]").match(text, pos) and text[pos + 1 : pos + 2] != "=":
                kinds.append(self.FEQ)
                at.append(pos)
                pos += 1
                continue
            if not depth and c == "!" and text[pos + 1 : pos + 2] != "=":
                m = re.compile(r"!\s*[rsa](?=\s*[:}])").match(text, pos)
                kinds.append(self.FCONV if m else self.bad)
                at.append(pos)
                if not m:
                    return -1
                pos = m.end()
                continue
            if not depth and c == ":":
                kinds.append(self.FCOLON)
                at.append(pos)
                pos = self._fbody(text, pos + 1, quote, raw, kinds, at, spec=True)
                if pos < 0:
                    return -1
                continue
            if c in "\r\n":
                pos += 1
                continue
            m = self._token.match(text, pos)
            if m is None or m.lastgroup == "num" and m.end() < n and (text[m.end()].isalpha() or text[m.end()] == "_"):
                kinds.append(self.open if c in "\"'" else self.bad)
                at.append(pos)
                return -1
            what, start, pos = m.lastgroup, pos, m.end()
            if what == "name":
                kinds.append(self.words.get(m[0], self.NAME))
            elif what == "num":
                kinds.append(self.NUMBER)
            elif what in ("str", "pre"):
                kinds.append(self.STRING)
            elif what == "fs":
                pos = self._fstring(text, start, pos, m[0], kinds, at)
                if pos < 0:
                    return -1
                continue
            elif what == "op":
                depth += (m[0] in "([{") - (m[0] in ")]}")
                kinds.append(self.words.get(m[0], self.bad))
            else:
                continue
            at.append(start)
        kinds.append(self.open)
        at.append(n)
        return -1


class JavaScriptLexer(Lexer):
    _ident = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
    _token = re.compile(
        r"(?P<ws>[^\S\r\n\u2028\u2029]+|\ufeff)|(?P<nl>[\r\n\u2028\u2029]+)|(?P<com>//[^\r\n\u2028\u2029]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)|(?P<name>" + _ident + r")|(?P<priv>#" + _ident + r")"
        r"|(?P<num>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|0n|[1-9](?:_?\d)*n|(?:0|[1-9](?:_?\d)*|0\d+)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d(?:_?\d)*)?|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?)"
        r"|(?P<str>\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')"
        r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|\*\*|<<|>>|[-+*%&|^!~<>=?:;,.()\[\]{}])|(?P<slash>/)|(?P<tick>`)"
    )
    _regex = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
    _template = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
    _before_regex_words = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "await", "yield", "default"}
    _keywords = {"enum"}
    _restricted = {"return", "break", "continue", "throw", "yield"}

    def __init__(self, grammar: Grammar):
        super().__init__(grammar)
        t = grammar.token
        self.NAME, self.NUMBER, self.STRING, self.REGEX, self.PRIVATE, self.PREINC, self.ASI = (t(x) for x in ("NAME", "NUMBER", "STRING", "REGEX", "PRIVATE", "PREINC", "ASI"))
        self.TSTRING, self.THEAD, self.TMID, self.TTAIL = (t(x) for x in ("TSTRING", "THEAD", "TMID", "TTAIL"))

    def lex(self, text: str) -> tuple[list[int], list[int]]:
        kinds: list[int] = []
        at: list[int] = []
        pos, n = 0, len(text)
        match, words, NAME = self._token.match, self.words, self.NAME
        if text.startswith("#!"):
            pos = len(text.split("\n", 1)[0])
        line = False  # a line break since the last token
        value = False  # whether a slash divides here
        held = False  # after return, break, ...
        parens: list[bool] = []  # whether what follows the closing parenthesis is a statement
        braces: list[str] = []  # 't': of a template, 'v': of a value, 's': of statements
        last = ""
        while pos < n:
            m = match(text, pos)
            if m is None:
                c = text[pos]
                kinds.append(self.open if c in "\"'" or text.startswith("/*", pos) else self.bad)
                at.append(pos)
                return kinds, at
            what, start, pos = m.lastgroup, pos, m.end()
            if what == "ws":
                continue
            if what == "nl":
                line = True
                continue
            if what == "com":
                line = line or m[0][1] == "*" and ("\n" in m[0] or "\r" in m[0])
                continue
            if held and line and m[0] not in (";", "}"):
                kinds.append(self.ASI)
                at.append(start)
            held = False
            s = m[0]
            if what == "name":
                kind = words.get(s, NAME)
                if last in (".", "?.") :
                    value = True
                else:
                    value = s not in self._before_regex_words
                    held = s in self._restricted
            elif what == "num":
                kind, value = self.NUMBER, True
                if pos < n and (text[pos].isalnum() or text[pos] in "_$"):
                    kind = self.bad
            elif what == "str":
                kind, value = self.STRING, True
            elif what == "priv":
                kind, value = self.PRIVATE, True
            elif what == "tick":
                kind, pos = self._piece(text, pos, self.TSTRING, self.THEAD)
                if kind == self.THEAD:
                    braces.append("t")
                value = kind == self.TSTRING
            elif what == "slash" and text.startswith("*", pos):
                kind = self.open
            elif what == "slash":
                r = None if value else self._regex.match(text, start)
                if r:
                    kind, pos, value, s = self.REGEX, r.end(), True, "/re/"
                else:
                    kind, value = (words["/="], False) if text.startswith("/=", start) else (words["/"], False)
                    if kind == words["/="]:
                        pos = start + 2
            else:
                kind = words.get(s, self.bad)
                if s == "(":
                    parens.append(last in ("if", "while", "for", "with"))
                    value = False
                elif s == ")":
                    value = not (parens.pop() if parens else False)
                elif s == "{":
                    braces.append("v" if last in ("(", ",", "=", ":", "[", "?", "return", "=>(", "&&", "||", "??", "+") else "s")
                    value = False
                elif s == "}":
                    top = braces.pop() if braces else "s"
                    if top == "t":
                        kind, pos = self._piece(text, pos, self.TTAIL, self.TMID)
                        if kind == self.TMID:
                            braces.append("t")
                        value = kind == self.TTAIL
                    else:
                        value = top == "v"
                elif s == "]":
                    value = True
                elif s in ("++", "--"):
                    if line:
                        kind = self.PREINC
                else:
                    value = False
            last = s
            kinds.append(kind + NEWLINE_BEFORE if line else kind)
            at.append(start)
            if kind in (self.bad, self.open):
                kinds[-1] = kind
                return kinds, at
            line = False
        return kinds, at

    def _piece(self, text: str, pos: int, whole: int, part: int) -> tuple[int, int]:
        end = self._template.match(text, pos).end()
        if text.startswith("`", end):
            return whole, end + 1
        if text.startswith("${", end):
            return part, end + 2
        return self.open, end


class CLexer(Lexer):
    _token = re.compile(
        r"(?P<ws>(?:[ \t\v\f\r\n]|\\\r?\n)+)|(?P<com>//(?:[^\\\n]|\\\r?\n|\\.)*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)"
        r"|(?P<str>(?:u8|[uUL])?(?:R\"(?P<mark>[^()\\\s]{0,16})\([\s\S]*?\)(?P=mark)\"|\"(?:[^\"\\\n]|\\(?:\r?\n|.))*\"))|(?P<chr>(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+')|(?P<name>(?:[^\W\d]|\$)[\w$]*)"
        r"|(?P<num>\.?\d(?:[eEpP][+-]|'(?=[\da-fA-F])|[\w.])*)|(?P<op>->\*|<<=|>>=|\.\.\.|<=>|\.\*|::|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~!<>=?:;,.(){}\[\]])"
    )
    _number = re.compile(r"(?:0[xX][\da-fA-F']+|0[bB][01']+|\d[\d']*)(?:[uU]?(?:ll?|LL?|z|Z)?|(?:ll?|LL?)[uU])$|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?[fFlL]?$|0[xX][\da-fA-F.]+[pP][+-]?\d+[fFlL]?$")
    _directive = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\\\n]|\\\r?\n|\\.)*)$", re.M)
    _known = {"define", "undef", "include", "include_next", "line", "error", "warning", "pragma", "ident", "import", ""}

    def __init__(self, grammar: Grammar, cpp: bool):
        super().__init__(grammar)
        self.cpp = cpp
        self.NAME, self.NUMBER, self.STRING, self.CHAR = (grammar.token(x) for x in ("NAME", "NUMBER", "STRING", "CHAR"))
        if cpp:
            for word, same in (("and", "&&"), ("or", "||"), ("not", "!"), ("and_eq", "&="), ("or_eq", "|="), ("not_eq", "!="), ("bitand", "&"), ("bitor", "|"), ("xor", "^"), ("compl", "~")):
                self.words[word] = self.words[same]
        else:
            for word, same in (("__inline", "inline"), ("__inline__", "inline"), ("__restrict", "restrict"), ("__const", "const"), ("__volatile__", "volatile"), ("__asm__", "asm"), ("__typeof__", "typeof"), ("static_assert", "_Static_assert"), ("alignas", "_Alignas")):
                if same in self.words:
                    self.words[word] = self.words[same]

    def lex(self, text: str) -> tuple[list[int], list[int]]:
        kinds: list[int] = []
        at: list[int] = []
        pos, n = 0, len(text)
        taken: list[list[bool]] = []  # of each open conditional: [this branch counts, one has counted]
        match, words, NAME = self._token.match, self.words, self.NAME
        directives = "#" in text
        fresh = True
        while pos < n:
            if directives and fresh:
                d = self._directive.match(text, pos)
                if d:
                    word, rest = d[1], d[2].strip()
                    pos = d.end()
                    if "/*" in rest and "*/" not in rest.split("/*")[-1]:
                        end = text.find("*/", pos)
                        pos = n if end < 0 else end + 2
                    live = all(x[0] for x in taken)
                    if word in ("if", "ifdef", "ifndef"):
                        on = not (word == "if" and re.match(r"(?:0|false|\(0\))\s*(?:$|/[/*]|&&)", rest))
                        taken.append([on, on])
                        if live and word != "if" and not re.match(r"[^\W\d]\w*", rest):
                            kinds.append(self.bad)
                            at.append(d.start())
                            return kinds, at
                    elif word in ("else", "elif", "elifdef", "elifndef") and taken:
                        on = not taken[-1][1] and not (word == "elif" and re.match(r"0\s*(?:$|/[/*])", rest))
                        taken[-1] = [on, taken[-1][1] or on]
                    elif word == "endif" and taken:
                        taken.pop()
                    elif live and word not in self._known:
                        kinds.append(self.bad)
                        at.append(d.start())
                        return kinds, at
                    continue
                if taken and not all(x[0] for x in taken):  # a line that doesn't count
                    end = text.find("\n", pos)
                    pos = n if end < 0 else end + 1
                    continue
            m = match(text, pos)
            if m is None:
                kinds.append(self.open if text[pos] in "\"'" or text.startswith("/*", pos) else self.bad)
                at.append(pos)
                return kinds, at
            what, start, pos = m.lastgroup, pos, m.end()
            if what == "ws":
                if directives and "\n" in m[0]:
                    fresh, pos = True, start + m[0].rindex("\n") + 1
                    if pos < m.end() and not self._directive.match(text, pos) and all(x[0] for x in taken):
                        pos, fresh = m.end(), False
                continue
            fresh = False
            if what == "com":
                fresh = m[0][1] == "*" and "\n" in m[0]
                continue
            s = m[0]
            if what == "name":
                kind = words.get(s, NAME)
            elif what == "op" and s == "/" and text.startswith("*", pos):
                kind = self.open
            elif what == "op":
                kind = words.get(s)
                if kind is None:
                    if self.cpp and s in (">>", ">>=", "<=>"):
                        kind = None
                    elif s == "::":
                        kind = self.bad
                    else:
                        kind = self.bad
                if s == ">>" and self.cpp:
                    kinds += [words[">"], words[">"]]
                    at += [start, start + 1]
                    continue
                if s == ">>=" and self.cpp and "'>>='" not in self.g.ids:
                    kinds += [words[">"], words[">="]]
                    at += [start, start + 1]
                    continue
                if kind is None:
                    kind = self.bad
            elif what == "num":
                kind = self.NUMBER if self._number.match(s) or self.cpp and re.match(r"[\d.']+(?:[eE][+-]?\d+)?_?[a-z]\w*$", s) and s[0] != "0" and re.search(r"(?:_\w+|h|min|s|ms|us|ns|if|il|i)$", s) else self.bad
            elif what == "chr":
                kind = self.CHAR
            else:  # a raw string's mark is a group of its own
                kind = self.STRING
            kinds.append(kind)
            at.append(start)
            if kind in (self.bad, self.open):
                return kinds, at
        if taken:
            kinds.append(self.bad)
            at.append(n)
        return kinds, at
