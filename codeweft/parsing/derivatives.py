"""Memoised parsing with derivatives.

The language that may still follow is a sum of concatenations of grammar symbols; its derivative by a token is the sum
of what each summand leaves. A concatenation is a hash-consed list, so equal remainders are one object, and derivatives
are memoised three times: of a symbol, of a list and of a whole sum. The memo is shared by all texts a worker parses;
after a while nearly every token is one dictionary look-up, whatever the grammar's ambiguity.

The derivative by the token at fault is empty, which marks the place; a language at the end that lacks the empty word
tells that the text was cut off. Rules must not be left-recursive.

Notation: `name: a b | c`, with ( ), ?, * and +; 'x' is the token x, an upper-case word a token class.
"""

from __future__ import annotations

import re

NEWLINE_BEFORE = 1 << 12  # added to a token's number where a line break precedes it
_PIECE = re.compile(r"\s*('[^']*'|[A-Za-z_]\w*|[|()?*+])")
MAX_STATES = 60_000


class Grammar:
    def __init__(self, text: str, start: str, copies: dict[str, tuple[list[str], set[str]]] | None = None):
        """copies: suffix -> (rules on the left edge, first tokens left out): variants that can't begin with those."""
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.rules: dict[int, list[tuple[int, ...]]] = {}
        self.helpers = 0
        parsed: dict[str, list[list[str]]] = {}
        self._parsed = parsed
        for block in re.split(r"\n(?=\w+:)", text.strip()):
            name, _, body = block.partition(":")
            parsed[name.strip()] = self._alternatives(_PIECE.findall(body), name.strip())
        for suffix, (spine, without) in (copies or {}).items():
            self._copy(parsed, suffix, spine, without)
        for name, alts in parsed.items():
            self.rules[self.id(name)] = [tuple(self.id(s) for s in a) for a in alts]
        self.start = self.id(start)
        self.nullable = self._nullable()

    def id(self, name: str) -> int:
        if name not in self.ids:
            self.ids[name] = len(self.names)
            self.names.append(name)
        return self.ids[name]

    def token(self, text: str) -> int:
        """Number of a token ('x' or CLASS); one that the grammar doesn't know has no derivative."""
        return self.id(text)

    def _copy(self, parsed: dict, suffix: str, spine: list[str], without: set[str]) -> None:
        reach = set(spine)
        for name in list(parsed):  # helper rules made for ?, * and + on the left edge belong to it too
            if "~" in name and name.split("~")[0] in reach:
                reach.add(name)
        for name in [n for n in parsed if n in reach]:
            alts = []
            for a in parsed[name]:
                if a and a[0] in without:
                    continue
                out = list(a)
                for k, s in enumerate(out):  # the first symbol, and the next ones while those before may be empty
                    if s in reach:
                        out[k] = s + suffix
                    if not (s in parsed and self._may_be_empty(parsed, s)):
                        break
                alts.append(out)
            parsed[name + suffix] = alts

    def _may_be_empty(self, parsed: dict, s: str) -> bool:
        return any(not a for a in parsed[s])

    def _alternatives(self, parts: list[str], owner: str) -> list[list[str]]:
        alts, _ = self._read(parts, 0, owner)
        return alts

    def _read(self, parts: list[str], i: int, owner: str) -> tuple[list[list[str]], int]:
        alts: list[list[str]] = [[]]
        while i < len(parts):
            p = parts[i]
            if p == ")":
                return alts, i + 1
            if p == "|":
                alts.append([])
                i += 1
                continue
            if p == "(":
                inner, i = self._read(parts, i + 1, owner)
                sym = self._helper(inner, owner)
            else:
                sym, i = p, i + 1
            while i < len(parts) and parts[i] in "?*+":
                op, i = parts[i], i + 1
                if op == "?":
                    sym = self._helper([[], [sym]], owner)
                elif op == "*":
                    star = self._helper([[]], owner)
                    self._parsed[star].append([sym, star])
                    sym = star
                else:
                    star = self._helper([[]], owner)
                    self._parsed[star].append([sym, star])
                    sym = self._helper([[sym, star]], owner)
            alts[-1].append(sym)
        return alts, i

    def _helper(self, alts: list[list[str]], owner: str) -> str:
        self.helpers += 1
        name = f"{owner}~{self.helpers}"
        self._parsed[name] = alts
        return name

    def _nullable(self) -> set[int]:
        empty: set[int] = set()
        while True:
            more = {n for n, alts in self.rules.items() if n not in empty and any(all(s in empty for s in a) for a in alts)}
            if not more:
                return empty
            empty |= more


class Parser:
    """Derivatives of one grammar. State 0 is the empty language."""

    def __init__(self, grammar: Grammar, inserted: str | None = None):
        """inserted: a token that may be put in where a line break, a closing brace or the end is at fault."""
        self.g = grammar
        self.inserted = grammar.token(inserted) if inserted else None
        self.brace = grammar.token("'}'")
        self.of_symbol: dict[tuple[int, int], tuple[tuple[int, ...], ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.sym, self.rest, self.cons = [-1], [-1], {}
        self.of_list: dict[tuple[int, int], frozenset[int]] = {}
        self.states: list[tuple[int, ...]] = [()]
        self.state_id: dict[tuple[int, ...], int] = {(): 0}
        self.moves: list[dict[int, int]] = [{}]
        self.first = self._state(frozenset([self._push((self.g.start,), 0)]))

    def _push(self, symbols: tuple[int, ...], onto: int) -> int:
        for s in reversed(symbols):
            key = (s, onto)
            at = self.cons.get(key)
            if at is None:
                at = self.cons[key] = len(self.sym)
                self.sym.append(s)
                self.rest.append(onto)
            onto = at
        return onto

    def _state(self, lists: frozenset[int]) -> int:
        key = tuple(sorted(lists))
        at = self.state_id.get(key)
        if at is None:
            at = self.state_id[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return at

    def _derive_symbol(self, n: int, t: int) -> tuple[tuple[int, ...], ...]:
        key = (n, t)
        got = self.of_symbol.get(key)
        if got is None:
            out: dict[tuple[int, ...], None] = {}
            rules, empty = self.g.rules, self.g.nullable
            for alt in rules[n]:
                for k, s in enumerate(alt):
                    if s in rules:
                        for left in self._derive_symbol(s, t):
                            out[left + alt[k + 1 :]] = None
                    elif s == t:
                        out[alt[k + 1 :]] = None
                    if s not in empty:
                        break
            got = self.of_symbol[key] = tuple(out)
        return got

    def _derive_list(self, c: int, t: int) -> frozenset[int]:
        key = (c, t)
        got = self.of_list.get(key)
        if got is None:
            out: set[int] = set()
            at = c
            while at:
                s, rest = self.sym[at], self.rest[at]
                if s in self.g.rules:
                    for left in self._derive_symbol(s, t):
                        out.add(self._push(left, rest))
                    if s not in self.g.nullable:
                        break
                else:
                    if s == t:
                        out.add(rest)
                    break
                at = rest
            got = self.of_list[key] = frozenset(out)
        return got

    def _derive(self, state: int, t: int) -> int:
        out: set[int] = set()
        for c in self.states[state]:
            out |= self._derive_list(c, t)
        return self._state(frozenset(out))

    def _move(self, state: int, t: int) -> int:
        kind = t & (NEWLINE_BEFORE - 1)
        to = self._derive(state, kind)
        if not to and self.inserted is not None and (t != kind or kind == self.brace):
            mid = self._derive(state, self.inserted)
            to = mid and self._derive(mid, kind)
        self.moves[state][t] = to
        return to

    def _done(self, state: int) -> bool:
        for c in self.states[state]:
            while c and self.sym[c] in self.g.nullable:
                c = self.rest[c]
            if not c:
                return True
        return False

    def parse(self, tokens: list[int]) -> int:
        """-1 if the tokens are a word of the language, the index of the token at fault, or len(tokens) if cut off."""
        if len(self.states) > MAX_STATES or len(self.sym) > 4 * MAX_STATES:
            self._reset()
        moves, state = self.moves, self.first
        for i, t in enumerate(tokens):
            to = moves[state].get(t)
            if to is None:
                to = self._move(state, t)
            if not to:
                return i
            state = to
        if self._done(state) or (self.inserted is not None and self._done(self._derive(state, self.inserted))):
            return -1
        return len(tokens)
