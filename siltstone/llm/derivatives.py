"""Memoised parsing with derivatives over token classes.

A grammar is a set of expressions (token, sequence, alternative, repetition, reference, excluded
start), all hash-consed: equal expressions are one node. The derivative of a node by a token is the
expression that must follow; it is computed once per (node, token) and kept. A text is parsed by
taking derivatives token by token from the start symbol: an empty derivative marks the exact failing
token, and an end expression that does not accept the empty text means truncation. Since nodes are
shared, texts that nest alike walk the same kept transitions, and the parser runs as a lazily built
automaton over any context-free grammar without left recursion, ambiguity included.
"""

from __future__ import annotations

import re

EMPTY, EPS = 0, 1
#: Nodes after which the tables are built anew, so that a worker's memory stays flat.
NODE_BOUND = 400_000


class Grammar:
    """A grammar written as ``name = expression ;`` with ``'x'`` or ``CLASS`` tokens, ``[ ]`` optional,
    ``{ }`` repeated, ``( | )`` choice and ``!'x'`` in front for an expression not starting with ``x``."""

    def __init__(self, text: str, start: str):
        self.source, self.start_name = text, start
        self.tokens: dict[str, int] = {}
        self.rules: dict[str, object] = {}
        self._read(text)
        self._reset()

    # reading -----------------------------------------------------------------------------------
    def _read(self, text: str) -> None:
        toks = re.findall(r"'[^']*'|[A-Za-z_]\w*|[=;|()\[\]{}!]", re.sub(r"(?m)^\s*--.*$", "", text))
        at = 0

        def choice():
            nonlocal at
            alts = [sequence()]
            while at < len(toks) and toks[at] == "|":
                at += 1
                alts.append(sequence())
            return ("alt", alts) if len(alts) > 1 else alts[0]

        def sequence():
            nonlocal at
            parts = []
            while at < len(toks) and toks[at] not in ("|", ")", "]", "}", ";"):
                parts.append(item())
            return ("seq", parts)

        def item():
            nonlocal at
            t = toks[at]
            at += 1
            if t == "!":
                banned = [toks[at].strip("'")]
                at += 1
                while toks[at] == "!":
                    banned.append(toks[at + 1].strip("'"))
                    at += 2
                return ("not", banned, item())
            if t in "([{" and len(t) == 1:
                inner = choice()
                at += 1
                return {"(": inner, "[": ("alt", [inner, ("seq", [])]), "{": ("star", inner)}[t]
            if t[0] == "'":
                return ("tok", t[1:-1])
            return ("tok", t) if t.isupper() else ("ref", t)

        while at < len(toks):
            name = toks[at]
            at += 2
            self.rules[name] = choice()
            at += 1

    def token(self, name: str) -> int:
        if name not in self.tokens:
            self.tokens[name] = len(self.tokens)
        return self.tokens[name]

    # nodes -------------------------------------------------------------------------------------
    def _reset(self) -> None:
        self.nodes: list[tuple] = [("0",), ("1",)]
        self.ids: dict[tuple, int] = {}
        self.null: list[bool] = [False, True]
        self.memo: dict[tuple[int, int], int] = {}
        self.bodies: dict[str, int] = {}
        self.nullable_rules = self._nullable_rules()
        self.start = self._build(("ref", self.start_name))
        self.moves: dict[int, dict[int, int]] = {}

    def _nullable_rules(self) -> set[str]:
        known: set[str] = set()

        def null(e) -> bool:
            k = e[0]
            if k in ("tok",):
                return False
            if k == "ref":
                return e[1] in known
            if k == "seq":
                return all(map(null, e[1]))
            if k == "alt":
                return any(map(null, e[1]))
            if k == "star":
                return True
            return null(e[2])

        while True:
            more = {n for n, e in self.rules.items() if n not in known and null(e)}
            if not more:
                return known
            known |= more

    def _node(self, key: tuple, null: bool) -> int:
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.nodes)
            self.nodes.append(key)
            self.null.append(null)
        return n

    def seq(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        k = self.nodes[a]
        if k[0] == "s":
            return self.seq(k[1], self.seq(k[2], b))
        return self._node(("s", a, b), self.null[a] and self.null[b])

    def alt(self, parts) -> int:
        flat: set[int] = set()
        for p in parts:
            if p == EMPTY:
                continue
            k = self.nodes[p]
            if k[0] == "a":
                flat |= k[1]
            else:
                flat.add(p)
        if not flat:
            return EMPTY
        if len(flat) == 1:
            return next(iter(flat))
        f = frozenset(flat)
        return self._node(("a", f), any(self.null[p] for p in f))

    def _build(self, e) -> int:
        k = e[0]
        if k == "tok":
            return self._node(("t", self.token(e[1])), False)
        if k == "ref":
            if e[1] not in self.rules:
                raise KeyError(f"no rule {e[1]}")
            return self._node(("r", e[1]), e[1] in self.nullable_rules)
        if k == "seq":
            out = EPS
            for p in reversed(e[1]):
                out = self.seq(self._build(p), out)
            return out
        if k == "alt":
            return self.alt([self._build(p) for p in e[1]])
        if k == "star":
            return self._node(("*", self._build(e[1])), True)
        inner = self._build(e[2])
        return self._node(("n", frozenset(self.token(b) for b in e[1]), inner), self.null[inner])

    def derive(self, n: int, t: int) -> int:
        got = self.memo.get((n, t))
        if got is not None:
            return got
        k = self.nodes[n]
        kind = k[0]
        if kind == "t":
            out = EPS if k[1] == t else EMPTY
        elif kind == "s":
            out = self.seq(self.derive(k[1], t), k[2])
            if self.null[k[1]]:
                out = self.alt((out, self.derive(k[2], t)))
        elif kind == "a":
            out = self.alt([self.derive(p, t) for p in k[1]])
        elif kind == "r":
            body = self.bodies.get(k[1])
            if body is None:
                body = self.bodies[k[1]] = self._build(self.rules[k[1]])
            out = self.derive(body, t)
        elif kind == "*":
            out = self.seq(self.derive(k[1], t), n)
        elif kind == "n":
            out = EMPTY if t in k[1] else self.derive(k[2], t)
        else:
            out = EMPTY
        self.memo[n, t] = out
        return out

    # parsing -----------------------------------------------------------------------------------
    def run(self, classes) -> tuple[str, int]:
        """``("ok", n)``, ``("token", i)`` for the failing token's index, or ``("end", n)`` for truncation."""
        if len(self.nodes) > NODE_BOUND:
            self._reset()
        moves, state, i = self.moves, self.start, 0
        row = moves.get(state)
        if row is None:
            row = moves[state] = {}
        for t in classes:
            nxt = row.get(t)
            if nxt is None:
                nxt = row[t] = self.derive(state, t)
            if nxt == EMPTY:
                return "token", i
            if nxt != state:
                state = nxt
                row = moves.get(state)
                if row is None:
                    row = moves[state] = {}
            i += 1
        return ("ok", i) if self.null[state] else ("end", i)
