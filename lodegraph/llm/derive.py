"""Memoised parsing with derivatives.

A grammar is a set of regular expressions over tokens and rule names. The derivative of an expression by a token is what may
follow that token; it is the empty expression where the token can't stand. Expressions are interned, so that equal remainders
are one object, and each object remembers its derivatives: after a while a parse is one dictionary look-up a token, for all
files of a worker together. The memo is dropped when it grows past a bound, which changes no result.

Rules may recurse everywhere but at their left end.
"""

from __future__ import annotations

import re

EMPTY_KIND, EPS_KIND, TOK, SEQ, ALT, STAR, REF = range(7)
#: Interned expressions of a grammar above which its memo is dropped.
MEMO_BOUND = 100_000


class Node:
    __slots__ = ("kind", "a", "b", "null", "d", "n")

    def __init__(self, kind, a, b, null, n):
        self.kind, self.a, self.b, self.null, self.n = kind, a, b, null, n
        self.d: dict[str, Node] = {}


class Grammar:
    """A compiled grammar; start is the expression of its first rule."""

    def __init__(self, text: str, sets: dict[str, list[str]] | None = None):
        self.known: dict[tuple, Node] = {}
        self.count = 0
        self.empty = Node(EMPTY_KIND, None, None, False, -1)
        self.eps = Node(EPS_KIND, None, None, True, -2)
        self.rules: dict[str, Node] = {}
        self.sets = sets or {}
        self.tokens: set[str] = set()
        self._read(text)
        self.start = self.rules[next(iter(self.rules))]
        self.base = dict(self.known)

    # building

    def _new(self, key: tuple, kind: int, a, b, null: bool) -> Node:
        if (n := self.known.get(key)) is None:
            self.count += 1
            n = self.known[key] = Node(kind, a, b, null, self.count)
        return n

    def tok(self, t: str) -> Node:
        self.tokens.add(t)
        return self._new((TOK, t), TOK, t, None, False)

    def seq(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == SEQ:
            return self.seq(a.a, self.seq(a.b, b))
        return self._new((SEQ, a.n, b.n), SEQ, a, b, a.null and b.null)

    def alt(self, parts) -> Node:
        flat: dict[int, Node] = {}
        for p in parts:
            if p.kind == ALT:
                flat.update((x.n, x) for x in p.a)
            elif p is not self.empty:
                flat[p.n] = p
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        own = tuple(sorted(flat))
        return self._new((ALT, *own), ALT, tuple(flat[n] for n in own), None, any(flat[n].null for n in own))

    def star(self, a: Node) -> Node:
        return self._new((STAR, a.n), STAR, a, None, True)

    # deriving

    def d(self, n: Node, t: str) -> Node:
        """What may follow t at the start of n."""
        got = n.d.get(t)
        if got is None:
            k = n.kind
            if k == TOK:
                got = self.eps if n.a == t else self.empty
            elif k == SEQ:
                got = self.seq(self.d(n.a, t), n.b)
                if n.a.null:
                    got = self.alt((got, self.d(n.b, t)))
            elif k == ALT:
                got = self.alt([self.d(x, t) for x in n.a])
            elif k == STAR:
                got = self.seq(self.d(n.a, t), n)
            elif k == REF:
                got = self.d(self.rules[n.a], t)
            else:
                got = self.empty
            n.d[t] = got
        return got

    def full(self) -> bool:
        return self.count - len(self.base) > MEMO_BOUND

    def forget(self) -> None:
        """Drop everything but the grammar's own expressions."""
        self.known = dict(self.base)
        for n in self.base.values():
            n.d = {}
        self.count = max((n.n for n in self.base.values()), default=0)

    # reading

    def _read(self, text: str) -> None:
        bodies: dict[str, list[str]] = {}
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            if line.strip() and not line.startswith("#"):
                name, _, body = line.partition(":")
                bodies[name.strip()] = re.findall(r"'[^' ]+'|\w+|[()|*+?%]", body)
        self.names = set(bodies)
        nullable: set[str] = set()
        trees = {k: _Reader(v).alternatives() for k, v in bodies.items()}
        while True:
            more = {k for k, t in trees.items() if k not in nullable and self._nullable(t, nullable)}
            if not more:
                break
            nullable |= more
        self.nullable = nullable
        for k, t in trees.items():
            self.rules[k] = self._build(t)

    def _nullable(self, t, known: set[str]) -> bool:
        if isinstance(t, str):
            return t in known
        op = t[0]
        return op in "*?" or (op == "|" and any(self._nullable(x, known) for x in t[1:])) or (op in ".+" and all(self._nullable(x, known) for x in t[1:]))

    def _build(self, t) -> Node:
        if isinstance(t, str):
            if t[0] == "'":
                return self.tok(t[1:-1])
            if t in self.names:
                return self._new((REF, t), REF, t, None, t in self.nullable)
            if t in self.sets:
                return self.alt([self.tok(x) for x in self.sets[t]])
            return self.tok(t)
        op, parts = t[0], [self._build(x) for x in t[1:]]
        if op == "|":
            return self.alt(parts)
        if op == "*":
            return self.star(parts[0])
        if op == "+":
            return self.seq(parts[0], self.star(parts[0]))
        if op == "?":
            return self.alt((parts[0], self.eps))
        out = self.eps
        for p in reversed(parts):
            out = self.seq(p, out)
        return out


class _Reader:
    """Reads one rule's body: juxtaposition, |, postfix * + ?, and x % y for x separated by y."""

    def __init__(self, words: list[str]):
        self.words, self.at = words, 0

    def _peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def alternatives(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("|", *parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            x = self._item()
            if self._peek() == "%":
                self.at += 1
                x = (".", x, ("*", (".", self._item(), x)))
            parts.append(x)
        return parts[0] if len(parts) == 1 else (".", *parts)

    def _item(self):
        w = self._peek()
        self.at += 1
        if w == "(":
            x = self.alternatives()
            self.at += 1
        else:
            x = w
        while self._peek() and self._peek() in "*+?":
            x = (self._peek(), x)
            self.at += 1
        return x
