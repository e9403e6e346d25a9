"""Which source files do not parse (problem 2), by derivatives of their token streams.

A machine turns one line into tokens and feeds them to the grammar's derivative. What it carries from line to line (an open
comment or literal, the indentation, an open template) is small and hashable, so whole lines are remembered as well: the same
line in the same context isn't read twice, in whatever file. Runs of digits are shortened before that to what the form of a number
depends on: a leading zero and the largest digit; in shell, where they are parts of words, they stay. The memos are bounded and hold no result that they would change.

An empty derivative marks the failing token; an end whose derivative isn't nullable, or an open literal, means truncation.
"""

from __future__ import annotations

import re
import sys
from functools import cache
from typing import NamedTuple

from lodegraph.llm import grammars as G
from lodegraph.llm.derive import Grammar, Node

#: Remembered lines above which the memo of a language is dropped.
LINE_BOUND = 60_000
#: Longer lines, as of minified files, hardly come again.
LINE_CHARS = 200
#: Frames of nested derivatives. They take no C stack.
DEEPEST = 1_000_000


class Verdict(NamedTuple):
    valid: bool
    reason: str | None  # "unexpected", "truncated"
    line: int | None
    token: str | None


def _short(m: re.Match) -> str:
    """Another run of digits of the same form: led by a zero or not, and binary, octal or decimal."""
    x = m[0]
    if x == "0":
        return x
    most = max(x)
    return ("0" if x[0] == "0" else "") + ("9" if most > "7" else "7" if most > "1" else most)


class Machine:
    """What the languages share; the subclasses read lines."""

    #: whether digits play no part but in numbers
    digits = True
    #: numbers that aren't well formed
    bad = re.compile("(?!)")

    def __init__(self, grammar: str, sets: dict[str, list[str]]):
        self.g = Grammar(grammar, sets)
        self.memo: dict[tuple, tuple] = {}

    def begin(self) -> tuple:
        raise NotImplementedError

    def line(self, state: Node, mode: tuple, text: str) -> tuple[Node, tuple]:
        """The state and mode after one line; the empty state and (token,) where it failed."""
        raise NotImplementedError

    def end(self, state: Node, mode: tuple) -> bool:
        raise NotImplementedError

    def prepare(self, text: str) -> str:
        return text

    def check(self, text: str) -> Verdict:
        if self.g.full() or len(self.memo) > LINE_BOUND:
            self.g.forget()
            self.memo.clear()
        empty, memo, state, mode = self.g.empty, self.memo, self.g.start, self.begin()
        text = self.prepare(text.removeprefix("﻿"))
        if self.digits:
            text = re.sub("[0-9]+", _short, text)
        for i, x in enumerate(text.replace("\r\n", "\n").split("\n")):
            if len(x) > LINE_CHARS:
                got = self.line(state, mode, x)
            elif (got := memo.get((state, mode, x))) is None:
                got = memo[state, mode, x] = self.line(state, mode, x)
            state, mode = got
            if state is empty:
                return Verdict(False, "unexpected", i + 1, mode[0])
        return Verdict(True, None, None, None) if self.end(state, mode) else Verdict(False, "truncated", i + 1, None)


def _words(pattern: str) -> list[str]:
    return sorted(pattern.split(), key=len, reverse=True)


def _punct(words: str) -> str:
    return "|".join(map(re.escape, _words(words)))


_ID = r"[^\W\d]\w*"
_NUM = r"0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?\w*|(?:\d[\d_']*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?"
_STR = r'"(?:[^"\\]|\\.)*"'
_CHAR = r"'(?:[^'\\]|\\.)+'"


class Curly(Machine):
    """Languages with braces and /* comments */. mode: (kind, aux, stack, flag)."""

    #: what the subclasses set
    ids: frozenset = frozenset()
    nested = False
    asi = False
    go = False
    multiline_strings = False

    def __init__(self, grammar: str, sets, keywords, numbers: str, strings: str, punct: str, raw: str = "(?!)"):
        super().__init__(grammar, sets)
        self.keywords = frozenset(keywords)
        self.rx = re.compile(
            rf"(?P<w>\s+)|(?P<lc>//)|(?P<bc>/\*)|(?P<raw>{raw})|(?P<num>{numbers})|(?P<str>{strings})|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<p>{_punct(punct)})|(?P<x>.)", re.S
        )

    def begin(self) -> tuple:
        return ("", None, (), False)

    def end(self, state: Node, mode: tuple) -> bool:
        return mode[0] == "" and not mode[2] and state.null

    def number_ok(self, text: str, end: int) -> bool:
        return end >= len(text) or not (text[end].isalnum() or text[end] in "_$")

    def line(self, state: Node, mode: tuple, text: str) -> tuple[Node, tuple]:
        d, empty, rx, n = self.g.d, self.g.empty, self.rx, len(text)
        kind, aux, stack, flag = mode
        pos = 0
        while True:
            if kind == "c":
                pos, aux = self._comment(text, pos, aux)
                if aux:
                    return state, (kind, aux, stack, flag)
                kind = ""
            elif kind == "r":
                at = self._close(text, pos, aux)
                if at < 0:
                    return state, (kind, aux, stack, flag)
                pos, kind, aux = at, "", None
                state = d(state, "STR")
                flag = self.go
                if state is empty:
                    return empty, ("literal",)
            elif pos >= n:
                break
            m = rx.match(text, pos)
            if m is None:
                break
            what, start, pos = m.lastgroup, pos, m.end()
            if what == "w":
                continue
            if what == "lc":
                break
            if what == "bc":
                kind, aux = "c", 1
                continue
            if what == "raw":
                kind, aux = "r", self.closer(m[0])
                continue
            if what == "id":
                t = m[0] if m[0] in self.keywords else "ID"
                if self.go:
                    flag = t in ("ID", "break", "continue", "fallthrough", "return")
            elif what == "num":
                t = "NUM"
                flag = self.go
                if not self.number_ok(text, pos) or self.bad.fullmatch(m[0]):
                    return empty, (m[0],)
            elif what == "str":
                t = "CHAR" if m[0].endswith("'") and not self.asi else "STR"
                flag = self.go
            elif what == "p":
                t = m[0]
                if self.go:
                    flag = t in (")", "]", "}", "++", "--")
            elif what == "lt":
                t = "LT"
            else:
                return empty, (m[0],)
            state = d(state, t)
            if state is empty:
                return empty, (text[start:pos],)
        if self.go and flag:
            s = d(state, ";")
            if s is empty:
                return empty, ("newline",)
            state, flag = s, False
        return state, (kind, aux, stack, flag)

    def closer(self, opened: str) -> str:
        return opened

    def _close(self, text: str, pos: int, closer: str) -> int:
        at = text.find(closer, pos)
        return at if at < 0 else at + len(closer)

    def _comment(self, text: str, pos: int, depth: int) -> tuple[int, int]:
        if not self.nested:
            at = text.find("*/", pos)
            return (len(text), 1) if at < 0 else (at + 2, 0)
        for m in re.compile(r"/\*|\*/").finditer(text, pos):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end(), 0
        return len(text), depth


class Go(Curly):
    go = True

    bad = re.compile(r"0[0-9_]*[89][0-9_]*")

    def __init__(self):
        super().__init__(
            G.GO, {}, G.GO_KEYWORDS, _NUM + "i?", _STR + "|" + _CHAR,
            "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~", "`",
        )

    def end(self, state: Node, mode: tuple) -> bool:
        if mode[0]:
            return False
        return state.null or (mode[3] and self.g.d(state, ";").null)


class Java(Curly):
    bad = re.compile(r"0[0-9_]*[89][0-9_]*[lL]?")

    def __init__(self):
        soft = {"Id": ["ID", *G.JAVA_SOFT]}
        super().__init__(
            G.JAVA, soft, [*G.JAVA_KEYWORDS, *G.JAVA_SOFT], rf"(?:{_NUM})[lLfFdD]?", _STR + "|" + _CHAR,
            "<<= ... -> :: ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << + - * / % & | ^ < > = ! ~ ? : ; , . ( ) [ ] { } @", '"""',
        )


class Rust(Curly):
    nested = True

    def __init__(self):
        punct = "<<= ..= ... -> => :: .. && || == != <= >= += -= *= /= %= &= |= ^= << + - * / % & | ^ < > = ! ~ ? : ; , . ( ) [ ] { } @ # $ '"
        leaf = [*G.RUST_KEYWORDS, *G.RUST_SOFT, "ID", "NUM", "STR", "CHAR", "LT", "_", *(x for x in punct.split() if x not in "()[]{}'")]
        num = r"0[xob][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?(?:[a-zA-Z]\w*)?"
        super().__init__(
            G.RUST, {"Id": ["ID", *G.RUST_SOFT], "LEAF": leaf}, [*G.RUST_KEYWORDS, *G.RUST_SOFT, "_"], num,
            r"b?'(?:[^'\\\n]|\\[^\n]+?)'", punct.replace(" '", ""), r"""[bc]?r#*"|[bc]?\"""",
        )
        self.rx = re.compile(self.rx.pattern.replace("(?P<id>", "(?P<lt>'[^\\W\\d]\\w*(?!'))|(?P<id>(?:r\\#)?"), re.S)

    def closer(self, opened: str) -> str:
        return '"' + "#" * opened.count("#") if "r" in opened else "\\"

    def _close(self, text: str, pos: int, closer: str) -> int:
        if closer != "\\":
            return super()._close(text, pos, closer)
        m = re.compile(r'(?:[^"\\]|\\.|\\$)*"', re.S).match(text, pos)
        return m.end() if m else -1


class C(Curly):
    """mode's stack holds the open conditionals: (state before, state of the first branch, skipping, outer skipping)."""

    bad = re.compile(r"0[0-9']*[89][0-9']*[uUlL]*")

    def __init__(self):
        super().__init__(
            G.C, {}, G.C_KEYWORDS, rf"(?:{_NUM})[uUlLfFjJ]*", r"(?:u8|[uUL])?" + _STR + r"|[uUL]?" + _CHAR,
            "<<= >>= ... -> ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << >> + - * / % & | ^ < > = ! ~ ? : :: ; , . ( ) [ ] { }",
        )

    def line(self, state, mode, text):
        kind, aux, stack, flag = mode
        if kind == "pp":
            return state, ("pp" if text.endswith("\\") else "", None, stack, flag)
        if kind == "" and (m := re.match(r"\s*#\s*(\w*)\s*(.*)", text)):
            word, rest = m[1], m[2]
            skip = bool(stack) and stack[-1][2]
            if word in ("if", "ifdef", "ifndef"):
                stack = (*stack, (state, None, skip or (word == "if" and re.match(r"0+\s*(//|/\*|$)", rest) is not None), skip))
            elif word in ("elif", "else", "elifdef", "elifndef"):
                if not stack:
                    return self.g.empty, ("#" + word,)
                before, first, skipping, outer = stack[-1]
                stack = (*stack[:-1], (before, first if skipping or first is not None else state, outer, outer))
                state = before
            elif word == "endif":
                if not stack:
                    return self.g.empty, ("#endif",)
                before, first, skipping, _ = stack[-1]
                state = first if first is not None else before if skipping else state
                stack = stack[:-1]
            kind = "pp" if text.endswith("\\") else ""
            open_comment = "/*" in rest and "*/" not in rest.rpartition("/*")[2] and word != "include"
            return state, ("c" if open_comment and not kind else kind, 1 if open_comment and not kind else None, stack, flag)
        if stack and stack[-1][2]:
            return state, mode
        if text.endswith("\\"):
            text = text[:-1]
        return super().line(state, mode, text)


class Script(Curly):
    """JavaScript and TypeScript: templates, regular expressions and JSX nest; semicolons may be inserted.

    stack holds the open templates and JSX parts: a number counts braces inside a substitution, "`" is template text, "<" a tag, ">" its children.
    """

    asi = True

    def __init__(self, grammar: str, jsx: bool = False):
        soft, res = G.JS_SOFT, G.JS_RESERVED
        sets = {"Id": ["ID", *soft, "yield"], "Name": ["ID", *soft, *res]}
        super().__init__(
            grammar, sets, [*soft, *res], r"0[xX][0-9a-fA-F_]+n?|0[bBoO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?n?", _STR + r"|'(?:[^'\\]|\\.)*'",
            "<<= **= &&= ||= ??= === !== ... => ?. ++ -- ** && || ?? == != <= >= += -= *= /= %= &= |= ^= << + - * / % & | ^ < > = ! ~ ? : ; , . ( ) [ ] { } @",
        )
        self.jsx = jsx
        self.re = re.compile(r"/(?![*/])(?:[^/\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])+/[a-z]*")
        self.tag = re.compile(r"<\s*(?:>|[A-Za-z_$][\w.$:-]*(?=\s|/|>|$)(?!\s+extends\b))")
        self.hash = re.compile(r"#[^\W\d][\w$]*")

    def line(self, state: Node, mode: tuple, text: str) -> tuple[Node, tuple]:
        d, empty, rx, n = self.g.d, self.g.empty, self.rx, len(text)
        kind, aux, stack, flag = mode
        if kind == "" and not stack and state is self.g.start and text.startswith("#!"):
            return state, mode
        pos, nl = 0, True
        while True:
            if kind == "c":
                at = text.find("*/", pos)
                if at < 0:
                    return state, (kind, aux, stack, flag)
                pos, kind = at + 2, ""
            elif kind == "q":  # a string goes on after a backslash at the line's end
                m = re.compile(rf"(?:[^{aux}\\]|\\.)*{aux}", re.S).match(text, pos)
                if not m:
                    return (state, (kind, aux, stack, flag)) if text.endswith("\\") else (empty, ("string",))
                pos, kind, t = m.end(), "", "STR"
                state = d(state, t)
                if state is empty:
                    return empty, (t,)
                continue
            top = stack[-1] if stack else None
            if top == "`":
                m = re.compile(r"(?:[^`$\\]|\\.|\\$|\$(?!\{))*(`|\$\{)?", re.S).match(text, pos)
                if m[1] is None:
                    return state, (kind, aux, stack, flag)
                pos = m.end()
                t = "`$" if m[1] == "`" else "${"
                stack = stack[:-1] if t == "`$" else (*stack, 0)
                state = d(state, t)
                if state is empty:
                    return empty, (t,)
                continue
            if top == ">":
                m = re.compile(r"[^<{]*").match(text, pos)
                if m[0].strip():
                    state = d(state, "JTEXT")
                pos = m.end()
                if pos >= n:
                    return state, (kind, aux, stack, flag)
                if text[pos] == "{":
                    t, stack, pos = "j{", (*stack, 0), pos + 1
                elif text.startswith("</", pos):
                    t, stack, pos = "j</", (*stack[:-1], "</"), pos + 2
                else:
                    t, stack, pos = "j<", (*stack, "<"), pos + 1
                state = d(state, t)
                if state is empty:
                    return empty, (t,)
                continue
            if pos >= n:
                break
            if top == "<" or top == "</":
                m = re.compile(r"\s+|/\*.*?\*/|(?P<e>/?>)|(?P<n>[A-Za-z_$][\w.$:-]*)|(?P<s>\"[^\"]*\"|'[^']*')|(?P<o>[={<])").match(text, pos)
                if not m:
                    return empty, (text[pos],)
                pos = m.end()
                if m["e"]:
                    t = "j" + m["e"]
                    stack = stack[:-1] if top == "</" or t == "j/>" else (*stack[:-1], ">")
                elif m["n"]:
                    t = "JID"
                elif m["s"]:
                    t = "STR"
                elif m["o"] == "{":
                    t, stack = "j{", (*stack, 0)
                elif m["o"] == "<":
                    t = "<"
                elif m["o"]:
                    t = "="
                else:
                    continue
                state = d(state, t)
                if state is empty:
                    return empty, (t,)
                continue
            m = rx.match(text, pos)
            what, start, pos = m.lastgroup, pos, m.end()
            if what == "w":
                continue
            if what == "lc":
                break
            if what == "bc":
                kind = "c"
                continue
            if what == "id":
                t = m[0] if m[0] in self.keywords else "ID"
            elif what == "num":
                t = "NUM"
                if not self.number_ok(text, pos):
                    return empty, (m[0],)
            elif what == "str":
                t = "STR"
            elif what == "p":
                t = m[0]
                if t == "?." and text[pos : pos + 1].isdigit():
                    t, pos = "?", pos - 1
                if t in ("/", "/=") and d(state, t) is empty and (r := self.re.match(text, start)):
                    t, pos = "RE", r.end()
                elif t == "<" and self.jsx and d(state, "j<") is not empty and self.tag.match(text, start):
                    t = "j<"
                    stack = (*stack, "<")
                elif t == "{" and type(top) is int:
                    stack = (*stack[:-1], top + 1)
                elif t == "}" and type(top) is int:
                    if top:
                        stack = (*stack[:-1], top - 1)
                    else:
                        t, stack = "}$", stack[:-1]
            elif m[0] == "`":
                t, stack = "`", (*stack, "`")
            elif m[0] == "#" and (h := self.hash.match(text, start)):
                t, pos = "HASH", h.end()
            elif m[0] in "\"'" and text.endswith("\\"):
                kind, aux, pos = "q", m[0], n
                return state, (kind, aux, stack, flag)
            else:
                return empty, (m[0],)
            if nl and (flag or t in ("++", "--")) and (s := d(state, "ASI")) is not empty:
                state = s
            s = d(state, t)
            if s is empty and (nl or t == "}") and (s := d(state, "ASI")) is not empty:
                s = d(s, t)
            if s is empty:
                return empty, (text[start:pos],)
            state, nl = s, False
            flag = t in ("return", "break", "continue", "throw", "yield")
        return state, (kind, aux, stack, flag)

    def end(self, state: Node, mode: tuple) -> bool:
        return mode[0] == "" and not mode[2] and (state.null or self.g.d(state, "ASI").null)


class Python(Machine):
    """mode: (kind, quote, indents, depth, flag); indents are pairs of columns with tabs of eight and of one."""

    bad = re.compile(r"0[0-9_]*[1-9][0-9_]*|0[bB][01_]*[2-9].*|0[oO][0-7_]*[89].*")

    def __init__(self):
        super().__init__(G.PYTHON, {"Id": ["ID", *G.PY_SOFT]})
        self.keywords = frozenset([*G.PY_KEYWORDS, *G.PY_SOFT])
        self.rx = re.compile(
            r"(?P<w>[ \t\f]+)|(?P<c>#)|(?P<num>(?:0[xX][\da-fA-F_]+|0[oObB][\d_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[jJ]?))"
            r"|(?P<s>(?:[rRbBuUfFtT]|[bB][rR]|[rR][bB]|[fFtT][rR]|[rR][fFtT])?(?P<q>'''|\"\"\"|'|\"))|(?P<id>[^\W\d]\w*)|(?P<p>"
            + _punct("**= //= >>= <<= ... -> := += -= *= /= %= @= &= |= ^= ** // >> << <= >= == != + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =")
            + r")|(?P<bs>\\$)|(?P<x>.)",
            re.S,
        )

    def begin(self) -> tuple:
        return ("", None, ((0, 0),), 0, False)

    def line(self, state: Node, mode: tuple, text: str) -> tuple[Node, tuple]:
        d, empty, rx, n = self.g.d, self.g.empty, self.rx, len(text)
        kind, quote, indents, depth, flag = mode
        pos = 0
        if kind == "" and depth == 0 and not flag:
            body = text.lstrip(" \t\f")
            if not body or body[0] == "#":
                return state, mode
            lead = text[: n - len(body)]
            col = 0
            for c in lead:
                col = (col // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else col + 1
            here = (col, len(lead.rpartition("\f")[2]))
            if here[0] == indents[-1][0]:
                if here[1] != indents[-1][1]:
                    return empty, ("indentation",)
            elif here[0] > indents[-1][0]:
                if here[1] <= indents[-1][1]:
                    return empty, ("indentation",)
                state, indents = d(state, "INDENT"), (*indents, here)
                if state is empty:
                    return empty, ("indentation",)
            else:
                while here[0] < indents[-1][0]:
                    indents = indents[:-1]
                    state = d(state, "DEDENT")
                    if state is empty:
                        return empty, ("indentation",)
                if here != indents[-1]:
                    return empty, ("indentation",)
            pos = n - len(body)
        flag = False
        while True:
            if kind == "r":
                at, over = self._string(text, pos, quote)
                if at < 0:
                    if not over:
                        return empty, ("string",)
                    return state, (kind, quote, indents, depth, flag)
                pos, kind, quote = at, "", None
            if pos >= n:
                break
            m = rx.match(text, pos)
            what, start, pos = m.lastgroup, pos, m.end()
            if what == "w":
                continue
            if what == "c":
                break
            if what == "bs":
                flag = True
                break
            if what == "id":
                t = m[0] if m[0] in self.keywords else "ID"
            elif what == "num":
                t = "NUM"
                if self.bad.fullmatch(m[0]):
                    return empty, (m[0],)
                if pos < n and (text[pos].isalnum() or text[pos] == "_") and not re.match(r"(?:and|else|for|if|in|is|or|not)\b", text[pos:]):
                    return empty, (m[0],)
            elif m["q"]:
                t, kind, quote = "STR", "r", (m["q"], m["s"][:-1].lower() if len(m["q"]) == 1 else m["s"][:-3].lower())
            elif what == "p":
                t = m[0]
                if t in "([{":
                    depth += 1
                elif t in ")]}":
                    depth -= 1
            else:
                return empty, (m[0],)
            state = d(state, t)
            if state is empty or depth < 0:
                return empty, (text[start:pos],)
        if depth == 0 and not flag:
            state = d(state, "NL")
            if state is empty:
                return empty, ("newline",)
        return state, (kind, quote, indents, depth, flag)

    def _string(self, text: str, pos: int, quote: tuple[str, str]) -> tuple[int, bool]:
        """Where the literal ends, or -1 and whether it may go on in the next line."""
        q, prefix = quote
        if len(q) == 1 and ("f" in prefix or "t" in prefix):
            return self._formatted(text, pos, q)
        m = re.compile(r"(?:[^\\]|\\.|\\$)*?" + q, re.S).match(text, pos)
        if m:
            return m.end(), True
        return -1, len(q) == 3 or text.endswith("\\")

    def _formatted(self, text: str, pos: int, q: str) -> tuple[int, bool]:
        """A formatted literal of one line, whose fields may hold literals of their own."""
        depth, n = 0, len(text)
        while pos < n:
            c = text[pos]
            if c == "\\":
                pos += 2
                continue
            if depth == 0:
                if c == q:
                    return pos + 1, True
                if c == "{":
                    if text.startswith("{{", pos):
                        pos += 1
                    else:
                        depth = 1
                        if text[pos + 1 : pos + 2] == "}":
                            return -1, False
                elif c == "}":
                    if not text.startswith("}}", pos):
                        return -1, False
                    pos += 1
            elif c in "{[(":
                depth += 1
            elif c in "}])":
                depth -= 1
            elif c in "\"'":
                at = text.find(c, pos + 1)
                if at < 0:
                    return -1, False
                pos = at
            pos += 1
        return -1, text.endswith("\\")

    def end(self, state: Node, mode: tuple) -> bool:
        kind, _, indents, depth, flag = mode
        if kind or depth or flag:
            return False
        for _ in indents[1:]:
            state = self.g.d(state, "DEDENT")
        return state.null


class Bash(Machine):
    """mode: (stack, start, heredocs, extra): stack of contexts; start says whether a command may begin.

    Contexts: "(" a command list in parentheses, '"' a quoted text, "a" an array, "x" a [[ ]] test, and open spans that run over lines.
    """

    opens = frozenset("if then else elif while until do { ! time".split())

    digits = False

    def __init__(self):
        super().__init__(G.BASH, {"KW": []})
        self.keywords = frozenset(G.BASH_KEYWORDS)
        self.rx = re.compile(
            r"(?P<w>[ \t]+)|(?P<cont>\\$)|(?P<c>\#)|(?P<sub>\$\((?!\()|[<>]\()|(?P<ar>\$\(\(|\(\()|(?P<here><<(?!<)-?[ \t]*)|(?P<redir>[0-9]*(?:<<<|>>|<&|>&|<>|>\||<|>)|&>>?|[0-9]+(?=[<>]))"
            r"|(?P<op>;;&|;;|;&|&&|\|\||\|&|[;&|()])|(?P<dq>\$?\")|(?P<sq>\$?')|(?P<bt>`)|(?P<word>(?:[^\s;&|<>()\"'`$\\]|\\.|\$(?![({'\"])|\$\{)+)|(?P<x>.)",
            re.S,
        )

    def begin(self) -> tuple:
        return ((), True, (), None)

    def line(self, state: Node, mode: tuple, text: str) -> tuple[Node, tuple]:
        d, empty, n = self.g.d, self.g.empty, len(text)
        stack, start, heres, extra = mode
        if heres and extra == "body":
            strip, word = heres[0]
            if (text.lstrip("\t") if strip else text) == word:
                heres = heres[1:]
            return state, (stack, start, heres, "body" if heres else None)
        pos, glued = 0, False
        while True:
            top = stack[-1] if stack else None
            if isinstance(top, tuple):  # an open span: (kind, depth)
                pos, top = self._span(text, pos, top)
                if top is not None:
                    return state, ((*stack[:-1], top), start, heres, extra)
                stack = stack[:-1]
                glued = True
                continue
            if top == '"':
                m = re.compile(r'(?:[^"\\$`]|\\.|\\$|\$(?![({]))*', re.S).match(text, pos)
                pos = m.end()
                if pos >= n:
                    return state, (stack, start, heres, extra)
                if text[pos] == '"':
                    stack, pos, glued = stack[:-1], pos + 1, True
                elif text[pos] == "`":
                    stack, pos = (*stack, ("`", 0)), pos + 1
                elif text.startswith("$((", pos):
                    stack, pos = (*stack, ("((", 2)), pos + 3
                elif text.startswith("${", pos):
                    stack, pos = (*stack, ("{", 1)), pos + 2
                else:
                    state, stack, pos, start = d(state, "$("), (*stack, "("), pos + 2, True
                    if state is empty:
                        return empty, ("$(",)
                continue
            if pos >= n:
                break
            m = self.rx.match(text, pos)
            what, at, pos = m.lastgroup, pos, m.end()
            if what == "w":
                glued = False
                continue
            if what == "cont":
                return state, (stack, start, heres, extra)
            if what == "c" and not glued:
                break
            t = None
            if what in ("word", "c"):
                w = m[0]
                cut = w.find("${")
                if cut >= 0:
                    pos = at + cut + 2
                    stack = (*stack, ("{", 1))
                    w = w[:cut]
                elif w[-1] == "=" and text[pos : pos + 1] == "(" and re.match(r"[A-Za-z_]\w*(\[.*\])?\+?=$", w):
                    t, pos, stack = "A(", pos + 1, (*stack, "a")
                if t is None:
                    t = "W"
                    whole = cut < 0 and not glued and (pos >= n or text[pos] in " \t;&|<>()")
                    if top == "x":
                        if whole and w == "]]":
                            t, stack = "]]", stack[:-1]
                    elif whole and w in self.keywords and top != "a":
                        if w == "in":
                            t = "in" if d(state, "in") is not empty else "W"
                        elif start or (w == "do" and d(state, "do") is not empty):
                            t = w
                if t == "W" and glued and not start:
                    glued = True
                    continue
                if t == "[[":
                    stack = (*stack, "x")
                start = t in self.opens or t in ("fi", "done", "esac", "}")
                glued = t != "A("
            elif what == "dq":
                t, stack, start = "W", (*stack, '"'), False
            elif what == "sq":
                t, stack, start = "W", (*stack, ("$'" if m[0] == "$'" else "'", 0)), False
            elif what == "bt":
                t, stack, start = "W", (*stack, ("`", 0)), False
            elif what == "sub":
                t, stack, start, glued = "$(", (*stack, "("), True, False
            elif what == "ar":
                if m[0] == "$((":
                    t, stack, start = "W", (*stack, ("((", 2)), False
                elif start and d(state, "ARITH") is not empty:
                    t, stack, start = "ARITH", (*stack, ("((", 2)), False
                elif top not in ("x", "a") and d(state, "ARITH") is not empty:
                    t, stack, start = "ARITH", (*stack, ("((", 2)), False
                else:
                    t, pos, start = "OP" if top == "x" else "(", at + 1, True
                    stack = stack if top == "x" else (*stack, "(")
            elif what == "here":
                w = re.compile(r"(?:[^\s;&|<>()\"'\\]|\\.|\"[^\"]*\"|'[^']*')+").match(text, pos)
                if not w:
                    return empty, (m[0],)
                pos, t, start = w.end(), "HEREDOC", False
                heres = (*heres, ("-" in m[0], re.sub(r"[\"'\\]", "", w[0])))
            elif what == "redir":
                t, glued = ("OP" if top == "x" else "REDIR"), False
                if m[0].isdigit():
                    continue
                start = start and t != "REDIR"
            elif what == "op":
                t, glued = m[0], False
                if top == "x":
                    t = "OP"
                elif t == "(":
                    stack, start = (*stack, "("), True
                elif t == ")":
                    if top in ("(", "a"):
                        stack = stack[:-1]
                        start = False
                        glued = True
                    else:  # after a pattern of case
                        start = True
                    start = start or d(d(state, ")"), "NL") is not empty and top == "("
                else:
                    t = ";;" if t in (";;&", ";&") else t
                    start = True
            else:
                return empty, (m[0],)
            state = d(state, t)
            if state is empty:
                return empty, (text[at:pos],)
            if t == ")" and top == "(" and stack and stack[-1] == '"':
                start = False
            elif t == "W" and not start and d(state, "{") is not empty:  # the name of a function
                start = True
        if heres:
            extra = "body"
        if top == "x" or top != '"':
            state = d(state, "NL")
            if state is empty:
                return empty, ("newline",)
            if top not in ("x", "a"):
                start = True
        return state, (stack, start, heres, extra)

    def _span(self, text: str, pos: int, top: tuple) -> tuple[int, tuple | None]:
        """Reads on in a span that holds no commands: quotes, backquotes, arithmetic or a parameter."""
        kind, depth = top
        n = len(text)
        if kind in ("'", "$'", "`"):
            rx = r"[^']*'" if kind == "'" else r"(?:[^'\\]|\\.|\\$)*'" if kind == "$'" else r"(?:[^`\\]|\\.|\\$)*`"
            m = re.compile(rx, re.S).match(text, pos)
            return (m.end(), None) if m else (n, top)
        a, b = ("(", ")") if kind == "((" else ("{", "}")
        while pos < n:
            c = text[pos]
            if c == "\\":
                pos += 1
            elif kind == "{" and c in "\"'" and (e := text.find(c, pos + 1)) > 0:
                pos = e
            elif c == a and (kind == "((" or text[pos - 1 : pos] == "$"):
                depth += 1
            elif c == b:
                depth -= 1
                if not depth:
                    return pos + 1, None
            pos += 1
        return n, (kind, depth)

    def end(self, state: Node, mode: tuple) -> bool:
        return not mode[0] and state.null


# The extensions of code files and the languages they stand for.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "go": "Go", "java": "Java", "c": "C", "h": "C", "rs": "Rust", "sh": "Shell",
}
_MACHINES = {
    "ts": lambda: Script(G.TS), "tsx": lambda: Script(G.TSX, True), "js": lambda: Script(G.JS), "py": Python, "go": Go, "java": Java, "c": C, "rs": Rust, "sh": Bash,
}
_SAME = {"mjs": "js", "cjs": "js", "h": "c"}


@cache
def machine(ext: str) -> Machine:
    return _MACHINES[ext]() if ext in _MACHINES else machine(_SAME[ext])


def check(ext: str, text: str) -> Verdict:
    """Whether text is syntactically valid in the language of an extension. Empty text is valid; nesting beyond what DEEPEST holds is not."""
    if not text.strip():
        return Verdict(True, None, None, None)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, DEEPEST))
    try:
        return machine(ext).check(text)
    except RecursionError:
        return Verdict(False, "unexpected", None, "nesting")
    finally:
        sys.setrecursionlimit(before)
