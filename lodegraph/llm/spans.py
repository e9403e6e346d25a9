"""Comments and literals of source files, found by one regular expression a language.

Only the starts of comments and literals are matched, so that the text between them is skipped at the expression's own speed.
Files that do not parse are read as far as they go: an open literal ends with its line, an open block at the end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from typing import NamedTuple


class Span(NamedTuple):
    kind: str  # "c" comment, "s" literal
    start: int
    end: int
    body: int  # where the content begins and ends
    until: int


_DQ = r'"(?P<dq>(?:[^"\\\n]|\\.)*)(?:"|(?=\n)|\Z)'
_SQ = r"'(?P<sq>(?:[^'\\\n]|\\.)*)(?:'|(?=\n)|\Z)"
_LINE = r"//(?P<lc>[^\n]*)"
_BLOCK = r"/\*(?P<bc>.*?)(?:\*/|\Z)"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"
_REGEX = r"[=(,:\[!&|?{};+]\s{0,4}/(?![/*\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

_PATTERNS = {
    "js": f"{_LINE}|{_BLOCK}|{_DQ}|{_SQ}|`(?P<tp>(?:[^`\\\\]|\\\\.)*)(?:`|\\Z)|{_REGEX}",
    "c": f"{_LINE}|{_BLOCK}|{_DQ}|{_CHAR}",
    "java": f'{_LINE}|{_BLOCK}|"""(?P<tq>.*?)(?:"""|\\Z)|{_DQ}|{_CHAR}',
    "go": f"{_LINE}|{_BLOCK}|{_DQ}|`(?P<tp>[^`]*)(?:`|\\Z)|{_CHAR}",
    "rs": f'{_LINE}|{_BLOCK}|r(?P<h>#+)"(?P<rw>.*?)(?:"(?P=h)|\\Z)|"(?P<dq>(?:[^"\\\\]|\\\\.)*)(?:"|\\Z)|{_CHAR}',
    "py": rf"#(?P<lc>[^\n]*)|'''(?P<t1>(?:[^\\]|\\.)*?)(?:'''|\Z)|\"\"\"(?P<t2>(?:[^\\]|\\.)*?)(?:\"\"\"|\Z)|{_DQ}|{_SQ}",
    "sh": r"(?:(?<=[\s;(])|\A)#(?P<lc>[^\n]*)|\\.|\"(?P<dq>(?:[^\"\\]|\\.)*)(?:\"|\Z)|'(?P<sq>[^']*)(?:'|\Z)|<<-?[ \t]*(?P<q>['\"]?)(?P<hw>\w+)(?P=q)[^\n]*\n",
}
_LIKE = {"ts": "js", "tsx": "js", "mjs": "js", "cjs": "js", "jsx": "js", "h": "c"}


@cache
def _pattern(ext: str) -> re.Pattern:
    return re.compile(_PATTERNS[_LIKE.get(ext, ext)], re.S)


_ALONE = re.compile(r"^[ \t]*(\w+)[^\S\n]*$", re.M)


def _shell(text: str) -> list[Span]:
    """Shell: a here-document ends at the next line of its word alone; without such a line it is none."""
    rx, out, pos = _pattern("sh"), [], 0
    ends: dict[str, list[int]] | None = None
    while m := rx.search(text, pos):
        pos = m.end()
        g = m.lastgroup
        if g == "hw":
            if ends is None:
                ends = {}
                for a in _ALONE.finditer(text):
                    ends.setdefault(a[1], []).append(a.start())
            at = ends.get(m["hw"], [])
            i = bisect_left(at, m.end() + 1)
            if i < len(at):
                pos = text.find("\n", at[i])
                pos = len(text) if pos < 0 else pos
                out.append(Span("s", m.start(), pos, m.end(), at[i] - 1))
            else:
                pos = m.start() + 2
        elif g is not None:
            a, b = m.span(g)
            out.append(Span("c" if g in ("lc", "bc") else "s", m.start(), m.end(), a, b))
    return out


def spans(ext: str, text: str) -> list[Span]:
    if ext == "sh":
        return _shell(text)
    out = []
    for m in _pattern(ext).finditer(text):
        g = m.lastgroup
        if g is None:
            continue
        if g in ("h", "q", "hw"):
            continue
        a, b = m.span(g)
        out.append(Span("c" if g in ("lc", "bc") else "s", m.start(), m.end(), a, b))
    return out


def without(ext: str, text: str) -> str:
    """The text with a space for each comment and literal."""
    if ext != "sh":
        return _pattern(ext).sub(" ", text)
    out, done = [], 0
    for x in _shell(text):
        out += text[done : x.start], " "
        done = x.end
    return "".join(out) + text[done:]


# a patch stored as a file has a sign before each line
_GAP = re.compile(r"[ \t\r]*\n[+-]?[ \t]*\Z")
_STAR = re.compile(r"\n[+-]?[ \t]*\*?[ \t]*")


def passages(ext: str, text: str) -> list[tuple[str, str]]:
    """(kind, content): comment lines in a row and literals joined on the spot are one passage; leading stars are dropped."""
    out: list[tuple[str, str]] = []
    last: Span | None = None
    alone = False
    begin = at = 0
    for s in spans(ext, text):
        body = text[s.body : s.until]
        begin, at = max(begin, text.rfind("\n", at, s.start) + 1), s.start
        # a line's first span alone looks at the text before it
        own_line = (last is None or last.end <= begin) and not text[begin : s.start].strip(" \t+-")
        if last is not None and last.kind == s.kind:
            gap = text[last.end : s.start]
            if s.kind == "c" and alone and own_line and _GAP.match(gap):
                out[-1] = ("c", out[-1][1] + "\n" + body)
                last = s
                continue
            if s.kind == "s" and (gap.strip() in ("+", ".", "..") or (ext in ("py", "c", "h") and not gap.strip())):
                out[-1] = ("s", out[-1][1] + body)
                last = s
                continue
        out.append((s.kind, body))
        last, alone = s, own_line
    return [(k, _STAR.sub("\n", b) if k == "c" and "*" in b else b) for k, b in out]
