"""Tokens of source files, without comments, in the languages whose structure is read.

A token is (kind, text, offset): "n" a name or keyword, "s" a literal, "d" a number, "o" a sign, and in Python "l" the start of a
logical line, whose text is its indentation. Faulty text is read as far as it goes: an open literal ends with its line, an open
block at the end of the text.
"""

from __future__ import annotations

import re
from functools import cache

Token = tuple[str, str, int]

_NAME = r"(?P<n>[^\W\d][\w$]*|[$@][\w$]+)|(?P<d>\.?\d[\w.]*)"
_SIGN = r"(?P<o>=>|\?\.|\.\.\.|::|->|[\s\S])"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"?', r"'(?:[^'\\\n]|\\[\s\S])*'?"
_REMARK = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'"

# one expression a family: what is skipped, literals, names, numbers, signs
_FAMILIES = {
    "js": rf"(?P<skip>\s+|{_REMARK})|(?P<s>{_DQ}|{_SQ})|(?P<t>`)|{_NAME}|{_SIGN}",
    "java": rf'(?P<skip>\s+|{_REMARK})|(?P<s>"""[\s\S]*?(?:"""|\Z)|{_DQ}|{_CHAR})|{_NAME}|{_SIGN}',
    "go": rf"(?P<skip>\s+|{_REMARK})|(?P<s>{_DQ}|`[^`]*`|`[^\n]*|{_CHAR})|{_NAME}|{_SIGN}",
    "rs": rf'(?P<skip>\s+|{_REMARK})|(?P<s>b?r(?P<h>#*)"[\s\S]*?(?:"(?P=h)|\Z)|b?"(?:[^"\\]|\\[\s\S])*"?|b?{_CHAR})|(?P<life>\'[^\W\d]\w*)|{_NAME}|{_SIGN}',
    "c": rf"(?P<skip>\s+|{_REMARK}|(?<![^\n])[ \t]*#(?:[^\n\\]|\\\r?\n|\\)*)|(?P<s>{_DQ}|{_CHAR})|{_NAME}|{_SIGN}",
    "php": rf"(?P<skip>\s+|{_REMARK}|#(?!\[)[^\n]*|\?>[\s\S]*?(?:<\?(?:php|=)?|\Z))|(?P<s><<<[ \t]*(?P<q>['\"]?)(?P<w>\w+)(?P=q)[\s\S]*?(?:\n[ \t]*(?P=w)\b|\Z)|\"(?:[^\"\\]|\\[\s\S])*\"?|'(?:[^'\\]|\\[\s\S])*'?)|{_NAME}|{_SIGN}",
    "rb": rf"(?P<skip>[^\S\n]+|#[^\n]*|(?<![^\n])=begin\b[\s\S]*?(?:\n=end\b|\Z))|(?P<l>\n)|(?P<s>{_DQ}|{_SQ})|(?P<n>[^\W\d]\w*[?!]?|[$@]+\w+)|(?P<d>\d[\w.]*)|{_SIGN}",
    "py": rf"(?P<skip>[^\S\n]+|#[^\n]*|\\\r?\n)|(?P<l>\n)|(?P<s>[rRbBuUfFtT]{{0,2}}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"[^\n]*|'''[^\n]*|{_DQ}|{_SQ}))|{_NAME}|{_SIGN}",
}
FAMILY = {
    **dict.fromkeys("ts tsx js jsx mjs cjs".split(), "js"), "java": "java", "go": "go", "rs": "rs", **dict.fromkeys("c h cpp cc cxx hpp hxx".split(), "c"), "php": "php", "rb": "rb", "py": "py",
}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Words behind which a slash begins an expression.
_BEFORE = set("return typeof case in of do else void delete throw new instanceof yield await".split())
_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")


@cache
def _pattern(family: str) -> re.Pattern:
    return re.compile(_FAMILIES[family])


def _js(text: str) -> list[Token]:
    """JavaScript and TypeScript: templates hold code, and a slash is an operator or begins an expression by what stands before it."""
    rx, out, pos, n = _pattern("js"), [], 0, len(text)
    open_: list[int] = []  # of each template around, the braces open in its code
    while pos < n:
        m = rx.match(text, pos)
        kind, at = m.lastgroup, pos
        pos = m.end()
        if kind == "skip":
            continue
        if kind == "o" and m[0] in "{}" and open_:
            open_[-1] += 1 if m[0] == "{" else -1
            if open_[-1] < 0:
                open_.pop()
                kind = "t"
        if kind == "t":
            # the template's text, up to its end or its next piece of code
            e = _TEXT.match(text, pos).end()
            out.append(("s", text[at : e + 1], at))
            if text.startswith("${", e):
                open_.append(0)
                pos = e + 2
            else:
                pos = e + 1
            continue
        if kind == "o" and m[0] == "/" and (not out or out[-1][1] in _BEFORE or (out[-1][0] == "o" and out[-1][1] not in (")", "]", "}"))) and (r := _REGEX.match(text, at)):
            out.append(("s", r[0], at))
            pos = r.end()
            continue
        out.append((kind, m[0], at))
    return out


#: What begins a statement where it begins a line.
_STATEMENTS = ("def ", "class ", "async def ", "import ", "from ", "module ")


def _lines(family: str, text: str) -> list[Token]:
    """Languages of lines: a line within parentheses or without a token is none."""
    out: list[Token] = []
    depth, begin = 0, 0
    fresh = True
    for m in _pattern(family).finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "l":
            if depth and text.startswith(_STATEMENTS, m.end()):
                depth = 0  # a parenthesis that was never closed
            begin, fresh = m.end(), depth == 0
            continue
        if fresh:
            lead = text[begin : m.start()]
            out.append(("l", lead.expandtabs(8) if lead.isspace() or not lead else "", m.start()))
            fresh = False
        if kind == "o":
            depth = max(0, depth + (m[0] in "([{") - (m[0] in ")]}"))
        out.append((kind, m[0], m.start()))
    return out


def tokens(ext: str, text: str) -> list[Token]:
    """The tokens of a text by its extension; none for other languages."""
    family = FAMILY.get(ext)
    if family is None:
        return []
    if family == "js":
        return _js(text)
    if family in ("py", "rb"):
        return _lines(family, text)
    kinds = {"w": "s", "q": "s", "h": "s"}
    return [(kinds.get(m.lastgroup, m.lastgroup), m[0], m.start()) for m in _pattern(family).finditer(text) if m.lastgroup not in ("skip", "life")]
