"""Functions, imports and calls by the structure of source files: tokens, nesting and classes instead of patterns.

Comments and literals hold nothing, a definition is no call, and a function is a method where it stands inside a class or has
a receiver. files is (repo_id, path, content); null and empty content and other languages have no rows, rows that are there
twice count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.dictionaries import TREE_KEYWORDS
from lodegraph.functions.lexer import FAMILY, Token, tokens
from lodegraph.functions.paths import extension, is_relative_spec, language


class Function(NamedTuple):
    name: str
    at: int  # offset of the definition
    params: list[str]
    is_method: bool
    class_name: str | None
    token: int  # the name's token


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _pairs(ts: list[Token]) -> dict[int, int]:
    """The closing token of each opening one; a wrong one is passed over."""
    out, open_ = {}, []
    for i, (k, t, _) in enumerate(ts):
        if k == "o" and t in _OPEN:
            open_.append((t, i))
        elif k == "o" and t in _CLOSE:
            for j in range(len(open_) - 1, max(-1, len(open_) - 4), -1):
                if _OPEN[open_[j][0]] == t:
                    out[open_[j][1]] = i
                    del open_[j:]
                    break
    return out


def _parameters(ts: list[Token], a: int, b: int, family: str) -> list[str]:
    """The names of the parameters between two parentheses, one a comma."""
    out, part, depth = [], [], 0
    for i in range(a + 1, b + 1):
        k, t, _ = ts[i]
        if i == b or (k == "o" and t == "," and depth == 0):
            stop = next((x for x, (kk, tt) in enumerate(part) if kk == "o" and tt in (":", "=", "?")), len(part))
            names = [tt for kk, tt in part[: stop if family in ("js", "py", "rs", "php", "rb") else len(part)] if kk == "n" and tt not in ("mut", "ref", "public", "private", "protected", "readonly", "final", "const")]
            if names:
                out.append(names[0] if family in ("js", "py", "rs", "go", "rb") else names[-1])
            part = []
            continue
        depth += (t in ("(", "[", "{", "<")) - (t in (")", "]", "}", ">")) if k == "o" else 0
        if depth <= 0 or family in ("c", "java"):
            part.append((k, t))
    return out


#: Words before a parenthesis that open a block and define nothing.
_BLOCKS = set("if for while switch catch with synchronized do else try return function match foreach elseif until unless using lock fixed sizeof defined".split())
_MODIFIERS = set("public private protected static final abstract native synchronized async get set override readonly default export declare accessor inline extern virtual unsafe const pub".split())


def functions(ext: str, text: str, ts: list[Token] | None = None) -> list[Function]:
    """The named functions of a text in order, nested ones too."""
    ts = tokens(ext, text) if ts is None else ts
    family = FAMILY.get(ext)
    if family == "py":
        return _python(ts)
    if family == "rb":
        return _ruby(ts)
    pairs = _pairs(ts)
    out: list[Function] = []
    scopes: list[tuple[int, str | None]] = []  # (closing token, class) around
    classes: dict[int, str] = {}  # opening brace -> class
    n = len(ts)

    def is_(i: int, text: str) -> bool:
        return 0 <= i < n and ts[i][1] == text and ts[i][0] in "on"

    def line_begin(i: int) -> int:
        """Where the definition of the name begins: at its modifiers and types, on the way back to a sign that ends what was before."""
        if family == "js":
            while i > 0 and ts[i - 1][1] in _MODIFIERS - {"export", "default", "declare", "const"} and ts[i - 1][0] == "n":
                i -= 1
            return i
        while i > 0 and (ts[i - 1][0] == "n" or ts[i - 1][1] in ("*", "&", "<", ">", "[", "]", ",", "::", ".", "?")) and ts[i - 1][1] not in ("else", "return"):
            i -= 1
        return i

    for i, (k, t, at) in enumerate(ts):
        while scopes and i > scopes[-1][0]:
            scopes.pop()
        if k == "o" and t == "{":
            scopes.append((pairs.get(i, n), classes.get(i)))
        if k != "n":
            continue
        inside = next((c for _, c in reversed(scopes) if c), None)
        if t == "class" and family in ("js", "java", "php") and i + 1 < n and ts[i + 1][0] == "n" and not is_(i - 1, ".") and not is_(i - 1, "::"):
            j = i + 2
            while j < n and not (ts[j][0] == "o" and ts[j][1] in ("{", ";", ")")):
                j = pairs.get(j, j) + 1 if ts[j][1] in ("(", "[") else j + 1
            if is_(j, "{"):
                classes[j] = ts[i + 1][1] if ts[i + 1][1] not in ("extends", "implements") else "class"
            continue
        if family in ("go", "rs") or (family in ("js", "php") and t == "function"):
            word = {"go": "func", "rs": "fn"}.get(family, "function")
            if t != word:
                continue
            j, receiver = i + 1, False
            while is_(j, "*") or is_(j, "&"):
                j += 1
            if family == "go" and is_(j, "(") and j in pairs:
                j, receiver = pairs[j] + 1, True
            if j < n and ts[j][0] == "n":
                a = j + 1
                if is_(a, "<") or (family == "go" and is_(a, "[")):
                    a = _generics(ts, a)
                if is_(a, "(") and a in pairs:
                    start = i
                    while family in ("js", "rs", "php") and start > 0 and ts[start - 1][0] == "n" and ts[start - 1][1] in ("async", "pub", "unsafe", "const", *(_MODIFIERS if family == "php" else ())):
                        start -= 1
                    out.append(Function(ts[j][1], ts[start][2], _parameters(ts, a, pairs[a], family), bool(inside) or receiver, inside, j))
            continue
        # a name before parentheses and a body
        if t in _BLOCKS or t in ("class", "new"):
            continue
        a = i + 1
        if is_(a, "<"):
            a = _generics(ts, a)
        if not is_(a, "(") or a not in pairs:
            continue
        before = ts[i - 1] if i else ("o", ";", 0)
        b = pairs[a] + 1
        if family == "js":
            # a method: in the body of a class or an object, before its body
            if before[0] == "n" and before[1] not in _MODIFIERS or before[1] in (".", "?.", "=", "(", ":", "&&", "||", "!", "?", "=>", "..."):
                continue
            if is_(b, ":"):
                while b < n and not (ts[b][0] == "o" and ts[b][1] in ("{", ";", "}", ",")):
                    b = pairs.get(b, b) + 1 if ts[b][1] in ("(", "[") else b + 1
            if is_(b, "{") and scopes:
                out.append(Function(t, ts[line_begin(i)][2], _parameters(ts, a, pairs[a], family), bool(inside), inside, i))
        elif family in ("java", "c"):
            if before[1] in (".", "->", "=", "(", ",", "!", "return", "new", "&&", "||", "?", ":", "+"):
                continue
            # what may stand between the parameters and the body
            tail = ("const", "noexcept", "override", "final") if family == "c" else ("throws",)
            while b < n and ((ts[b][0] == "n" and (ts[b][1] in tail or ts[b - 1][1] != ")")) or (family == "java" and ts[b][1] in (".", ",") and ts[b - 1][1] != ")")):
                b += 1
            typed = before[0] == "n" and before[1] not in ("else", "do", "try", "finally") or before[1] in ("*", "&", ">", "]")
            constructor = family == "java" and inside is not None and t == inside
            if is_(b, "{") and (typed or constructor):
                out.append(Function(t, ts[line_begin(i)][2], _parameters(ts, a, pairs[a], family), bool(inside), inside, i))
    return out


def _generics(ts: list[Token], i: int) -> int:
    """Behind type parameters, or where it was if they don't close."""
    depth, j = 0, i
    while j < len(ts) and j < i + 200:
        t = ts[j][1]
        depth += (t in "<[") - (t in ">]") if ts[j][0] == "o" and len(t) == 1 else 0
        j += 1
        if depth == 0:
            return j
        if t in ("{", "}", ";", "("):
            return i
    return i


def _python(ts: list[Token]) -> list[Function]:
    pairs, out = _pairs(ts), []
    scopes: list[tuple[int, str | None]] = []  # (indentation, class)
    for i, (k, t, at) in enumerate(ts):
        if k == "l":
            while scopes and len(t) <= scopes[-1][0]:
                scopes.pop()
            j = i + 1
            asynchronous = j + 1 < len(ts) and ts[j][1] == "async"
            j += asynchronous
            if j + 1 < len(ts) and ts[j][0] == ts[j + 1][0] == "n" and ts[j][1] in ("class", "def"):
                if ts[j][1] == "class":
                    scopes.append((len(t), ts[j + 1][1]))
                    continue
                a = j + 2
                if a < len(ts) and ts[a][1] == "[":
                    a = pairs.get(a, a) + 1
                if a < len(ts) and ts[a][1] == "(" and a in pairs:
                    inside = next((c for _, c in reversed(scopes) if c), None)
                    out.append(Function(ts[j + 1][1], ts[i + 1][2], _parameters(ts, a, pairs[a], "py"), inside is not None, inside, j + 1))
                scopes.append((len(t), None))
    return out


def _ruby(ts: list[Token]) -> list[Function]:
    out, scopes, pairs = [], [], _pairs(ts)
    for i, (k, t, at) in enumerate(ts):
        first = i > 0 and ts[i - 1][0] == "l"
        if k != "n" or (i and ts[i - 1][1] == "."):
            continue
        if t == "end":
            scopes[-1:] = []
        elif t in ("class", "module") and first and i + 1 < len(ts):
            scopes.append(ts[i + 1][1] if t == "class" else None)
        elif t == "def" and i + 1 < len(ts):
            j = i + 1
            while j + 2 < len(ts) and ts[j + 1][1] == ".":
                j += 2
            inside = next((c for c in reversed(scopes) if c), None)
            if ts[j][0] == "n":
                a = j + 1
                params = _parameters(ts, a, pairs[a], "rb") if a < len(ts) and ts[a][1] == "(" and a in pairs else []
                out.append(Function(ts[j][1], at, params, inside is not None, inside, j))
            scopes.append(None)
        elif t in ("begin", "case", "do") or (first and t in ("if", "unless", "while", "until", "for")):
            scopes.append(None)
    return out


def imports(ext: str, text: str, ts: list[Token] | None = None) -> list[str]:
    """The specs that a text imports, each once, in order: JavaScript, TypeScript, Python, Go and Rust."""
    ts = tokens(ext, text) if ts is None else ts
    family, n = FAMILY.get(ext), len(ts)
    out: dict[str, None] = {}
    bare = lambda s: s[1:-1] if s[:1] in "\"'`" else s
    i = 0
    while i < n:
        k, t, _ = ts[i]
        i += 1
        if k != "n" or (i > 1 and ts[i - 2][1] in (".", "?.", "::")):
            continue
        if family == "js":
            if t in ("import", "require") and i + 1 < n and ts[i][1] == "(" and ts[i + 1][0] == "s":
                out[bare(ts[i + 1][1])] = None
            elif t == "import" and i < n and ts[i][0] == "s":
                out[bare(ts[i][1])] = None
            elif t in ("import", "export") and i < n and (ts[i][1] in ("*", "{", "type") or (t == "import" and ts[i][0] == "n")):
                # as far as a statement of bindings goes
                j = i
                while j < n and (ts[j][0] == "n" or ts[j][1] in ("{", "}", ",", "*")) and ts[j][1] not in ("function", "class", "const", "let", "var"):
                    j += 1
                    if ts[j - 1][1] == "from" and j < n and ts[j][0] == "s":
                        out[bare(ts[j][1])] = None
                        break
        elif family == "py":
            if i < 2 or ts[i - 2][0] != "l" or t not in ("import", "from"):
                continue
            j, name = i, ""
            while j < n and ts[j][0] != "l":
                word = ts[j][1]
                if t == "from" and word == "import":
                    break
                if ts[j][0] == "n" and word not in ("as",) or word in (".", "..."):
                    name += word
                    j += 1
                    continue
                if t == "import" and name:
                    out[name] = None
                    name = ""
                j += 2 if word == "as" else 1
            if name:
                out[name] = None
        elif family == "go" and t == "import":
            if i < n and ts[i][1] == "(":
                j = i + 1
                while j < n and ts[j][1] != ")":
                    if ts[j][0] == "s":
                        out[bare(ts[j][1])] = None
                    j += 1
            else:
                j = i + (i < n and (ts[i][0] == "n" or ts[i][1] in (".", "_")))
                if j < n and ts[j][0] == "s":
                    out[bare(ts[j][1])] = None
        elif family == "rs" and t == "use":
            j = i + (i < n and ts[i][1] == "::")
            if j < n and ts[j][0] == "n":
                out[ts[j][1]] = None
    out.pop("", None)
    return list(out)


#: Words behind which a name and a parenthesis are a call, not a definition.
_GOES_ON = set("return else case throw await yield in not and or typeof delete void do of is assert del lambda if elif while raise print go defer match then echo unless until when puts".split())


def calls(ext: str, text: str, ts: list[Token] | None = None) -> list[tuple[str, int, bool]]:
    """(callee, offset, whether it is a member's) of each call in order; definitions, constructions and keywords are none."""
    ts = tokens(ext, text) if ts is None else ts
    family = FAMILY.get(ext)
    defined = {f.token for f in functions(ext, text, ts)}
    out = []
    for i, (k, t, at) in enumerate(ts[:-1]):
        if k != "n" or i in defined or ts[i + 1][1] != "(" or ts[i + 1][0] != "o" or t in TREE_KEYWORDS:
            continue
        before = ts[i - 1] if i else ("o", ";", 0)
        typed = family in ("c", "java")
        joined = before[0] == "n" and (typed or "\n" not in text[before[2] : at])  # elsewhere a line's end ends a statement
        if joined and (before[1] not in _GOES_ON or (typed and before[1] == "void")):
            continue  # a declaration, or behind `new`, `def`, `func`
        if typed and before[1] in ("*", "&") and i > 1 and ts[i - 2][0] == "n" and ts[i - 2][1] not in _GOES_ON - {"void"} and (i < 3 or ts[i - 3][1] in (";", "}", "{")):
            continue  # a declaration that returns a pointer
        out.append((t, at, before[1] in (".", "?.", "->")))
    return out


def _extracted(files: DataFrame, rows_of: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, *x) for r, p, t in zip(b["repo_id"], b["path"], b["content"]) for x in rows_of(p.rpartition(".")[2].lower(), t)]
            if rows:
                yield pd.DataFrame(rows, columns=["repo_id", "path", *names])

    kind = files.schema["repo_id"].dataType.simpleString()
    own = files.where(extension(F.col("path")).isin(*FAMILY) & F.col("content").isNotNull() & (F.col("content") != "")).select("repo_id", "path", "content")
    return own.mapInPandas(run, f"repo_id {kind}, path string, {schema}")


def _numbered(text: str, offsets: list[int]) -> list[int]:
    """The lines of ascending offsets, in one pass."""
    out, line, last = [], 1, 0
    for at in offsets:
        line += text.count("\n", last, at)
        last = at
        out.append(line)
    return out


def extract_functions(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, line, params array, is_method, class_name, language): of a path, line and name the first."""

    def rows(ext: str, text: str) -> list[tuple]:
        found = sorted(functions(ext, text), key=lambda f: f.at)
        out = {}
        for f, line in zip(found, _numbered(text, [f.at for f in found])):
            out.setdefault((line, f.name), (f.name, line, f.params, f.is_method, f.class_name))
        return list(out.values())

    own = _extracted(files, rows, "name string, line int, params array<string>, is_method boolean, class_name string").distinct()
    return own.withColumn("language", language(F.col("path")))


def extract_imports(files: DataFrame) -> DataFrame:
    """(repo_id, path, pattern_no, pos, raw, is_relative): each spec of a file once, numbered by its first place."""
    own = _extracted(files, lambda ext, text: list(enumerate(imports(ext, text))), "pos int, raw string").distinct()
    return own.select("repo_id", "path", F.lit(0).alias("pattern_no"), "pos", "raw", is_relative_spec(F.col("raw")).alias("is_relative"))


def extract_calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, pattern_no, pos, callee, line, is_method), one row for each call."""

    def rows(ext: str, text: str) -> list[tuple]:
        found = calls(ext, text)
        return [(i, name, line, member) for i, ((name, _, member), line) in enumerate(zip(found, _numbered(text, [x[1] for x in found])))]

    own = _extracted(files, rows, "pos int, callee string, line int, is_method boolean").distinct()
    return own.select("repo_id", "path", F.lit(0).alias("pattern_no"), "pos", "callee", "line", "is_method")
