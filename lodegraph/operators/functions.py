"""Functions and calls of source files by pattern tables, and the functions that calls lead to.

files is (repo_id, path, content).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.functions import dictionaries as D
from lodegraph.functions.paths import default_module, directory, extension, language
from lodegraph.functions.text import parameters

#: A match: where it starts, the name, the parameters.
Find = Callable[[str], Iterator[tuple[int, str, str]]]


def _by_pattern(pattern: str) -> Find:
    rx = re.compile(pattern, re.A)
    return lambda text: ((m.start(), m[1], m[2]) for m in rx.finditer(text))


_TYPED_NAME = re.compile(r"[a-zA-Z_]\w*", re.A)


def _by_run(letters: str, tail: str, modifiers: str | None = None) -> Find:
    """What the patterns of typed languages match, in linear time: they begin with a run of letters of types and names, which an
    expression would read again from each of its letters.

    A run ends at a parenthesis; its last word is the name. The match starts with the run, or at the first of its modifiers and
    spaces that leaves a letter and a space before the name.
    """
    run, end = re.compile(rf"(?<![{letters}])[{letters}]+\(", re.A), re.compile(tail, re.A)
    word = re.compile(modifiers, re.A) if modifiers else None

    def find(text: str) -> Iterator[tuple[int, str, str]]:
        closing = [m.start() for m in re.finditer(r"\)", text)]
        done = 0
        for m in run.finditer(text):
            if m.start() < done:
                continue
            i = bisect_left(closing, m.end())
            if i == len(closing):
                return
            last = end.match(text, closing[i] + 1)
            if last is None:
                continue
            types = m[0][:-1].rstrip(" \t\n\r\f\v")
            at = max(map(types.rfind, " \t\n\r\f\v")) + 1
            if at < 2 or not _TYPED_NAME.fullmatch(types, at):
                continue
            start = 0
            if word is not None:
                start = next((w.start() for w in word.finditer(types) if w.end() <= at - 2), -1)
                if start < 0:
                    continue
            done = last.end()
            yield m.start() + start, types[at:], text[m.end() : closing[i]]

    return find


_LINEAR = {
    "c": _by_run(r"\w\s*", r"\s*\{"),
    "cpp": _by_run(r"\w:\s<>", r"\s*(?:const)?\s*\{"),
    "java": _by_run(r"\w<>\[\]\s", r"\s*\{", r"public|private|protected|static|final|native|synchronized|\s"),
}


def _first_matches(files: pd.DataFrame, patterns: dict[str, list[tuple[Find, bool]]]) -> Iterator[tuple]:
    """(row, name, params, line, is_method): in each file the first pattern's match of a line and name."""
    for row, (path, text) in enumerate(zip(files["path"], files["content"])):
        seen = set()
        for find, method in patterns.get(path.rpartition(".")[2].lower(), ()):
            line, at = 1, 0
            for start, name, params in find(text):
                line += text.count("\n", at, start)
                at = start
                if (line, name) not in seen:
                    seen.add((line, name))
                    yield row, name, params, line, method


def extract_functions(files: DataFrame, java_pattern: str = "corrected") -> DataFrame:
    """(repo_id, path, name, line, params array, is_method, language): of a path, line and name the first pattern's match.

    A line needs the offset of its match, which no built-in function gives; so matches are found in Arrow batches.
    java_pattern="literal" uses the pattern that ordinary methods don't match.
    """
    lists: dict[str, list[tuple[Find, bool]]] = {}
    for e, patterns in D.FUNCTIONS.items():
        literal = e == "java" and java_pattern == "literal"
        for name in [e, *(k for k, v in D.FUNCTIONS_OF.items() if v == e)]:
            lists[name] = [(_by_pattern(D.JAVA_LITERAL if literal else p) if literal or e not in _LINEAR else _LINEAR[e], m) for p, m in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not (got := list(_first_matches(b, lists))):
                continue
            at = [x[0] for x in got]
            yield pd.DataFrame({"repo_id": b["repo_id"].iloc[at].to_numpy(), "path": b["path"].iloc[at].to_numpy(), "name": [x[1] for x in got], "params0": [x[2] for x in got], "line": [x[3] for x in got], "is_method": [x[4] for x in got]})

    kind = files.schema["repo_id"].dataType.simpleString()
    own = files.where(extension(F.col("path")).isin(*lists) & F.col("content").isNotNull() & (F.col("content") != "")).select("repo_id", "path", "content")
    found = own.mapInPandas(run, f"repo_id {kind}, path string, name string, params0 string, line int, is_method boolean").distinct()
    return found.select("repo_id", "path", "name", "line", parameters(F.col("params0")).alias("params"), "is_method", language(F.col("path")).alias("language"))


def function_nodes(functions: DataFrame) -> DataFrame:
    """(repo_id, id, label, kind, path, grp, loc, complexity, language): loc and complexity are 1, the group is the directory."""
    return functions.select(
        "repo_id", F.concat_ws(":", F.lit("func"), "path", "name", F.col("line").cast("string")).alias("id"), F.col("name").alias("label"), F.lit("function").alias("kind"), "path",
        directory(F.col("path")).alias("grp"), F.lit(1).alias("loc"), F.lit(1).alias("complexity"), "language",
    )


def _tagged(pattern: str, no: int) -> Column:
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda x, i: F.struct(F.lit(no).alias("pattern_no"), i.alias("pos"), x.alias("callee")))


def extract_calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, pattern_no, pos, callee), one row for each match of each pattern, without words that are no calls."""
    ext = extension(F.col("path"))
    chain = None
    for e, patterns in D.CALLS.items():
        value = F.concat(*[_tagged(p, n) for n, p in enumerate(patterns)])
        chain = F.when(ext == e, value) if chain is None else chain.when(ext == e, value)
    own = files.where("content is not null and content <> ''").select("repo_id", "path", F.explode(chain).alias("c")).select("repo_id", "path", "c.*")
    return own.where(~F.col("callee").isin(*D.NO_CALLS) & (F.col("callee") != "")).distinct()


_OPENING = re.compile(r"""//|/\*|["']""")
_LITERAL = {q: re.compile(rf"(?s)(?:[^{q}\\\n]++|\\.)*+") for q in "\"'"}


def _without_remarks(text: str) -> str:
    """A text with a space for each match of REMARK, in linear time and without recursion: what was seen not to close is not tried again.

    From a quote that is never closed up to where its literal breaks off, each further quote of its kind is an escaped one and breaks off there too.
    """
    kept, done, at, vain = [], 0, 0, {}
    while m := _OPENING.search(text, at):
        start, mark = m.start(), m[0]
        at = start + 1
        if start < vain.get(mark, 0):
            continue
        if mark == "//":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
        elif mark == "/*":
            end = text.find("*/", start + 2) + 2
            if end < 2:
                vain[mark] = len(text)
                continue
        else:
            end = _LITERAL[mark].match(text, at).end()
            if not text.startswith(mark, end):
                vain[mark] = end
                continue
            end += 1
        kept.append(text[done:start])
        done = at = end
    return " ".join([*kept, text[done:]])


#: As the SQL's engine has white space, without the vertical tab.
_SPACE = r"[\t\n\f\r ]"
_DEFINITION = re.compile(D.DEFINITION.replace(r"\s", _SPACE), re.A)
#: What CALLED matches, read backwards from the parenthesis, and with the digits that its name may follow.
_BEFORE = re.compile(rf"\({_SPACE}*+([\w$]++(?:(?<=[A-Za-z_$])\.)?+)", re.A)


def _called(text: str) -> list[str]:
    """The names before parentheses with their dot, last to first."""
    code = _DEFINITION.sub(" (", _without_remarks(text))
    return [name for x in _BEFORE.findall(code[::-1]) if (name := x[::-1].lstrip("0123456789"))]


def syntax_calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, callee, is_method, calls): each call once by its last name, outside comments and literals.

    Names after `function`, `func`, `fn` or `def` are definitions. For languages with braces and their variants.
    Java's expressions recurse at each character of a literal, until the stack ends at some thousands; so texts are read in Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def called(texts: pd.Series) -> pd.Series:
        return texts.map(_called)

    own = files.where(extension(F.col("path")).isin(*D.BRACES) & F.col("content").isNotNull())
    rows = own.select("repo_id", "path", called("content").alias("f")).distinct().select("repo_id", "path", F.explode("f").alias("f"))
    rows = rows.select("repo_id", "path", F.ltrim(F.col("f"), F.lit(".")).alias("callee"), F.col("f").startswith(".").alias("is_method"))
    return rows.where(~F.col("callee").isin(*D.NO_CALLS)).groupBy("repo_id", "path", "callee", "is_method").agg(F.count("*").alias("calls"))


#: Functions of one name in one place beyond which they are split.
HOT = 1_000


def tiered_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, path, callee, calls, module, tier): for each file and callee the best tier that has functions of that name, and the number of calls.

    Tiers: 0 the same file, 1 the same module, 2 elsewhere in the repository. With the functions' own names, files and modules this
    is the whole of the call graph, a row for each file and name, however many functions bear the name.
    """
    asks = calls.groupBy("repo_id", "path", "callee").agg(F.count("*").alias("calls")).withColumn("module", default_module(F.col("path")))
    f = functions.select("repo_id", "path", F.col("name").alias("callee"), default_module(F.col("path")).alias("module"))
    here = f.groupBy("repo_id", "path", "callee").agg(F.lit(1).alias("here"))
    near = f.groupBy("repo_id", "module", "callee").agg(F.lit(1).alias("near"))
    any_ = f.groupBy("repo_id", "callee").agg(F.lit(1).alias("far"))
    own = asks.join(here, ["repo_id", "path", "callee"], "left").join(near, ["repo_id", "module", "callee"], "left").join(any_, ["repo_id", "callee"], "left")
    tier = F.when(F.col("here") == 1, 0).when(F.col("near") == 1, 1).when(F.col("far") == 1, 2)
    return own.select("repo_id", "path", "callee", "calls", "module", tier.alias("tier")).where("tier is not null")


def _met(asks: DataFrame, functions: DataFrame, keys: list[str]) -> DataFrame:
    """asks with the functions of their keys; of keys with many functions each part meets the asks in a task of its own."""
    parts = functions.groupBy(*keys).agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    asks = asks.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    functions = functions.join(parts.where("parts > 1"), keys, "left").withColumn("part", F.pmod(F.xxhash64("func_path", "line"), F.coalesce("parts", F.lit(1))).cast("int"))
    return asks.drop("parts").join(functions.drop("parts"), [*keys, "part"])


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, path, callee, calls, func_path, line): tiered_calls written out, for each file and callee the functions of its tier.

    Calls of one name in one file resolve alike, so they are added up before the join, and a tier is read off the functions' own groups
    by file and module: no call meets the functions of a tier it doesn't use.
    """
    asks = tiered_calls(calls, functions)
    f = functions.select("repo_id", F.col("path").alias("func_path"), F.col("name").alias("callee"), "line", default_module(F.col("path")).alias("func_module"))
    cols = ["repo_id", "path", "callee", "calls", "func_path", "line"]
    same = asks.where("tier = 0").join(f.withColumn("path", F.col("func_path")).drop("func_module"), ["repo_id", "path", "callee"]).select(*cols)
    mod = _met(asks.where("tier = 1"), f.withColumnRenamed("func_module", "module"), ["repo_id", "module", "callee"]).select(*cols)
    far = _met(asks.where("tier = 2").drop("module"), f.drop("func_module"), ["repo_id", "callee"]).select(*cols)
    return same.unionByName(mod).unionByName(far)


def call_edges(resolved: DataFrame) -> DataFrame:
    """(repo_id, src, dst, weight, kind, calls): file to function; calls says how many edges of weight 1 the row stands for."""
    dst = F.concat_ws(":", F.lit("func"), "func_path", "callee", F.col("line").cast("string"))
    return resolved.select("repo_id", F.concat(F.lit("file:"), F.col("path")).alias("src"), dst.alias("dst"), F.lit(1).alias("weight"), F.lit("call").alias("kind"), "calls")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the first in an order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
