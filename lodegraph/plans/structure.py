"""Queries that read the structure of source files, with SQL that finds the same by other means: by lines, and with literals cut out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions.dictionaries import TREE_KEYWORDS
from lodegraph.operators import functions as fn
from lodegraph.operators import syntax
from lodegraph.plans.code import _TIERS, _files, _in, _q


def ast_functions(spark, d):
    own = syntax.extract_functions(_files(spark, d))
    return own.select("repo_id", "path", "name", F.col("line").cast("bigint").alias("line"), F.array_join("params", "|").alias("params"), "is_method")


def ast_imports(spark, d):
    return syntax.extract_imports(_files(spark, d)).select("repo_id", "path", "raw", "is_relative")


def ast_calls(spark, d):
    own = syntax.extract_calls(_files(spark, d))
    return own.groupBy("repo_id", "path", "callee", "is_method").agg(F.count("*").alias("calls"))


def _callers(spark, d):
    """A file for each of files, in several modules, with two functions and a call; names recur, so that calls lead to every tier."""
    i = F.col("file_id")
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    own = _files(spark, d).where("file_id is not null and repo_id is not null").select("repo_id", "file_id").distinct()
    return own.select("repo_id", text("m", i % 5, "/f", i, ".js").alias("path"), text("function f", i % 40, "(a) {}\nfunction g", i, "() { f", (i * 7) % 40, "(1); // f1()\n}\n").alias("content"))


def ast_call_edges(spark, d):
    f = _callers(spark, d)
    own = fn.call_edges(fn.resolve_calls(syntax.extract_calls(f), syntax.extract_functions(f)))
    return own.select("repo_id", "src", "dst", "calls")


QUERIES = {f.__name__: f for f in (ast_functions, ast_imports, ast_calls, ast_call_edges)}

_F = "f AS (SELECT DISTINCT repo_id, path, content, lower(string_split(path, '.')[-1]) AS ext FROM files WHERE content IS NOT NULL AND content <> '')"
_L = "l AS (SELECT repo_id, path, ext, unnest(string_split(content, chr(10))) AS l, unnest(range(len(string_split(content, chr(10))))) + 1 AS line FROM f)"
_JS = "ext IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs')"
# a definition of a line: its name and what stands in its parentheses; a patch has a sign before each line
_HEADS = {
    _JS: r"(?:^|[^\w$.])function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(([^)]*)\)",
    "ext = 'py'": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)",
    "ext = 'go'": r"^[+ -]?func\s+(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^(]*\])?\(([^)]*)\)",
    "ext = 'rs'": r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)\s*(?:<[^(]*>)?\(([^)]*)\)",
    "ext = 'java'": r"^\s+(?:(?:public|private|protected|static|final)\s+)*[\w<>\[\]]+\s+(\w+)\s*\(([^;)]*)\)[^;]*\{\s*$",
    "ext IN ('c', 'h')": r"^[+ -]?(?:[\w*]+\s+)+\**(\w+)\s*\(([^;)]*)\)\s*\{\s*$",
}
_HITS = " UNION ALL ".join(f"SELECT repo_id, path, ext, line, unnest(regexp_extract_all(l, '{_q(rx)}', 1)) AS name, unnest(regexp_extract_all(l, '{_q(rx)}', 2)) AS p, unnest(range(len(regexp_extract_all(l, '{_q(rx)}', 1)))) AS pos FROM l WHERE {test}" for test, rx in _HEADS.items())
_PARAM = (
    "CASE WHEN ext IN ('java', 'c', 'h') THEN regexp_extract(x, '(\\w+)\\s*(?:\\[[^\\]]*\\])*\\s*$', 1) "
    "ELSE regexp_extract(regexp_replace(x, '^\\s*(?:mut\\s+|&|\\*+|\\.\\.\\.)*', ''), '^([\\w$]+)', 1) END"
)

_DQ, _SQ, _CHAR = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?", r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
_REM = r"//[^\n]*|(?s:/\*.*?(?:\*/|\z))"
_LITERALS = {
    _JS: rf"{_REM}|{_DQ}|{_SQ}|`(?:[^`\\]|\\.)*`",
    "ext = 'java'": rf'(?s:""".*?""")|{_REM}|{_DQ}|{_CHAR}',
    "ext = 'go'": rf"{_REM}|{_DQ}|`[^`]*`|{_CHAR}",
    "ext IN ('c', 'h')": rf"(?m:^[ \t]*#[^\n]*)|{_REM}|{_DQ}|{_CHAR}",
    "ext = 'rs'": rf'{_REM}|(?s:r#+".*?"#+)|(?s:"(?:[^"\\]|\\.)*"?)|{_CHAR}',
    "ext = 'py'": rf"""(?s:'''.*?'''|\"\"\".*?\"\"\")|#[^\n]*|{_DQ}|{_SQ}""",
}
_CODE = "CASE " + " ".join(f"WHEN {test} THEN regexp_replace(content, '{_q(rx)}', ' \"\" ', 'g')" for test, rx in _LITERALS.items()) + " END"
_CALL = r"((?:[A-Za-z_][A-Za-z0-9_$]*[ \t]+)|[.]\s*|->\s*)?([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
_QUOTE = "[\"'']([^\"'']+)[\"'']"

ORACLES = {
    "ast_functions": f"""WITH {_F}, {_L}, h AS ({_HITS})
SELECT repo_id, path, name, CAST(line AS BIGINT) AS line, arg_min(array_to_string(list_filter(list_transform(string_split(p, ','), lambda x: {_PARAM}), lambda x: x <> ''), '|'), pos) AS params, ext = 'java' AS is_method
FROM h WHERE name NOT IN ('if', 'for', 'while', 'switch', 'catch') GROUP BY repo_id, path, ext, name, line""",
    "ast_imports": f"""WITH {_F}, {_L}, r AS (
SELECT repo_id, path, regexp_extract(l, '^\\s*from\\s+([.\\w]+)\\s+import', 1) AS raw FROM l WHERE ext = 'py'
UNION SELECT repo_id, path, unnest(list_transform(string_split(regexp_extract(l, '^\\s*import\\s+([\\w., ]+)', 1), ','), lambda x: regexp_replace(trim(x), '\\s+as\\s+.*$', ''))) FROM l WHERE ext = 'py'
UNION SELECT repo_id, path, unnest(regexp_extract_all(l, '^\\s*(?:import|export)\\s(?:[^"''`;]*\\sfrom\\s*)?{_QUOTE}', 1)) FROM l WHERE {_JS}
UNION SELECT repo_id, path, unnest(regexp_extract_all(content, '(?:^|[^\\w$.])(?:require|import)\\s*\\(\\s*{_QUOTE}', 1)) FROM f WHERE {_JS}
UNION SELECT repo_id, path, regexp_extract(l, '^[+ -]?use\\s+(?:::)?(\\w+)', 1) FROM l WHERE ext = 'rs'
UNION SELECT repo_id, path, unnest(regexp_extract_all(regexp_extract(content, '(?s)\\nimport\\s*\\((.*?)\\)', 1), '"([^"]+)"', 1)) FROM f WHERE ext = 'go'
UNION SELECT repo_id, path, unnest(regexp_extract_all(content, '\\nimport\\s+"([^"]+)"', 1)) FROM f WHERE ext = 'go')
SELECT DISTINCT repo_id, path, raw, raw LIKE './%' OR raw LIKE '../%' OR raw LIKE '/%' AS is_relative FROM r WHERE raw <> ''""",
    "ast_calls": f"""WITH {_F}, k AS (SELECT repo_id, path, {_CODE} AS code FROM f),
x AS (SELECT repo_id, path, unnest(regexp_extract_all(code, '{_CALL}', 1)) AS b, unnest(regexp_extract_all(code, '{_CALL}', 2)) AS callee FROM k WHERE code IS NOT NULL),
y AS (SELECT repo_id, path, trim(coalesce(b, '')) AS b, callee FROM x)
SELECT repo_id, path, callee, b IN ('.', '->') AS is_method, count(*) AS calls FROM y
WHERE callee NOT IN ({_in(sorted(TREE_KEYWORDS))}) AND (b IN ('', '.', '->') OR b IN ({_in(sorted(syntax._GOES_ON))})) GROUP BY ALL""",
}
ORACLES["ast_call_edges"] = (
    "WITH files AS (SELECT DISTINCT repo_id, 'm' || file_id % 5 || '/f' || file_id || '.js' AS path, 'function f' || file_id % 40 || '(a) {}' || chr(10) || 'function g' || file_id || '() { f' || (file_id * 7) % 40 || '(1); // f1()' || chr(10) || '}' || chr(10) AS content "
    f"FROM files WHERE file_id IS NOT NULL AND repo_id IS NOT NULL), fn AS ({ORACLES['ast_functions']}), c AS (SELECT repo_id, path, callee, CAST(sum(calls) AS BIGINT) AS calls FROM ({ORACLES['ast_calls']}) GROUP BY ALL), {_TIERS} "
    "SELECT repo_id, 'file:' || path AS src, 'func:' || func_path || ':' || callee || ':' || line AS dst, calls FROM r"
)
