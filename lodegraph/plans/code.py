"""Queries over source files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import dictionaries as D
from lodegraph.functions import paths as P
from lodegraph.functions import text as T
from lodegraph.operators import functions as fn
from lodegraph.operators import graph, monorepo
from lodegraph.operators import imports as im
from lodegraph.session import spread, table
from lodegraph.sources import files as src


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "files"))


def _q(s: str) -> str:
    return s.replace("'", "''")


def _in(words) -> str:
    return ", ".join(f"'{_q(w)}'" for w in words)


_EXT = "lower(string_split(path, '.')[-1])"
_BASE = "string_split(path, '/')[-1]"
_LANG = "map_from_entries([" + ", ".join(f"('{e}', '{n}')" for e, n in D.EXTENSION_LANGUAGE.items()) + f"])[{_EXT}]"
_LINES = r"len(string_split_regex(content, '\r?\n'))"
_CX = "1 + " + " + ".join(f"len(regexp_extract_all(content, '{_q(D.re2(p))}'))" for p in D.COMPLEXITY)
_SOURCE, _CONFIG = f"{_EXT} IN ({_in(D.SOURCE_EXTENSIONS)})", f"lower({_BASE}) IN ({_in(D.CONFIG_NAMES)})"
_MODULE = "CASE WHEN string_split(path, '/')[1] = 'src' AND len(string_split(path, '/')) > 2 THEN 'src/' || string_split(path, '/')[2] WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[1] ELSE 'root' END"


def detect_language(spark, d):
    return _files(spark, d).select("file_id", "path", P.language(F.col("path")).alias("language")).distinct()


def file_kind_filter(spark, d):
    return _files(spark, d).select("file_id", P.is_source(F.col("path")).alias("is_source"), P.is_config(F.col("path")).alias("is_config")).distinct()


def line_count(spark, d):
    return _files(spark, d).select("file_id", T.line_count(F.col("content")).cast("bigint").alias("loc")).distinct()


def complexity_estimate(spark, d):
    return _files(spark, d).select("file_id", T.complexity(F.col("content")).cast("bigint").alias("complexity")).distinct()


def entrypoint_flag(spark, d):
    return _files(spark, d).select("file_id", P.is_entrypoint(F.col("path")).alias("entrypoint")).distinct()


def file_nodes(spark, d):
    f = _files(spark, d)
    mods = f.where("path is not null").select("repo_id", "path").distinct().withColumn("module", P.default_module(F.col("path")))
    n = graph.file_nodes(f, mods)
    return n.select("repo_id", "id", "label", "kind", "grp", F.col("loc").cast("bigint").alias("loc"), F.col("complexity").cast("bigint").alias("complexity"), "language", "entrypoint")


def module_assign(spark, d):
    f = _files(spark, d)
    globs = f.select("repo_id").distinct().withColumn("globs", F.array(F.lit("packages/*"), F.lit("apps/*"), F.lit("libs/**")))
    return monorepo.assign_modules(f, monorepo.workspace_roots(globs, f))


def workspace_roots(spark, d):
    f = _files(spark, d)
    globs = f.select("repo_id").distinct().withColumn("globs", F.array(F.lit("packages/*"), F.lit("apps/*"), F.lit("libs/**")))
    return monorepo.workspace_roots(globs, f)


def path_normalize(spark, d):
    p = F.concat(P.directory(F.col("path")), F.lit("/./x//../../"), P.basename(F.col("path")))
    return _files(spark, d).select("file_id", P.normalise(p).alias("normal")).distinct()


def file_read(spark, d):
    own = src.read_file(_files(spark, d)).select("file_id", F.col("lines").cast("bigint").alias("lines"), F.col("size_bytes").cast("bigint").alias("size_bytes"))
    return own.distinct()


def file_cap_topk(spark, d):
    one = _files(spark, d).groupBy("repo_id", "path", F.col("file_id").alias("ord")).agg(F.max("size").alias("size"))
    return src.cap_tree(one, max_files=20).select("repo_id", "path", F.col("depth").cast("bigint").alias("depth"))


def local_dir_filter(spark, d):
    return src.local_filter(_files(spark, d)).select("file_id", "path").distinct()


def upload_filter(spark, d):
    return src.upload_filter(_files(spark, d)).select("file_id", "path").distinct()


def language_histogram_files(spark, d):
    return detect_language(spark, d).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


def extract_imports(spark, d):
    own = im.extract_imports(_files(spark, d))
    return own.select("repo_id", "path", F.col("pattern_no").cast("bigint").alias("pattern_no"), F.col("pos").cast("bigint").alias("pos"), "raw", "is_relative")


def first_imports(spark, d):
    own = im.first_imports(im.extract_imports(_files(spark, d)))
    return own.select("repo_id", "path", "raw", "is_relative", F.col("no").cast("bigint").alias("no"))


def syntax_calls(spark, d):
    return fn.syntax_calls(_files(spark, d))


_RESPONSE = (
    "status string, quality string, warnings array<string>, nodes bigint, edges bigint, modules bigint, files bigint, functions bigint, externals bigint, avg_degree double, density double, max_complexity bigint, "
    "top_by_degree array<struct<rank:int,id:string,degree:bigint>>, hotspots array<struct<id:string>>, languages array<struct<language:string,files:bigint>>"
)


def analysis_json(spark, d):
    """The JSON response of each repository, read back into its fields."""
    from lodegraph.api import analyze, response

    j = response(analyze(_files(spark, d))).select("repo_id", F.from_json("json", _RESPONSE).alias("j")).select("repo_id", "j.*")
    langs = F.array_join(F.array_sort(F.transform("languages", lambda x: F.concat_ws("=", x["language"], x["files"].cast("string")))), ",")
    sizes = [F.coalesce(F.size(F.col(c)), F.lit(0)).cast("bigint").alias(c) for c in ("warnings", "top_by_degree", "hotspots")]
    best = F.array_max(F.transform("top_by_degree", lambda x: x["degree"])).alias("top_degree")
    return j.select("repo_id", "status", "quality", *"nodes edges modules files functions externals avg_degree density max_complexity".split(), *sizes, best, F.coalesce(langs, F.lit("")).alias("languages"))


def analysis_lines(spark, d):
    """The nodes and edges of the response's lines of JSON, read back."""
    from lodegraph.api import analyze, response_lines

    own = response_lines(analyze(_files(spark, d))).where("part <> 'summary'")
    f = lambda k: F.get_json_object("json", f"$.{k}").alias(k)
    own = own.select("repo_id", "part", f("kind"), f("id"), f("src"), f("dst"))
    return own.groupBy("repo_id", "part", "kind", "id", "src", "dst").agg(F.count("*").alias("lines"))


def root_order(spark, d):
    return monorepo.ranked_roots(workspace_roots(spark, d)).select("repo_id", "root", F.col("rank").cast("bigint").alias("rank"))


def analysis_status(spark, d):
    from lodegraph.api import status_of

    a = table(spark, d, "analyses").select("analysis_id", "quality").distinct()
    return a.select("analysis_id", status_of(F.col("quality")).alias("status"))


def resolve_imports(spark, d):
    f = _files(spark, d)
    return im.resolve_imports(im.extract_imports(f), f).select("repo_id", "src", "dst", F.col("pattern_no").cast("bigint").alias("pattern_no"), F.col("pos").cast("bigint").alias("pos"))


def external_packages(spark, d):
    own = im.external_packages(im.extract_imports(_files(spark, d)))
    return own.groupBy("repo_id", "package").agg(F.count("*").alias("refs"))


def extract_functions(spark, d):
    own = fn.extract_functions(_files(spark, d))
    return own.select("repo_id", "path", "name", F.col("line").cast("bigint").alias("line"), F.array_join("params", "|").alias("params"), "is_method", "language")


def function_nodes(spark, d):
    own = fn.function_nodes(fn.extract_functions(_files(spark, d)))
    return own.select("repo_id", "id", "label", "grp", F.col("loc").cast("bigint").alias("loc"))


def extract_calls(spark, d):
    own = fn.extract_calls(_files(spark, d))
    return own.groupBy("repo_id", "path", "callee").agg(F.count("*").alias("calls"))


def call_tiers(spark, d):
    f = _files(spark, d)
    own = fn.tiered_calls(fn.extract_calls(f), fn.extract_functions(f))
    return own.select("repo_id", "path", "callee", "calls", F.col("tier").cast("bigint").alias("tier"))


def resolve_calls(spark, d):
    f = _files(spark, d)
    own = fn.resolve_calls(fn.extract_calls(f), fn.extract_functions(f))
    return own.select("repo_id", "path", "callee", "calls", "func_path", F.col("line").cast("bigint").alias("line"))


def call_graph(spark, d):
    f = _files(spark, d)
    own = fn.call_edges(fn.resolve_calls(fn.extract_calls(f), fn.extract_functions(f)))
    return own.groupBy("repo_id", "src").agg(F.sum("calls").alias("edges"), F.countDistinct("dst").alias("functions"))


def membership_edges(spark, d):
    f = _files(spark, d)
    mods = f.where("path is not null").select("repo_id", "path").distinct().withColumn("module", P.default_module(F.col("path")))
    e = graph.membership_edges(mods, fn.function_nodes(fn.extract_functions(f)))
    return e.groupBy("repo_id", "src").agg(F.count("*").alias("edges"))


def call_edges(spark, d):
    f = _files(spark, d)
    return fn.call_edges(fn.resolve_calls(fn.extract_calls(f), fn.extract_functions(f))).select("repo_id", "src", "dst", "kind", "calls")


def membership_edge_rows(spark, d):
    f = _files(spark, d)
    mods = f.where("path is not null").select("repo_id", "path").distinct().withColumn("module", P.default_module(F.col("path")))
    return graph.membership_edges(mods, fn.function_nodes(fn.extract_functions(f))).select("repo_id", "src", "dst", "kind")


def graph_nodes(spark, d):
    own = graph.build_graph(_files(spark, d)).nodes
    return own.withColumn("loc", F.col("loc").cast("bigint")).withColumn("complexity", F.col("complexity").cast("bigint"))


def graph_edges(spark, d):
    g = graph.build_graph(_files(spark, d))
    return g.edges.groupBy("repo_id", "src", "dst", "kind").agg(F.sum("weight").alias("edges"))


def target_url_classify(spark, d):
    r = table(spark, d, "repos").select("repo_id", "owner", "repo")
    o, n = F.col("owner"), F.col("repo")
    forms = [
        F.concat(F.lit("https://github.com/"), o, F.lit("/"), n, F.lit(".git")), F.concat(F.lit(" https://www.github.com/"), o), F.concat(F.lit("/srv/"), o, F.lit("/"), n), F.concat(F.lit("C:\\"), n), F.concat(F.lit("file:///a/"), n),
        F.concat(F.lit("https://"), n, F.lit(".example.org/x")), F.concat(F.lit("ftp://"), n), F.concat(F.lit("https://notgithub.com/"), o, F.lit("/"), n), n,
    ]
    own = r.select("repo_id", F.posexplode(F.array(*forms)).alias("form", "url"))
    t = src.classify_target(F.col("url"))
    return own.select("repo_id", F.col("form").cast("bigint").alias("form"), t["owner"].alias("owner"), t["repo"].alias("repo"), t["target_type"].alias("target_type"))


def repo_url_split(spark, d):
    r = table(spark, d, "repos").select("repo_id", F.concat(F.lit("https://host/"), "owner", F.lit("/"), "repo", F.lit(".git")).alias("url"))
    return r.select("repo_id", src.repo_of_url(F.col("url"))["owner"].alias("owner"), src.repo_of_url(F.col("url"))["repo"].alias("repo"))


def fnv1a_hash(spark, d):
    r = table(spark, d, "repos")
    return r.select("repo_id", T.fnv1a(F.concat("owner", F.lit("/"), "repo", F.lit("@"), "branch")).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        detect_language, file_kind_filter, line_count, complexity_estimate, entrypoint_flag, file_nodes, module_assign, workspace_roots, path_normalize, file_read, file_cap_topk, local_dir_filter, upload_filter, language_histogram_files,
        extract_imports, first_imports, resolve_imports, external_packages, extract_functions, function_nodes, extract_calls, syntax_calls, call_tiers, resolve_calls, call_graph, call_edges, membership_edges, membership_edge_rows, graph_nodes, graph_edges, analysis_json, analysis_lines, analysis_status, root_order, target_url_classify, repo_url_split,
        fnv1a_hash,
    )
}

# ---------------------------------------------------------------- SQL

_C = "f AS (SELECT DISTINCT repo_id, path, content FROM files WHERE content IS NOT NULL AND content <> '')"


def _imports_sql() -> str:
    out = []
    for exts, patterns, rule in D.IMPORTS:
        tests = ["true"] if rule == "*" else [f"raw LIKE '{p}%'" for p in (".", "/") if p in rule.replace("package:", "")] + ["contains(raw, '::')"] * ("::" in rule) + ["raw LIKE 'package:%'"] * ("package:" in rule)
        for n, p in enumerate(patterns):
            rel = " OR ".join(tests) or "false"
            out.append(
                f"SELECT repo_id, path, {n} AS pattern_no, unnest(range(len(x))) AS pos, unnest(x) AS raw0, '{_q(rel)}' AS r FROM (SELECT repo_id, path, regexp_extract_all(content, '{_q(D.re2(p))}', 1) AS x FROM f WHERE {_EXT} IN ({_in(exts.split())}))"
            )
    go = f"SELECT repo_id, path, 0, unnest(range(len(x))), unnest(x), 'go' FROM (SELECT repo_id, path, regexp_extract_all(content, '{_q(D.re2(D.GO_SINGLE))}', 1) AS x FROM f WHERE {_EXT} = 'go')"
    block = (
        f"SELECT repo_id, path, 1, unnest(range(len(x))), unnest(x), 'go' FROM (SELECT repo_id, path, flatten(list_transform(regexp_extract_all(content, '{_q(D.re2(D.GO_BLOCK))}', 1), lambda b: regexp_extract_all(b, '{_q(D.GO_ITEM)}', 1))) AS x FROM f WHERE {_EXT} = 'go')"
    )
    rel = "CASE WHEN r = 'true' THEN true WHEN r = 'false' THEN false ELSE (r LIKE '%''.%' AND starts_with(raw, '.')) OR (r LIKE '%''/%' AND starts_with(raw, '/')) OR (r LIKE '%::%' AND contains(raw, '::')) OR (r LIKE '%package:%' AND starts_with(raw, 'package:')) OR (r = 'go' AND (starts_with(raw, '.') OR starts_with(raw, '/'))) END"
    return f"i AS (SELECT DISTINCT repo_id, path, CAST(pattern_no AS BIGINT) AS pattern_no, CAST(pos AS BIGINT) AS pos, raw, {rel} AS is_relative FROM (SELECT *, regexp_replace(raw0, '^\\s+|\\s+$', '', 'g') AS raw FROM (" + " UNION ALL ".join([*out, go, block]) + ")) WHERE raw <> '')"


_I = _imports_sql()
_FOLD = "array_to_string(list_reduce(string_split({0}, '/'), lambda s, p: CASE WHEN p = '' OR p = '.' THEN s WHEN p = '..' THEN s[1:len(s) - 1] ELSE list_append(s, p) END, []::VARCHAR[]), '/')"
_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"


def _functions_sql() -> str:
    out = []
    for e, patterns in D.FUNCTIONS.items():
        exts = [e, *(k for k, v in D.FUNCTIONS_OF.items() if v == e)]
        for n, (p, m) in enumerate(patterns):
            q = _q(p)
            out.append(
                f"SELECT repo_id, path, {n} AS pattern_no, unnest(range(len(nm))) AS pos, unnest(nm) AS name, unnest(pr) AS params, {str(m).lower()} AS is_method, unnest(list_transform(range(len(nm)), lambda k: 1 + len(list_reduce(pc[1:k + 1], lambda a, b: a || b)) - len(replace(list_reduce(pc[1:k + 1], lambda a, b: a || b), chr(10), '')) + CASE WHEN k > 0 THEN len(list_reduce(wh[1:k], lambda a, b: a || b)) - len(replace(list_reduce(wh[1:k], lambda a, b: a || b), chr(10), '')) ELSE 0 END)) AS line "
                f"FROM (SELECT repo_id, path, regexp_extract_all(content, '{q}', 1) AS nm, regexp_extract_all(content, '{q}', 2) AS pr, regexp_extract_all(content, '{q}', 0) AS wh, string_split_regex(content, '{q}') AS pc FROM f WHERE {_EXT} IN ({_in(exts)})) WHERE len(nm) > 0"
            )
    first = "SELECT repo_id, path, name, CAST(line AS BIGINT) AS line, arg_min(params, pattern_no * 1000000 + pos) AS params0, arg_min(is_method, pattern_no * 1000000 + pos) AS is_method FROM (" + " UNION ALL ".join(out) + ") GROUP BY ALL"
    return f"fn AS (SELECT repo_id, path, name, line, is_method, array_to_string(list_filter(list_transform(string_split(params0, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') AS params, {_LANG} AS language FROM ({first}))"


_FN = _functions_sql()
_CALLS = "c AS (SELECT repo_id, path, callee, count(*) AS calls FROM (" + " UNION ALL ".join(
    f"SELECT repo_id, path, unnest(regexp_extract_all(content, '{_q(p)}', 1)) AS callee FROM f WHERE {_EXT} = '{e}'" for e, ps in D.CALLS.items() for p in ps
) + f") WHERE callee NOT IN ({_in(D.NO_CALLS)}) AND callee <> '' GROUP BY ALL)"
_TIERS = f"""
a AS (SELECT c.*, {_MODULE} AS module FROM c),
g AS (SELECT repo_id, path AS func_path, name, line, {_MODULE} AS func_module FROM fn),
t AS (SELECT a.repo_id, a.path, a.callee, a.calls, g.func_path, g.line, CASE WHEN g.func_path = a.path THEN 0 WHEN g.func_module = a.module THEN 1 ELSE 2 END AS tier FROM a JOIN g ON a.repo_id = g.repo_id AND a.callee = g.name),
r AS (SELECT repo_id, path, callee, calls, func_path, line FROM t QUALIFY tier = min(tier) OVER (PARTITION BY repo_id, path, callee))
"""
_ROOTS = """p AS (SELECT DISTINCT repo_id, path FROM files WHERE path IS NOT NULL),
w AS (SELECT DISTINCT repo_id, CASE WHEN len(string_split(path, '/')) > 1 AND string_split(path, '/')[1] IN ('packages', 'apps') AND string_split(path, '/')[2] <> '' THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] END AS root FROM p),
roots AS (SELECT DISTINCT repo_id, root FROM w WHERE root IS NOT NULL
  UNION SELECT repo_id, 'libs/**' FROM p
  UNION SELECT repo_id, g || '/*' FROM (SELECT DISTINCT repo_id FROM p), (VALUES ('packages'), ('apps')) v(g) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.repo_id IS NOT DISTINCT FROM p.repo_id AND root LIKE v.g || '/%'))"""
_ROOTS = _ROOTS.replace("(SELECT DISTINCT repo_id FROM p), (VALUES", "(SELECT DISTINCT repo_id FROM p) p, (VALUES")
_CANDS = " UNION ALL ".join(f"SELECT repo_id, path, pattern_no, pos, {n} AS cand_no, base || '{c}' AS candidate FROM b" for n, c in enumerate(D.CANDIDATES))

_PATHS = "p AS (SELECT DISTINCT repo_id, path FROM files WHERE path IS NOT NULL)"
_MEMBERS = f"SELECT repo_id, 'mod:' || {_MODULE} AS src, 'file:' || path AS dst, 'import' AS kind FROM p UNION ALL SELECT repo_id, 'file:' || path, fid, 'import' FROM fi UNION ALL SELECT repo_id, 'mod:' || {_MODULE}, fid, 'import' FROM fi"
_FI = "fi AS (SELECT repo_id, path, 'func:' || path || ':' || name || ':' || line AS fid, name, language FROM fn)"
_RESOLVED = f"b AS (SELECT *, {_FOLD.format(f'(({_DIR}) || {chr(39)}/{chr(39)} || raw)')} AS base FROM i WHERE is_relative AND (raw LIKE '.%' OR raw LIKE '/%')), k AS ({_CANDS}), ri AS (SELECT * FROM (SELECT k.repo_id, k.path, k.pattern_no, k.pos, arg_min(candidate, cand_no) AS dst FROM k JOIN p ON p.repo_id = k.repo_id AND p.path = k.candidate GROUP BY ALL) WHERE dst <> path)"
_PACKAGE = "CASE WHEN raw LIKE '@%' THEN array_to_string(string_split(raw, '/')[1:2], '/') ELSE string_split(raw, '/')[1] END"
_EXTERNAL = f"x AS (SELECT repo_id, path, {_PACKAGE} AS package FROM i WHERE NOT is_relative AND {_PACKAGE} <> '')"

ORACLES = {
    "detect_language": f"SELECT DISTINCT file_id, path, {_LANG} AS language FROM files",
    "file_kind_filter": f"SELECT DISTINCT file_id, {_SOURCE} AS is_source, {_CONFIG} AS is_config FROM files",
    "line_count": f"SELECT DISTINCT file_id, CASE WHEN length(content) > 0 THEN CAST({_LINES} AS BIGINT) END AS loc FROM files",
    "complexity_estimate": f"SELECT DISTINCT file_id, CASE WHEN length(content) > 0 THEN CAST({_CX} AS BIGINT) END AS complexity FROM files",
    "entrypoint_flag": "SELECT DISTINCT file_id, " + " OR ".join(f"regexp_matches(path, '{p}')" for p in D.ENTRYPOINTS) + " AS entrypoint FROM files",
    "file_nodes": f"SELECT repo_id, 'file:' || path AS id, {_BASE} AS label, CASE WHEN {_CONFIG} THEN 'config' ELSE 'file' END AS kind, {_MODULE} AS grp, max(CASE WHEN length(content) > 0 THEN CAST({_LINES} AS BIGINT) END) AS loc, max(CASE WHEN length(content) > 0 THEN CAST({_CX} AS BIGINT) END) AS complexity, {_LANG} AS language, {' OR '.join(f"regexp_matches(path, '{p}')" for p in D.ENTRYPOINTS)} AS entrypoint FROM files WHERE path IS NOT NULL GROUP BY ALL",
    "module_assign": f"WITH {_ROOTS}, m AS (SELECT p.repo_id, p.path, arg_max(root, length(root)) AS root FROM p JOIN roots r ON r.repo_id = p.repo_id AND (p.path = r.root OR starts_with(p.path, r.root || '/')) GROUP BY ALL) SELECT p.repo_id, p.path, coalesce(m.root, {_MODULE.replace('path', 'p.path')}) AS module FROM p LEFT JOIN m ON m.repo_id = p.repo_id AND m.path = p.path",
    "workspace_roots": f"WITH {_ROOTS} SELECT repo_id, root FROM roots",
    "path_normalize": f"SELECT DISTINCT file_id, {_FOLD.format(f'(({_DIR}) || {chr(39)}/./x//../../{chr(39)} || {_BASE})')} AS normal FROM files",
    "file_read": "SELECT DISTINCT file_id, CASE WHEN content IS NOT NULL THEN CAST(len(string_split(content, chr(10))) AS BIGINT) END AS lines, CAST(strlen(content) AS BIGINT) AS size_bytes FROM files",
    "file_cap_topk": f"WITH o AS (SELECT repo_id, path, file_id, max(size) AS size FROM files GROUP BY ALL) SELECT repo_id, path, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM o WHERE ({_SOURCE} OR {_CONFIG}) AND coalesce(size, 0) <= {D.MAX_BYTES} QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY len(string_split(path, '/')), file_id) <= 20",
    "local_dir_filter": f"SELECT DISTINCT file_id, path FROM files WHERE ({_SOURCE} OR {_CONFIG}) AND NOT list_has_any(string_split(path, '/'), [{_in(D.LOCAL_SKIPPED)}])",
    "upload_filter": f"SELECT DISTINCT file_id, path FROM files WHERE {_EXT} NOT IN ({_in(D.UPLOAD_SKIPPED_EXTENSIONS)})" + "".join(f" AND NOT contains(path, '{x}')" for x in D.UPLOAD_SKIPPED_DIRS),
    "language_histogram_files": f"SELECT language, count(*) AS files FROM (SELECT DISTINCT file_id, path, {_LANG} AS language FROM files) WHERE language IS NOT NULL GROUP BY 1",
    "extract_imports": f"WITH {_C}, {_I} SELECT * FROM i",
    "resolve_imports": f"WITH {_C}, {_I}, b AS (SELECT *, {_FOLD.format(f'(({_DIR}) || {chr(39)}/{chr(39)} || raw)')} AS base FROM i WHERE is_relative AND (raw LIKE '.%' OR raw LIKE '/%')), k AS ({_CANDS}) SELECT repo_id, path AS src, dst, pattern_no, pos FROM (SELECT k.repo_id, k.path, k.pattern_no, k.pos, arg_min(candidate, cand_no) AS dst FROM k JOIN (SELECT DISTINCT repo_id, path AS fp FROM files) p ON p.repo_id = k.repo_id AND p.fp = k.candidate GROUP BY ALL) WHERE dst <> path",
    "first_imports": f"WITH {_C}, {_I} SELECT repo_id, path, raw, raw LIKE './%' OR raw LIKE '../%' OR raw LIKE '/%' AS is_relative, row_number() OVER (PARTITION BY repo_id, path ORDER BY o) - 1 AS no FROM (SELECT repo_id, path, raw, min(pattern_no * 1000000 + pos) AS o FROM i GROUP BY ALL)",
    "syntax_calls": f"WITH k AS (SELECT DISTINCT repo_id, path, regexp_extract_all(regexp_replace(regexp_replace(content, '{_q(D.REMARK)}', ' ', 'g'), '{_q(D.DEFINITION)}', ' (', 'g'), '{_q(D.CALLED)}', 1) AS x FROM files WHERE content IS NOT NULL AND {_EXT} IN ({_in(D.BRACES)})), u AS (SELECT repo_id, path, unnest(x) AS y FROM k) SELECT repo_id, path, ltrim(y, '.') AS callee, starts_with(y, '.') AS is_method, count(*) AS calls FROM u WHERE ltrim(y, '.') NOT IN ({_in(D.NO_CALLS)}) GROUP BY ALL",
    "analysis_status": "SELECT DISTINCT analysis_id, CASE WHEN quality = 'full' THEN 'success' WHEN quality IS NULL THEN 'error' ELSE 'partial' END AS status FROM analyses",
    "external_packages": f"WITH {_C}, {_I}, e AS (SELECT repo_id, CASE WHEN raw LIKE '@%' THEN array_to_string(string_split(raw, '/')[1:2], '/') ELSE string_split(raw, '/')[1] END AS package FROM i WHERE NOT is_relative) SELECT repo_id, package, count(*) AS refs FROM e WHERE package <> '' GROUP BY ALL",
    "extract_functions": f"WITH {_C}, {_FN} SELECT repo_id, path, name, line, params, is_method, language FROM fn",
    "function_nodes": f"WITH {_C}, {_FN} SELECT repo_id, 'func:' || path || ':' || name || ':' || line AS id, name AS label, {_DIR} AS grp, CAST(1 AS BIGINT) AS loc FROM fn",
    "extract_calls": f"WITH {_C}, {_CALLS} SELECT * FROM c",
    "resolve_calls": f"WITH {_C}, {_FN}, {_CALLS}, {_TIERS} SELECT * FROM r",
    "call_graph": f"WITH {_C}, {_FN}, {_CALLS}, {_TIERS} SELECT repo_id, 'file:' || path AS src, CAST(sum(calls) AS BIGINT) AS edges, count(DISTINCT func_path || ':' || callee || ':' || line) AS functions FROM r GROUP BY ALL",
    "membership_edges": f"WITH {_C}, {_FN}, p AS (SELECT DISTINCT repo_id, path FROM files WHERE path IS NOT NULL) SELECT repo_id, src, count(*) AS edges FROM (SELECT repo_id, 'mod:' || {_MODULE} AS src FROM p UNION ALL SELECT repo_id, 'file:' || path FROM fn UNION ALL SELECT repo_id, 'mod:' || {_MODULE} FROM fn) GROUP BY ALL",
    "target_url_classify": """SELECT repo_id, CAST(form AS BIGINT) AS form, CASE form WHEN 0 THEN owner WHEN 7 THEN owner WHEN 2 THEN 'local' WHEN 3 THEN 'local' WHEN 4 THEN 'local' WHEN 5 THEN 'web' END AS owner,
      CASE form WHEN 0 THEN repo WHEN 7 THEN repo WHEN 2 THEN repo WHEN 3 THEN repo WHEN 4 THEN repo WHEN 5 THEN lower(repo) || '.example.org' END AS repo, CASE form WHEN 0 THEN 'github' WHEN 7 THEN 'github' WHEN 2 THEN 'local' WHEN 3 THEN 'local' WHEN 4 THEN 'local' WHEN 5 THEN 'website' END AS target_type
      FROM repos, range(9) t(form)""",
    "repo_url_split": "SELECT repo_id, owner, repo FROM repos",
    "fnv1a_hash": "SELECT repo_id, list_reduce(list_transform(string_split(owner || '/' || repo || '@' || branch, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS hash FROM repos",
}
ORACLES |= {
    "call_edges": f"WITH {_C}, {_FN}, {_CALLS}, {_TIERS} SELECT repo_id, 'file:' || path AS src, 'func:' || func_path || ':' || callee || ':' || line AS dst, 'call' AS kind, CAST(sum(calls) AS BIGINT) AS calls FROM r GROUP BY ALL",
    "membership_edge_rows": f"WITH {_C}, {_FN}, {_PATHS}, {_FI} {_MEMBERS}",
    "graph_nodes": f"""WITH {_C}, {_I}, {_FN}, {_PATHS}, {_FI}, {_EXTERNAL}
SELECT DISTINCT repo_id, 'mod:' || {_MODULE} AS id, string_split({_MODULE}, '/')[-1] AS label, 'module' AS kind, NULL AS path, {_MODULE} AS grp, CAST(NULL AS BIGINT) AS loc, CAST(NULL AS BIGINT) AS complexity, NULL AS language, CAST(NULL AS BOOLEAN) AS entrypoint FROM p
UNION ALL SELECT repo_id, id, label, kind, substr(id, 6), grp, loc, complexity, language, entrypoint FROM ({ORACLES["file_nodes"]})
UNION ALL SELECT repo_id, fid, name, 'function', path, {_DIR}, 1, 1, language, NULL FROM fi
UNION ALL SELECT DISTINCT repo_id, 'ext:' || package, package, 'external', NULL, 'external', NULL, NULL, NULL, NULL FROM x""",
    "graph_edges": f"""WITH {_C}, {_I}, {_FN}, {_CALLS}, {_TIERS}, {_PATHS}, {_FI}, {_RESOLVED}, {_EXTERNAL}, e AS (
SELECT *, 1 AS n FROM ({_MEMBERS}) UNION ALL SELECT repo_id, 'file:' || path, 'file:' || dst, 'import', 1 FROM ri UNION ALL SELECT repo_id, 'file:' || path, 'ext:' || package, 'import', 1 FROM x
UNION ALL SELECT repo_id, 'file:' || path, 'func:' || func_path || ':' || callee || ':' || line, 'call', calls FROM r)
SELECT repo_id, src, dst, kind, CAST(sum(n) AS BIGINT) AS edges FROM e GROUP BY ALL""",
}
_R2 = "floor(({0}) * {1} + 0.5) / {1}"
ORACLES |= {
    "call_tiers": f"WITH {_C}, {_FN}, {_CALLS}, {_TIERS} SELECT repo_id, path, callee, calls, CAST(min(tier) AS BIGINT) AS tier FROM t GROUP BY ALL",
    "root_order": f"WITH {_ROOTS} SELECT repo_id, root, row_number() OVER (PARTITION BY repo_id ORDER BY length(root) DESC, root) AS rank FROM roots",
    "analysis_lines": f"SELECT repo_id, 'node' AS part, kind, id, NULL AS src, NULL AS dst, count(*) AS lines FROM ({ORACLES['graph_nodes']}) GROUP BY ALL UNION ALL SELECT repo_id, 'edge', kind, NULL, src, dst, edges FROM ({ORACLES['graph_edges']})",
    "analysis_json": f"""WITH n AS ({ORACLES["graph_nodes"]}), e AS ({ORACLES["graph_edges"]}),
nn AS (SELECT repo_id, count(*) AS nodes, count(*) FILTER (kind = 'module') AS modules, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'external') AS externals, greatest(coalesce(max(complexity), 0), 0) AS max_complexity,
  least(5, count(*) FILTER (complexity > 0)) AS hotspots FROM n GROUP BY 1),
ee AS (SELECT repo_id, CAST(sum(edges) AS BIGINT) AS edges FROM e GROUP BY 1),
dd AS (SELECT repo_id, id, sum(edges) AS degree FROM (SELECT repo_id, src AS id, edges FROM e UNION ALL SELECT repo_id, dst, edges FROM e) GROUP BY ALL),
d5 AS (SELECT repo_id, CAST(max(degree) AS BIGINT) AS top_degree, least(5, count(*)) AS top_by_degree FROM dd GROUP BY 1),
ll AS (SELECT repo_id, string_agg(language || '=' || c, ',' ORDER BY language || '=' || c) AS languages FROM (SELECT repo_id, language, count(*) AS c FROM n WHERE kind IN ('file', 'config') AND language IS NOT NULL GROUP BY ALL) GROUP BY 1),
qq AS (SELECT repo_id, CASE WHEN bool_and(has) THEN 'full' ELSE 'partial' END AS quality, least(6, count(*) FILTER (NOT has)) AS warnings FROM (SELECT repo_id, path, bool_or(content IS NOT NULL) AS has FROM files WHERE path IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT repo_id, CASE quality WHEN 'full' THEN 'success' ELSE 'partial' END AS status, quality, nodes, coalesce(edges, 0) AS edges, modules, files, functions, externals, {_R2.format("2.0::DOUBLE * coalesce(edges, 0) / nodes", 100)} AS avg_degree,
  CASE WHEN nodes > 1 THEN {_R2.format("coalesce(edges, 0)::DOUBLE / (nodes * (nodes - 1))", 10000)} ELSE 0.0 END AS density, max_complexity, warnings, coalesce(top_by_degree, 0) AS top_by_degree, hotspots, top_degree, coalesce(languages, '') AS languages
FROM nn LEFT JOIN ee USING (repo_id) LEFT JOIN d5 USING (repo_id) LEFT JOIN ll USING (repo_id) LEFT JOIN qq USING (repo_id)""",
}
