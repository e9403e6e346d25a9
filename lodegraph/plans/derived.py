"""Queries over inputs that are derived from the tables, as these hold no configuration of workspaces and aliases and no pages.

Both engines derive the same inputs; the SQL then computes the results from them by its own means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import dictionaries as D
from lodegraph.operators import cycles, metrics, monorepo
from lodegraph.operators import imports as im
from lodegraph.plans.code import _CANDS, _FOLD, _MODULE
from lodegraph.plans.graphs import _DEP, _E, _N, _ne
from lodegraph.session import table
from lodegraph.sources import files as src

# ---------------------------------------------------------------- workspaces

# (kind of repository, path, content), with {r} for its name: every tool, and two that end in none
_ROOT_FILES = [
    (0, "pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - '{r}/*'\n  - ./tools/*   # tools\n"),
    (0, "package.json", '{"workspaces":["a/*"]}'),
    (1, "package.json", '{"workspaces":["apps/*","{r}/*","libs/**"]}'),
    (2, "package.json", '{"workspaces":["services/*","src/*"]}'),
    (2, "turbo.json", "{}"),
    (3, "package.json", '{"workspaces":["x/{r}"]}'),
    (3, "nx.json", "{}"),
    (4, "turbo.json", '{"workspace":["apps/*"]}'),
    (5, "nx.json", "{}"),
    (6, "go.work", "go 1.22\n\nuse ./{r}\nuse (\n\t./b\n)\n"),
    (7, "Cargo.toml", '[package]\nname = "x"\n[workspace]\nmembers = ["{r}/*", "crates/a"]\n'),
    (8, "lerna.json", '{"packages":["packages/*","{r}/*"]}'),
    (9, "package.json", '{"workspaces":{"packages":["p/*"]}}'),
    (10, "README.md", "- a\n"),
]


def _roots(spark, d) -> DataFrame:
    kinds = spark.createDataFrame(_ROOT_FILES, "kind int, path string, content string")
    r = table(spark, d, "repos").select("repo_id", "repo", (F.col("repo_id") % 11).cast("int").alias("kind"))
    return r.join(kinds, "kind").select("repo_id", "path", F.replace("content", F.lit("{r}"), F.col("repo")).alias("content"))


def monorepo_detect(spark, d):
    return monorepo.monorepo_detect(_roots(spark, d)).select("repo_id", "tool", F.array_join("globs", ",").alias("globs"))


def detected_roots(spark, d):
    """Tools and globs as detected, and the roots that the globs become among the files."""
    return monorepo.workspace_roots(monorepo.monorepo_detect(_roots(spark, d)), table(spark, d, "files"))


def detected_modules(spark, d):
    return monorepo.assign_modules(table(spark, d, "files"), detected_roots(spark, d))


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


_CONFIGS = "c AS (SELECT repo_id, path, replace(content, '{r}', repo) AS content FROM repos JOIN (VALUES " + ", ".join(f"({k}, {_sq(p)}, {_sq(c)})" for k, p, c in _ROOT_FILES) + ") v(kind, path, content) ON repo_id % 11 = kind)"
_TOOLS = """w AS (SELECT repo_id, max(content) FILTER (path = 'pnpm-workspace.yaml') AS pnpm, max(content) FILTER (path = 'package.json') AS pkg, max(content) FILTER (path = 'turbo.json') AS turbo, max(content) FILTER (path = 'nx.json') AS nx,
  max(content) FILTER (path = 'go.work') AS go, max(content) FILTER (path = 'Cargo.toml') AS cargo, max(content) FILTER (path = 'lerna.json') AS lerna FROM c GROUP BY 1),
g AS (SELECT *, CASE WHEN json_type(pkg, '$.workspaces') = 'ARRAY' THEN json_extract_string(pkg, '$.workspaces[*]') ELSE [] END AS ws FROM w)
SELECT repo_id, CASE WHEN pnpm IS NOT NULL THEN 'pnpm' WHEN len(ws) > 0 AND turbo IS NOT NULL THEN 'turbo' WHEN len(ws) > 0 AND nx IS NOT NULL THEN 'nx' WHEN len(ws) > 0 THEN 'npm' WHEN turbo IS NOT NULL THEN 'turbo' WHEN nx IS NOT NULL THEN 'nx'
  WHEN go IS NOT NULL THEN 'go-work' WHEN contains(cargo, '[workspace]') THEN 'cargo-workspace' WHEN lerna IS NOT NULL THEN 'lerna' ELSE 'none' END AS tool,
 array_to_string(CASE WHEN pnpm IS NOT NULL THEN list_transform(list_filter(string_split(pnpm, chr(10)), lambda x: starts_with(trim(x), '- ')), lambda x: trim(string_split(replace(trim(x), '''', ''), ' ')[2]))
  WHEN len(ws) > 0 THEN ws WHEN turbo IS NOT NULL THEN json_extract_string(turbo, '$.workspace[*]') WHEN nx IS NOT NULL THEN []
  WHEN go IS NOT NULL THEN list_transform(list_filter(string_split(go, chr(10)), lambda x: starts_with(x, 'use ')), lambda x: string_split(x, ' ')[2])
  WHEN cargo IS NOT NULL THEN list_transform(string_split(regexp_extract(cargo, 'members = \\[([^\\]]*)', 1), ','), lambda x: trim(replace(x, '"', ''))) WHEN lerna IS NOT NULL THEN json_extract_string(lerna, '$.packages[*]') ELSE [] END, ',') AS globs FROM g"""

_GLOBS = f"""{_CONFIGS}, tools AS (WITH {_TOOLS}), gl AS (SELECT DISTINCT repo_id, unnest(string_split(globs, ',')) AS gb FROM tools WHERE globs <> ''),
pf AS (SELECT DISTINCT repo_id, path FROM files WHERE path IS NOT NULL),
ch AS (SELECT DISTINCT gl.repo_id, gb, rtrim(gb, '*') || string_split(substr(path, length(gb)), '/')[1] AS root FROM gl JOIN pf ON pf.repo_id = gl.repo_id AND gb LIKE '%/*' AND gb NOT LIKE '%**' AND starts_with(path, rtrim(gb, '*'))),
ro AS (SELECT DISTINCT gl.repo_id, coalesce(root, gl.gb) AS root FROM gl LEFT JOIN ch ON ch.repo_id = gl.repo_id AND ch.gb = gl.gb)"""

# ---------------------------------------------------------------- aliases

_TSCONFIGS = [
    (0, "tsconfig.json", '{"compilerOptions":{"baseUrl":".","paths":{"@/*":["./src/*"],"~{r}/*":["packages/*","apps/*"],"main":["src/index"],"none/*":[]}}}'),
    (1, "tsconfig.json", '{"compilerOptions":{"baseUrl":"./src/../","paths":{"~{r}/*":["./apps/../packages/*"],"@/*":["src/*"],"main":["lib/{r}"]}}}'),
    (1, "web/tsconfig.app.json", '{"compilerOptions":{"baseUrl":"src","paths":{"#/*":["../../src/*"],"@/*":["./never/*"]}}}'),
    (2, "tsconfig.json", '{ // comment\n"compilerOptions":{"paths":{"@/*":["src/*"]}}}'),
    (2, "x/tsconfig.base.json", '{"compilerOptions":{"paths":{"@/*":["../src/*"]}}}'),
]


def _configs(spark, d) -> DataFrame:
    kinds = spark.createDataFrame(_TSCONFIGS, "kind int, path string, content string")
    r = table(spark, d, "repos").select("repo_id", "repo", (F.col("repo_id") % 3).cast("int").alias("kind"))
    return r.join(kinds, "kind").select("repo_id", "path", F.replace("content", F.lit("{r}"), F.col("repo")).alias("content"))


def _specs(spark, d) -> DataFrame:
    """Imports by alias of every file below src and packages, and two that have no alias, of a file at its own place."""
    f = table(spark, d, "files").where("path is not null and repo_id is not null").select("repo_id", "path").distinct()
    f = f.join(table(spark, d, "repos").select("repo_id", "repo"), "repo_id")
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    spec = F.when(F.col("path").startswith("src/"), F.concat(F.when(F.length("path") % 2 == 0, F.lit("@/")).otherwise(F.lit("#/")), F.substring(bare, 5, 10**6))).when(F.col("path").startswith("packages/"), F.concat(F.lit("~"), "repo", F.lit("/"), F.substring(bare, 10, 10**6)))
    own = f.select("repo_id", F.concat(F.lit("use/"), "path", F.lit(".ts")).alias("path"), F.posexplode(F.array(spec, F.lit("main"), F.lit("react"), F.lit("./x"))).alias("pos", "raw"))
    return own.where("raw is not null").select("repo_id", "path", F.lit(0).alias("pattern_no"), "pos", "raw", F.col("raw").startswith(".").alias("is_relative"))


def tsconfig_aliases(spark, d):
    own = im.aliases(_configs(spark, d))
    return own.select("repo_id", "config_path", F.col("alias_ord").cast("bigint").alias("alias_ord"), "alias_key", "wildcard", F.array_join("targets", ",").alias("targets"), "base_url")


def resolve_alias(spark, d):
    own = im.rewrite_aliases(_specs(spark, d), im.aliases(_configs(spark, d)))
    return own.select("repo_id", "path", "raw", "rewritten")


def resolve_any(spark, d):
    own = im.resolve_any(_specs(spark, d), im.aliases(_configs(spark, d)), table(spark, d, "files"), strict=True)
    return own.select("repo_id", "path", "raw", "target")


_TS = "t AS (SELECT repo_id, path, replace(content, '{r}', repo) AS content FROM repos JOIN (VALUES " + ", ".join(f"({k}, {_sq(p)}, {_sq(c)})" for k, p, c in _TSCONFIGS) + ") v(kind, path, content) ON repo_id % 3 = kind)"
_AT = "CASE WHEN contains(config_path, '/') THEN regexp_replace(config_path, '/[^/]*$', '') ELSE '' END"
_ALIASES = f"""{_TS},
k AS (SELECT repo_id, path AS config_path, content, unnest(json_keys(content, '$.compilerOptions.paths')) AS k, unnest(range(len(json_keys(content, '$.compilerOptions.paths')))) AS alias_ord FROM t WHERE json_valid(content)),
b AS (SELECT *, {_FOLD.format(f"({_AT} || '/' || coalesce(json_extract_string(content, '$.compilerOptions.baseUrl'), ''))")} AS base_url, from_json(json_extract(content, '/compilerOptions/paths/' || replace(replace(k, '~', '~0'), '/', '~1')), '["VARCHAR"]') AS ts FROM k),
a AS (SELECT repo_id, config_path, CAST(alias_ord AS BIGINT) AS alias_ord, rtrim(k, '*') AS alias_key, contains(k, '*') AS wildcard,
  list_filter(list_transform(ts, lambda x: {_FOLD.format("(base_url || '/' || rtrim(x, '*'))")}), lambda x: x <> '') AS targets, base_url FROM b)"""
_BARE = "regexp_replace(path, '\\.[^./]*$', '')"
_SPECS = f"""s0 AS (SELECT DISTINCT files.repo_id, path, repo FROM files JOIN repos ON repos.repo_id = files.repo_id WHERE path IS NOT NULL),
s AS (SELECT repo_id, 'use/' || path || '.ts' AS path, unnest(range(4)) AS pos, unnest([CASE WHEN path LIKE 'src/%' THEN CASE WHEN length(path) % 2 = 0 THEN '@/' ELSE '#/' END || substr({_BARE}, 5) WHEN path LIKE 'packages/%' THEN '~' || repo || '/' || substr({_BARE}, 10) END, 'main', 'react', './x']) AS raw FROM s0),
h AS (SELECT s.repo_id, s.path, s.pos, s.raw, arg_min(CASE WHEN NOT wildcard THEN coalesce(targets[1], '') ELSE concat_ws('/', targets[1], nullif(substr(raw, length(alias_key) + 1), '')) END, config_path || chr(0) || lpad(alias_ord::VARCHAR, 9, '0')) AS rewritten
  FROM s JOIN a ON a.repo_id = s.repo_id AND s.raw NOT LIKE '.%' AND ((NOT wildcard AND raw = alias_key) OR (wildcard AND starts_with(raw, alias_key) AND len(targets) > 0)) WHERE raw IS NOT NULL GROUP BY ALL),
z AS (SELECT s.repo_id, s.path, s.pos, s.raw, h.rewritten FROM s LEFT JOIN h ON h.repo_id = s.repo_id AND h.path = s.path AND h.pos = s.pos WHERE s.raw IS NOT NULL)"""
_BASE = _FOLD.format("(CASE WHEN raw LIKE '.%' THEN regexp_replace(path, '/[^/]*$', '') || '/' || raw ELSE rewritten END)")

# ---------------------------------------------------------------- listings


def _tree_pages(spark, d) -> DataFrame:
    """The files as pages of tree listings, some truncated, with entries that are no files."""
    f = table(spark, d, "files").where("path is not null and repo_id is not null").groupBy("repo_id", "path").agg(F.max("size").alias("size"), F.min("file_id").alias("file_id"))
    entry = F.struct("path", F.when(F.col("file_id") % 11 == 0, "tree").otherwise("blob").alias("type"), "size")
    own = f.groupBy("repo_id", F.floor(F.col("file_id") / 40).alias("page")).agg(F.collect_list(entry).alias("tree"))  # forty entries at most
    return own.select("repo_id", "page", F.to_json(F.struct("tree", (F.col("page") % 9 == 0).alias("truncated"))).alias("tree_json"))


def tree_scan(spark, d):
    blobs, cut = src.from_trees(_tree_pages(spark, d))
    return blobs.join(cut, "repo_id").select("repo_id", "path", "size", "truncated")


def scan_report(spark, d):
    f = table(spark, d, "files").where("path is not null and repo_id is not null").groupBy("repo_id", "file_id").agg(F.min("path").alias("path"), F.max(F.col("content").isNotNull()).alias("has"))
    rows = f.select("repo_id", "path", F.col("file_id").alias("ord"), F.when(~F.col("has"), "no content").alias("error"))
    listed = f.groupBy("repo_id").agg((F.count("*") + F.col("repo_id") % 3).alias("files"))
    return src.scan_report(rows, listed, src.from_trees(_tree_pages(spark, d))[1])


_TREES = "tp AS (SELECT repo_id, path, max(size) AS size, min(file_id) AS file_id FROM files WHERE path IS NOT NULL AND repo_id IS NOT NULL GROUP BY ALL), tc AS (SELECT repo_id, bool_or((file_id // 40) % 9 = 0) AS truncated FROM tp GROUP BY 1)"

# ---------------------------------------------------------------- pages


def _pages(spark, d) -> DataFrame:
    f = table(spark, d, "files").where("path is not null and repo_id is not null").select("repo_id", "file_id", "path").distinct()
    base = F.substring_index("path", "/", -1)
    html = F.concat(
        F.lit('<script src="/'), "path", F.lit("\"></script><link HREF='css/"), base, F.lit(".css'><script SRC = x src=\"https://cdn.example/"), base, F.lit('"></script><a href="//c.example/'), "path", F.lit('?v=1">x</a>')
    )
    return f.select(F.concat(F.lit("https://r"), F.col("repo_id").cast("string"), F.lit(".example/d/"), F.col("file_id").cast("string"), F.lit(".html?q=/1")).alias("url"), html.alias("html"))


def html_asset_refs(spark, d):
    own = im.extract_imports(_pages(spark, d).select(F.col("url").alias("repo_id"), F.lit("index.html").alias("path"), F.col("html").alias("content")))
    return own.select(F.col("repo_id").alias("url"), F.col("pattern_no").cast("bigint").alias("pattern_no"), F.col("pos").cast("bigint").alias("pos"), "raw")


def page_asset_links(spark, d):
    own = src.page_assets(_pages(spark, d))
    return own.select("url", "asset", src.asset_path(F.col("asset")).alias("path"))


_PG = "p AS (SELECT DISTINCT 'https://r' || repo_id || '.example' AS site, 'https://r' || repo_id || '.example/d/' || file_id || '.html?q=/1' AS url, path, string_split(path, '/')[-1] AS base FROM files WHERE path IS NOT NULL AND repo_id IS NOT NULL)"
_REF = "r AS (SELECT site, url, unnest([0, 0, 1, 1]) AS pattern_no, unnest([0, 1, 0, 1]) AS pos, unnest(['/' || path, 'https://cdn.example/' || base, 'css/' || base || '.css', '//c.example/' || path || '?v=1']) AS raw FROM p)"
_ENDS = " OR ".join(f"ends_with(raw, '{e}')" for e in D.ASSET_ENDINGS)
_ABS = "CASE WHEN starts_with(raw, '/') THEN site || raw WHEN starts_with(raw, 'css/') THEN site || '/d/' || raw ELSE raw END"

# ---------------------------------------------------------------- cycles


def module_cycles(spark, d):
    """Dependencies of modules, and a third of them the other way round too, so that there are cycles of several sizes."""
    dep = metrics.module_dependencies(*_ne(spark, d))
    back = dep.where((F.length("src_module") + F.length("dst_module")) % 3 == 0).select("analysis_id", F.col("dst_module").alias("src_module"), F.col("src_module").alias("dst_module"))
    return cycles.module_cycles(dep.unionByName(back).distinct())


_CYCLES = f"""WITH RECURSIVE {_E}, {_N}, {_DEP}, dd AS (SELECT * FROM dep UNION SELECT analysis_id, dst_module, src_module FROM dep WHERE (length(src_module) + length(dst_module)) % 3 = 0),
reach AS (SELECT analysis_id, src_module AS a, dst_module AS b FROM dd UNION SELECT r.analysis_id, r.a, dd.dst_module FROM reach r JOIN dd ON dd.analysis_id = r.analysis_id AND dd.src_module = r.b),
m AS (SELECT x.analysis_id, x.a, least(min(x.b), x.a) AS root FROM reach x JOIN reach y ON y.analysis_id = x.analysis_id AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.analysis_id, x.a)
SELECT analysis_id, count(*) AS size, string_agg(a, ',' ORDER BY a) AS modules FROM m GROUP BY analysis_id, root"""

QUERIES = {f.__name__: f for f in (monorepo_detect, detected_roots, detected_modules, tsconfig_aliases, resolve_alias, resolve_any, tree_scan, scan_report, html_asset_refs, page_asset_links, module_cycles)}
ORACLES = {
    "monorepo_detect": f"WITH {_CONFIGS}, {_TOOLS}",
    "detected_roots": f"WITH {_GLOBS} SELECT repo_id, root FROM ro",
    "detected_modules": f"WITH {_GLOBS}, be AS (SELECT pf.repo_id, pf.path, arg_max(root, length(root)) AS root FROM pf JOIN ro ON ro.repo_id = pf.repo_id AND (path = root OR starts_with(path, root || '/')) GROUP BY ALL) "
    f"SELECT pf.repo_id, pf.path, coalesce(be.root, {_MODULE.replace('path', 'pf.path')}) AS module FROM pf LEFT JOIN be ON be.repo_id IS NOT DISTINCT FROM pf.repo_id AND be.path = pf.path",
    "tsconfig_aliases": f"WITH {_ALIASES} SELECT repo_id, config_path, alias_ord, alias_key, wildcard, array_to_string(targets, ',') AS targets, base_url FROM a",
    "resolve_alias": f"WITH {_ALIASES}, {_SPECS} SELECT repo_id, path, raw, rewritten FROM z",
    "resolve_any": f"WITH {_ALIASES}, {_SPECS}, b2 AS (SELECT repo_id, path, 0 AS pattern_no, pos, raw, {_BASE} AS base FROM z WHERE raw LIKE '.%' OR rewritten IS NOT NULL), k2 AS ({_CANDS.replace(' FROM b', ' FROM b2')}), "
    "t2 AS (SELECT k2.repo_id, k2.path, k2.pos, arg_min(candidate, cand_no) AS target FROM k2 JOIN (SELECT DISTINCT repo_id, path FROM files) o ON o.repo_id = k2.repo_id AND o.path = candidate GROUP BY ALL) "
    "SELECT z.repo_id, z.path, z.raw, t2.target FROM z LEFT JOIN t2 ON t2.repo_id = z.repo_id AND t2.path = z.path AND t2.pos = z.pos",
    "tree_scan": f"WITH {_TREES} SELECT repo_id, path, size, truncated FROM tp JOIN tc USING (repo_id) WHERE file_id % 11 <> 0",
    "scan_report": f"""WITH {_TREES}, sf AS (SELECT repo_id, file_id, min(path) AS path, bool_or(content IS NOT NULL) AS has FROM files WHERE path IS NOT NULL AND repo_id IS NOT NULL GROUP BY ALL),
sw AS (SELECT repo_id, path || ': no content' AS text, row_number() OVER (PARTITION BY repo_id ORDER BY file_id) AS k, count(*) OVER (PARTITION BY repo_id) AS c FROM sf WHERE NOT has),
sx AS (SELECT repo_id, string_agg(text, chr(10) ORDER BY k) || CASE WHEN any_value(c) > 5 THEN chr(10) || '+' || (any_value(c) - 5) || ' more file read errors.' ELSE '' END AS warnings FROM sw WHERE k <= 5 GROUP BY 1),
sn AS (SELECT repo_id, count(*) AS kept, count(*) + repo_id % 3 AS files FROM sf GROUP BY repo_id)
SELECT repo_id, coalesce(warnings, '') AS warnings, concat_ws(chr(10), CASE WHEN truncated THEN 'The tree was truncated.' END, CASE WHEN kept < files THEN 'Only ' || kept || ' of ' || files || ' files were read.' END) AS limitations,
  CASE WHEN truncated OR kept < files THEN 'partial' ELSE 'full' END AS quality FROM sn LEFT JOIN tc USING (repo_id) LEFT JOIN sx USING (repo_id)""",
    "html_asset_refs": f"WITH {_PG}, {_REF} SELECT url, CAST(pattern_no AS BIGINT) AS pattern_no, CAST(pos AS BIGINT) AS pos, raw FROM r",
    "page_asset_links": f"WITH {_PG}, {_REF}, q AS (SELECT DISTINCT url, {_ABS} AS asset FROM r WHERE {_ENDS}) SELECT url, asset, array_to_string(string_split(asset, '/')[4:], '/') AS path FROM q",
    "module_cycles": _CYCLES,
}
