"""Imports of source files: extraction by pattern tables, aliases and resolution to files.

files is (repo_id, path, content); every result is keyed by repo_id, so that one run serves all repositories. Rows that are
there twice give the same result rows, which count once. Null and empty content has no imports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.functions import dictionaries as D
from lodegraph.functions.paths import basename, directory, extension, external_package, is_relative_spec, normalise

_IMPORT = "array<struct<pattern_no:int,pos:int,raw:string>>"


def _tagged(raws: Column, no: int) -> Column:
    return F.transform(raws, lambda x, i: F.struct(F.lit(no).alias("pattern_no"), i.alias("pos"), x.alias("raw")))


def _of_language(content: Column, patterns: list[str]) -> Column:
    return F.concat(*[_tagged(F.regexp_extract_all(content, F.lit(D.java(p)), F.lit(1)), n) for n, p in enumerate(patterns)])


def _of_go(content: Column) -> Column:
    single = F.regexp_extract_all(content, F.lit(D.java(D.GO_SINGLE)), F.lit(1))
    blocks = F.regexp_extract_all(content, F.lit(D.java(D.GO_BLOCK)), F.lit(1))
    inside = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(D.GO_ITEM), F.lit(1))))
    return F.concat(_tagged(single, 0), _tagged(inside, 1))


def _relative(raw: Column, rule: str) -> Column:
    if rule == "*":
        return F.lit(True)
    out = F.lit(False)
    if "." in rule:
        out = out | raw.startswith(".")
    if "/" in rule:
        out = out | raw.startswith("/")
    if "::" in rule:
        out = out | raw.contains("::")
    if "package:" in rule:
        out = out | raw.startswith("package:")
    return out


def extract_imports(files: DataFrame) -> DataFrame:
    """(repo_id, path, pattern_no, pos, raw, is_relative): patterns of the extension's language in order, then by position."""
    ext = extension(F.col("path"))
    found, relative = F.when(ext == "go", _of_go(F.col("content"))), F.when(ext == "go", _relative(F.col("raw"), "./"))
    for exts, patterns, rule in D.IMPORTS:
        found = found.when(ext.isin(*exts.split()), _of_language(F.col("content"), patterns))
        relative = relative.when(ext.isin(*exts.split()), _relative(F.col("raw"), rule))
    own = files.where("content is not null and content <> ''").select("repo_id", "path", F.explode(found.cast(_IMPORT)).alias("i")).select("repo_id", "path", "i.*")
    own = own.withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("raw <> ''")
    return own.select("repo_id", "path", "pattern_no", "pos", "raw", relative.alias("is_relative")).distinct()


def first_imports(imports: DataFrame) -> DataFrame:
    """(repo_id, path, raw, is_relative, no): each spec of a file once, numbered by its first place, relative by its form alone."""
    one = imports.groupBy("repo_id", "path", "raw").agg(F.min(F.struct("pattern_no", "pos")).alias("at"))
    no = F.row_number().over(W.partitionBy("repo_id", "path").orderBy("at")) - 1
    return one.select("repo_id", "path", "raw", is_relative_spec(F.col("raw")).alias("is_relative"), no.alias("no"))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with target: the first of the candidate paths that is a file of the repository, null without one."""
    base = normalise(F.concat_ws("/", directory(F.col("path")), F.col("raw")))
    tries = imports.withColumn("import_id", F.xxhash64("repo_id", "path", "pattern_no", "pos")).where(F.col("raw").startswith(".") | F.col("raw").startswith("/"))
    tries = tries.select("repo_id", "path", "pattern_no", "pos", "raw", base.alias("base"))
    many = tries.select("*", F.posexplode(F.array(*[F.concat("base", F.lit(c)) for c in D.CANDIDATES])).alias("cand_no", "candidate"))
    known = files.select("repo_id", F.col("path").alias("candidate")).distinct()
    hits = many.join(known, ["repo_id", "candidate"]).groupBy("repo_id", "path", "pattern_no", "pos").agg(F.min_by("candidate", "cand_no").alias("target"))
    return imports.join(hits, ["repo_id", "path", "pattern_no", "pos"], "left")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, src, dst) of the imports that lead to another file of the repository, one row for each import."""
    own = resolve_relative(imports.where("is_relative"), files)
    return own.where("target is not null and target <> path").select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst"), "pattern_no", "pos")


def external_packages(imports: DataFrame) -> DataFrame:
    """(repo_id, src, package) of the imports that aren't relative, one row for each import."""
    own = imports.where("not is_relative").select("repo_id", F.col("path").alias("src"), external_package(F.col("raw")).alias("package"), "pattern_no", "pos")
    return own.where("package <> ''")


_TSCONFIG = "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>"


def aliases(files: DataFrame) -> DataFrame:
    """(repo_id, config_path, alias_ord, alias_key, wildcard, targets, base_url) of path aliases in TypeScript configurations.

    JSON with comments or other faults has none. The order is that of the keys in the file.
    """
    name = F.lower(basename(F.col("path")))
    own = files.where(((name == "tsconfig.json") | name.rlike(r"^tsconfig\..+\.json$")) & F.col("content").isNotNull())
    parsed = F.from_json("content", _TSCONFIG, {"mode": "PERMISSIVE"})
    own = own.select("repo_id", F.col("path").alias("config_path"), parsed.alias("c")).where("c.compilerOptions.paths is not null")
    at = directory(F.col("config_path"))
    base = F.when(F.length("c.compilerOptions.baseUrl") > 0, F.concat_ws("/", at, F.col("c.compilerOptions.baseUrl"))).otherwise(at)
    own = own.select("repo_id", "config_path", normalise(base).alias("base_url"), F.posexplode(F.map_entries("c.compilerOptions.paths")).alias("alias_ord", "e")).where("e.value is not null")
    bare = lambda x: F.regexp_replace(x, r"\*$", "")
    targets = F.filter(F.transform("e.value", lambda t: normalise(F.concat_ws("/", F.col("base_url"), bare(t)))), lambda t: t != "")
    return own.select("repo_id", "config_path", "alias_ord", bare(F.col("e.key")).alias("alias_key"), F.col("e.key").contains("*").alias("wildcard"), targets.alias("targets"), "base_url").distinct()


def rewrite_aliases(imports: DataFrame, alias: DataFrame) -> DataFrame:
    """imports with rewritten: the first alias in order of file and key that matches the spec, null without one.

    Aliases of a repository are few; they meet the imports on repo_id and the alias's first character.
    """
    spec = imports.where("not (raw like '.%' or raw like '/%')").withColumn("head", F.substring("raw", 1, 1))
    a = alias.withColumn("head", F.substring("alias_key", 1, 1)).withColumn("any", F.length("alias_key") == 0)
    a = a.withColumn("alias_no", F.row_number().over(W.partitionBy("repo_id").orderBy("config_path", "alias_ord")))
    both = spec.join(a, (spec["repo_id"] == a["repo_id"]) & ((spec["head"] == a["head"]) | a["any"])).drop(a["repo_id"]).drop(a["head"])
    exact = ~F.col("wildcard") & (F.col("raw") == F.col("alias_key"))
    rest = F.substring("raw", F.length("alias_key") + 1, F.length("raw"))
    first = F.when(F.size("targets") > 0, F.col("targets")[0])
    wild = F.col("wildcard") & F.col("raw").startswith(F.col("alias_key")) & first.isNotNull()
    new = F.when(exact, F.coalesce(first, F.lit(""))).when(F.length(rest) > 0, F.concat_ws("/", first, rest)).otherwise(first)
    hit = both.where(exact | wild).groupBy("repo_id", "path", "pattern_no", "pos").agg(F.min_by(new, "alias_no").alias("rewritten"))
    return imports.join(hit, ["repo_id", "path", "pattern_no", "pos"], "left")


def resolve_any(imports: DataFrame, alias: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """imports with target: relative specs as they are, others through their alias.

    An alias's result is looked up below the importer's directory, as is a leading slash; strict looks both up from the root.
    """
    own = rewrite_aliases(imports, alias)
    spec = F.when(F.col("raw").startswith(".") | F.col("raw").startswith("/"), F.col("raw")).otherwise(F.concat(F.lit("/"), F.col("rewritten")))
    own = own.withColumn("spec", spec).withColumnRenamed("raw", "raw_spec")
    from_root = own.select("repo_id", F.when(F.col("spec").startswith("/"), F.lit("root")).otherwise(F.col("path")).alias("path"), "pattern_no", "pos", F.col("spec").alias("raw"), F.col("path").alias("importer"))
    ask = from_root if strict else own.select("repo_id", "path", "pattern_no", "pos", F.col("spec").alias("raw"), F.col("path").alias("importer"))
    ask = ask.where("raw is not null").withColumn("key", F.xxhash64("importer", "pattern_no", "pos"))
    got = _resolved(ask, files)
    return own.join(got, (own["repo_id"] == got["r"]) & (own["path"] == got["i"]) & (own["pattern_no"] == got["n"]) & (own["pos"] == got["p"]), "left").select(
        own["repo_id"], own["path"], own["pattern_no"], own["pos"], own["raw_spec"].alias("raw"), "is_relative", "rewritten", "target"
    )


def _resolved(ask: DataFrame, files: DataFrame) -> DataFrame:
    base = normalise(F.concat_ws("/", directory(F.col("path")), F.col("raw")))
    many = ask.select("repo_id", "importer", "pattern_no", "pos", F.posexplode(F.array(*[F.concat(base, F.lit(c)) for c in D.CANDIDATES])).alias("cand_no", "candidate"))
    known = files.select("repo_id", F.col("path").alias("candidate")).distinct()
    hits = many.join(known, ["repo_id", "candidate"]).groupBy("repo_id", "importer", "pattern_no", "pos").agg(F.min_by("candidate", "cand_no").alias("target"))
    return hits.select(F.col("repo_id").alias("r"), F.col("importer").alias("i"), F.col("pattern_no").alias("n"), F.col("pos").alias("p"), "target")
