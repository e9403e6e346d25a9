"""Assembly of the property graph of file collections: modules, files, functions, externals and their edges.

files is (repo_id, path, content). One graph for each repo_id. Content is read once for each kind of extraction and never
leaves it: nodes and edges carry no text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.lexer import FAMILY
from lodegraph.functions.paths import basename, extension, is_entrypoint, language, node_kind
from lodegraph.functions.text import complexity, line_count
from lodegraph.operators import functions as fn
from lodegraph.operators import imports as im
from lodegraph.operators import syntax
from lodegraph.operators.monorepo import assign_modules, monorepo_detect, workspace_roots
from lodegraph.session import cut


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def file_nodes(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, id, label, kind, path, grp, loc, complexity, language, entrypoint) of files and configurations."""
    p = F.col("path")
    own = files.where("path is not null").select(
        "repo_id", F.concat(F.lit("file:"), p).alias("id"), basename(p).alias("label"), node_kind(p).alias("kind"), "path", line_count(F.col("content")).alias("loc"), complexity(F.col("content")).alias("complexity"), language(p).alias("language"), is_entrypoint(p).alias("entrypoint")
    )
    # a redelivered row is the same; of one that came without content the other counts
    own = own.groupBy("repo_id", "id", "label", "kind", "path", "language", "entrypoint").agg(F.max("loc").alias("loc"), F.max("complexity").alias("complexity"))
    return own.join(modules.withColumnRenamed("module", "grp"), ["repo_id", "path"])


def module_nodes(modules: DataFrame) -> DataFrame:
    m = F.col("module")
    own = modules.select("repo_id", "module").distinct()
    return own.select("repo_id", F.concat(F.lit("mod:"), m).alias("id"), basename(m).alias("label"), F.lit("module").alias("kind"), m.alias("grp"))


def membership_edges(modules: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, src, dst, weight, kind): module to file, file to function and module to function."""
    mod, file = F.concat(F.lit("mod:"), F.col("module")), F.concat(F.lit("file:"), F.col("path"))
    rest = lambda df: df.select("repo_id", "src", "dst", F.lit(1).alias("weight"), F.lit("import").alias("kind"))
    a = rest(modules.select("repo_id", mod.alias("src"), file.alias("dst")))
    f = functions.select("repo_id", "path", F.col("id").alias("dst")).join(modules, ["repo_id", "path"])
    both = f.select("repo_id", "dst", F.explode(F.array(file, mod)).alias("src"))
    return a.unionByName(rest(both))


def _either(tree: DataFrame, pattern: DataFrame) -> DataFrame:
    """The rows of tree for the files that both have, else those of pattern."""
    at = ["repo_id", "path"]
    both = pattern.select(*at).distinct().join(tree.select(*at).distinct(), at)
    return tree.join(both, at, "left_semi").unionByName(pattern.join(both, at, "left_anti"))


def build_graph(files: DataFrame, functions: str = "pattern", function_group: str = "directory", resolve: str = "faithful", java_pattern: str = "corrected") -> Graph:
    """All nodes and edges of files.

    functions="off" leaves functions and calls out; functions="syntax" reads them, and the imports of files that have any, from the
    structure of the files instead of patterns, which serve the languages that aren't read so. function_group="module" puts functions into their module instead of their
    directory. resolve="strict" resolves aliases and leading slashes from the root. Null content gives nodes without measures.
    """
    globs = monorepo_detect(files)
    modules = cut(assign_modules(files, workspace_roots(globs, files)))  # nodes and edges both read these four
    f_nodes = file_nodes(files, modules)
    m_nodes = module_nodes(modules)
    imports = im.extract_imports(files)
    if functions == "syntax":
        imports = _either(syntax.extract_imports(files), imports)
    imports = cut(imports)
    if resolve == "strict":
        got = im.resolve_any(imports, im.aliases(files), files, strict=True)
        inner = got.where("target is not null and target <> path").select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst"))
        outer = im.external_packages(imports.join(got.where("target is not null").select("repo_id", "path", "pattern_no", "pos"), ["repo_id", "path", "pattern_no", "pos"], "left_anti"))
    else:
        inner, outer = im.resolve_imports(imports, files), im.external_packages(imports)
    outer = cut(outer)
    edge = lambda df, dst: df.select("repo_id", F.concat(F.lit("file:"), F.col("src")).alias("src"), dst.alias("dst"), F.lit(1).alias("weight"), F.lit("import").alias("kind"))
    edges = edge(inner, F.concat(F.lit("file:"), F.col("dst"))).unionByName(edge(outer, F.concat(F.lit("ext:"), F.col("package"))))
    externals = outer.select("repo_id", "package").distinct().select("repo_id", F.concat(F.lit("ext:"), F.col("package")).alias("id"), F.col("package").alias("label"), F.lit("external").alias("kind"), F.lit("external").alias("grp"))
    nodes = m_nodes.unionByName(f_nodes, allowMissingColumns=True)
    if functions != "off":
        others = files.where(~extension(F.col("path")).isin(*FAMILY)) if functions == "syntax" else files
        found, asked = fn.extract_functions(others, java_pattern), fn.extract_calls(others)
        if functions == "syntax":
            found = found.unionByName(syntax.extract_functions(files).select(*found.columns))
            asked = asked.unionByName(syntax.extract_calls(files).select(*asked.columns))
        found = cut(found)
        fnodes = fn.function_nodes(found)
        if function_group == "module":
            fnodes = fnodes.drop("grp").join(modules.withColumnRenamed("module", "grp"), ["repo_id", "path"])
        calls = fn.call_edges(fn.resolve_calls(asked, found))
        # as many edges as calls
        calls = calls.select("repo_id", "src", "dst", "weight", "kind", F.explode(F.sequence(F.lit(1), F.col("calls").cast("int")))).drop("col")
        edges = edges.unionByName(membership_edges(modules, fnodes)).unionByName(calls)
        nodes = nodes.unionByName(fnodes, allowMissingColumns=True)
    else:
        edges = edges.unionByName(membership_edges(modules, f_nodes.limit(0).select("repo_id", "path", "id")))
    nodes = nodes.unionByName(externals, allowMissingColumns=True)
    return Graph(nodes.select("repo_id", "id", "label", "kind", "path", "grp", "loc", "complexity", "language", "entrypoint"), edges)
