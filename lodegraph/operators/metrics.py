"""Metrics of property graphs, one graph for each value of a key (analysis_id or repo_id).

nodes is (key, id, label, kind, path, grp, loc, complexity, language), edges (key, src, dst, weight, kind, ord). Exact duplicate
rows count once; edges that differ in kind or order are several. Edges may end at ids that are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.functions.dictionaries import TOP
from lodegraph.functions.text import round_half_up

KEY = "analysis_id"
_ND = ["id", "label", "kind", "path", "grp", "loc", "complexity", "language"]
_ED = ["src", "dst", "weight", "kind", "ord"]


def unique_nodes(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """One row for a key and id; of rows that differ the greatest values, null where all are null."""
    return nodes.where("id is not null").groupBy(key, "id").agg(*[F.max(c).alias(c) for c in _ND if c != "id"])


def unique_edges(edges: DataFrame, key: str = KEY) -> DataFrame:
    return edges.where("src is not null and dst is not null").select(key, *_ED).distinct()


def with_externals(nodes: DataFrame, edges: DataFrame, externals: DataFrame, key: str = KEY) -> DataFrame:
    """nodes and the external packages that each graph's edges lead to, in the group `external`."""
    used = edges.select(key, F.col("dst").alias("id")).distinct().join(externals.where("id is not null").groupBy("id").agg(F.max("label").alias("label")), "id")
    own = nodes.select(key, *_ND)
    none = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
    return own.unionByName(used.select(key, "id", "label", F.lit("external").alias("kind"), none("path"), F.lit("external").alias("grp"), none("loc"), none("complexity"), none("language")))


def node_degree(edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, id, degree, first_seen): one for each end of each edge, two for a loop; first_seen orders ends by edge, source first."""
    e = unique_edges(edges, key)
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), (2 * F.col("ord")).alias("at")), F.struct(F.col("dst").alias("id"), (2 * F.col("ord") + 1).alias("at"))))
    return e.select(key, ends.alias("e")).groupBy(key, F.col("e.id").alias("id")).agg(F.count("*").alias("degree"), F.min("e.at").alias("first_seen"))


def node_kind_counts(nodes: DataFrame, key: str = KEY) -> DataFrame:
    own = unique_nodes(nodes, key)
    return own.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k + "s") for k in ("module", "file", "function", "external", "config")])


def graph_metrics(nodes: DataFrame, edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, nodes, edges, modules, files, functions, externals, avg_degree, density, max_complexity); files are without configs."""
    n = unique_nodes(nodes, key).groupBy(key).agg(
        F.count("*").alias("nodes"), *[F.count_if(F.col("kind") == k).alias(k + "s") for k in ("module", "file", "function", "external")], F.greatest(F.coalesce(F.max("complexity"), F.lit(0)), F.lit(0)).alias("max_complexity")
    )
    e = unique_edges(edges, key).groupBy(key).agg(F.count("*").alias("edges"))
    own = n.join(e, key, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    avg = F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0)
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return own.select(key, "nodes", "edges", "modules", "files", "functions", "externals", round_half_up(avg, 2).alias("avg_degree"), round_half_up(density, 4).alias("density"), "max_complexity")


def top_by_degree(nodes: DataFrame, edges: DataFrame, key: str = KEY, k: int = TOP) -> DataFrame:
    """(key, rank, id, label, degree): the k greatest degrees of each graph; ties by first appearance; an unknown id is its own label."""
    w = W.partitionBy(key).orderBy(F.desc("degree"), "first_seen", "id")
    top = node_degree(edges, key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    labels = unique_nodes(nodes, key).select(key, "id", "label")
    return top.join(labels, [key, "id"], "left").select(key, "rank", "id", F.coalesce("label", "id").alias("label"), "degree")


def hotspots(nodes: DataFrame, key: str = KEY, k: int = TOP) -> DataFrame:
    """(key, rank, id, label, complexity): the k greatest positive complexities of each graph; ties by id."""
    w = W.partitionBy(key).orderBy(F.desc("complexity"), "id")
    own = unique_nodes(nodes, key).where("complexity > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return own.select(key, "rank", "id", "label", "complexity")


def edge_weights(edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, src, dst, kind, weight): parallel edges added up."""
    return unique_edges(edges, key).groupBy(key, "src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def labelled_edges(nodes: DataFrame, edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, src, dst, kind, ord, src_label, dst_label): ids without a node are their own labels."""
    n = unique_nodes(nodes, key).select(key, "id", "label")
    a, b = n.select(key, F.col("id").alias("src"), F.col("label").alias("a")), n.select(key, F.col("id").alias("dst"), F.col("label").alias("b"))
    own = unique_edges(edges, key).join(a, [key, "src"], "left").join(b, [key, "dst"], "left")
    return own.select(key, "src", "dst", "kind", "ord", F.coalesce("a", "src").alias("src_label"), F.coalesce("b", "dst").alias("dst_label"))


def module_dependencies(nodes: DataFrame, edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, src_module, dst_module): distinct pairs of groups of nodes that an edge joins, without those within a group."""
    own = nodes.where("id is not null and grp is not null and grp <> ''").groupBy(key, "id").agg(F.max("grp").alias("grp"))
    pairs = edges.where("src is not null and dst is not null").select(key, "src", "dst").distinct()
    a, b = own.select(key, F.col("id").alias("src"), F.col("grp").alias("src_module")), own.select(key, F.col("id").alias("dst"), F.col("grp").alias("dst_module"))
    return pairs.join(a, [key, "src"]).join(b, [key, "dst"]).where("src_module <> dst_module").select(key, "src_module", "dst_module").distinct()


def module_coupling(nodes: DataFrame, edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, module, ca, ce): distinct groups that depend on a module and that it depends on; groups that are no modules count too."""
    modules = nodes.where("kind = 'module' and grp is not null").select(key, F.col("grp").alias("module")).distinct()
    # both directions from one pass over the pairs
    side = F.explode(F.array(F.struct(F.col("src_module").alias("m"), F.lit(1).alias("ce"), F.lit(0).alias("ca")), F.struct(F.col("dst_module").alias("m"), F.lit(0).alias("ce"), F.lit(1).alias("ca"))))
    sums = module_dependencies(nodes, edges, key).select(key, side.alias("s")).groupBy(key, F.col("s.m").alias("module")).agg(F.sum("s.ca").alias("ca"), F.sum("s.ce").alias("ce"))
    return modules.join(sums, [key, "module"], "left").select(key, "module", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))


def module_metrics(nodes: DataFrame, edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, module, ca, ce, instability, abstractness, distance, total_complexity), rounded half up to three places at the end."""
    n = unique_nodes(nodes, key)
    types = F.col("kind").isin("file", "function")
    label = F.lower("label")
    own = n.where("grp is not null").groupBy(key, F.col("grp").alias("module")).agg(
        F.count_if(types).alias("types"), F.count_if(types & (label.startswith("abstract") | label.startswith("interface") | label.startswith("i"))).alias("abstracts"), F.sum(F.coalesce("complexity", F.lit(0))).alias("total_complexity")
    )
    m = module_coupling(nodes, edges, key).join(own, [key, "module"], "left")
    i = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    a = F.when(F.col("types") > 0, F.col("abstracts") / F.col("types")).otherwise(0.0)
    return m.select(
        key, "module", "ca", "ce", round_half_up(i, 3).alias("instability"), round_half_up(a, 3).alias("abstractness"), round_half_up(F.abs(a + i - 1), 3).alias("distance"), F.coalesce("total_complexity", F.lit(0)).alias("total_complexity")
    )


def ranked_modules(metrics: DataFrame, key: str = KEY) -> DataFrame:
    """module_metrics with rank, by falling rounded instability, then by name."""
    return metrics.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("instability"), "module")))


def god_modules(metrics: DataFrame, key: str = KEY, share: float = 0.75, documented: bool = False) -> DataFrame:
    """(key, module) of modules at or above the threshold in two of ca, ce and total_complexity; none in graphs of fewer than three modules.

    The threshold is the value at index floor(share * n) of the descending list; documented takes the ascending one and asks for more than it.
    """
    own = metrics
    n = F.count("*").over(W.partitionBy(key))
    at = F.floor(n * share).cast("int") + 1
    flags = F.lit(0)
    own = own.withColumn("n", n).withColumn("at", at)
    for c in ("ca", "ce", "total_complexity"):
        order = F.col(c) if documented else F.desc(c)
        own = own.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order)))
        own = own.withColumn(f"t_{c}", F.max(F.when(F.col("_r") == F.col("at"), F.col(c))).over(W.partitionBy(key)))
        flags = flags + (F.col(c) > F.col(f"t_{c}") if documented else F.col(c) >= F.col(f"t_{c}")).cast("int")
    return own.where((F.col("n") >= 3) & (flags >= 2)).select(key, "module")


def ego_network(nodes: DataFrame, edges: DataFrame, path: str, key: str = KEY) -> DataFrame:
    """(key, id, direction, other, kind, ord): the edges of the nodes at a path, out and in; a loop has both."""
    ids = nodes.where((F.col("path") == path) & (F.col("kind") != "function")).select(key, "id").distinct()
    e = unique_edges(edges, key)
    out = e.join(ids, (e[key] == ids[key]) & (e["src"] == ids["id"])).select(e[key], "id", F.lit("out").alias("direction"), F.col("dst").alias("other"), "kind", "ord")
    into = e.join(ids, (e[key] == ids[key]) & (e["dst"] == ids["id"])).select(e[key], "id", F.lit("in").alias("direction"), F.col("src").alias("other"), "kind", "ord")
    return out.unionByName(into)


def language_histogram(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """(key, language, files) over files and configurations with a language."""
    own = unique_nodes(nodes, key).where("kind in ('file', 'config') and language is not null")
    return own.groupBy(key, "language").agg(F.count("*").alias("files"))
