"""Differences of two graphs for many pairs of graphs at once.

pairs is (base, head) of graph keys. Compared with snapshot_diff these give the attributes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.metrics import KEY, unique_nodes


def _sided(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Each row once as the base and once as the head of the pairs its graph is in."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("base").alias(key), "base", "head", F.lit(False).alias("is_head")), F.struct(F.col("head").alias(key), "base", "head", F.lit(True).alias("is_head")))).alias("p")).select("p.*")
    return df.join(both, key)


def node_pairs(nodes: DataFrame, pairs: DataFrame, key: str = KEY) -> DataFrame:
    """(base, head, id, in_base, in_head, and of each attribute base and head): one shuffle on pair and id, no self-join."""
    own = _sided(unique_nodes(nodes, key), pairs, key)
    b = lambda c: F.max(F.when(~F.col("is_head"), F.col(c))).alias(f"{c}_base")
    h = lambda c: F.max(F.when(F.col("is_head"), F.col(c))).alias(f"{c}_head")
    cols = [f(c) for c in ("loc", "complexity", "language") for f in (b, h)]
    return own.groupBy("base", "head", "id").agg((~F.min("is_head")).alias("in_base"), F.max("is_head").alias("in_head"), *cols)


def diff_nodes(nodes: DataFrame, pairs: DataFrame, key: str = KEY) -> DataFrame:
    """(base, head, id, change): nodes only in the head are added, only in the base deleted."""
    own = node_pairs(nodes, pairs, key).where("in_base <> in_head")
    return own.select("base", "head", "id", F.when(F.col("in_head"), "added").otherwise("deleted").alias("change"))


def _modified() -> Column:
    differs = lambda c: F.coalesce(F.col(f"{c}_base") != F.col(f"{c}_head"), F.lit(False))
    return F.col("in_base") & F.col("in_head") & (differs("loc") | differs("complexity") | ~F.col("language_base").eqNullSafe(F.col("language_head")))


def diff_modified(nodes: DataFrame, pairs: DataFrame, key: str = KEY) -> DataFrame:
    """Nodes of both graphs whose loc or complexity have values that differ, or whose language differs, a missing one included."""
    own = node_pairs(nodes, pairs, key).where(_modified())
    return own.select("base", "head", "id", *[F.col(f"{c}_{s}") for c in ("loc", "complexity", "language") for s in ("base", "head")])


def diff_edges(edges: DataFrame, pairs: DataFrame, key: str = KEY) -> DataFrame:
    """(base, head, src, dst, change, edges): by source and target only; edges counts the parallel ones."""
    own = edges.where("src is not null and dst is not null").select(key, "src", "dst", "weight", "kind", "ord").distinct()
    own = own.groupBy(key, "src", "dst").agg(F.count("*").alias("n"))
    own = _sided(own, pairs, key).groupBy("base", "head", "src", "dst").agg((~F.min("is_head")).alias("in_base"), F.max("is_head").alias("in_head"), F.sum("n").alias("edges"))
    return own.where("in_base <> in_head").select("base", "head", "src", "dst", F.when(F.col("in_head"), "added").otherwise("deleted").alias("change"), "edges")


def diff_summary(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, key: str = KEY) -> DataFrame:
    """(base, head, nine counters, text): one row for each pair, also for pairs without a difference."""
    n = node_pairs(nodes, pairs, key)
    added, deleted, modified = F.col("in_head") & ~F.col("in_base"), F.col("in_base") & ~F.col("in_head"), _modified()
    zero = F.lit(0)
    delta = F.when(modified, F.coalesce(F.col("complexity_head") - F.col("complexity_base"), zero)).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), zero)
    sums = n.groupBy("base", "head").agg(
        F.count_if(added).alias("nodes_added"), F.count_if(deleted).alias("nodes_deleted"), F.count_if(modified).alias("nodes_modified"),
        total(F.when(added, F.coalesce("loc_head", zero))).alias("loc_added"), total(F.when(deleted, F.coalesce("loc_base", zero))).alias("loc_removed"),
        total(F.greatest(delta, zero)).alias("complexity_increased"), total(F.greatest(-delta, zero)).alias("complexity_decreased"),
    )
    e = diff_edges(edges, pairs, key).groupBy("base", "head").agg(total(F.when(F.col("change") == "added", F.col("edges"))).alias("edges_added"), total(F.when(F.col("change") == "deleted", F.col("edges"))).alias("edges_deleted"))
    names = ["nodes_added", "nodes_deleted", "nodes_modified", "edges_added", "edges_deleted", "loc_added", "loc_removed", "complexity_increased", "complexity_decreased"]
    own = pairs.select("base", "head").distinct().join(sums, ["base", "head"], "left").join(e, ["base", "head"], "left")
    own = own.select("base", "head", *[F.coalesce(c, zero).cast("bigint").alias(c) for c in names])
    return own.withColumn("text", summary_text())


def summary_text() -> Column:
    """The non-zero counters of nodes and edges, or `No changes`."""
    part = lambda sign, c, what: F.when(F.col(c) > 0, F.concat(F.lit(sign), F.col(c).cast("string"), F.lit(what)))
    text = F.concat_ws(", ", part("+", "nodes_added", " nodes"), part("-", "nodes_deleted", " nodes"), part("~", "nodes_modified", " nodes"), part("+", "edges_added", " edges"), part("-", "edges_deleted", " edges"))
    return F.when(text == "", "No changes").otherwise(text)
