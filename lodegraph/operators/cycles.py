"""Cycles: strongly connected components of more than one module.

Small graphs go through one linear pass for each key. A graph of more edges than LOCAL_EDGES is solved by rounds of DataFrame
steps instead: vertices without a way in or out are dropped, the greatest reachable label is spread forward, and each label's
own component is what reaches it backward within its colour.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut

LOCAL_EDGES = 100_000


def components(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """The strongly connected components of more than one vertex, members sorted; iterative, linear in the edges."""
    out: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for root in out:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            v, it = stack[-1]
            for w in it:
                if w not in seen:
                    seen.add(w)
                    stack.append((w, iter(out[w])))
                    break
            else:
                order.append(v)
                stack.pop()
    found, done = [], set()
    for root in reversed(order):
        if root in done:
            continue
        done.add(root)
        members, todo = [root], [root]
        while todo:
            for w in back.get(todo.pop(), ()):
                if w not in done:
                    done.add(w)
                    members.append(w)
                    todo.append(w)
        if len(members) > 1:
            found.append(sorted(members))
    return sorted(found)


def _spread(edges: DataFrame) -> DataFrame:
    """(key, v, label): the greatest vertex that reaches v."""
    labels = cut(edges.select("k", F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("label", F.col("v")))
    while True:
        step = edges.join(labels.withColumnRenamed("v", "src"), ["k", "src"]).select("k", F.col("dst").alias("v"), "label")
        new = cut(labels.unionByName(step).groupBy("k", "v").agg(F.max("label").alias("label")))
        if new.exceptAll(labels).isEmpty():
            return new
        labels = new


def _distributed(edges: DataFrame) -> DataFrame:
    """(k, member, root) of all components of more than one vertex."""
    found = None
    edges = cut(edges.where("src <> dst").distinct())
    while not edges.isEmpty():
        while True:  # drop what has no way in or no way out
            n = edges.count()
            into, out = edges.select("k", F.col("dst").alias("v")).distinct(), edges.select("k", F.col("src").alias("v")).distinct()
            core = into.intersect(out)
            edges = cut(edges.join(core.withColumnRenamed("v", "src"), ["k", "src"]).join(core.withColumnRenamed("v", "dst"), ["k", "dst"]).select("k", "src", "dst"))
            if edges.count() == n:
                break
        if edges.isEmpty():
            break
        colour = _spread(edges)
        a, b = colour.select("k", F.col("v").alias("src"), F.col("label").alias("ca")), colour.select("k", F.col("v").alias("dst"), F.col("label").alias("cb"))
        inside = cut(edges.join(a, ["k", "src"]).join(b, ["k", "dst"]).where("ca = cb").select("k", "src", "dst", F.col("ca").alias("root")))
        reach = cut(colour.where("v = label").select("k", F.col("v").alias("member"), F.col("label").alias("root")))
        while True:
            more = inside.join(reach.withColumnRenamed("member", "dst"), ["k", "root", "dst"]).select("k", F.col("src").alias("member"), "root")
            new = cut(reach.unionByName(more).distinct())
            if new.count() == reach.count():
                break
            reach = new
        big = reach.groupBy("k", "root").agg(F.count("*").alias("n")).where("n > 1").select("k", "root")
        own = cut(reach.join(big, ["k", "root"]))
        found = own if found is None else cut(found.unionByName(own))
        gone = reach.select("k", F.col("member").alias("v"))
        edges = cut(edges.join(gone.withColumnRenamed("v", "src"), ["k", "src"], "left_anti").join(gone.withColumnRenamed("v", "dst"), ["k", "dst"], "left_anti"))
    return found


def module_cycles(pairs: DataFrame, key: str = "analysis_id", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(key, size, modules): modules is the comma-separated sorted list of a component's members."""
    spark = pairs.sparkSession
    own = cut(pairs.select(F.col(key).alias("k"), F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).where("src is not null and dst is not null").distinct())
    kind = own.schema["k"].dataType.simpleString()
    large = own.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > local_edges).select("k")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = components(list(zip(pdf["src"], pdf["dst"])))
        # object columns, as an empty list of strings has no type of its own
        return pd.DataFrame({"k": pd.Series([pdf["k"].iloc[0]] * len(got), dtype=pdf["k"].dtype), "size": pd.Series([len(x) for x in got], dtype="int64"), "modules": pd.Series([",".join(x) for x in got], dtype=object)})

    small = own.join(large, "k", "left_anti").groupBy("k").applyInPandas(one, f"k {kind}, size bigint, modules string")
    far = _distributed(own.join(large, "k", "left_semi"))
    if far is not None:
        far = far.groupBy("k", "root").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("member")), ",").alias("modules")).select("k", "size", "modules")
        small = small.unionByName(far)
    return small.select(F.col("k").alias(key), "size", "modules")
