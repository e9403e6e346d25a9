"""Structural status of nodes, and the contract that goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import dictionaries as D
from lodegraph.operators.metrics import KEY, node_degree, unique_nodes


def status(complexity: Column, degree: Column) -> Column:
    """Missing and zero complexity count as 10, missing and zero degree as 1."""
    c, d = F.coalesce(F.nullif(complexity, F.lit(0)), F.lit(10)), F.coalesce(F.nullif(degree, F.lit(0)), F.lit(1))
    return F.when((c > D.CRITICAL_COMPLEXITY) | (d > D.CRITICAL_DEGREE), "CRITICAL_GOD_MODULE").when(c > D.WARNING_COMPLEXITY, "WARNING").otherwise("STABLE")


def skill(language: Column) -> Column:
    lang = F.lower(F.coalesce(F.nullif(language, F.lit("")), F.lit("TypeScript")))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in D.SKILLS.items() for x in kv]), lang), F.lit(D.SKILL_ELSE))


def directives(status_: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in D.DIRECTIVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), status_)


def contracts(nodes: DataFrame, edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, id, language, complexity, degree, status, skill, protected, directives) of nodes of complexity above 50 or degree above 25."""
    own = unique_nodes(nodes, key).join(node_degree(edges, key).select(key, "id", "degree"), [key, "id"], "left")
    own = own.where((F.col("complexity") > D.WARNING_COMPLEXITY) | (F.col("degree") > D.HOT_DEGREE))
    st = status(F.col("complexity"), F.col("degree"))
    return own.select(
        key, "id", F.coalesce(F.nullif("language", F.lit("")), F.lit("TypeScript")).alias("language"), F.coalesce(F.nullif("complexity", F.lit(0)), F.lit(10)).alias("complexity"), F.coalesce("degree", F.lit(1)).alias("degree"),
        st.alias("status"), skill(F.col("language")).alias("skill"), F.array(F.col("label"), *map(F.lit, D.PROTECTED)).alias("protected"), directives(st).alias("directives"),
    )
