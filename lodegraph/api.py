"""The whole analysis in one call: files in, graph, metrics and report out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import contracts, cycles, metrics, reports
from lodegraph.operators.graph import build_graph
from lodegraph.session import cut, shared_dir

KEY = "repo_id"


class Analysis(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame
    top: DataFrame
    hotspots: DataFrame
    languages: DataFrame
    modules: DataFrame
    cycles: DataFrame
    gods: DataFrame
    contracts: DataFrame
    quality: DataFrame


def analyze(files: DataFrame, **options) -> Analysis:
    """One analysis for each repo_id of files (repo_id, path, content). Options are those of build_graph.

    Nodes and edges are written once to the shared folder, as every metric reads them; edges get an order of their own.
    """
    g = build_graph(files, **options)
    nodes = cut(g.nodes)
    edges = cut(g.edges.withColumn("ord", F.monotonically_increasing_id()))
    mm = metrics.module_metrics(nodes, edges, KEY)
    return Analysis(
        nodes, edges, metrics.graph_metrics(nodes, edges, KEY), metrics.top_by_degree(nodes, edges, KEY), metrics.hotspots(nodes, KEY), metrics.language_histogram(nodes, KEY), mm,
        cycles.module_cycles(metrics.module_dependencies(nodes, edges, KEY), KEY), metrics.god_modules(mm, KEY), contracts.contracts(nodes, edges, KEY), quality_of(files),
    )


def quality_of(files: DataFrame) -> DataFrame:
    """(repo_id, quality, warnings): `partial` where a file's content is missing, with a warning for each of the first such files."""
    one = files.where("path is not null").groupBy(KEY, "path").agg(F.max(F.col("content").isNotNull()).alias("has"))
    lost = one.where("not has").select(KEY, F.xxhash64("path").alias("ord"), F.concat(F.lit("Could not read "), "path").alias("text"))
    own = one.groupBy(KEY).agg(F.when(F.min("has"), "full").otherwise("partial").alias("quality"))
    return own.join(reports.warning_rollup(lost, KEY), KEY, "left").select(KEY, "quality", F.coalesce("warnings", F.lit("")).alias("warnings"))


def status_of(quality: Column) -> Column:
    """`success` for full quality, else `partial`; null quality is an `error`."""
    return F.when(quality == "full", "success").when(quality.isNull(), "error").otherwise("partial")


def response(a: Analysis) -> DataFrame:
    """(repo_id, json): status, quality, warnings, counts, top connections, hotspots, languages, cycles and oversized modules of each repository.

    Nodes and edges are in response_lines: a repository's are no single row's work.
    """
    listed = lambda df, name: df.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != KEY]))).alias(name))
    q = a.quality.select(KEY, status_of(F.col("quality")).alias("status"), "quality", F.filter(F.split("warnings", "\n"), lambda x: x != "").alias("warnings"))
    own = a.metrics.join(q, KEY, "left")
    for df, name in ((a.top, "top_by_degree"), (a.hotspots, "hotspots"), (a.languages, "languages"), (a.cycles, "cycles"), (a.gods, "god_modules")):
        own = own.join(listed(df, name), KEY, "left")
    return reports.json_report(own, KEY)


def response_lines(a: Analysis) -> DataFrame:
    """(repo_id, part, json): the whole response as lines of JSON: one `summary`, and one `node` or `edge` for each of the graph's."""
    line = lambda df, part: df.select(KEY, F.lit(part).alias("part"), F.to_json(F.struct(*[c for c in df.columns if c != KEY])).alias("json"))
    return response(a).select(KEY, F.lit("summary").alias("part"), "json").unionByName(line(a.nodes, "node")).unionByName(line(a.edges, "edge"))


def remember(spark: SparkSession, a: Analysis, name: str) -> str:
    """Writes nodes, edges and metrics below the shared folder, where the next session finds them; gives the folder."""
    at = f"{shared_dir(spark).rstrip('/')}/analyses/{name}"
    for part in ("nodes", "edges", "metrics"):
        getattr(a, part).write.mode("overwrite").parquet(f"{at}/{part}")
    return at
