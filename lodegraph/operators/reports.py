"""Reports of graph metrics: JSON, text, Markdown and the data of a drawn graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.metrics import KEY


def _listed(df: DataFrame, key: str, line: Column, name: str) -> DataFrame:
    """The lines of a top list, at most a handful for a key, in order of rank."""
    own = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return own.select(key, F.array_join(F.col("x.line"), "\n").alias(name))


def text_report(metrics: DataFrame, top: DataFrame, hot: DataFrame, key: str = KEY, markdown: bool = False) -> DataFrame:
    """(key, report): overview, top connections and hotspots. A graph without either list has its heading only."""
    names = [("Nodes", "nodes"), ("Edges", "edges"), ("Modules", "modules"), ("Files", "files"), ("Max Complexity", "max_complexity")]
    row = (lambda a, c: F.concat(F.lit(f"| {a} | "), F.col(c).cast("string"), F.lit(" |"))) if markdown else (lambda a, c: F.concat(F.lit(f"- {a}: "), F.col(c).cast("string")))
    label = F.concat(F.lit("- **"), F.col("label"), F.lit("**: ")) if markdown else F.concat(F.lit("- "), F.col("label"), F.lit(": "))
    cx = F.lit("Complexity ")
    t = _listed(top, key, F.concat(label, F.col("degree").cast("string")), "top")
    h = _listed(hot, key, F.concat(label, cx, F.col("complexity").cast("string")), "hot")
    own = metrics.join(t, key, "left").join(h, key, "left")
    head = ["# Analysis Report", "", "## Overview", "", "| Metric | Value |", "|---|---|"] if markdown else ["Analysis Report", "===============", "", "Overview:"]
    sections = ("## Top Connections\n", "## Hotspots\n") if markdown else ("Top Connections:", "Hotspots:")
    parts = [*map(F.lit, head), *[row(a, c) for a, c in names], F.lit(""), F.lit(sections[0]), F.coalesce("top", F.lit("")), F.lit(""), F.lit(sections[1]), F.coalesce("hot", F.lit(""))]
    return own.select(key, F.concat_ws("\n", *parts).alias("report"))


def json_report(metrics: DataFrame, key: str = KEY) -> DataFrame:
    """(key, json): the metrics row as JSON."""
    cols = [c for c in metrics.columns if c != key]
    return metrics.select(key, F.to_json(F.struct(*cols)).alias("json"))


def drawn_nodes(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """(key, id, label, group): the label is the id's last segment, the group its kind."""
    return nodes.where("id is not null").select(key, "id", F.substring_index("id", "/", -1).alias("label"), F.col("kind").alias("group")).distinct()


def drawn_edges(edges: DataFrame, key: str = KEY) -> DataFrame:
    """(key, from, to, title)."""
    return edges.where("src is not null and dst is not null").select(key, F.col("src").alias("from"), F.col("dst").alias("to"), F.col("kind").alias("title"), "ord").distinct()


# a layout by forces: neighbours attract, all nodes repel, drawn once
_DRAW = """
const g = document.getElementById("g"), c = g.getContext("2d"), at = new Map(), color = {module: "#4269d0", file: "#3ca951", function: "#efb118", external: "#ff725c", config: "#a463f2"};
g.width = innerWidth; g.height = innerHeight;
data.nodes.forEach((n, i) => at.set(n.id, {x: g.width / 2 + 20 * Math.sqrt(i) * Math.cos(2.4 * i), y: g.height / 2 + 20 * Math.sqrt(i) * Math.sin(2.4 * i), n}));
const ps = [...at.values()], ls = data.edges.map(e => [at.get(e.from), at.get(e.to)]).filter(l => l[0] && l[1]);
for (let step = 0; step < 120; step++) {
  for (const p of ps) for (const q of ps) if (p !== q) { const x = p.x - q.x, y = p.y - q.y, d = x * x + y * y + 9; p.x += 90 * x / d; p.y += 90 * y / d; }
  for (const [p, q] of ls) { const x = (q.x - p.x) / 40, y = (q.y - p.y) / 40; p.x += x; p.y += y; q.x -= x; q.y -= y; }
}
c.strokeStyle = "#ccc"; for (const [p, q] of ls) { c.beginPath(); c.moveTo(p.x, p.y); c.lineTo(q.x, q.y); c.stroke(); }
c.font = "10px sans-serif"; for (const p of ps) { c.fillStyle = color[p.n.group] || "#888"; c.beginPath(); c.arc(p.x, p.y, 4, 0, 7); c.fill(); c.fillStyle = "#222"; c.fillText(p.n.label ?? p.n.id, p.x + 6, p.y + 3); }
"""


def html_page(nodes: DataFrame, edges: DataFrame, limit: int) -> str:
    """A page that draws one graph: at most limit nodes, and the edges between them, which say so where there are more.

    nodes is what drawn_nodes gives, edges what drawn_edges gives; the limit is what a page can show and bounds what the driver takes.
    """
    import json

    kept = nodes.orderBy("id").limit(limit)
    n = [r.asDict() for r in kept.collect()]
    e: list[dict] = []
    if {"from", "to"} <= set(edges.columns):
        ids = kept.select("id")
        inner = edges.join(ids.withColumnRenamed("id", "from"), "from").join(ids.withColumnRenamed("id", "to"), "to")
        e = [r.asDict() for r in inner.select("from", "to", *[c for c in edges.columns if c not in ("from", "to")]).limit(limit * 20).collect()]
    left_out = nodes.count() - len(n), edges.count() - len(e)
    note = f"{len(n)} nodes, {len(e)} edges; {left_out[0]} nodes and {left_out[1]} edges are not shown"
    data = json.dumps({"nodes": n, "edges": e}, default=str).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>Graph</title><p>{note}</p><canvas id=g></canvas><script>const data = {data};{_DRAW}</script>"


def warning_rollup(warnings: DataFrame, key: str = "repo_id", kept: int = 5) -> DataFrame:
    """(key, warnings): the first warnings (key, ord, text) of a key and, beyond them, how many more there are."""
    from pyspark.sql.window import Window as W

    w = warnings.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("ord")))
    first = w.where(F.col("_n") <= kept).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("x"))
    n = warnings.groupBy(key).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > kept, F.array(F.concat(F.lit("+"), (F.col("n") - kept).cast("string"), F.lit(" more file read errors.")))).otherwise(F.array().cast("array<string>"))
    return first.join(n, key).select(key, F.array_join(F.concat(F.col("x.text"), more), "\n").alias("warnings"))
