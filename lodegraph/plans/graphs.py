"""Queries over the graphs of analyses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import contracts, diff, metrics, reports, search
from lodegraph.operators.snapshot_diff import lineages
from lodegraph.session import table


def _ne(spark, d) -> tuple[DataFrame, DataFrame]:
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    return metrics.with_externals(n, e, table(spark, d, "externals")), e


def _pairs(spark, d) -> DataFrame:
    return lineages(table(spark, d, "analyses")).where("prev_id is not null").select(F.col("prev_id").alias("base"), F.col("snapshot_id").alias("head"))


def node_kind_counts(spark, d):
    return metrics.node_kind_counts(_ne(spark, d)[0])


def node_degree(spark, d):
    return metrics.node_degree(_ne(spark, d)[1]).select("analysis_id", "id", "degree")


def graph_density(spark, d):
    return metrics.graph_metrics(*_ne(spark, d))


def top_by_degree(spark, d):
    return metrics.top_by_degree(*_ne(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


def hotspots(spark, d):
    return metrics.hotspots(_ne(spark, d)[0]).select("analysis_id", F.col("rank").cast("bigint").alias("rank"), "id", "label", F.col("complexity").cast("bigint").alias("complexity"))


def language_histogram(spark, d):
    return metrics.language_histogram(table(spark, d, "nodes"))


def edge_weights(spark, d):
    return metrics.edge_weights(table(spark, d, "edges"))


def edge_labels(spark, d):
    return metrics.labelled_edges(*_ne(spark, d))


def module_dependencies(spark, d):
    return metrics.module_dependencies(*_ne(spark, d))


def module_coupling(spark, d):
    own = metrics.module_coupling(*_ne(spark, d))
    return own.select("analysis_id", "module", F.col("ca").cast("bigint").alias("ca"), F.col("ce").cast("bigint").alias("ce"))


def module_metrics(spark, d):
    return metrics.module_metrics(*_ne(spark, d))


def god_modules(spark, d):
    return metrics.god_modules(metrics.module_metrics(*_ne(spark, d)))


def ego_network(spark, d):
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    path = n.where("kind = 'file'").agg(F.min("path").alias("p")).first()["p"]  # one value
    return metrics.ego_network(n, e, path or "")


def hotspot_contracts(spark, d):
    own = contracts.contracts(*_ne(spark, d))
    return own.select("analysis_id", "id", "language", F.col("complexity").cast("bigint").alias("complexity"), "degree", "status", "skill")


def contract_severity(spark, d):
    own = metrics.unique_nodes(table(spark, d, "nodes")).select("analysis_id", "id", contracts.status(F.col("complexity"), F.lit(None).cast("int")).alias("status"), contracts.skill(F.col("language")).alias("skill"))
    return own


def diff_nodes(spark, d):
    return diff.diff_nodes(table(spark, d, "nodes"), _pairs(spark, d))


def diff_modified(spark, d):
    own = diff.diff_modified(table(spark, d, "nodes"), _pairs(spark, d))
    return own.select("base", "head", "id", *[F.col(f"{c}_{s}").cast("bigint").alias(f"{c}_{s}") for c in ("loc", "complexity") for s in ("base", "head")], "language_base", "language_head")


def diff_edges(spark, d):
    return diff.diff_edges(table(spark, d, "edges"), _pairs(spark, d))


def diff_summary(spark, d):
    return diff.diff_summary(table(spark, d, "nodes"), table(spark, d, "edges"), _pairs(spark, d))


def report_text(spark, d):
    n, e = _ne(spark, d)
    return reports.text_report(metrics.graph_metrics(n, e), metrics.top_by_degree(n, e), metrics.hotspots(n))


def report_markdown(spark, d):
    n, e = _ne(spark, d)
    return reports.text_report(metrics.graph_metrics(n, e), metrics.top_by_degree(n, e), metrics.hotspots(n), markdown=True)


_METRICS = "nodes bigint, edges bigint, modules bigint, files bigint, functions bigint, externals bigint, avg_degree double, density double, max_complexity bigint"


def report_json(spark, d):
    """The JSON report, read back into its fields."""
    own = reports.json_report(metrics.graph_metrics(*_ne(spark, d)))
    return own.select("analysis_id", F.from_json("json", _METRICS).alias("j")).select("analysis_id", "j.*")


def module_order(spark, d):
    return metrics.ranked_modules(metrics.module_metrics(*_ne(spark, d))).select("analysis_id", "module", F.col("rank").cast("bigint").alias("rank"))


def drawn_nodes(spark, d):
    return reports.drawn_nodes(table(spark, d, "nodes"))


def drawn_edges(spark, d):
    return reports.drawn_edges(table(spark, d, "edges"))


def warning_rollup(spark, d):
    f = table(spark, d, "files").where("content is null").groupBy("repo_id", "file_id").agg(F.min("path").alias("path"))
    return reports.warning_rollup(f.select("repo_id", F.col("file_id").alias("ord"), F.concat(F.lit("Could not read "), "path").alias("text")))


def semantic_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.top_k(v, q, 5).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        node_kind_counts, node_degree, graph_density, top_by_degree, hotspots, language_histogram, edge_weights, edge_labels, module_dependencies, module_coupling, module_metrics, module_order, god_modules, ego_network, hotspot_contracts,
        contract_severity, diff_nodes, diff_modified, diff_edges, diff_summary, report_text, report_markdown, report_json, drawn_nodes, drawn_edges, warning_rollup, semantic_topk,
    )
}

# ---------------------------------------------------------------- SQL

_E = "e AS (SELECT DISTINCT analysis_id, src, dst, weight, kind, ord FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)"
_COLS = "max(label) AS label, max(kind) AS kind, max(path) AS path, max(grp) AS grp, max(loc) AS loc, max(complexity) AS complexity, max(language) AS language"
_N0 = f"n0 AS (SELECT analysis_id, id, {_COLS} FROM nodes WHERE id IS NOT NULL GROUP BY analysis_id, id)"
_N = f"{_N0}, x AS (SELECT DISTINCT analysis_id, dst AS id FROM edges), n AS (SELECT analysis_id, id, {_COLS} FROM (SELECT * FROM n0 UNION ALL SELECT x.analysis_id, x.id, o.label, 'external', NULL, 'external', NULL, NULL, NULL FROM x JOIN externals o ON o.id = x.id) GROUP BY analysis_id, id)"
_D = "d AS (SELECT analysis_id, id, count(*) AS degree, min(o2) AS first_seen FROM (SELECT analysis_id, src AS id, 2 * ord AS o2 FROM e UNION ALL SELECT analysis_id, dst, 2 * ord + 1 FROM e) GROUP BY ALL)"
_DEP = "dep AS (SELECT DISTINCT e.analysis_id, a.grp AS src_module, b.grp AS dst_module FROM e JOIN n a ON a.analysis_id = e.analysis_id AND a.id = e.src JOIN n b ON b.analysis_id = e.analysis_id AND b.id = e.dst WHERE a.grp <> b.grp AND a.grp <> '' AND b.grp <> '')"
_CPL = "cpl AS (SELECT m.analysis_id, m.module, (SELECT count(*) FROM dep WHERE dep.analysis_id = m.analysis_id AND dst_module = m.module) AS ca, (SELECT count(*) FROM dep WHERE dep.analysis_id = m.analysis_id AND src_module = m.module) AS ce FROM (SELECT DISTINCT analysis_id, grp AS module FROM n WHERE kind = 'module' AND grp IS NOT NULL) m)"
_R = "floor(({0}) * {1} + 0.5) / {1}"
_MM = (
    "s AS (SELECT analysis_id, grp AS module, count(*) FILTER (kind IN ('file', 'function')) AS types, count(*) FILTER (kind IN ('file', 'function') AND (lower(label) LIKE 'abstract%' OR lower(label) LIKE 'interface%' OR lower(label) LIKE 'i%')) AS abstracts, sum(coalesce(complexity, 0)) AS cx FROM n WHERE grp IS NOT NULL GROUP BY ALL), "
    "q AS (SELECT cpl.*, CASE WHEN ca + ce > 0 THEN ce::DOUBLE / (ca + ce) ELSE 0.0 END AS i, CASE WHEN types > 0 THEN abstracts::DOUBLE / types ELSE 0.0 END AS a, coalesce(cx, 0)::BIGINT AS total_complexity FROM cpl LEFT JOIN s USING (analysis_id, module)), "
    f"mm AS (SELECT analysis_id, module, ca, ce, {_R.format('i', 1000)} AS instability, {_R.format('a', 1000)} AS abstractness, {_R.format('abs(a + i - 1)', 1000)} AS distance, total_complexity FROM q)"
)
_GM = f"gm AS (SELECT nn.analysis_id, nodes, coalesce(edges, 0) AS edges, modules, files, functions, externals, {_R.format('2.0::DOUBLE * coalesce(edges, 0) / nodes', 100)} AS avg_degree, CASE WHEN nodes > 1 THEN {_R.format('coalesce(edges, 0)::DOUBLE / (nodes * (nodes - 1))', 10000)} ELSE 0.0 END AS density, max_complexity FROM (SELECT analysis_id, count(*) AS nodes, count(*) FILTER (kind = 'module') AS modules, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'external') AS externals, greatest(coalesce(max(complexity), 0), 0) AS max_complexity FROM n GROUP BY 1) nn LEFT JOIN (SELECT analysis_id, count(*) AS edges FROM e GROUP BY 1) ee USING (analysis_id))"
_TOP = "top AS (SELECT d.analysis_id, row_number() OVER (PARTITION BY d.analysis_id ORDER BY degree DESC, first_seen, d.id) AS rank, d.id, coalesce(n.label, d.id) AS label, degree FROM d LEFT JOIN n USING (analysis_id, id) QUALIFY rank <= 5)"
_HOT = "hot AS (SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY complexity DESC, id) AS rank, id, label, complexity::BIGINT AS complexity FROM n WHERE complexity > 0 QUALIFY rank <= 5)"
_STATUS = "CASE WHEN coalesce(nullif(complexity, 0), 10) > 100 OR coalesce(nullif({0}, 0), 1) > 30 THEN 'CRITICAL_GOD_MODULE' WHEN coalesce(nullif(complexity, 0), 10) > 50 THEN 'WARNING' ELSE 'STABLE' END"
_SKILL = "CASE lower(coalesce(nullif(language, ''), 'TypeScript')) WHEN 'python' THEN 'Karpathy_Python_Strict_Typing_Skill' WHEN 'typescript' THEN 'Enterprise_TS_Modularization_Skill' WHEN 'javascript' THEN 'Enterprise_TS_Modularization_Skill' ELSE 'Standard_Clean_Architecture_Skill' END"
_P = "ua AS (SELECT analysis_id, min(repo_id) AS repo_id, min(branch) AS branch, min(created_at) AS created_at FROM analyses WHERE status IS DISTINCT FROM 'error' AND analysis_id IS NOT NULL GROUP BY 1), p AS (SELECT * FROM (SELECT lag(analysis_id) OVER (PARTITION BY repo_id, branch ORDER BY created_at, analysis_id) AS base, analysis_id AS head FROM ua) WHERE base IS NOT NULL)"
_NP = (
    "np AS (SELECT coalesce(b.base, h.base) AS base, coalesce(b.head, h.head) AS head, coalesce(b.id, h.id) AS id, b.id IS NOT NULL AS in_base, h.id IS NOT NULL AS in_head, b.loc AS loc_base, h.loc AS loc_head, b.complexity AS complexity_base, h.complexity AS complexity_head, b.language AS language_base, h.language AS language_head "
    "FROM (SELECT p.base, p.head, n0.* FROM p JOIN n0 ON n0.analysis_id = p.base) b FULL JOIN (SELECT p.base, p.head, n0.* FROM p JOIN n0 ON n0.analysis_id = p.head) h ON b.base = h.base AND b.head = h.head AND b.id = h.id)"
)
_MOD = "in_base AND in_head AND (coalesce(loc_base <> loc_head, false) OR coalesce(complexity_base <> complexity_head, false) OR language_base IS DISTINCT FROM language_head)"
_EP = "k AS (SELECT analysis_id, src, dst, count(*) AS c FROM e GROUP BY ALL), ep AS (SELECT p.base, p.head, k.src, k.dst, 'added' AS change, c AS edges FROM p JOIN k ON k.analysis_id = p.head WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.analysis_id = p.base AND b.src = k.src AND b.dst = k.dst) UNION ALL SELECT p.base, p.head, k.src, k.dst, 'deleted', c FROM p JOIN k ON k.analysis_id = p.base WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.analysis_id = p.head AND b.src = k.src AND b.dst = k.dst))"


def _report(md: bool) -> str:
    names = [("Nodes", "nodes"), ("Edges", "edges"), ("Modules", "modules"), ("Files", "files"), ("Max Complexity", "max_complexity")]
    head = ["# Analysis Report", "", "## Overview", "", "| Metric | Value |", "|---|---|"] if md else ["Analysis Report", "===============", "", "Overview:"]
    sec = ("## Top Connections\n", "## Hotspots\n") if md else ("Top Connections:", "Hotspots:")
    row = [f"'| {a} | ' || {c} || ' |'" if md else f"'- {a}: ' || {c}" for a, c in names]
    q = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    parts = [*map(q, head), *row, "''", q(sec[0]), "coalesce(t, '')", "''", q(sec[1]), "coalesce(h, '')"]
    a, b = ("'- **' || label || '**: '", "") if md else ("'- ' || label || ': '", "")
    return (
        f"WITH {_E}, {_N}, {_D}, {_GM}, {_TOP}, {_HOT}, t1 AS (SELECT analysis_id, string_agg({a} || degree, chr(10) ORDER BY rank) AS t FROM top GROUP BY 1), h1 AS (SELECT analysis_id, string_agg({a} || 'Complexity ' || complexity, chr(10) ORDER BY rank) AS h FROM hot GROUP BY 1) "
        f"SELECT gm.analysis_id, concat_ws(chr(10), {', '.join(parts)}) AS report FROM gm LEFT JOIN t1 USING (analysis_id) LEFT JOIN h1 USING (analysis_id)"
    )


ORACLES = {
    "node_kind_counts": f"WITH {_N} SELECT analysis_id, count(*) FILTER (kind = 'module') AS modules, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'external') AS externals, count(*) FILTER (kind = 'config') AS configs FROM n GROUP BY 1",
    "node_degree": f"WITH {_E}, {_D} SELECT analysis_id, id, degree FROM d",
    "graph_density": f"WITH {_E}, {_N}, {_GM} SELECT * FROM gm",
    "top_by_degree": f"WITH {_E}, {_N}, {_D}, {_TOP} SELECT * FROM top",
    "hotspots": f"WITH {_N}, {_HOT} SELECT * FROM hot",
    "language_histogram": f"WITH {_N0} SELECT analysis_id, language, count(*) AS files FROM n0 WHERE kind IN ('file', 'config') AND language IS NOT NULL GROUP BY ALL",
    "edge_weights": f"WITH {_E} SELECT analysis_id, src, dst, kind, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY ALL",
    "edge_labels": f"WITH {_E}, {_N} SELECT e.analysis_id, e.src, e.dst, e.kind, e.ord, coalesce(a.label, e.src) AS src_label, coalesce(b.label, e.dst) AS dst_label FROM e LEFT JOIN n a ON a.analysis_id = e.analysis_id AND a.id = e.src LEFT JOIN n b ON b.analysis_id = e.analysis_id AND b.id = e.dst",
    "module_dependencies": f"WITH {_E}, {_N}, {_DEP} SELECT * FROM dep",
    "module_coupling": f"WITH {_E}, {_N}, {_DEP}, {_CPL} SELECT * FROM cpl",
    "module_metrics": f"WITH {_E}, {_N}, {_DEP}, {_CPL}, {_MM} SELECT * FROM mm",
    "god_modules": f"WITH {_E}, {_N}, {_DEP}, {_CPL}, {_MM}, th AS (SELECT analysis_id, count(*) AS c, list_sort(list(ca), 'DESC')[floor(0.75 * count(*))::INT + 1] AS t1, list_sort(list(ce), 'DESC')[floor(0.75 * count(*))::INT + 1] AS t2, list_sort(list(total_complexity), 'DESC')[floor(0.75 * count(*))::INT + 1] AS t3 FROM mm GROUP BY 1) SELECT mm.analysis_id, module FROM mm JOIN th USING (analysis_id) WHERE c >= 3 AND (ca >= t1)::INT + (ce >= t2)::INT + (total_complexity >= t3)::INT >= 2",
    "ego_network": f"WITH {_E}, i AS (SELECT DISTINCT analysis_id, id FROM nodes WHERE kind <> 'function' AND path = (SELECT min(path) FROM nodes WHERE kind = 'file')) SELECT e.analysis_id, i.id, 'out' AS direction, dst AS other, e.kind, e.ord FROM e JOIN i ON i.analysis_id = e.analysis_id AND i.id = e.src UNION ALL SELECT e.analysis_id, i.id, 'in', src, e.kind, e.ord FROM e JOIN i ON i.analysis_id = e.analysis_id AND i.id = e.dst",
    "hotspot_contracts": f"WITH {_E}, {_N}, {_D} SELECT n.analysis_id, n.id, coalesce(nullif(language, ''), 'TypeScript') AS language, coalesce(nullif(complexity, 0), 10)::BIGINT AS complexity, coalesce(degree, 1) AS degree, {_STATUS.format('degree')} AS status, {_SKILL} AS skill FROM n LEFT JOIN d USING (analysis_id, id) WHERE complexity > 50 OR degree > 25",
    "contract_severity": f"WITH {_N0} SELECT analysis_id, id, {_STATUS.format('NULL')} AS status, {_SKILL} AS skill FROM n0",
    "diff_nodes": f"WITH {_N0}, {_P}, {_NP} SELECT base, head, id, CASE WHEN in_head THEN 'added' ELSE 'deleted' END AS change FROM np WHERE in_base <> in_head",
    "diff_modified": f"WITH {_N0}, {_P}, {_NP} SELECT base, head, id, loc_base::BIGINT AS loc_base, loc_head::BIGINT AS loc_head, complexity_base::BIGINT AS complexity_base, complexity_head::BIGINT AS complexity_head, language_base, language_head FROM np WHERE {_MOD}",
    "diff_edges": f"WITH {_E}, {_P}, {_EP} SELECT * FROM ep",
    "diff_summary": f"""WITH {_E}, {_N0}, {_P}, {_NP}, {_EP},
      s AS (SELECT base, head, count(*) FILTER (in_head AND NOT in_base) AS nodes_added, count(*) FILTER (in_base AND NOT in_head) AS nodes_deleted, count(*) FILTER ({_MOD}) AS nodes_modified, coalesce(sum(loc_head) FILTER (in_head AND NOT in_base), 0)::BIGINT AS loc_added, coalesce(sum(loc_base) FILTER (in_base AND NOT in_head), 0)::BIGINT AS loc_removed,
        coalesce(sum(greatest(complexity_head - complexity_base, 0)) FILTER ({_MOD}), 0)::BIGINT AS complexity_increased, coalesce(sum(greatest(complexity_base - complexity_head, 0)) FILTER ({_MOD}), 0)::BIGINT AS complexity_decreased FROM np GROUP BY ALL),
      t AS (SELECT base, head, coalesce(sum(edges) FILTER (change = 'added'), 0)::BIGINT AS edges_added, coalesce(sum(edges) FILTER (change = 'deleted'), 0)::BIGINT AS edges_deleted FROM ep GROUP BY ALL),
      u AS (SELECT p.base, p.head, coalesce(nodes_added, 0) AS nodes_added, coalesce(nodes_deleted, 0) AS nodes_deleted, coalesce(nodes_modified, 0) AS nodes_modified, coalesce(edges_added, 0) AS edges_added, coalesce(edges_deleted, 0) AS edges_deleted, coalesce(loc_added, 0) AS loc_added, coalesce(loc_removed, 0) AS loc_removed, coalesce(complexity_increased, 0) AS complexity_increased, coalesce(complexity_decreased, 0) AS complexity_decreased FROM p LEFT JOIN s USING (base, head) LEFT JOIN t USING (base, head))
      SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN nodes_added > 0 THEN '+' || nodes_added || ' nodes' END, CASE WHEN nodes_deleted > 0 THEN '-' || nodes_deleted || ' nodes' END, CASE WHEN nodes_modified > 0 THEN '~' || nodes_modified || ' nodes' END, CASE WHEN edges_added > 0 THEN '+' || edges_added || ' edges' END, CASE WHEN edges_deleted > 0 THEN '-' || edges_deleted || ' edges' END), ''), 'No changes') AS text FROM u""",
    "module_order": f"WITH {_E}, {_N}, {_DEP}, {_CPL}, {_MM} SELECT analysis_id, module, row_number() OVER (PARTITION BY analysis_id ORDER BY instability DESC, module) AS rank FROM mm",
    "report_json": f"WITH {_E}, {_N}, {_GM} SELECT * REPLACE (max_complexity::BIGINT AS max_complexity) FROM gm",
    "report_text": _report(False),
    "report_markdown": _report(True),
    "drawn_nodes": "SELECT DISTINCT analysis_id, id, string_split(id, '/')[-1] AS label, kind AS \"group\" FROM nodes WHERE id IS NOT NULL",
    "drawn_edges": 'SELECT DISTINCT analysis_id, src AS "from", dst AS "to", kind AS title, ord FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL',
    "warning_rollup": "WITH w AS (SELECT repo_id, file_id, 'Could not read ' || min(path) AS text FROM files WHERE content IS NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_id) AS k, count(*) OVER (PARTITION BY repo_id) AS c FROM w) SELECT repo_id, string_agg(text, chr(10) ORDER BY file_id) FILTER (k <= 5) || CASE WHEN max(c) > 5 THEN chr(10) || '+' || (max(c) - 5) || ' more file read errors.' ELSE '' END AS warnings FROM r GROUP BY repo_id",
    "semantic_topk": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id FROM s QUALIFY rank <= 5",
}
