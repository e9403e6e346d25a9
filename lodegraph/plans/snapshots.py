"""Queries over full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.operators.snapshot_diff import graph_changes
from lodegraph.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return graph_changes(*(table(spark, d, t) for t in ("analyses", "nodes", "edges", "externals")))


_P4 = """
WITH a AS (
  SELECT analysis_id, min(repo_id) AS repo_id, min(branch) AS branch, min(created_at) AS created_at
  FROM analyses WHERE status IS DISTINCT FROM 'error' AND analysis_id IS NOT NULL GROUP BY analysis_id),
p AS (
  SELECT analysis_id AS head, lag(analysis_id) OVER (PARTITION BY repo_id, branch ORDER BY created_at, analysis_id) AS base FROM a),
n AS (
  SELECT analysis_id, id, max(loc) AS loc, max(complexity) AS cx FROM nodes
  WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM externals WHERE id IS NOT NULL) GROUP BY ALL),
e AS (SELECT DISTINCT analysis_id, src || '->' || dst AS k FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
nb AS (SELECT p.base, p.head, n.* FROM p JOIN n ON n.analysis_id = p.base),
nh AS (SELECT p.base, p.head, n.* FROM p JOIN n ON n.analysis_id = p.head WHERE p.base IS NOT NULL),
eb AS (SELECT p.base, p.head, e.k FROM p JOIN e ON e.analysis_id = p.base),
eh AS (SELECT p.base, p.head, e.k FROM p JOIN e ON e.analysis_id = p.head WHERE p.base IS NOT NULL)
SELECT coalesce(b.base, h.base) AS base_analysis_id, coalesce(b.head, h.head) AS head_analysis_id, 'node' AS record_kind, coalesce(b.id, h.id) AS record_key,
  CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM nb b FULL JOIN nh h ON b.head = h.head AND b.id = h.id
WHERE b.id IS NULL OR h.id IS NULL OR b.loc <> h.loc OR b.cx <> h.cx
UNION ALL
SELECT coalesce(b.base, h.base), coalesce(b.head, h.head), 'edge', coalesce(b.k, h.k), CASE WHEN b.k IS NULL THEN 'added' ELSE 'removed' END
FROM eb b FULL JOIN eh h ON b.head = h.head AND b.k = h.k WHERE b.k IS NULL OR h.k IS NULL
"""

QUERIES = {"p4_found": p4_found}
ORACLES = {"p4_found": _P4}
