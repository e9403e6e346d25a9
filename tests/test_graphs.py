"""Metrics, cycles, differences and snapshots on small graphs."""

import random

from pyspark.sql import functions as F

from lodegraph.operators import cycles, diff, metrics, reports, search
from lodegraph.operators.snapshot_diff import changes, graph_changes, lineages

N = "analysis_id bigint, id string, label string, kind string, path string, grp string, loc int, complexity int, language string"
E = "analysis_id bigint, src string, dst string, weight int, kind string, ord bigint"


def nodes(spark, *rows):
    return spark.createDataFrame([(1, i, lab, k, None, g, None, c, None) for i, lab, k, g, c in rows], N)


def edges(spark, *pairs):
    return spark.createDataFrame([(1, a, b, 1, "import", i) for i, (a, b) in enumerate(pairs)], E)


def test_degree(spark):
    n, e = nodes(spark, ("a", "A", "file", "m", 3), ("b", "B", "file", "m", None)), edges(spark, ("a", "b"), ("a", "b"), ("a", "x"))
    assert {r["id"]: r["degree"] for r in metrics.node_degree(e).collect()} == {"a": 3, "b": 2, "x": 1}
    g = metrics.graph_metrics(n, e.where("dst = 'b'")).first()
    assert (g["avg_degree"], g["density"], g["max_complexity"]) == (2.0, 1.0, 3)
    assert [(r["id"], r["label"]) for r in metrics.top_by_degree(n, e).orderBy("rank").collect()] == [("a", "A"), ("b", "B"), ("x", "x")]
    assert [r["id"] for r in metrics.hotspots(n).collect()] == ["a"]
    doubled = e.unionByName(e)
    assert metrics.node_degree(doubled).collect().__len__() == 3 and metrics.node_degree(doubled).agg(F.sum("degree")).first()[0] == 6


def mods(spark, *names):
    return [("mod:" + m, m, "module", m, None) for m in names]


def test_modules(spark):
    rows = mods(spark, "A", "B", "C", "D") + [(f"f{m}", "index.ts" if m == "A" else "b.ts", "file", m, 2) for m in "ABCD"] + [("fA2", "b.ts", "file", "A", 1)]
    e = edges(spark, ("fA", "fB"), ("fB", "fC"), ("fC", "fA"), ("fC", "fD"), ("fA2", "fB"), ("fA", "fA2"), ("fA", "gone"))
    n = nodes(spark, *rows)
    m = {r["module"]: r for r in metrics.module_metrics(n, e).collect()}
    assert (m["A"]["ca"], m["A"]["ce"], m["A"]["abstractness"], m["A"]["total_complexity"]) == (1, 1, 0.5, 3)
    assert (m["D"]["ca"], m["D"]["ce"], m["D"]["instability"], m["D"]["distance"]) == (1, 0, 0.0, 1.0)
    dep = metrics.module_dependencies(n, e)
    assert [(r["size"], r["modules"]) for r in cycles.module_cycles(dep).collect()] == [(3, "A,B,C")]
    assert [(r["size"], r["modules"]) for r in cycles.module_cycles(dep, local_edges=0).collect()] == [(3, "A,B,C")]


def test_components_agree(spark):
    rng = random.Random(3)
    rows = [(k, f"v{rng.randrange(14)}", f"v{rng.randrange(14)}") for k in (1, 2) for _ in range(22)]
    df = spark.createDataFrame(rows, "analysis_id bigint, src_module string, dst_module string").where("src_module <> dst_module")
    a = sorted(map(tuple, cycles.module_cycles(df).collect()))
    assert a == sorted(map(tuple, cycles.module_cycles(df, local_edges=0).collect())) and a


def test_gods(spark):
    df = lambda *v: spark.createDataFrame([(1, f"m{x}", x, x, x) for x in v], "analysis_id bigint, module string, ca bigint, ce bigint, total_complexity bigint")
    names = lambda d: sorted(r["module"] for r in metrics.god_modules(d).collect())
    assert names(df(1, 2)) == []
    assert names(df(1, 2, 3, 4)) == ["m1", "m2", "m3", "m4"]
    assert names(df(1, 2, 3, 4, 5)) == ["m2", "m3", "m4", "m5"]


def test_diff(spark):
    n = spark.createDataFrame([(1, "a", "a", "file", None, None, 1, 5, None), (2, "a", "a", "file", None, None, None, 7, "Go"), (1, "b", "b", "file", None, None, 4, 1, None), (2, "c", "c", "file", None, None, 9, 1, None)], N)
    e = spark.createDataFrame([(1, "a", "b", 1, "import", 0), (2, "a", "b", 1, "call", 0), (1, "a", "x", 1, "call", 1)], E)
    pairs = spark.createDataFrame([(1, 2), (1, 1)], "base bigint, head bigint")
    s = {(r["base"], r["head"]): r for r in diff.diff_summary(n, e, pairs).collect()}
    r = s[1, 2]
    assert (r["nodes_added"], r["nodes_deleted"], r["nodes_modified"], r["edges_added"], r["edges_deleted"], r["loc_added"], r["loc_removed"], r["complexity_increased"]) == (1, 1, 1, 0, 1, 9, 4, 2)
    assert r["text"] == "+1 nodes, -1 nodes, ~1 nodes, -1 edges" and s[1, 1]["text"] == "No changes"


def brute(rows, order):
    by = {}
    for s, k, key, v in rows:
        d = by.setdefault(s, {})
        old = d.get((k, key))
        d[k, key] = v if old is None else old if v is None else max(old, v)
    out = set()
    for a, b in zip(order, order[1:]):
        x, y = by.get(a, {}), by.get(b, {})
        out |= {(a, b, *k, "added") for k in y.keys() - x.keys()} | {(a, b, *k, "removed") for k in x.keys() - y.keys()}
        out |= {(a, b, *k, "changed") for k in x.keys() & y.keys() if x[k] is not None and y[k] is not None and x[k] != y[k]}
    return out


def test_snapshots_against_brute_force(spark):
    rng = random.Random(1)
    rows, order = [], [10, 11, 12, 13]
    for s in order:
        for i in range(300):
            if rng.random() < 0.95:
                rows.append((s, "node", f"k{i:04d}", rng.choice([None, i, i, i, i + (rng.random() < 0.1)])))
    rows += rows[:40]
    rows.append((11, "node", None, 1))
    rec = spark.createDataFrame(rows, "snapshot_id bigint, record_kind string, record_key string, v int").withColumn("lineage", F.lit("clash"))
    ana = spark.createDataFrame([(s, 1, "b", s, "success") for s in order] + [(99, 1, "b", 12, "error"), (10, 1, "b", 10, "success")], "analysis_id bigint, repo_id bigint, branch string, created_at int, status string")
    rec = rec.drop("lineage")
    got = {tuple(r) for r in changes(rec, lineages(ana), ["v"], chunk_rows=4, slice_rows=70).collect()}
    assert got == brute([r for r in rows if r[2]], order)


def test_snapshots_edge_cases(spark):
    ana = spark.createDataFrame([(1, 1, None, 1, None), (2, 1, None, 2, "ok"), (3, 1, "x", 3, "ok")], "analysis_id bigint, repo_id bigint, branch string, created_at int, status string")
    n = spark.createDataFrame([(1, "a", 1, None), (1, None, 1, 1), (2, "a", None, 4), (2, "ext:e", 1, 1)], "analysis_id bigint, id string, loc int, complexity int").withColumn("seq", F.lit(5)).withColumn("slice", F.lit("x"))
    e = spark.createDataFrame([(1, "a", "ext:e"), (1, "a", None)], "analysis_id bigint, src string, dst string").withColumn("digest", F.lit(0))
    x = spark.createDataFrame([("ext:e",), (None,)], "id string")
    got = {tuple(r) for r in graph_changes(ana, n, e, x).collect()}
    assert got == {(1, 2, "edge", "a->ext:e", "removed")}
    none = [spark.createDataFrame([], d.schema) for d in (ana, n, e, x)]
    assert graph_changes(*none).count() == 0


def test_reports(spark):
    n, e = nodes(spark, ("a", "A", "file", "m", 3)), edges(spark, ("a", "b"))
    text = reports.text_report(metrics.graph_metrics(n, e), metrics.top_by_degree(n, e), metrics.hotspots(n)).first()["report"]
    assert "- Nodes: 1" in text and "- A: 1\n- b: 1" in text and text.endswith("- A: Complexity 3")
    w = spark.createDataFrame([(1, i, f"w{i}") for i in range(7)], "repo_id bigint, ord bigint, text string")
    assert reports.warning_rollup(w).first()["warnings"].split("\n") == ["w0", "w1", "w2", "w3", "w4", "+2 more file read errors."]
    assert "<\\/script>" in reports.html_page(n.select("id").withColumn("x", F.lit("</script>")), e, 5)


def test_search(spark):
    rng = random.Random(2)
    vs = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)] + [(500, None), (501, [0.0] * 6)]
    v = spark.createDataFrame(vs, "vec_id bigint, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.top_k(v, v.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "embedding"), 3).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    rows = {r["vec_id"]: r["embedding"] for r in v.collect()}
    for q in (0, 50, 100):
        best = sorted((-cos(rows[q], x), i) for i, x in rows.items() if i != q and x and any(x))[:3]
        assert [got[q, k + 1] for k in range(3)] == [i for _, i in best]


def test_unchanged_chunks_are_discarded(spark):
    """Of 40 snapshots of 600 records with one change each, only the chunks around the changes are left; blocks change nothing."""
    from lodegraph.operators.snapshot_diff import unmatched_chunks

    rows = [(s, "node", f"k{i:04}", 1 if i == s * 7 else 0) for s in range(1, 41) for i in range(600)]
    rec = spark.createDataFrame(rows, "snapshot_id bigint, record_kind string, record_key string, v int")
    ana = spark.createDataFrame([(s, 1, "main", s, "success") for s in range(1, 41)], "analysis_id bigint, repo_id bigint, branch string, created_at bigint, status string")
    order = lineages(ana)
    left = unmatched_chunks(rec, order, ["v"], chunk_rows=8, slice_rows=10_000, block=5).selectExpr("sum(size(rows)) as n", "max(block) as b").first()
    assert left["b"] == 7 and left["n"] < 0.2 * len(rows)
    want = {(s - 1, s, "node", f"k{x * 7:04}", "changed") for s in range(2, 41) for x in (s - 1, s)}
    for block in (1, 5, 16, 100):
        assert {tuple(r) for r in changes(rec, order, ["v"], chunk_rows=8, slice_rows=100, block=block).collect()} == want
