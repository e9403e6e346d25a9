"""Sources that fail, responses, pages, shared folders, incremental state, and searches with many queries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodegraph import api, session
from lodegraph.operators import reports, search
from lodegraph.sources import files as src
from lodegraph.streaming import ingest


def test_fetch_keeps_failures(spark):
    def fetch(path: str) -> str:
        if path.startswith("bad"):
            raise OSError("gone")
        return path.upper()

    rows = spark.createDataFrame([(1, "a.py", 0, "x"), (1, "bad1", 1, "x"), (1, None, 2, "x"), (2, "b.py", 0, "x")], "repo_id bigint, path string, ord bigint, content string")
    got = src.fetch_contents(rows, fetch)
    assert {(r["path"], r["content"], r["error"]) for r in got.collect()} == {("a.py", "A.PY", None), ("bad1", None, "OSError: gone"), (None, None, "no path"), ("b.py", "B.PY", None)}
    assert src.fetch_contents(rows.limit(0), fetch).count() == 0
    listed = spark.createDataFrame([(1, 3), (2, 5), (3, 1)], "repo_id bigint, files bigint")
    cut = spark.createDataFrame([(3, True)], "repo_id bigint, truncated boolean")
    rep = {r["repo_id"]: r for r in src.scan_report(got.where("path is not null"), listed, cut).collect()}
    assert rep[1]["warnings"] == "bad1: OSError: gone" and rep[1]["quality"] == "partial" and rep[1]["limitations"] == "Only 2 of 3 files were read."
    assert rep[3]["limitations"].split("\n") == ["The tree was truncated.", "Only 0 of 1 files were read."] and rep[2]["warnings"] == ""


def test_response(spark):
    f = spark.createDataFrame([(1, "src/a.ts", "import x from './b'; import r from 'react';\nfunction f() { g(); }"), (1, "src/b.ts", "function g() {}"), (1, "c.py", None), (2, "d.py", "x = 1")], "repo_id bigint, path string, content string")
    a = api.analyze(f)
    got = {r["repo_id"]: json.loads(r["json"]) for r in api.response(a).collect()}
    assert got[1]["status"] == got[1]["quality"] == "partial" and got[1]["warnings"] == ["Could not read c.py"] and got[2]["status"] == "success"
    lines = [(r["repo_id"], r["part"], json.loads(r["json"])) for r in api.response_lines(a).collect()]
    assert sum(p == "summary" for _, p, _ in lines) == 2
    assert {x["id"] for k, p, x in lines if k == 1 and p == "node"} >= {"mod:src", "file:src/a.ts", "file:c.py", "func:src/a.ts:f:2", "ext:react"}
    assert any(x.get("src") == "file:src/a.ts" and x.get("dst") == "file:src/b.ts" for _, p, x in lines if p == "edge")
    assert sum(p == "edge" for k, p, _ in lines if k == 1) == got[1]["edges"]


def test_page_draws_whole_edges(spark):
    n = spark.createDataFrame([(f"n{i}", f"n{i}", "file") for i in range(6)], "id string, label string, group string")
    e = spark.createDataFrame([("n0", "n1", "import"), ("n0", "n5", "import")], "from string, to string, title string")
    page = reports.html_page(n, e, 3)
    assert "3 nodes, 1 edges; 3 nodes and 1 edges are not shown" in page and '"n5"' not in page and "getContext" in page


def test_shared_folder_is_asked_for(monkeypatch, spark):
    class Sc:
        def __init__(self, master):
            self.master = master
            self._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

        def __init__(self, master):
            self.sparkContext = Sc(master)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("spark://host:7077"))
    assert "lodegraph-" in session.shared_dir(Session("local[2]"))


def test_versions_of_state(spark, tmp_path):
    assert [ingest.merged_by(n) for n in range(8)] == [[], [0], [], [2, 1], [], [4], [], [6, 5, 3]]
    assert [ingest.live(n) for n in range(8)] == [[0], [1], [2, 1], [3], [4, 3], [5, 3], [6, 5, 3], [7]]
    rng = random.Random(3)
    run, want = ingest.upsert_latest(str(tmp_path / "t")), {}
    for n in range(9):
        rows = [(k, rng.randint(0, 50), rng.randint(0, 9)) for k in rng.sample(range(20), 5)]
        batch = spark.createDataFrame(rows, "file_id bigint, received_at bigint, size bigint")
        for k, at, _ in rows:
            want[k] = max(want.get(k, -1), at)
        run(batch, n)
        if n in (4, 8):
            run(batch, n)  # a restart runs the last batch again
        got = {r["file_id"]: r["received_at"] for r in ingest.latest(spark, str(tmp_path / "t"), n).collect()}
        assert got == want
    assert len(list((tmp_path / "t").glob("v=*"))) <= 4


def test_search_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    v = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(90)], "vec_id bigint, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    pick = lambda: {(r["query_id"], r["rank"]): r["vec_id"] for r in search.top_k(v, q, 2).collect()}
    once = pick()
    monkeypatch.setattr(search, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "ROUND", 3)
    assert pick() == once and len(once) == 180
    assert search.top_k(v, q.limit(0), 2).count() == 0 and search.top_k(v.limit(0), q, 2).count() == 0
