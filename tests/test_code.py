"""Imports, functions, calls, workspaces and the assembled graph."""

from lodegraph.operators import functions as fn
from lodegraph.operators import graph, monorepo
from lodegraph.operators import imports as im
from lodegraph.sources import files as S
from lodegraph.sources.synthetic import synthetic_graph, uniform

FILES = "repo_id bigint, path string, content string"


def files(spark, *rows):
    return spark.createDataFrame([(1, p, c) for p, c in rows], FILES)


def imports(spark, *rows):
    got = im.extract_imports(files(spark, *rows)).orderBy("path", "pattern_no", "pos").collect()
    return [(r["raw"], r["is_relative"]) for r in got]


def test_imports(spark):
    assert imports(spark, ("a.ts", "import x from './b'; const y = require('z');")) == [("./b", True), ("z", False)]
    assert imports(spark, ("a.ts", "import x from '@/c'")) == [("@/c", False)]
    assert imports(spark, ("a.go", 'import (\n "fmt"\n "x/y"\n)')) == [("fmt", False), ("x/y", False)]
    assert imports(spark, ("a.rs", "use std::io;")) == [("std::io", True)]
    assert imports(spark, ("a.py", "from . import b\nimport os.path\n")) == [(".", True), ("os.path", False)]
    assert imports(spark, ("a.ts", None), ("b.ts", ""), ("c.xyz", "import 'x'")) == []


def resolved(spark, *rows):
    f = files(spark, *rows)
    return sorted((r["src"], r["dst"]) for r in im.resolve_imports(im.extract_imports(f), f).collect())


def test_resolution(spark):
    assert resolved(spark, ("pkg/a.py", "from . import b"), ("pkg/__init__.py", "")) == [("pkg/a.py", "pkg/__init__.py")]
    assert resolved(spark, ("pkg/a.py", "from .b import c"), ("pkg/b.py", "")) == []
    assert resolved(spark, ("src/a.ts", "import './b'"), ("src/b.tsx", ""), ("src/b/index.ts", "")) == [("src/a.ts", "src/b.tsx")]
    assert resolved(spark, ("a.ts", "import './a'")) == []
    assert resolved(spark, ("d/index.html", '<script src="/app.js">'), ("app.js", "")) == []


def test_strict_resolution(spark):
    f = files(spark, ("src/a/x.ts", "import q from '@/b/y'"), ("src/b/y.ts", ""), ("tsconfig.json", '{"compilerOptions":{"paths":{"@/*":["src/*"]}}}'))
    i = im.extract_imports(f)
    assert [r["target"] for r in im.resolve_any(i, im.aliases(f), f).collect()] == [None]
    assert [r["target"] for r in im.resolve_any(i, im.aliases(f), f, strict=True).collect()] == ["src/b/y.ts"]


def functions(spark, path, text, **kw):
    return [(r["name"], r["line"], r["params"], r["is_method"]) for r in fn.extract_functions(files(spark, (path, text)), **kw).orderBy("line", "name").collect()]


def test_functions(spark):
    assert functions(spark, "a.ts", "function f(a, b) {") == [("f", 1, ["a", "b"], False)]
    assert functions(spark, "a.ts", "\nif (x) {") == [("if", 2, ["x"], False)]
    assert functions(spark, "a.py", "def m(self, x):") == [("m", 1, ["self", "x"], False)]
    assert functions(spark, "a.py", "def m(x) -> int:") == []
    assert functions(spark, "a.go", "func (s *T) Run(a int) {\n}") == [("Run", 1, ["a int"], True)]
    java = "class A {\n  public int foo(int a) {\n"
    assert functions(spark, "A.java", java) == [("foo", 1, ["int a"], False)]  # the match begins at the line end before it
    assert functions(spark, "A.java", java, java_pattern="literal") == []


def test_calls(spark):
    got = fn.extract_calls(files(spark, ("a.ts", "obj.foo(); if (x) { bar(1) }"), ("b.tsx", "foo()"))).collect()
    assert sorted((r["path"], r["callee"]) for r in got) == [("a.ts", "bar"), ("a.ts", "foo"), ("a.ts", "foo")]


def test_tiers(spark):
    calls = spark.createDataFrame([(1, "m/a.ts", 0, 0, "f"), (1, "m/b.ts", 0, 0, "f"), (1, "z/c.ts", 0, 0, "f"), (1, "z/c.ts", 0, 1, "f")], "repo_id bigint, path string, pattern_no int, pos int, callee string")
    funcs = spark.createDataFrame([(1, "m/a.ts", "f", 1), (1, "q/d.ts", "f", 2)], "repo_id bigint, path string, name string, line int")
    got = sorted((r["path"], r["func_path"], r["calls"]) for r in fn.resolve_calls(calls, funcs).collect())
    assert got == [("m/a.ts", "m/a.ts", 1), ("m/b.ts", "m/a.ts", 1), ("z/c.ts", "m/a.ts", 2), ("z/c.ts", "q/d.ts", 2)]


def test_monorepo():
    assert monorepo.detect({"pnpm-workspace.yaml": "packages/*"}) == ("pnpm", [])
    assert monorepo.detect({"pnpm-workspace.yaml": "packages:\n  - 'packages/*' # x\n  - /apps/web/\n"}) == ("pnpm", ["packages/*", "apps/web"])
    assert monorepo.detect({"lerna.json": '{"packages":["packages/*"]}'}) == ("lerna", ["packages/*"])
    assert monorepo.detect({"package.json": "{}"}) == ("none", [])
    assert monorepo.detect({"package.json": '{"workspaces":["p/*"]}', "nx.json": None}) == ("nx", ["p/*"])
    assert monorepo.detect({"package.json": '{"workspaces":{"packages":["p/*"]}}'}) == ("none", [])
    assert monorepo.detect({"go.work": "use (\n ./a\n)"}) == ("go-work", ["("])
    assert monorepo.detect({"Cargo.toml": '[workspace]\nmembers = ["a","b"]'}) == ("cargo-workspace", ["a", "b"])


def test_roots(spark):
    globs = spark.createDataFrame([(1, ["packages/*", "libs/**", "none/*"])], "repo_id bigint, globs array<string>")
    f = files(spark, ("packages/a/x.ts", ""), ("packages/README.md", ""), ("libs/u/v.ts", ""))
    roots = monorepo.workspace_roots(globs, f)
    assert sorted(r["root"] for r in roots.collect()) == ["libs/**", "none/*", "packages/README.md", "packages/a"]
    mods = {r["path"]: r["module"] for r in monorepo.assign_modules(f, roots).collect()}
    assert mods == {"packages/a/x.ts": "packages/a", "packages/README.md": "packages/README.md", "libs/u/v.ts": "libs"}
    assert "libs/u" in {r["root"] for r in monorepo.workspace_roots(globs, f, recursive=True).collect()}


def test_graph(spark):
    g = graph.build_graph(files(spark, ("src/a/x.ts", "import y from './y'; import r from 'react';\nfunction f(a) {\n g(1) }"), ("src/a/y.ts", "function g(b) { }"), ("package.json", None)))
    ids = {r["id"] for r in g.nodes.collect()}
    assert {"mod:src/a", "mod:root", "file:src/a/x.ts", "file:package.json", "func:src/a/x.ts:f:2", "func:src/a/y.ts:g:1", "ext:react"} <= ids
    edges = {(r["src"], r["dst"], r["kind"]) for r in g.edges.collect()}
    assert {("mod:src/a", "file:src/a/x.ts", "import"), ("file:src/a/x.ts", "file:src/a/y.ts", "import"), ("file:src/a/x.ts", "ext:react", "import"), ("file:src/a/x.ts", "func:src/a/y.ts:g:1", "call"), ("mod:src/a", "func:src/a/y.ts:g:1", "import")} <= edges
    off = graph.build_graph(files(spark, ("a.ts", "function f() { f() }")), functions="off")
    assert {r["kind"] for r in off.nodes.collect()} == {"module", "file"}


def test_empty_files(spark):
    empty = spark.createDataFrame([], FILES)
    g = graph.build_graph(empty)
    assert g.nodes.count() == 0 and g.edges.count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules" / "b.js").write_text("1")
    (tmp_path / "c.png").write_text("1")
    assert [(r["path"], r["content"], r["size"]) for r in S.read_directory(spark, str(tmp_path)).collect()] == [("a.py", "x = 1\n", 6)]
    tree, cut = S.from_tree(spark, '{"truncated": true, "tree": [{"path": "d/e.ts", "type": "blob", "size": 3}, {"path": "f.ts", "type": "blob"}, {"path": "d", "type": "tree"}, {"path": "g.ts", "type": "blob", "size": 999999}]}')
    from pyspark.sql import functions as F

    assert cut and [r["path"] for r in S.cap_tree(tree.withColumn("repo_id", F.lit(1)), max_files=1).collect()] == ["f.ts"]
    reg = S.Registry()
    reg.add("bad", lambda t: True, lambda s, t: 1 / 0)
    reg.add("no", lambda t: False, lambda s, t: None)
    reg.add("rows", lambda t: True, lambda s, t: S.from_rows(s, [{"path": "a"}]))
    df, tried = reg.read(spark, "x")
    assert df.count() == 1 and [t["status"] for t in tried] == ["failed", "skipped", "used"]


def test_synthetic(spark):
    draw = uniform(1)
    assert all(0 <= draw() < 1 for _ in range(100))
    n, e = synthetic_graph(spark, "o", "r")
    assert 4 <= n.where("kind = 'module'").count() <= 7 and n.where("kind = 'external'").count() == 4
    assert [tuple(r) for r in n.collect()] == [tuple(r) for r in synthetic_graph(spark, "o", "r")[0].collect()] and e.count() > 12


def test_hot_names_are_split(spark, monkeypatch):
    """A third of all functions bear one name; the calls meet each of them once, whatever they are split into."""
    from lodegraph.operators import functions as fn

    f = spark.createDataFrame([(1, f"m{i % 7}/f{i}.py", "run" if i % 3 else f"n{i}", i) for i in range(120)], "repo_id bigint, path string, name string, line int")
    c = spark.createDataFrame([(1, f"m{i % 9}/c{i}.py", 0, i, "run") for i in range(40)] + [(1, "m1/f1.py", 0, 0, "run"), (2, "x.py", 0, 0, "run")], "repo_id bigint, path string, pattern_no int, pos int, callee string")
    take = lambda: sorted(tuple(r) for r in fn.resolve_calls(c, f).collect())
    once = take()
    monkeypatch.setattr(fn, "HOT", 3)
    assert take() == once and len(once) == len(set(once))
    run = [r for r in f.where("name = 'run'").collect()]
    far = [r for r in once if r[1] == "m8/c8.py"]
    assert len(far) == len(run) and {r[4] for r in once if r[1] == "m1/f1.py"} == {"m1/f1.py"}
