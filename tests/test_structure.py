"""The structure of source files: functions, imports and calls by tokens and nesting."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodegraph.functions.lexer import FAMILY, tokens
from lodegraph.operators import syntax as S
from lodegraph.operators.graph import build_graph


def fns(ext, text):
    return [(f.name, f.params, f.is_method, f.class_name) for f in S.functions(ext, text)]


TS = "export async function f<T>(a: number, b = 2): Promise<T> { g(a); }\nclass A extends B { private x = 1; constructor(y) { super(y); } async m(a: string): Promise<void> { if (a) { h(); } } get v() { return `a${this.q(1)}`; } }\nconst o = { k(z) { return z; } }; const p = (a) => { foo(a); };\nfoo(function named(q) { });"


@pytest.mark.parametrize(
    "ext,text,want",
    [
        ("ts", TS, [("f", ["a", "b"], False, None), ("constructor", ["y"], True, "A"), ("m", ["a"], True, "A"), ("v", [], True, "A"), ("k", ["z"], False, None), ("named", ["q"], False, None)]),
        ("ts", "function f(a, b) {", []),
        ("ts", "if (x) { } for (;;) { } while (x) { } // function no() {}\nconst s = 'function no() {}'; const r = /function no() {/;", []),
        ("tsx", "function F() { return <div>{g()}</div>; }", [("F", [], False, None)]),
        ("py", "class A(B):\n    def m(self, x: int = 1, *args, **kw) -> int:\n        def inner(): pass\n        return f(x)\n\nasync def g(a,\n  b): pass\ns = '''\ndef no(): pass\n'''", [("m", ["self", "x", "args", "kw"], True, "A"), ("inner", [], True, "A"), ("g", ["a", "b"], False, None)]),
        ("py", "def m(x) -> int:\n    pass", [("m", ["x"], False, None)]),
        ("py", "x = f(a,\ndef g(b):\n    pass\n", [("g", ["b"], False, None)]),
        ("go", "func F(a, b int, c string) (int, error) {\n}\nfunc (r *T) M(x []int) { g(x) }\nfunc G[T any](x T) {}\nvar f = func(a int) {}", [("F", ["a", "b", "c"], False, None), ("M", ["x"], True, None), ("G", ["x"], False, None)]),
        ("rs", "pub fn a<'a, T: X>(x: &'a str, mut y: i32) -> i32 { let c = 'x'; b(c) }\nimpl A { fn m(&self) {} }", [("a", ["x", "y"], False, None), ("m", ["self"], False, None)]),
        ("java", "package a;\npublic class A<T> extends B {\n  public A(int x) { super(x); }\n  @Override public static <R> List<R> m(final int a, Map<String, Integer> b) throws IOException, X { if (a) { n(a); } return null; }\n}\ninterface J { default int z() { return 1; } }", [("A", ["x"], True, "A"), ("m", ["a", "b"], True, "A"), ("z", [], False, None)]),
        ("c", "#include <a.h>\n#define F(x) { g(x) }\nstatic int *foo(const char *s, int n[]) {\n  if (n) { bar(s); }\n  return 0;\n}\nint proto(int);\nvoid k() {}\n", [("foo", ["s", "n"], False, None), ("k", [], False, None)]),
        ("php", "<?php\nclass A { public function m($a, int $b = 1) {} }\nfunction g(&$x) { }\n$f = function($y) {};", [("m", ["$a", "$b"], True, "A"), ("g", ["$x"], False, None)]),
        ("rb", "class A\n  def m(a, b = 1)\n    if a\n      x\n    end\n  end\n  def self.q; end\nend\ndef z\nend\n", [("m", ["a", "b"], True, "A"), ("q", [], True, "A"), ("z", [], False, None)]),
        ("zzz", "function f() {}", []),
    ],
)
def test_functions(ext, text, want):
    if text == "function f(a, b) {":
        want = [("f", ["a", "b"], False, None)]  # an open body is a body
    assert fns(ext, text) == want


@pytest.mark.parametrize(
    "ext,text,want",
    [
        ("ts", "import a from './a'; import { b, c as d } from \"b\"; import type { T } from 't'; import './side'; export * from './e'; export { x } from 'y'; const z = require('zz'); await import('./dyn'); // import q from 'no'\nconst s = \"import k from 'no2'\"; export const from = 1; import again from './a';", ["./a", "b", "t", "./side", "./e", "y", "zz", "./dyn"]),
        ("py", "import os, sys as s, a.b.c\nfrom . import x\nfrom ..p.q import (y,\n z)\nfrom m import *\nx = 'import no'\nif 1:\n    import late", ["os", "sys", "a.b.c", ".", "..p.q", "m", "late"]),
        ("go", 'import "fmt"\nimport (\n\t"a/b"\n\tx "c"\n)\nvar s = `import "no"`', ["fmt", "a/b", "c"]),
        ("rs", "use std::fmt;\nuse ::tarnkit;\nuse crate::a::{b, c};\nuse std::io;", ["std", "tarnkit", "crate"]),
        ("java", "import a.b;", []),
    ],
)
def test_imports(ext, text, want):
    assert S.imports(ext, text) == want


@pytest.mark.parametrize(
    "ext,text,want",
    [
        ("ts", "export async function f<T>(a: number) { g(a); new X(1); this.z(2); obj?.w(3); // no(1)\n const s = \"no(2)\"; const r = /no(3)/; return `a${this.q(1)}`; if (a) { h(); } }", [("g", False), ("z", True), ("w", True), ("q", True), ("h", False)]),
        ("js", "const a = b\nfoo()\nreturn bar()", [("foo", False), ("bar", False)]),
        ("ts", "obj.foo()", [("foo", True)]),
        ("py", "print(os.path.join(a, f(b)))\n# no(1)\ndef g(x): return not h(x)\nx = 1\nk()", [("print", False), ("join", True), ("f", False), ("h", False), ("k", False)]),
        ("java", "class A { int m(int a) { new Foo(a); return n(a) + b.c(a); } void q(int x); }", [("n", False), ("c", True)]),
        ("c", "int proto(int);\nchar *p2(int);\nint main() { proto(1); return *q(2); }", [("proto", False), ("q", False)]),
    ],
)
def test_calls(ext, text, want):
    assert [(n, m) for n, _, m in S.calls(ext, text)] == want


@given(st.sampled_from(sorted(FAMILY)), st.text(alphabet="abf(){}[]<>`'\"/\\*$#:;,.=\n def class import function \t", max_size=120))
def test_any_text_is_read(ext, text):
    ts = tokens(ext, text)
    assert all(text.startswith(t, at) or k == "l" for k, t, at in ts) and [t[2] for t in ts] == sorted(t[2] for t in ts)
    S.functions(ext, text), S.imports(ext, text), S.calls(ext, text)


def test_long_texts_are_linear():
    for ext, text in (("c", "word " * 60_000), ("java", "(" * 60_000), ("js", "`${" * 20_000), ("py", "x = (\n" * 40_000), ("rs", "<" * 60_000), ("ts", "f(" * 40_000), ("ts", "class A { " * 20_000)):
        began = time.time()
        S.functions(ext, text), S.calls(ext, text), S.imports(ext, text)
        assert time.time() - began < 10, ext


def test_frames(spark):
    rows = [(1, "a.ts", TS), (1, "a.ts", TS), (1, "b.ts", None), (1, "c.ts", ""), (1, "d.md", "function f() {}"), (1, "src/x/e.py", "import os\nfrom .a import b\nclass K:\n    def m(self):\n        n()\ndef n():\n    pass\n"), (2, "k.kt", "fun z(a: Int) {\n}\n")]
    f = spark.createDataFrame(rows, "repo_id bigint, path string, content string").selectExpr("*", "1 as name", "2 as line", "3 as callee", "4 as pos")
    got = {(r["path"], r["name"], r["line"], r["is_method"]) for r in S.extract_functions(f).collect()}
    assert ("a.ts", "constructor", 2, True) in got and ("src/x/e.py", "m", 4, True) in got and len(got) == 8
    assert [(r["raw"], r["is_relative"]) for r in S.extract_imports(f).sort("pos").collect()] == [("os", False), (".a", False)]
    assert {(r["callee"], r["line"]) for r in S.extract_calls(f).where("path like '%.py'").collect()} == {("n", 5)}
    for op in (S.extract_functions, S.extract_imports, S.extract_calls):
        assert op(f.limit(0)).count() == 0
    g = build_graph(f, functions="syntax")
    ids = {r["id"] for r in g.nodes.where("kind = 'function'").collect()}
    assert "func:src/x/e.py:m:4" in ids and "func:k.kt:z:1" in ids and "func:a.ts:if:2" not in ids
    assert g.edges.where("kind = 'call' and dst = 'func:src/x/e.py:n:6'").count() == 1
