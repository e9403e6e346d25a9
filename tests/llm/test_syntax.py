"""Files that parse and files that don't."""

import ast
import shutil
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import parsing
from lodegraph.llm.derive import Grammar
from lodegraph.llm.syntax import check, machine

VALID = {
    "py": [
        "", "x = 1", "def f(a, *b, c=1, **d) -> int:\n    return [i async for i in a if i]\n", "match x:\n    case {'a': [1, *r]} if r:\n        pass\n    case _:\n        pass\n", "with (open(a) as b, c):\n  x: int = 3; y = lambda z, *q: z\n",
        "@d(1)\nclass A[T: int](B, metaclass=C):\n\tasync def f(self): await g()\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nelse:\n  1\nfinally:\n  2\n", 'f"{a["b"]!r:>{w}} {{}}"\nx = (yield)\n', "a, *b = c = d[1:2, ::3]\nfor i, in x: print(i)\n", "if x:\n  pass\n# end\n\n  # odd comment\ny = '''\n<<<<<<< HEAD\n'''",
        "x = 1 if y else \\\n  2\nprint(*a, **b, c=(d := 4))\ntype X[T] = list[T]\n", "global a, b\ndel a[0], b.c\nassert x, 'y'\nfrom . import (a as b,)\nfrom ...x.y import *\n",
    ],
    "ts": [
        "export const a: Array<[number, string]> = [[1, ']']];\nconst f = async <T,>(x: T, ...y: T[]): Promise<T> => x as unknown as T;", "interface A<T> extends B { readonly [k: string]: T; f?(x: number): void; new (): A<T> }\ntype U = keyof typeof x | `a${string}` | (A extends infer R ? R : never)[];",
        "abstract class A<T> extends B<T> implements C, D { private readonly x!: number; static { 1 } constructor(private a?: string) { super() } get y(): T { return this.x! } declare z: any; @dec() m<K extends keyof T>(k: K) {} }",
        "declare module 'x' { export function f(a: number): asserts a is 3; }\nenum E { A = 1 << 2, B }\nimport type { X } from './x'\nexport type { X }\nexport default class {}\n", "let a = b\n(c)\nlet d = e as const\nfor (const k of x) if (k) continue\nelse break\n", "const x = a < b, y = f<number>(c), z = a >> 1 >= 2 ? /[/\\]]+/g.test(s) : `t ${`u ${v}`} w`",
    ],
    "tsx": ["const e = <div className=\"a\" {...p} on={() => 1}>text {x ? <B.C/> : null}<></></div>;\nfunction f<T>(a: T) { return a }"],
    "js": ["#!/usr/bin/env node\n'use strict'\nvar a = 1\nvar b = { get x() { return 1 }, [k]: 2, async *g() {}, ...c, d }\nlabel: for (;;) { break label }\na\n++b\nexport { a as default }", "const { a = 1, b: { c }, ...d } = e, [f,, g] = h;\nif (x) /re/.exec(y)\nx = y / z / 2;\nasync () => { for await (const q of r) await q?.[0]?.(1) ?? 2 }", "class A { #p = 1; static async *m() { yield* this.#p } 'x'() {} }\nnew Foo\ndo x(); while (y) z()\nimport('a').then(({ b }) => b)", "return_ = function* () {}\nthrow\u0020new Error(`a\n${b}`)"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K, V]) F(a int, b ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && !f(v) {\n\t\treturn\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\tdefault:\n\t\tgoto L\n\t}\nL:\n\tfor i := range []int{1, 2} {\n\t\tgo func() { c <- i }()\n\t}\n\tselect {\n\tcase v := <-c:\n\tdefault:\n\t}\n\tx := map[string][]T{\"a\": {{1, 2, nil}}}\n\treturn 1, nil\n}\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class X<T extends Y & Z> extends W<T[]> implements V {\n  static { }\n  int[] a = {1, 2}, b[] = new int[3][];\n  <K> K f(final int... x) throws E { for (var y : z) { if (y instanceof String s && s.length() > 1) return (K) y; } var r = a -> { }; q(String::new, (int p) -> p + 1, List.<T>of()); return switch (k) { case A, B -> 1; default -> { yield 2; } }; }\n  enum E { A(1) { void f() { } }, B; int z; }\n  record R(int a) { R { } }\n  String t = \"\"\"\n    x \"y\"\n    \"\"\"; char c = '\\'';\n  sealed interface S permits P { default void g() { x >>>= 2; int y = a < b ? c : d; } }\n}\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n  (a {\n#ifdef Q\nint f(void) {\n#else\nint f(int q) {\n#endif\n  struct s { int a:3; } *p = &(struct s){ .a = 1 }; T *t = (T *)malloc(sizeof *t); for (int i = 0; i < 3; i++) a[i] = b ? c : d, e->f++; return \"a\" \"b\"[0]; }\n#if 0\n it's junk (\n#endif\ntypedef int (*fn)(const char *, ...);\nenum { A, B = 2, };\nstatic inline unsigned long g(x_t x) { switch (x) { case 1: default: break; } do { goto l; } while (0); l: return -1; }\n"],
    "rs": ["#![allow(x)]\nuse a::{b, c::*, d as e};\n#[derive(A)] pub struct S<'a, T: B + 'a = C>(pub(crate) &'a T) where T: D;\nimpl<'a, T> E for S<'a, T> { type X = Vec<Vec<T>>; fn f(&mut self, x: impl Fn(i32) -> u8) -> Result<(), Box<dyn G>> { let Some(y) = z? else { return Err(q)?; }; if let A { b, .. } | C(b) = d && e { } match x { 1..=2 | 'a' => {} n @ 3 if n > 1 => (), _ => break 'l, } for i in 0..10 { v.push(i as u8 >> 1); } let c = move |a: &str, b| a.len() + b; unsafe { *p = 1 } println!(\"{}\", r#\"a \"b\"\"#); x.0.1 } }\nmacro_rules! m { ($a:expr) => { $a + 1 }; }\nconst A: [u8; 3] = [0; 3]; static B: &'static str = \"x\\\n y\";\n/* a /* b */ c */\n"],
    "sh": ["#!/bin/bash\nset -e\nf() { local a=\"$1 $(echo \"x)\" `date`)\"; [[ $a =~ ^(b|c)$ && -n $d ]] || return 1; }\nfor i in $(seq 1 3) a; do case \"$i\" in a|b) echo x ;; (*) y ;; esac; done < f > g 2>&1\nwhile read -r l; do ((n++)); done <<< \"$x\"\ncat <<'EOT' | tr a b\nif ( {\nEOT\narr=(a \"b c\" $(d)\n e) # not (\nif ! a; then :; elif b; then c & else d; fi\nx=${a:-(none} y=$(( (1 + 2) * 3 )) cmd && { echo }; }\nfunction g { echo done if; }\ndiff <(a) <(b)\n"],
}
INVALID = {
    "py": ["def f(:\n  pass", "if x\n  y", "x = (1", "print 'a'", "  x = 1", "if x:\npass", "<<<<<<< HEAD\n", "x = “a”", "a = b - c =\n", "f(x) = 1", "```py\nx\n```", "'abc", "x = '''\nabc", "if x:\n\ty\n        z\n", "!pip install x", 'f"{a"'],
    "ts": ["const a: number = ;", "}", "function f() {", "const x = `a ${b`", "def f(a, b):\n  pass", "---\ntitle: x\n---\n", "<!DOCTYPE html>", "for (let i = 0; i &lt; 3; i++) {}", "const a = \"b\nc", "interface A { x: }"],
    "js": ["function f(a: number): number { return a }", "{\"a\": 1, \"b\": 2}", "if (x", "a b", "const x = {a: 1", "return_(\n", ">>>>>>> theirs", "x = 3abc", "const e = <div/>;"],
    "go": ["package a\nfunc f() {", "package a\nx := 1\n", "func f() {}\n", "package a\nfunc f() {\n\tif x {\n\t}}\n}\n", "package a\nvar x = 'a\n"],
    "java": ["class A { int x = 1 }", "class A { void f() { if (a) { } }", "package a\nclass B {}", "class A { void f() { int x = 3 int y; } }", "x = 1;", "class A { String s = \"abc; }"],
    "c": ["int f(void) { return 1 }", "int f(void) {", "#if X\nint a;\n", "#endif\n", "int f(void) { } }", "int a = (1 + ;", "char *s = \"abc;\n", "/* open"],
    "rs": ["fn f() { let x = 1 let y = 2; }", "fn f() {", "fn f() { x + }", "int f(int a) { }", "struct S { a: u8 b: u8 }", "fn f() { \"abc }"],
    "sh": ["if true; then echo", "for i in a; do echo; fi", "echo $(a", "echo 'abc", "}", "done", "f() {\n", "case x in a) echo ;;", "<<<<<<< HEAD", "int f(int a) {"],
}


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in VALID.items() for t in ts])
def test_valid(ext, text):
    assert check(ext, text).valid, check(ext, text)
    if text:
        assert check(ext, text.replace("\n", "\r\n")).valid


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in INVALID.items() for t in ts])
def test_invalid(ext, text):
    assert not check(ext, text).valid


def test_reasons():
    assert check("py", "x = 1\ny = )\n")[1:] == ("unexpected", 2, ")")
    assert check("ts", "function f() {\n").reason == "truncated"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["x", "(", ")", "=", " ", "\n", "    ", "if", ":", "[", "]", ",", "1", "'a'", "def", "return", ".", "+", "lambda", "#c", "{", "}", "in", "for", "not"]), max_size=14))
def test_python_like_its_own_parser(parts):
    text = " ".join(parts)
    try:
        ast.parse(text)
        ok = True
    except SyntaxError as e:
        # what its parser refuses beyond the grammar
        if any(x in str(e) for x in ("cannot", "outside", "parameter", "illegal", "duplicate", "assign", "unparenthesized", "delete")):
            return
        ok = False
    except (ValueError, MemoryError):
        return
    assert check("py", text).valid == ok


@pytest.mark.skipif(not shutil.which("bash"), reason="no bash")
@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "if", "then", "fi", "do", "done", "for i in x", "while", ";", "\n", "&&", "|", "{", "}", "(", ")", "\"b\"", "$(c)", "case x in", "esac", "y)", ";;", "else"]), max_size=9))
def test_shell_like_bash(parts):
    text = " ".join(parts)
    got = subprocess.run(["bash", "-n"], input=text.encode(), capture_output=True)
    assert check("sh", text).valid == (got.returncode == 0 and not got.stderr) or not text.strip()


def test_memo_changes_nothing(monkeypatch):
    texts = [t for t in VALID["ts"]] + INVALID["ts"]
    before = [check("ts", t) for t in texts]
    machine("ts").g.forget()
    machine("ts").memo.clear()
    assert [check("ts", t) for t in texts] == before
    monkeypatch.setattr("lodegraph.llm.derive.MEMO_BOUND", 10)
    assert [check("ts", t) for t in texts] == before


def test_grammar():
    g = Grammar("S: E\nE: T (('+' | '-') T)*\nT: ID | '(' E ')'")
    s = g.start
    for t in ["ID", "+", "(", "ID", ")"]:
        s = g.d(s, t)
    assert s.null and g.d(s, ")") is g.empty


def test_queries(spark):
    rows = [(1, 1, "a.py", "x = ("), (1, 1, "a.py", "x = ("), (2, 1, "b.PY", "x = 1"), (3, 1, "c.js", None), (4, 1, "d.md", "x = ("), (5, 2, "e.ts", ""), (None, 1, "f.py", "("), (7, 1, None, "("), (8, 2, "g.go", "x" * 300_000)]
    f = spark.createDataFrame(rows, "file_id bigint, repo_id bigint, path string, content string").selectExpr("*", "1 as ext", "2 as v", "3 as valid")
    assert sorted(r[0] for r in parsing.invalid_files(f).collect()) == [1, 8]
    n = spark.createDataFrame([(1, "a.py", "Python 3"), (1, "a.py", None)], "repo_id bigint, path string, language string").selectExpr("*", "1 as valid")
    got = {(r["repo_id"], r["language"]): (r["files"], r["invalid"]) for r in parsing.invalid_rates(f, n).collect()}
    assert got == {(1, "Python 3"): (1, 1), (1, "Python"): (1, 0), (2, "TypeScript"): (1, 0), (2, "Go"): (1, 1)}
    assert parsing.invalid_files(f.limit(0)).count() == 0
