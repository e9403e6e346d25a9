"""Linear forms give what the patterns give, and take linear time."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.functions import dictionaries as D
from lodegraph.functions import text as T
from lodegraph.operators import functions as fn

WORDS = ["public", "static", "int", "foo", "x", " ", "  ", "\n", "*", "(", ")", "{", "}", ",", "<", ">", "[", "]", ":", ";", "const", "a1", "_b", "1a", "\t", "xpublic "]


@pytest.mark.parametrize("ext", ["c", "cpp", "java"])
@settings(max_examples=600, deadline=None)
@given(words=st.lists(st.sampled_from(WORDS), max_size=40))
def test_same_matches(ext, words):
    text = "".join(words)
    want = [(m.start(), m[1], m[2]) for m in re.finditer(D.FUNCTIONS[ext][0][0], text, re.A)]
    assert list(fn._LINEAR[ext](text)) == want


@pytest.mark.parametrize("ext", ["c", "cpp", "java"])
@pytest.mark.parametrize("part", ["plain words ", "f(", "a b(", "<>[] ", "public "])
def test_linear_time(ext, part):
    began = time.time()
    list(fn._LINEAR[ext](part * 20_000))
    assert time.time() - began < 3


def test_complexity(spark):
    texts = ["a ? b : c ? d : e", "??::", ": ? ?", "? \n :", "a?.b; c ? d : e", "éif (x) if y", "if (a) {} else if (b && c) {}", "x ||| y &&& z", "", "else  if", "? " * 50_000, "? : " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None)]
    began = time.time()
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, t string").select("i", T.complexity(F.col("t"))).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        if len(t) < 1000:
            assert got[i] == (1 + sum(len(re.findall(D.re2(p), t, re.A)) for p in D.COMPLEXITY) if t else None), t
    assert got[10] == 1 and got[11] == 20_001 and got[99] is None


MARKS = ['"', "'", "\\", "\n", "/", "*", "//", "/*", "*/", "(", ")", " ", "\t", "\r\n", "a", "b1", "1", ".", "$", "_", "é", "def ", "fn", "func f(", "x.y(", "9a ("]


@settings(max_examples=1500, deadline=None)
@given(parts=st.lists(st.sampled_from(MARKS), max_size=40))
def test_same_calls(parts):
    text = "".join(parts)
    code = re.sub(D.DEFINITION, " (", re.sub(D.REMARK, " ", text), flags=re.A)
    assert fn._called(text)[::-1] == re.findall(D.CALLED, code, re.A)


@pytest.mark.parametrize("part", ['"', r"\"", r"\'", "/* ", "/*/", "a", "a1", " ", "fn ", "f(", "( ", "'\\\n"])
def test_linear_calls(part):
    began = time.time()
    fn._called('"' + part * 200_000)
    fn._called("x" + part * 200_000)
    assert time.time() - began < 5


def test_calls_beside_long_literals(spark):
    """Java's form of the patterns ended the session with a stack overflow."""
    odd = ['"' + "abc " * 10_000 + '"', "'" + r"\n" * 20_000 + "'", "/*" + "f(1) " * 10_000 + "*/", '"' + r"\"" * 20_000 + "\n", "/* " * 20_000, "a" * 40_000]
    files = spark.createDataFrame([(i, "a.ts", f"f(x.g({t} ), 1); def h(1)") for i, t in enumerate(odd)] + [(9, "a.ts", None), (9, "b.ts", ""), (9, "c.py", "f()")], "repo_id bigint, path string, content string")
    got = {tuple(r) for r in fn.syntax_calls(files).collect()}
    assert got == {(i, "a.ts", name, dot, 1) for i in range(len(odd)) for name, dot in (("f", False), ("g", True))}
