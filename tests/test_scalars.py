"""Scalars and path functions on small hand-made rows."""

from pyspark.sql import functions as F

from lodegraph.functions import paths as P
from lodegraph.functions import text as T
from lodegraph.operators.contracts import status
from lodegraph.sources import files as S


def one(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_language(spark):
    assert one(spark, P.language, ["file.ts", "file.js", "file.py", "file.cbl", "unknown.xyz", "Dockerfile", "x/Dockerfile", None]) == ["TypeScript", "JavaScript", "Python", "COBOL", None, "Dockerfile", None, None]
    assert one(spark, P.is_source, ["main.go", "app.tsx", "script.sh", "image.png", "a.h"]) == [True, True, True, False, False]
    assert one(spark, P.is_config, ["package.json", "tsconfig.json", "a/tailwind.config.js", "index.js"]) == [True, True, True, False]


def test_lines_and_complexity(spark):
    assert one(spark, T.line_count, ["a\nb\r\nc\n", "", None, "x"]) == [4, None, None, 1]
    assert one(spark, T.complexity, ["if (a) {} else if (b && c) {}", "a?.b; c ? d : e", "éif (x) if y", "", None]) == [5, 2, 3, None, None]


def test_paths(spark):
    assert one(spark, P.normalise, ["a/./b/../c", "/x", "../..", ""]) == ["a/c", "x", "", ""]
    assert one(spark, P.external_package, ["@scope/pkg/sub", "lodash/fp", "os.path", "@/x/y"]) == ["@scope/pkg", "lodash", "os.path", "@/x"]
    assert one(spark, P.is_entrypoint, ["src/main.ts", "cmd/a/main.go", "cmd/a/b/main.go", "src/a/index.ts"]) == [True, True, False, False]
    assert one(spark, P.default_module, ["src/a/b.ts", "src/a.ts", "x/y.ts", "z.ts"]) == ["src/a", "src", "x", "root"]
    assert one(spark, P.is_relative_spec, ["./a", "../a", "/a", ".a", "a"]) == [True, True, True, False, False]


def test_rounding(spark):
    assert one(spark, lambda x: T.round_half_up(x, 2), [1.005, 0.285, 2.675], "double") == [1.0, 0.28, 2.68]


def test_fnv(spark):
    assert one(spark, T.fnv1a, ["ab", ""]) == [1294271946, 2166136261]
    from lodegraph.sources.synthetic import fnv1a

    assert fnv1a("ab") == 1294271946


def test_targets(spark):
    got = one(spark, S.classify_target, ["/tmp/p", "C:\\p", "file:///a/b", "https://github.com/o/r.git", "https://github.com/o", "https://x.org/y", "ftp://a", "nothing", None, " https://www.github.com/o/r "])
    assert [None if g is None else tuple(g) for g in got] == [("local", "p", "local"), ("local", "p", "local"), ("local", "b", "local"), ("o", "r", "github"), None, ("web", "x.org", "website"), None, None, None, ("o", "r", "github")]


def test_status(spark):
    df = spark.createDataFrame([(101, 1), (51, 1), (50, 31), (50, 30), (None, None), (0, 0)], "c int, d int")
    assert [r[0] for r in df.select(status(F.col("c"), F.col("d"))).collect()] == ["CRITICAL_GOD_MODULE", "WARNING", "CRITICAL_GOD_MODULE", "STABLE", "STABLE", "STABLE"]
