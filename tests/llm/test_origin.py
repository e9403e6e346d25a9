"""Generated, minified, vendored and data files."""

import pytest

from lodegraph.llm import origin as O

MODEL = O.NameModel({g: 9 for n in "function value index count total result order window buffer length number".split() for g in O._grams(n)})
TABLE = "TABLE = [\n" + "  33770, 33102, 0x1f, 3503,\n" * 30 + "]\n"
MIN = "!function(s){if(s){var b1=s.x||{};b1.y='640a'}}({});" + "".join(f"function {chr(97 + i % 26)}{i}(o,k){{return o+k*{i}}}" for i in range(30))


@pytest.mark.parametrize(
    "ext,path,text,kind",
    [
        ("go", "a.go", "// Code generated by tool v2. DO NOT EDIT.\npackage a\n", "generated"), ("py", "a.py", "#!/usr/bin/env python\n# Copyright 2022 Us\n# Automatisch erzeugte Datei, bitte nicht von Hand bearbeiten.\n", "generated"), ("js", "a.js", "x()\n// @generated graphc 3\n", "generated"),
        ("py", "b/x_pb2.py", None, "generated"), ("rs", "t/target/out/a.rs", "fn a() { }", "generated"), ("ts", "x.generated.ts", "", "generated"), ("py", "a.py", "".join(f"def get_field_{i:03}(m):\n    return m.f[{i}]\n" for i in range(20)), "generated"),
        ("c", "n/node_modules/q/a.c", None, "vendored"), ("py", "s/compat/a.py", "# quillbase v3.25.9\n# Copyright (c) quillbase\n", "vendored"), ("ts", "a.ts", "/*!\n * snap v1.2.3 - upstream distribution\n */\n", "vendored"), ("py", "a/deps/lib/x.py", "x", "vendored"),
        ("js", "dist/a.js", None, "minified"), ("js", "a.js", MIN, "minified"), ("js", "a.min.js", "x", "minified"), ("py", "a.py", TABLE, "data"), ("ts", "a.ts", 'export const DATA: string = "' + "5Bz+fSKv4bSUcCx0uy6nMo" * 40 + '";\n', "data"),
        ("go", "a.go", "package data\n\nvar T = []int{\n" + "  1, 2, 3,\n" * 90 + "}\n", "data"),
        ("ts", "a.ts", 'const banner = "Code generated by our tool. DO NOT EDIT.";\nfunction f() { }', None), ("py", "vendor_portal/a.py", "x = 1", None), ("ts", "a.ts", "// Copyright 2022 Us\n// The authors wrote this module and maintain it.\n", None), ("py", "a.py", TABLE + "\ndef f(a):\n    return TABLE[a]\n" * 12, None),
        ("ts", "a.ts", "// Ids are generated at startup, please do not edit the order of the calls.\nf()", None), ("py", "deps/a.py", "x", None), ("js", "a.js", 'const columns = "' + "value0,index1,count2," * 40 + '";\nfunction total(result) {\n  return result.length;\n}\n', None), ("ts", "a.ts", "", None), ("ts", "a.ts", None, None),
    ],
)
def test_judge(ext, path, text, kind):
    assert O.judge(ext, path, text, MODEL)[0] == kind
    if text:
        assert O.judge(ext, path, text.replace("\n", "\r\n"), MODEL)[0] == kind


def test_queries(spark):
    rows = [(1, 1, "a_pb2.py", None), (1, 1, "a_pb2.py", None), (2, 1, "b.py", "value = count"), (3, None, "c.js", ""), (4, 2, "d.md", TABLE), (None, 1, "e_pb2.py", "x"), (5, 2, "e.go", "// Code generated by x. DO NOT EDIT.\npackage a\n" + "// y\n" * 90_000)]
    f = spark.createDataFrame(rows, "file_id bigint, repo_id bigint, path string, content string").selectExpr("*", "1 as kind", "2 as n", "3 as ext", "4 as lang")
    assert sorted(r[0] for r in O.found(f).collect()) == [1, 5]
    assert sorted((r["file_id"], r["kind"]) for r in O.origins(f).collect()) == [(1, "generated"), (2, None), (3, None), (5, "generated")]
    assert O.found(f.limit(0)).count() == 0
