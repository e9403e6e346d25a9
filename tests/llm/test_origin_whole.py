"""Origins that only a whole header, footer or file shows."""

import pytest

from lodegraph.llm import origin as O

LONG = "".join(f" * Redistribution and use in source and binary forms, clause {i}, are permitted.\n" for i in range(200))
LINES = LONG.replace(" * ", "// ")
CODE = "int total(int count) {\n  return count;\n}\n"
GPL = "/*\n * Our own library\n" + LONG + " * Version 2.0, January 2004\n * Copyright us\n */\n"


@pytest.mark.parametrize(
    "text,kind",
    [
        ("/*\n" + LONG + " */\n// Code generated by tool v2. DO NOT EDIT.\n" + CODE, "generated"), (LINES + "// @generated\n" + CODE, "generated"), ("/*\n" + LONG + " * quillbase v3.25.9\n * Copyright (c) quillbase\n */\n" + CODE, "vendored"),
        (CODE + LINES + "// Code generated by tool v2. DO NOT EDIT.\n" + LINES, "generated"), (CODE + "/*\n * Code generated by tool v2. DO NOT EDIT.\n" + LONG + " */\n", "generated"), (CODE + "x(); /* Code generated by tool v2. DO NOT EDIT.\n" + LONG + " */\n", "generated"),
        (LINES + 'char *s = "Code generated by tool v2. DO NOT EDIT.";\n' + CODE, None), ('char *s = "Code generated by tool v2. DO NOT EDIT.";\n' + CODE + "/*\n" + LONG + " */\n", None), (GPL + CODE, None),
    ],
)
def test_whole_comments(text, kind):
    assert O.judge("c", "a.c", text, None)[0] == kind


def test_long_comments_are_linear():
    import time

    for text in ("//\n" * 100_000, "// a b 1\n" * 40_000, "/*\n" + " * x\n" * 100_000 + "*/\nx"):
        began = time.process_time()
        O.judge("c", "a.c", text, None)
        assert time.process_time() - began < 20


def _names(k: int) -> list[str]:
    return [chr(97 + i % 26) + ("" if i < 26 else str(i // 26)) for i in range(k)]


def _mangled(end: str, k: int = 30) -> str:
    n = _names(k)
    return "".join(f"function {n[i]}({n[i - 1]},{n[i - 2]}){{{end}return {n[i - 1]}+{n[i - 2]}*{i}}}{end}" for i in range(k))


WRAPPED = "\n".join(_mangled("")[i : i + 120] for i in range(0, len(_mangled("")), 120))
RESTORED = "\n".join(f"function {a}({b}, {c}) {{\n    var {d} = {b} + {c};\n    return {d} * {a}({c}, {b});\n}}\n" for a, b, c, d in zip(_names(30), _names(30)[1:], _names(30)[2:], _names(30)[3:]))
HAND = "\n".join(f"function total{w}(index, count) {{\n    for (var i = 0; i < count; i++) {{\n        result{w}[i] = index + i;\n    }}\n    return result{w};\n}}\n" for w in "Order Window Buffer Length Number".split())
MODEL = O.NameModel({g: 9 for n in "function value index count total result order window buffer length number return var for".split() for g in O._grams(n)})


@pytest.mark.parametrize("text,kind", [(WRAPPED, "minified"), (_mangled("", 7), "minified"), (RESTORED, "minified"), (HAND, None), (HAND.replace("    ", "").replace("\n", ""), None)])
def test_names_are_asked_in_any_layout(text, kind):
    assert O.judge("js", "a.js", text, MODEL)[0] == kind


def test_names_come_first():
    """A template and mangled names are found without header or path, and a directory's name alone condemns nothing."""
    files = [("ts", "\n".join(f"export function readField{i}(box: Box): number {{\n  return box.field{i};\n}}" for i in range(40)))]
    plain = "\n".join(f"export function {v}{n}(total: number, limit: number): number {{\n  return total + limit;\n}}" for v in ("merge", "count", "split", "close", "apply") for n in ("Orders", "Prices", "Clients", "Letters"))
    model = own_model([("ts", plain)] * 20)
    assert O.judge(*files[0][:1], "src/a.ts", files[0][1], model) == ("generated", "template names")
    assert O.judge("ts", "src/a.ts", "// @generated by x\n" + files[0][1], model) == ("generated", "template names")
    for path in ("src/vendor/ours.ts", "src/generated/ours.ts", "src/external/ours.ts", "third_party/ours.ts"):
        assert O.judge("ts", path, plain, model) == (None, ""), path
    assert O.judge("ts", "src/vendor/somelib/a.ts", plain, model) == ("vendored", "path")
    mixed = "\n".join(f"export function readField{i}(box: Box): number {{\n  return box.field{i};\n}}" for i in range(12)) + "\n" + "\n".join(f"const {w}Name = 1;" for w in ("alpha", "beta", "gamma", "delta"))
    assert O.judge("ts", "src/generated/a.ts", mixed, model)[0] == "generated"


def own_model(files):
    import pandas as pd

    grams = {}
    for part in O._count(iter([pd.DataFrame(files, columns=["ext", "content"])])):
        for lang, gram, n in zip(part["lang"], part["gram"], part["n"]):
            grams.setdefault(lang, {})[gram] = n
    return O.NameModel(grams["TypeScript"] if "TypeScript" in grams else next(iter(grams.values())))
