"""The form of numbers, heredoc words with digits, and deep nesting."""

import pytest

from lodegraph.llm import syntax as S


@pytest.mark.parametrize(
    "ext,text,valid",
    [
        ("py", "os.chmod(p, 0755)\n", False), ("py", "x = 08\n", False), ("py", "x = 0b12\n", False), ("py", "x = 0o78\n", False), ("py", "x = 00 + 0 + 0_0 + 08.5 + 01e5 + 09j + 0o17 + 0x08 + 0b11 + 10 + x08 + 1_08\n", True),
        ("java", "class A { int x = 08; }\n", False), ("java", "class A { long x = 019L; }\n", False), ("java", "class A { int x = 017; double y = 08.5; double z = 09d; int w = 0x09; }\n", True),
        ("go", "package a\n\nvar x = 09\n", False), ("go", "package a\n\nvar x = 0755\nvar y = 08.5\nvar z = 0x09\n", True), ("c", "int x = 08;\n", False), ("c", "int x = 0755;\ndouble y = 09.5;\nint z = 0x09u;\n", True),
        ("js", "var x = 08;\n", True), ("rs", "fn main() { let x = 08; }\n", True),
        ("sh", "cat <<EOF1 <<EOF2\nif (\nEOF2\nEOF1\nif (\nEOF2\n", True), ("sh", "cat <<EOF1\nEOF2\nif (\nEOF1\n", True),
    ],
)
def test_forms(ext, text, valid):
    assert S.check(ext, text).valid == valid


@pytest.mark.parametrize("ext,a,b", [("py", "x = " + "(" * 3000 + "1", ")" * 3000 + "\n"), ("js", "x = " + "[" * 3000 + "1", "]" * 3000 + ";\n"), ("java", "class A { int x = " + "(" * 3000 + "1", ")" * 3000 + "; }\n")])
def test_deep_nesting(ext, a, b):
    assert S.check(ext, a + b).valid and not S.check(ext, a + b[1:]).valid
