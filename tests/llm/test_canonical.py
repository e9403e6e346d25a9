"""Texts that look the same."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodegraph.llm import canonical as C

SAME = [
    ("Order 12", "Ｏｒｄｅｒ　１２"), ("café", "cafe\u0301"), ("zero width", "zero\u200b wi\u200ddth\ufeff"), ("soft", "so\u00adft"), ("a b", "a\u00a0b"), ("a b", "a\u202fb"), ("file", "\ufb01le"), ("check", "сhесk"), ("The", "Τhe"), ("カ", "ｶ"), ("ガ", "ｶﾞ"),
    ("Kelvin", "\u212aelvin"), ("eщё", "ещё"), ("ё", "e\u0308"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("a\nb", "a b"), ("a\tb", "a b"), ("1", "l"), ("x²", "x2"), ("a  b", "a b"), ("word", "words"), ("①", "1")]


def key(text):
    a, b = C.look_table()
    return C._settled(text.translate({ord(x): y for x, y in zip(a, b)}))


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert key(a) == key(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert key(a) != key(b)


def test_canonical_repairs_mixed_words_only():
    assert C.canonical("Это сhесk") == "Это check"
    assert C.canonical("кaждый") == "каждый"
    assert C.canonical("сохо") == "сохо"
    assert C.canonical(None) is None and C.canonical("") == ""


@given(st.text())
def test_idempotent_and_stable_outside(text):
    once = C.normalise(text)
    assert C.normalise(once) == once
    if unicodedata.is_normalized("NFC", text) and not any(c in text for c in map(chr, C._folds())) and not C._GONE.search(text):
        assert once == text


@given(st.text(alphabet="ab éñ\u0301\u0308한ᄒ\u1161\u11abｶﾞ\u200b\u00a0\ufb01К"))
def test_segments_equal_whole(text):
    whole = unicodedata.normalize("NFC", C._GONE.sub("", text).translate(C._folds()))
    assert C.normalise(text) == whole


def test_quick_check_is_safe():
    import re

    sure, odd = re.compile(f"[{C.SURE}]"), re.compile(f"[{C.unstable_class()}]")
    assert not [i for i in range(0x30000) if not 0xD800 <= i < 0xE000 and sure.match(chr(i)) and odd.match(chr(i))]


def test_pairs(spark):
    rows = [(1, "check it"), (2, "сhесk it"), (3, "check it"), (4, "Check it"), (5, None), (6, ""), (7, "\u200b"), (8, "x" * 50_000), (9, "x" * 50_000 + "\u00ad")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    d = d.selectExpr("*", "1 as look", "2 as exact", "3 as id", "4 as ea")
    assert sorted(map(tuple, C.same_look_pairs(d).collect())) == [(1, 2), (2, 3), (8, 9)]
    assert C.same_look_pairs(d.limit(0)).count() == 0
    from pyspark.sql import functions as F

    got = {r[0]: r[1] for r in d.select("doc_id", C.canonical_text(F.col("text")).alias("t")).collect()}
    assert got[2] == "check it" and got[5] is None and got[6] == ""


@pytest.mark.parametrize("a,b", [("paypal", "ρaypal"), ("ABC", "ᎪᏴᏟ"), ("paypal", "𝐩𝐚𝐲𝐩𝐚𝐥"), ("IV", "Ⅳ"), ("HELLO", "ꓧꓰꓡꓡꓳ"), ("Open", "Ⲟpen"), ("paypal", "pаypаl"), ("value", "ѵalue"), ("R", "ℝ")])
def test_more_letters(a, b):
    assert key(a) == key(b)


def test_canonical_styles():
    assert C.canonical("𝐩𝐚𝐲𝐩𝐚𝐥 login") == "paypal login" and C.canonical("ρaypal") == "paypal"
    assert C.canonical("let 𝑥 be") == "let 𝑥 be" and C.canonical("λόγος") == "λόγος" and C.canonical("ᎪᏂ") == "ᎪᏂ"


def test_classes_and_hot_texts(spark, monkeypatch):
    """A third of all documents are copies of one text; classes hold each document once, pairs equal brute force."""
    monkeypatch.setattr(C, "HOT", 7)
    rows = [(i, "check it" if i % 3 == 0 else "сhесk it" if i % 10 == 1 else f"text {i}") for i in range(90)] + [(200, "ϲheck it"), (201, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    same = {i: t for i, t in rows if t and t.endswith(" it")}
    want = sorted((a, b) for a in same for b in same if a < b and same[a] != same[b])
    assert sorted(map(tuple, C.same_look_pairs(d).collect())) == want
    got = {r["doc_id"]: r for r in C.same_look_classes(d).collect()}
    assert set(got) == set(same) and len({r["look_class"] for r in got.values()}) == 1 and len({r["text_class"] for r in got.values()}) == 3
    assert all(r["links"] == sum(i in p for p in want) for i, r in got.items())
    assert C.same_look_classes(d.limit(0)).count() == 0


def test_tables_are_not_chained():
    for table in (C._look_map(), C._plain()):
        assert not {ord(c) for v in table.values() for c in v} & set(table)
    text = "pаypаl ρ 𝐩 ⅣЅ plain"
    assert C._folded(text, C._look_map()) == text.translate(C._look_map()) and C._folded(text, C._plain()) == text.translate(C._plain())


@pytest.mark.parametrize("part", ["é", "ﬁ", "аa", "́", "ρ", "a​"])
def test_long_words_in_linear_time(part):
    import time

    began = time.time()
    C.canonical(part * 60_000), C._look(part * 60_000)
    assert time.time() - began < 5
