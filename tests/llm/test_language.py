"""Natural language in comments and literals."""

import random

import pytest

from lodegraph.llm import language as L
from lodegraph.llm.spans import passages

TEXTS = {
    "en": "The nightly importer keeps a copy of the cached list of packages. This helper should never drop the longest path in the tree because the order matters here.",
    "de": "Der nächtliche Import behält die zwischengespeicherten Pakete. Diese Hilfsfunktion darf niemals den längsten Pfad im Baum verwerfen, weil die Reihenfolge wichtig ist.",
    "es": "La importación nocturna guarda una copia de la lista de paquetes guardados. Esta función auxiliar nunca debe perder el camino más largo del árbol porque aquí importa el orden.",
    "ru": "Ночной импорт хранит список сохранённых пакетов. Эта вспомогательная функция никогда не должна терять самый длинный путь в дереве потому что порядок здесь важен.",
    "ja": "夜間の取り込み処理は保存されたパッケージの一覧をまとめて保存します。この補助関数は木の中で最も長いパスを失ってはいけません。",
    "ko": "야간 가져오기 작업은 저장된 패키지 목록을 따로 보관합니다. 이 보조 함수는 트리에서 가장 긴 경로를 잃어버리면 안 됩니다.",
    "zh": "夜间导入程序会保留已缓存软件包列表的副本。这个辅助函数绝不能丢失树中最长的路径因为顺序很重要。",
}


@pytest.fixture(scope="module")
def own():
    return L.Identifier(L.dictionaries({k: [v] * 3 for k, v in TEXTS.items()}))


def langs(own, ext, text):
    return {k for _, b in passages(ext, text) for k, _ in own.natural(b)}


def test_each(own):
    for lang, text in TEXTS.items():
        assert {k for k, _ in own.natural(text)} == {lang}


def test_where(own):
    assert langs(own, "py", "# The nightly importer keeps\n# a copy of the cached\n# list of packages\nx = 1") == {"en"}
    assert langs(own, "go", "/*\n * Der nächtliche Import behält\n * die zwischengespeicherten Pakete\n */") == {"de"}
    assert langs(own, "ts", "const a = 'La importaci\\u00f3n nocturna guarda una copia de la lista';") == {"es"}
    assert langs(own, "ts", "const a = 'La importacion nocturna guarda una copia de la lista';") == {"es"}
    assert langs(own, "js", "x = /[\"'`]+/g; // Der naechtliche Import behaelt die zwischengespeicherten Pakete") == {"de"}
    assert langs(own, "sh", "cat <<EOT\nThe nightly importer keeps a copy of the cached list\nEOT\n") == {"en"}
    assert langs(own, "rs", "let x: &'a str = r#\"夜間の取り込み処理は保存されたパッケージの一覧\"#;") == {"ja"}


def test_not_language(own):
    for t in ['"SELECT id, loc FROM nodes WHERE loc > 0 ORDER BY id"', "// if (a && b) { flush(q); }", "// return cache.get(key, 0);", '"btn btn-primary px-4 py-2 flex items-center"', '"id path size loc language"', '"src/a/b.ts src/c/d.ts src/e/f.ts x y"', "// four words are few", '"%s %d %s %d %s %d"']:
        assert langs(own, "ts", t) == set(), t


def test_held_out_accuracy():
    """Labels with a tenth of them wrong; sentences of documents that weren't in the fit."""
    rng = random.Random(4)
    labelled = {k: [" ".join(rng.sample(v.replace("。", "。 ").split(), len(v.replace("。", "。 ").split()))) + " " + v for _ in range(20)] for k, v in TEXTS.items()}
    labelled["en"][:2] = labelled["de"][5:7]
    kept = L.clean(labelled)
    assert len(kept["en"]) == 18
    own = L.Identifier(L.dictionaries(labelled))
    right = sum(own.phrase(" ".join(x.strip(".。,") for x in v.split())) == k for k, v in TEXTS.items())
    assert right >= 6


def test_queries(spark):
    docs = spark.createDataFrame([(i * 10 + j, (k.upper() if j % 2 else k + "-XX"), v) for i, (k, v) in enumerate(TEXTS.items()) for j in range(4)] + [(900, None, "x"), (901, "en", None), (902, "en", "")], "doc_id bigint, lang string, text string").selectExpr("*", "1 as n")
    rows = [(1, "a.py", "# The nightly importer keeps a copy of the cached list of packages"), (1, "a.py", "# The nightly importer keeps a copy of the cached list of packages"), (2, "b.ts", None), (3, "c.go", ""), (4, "d.md", TEXTS["en"]), (5, "e.js", "// " + "Der nächtliche Import behält die zwischengespeicherten Pakete. " * 3000)]
    f = spark.createDataFrame(rows, "file_id bigint, path string, content string").selectExpr("*", "1 as s", "2 as lang", "3 as n")
    assert sorted(map(tuple, L.languages_in_code(f, docs).collect())) == [(1, "en"), (5, "de")]
    assert 0.5 < L.language_shares(f, docs).where("file_id = 1").first()["share"] <= 1
    assert L.languages_in_code(f.limit(0), docs).count() == 0
    assert L.languages_in_code(f, docs.limit(0)).count() == 0


def test_sentences_of_other_wording():
    """Sentences that share no wording with the labelled ones, and spans that only look like text."""
    from tests.llm.heldout import CODE_LIKE, FRESH, HELD_OUT

    own = L.Identifier(L.dictionaries({}))
    for lang, text in HELD_OUT.items():
        rows = text.split("\n")
        assert len(rows) >= 20
        assert sum({k for k, _ in own.natural(x)} == {lang} for x in rows) >= 0.8 * len(rows), lang
    every = [(lang, x) for lang, text in HELD_OUT.items() for x in text.split("\n")]
    assert sum({k for k, _ in own.natural(x)} == {lang} for lang, x in every) >= 0.9 * len(every)
    fresh = [(lang, x) for lang, text in FRESH.items() for x in text.split("\n")]
    assert sum({k for k, _ in own.natural(x)} == {lang} for lang, x in fresh) >= 0.9 * len(fresh)
    assert sum(bool(own.natural(x)) for x in CODE_LIKE) <= 0.02 * len(CODE_LIKE)


def test_distance_does_not_matter():
    text = "x = ('The nightly importer keeps'" + " " * 60 + "+ ' a copy of the cached list')"
    assert passages("ts", text) == [("s", "The nightly importer keeps a copy of the cached list")]
    far = " " * 500
    assert passages("py", f"{far}# one line\n{far}# and the next\n") == [("c", " one line\n and the next")]
    assert passages("py", "x = 1 # one\ny = 2 # two\n") == [("c", " one"), ("c", " two")]


def test_here_documents():
    text = "x=$((1 << y))\ncat <<EOT\n# inside\nwords\n  EOT\necho # outside\ncat <<'B'\nnever ended\n"
    assert passages("sh", text) == [("s", "# inside\nwords"), ("c", " outside"), ("s", "B")]


def test_long_texts_in_linear_time():
    import time

    for ext, part in (("sh", "<<EOT\n"), ("ts", "/* "), ("py", '"""'), ("ts", "`"), ("c", '"'), ("rs", 'r#"')):
        began = time.time()
        passages(ext, part * 40_000)
        assert time.time() - began < 5, ext
