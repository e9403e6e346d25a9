"""Visually identical text in one form (problem 8).

A quick-check class holds every character whose presence can make a text unstable: those that NFC may change, width forms,
joined letters, invisible characters and kinds of space. Stable texts are told by a quick check. In the others each run of such
characters is taken with the one character before it (the only context that composition can reach), normalised alone and
spliced back; all other text is copied.

Look-alike letters are folded per character. `canonical_text` folds them only inside words that mix scripts, into the script
of the word's unmistakable letters; `look_key` folds all of them, so that it serves comparison only.

Defined results: null stays null, the empty text stays empty; line breaks and tabs are never changed; joiners stay between
letters whose shape depends on them.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut

# Letters of other scripts that look like Latin letters, after the public list of confusable characters.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮҺԌԚԜавесѕіјкмнорстухүһԁԛԝѵѴѡӏӀ", "ABESIJKMHOPCTYXYHGQWaвecsijкмнopcтyxyhdqwvVwlI"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳαιρυγϹͿ", "ABEZHIKMNOPTYXovcjaipuyCJ"),
    "Armenian": ("ՍՏՕօոսցհզյ", "USOonughqj"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "Lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    "Coptic": ("ⲀⲂⲈⲌⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEZHIKMNOPCTYXopc"),
}
#: Invisible characters besides the joiners.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​‎‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
SHAPED = "؀-෿☀-➿️\U0001f000-\U0001faff"
JOINED = [*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0xB5, 0x17F]


@cache
def _folds() -> dict[int, str]:
    """Single characters that are replaced whatever stands around them."""
    out = {}
    for i in range(0x80, 0x20000):
        c = chr(i)
        kind = unicodedata.decomposition(c).partition(">")[0]
        if kind in ("<wide", "<narrow") or (i in JOINED and i != 0x17F):
            out[i] = unicodedata.normalize("NFKC", c)
        elif unicodedata.category(c) == "Zs":
            out[i] = " "
    return out


@cache
def _plain() -> dict[int, str]:
    """Letters and digits in the styles of formulas, and Roman numerals, which look like plain ones."""
    out = {i: unicodedata.normalize("NFKC", chr(i)) for i in range(0x2160, 0x2180) if unicodedata.decomposition(chr(i))}
    for i in [*range(0x2100, 0x2150), *range(0x1D400, 0x1D800)]:
        if unicodedata.decomposition(chr(i)).startswith("<font>"):
            out[i] = unicodedata.normalize("NFKC", chr(i))
    return out


@cache
def _plain_run() -> re.Pattern:
    """Words in such a style; a single letter is a sign of a formula and stays."""
    return re.compile(f"[{_ranges(sorted(_plain()))}]{{2,}}")


def _ranges(codes: list[int]) -> str:
    """The inside of a character class."""
    out, start = [], None
    for a, b in zip(codes, [*codes[1:], sys.maxunicode + 9]):
        start = a if start is None else start
        if b != a + 1:
            out.append((start, a))
            start = None
    return "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in out)


@cache
def unstable_class() -> str:
    """All characters that can make a text unstable, as the inside of a character class of Python and of Java."""
    codes = set(_folds())
    for i in range(0x80, 0x30000):
        c = chr(i)
        if unicodedata.category(c) in ("Mn", "Mc") or not unicodedata.is_normalized("NFC", c):
            codes.add(i)
    codes |= {*range(0x1100, 0x1200)}
    return _ranges(sorted(codes)) + INVISIBLE + "‌‍"


@cache
def _run() -> re.Pattern:
    return re.compile(f"[{unstable_class()}]+")


#: Characters that are stable in any context, in few ranges: the quick check of a text.
SURE = (
    r"\x00-\x9f\u00a1-\u00ac\u00ae-\u00b2\u00b6-\u0131\u0134-\u01c3\u01cd-\u01f0\u01f4-\u02af\u0370-\u0373\u0384-\u0386\u0388-\u0482\u048a-\u058f"
    r"\u2010-\u2027\u2030-\u205e\u20a0-\u20cf\u2190-\u21ff\u3001-\u3029\u3041-\u3096\u309d-\u30ff\u3131-\u3163\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3"
)


_GONE = re.compile(f"[{INVISIBLE}]|(?<![{SHAPED}])[‌‍]|[‌‍](?![{SHAPED}])")


def _stable(segment: str) -> str:
    return unicodedata.normalize("NFC", _GONE.sub("", segment).translate(_folds()))


def normalise(text: str | None) -> str | None:
    """One text with its unstable segments replaced."""
    if not text or text.isascii():
        return text
    out, done = [], 0
    for m in _run().finditer(text):
        start = max(done, m.start() - 1)  # the boundary context
        out += text[done:start], _stable(text[start : m.end()])
        done = m.end()
    return "".join(out) + text[done:] if done else text


@cache
def look_table() -> tuple[str, str]:
    """From and to, for one-character replacement; composed letters are in it where the Latin one is composed too."""
    pairs = {}
    for theirs, ours in LOOK_ALIKES.values():
        pairs |= {a: b for a, b in zip(theirs, ours, strict=True) if a != b}
    for i in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(i))
        if len(d) > 1 and d[0] in pairs and len(c := unicodedata.normalize("NFC", pairs[d[0]] + d[1:])) == 1:
            pairs[chr(i)] = c
    return "".join(pairs), "".join(pairs.values())


@cache
def _mixed() -> tuple[re.Pattern, dict[int, str], dict[str, dict[int, str]]]:
    a, b = look_table()
    to_latin = {ord(x): y for x, y in zip(a, b)}
    back = {}
    for script, (theirs, ours) in LOOK_ALIKES.items():
        back[script] = {ord(y): x for x, y in reversed([*zip(theirs, ours)])}
    other = "Ͱ-֏ἀ-῿Ꭰ-Ᏼꓐ-ꓽⲀ-ⳮ"
    # whole words with such a letter; from their starts alone, so that a long word is read once
    word = re.compile(f"(?<![^\\W\\d_])(?:(?![{other}])[^\\W\\d_])*+[{other}][^\\W\\d_]*+")
    return word, to_latin, back


_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_BLOCKS = [
    ("Greek", 0x370, 0x400), ("Cyrillic", 0x400, 0x530), ("Armenian", 0x530, 0x590), ("Cherokee", 0x13A0, 0x1400), ("Greek", 0x1F00, 0x2000), ("Coptic", 0x2C80, 0x2D00), ("Lisu", 0xA4D0, 0xA500),
]


def _unmix(m: re.Match) -> str:
    _, to_latin, back = _mixed()
    w = m[0]
    if not _LATIN.search(w):
        return w
    odd = [c for c in w if ord(c) >= 0x370 and ord(c) not in to_latin]
    if not odd:
        return w.translate(to_latin)
    c = ord(odd[0])
    script = next((name for name, first, end in _BLOCKS if first <= c < end), None)
    if script is None:
        return w
    turned = w.translate(back[script])
    return turned if not _LATIN.search(turned) else w


#: What a text that changes holds: a character that isn't surely stable, or a letter of a script with look-alikes.
_CHANGEABLE = re.compile(f"[^{SURE}]|[Ͱ-֏]")


def canonical(text: str | None) -> str | None:
    """The consistent form of one text."""
    if not text or text.isascii() or not _CHANGEABLE.search(text):
        return text
    text = _plain_run().sub(lambda m: m[0].translate(_plain()), normalise(text))
    return unicodedata.normalize("NFC", _mixed()[0].sub(_unmix, text))


def _udf(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def _wide(text: Column, f) -> Column:
    """f over the texts that are not ASCII, told by their bytes; the others never leave the JVM."""
    wide = F.octet_length(text) != F.length(text)
    return F.when(wide, _udf(f)(F.when(wide, text))).otherwise(text)


def canonical_text(text: Column) -> Column:
    """The consistent form of a text column."""
    return _wide(text, canonical)


@cache
def _look_map() -> dict[int, str]:
    a, b = look_table()
    return {ord(x): y for x, y in zip(a, b)}


_UNSURE = re.compile(f"[^{SURE}]")


def _folded(text: str, table: dict[int, str]) -> str:
    """text.translate(table) for a table no result of which is replaced again: one search for each different character that is."""
    for c in set(text):
        if (to := table.get(ord(c))) is not None:
            text = text.replace(c, to)
    return text


def _look(text: str) -> str:
    # composition runs after the letters are folded, as a mark may follow a look-alike
    text = _folded(text, _look_map())
    return _settled(text) if _UNSURE.search(text) else text


def look_key(text: Column) -> Column:
    """Equal for texts that look the same; only for comparison. ASCII texts, told by their bytes, are their own keys."""
    return _wide(text, _look)


def _settled(text: str) -> str:
    """Normalised, then folded once more: a narrow or composed form may have given a look-alike."""
    return unicodedata.normalize("NFC", _folded(_folded(normalise(text), _plain()), _look_map()))


#: Rows of one text beyond which they are split.
HOT = 50_000


def _members(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, look, exact, salt) of the documents with text, and (look, exact, n, salts, total) of the different texts that others look like."""
    own = docs.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(doc_id).isNotNull())
    key = F.md5(look_key(F.col(text)).cast("binary"))
    own = own.select(F.col(doc_id).alias("id"), key.alias("look"), F.md5(F.col(text).cast("binary")).alias("exact")).distinct()
    own = cut(own)  # the texts are read and folded once
    kinds = own.groupBy("look", "exact").agg(F.count("*").alias("n"))
    mixed = kinds.groupBy("look").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("k > 1").select("look", "total")
    kinds = cut(kinds.join(mixed, "look").withColumn("salts", F.ceil(F.col("n") / HOT).cast("int")))
    # a text that many documents have is spread over its salts; there are few such texts
    hot = kinds.where("salts > 1").select("exact", "salts")
    salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))
    return own.join(hot, "exact", "left").select("id", "look", "exact", salt.cast("int").alias("salt")), kinds


def _spread(kinds: DataFrame, salts: str, salt: str) -> DataFrame:
    return kinds.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(salts) - 1)))


def same_look_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, look_class, text_class, links): each document that looks like one with another text.

    Documents of one look_class look the same, those of one text_class are equal; links counts the documents that look the same
    and aren't equal. Null and empty texts are in no class. There is one row a document, however large a class is.
    """
    own, kinds = _members(docs, doc_id, text)
    out = own.join(_spread(kinds, "salts", "salt").drop("look"), ["exact", "salt"])
    return out.select(F.col("id").alias(doc_id), F.col("look").alias("look_class"), F.col("exact").alias("text_class"), (F.col("total") - F.col("n")).alias("links"))


def same_look_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): documents, a < b, whose texts look the same but aren't equal: the classes above, written out as pairs.

    Classes of equal texts are paired before their members are, so that copies of one text are never compared with each
    other, however many there are. Null and empty texts are in no pair.
    """
    own, kinds = _members(docs, doc_id, text)
    side = lambda x: kinds.select("look", F.col("exact").alias(f"e{x}"), F.col("salts").alias(f"n{x}"))
    pairs = side("a").join(side("b"), "look").where("ea < eb").drop("look")
    for x in "ab":
        ids = own.select(F.col("exact").alias(f"e{x}"), F.col("salt").alias(f"s{x}"), F.col("id").alias(x))
        pairs = _spread(pairs, f"n{x}", f"s{x}").join(ids, [f"e{x}", f"s{x}"])
    return pairs.where("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()
