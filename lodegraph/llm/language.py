"""Natural language hidden inside code (problem 5), by compression.

A phrase is encoded with zstandard dictionaries of each language and of code; the language of the shortest encoding wins, unless
code's is about as short. Zstandard finds few matches in a single sentence, so what it gets are the sentence's overlapping letter
groups: a word unknown to a dictionary still matches by the groups it shares with known ones. Groups of two go against a dictionary
of raw content, which ranks the languages; groups of three against a trained one with its entropy tables, for the first FINALISTS
and code. Both sizes add up.

The dictionaries are made from labelled documents, a bounded sample of a language (SAMPLE_DOCS documents of SAMPLE_CHARS characters)
without those whose letter trigrams are nearer to another language's, as some labels are wrong, and from the labelled text of seeds.py.
Latin text goes in a second time without accents, as many type so.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import cache
from math import sqrt

import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.code import code_files, per_text
from lodegraph.llm.seeds import SEEDS, WORDS
from lodegraph.llm.spans import passages

# The languages told apart.
LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "tr", "ja", "zh", "ko")
#: Parameters of the fit: documents of a language, characters of each, bytes of a dictionary of raw content and of a trained one.
SAMPLE_DOCS, SAMPLE_CHARS, RAW_BYTES, TRAINED_BYTES = 150, 800, 48_000, 30_000
#: Languages that the second encoding is made for.
FINALISTS = 3
#: A phrase's encoding may be at most this part of the one with code's dictionaries, and so much more for each different word, LINKS at
#: most, that holds sentences of its language together and is no word of code: English and code share most other words. Text in Han, kana
#: or hangul, which code has none of, gets one such allowance.
CODE_MARGIN, LINK_MARGIN, LINKS = 0.76, 0.16, 3
#: For a line on its own within a passage: the part of code's and of the next language's encoding.
STRICT_MARGIN, STRICT_NEXT = 0.7, 0.86
MIN_WORDS, MIN_CHARS = 5, 10
#: Remembered passages of a worker.
MEMO = 200_000

# Words of queries, styles, commands and programs, for the dictionary of code.
CODE_TEXT = """
select id, name, path, size from nodes where loc > 0 and value is not null order by id desc limit 10 group by having count(*) insert into table values (1, 2) update set delete from inner join left join on
delete from t where expires < now() and id in (select id from old_rows where deleted) returning id; select max(created) from events where kind = before or kind = after having sum(n) > 1; merge into t using s on t.id = s.id when matched then update
create table if not exists primary key foreign key references drop index alter column distinct union all as with begin commit
if (a && b) { return false; } else { x = foo(bar, baz); } for (i = 0; i < n; i++) total += v[i]; while (true) { break; } return cache.get(key, 0); old_value := load(path, true) def run(self, x): print(x)
const let var function class public static void int string null true false import export default async await new this try catch throw switch case
btn btn-primary px-4 py-2 flex items-center justify-between text-sm font-bold bg-white rounded shadow container row col-md-6 mt-4 mb-2 hover:bg-blue w-full h-full grid gap-4 border
get post put delete http host accept content-type application/json charset=utf-8 authorization bearer cache-control no-cache node:fs node:path node:url node:os utf-8 %y-%m-%d %h:%m:%s %s/%d/%s.json
ls -la grep -rn sed -i awk cat echo export path sudo apt-get install npm run build git commit -m docker run --rm -it python -m pip curl -s -o /dev/null chmod +x mkdir -p rm -rf cd usr local bin var tmp src lib
id path size loc language width height color margin padding display block none left right top bottom center index item list map key value type data error status code file line row column user order
"""

_MAP = str.maketrans({"ł": "l", "ß": "ss", "ı": "i", "ø": "o", "æ": "ae", "œ": "oe", "ñ": "n"})
_UML = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"})


def unaccented(text: str, umlauts: bool = False) -> str:
    text = (text.translate(_UML) if umlauts else text).translate(_MAP)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)) if not text.isascii() else text


_OTHER, _LATINS = re.compile("[가-힣ぁ-ヿ一-鿿㐀-䶿Ѐ-ӿ]"), re.compile("[a-zA-ZÀ-ɏ]")
_LATIN = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "tr")
_OTHERS = tuple(x for x in LANGS if x not in _LATIN)


def _candidates(text: str) -> tuple[str, ...]:
    """The languages whose letters a text could be in: those written in Latin letters, or the others."""
    if text.isascii() or not _OTHER.search(text):
        return _LATIN
    return _LATIN if len(_LATINS.findall(text)) > 2 * len(_OTHER.findall(text)) else _OTHERS


_LETTERS = re.compile(r"[^\W\d_]+")


def _joined(words: list[str]) -> str:
    """Words with their ends, which count as letters."""
    return " " + "  ".join(words) + " "


def _packed(t: str, k: int) -> bytes:
    if not t.isascii():
        return "".join([t[i : i + k] for i in range(len(t) - k + 1)]).encode()
    b = t.encode()
    n = len(b) - k + 1
    out = bytearray(k * max(0, n))
    for i in range(k):
        out[i::k] = b[i : i + n]
    return bytes(out)


def groups(text: str, k: int) -> bytes:
    """The overlapping groups of k letters of a text's words, one after the other; a word's ends count as letters."""
    return _packed(_joined(_LETTERS.findall(text.lower())), k)


def _trigrams(text: str) -> Counter:
    t = re.sub(r"[\W\d_]+", " ", text.lower())
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


def clean(labelled: dict[str, list[str]]) -> dict[str, list[str]]:
    """The texts that are nearest to their own label's centroid."""
    grams = {k: [_trigrams(x) for x in v] for k, v in labelled.items()}
    middle: dict[str, dict[str, float]] = {}
    for k, v in grams.items():
        c: Counter = Counter()
        for g in v:
            s = sum(g.values()) or 1
            for x, n in g.items():
                c[x] += n / s
        norm = sqrt(sum(x * x for x in c.values())) or 1
        middle[k] = {x: n / norm for x, n in c.items()}
    out = defaultdict(list)
    for k, v in labelled.items():
        for text, g in zip(v, grams[k]):
            if max(middle, key=lambda m: sum(n * middle[m].get(x, 0) for x, n in g.items())) == k:
                out[k].append(text)
    return dict(out)


def _phrases(lang: str, texts: list[str]) -> list[str]:
    """The distinct phrases that a language's dictionaries are made from, the most general last."""
    if lang == "code":
        rows = [x.split() for x in CODE_TEXT.lower().split("\n")]
        return [" ".join(w[i : i + 6]) for w in rows for i in range(0, len(w), 3)]
    out = []
    for t in texts:
        for s in _SENTENCE.split(t.lower()):
            s = " ".join(w for w in s.split() if not _ODD.search(w))
            if len(s) >= 12:
                out.append(s)
    words = WORDS.get(lang, "").replace("|", " ").lower().split()
    seed = [*(x for x in _SENTENCE.split(" ".join(SEEDS.get(lang, "").split()).lower()) if len(x) > 8), *(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))]
    out = [*dict.fromkeys(out), *seed, *seed]
    return out if lang in _OTHERS else [y for x in out for y in dict.fromkeys((x, unaccented(x), unaccented(x, True)))]


_SENTENCE = re.compile(r"(?<=[.!?。;:])\s*|\n")
_ODD = re.compile(r"[\d_`/=()<>{}\[\]#*]")


def dictionaries(labelled: dict[str, list[str]]) -> dict[str, tuple[bytes, bytes]]:
    """(raw content, trained dictionary) for each language, and `code`."""
    known = clean(labelled)
    out = {}
    for lang in (*LANGS, "code"):
        phrases = _phrases(lang, known.get(lang, []))
        raw = b"".join(dict.fromkeys(groups(x, 2) for x in phrases))[-RAW_BYTES:]
        trained = zstd.train_dictionary(TRAINED_BYTES, [groups(x, 3) for x in phrases] * 2).as_bytes()
        out[lang] = (raw, trained)
    return out


def labelled_sample(docs: DataFrame) -> dict[str, list[str]]:
    """A bounded sample of labelled documents by hash of their id; labels are cut to their language part."""
    lang = F.lower(F.substring("lang", 1, 2))
    own = docs.where("text is not null and length(text) > 20 and doc_id is not null").select("doc_id", "text", lang.alias("lang")).where(F.col("lang").isin(*LANGS))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, SAMPLE_DOCS / n)]), F.col("lang"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    out = defaultdict(list)
    for r in own.where(u < share).select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).sort("lang", "text").collect():
        out[r["lang"]].append(r["text"])
    return dict(out)


#: A word with the signs around it; not one in camel case. Runs of MIN_WORDS words are phrases, single signs between them don't count.
_WORD = r"(?>(?!\S*?[a-zß-ÿ][A-Z])[(\"'¿¡«\[*„“‘-]*[^\W\d_]+(?:['’\-.][^\W\d_]+)*['’]?[)\"'.,;:!?…»\]*”“’-]*(?!\S))"
_RUN = re.compile(rf"(?<!\S){_WORD}(?:(?:\s+[^\w\s](?!\S))*+\s+{_WORD}){{{MIN_WORDS - 1},}}+")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힣]")
_ESC = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([ntr])|\\([\"'`\\])")
_TAG = re.compile(r"^\W*(?:TODO|FIXME|HACK|NOTE|XXX)\b:?", re.M)
_END = re.compile(r"(?<=[.!?;])\s+|[。！？]\s*")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[4]:
            return " "
        if m[5]:
            return m[5]
        n = int(m[1] or m[2] or m[3], 16)
        return chr(n) if n < 0x110000 else m[0]

    out = _ESC.sub(one, text)
    try:
        return out.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return out


@cache
def _links(lang: str) -> frozenset[str]:
    """The words that hold sentences of a language together."""
    own = WORDS[lang].partition("|")[0].lower() if "|" in WORDS.get(lang, "") else ""
    return frozenset(y for x in own.split() for y in (x, unaccented(x), unaccented(x, True)) if len(y) > 1) - frozenset(CODE_TEXT.lower().split())


def _encoder(data: bytes, kind: int):
    p = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_DFAST, min_match=5, window_log=16, hash_log=14, chain_log=14, write_checksum=0, write_content_size=0, write_dict_id=0)
    d = zstd.ZstdCompressionDict(data, dict_type=kind)
    d.precompute_compress(compression_params=p)
    return zstd.ZstdCompressor(dict_data=d, compression_params=p).compress


#: Bytes of every encoding that hold no text.
_FRAME = 6


class Identifier:
    """Tells the language of passages; remembers those it has seen."""

    def __init__(self, dicts: dict[str, tuple[bytes, bytes]]):
        self.raw = {k: _encoder(v[0], zstd.DICT_TYPE_RAWCONTENT) for k, v in dicts.items()}
        self.trained = {k: _encoder(v[1], zstd.DICT_TYPE_FULLDICT) for k, v in dicts.items()}
        self.memo: dict[str, tuple[str, float, float]] = {}

    def score(self, text: str) -> tuple[str, float, float]:
        """The language of the shortest encoding, its part of code's less the allowance for linking words, and its part of the next language's."""
        got = self.memo.get(text)
        if got is not None:
            return got
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = _LETTERS.findall(text.lower())
        t = _joined(words)
        two, three = _packed(t, 2), _packed(t, 3)
        sizes = sorted((len(self.raw[k](two)), k) for k in _candidates(text))[:FINALISTS]
        sizes = sorted((n + len(self.trained[k](three)) - 2 * _FRAME, k) for n, k in sizes)
        code = len(self.raw["code"](two)) + len(self.trained["code"](three)) - 2 * _FRAME
        best = sizes[0][1]
        links = 1 if best in ("ja", "zh", "ko") else min(LINKS, len(_links(best).intersection(words)))
        got = self.memo[text] = (best, sizes[0][0] / code - LINK_MARGIN * links, sizes[0][0] / sizes[1][0])
        return got

    def phrase(self, text: str, strict: bool = False) -> str | None:
        """The language of one phrase, or None where it looks like code; strict asks for a wide margin over the next language too."""
        lang, code, following = self.score(text)
        if strict:
            return lang if code <= STRICT_MARGIN and following <= STRICT_NEXT else None
        return lang if code <= CODE_MARGIN else None

    def natural(self, passage: str) -> list[tuple[str, int]]:
        """(language, characters) of the phrases of a passage; a line that is surely in another language than its passage counts for itself."""
        text = unescape(passage)
        wide = len(_CJK.findall(text)) >= MIN_CHARS
        if not wide and text.count(" ") + text.count("\n") < MIN_WORDS - 1:
            return []
        text = _TAG.sub("", text)
        out = []
        for part in _END.split(text):
            out += self._runs(part, wide)
        if "\n" in text:
            known = {k for k, _ in out}
            for row in text.split("\n"):
                out += [x for x in self._runs(row, wide, True) if x[0] not in known]
        return out

    def _runs(self, part: str, wide: bool, strict: bool = False) -> list[tuple[str, int]]:
        out = []
        if wide and (n := len(_CJK.findall(part))) >= MIN_CHARS:
            lang = self.phrase(" ".join(w for w in part.split() if _CJK.search(w)), strict)
            if lang in ("ja", "zh"):
                return [(lang, n)]
        for m in _RUN.finditer(part):
            run = [w for w in (x.strip("\"'()[]*«»„“”.,;:!?") for x in m[0].split()) if len(w) > 1 or w.isalnum()]
            if (lang := self.phrase(" ".join(run), strict)) and lang not in ("ja", "zh"):
                out.append((lang, sum(map(len, run)) + len(run) - 1))
        return out


@cache
def _identifier(items: tuple) -> Identifier:
    return Identifier(dict(items))


def _shares(dicts: dict[str, bytes]):
    items = tuple(sorted(dicts.items()))

    def run(ext: str, text: str) -> str | None:
        own = _identifier(items)
        n: Counter = Counter()
        for _, body in passages(ext, text):
            for lang, k in own.natural(body):
                n[lang] += k
        return " ".join(f"{k}:{v}" for k, v in sorted(n.items())) or None

    return run


def language_shares(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(file_id, nl_lang, chars, share): the languages in the comments and literals of each code file, share of its characters.

    Only phrases of MIN_WORDS words, in Japanese and Chinese MIN_CHARS characters, count. Null and empty content has none; rows
    that are there twice count once; without any labelled document there are no rows.
    """
    sample = labelled_sample(docs)
    dicts = dictionaries(sample) if sample else {}
    own = code_files(files).where("content is not null and content <> ''" if dicts else "false")
    own = own.select("file_id", F.length("content").alias("n"), per_text(_shares(dicts), "string", F.col("ext"), F.col("content")).alias("s")).where("s is not null")
    own = own.dropDuplicates(["file_id"]).select("file_id", "n", F.explode(F.split("s", " ")).alias("s"))
    lang, chars = F.substring_index("s", ":", 1), F.substring_index("s", ":", -1).cast("bigint")
    return own.select("file_id", lang.alias("nl_lang"), chars.alias("chars"), (chars / F.col("n")).alias("share"))


def languages_in_code(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(file_id, nl_lang) of language_shares."""
    return language_shares(files, docs).select("file_id", "nl_lang")
