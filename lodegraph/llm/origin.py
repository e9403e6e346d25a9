"""Generated, minified or vendored source files and data stored as code (problem 3).

Character trigram models of identifiers are counted for each language over all files; every file's own identifiers are judged by
them before anything else. Mangled names have a high cross-entropy, are short, and often stand in text without layout; names made
from a template lose their diversity once their digits are dropped; names in another style than the repository's own mark a copy
where the file carries a licence line. One large literal is data. Only what names can't tell is decided by comments and paths: an
unchanged copy, or code from a generator that names things as people do, has names like any other. A path decides only where
it has the form that a package manager or tool gives it; a directory's name alone doesn't. Text in literals is never taken for a header.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.code import code_files, per_text
from lodegraph.llm.spans import without
from lodegraph.llm.syntax import LANGUAGES
from lodegraph.session import cut

#: Parameters. A mangled file's names cost so many bits a character more than its language's mean; a template leaves so few distinct names.
MANGLED_BITS, TEMPLATE_SHARE, TEMPLATE_NAMES = 0.25, 0.2, 8
#: Names that a task holds before it turns them into trigrams.
NAMES_HELD = 200_000
#: A data file's literals hold this part of its characters, and so many at least.
DATA_SHARE, DATA_CHARS = 0.88, 300
#: Text without layout: characters of the longest line, white space a character.
LONG_LINE, SPACE_SHARE = 300, 0.13

#: A share of short names that tells, and how much more counts as much as MANGLED_BITS; the weight of missing layout; the sum from which names are
#: mangled: two full signs and a bit, or short names nearly all. Distinct names that are needed, and where there is layout.
SHORT_SHARE, SHORT_SPAN, LAYOUT_WEIGHT, MANGLED_SCORE, NAMES_LEAST, NAMES_LAID_OUT = 0.6, 0.18, 1.25, 2.3, 8, 20

# Directories and names that tools and package managers use.
VENDOR_DIRS = re.compile(r"(?:^|/)(?:vendor|vendors|vendored|_vendor|third[_-]?party|external|externals|extern|deps|node_modules|bower_components|jspm_packages|site-packages|dist-packages|Pods|Carthage|Godeps)/[^/]+/", re.I)
#: A directory's name that supports half a template.
GENERATED_DIRS = re.compile(r"(?:^|/)(?:generated|gen|codegen)/", re.I)
TOOL_PATHS = re.compile(
    r"(?:^|/)(?:__generated__|autogen|autogenerated|build/generated|generated-sources|gen-src)/|(?:^|/)target/(?:out|debug|release|generated)|_pb2(?:_grpc)?\.pyi?$|\.pb(?:-c|\.gw|\.validate)?\.(?:go|h|c|cc|ts|js)$|_pb\.(?:js|ts|d\.ts)$|[._](?:generated|gen|g|designer)\.\w+$|\.tab\.[ch]$|(?:^|/)lex\.yy\.c$|zz_generated",
    re.I,
)
MINIFIED_PATHS = re.compile(r"[.-]min\.[cm]?js$|\.bundle\.[cm]?js$|\.chunk\.[cm]?js$|(?:^|/)dist/.*\.[cm]?js$|[-.][0-9a-f]{8,20}\.[cm]?js$", re.I)
GENERATED = re.compile(
    r"@generated\b|<auto-generated|\bauto-?generated\b|\bautomatically (?:generated|created|produced)|\bcode generated (?:by|from)\b|\b(?:this )?(?:file|code|module) (?:is|was|has been) (?:auto\w*[ -])?(?:generated|produced|created) (?:by|from|with)\b|^[^\w\n]*generated(?: by| from|:)|(?-i:\bDO NOT (?:EDIT|MODIFY)\b)"
    r"|\bdo not (?:edit|modify|change) (?:this|it|by hand|manually|the file)|changes .{0,40}will be (?:lost|overwritten)|^[^\w\n]*source: \S+\.(?:proto|thrift|graphql|avsc|fbs|idl|yaml|json)\b"
    r"|automatisch (?:erzeugt|generiert|erstellt|gegenereerd)|(?:produit|généré|genere|créé)e? (?:automatiquement|par un outil)|(?:gerado|generado) (?:automaticamente|automáticamente|por una? )|generato (?:automaticamente|da uno strumento)|wygenerowan\w* automatycznie|automatycznie wygenerowan|создан\w* автоматически|автоматически (?:создан|сгенерирован)|сгенерирован\w* автоматически"
    r"|otomatik olarak (?:oluşturul|üretil)|自動生成|自动生成|自動產生|자동(?:으로)? 생성",
    re.I | re.M,
)
UPSTREAM = re.compile(r"\bupstream (?:distribution|release|copy|version|source)|\bthird[- ]party (?:code|copy|library)\b.*\blicen[sc]e|\bvendored (?:from|copy)|\bcopied from https?://", re.I)
VERSION = re.compile(r"^[^\w\n]*(?!(?i:version) \d[\d.]*(?:, \w+ \d{4}\b| of the\b))(?:[\w.-]+(?: [\w.-]+)?,? )v?\d+\.\d+(?:\.\d+)?\b", re.M)
LICENSE = re.compile(r"\blicen[sc]ed?\b|\(c\)|©|\bcopyright\b|\bMIT\b|\bBSD\b|\bApache\b|\bMPL\b|\bISC\b", re.I)
NEGATED = re.compile(r"\bnot (?:auto)?generated|hand[- ]written|written by hand|\bno longer generated", re.I)

_IDENT = re.compile(r"[^\W\d]\w*|\$\w+")
_NOISE = re.compile(r"^(?:```.*|@@ .*|---.*|\+\+\+.*|diff .*|index .*|#!.*|set -\w+|['\"]use strict['\"];?|<\?.*|!\w.*|>>> .*|[a-z_]+: [\w .-]*|<{7}.*|={7}|>{7}.*)$")
_DIGITS = re.compile(r"\d+")
_DIRECTIVES = ("#include", "#define", "#if", "#pragma", "#[", "#!")


def _rows(text: str) -> Iterator[str]:
    """The lines from the start, one by one."""
    at = 0
    while (e := text.find("\n", at)) >= 0:
        yield text[at:e]
        at = e + 1
    yield text[at:]


def _rows_back(text: str) -> Iterator[str]:
    """The lines from the end, one by one."""
    e = len(text.rstrip())
    while (at := text.rfind("\n", 0, e)) >= 0:
        yield text[at + 1 : e]
        e = at
    yield text[:e]


def header(text: str) -> str:
    """The comment lines before the first line of code, however many."""
    out, inside = [], ""
    for row in _rows(text):
        s = row.strip().lstrip("﻿")
        if s[:1] == "+" and not inside:
            s = s[1:].lstrip()
        if inside:
            out.append(s)
            if inside in s:
                inside = ""
            continue
        if not s or _NOISE.match(s):
            continue
        if s.startswith(("//", "#", "--", ";;")) and not s.startswith(_DIRECTIVES):
            out.append(s)
        elif s.startswith(("/*", "<!--")):
            out.append(s)
            inside = "" if ("*/" in s or "-->" in s) else "*/" if s.startswith("/*") else "-->"
            if not inside and s.rpartition("*/")[2].strip():
                break
        else:
            break
    return "\n".join(out)


def footer(text: str) -> str:
    """The comment lines after the last line of code, however many."""
    out: list[str] = []
    block = False
    for row in _rows_back(text):
        s = row.strip()
        if block:
            if "*/" in s:  # no comment that began further up
                return ""
            out.append(s)
            block = not s.startswith("/*")
            if block and not s.startswith("*") and "/*" in s:  # begins behind code
                out[-1] = s[s.index("/*") :]
                block = False
                break
        elif s.endswith("*/") and not s.startswith("/*"):
            if "/*" in s:
                break
            out.append(s)
            block = True
        elif s.startswith(("//", "#", "/*", "--")) and not s.startswith(_DIRECTIVES) or (not s and out) or s == "```":
            out.append(s)
        else:
            break
    return "" if block else "\n".join(reversed(out))


def bare(ext: str, text: str) -> str:
    """The text without comments and literals."""
    return without(ext, text)


def names_of(ext: str, text: str) -> list[str]:
    return _IDENT.findall(bare(ext, text))


@lru_cache(20_000)
def _grams(name: str) -> tuple[str, ...]:
    n = "^^" + _DIGITS.sub("0", name.lower()) + "$"
    if not n.isascii():
        n = "".join(c if c < "\x80" else "~" for c in n)
    return tuple(n[i : i + 3] for i in range(len(n) - 2))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigrams of the distinct names of each file, added up before they leave the task."""
    seen: dict[str, Counter] = defaultdict(Counter)  # names first: most are in many files
    out: dict[str, Counter] = defaultdict(Counter)

    def settle() -> None:
        for lang, names in seen.items():
            for name, n in names.items():
                for g in _grams(name):
                    out[lang][g] += n
        seen.clear()

    for b in batches:
        for ext, text in zip(b["ext"], b["content"]):
            seen[LANGUAGES[ext]].update({x for x in names_of(ext, text) if len(x) < 64})
        if sum(map(len, seen.values())) > NAMES_HELD:
            settle()
    settle()
    yield pd.DataFrame([(k, g, n) for k, c in out.items() for g, n in c.items()], columns=["lang", "gram", "n"])


def models(files: DataFrame) -> dict[str, dict[str, int]]:
    """Trigram counts of identifiers by language over all code files.

    What the driver gets is bounded by the alphabet: trigrams of some forty symbols, a table for each language.
    """
    own = code_files(files).where("content is not null and content <> ''").select("ext", "content")
    sums = own.mapInPandas(_count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for r in sums.collect():
        out[r["lang"]][r["gram"]] = r["n"]
    return dict(out)


class NameModel:
    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        self.context: Counter = Counter()
        for g, n in grams.items():
            self.context[g[:2]] += n
        total = sum(grams.values()) or 1
        self.mean = sum(n * self.bits(g) for g, n in grams.items()) / total
        self.of = lru_cache(20_000)(self._of)

    def bits(self, g: str) -> float:
        return -log2((self.grams.get(g, 0) + 0.1) / (self.context[g[:2]] + 4.0))

    def _of(self, name: str) -> float:
        g = _grams(name)
        return sum(map(self.bits, g)) / len(g)


@lru_cache(20_000)
def _style(name: str) -> str:
    n = name.strip("_$")
    if len(n) < 4:
        return ""
    return "snake" if "_" in n and n.islower() else "camel" if n[0].islower() and not n.islower() and "_" not in n else "pascal" if n[0].isupper() and not n.isupper() and "_" not in n else ""


_REMARKS = re.compile(r"(?m)^[ \t]*(?://|#(?!include))[^\n]*$|(?s:/\*.*?(?:\*/|\Z))")


def _is_data(ext: str, text: str) -> bool:
    """One large literal or table and nothing else."""
    body = _REMARKS.sub("", re.sub(r"\A```\w*\s*\n|\n```\s*\Z", "", text))
    body = body.strip()
    if len(body) < DATA_CHARS:
        return False
    if re.search(r"\b(?:def|func|function|fn|return|if|for|while|switch|=>)\b|=>", without(ext, body)):
        return False
    values = sum(m.end() - m.start() for m in re.finditer(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|\b0[xX][0-9a-fA-F]+\b|-?\b\d[\d_.]*\b|\b(?:true|false|null|None|True|False)\b|[\s,:;\[\]{}()]", body))
    return values / len(body) >= DATA_SHARE


def _mangled(text: str, code: str, own: set[str], model: NameModel) -> bool:
    """Whether a tool shortened the names: their cross-entropy, the share of short ones, and missing layout, each by its weight."""
    if len(own) < NAMES_LEAST:
        return False
    bits = sum(map(model.of, own)) / len(own) - model.mean
    short = sum(1 for n in own if len(_DIGITS.sub("", n)) <= 2) / len(own)
    if bits <= 0 and short <= SHORT_SHARE:
        return False
    lines = code.split("\n")
    if max(map(len, text.split("\n"))) > LONG_LINE:
        dense = "".join(x for x in lines if len(x) > 80) or code
        if len(code) > 0.5 * len(text) * SPACE_SHARE and sum(map(str.isspace, dense)) / max(1, len(dense)) < SPACE_SHARE and len(dense) > LONG_LINE // 2 and (bits > MANGLED_BITS or short > SHORT_SHARE):
            return True
    flat = sum(map(str.isspace, code)) < SPACE_SHARE * len(code)
    if not flat and len(own) < NAMES_LAID_OUT:
        return False
    score = max(0.0, min(1.0, bits / MANGLED_BITS)) + max(0.0, min(1.5, (short - SHORT_SHARE) / SHORT_SPAN)) + LAYOUT_WEIGHT * flat
    return score >= MANGLED_SCORE


def judge(ext: str, path: str, text: str | None, model: NameModel | None) -> tuple[str | None, str]:
    """(kind, reason); kind is generated, minified, vendored, data or None."""
    return judge_names(ext, path, text, model)[:2]


def _template(text: str, names: list[str], share: float) -> bool:
    """Whether most names come from one pattern: without their digits few are left."""
    if text.count("\n") <= 2 * TEMPLATE_NAMES or not _DIGITS.search(text):
        return False
    own = {n for n in names if len(n) > 4}
    kinds = Counter(_DIGITS.sub("0", n) for n in own)
    if not kinds:
        return False
    numbered = sum(n for n in kinds.values() if n >= TEMPLATE_NAMES)  # of patterns that repeat
    return numbered > 0 and len(kinds) <= share * len(own) + 2 and numbered >= (1 - 2 * share) * len(own)


def judge_names(ext: str, path: str, text: str | None, model: NameModel | None) -> tuple[str | None, str, list[str]]:
    """judge() with the names of a file that nothing was found against, for its style."""
    names: list[str] = []
    if text and model is not None:
        code = bare(ext, text)
        names = _IDENT.findall(code)
        if _is_data(ext, text):  # before the names: hexadecimal numbers look like short ones
            return "data", "literal", []
        if _mangled(text, code, set(names), model):
            return "minified", "mangled names", []
        if _template(text, names, TEMPLATE_SHARE):
            return "generated", "template names", []
        if GENERATED_DIRS.search(path) and _template(text, names, 1.5 * TEMPLATE_SHARE):
            return "generated", "names and path", []
    if text:
        head = header(text)
        if head and not NEGATED.search(head):
            if GENERATED.search(head):
                return "generated", "header", []
            if UPSTREAM.search(head) or (VERSION.search(head) and LICENSE.search(head)):
                return ("minified", "banner", []) if ext in ("js", "mjs", "cjs") and max(map(len, text.split("\n"))) > LONG_LINE * 2 else ("vendored", "header", [])
        foot = footer(text)
        if foot and not NEGATED.search(foot):
            if GENERATED.search(foot):
                return "generated", "footer", []
            if UPSTREAM.search(foot):
                return "vendored", "footer", []
    if VENDOR_DIRS.search(path):
        return "vendored", "path", []
    if TOOL_PATHS.search(path):
        return "generated", "path", []
    if MINIFIED_PATHS.search(path):
        return "minified", "path", []
    return None, "", names


def _judged(grams: dict[str, dict[str, int]]):
    made: dict[str, NameModel] = {}

    def run(ext: str, path: str, text: str) -> str | None:
        lang = LANGUAGES[ext]
        if lang not in made:
            made[lang] = NameModel(grams.get(lang, {}))
        kind, why, names = judge_names(ext, path, text or None, made[lang])
        style = ""
        if kind is None and text:
            c = Counter(map(_style, set(names)))
            c.pop("", None)
            if sum(c.values()) >= 8:
                style = f"{c['snake']} {c['camel']} {c['pascal']} {int(LICENSE.search(header(text)) is not None)}"
        return f"{kind or ''}\t{why}\t{style}"

    return run


def origins(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, kind, reason) of every code file; kind is null for hand-written ones.

    Null and empty content is judged by its path alone. Redelivered rows count once.
    """
    grams = models(files)
    own = code_files(files).select("file_id", "repo_id", "path", "ext", F.coalesce("content", F.lit("")).alias("content"))
    parts = F.split("v", "\t")
    own = own.select("file_id", "repo_id", "path", "ext", per_text(_judged(grams), "string", F.col("ext"), F.col("path"), F.col("content")).alias("v"))
    own = own.select("file_id", "repo_id", "path", "ext", F.nullif(parts[0], F.lit("")).alias("kind"), parts[1].alias("reason"), parts[2].alias("style")).dropDuplicates(["file_id"])
    own = cut(own)  # the texts are judged once
    # a foreign naming style: the repository writes this language otherwise, and the file has a licence line of its own
    own = own.withColumn("s", F.split("style", " ").try_cast("array<double>"))
    snake, camel, pascal, licensed = (F.get("s", F.lit(i)) for i in range(4))
    total = snake + camel + pascal
    styled = own.where("style <> ''").select("repo_id", "ext", (snake / total).alias("snake"), (camel / total).alias("camel"))
    usual = styled.groupBy("repo_id", "ext").agg(F.avg("snake").alias("u_snake"), F.avg("camel").alias("u_camel"), F.count("*").alias("files"))
    own = own.join(usual, ["repo_id", "ext"], "left")
    far = (F.col("files") >= 8) & (licensed == 1) & (F.abs(snake / total - F.col("u_snake")) + F.abs(camel / total - F.col("u_camel")) > 1.2)
    foreign = F.col("kind").isNull() & F.coalesce(far, F.lit(False))
    return own.select(
        "file_id", "repo_id", "path", F.when(foreign, "vendored").otherwise(F.col("kind")).alias("kind"), F.when(foreign, "foreign style").otherwise(F.nullif("reason", F.lit(""))).alias("reason")
    )


def signs(files: DataFrame) -> DataFrame:
    """(kind, reason, files): how many files each sign decided."""
    return origins(files).where("kind is not null").groupBy("kind", "reason").agg(F.count("*").alias("files"))


def found(files: DataFrame) -> DataFrame:
    """(file_id) of the code files that nobody in the repository wrote by hand."""
    return origins(files).where("kind is not null").select("file_id")
