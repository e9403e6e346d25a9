"""Scalars over texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.functions.dictionaries import COMPLEXITY, CONDITIONAL, ELSE_IF, java


def line_count(content: Column) -> Column:
    """Lines ending at LF or CRLF; a trailing line end begins one more. Null for null and empty content."""
    return F.when(F.length(content) > 0, F.size(F.split(content, "\r?\n", -1)))


def complexity(content: Column) -> Column:
    """1 and one for each decision, whatever the language; an else-if counts twice. Null for null and empty content."""
    # decisions of one word or sign never overlap, so one pass counts them; the else-if and the conditional hold others
    lone = [p for p in COMPLEXITY if p not in (ELSE_IF, CONDITIONAL)]
    # up to the last colon every question mark has one behind it, so that no search runs on in vain
    closed = F.left(content, F.length(content) - F.length(F.substring_index(content, ":", -1)))
    count = lambda text, p: F.regexp_count(text, F.lit(java(p)))
    return F.when(F.length(content) > 0, 1 + count(content, "|".join(lone)) + count(content, ELSE_IF) + count(closed, r"\?[^:]*+:"))


def round_half_up(x: Column, places: int) -> Column:
    """floor(x * 10^k + 0.5) / 10^k in binary floating point; 1.005 gives 1.0 for two places."""
    return F.floor(x * 10**places + 0.5) / 10**places


def parameters(text: Column) -> Column:
    """The trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units below U+10000 (one for each character)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c.cast("bigint")) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))
