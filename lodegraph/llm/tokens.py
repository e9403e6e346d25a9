"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the tokenizer's vocabulary lies; a parameter, nothing of it is copied. The same vocabulary as ranks lies beside it or is not used.
VOCABULARY = os.environ.get("LODEGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
# Fixed value: how this tokenizer's family splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The slower encoder gets a text in parts of at least so many characters.
PART = 4_000

#: Where a text may be cut, as the tokenizer never joins across: before a single space, and between a letter and a punctuation mark.
_SAFE = re.compile(r"(?<=\S) (?=\S)|(?<=[^\W\d_])[.,;:!?()\[\]{}，。、！？；：（）「」…]")
#: The fast encoder's expressions fail on longer runs of white space.
_SPACES = re.compile(r"\s{5000}")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@cache
def _fast(path: str):
    """The encoder of the ranks beside a vocabulary, None without them."""
    at = path.rpartition(".")[0] + ".tiktoken"
    if not os.path.exists(at):
        return None
    import tiktoken

    with open(at, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _parts(text: str) -> list[str]:
    out, at = [], 0
    while m := _SAFE.search(text, at + PART):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def count(text: str, path: str = VOCABULARY) -> int:
    """The number of tokens of a text, however long and with or without white space."""
    if not text:
        return 0
    fast = _fast(path)
    if fast is not None and not _SPACES.search(text):
        return len(fast(text))
    return sum(len(e.ids) for e in _tokenizer(path).encode_batch(_parts(text), add_special_tokens=False))


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens; null for null, 0 for the empty text."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else count(x, path) for x in s], dtype="Int64")

    return run(text)
