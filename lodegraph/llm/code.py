"""What the operators on source files share: which files are code, and running a text function over a column."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.syntax import LANGUAGES


def extension(path: Column) -> Column:
    """The lower-cased extension of a path, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language(path: Column) -> Column:
    """The language that the extension stands for, null for other files."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), extension(path))


def code_files(files: DataFrame) -> DataFrame:
    """The rows of code files with a file_id and a path; ext is added."""
    own = files.where(F.col("file_id").isNotNull() & F.col("path").isNotNull()).withColumn("ext", extension(F.col("path")))
    return own.where(F.col("ext").isin(*LANGUAGES))


def per_text(f: Callable, kind: str = "string", *cols: Column) -> Column:
    """f over the columns, row by row in Arrow batches; no call where the last one, the text, is null."""

    @F.pandas_udf(kind)
    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if row[-1] is None else f(*row) for row in zip(*args)], dtype=object)

    return run(*cols)
