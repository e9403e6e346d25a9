"""Queries on files that do not parse (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import syntax
from lodegraph.llm.code import code_files, language, per_text


def _verdict(ext: str, text: str) -> str | None:
    v = syntax.check(ext, text)
    return None if v.valid else f"{v.reason}\t{v.line}\t{v.token or ''}"


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, valid, reason, line_no, token), a row for each code file with content.

    Redelivered rows count once. Null content is left out; empty content is valid. reason is `unexpected` where a token's
    derivative is empty, with its line and text, or `truncated` where the end's isn't nullable.
    """
    own = code_files(files).where("content is not null")
    own = own.select("file_id", "repo_id", "path", per_text(_verdict, "string", F.col("ext"), F.col("content")).alias("v"))
    parts = F.split("v", "\t", 3)
    return own.select(
        "file_id", "repo_id", "path", F.col("v").isNull().alias("valid"), F.element_at(parts, 1).alias("reason"), F.element_at(parts, 2).cast("bigint").alias("line_no"), F.element_at(parts, 3).alias("token")
    ).dropDuplicates(["file_id"])


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id) of the code files that do not parse."""
    own = code_files(files).where("content is not null")
    return own.where(per_text(_verdict, "string", F.col("ext"), F.col("content")).isNotNull()).select("file_id").distinct()


def invalid_rates(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, language, files, invalid, invalid_share): nodes.language where a node of the repository has that path, else the extension's."""
    named = nodes.where("path is not null and language is not null").groupBy("repo_id", "path").agg(F.max("language").alias("named"))
    own = verdicts(files).join(named, ["repo_id", "path"], "left").withColumn("language", F.coalesce("named", language(F.col("path"))))
    bad = F.count_if(~F.col("valid"))
    return own.groupBy("repo_id", "language").agg(F.count("*").alias("files"), bad.alias("invalid"), (bad / F.count("*")).alias("invalid_share"))
