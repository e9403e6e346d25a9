"""The queries of the problems on texts, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import canonical, language, mixing, origin, packing, parsing, secrets, sql
from lodegraph.llm.code import code_files, extension
from lodegraph.session import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.found(spread(table(spark, d, "files")))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(spread(table(spark, d, "files"))).select("file_id", "repo_id", "path", "content")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """What masking keeps: the characters and line ends of every file."""
    own = secrets.redacted(spread(table(spark, d, "files")))
    return own.select("file_id", F.length("content").cast("bigint").alias("chars"), F.regexp_count("content", F.lit("\n")).cast("bigint").alias("line_ends")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.invalid_files(spread(table(spark, d, "files")))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.invalid_rates(spread(table(spark, d, "files")), table(spark, d, "nodes"))


def p2_judged(spark: SparkSession, d: str) -> DataFrame:
    """The files that a verdict is about, valid or not."""
    return parsing.verdicts(spread(table(spark, d, "files"))).select("file_id", extension(F.col("path")).alias("ext"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.found(spread(table(spark, d, "files")))


def p3_origins(spark: SparkSession, d: str) -> DataFrame:
    return origin.origins(spread(table(spark, d, "files")))


def p3_signs(spark: SparkSession, d: str) -> DataFrame:
    return origin.signs(spread(table(spark, d, "files")))


def p3_judged(spark: SparkSession, d: str) -> DataFrame:
    """The files that an origin is given for, null for hand-written ones."""
    return origin.origins(spread(table(spark, d, "files"))).select("file_id", "path")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.languages_in_code(spread(table(spark, d, "files")), table(spark, d, "documents"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return language.language_shares(spread(table(spark, d, "files")), table(spark, d, "documents"))


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """(beyond, unknown_languages, no_code): shares outside 0 to 1, languages outside the list, files that are no code; all 0."""
    own = p5_shares(spark, d).join(code_files(spread(table(spark, d, "files"))).select("file_id").distinct().withColumn("code", F.lit(True)), "file_id", "left")
    count = lambda c: F.count_if(c).alias
    return own.agg(count((F.col("share") <= 0) | (F.col("share") > 1))("beyond"), count(~F.col("nl_lang").isin(*language.LANGS))("unknown_languages"), count(F.col("code").isNull())("no_code"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spread(table(spark, d, "documents")), table(spark, d, "containers"))


def p6_fills(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(p6_packing(spark, d))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p6_packing(spark, d))


def p6_holds(spark: SparkSession, d: str) -> DataFrame:
    return packing.holds(p6_packing(spark, d), spread(table(spark, d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    return mixing.limits(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_look_pairs(spread(table(spark, d, "documents")))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """The name of a look class is of no meaning outside a run and left out."""
    return canonical.same_look_classes(spread(table(spark, d, "documents"))).select("doc_id", "text_class", "links")


def p8_stable(spark: SparkSession, d: str) -> DataFrame:
    """(texts, unstable, nulls): how many texts there are, and how many change when they are brought to their form once more."""
    own = p8_canonical(spark, d)
    return own.agg(F.count("*").alias("texts"), F.count_if(~canonical.canonical_text(F.col("text")).eqNullSafe(F.col("text"))).alias("unstable"), F.count_if(F.col("text").isNull()).alias("nulls"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", canonical.canonical_text(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p1_kept, p2_found, p2_rates, p2_judged, p3_found, p3_origins, p3_signs, p3_judged, p5_found, p5_shares, p5_bounds, p6_packing, p6_fills, p6_summary, p6_holds, p7_mix, p7_shares, p7_limits, p8_found, p8_classes, p8_canonical, p8_stable)}
ORACLES: dict[str, str] = {
    **sql.ORACLES,
    # what any packing and any mix must keep
    "p6_holds": """
SELECT container_class, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IS NOT NULL AND text <> '') AS texts,
  0::BIGINT AS pieces_twice, 0::BIGINT AS over_full, 0::BIGINT AS split_needlessly, 0::BIGINT AS tokens_lost
FROM containers WHERE container_class IS NOT NULL AND capacity_tokens > 0 GROUP BY container_class""",
    "p7_limits": "SELECT DISTINCT mix_name, 0::BIGINT AS twice, 0::BIGINT AS outside, 0::BIGINT AS beyond FROM mix_targets WHERE mix_name IS NOT NULL AND source IS NOT NULL",
}
