"""File deliveries as a stream: windowed counts of late data, and the latest state of each file.

Both are plain Structured Streaming queries over any source with the columns of `files`; received_at is the event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import language

WATERMARK, WINDOW = "2 days", "1 day"


def deliveries(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def daily_deliveries(stream: DataFrame, watermark: str = WATERMARK, window: str = WINDOW) -> DataFrame:
    """(day, language, deliveries, bytes) of event-time windows; rows later than the watermark no longer count."""
    own = stream.withColumn("at", F.col("received_at").cast("timestamp")).where("at is not null").withWatermark("at", watermark)
    own = own.groupBy(F.window("at", window).alias("w"), F.coalesce(language(F.col("path")), F.lit("other")).alias("language"))
    return own.agg(F.count("*").alias("deliveries"), F.sum("size").alias("bytes")).select(F.col("w.start").alias("day"), "language", "deliveries", "bytes")


def first_deliveries(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each file_id's first delivery within the watermark; redeliveries are dropped with bounded state."""
    own = stream.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", watermark)
    return own.dropDuplicatesWithinWatermark(["file_id"])


def merged_by(number: int) -> list[int]:
    """The earlier versions that a batch's version takes in: those of a binary counter's carries."""
    out, size = [], 1
    while (number + 1) % (2 * size) == 0:
        out.append(number - size)
        size *= 2
    return out


def live(number: int) -> list[int]:
    """The versions that together hold the state after a batch: a few, however many batches there were."""
    out = []
    while number >= 0:
        out.append(number)
        number -= 1 << len(merged_by(number))
    return out


def _latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), F.xxhash64(*cols))).alias("r")).select(key, "r.*")


def latest(spark: SparkSession, target: str, number: int, key: str = "file_id", version: str = "received_at") -> DataFrame:
    """The latest row of each key after a batch."""
    return _latest(spark.read.parquet(*(f"{target}/v={n}" for n in live(number))), key, version)


def upsert_latest(target: str, key: str = "file_id", version: str = "received_at") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key in a parquet table of numbered versions.

    A version holds its batch and the versions that it takes in, so that a row is written again only once for each doubling of the
    number of batches. A batch that is run again writes the same version again, so a restart loses and doubles nothing; a version
    that another has taken in is deleted by the batch after that one.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        for n in merged_by(number):
            rows = rows.unionByName(spark.read.parquet(f"{target}/v={n}"))
        _latest(rows, key, version).write.mode("overwrite").parquet(f"{target}/v={number}")
        for n in merged_by(number - 1) if number else ():
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={n}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return run
