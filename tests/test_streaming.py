"""The streaming queries over a small folder of deliveries."""

import datetime as dt

from lodegraph.streaming import ingest

SCHEMA = "file_id bigint, path string, size bigint, received_at timestamp"


def batch(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_latest(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: dt.datetime(2024, 1, d)
    batch(spark, folder, [(1, "a.py", 5, day(1)), (2, "b.ts", 7, day(1))])

    def run():
        s = ingest.deliveries(spark, folder, spark.read.parquet(folder).schema)
        q = s.writeStream.foreachBatch(ingest.upsert_latest(target)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    batch(spark, folder, [(1, "a.py", 9, day(3)), (2, "b.ts", 6, day(1) - dt.timedelta(days=9))])
    run()
    got = {r["file_id"]: r["size"] for r in spark.read.parquet(f"{target}/v=1").collect()}
    assert got == {1: 9, 2: 7}


def test_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    day = lambda d: dt.datetime(2024, 1, d)
    batch(spark, folder, [(1, "a.py", 5, day(1)), (2, "b.ts", 7, day(1)), (3, "x.bin", 1, day(2)), (4, "y.py", None, None)])
    s = ingest.daily_deliveries(ingest.deliveries(spark, folder, spark.read.parquet(folder).schema))
    q = s.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["day"].day, r["language"]): (r["deliveries"], r["bytes"]) for r in spark.table("daily").collect()}
    assert got == {(1, "Python"): (1, 5), (1, "TypeScript"): (1, 7), (2, "other"): (1, 1)}
