"""What changed between consecutive full snapshots, by content-defined chunks.

Every snapshot is sorted by record key inside key slices and cut where a key's hash says so, so that an insertion or a
removal moves no other boundary. A chunk becomes one row, of its digest and its packed records. Chunks are compared with those
of the neighbour snapshots by digest; matching ones are discarded as they are, and only those left are unpacked, so that rows of
changed chunks alone are joined and classified.

One exchange on (lineage, kind, slice, block) serves every later step: the de-duplication, the sort, the packing, the comparison
of chunks and the final one are all clustered by a superset of those columns. A lineage holding a large share of all rows spreads
over as many slices as its largest snapshot needs, and over a block for every BLOCK snapshots; the snapshot between two blocks is in both.

Defined results: rows without a key are ignored; duplicate rows count once; of several rows of one key in one snapshot the
greatest values count; snapshots with equal times are ordered by their id; a snapshot without rows removes everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.session import cut

#: A chunk holds this many rows on average; a slice about so many rows of one snapshot.
CHUNK_ROWS = 32
SLICE_ROWS = 8_000
#: Pairs of snapshots that are compared in one task.
BLOCK = 16
#: Records that a task of the exchange gets on average; the session's number of partitions is the least.
TASK_ROWS = 100_000
#: Rows of a table of snapshots, of some 60 bytes each, up to which it is broadcast.
BROADCAST_ROWS = 200_000


def lineages(analyses: DataFrame) -> DataFrame:
    """(snapshot_id, lineage, seq, next_id): usable snapshots in order within repository and branch."""
    own = (
        analyses.where(F.col("analysis_id").isNotNull() & ~F.col("status").eqNullSafe("error"))
        .groupBy("analysis_id")
        .agg(F.min("repo_id").alias("repo_id"), F.min("branch").alias("branch"), F.min("created_at").alias("created_at"))
    )
    w = W.partitionBy("repo_id", "branch").orderBy("created_at", "analysis_id")
    return own.select(
        F.col("analysis_id").alias("snapshot_id"),
        F.xxhash64("repo_id", F.coalesce(F.col("branch"), F.lit("\0"))).alias("lineage"),
        F.row_number().over(w).alias("seq"),
        F.lag("analysis_id").over(w).alias("prev_id"),
        F.lead("analysis_id").over(w).alias("next_id"),
    )


def _digest(*cols: str) -> list[Column]:
    """Two independent sums make a 128-bit, order-free digest of a chunk's rows."""
    return [(F.sum(F.xxhash64(*cols) % F.lit(1 << 55))).alias("d1"), F.sum(F.xxhash64(F.lit(17), *cols) % F.lit(1 << 55)).alias("d2"), F.count("*").alias("n")]


def _small(written: DataFrame) -> DataFrame:
    """A table of a row a snapshot, broadcast where its counted rows are few, so that records aren't shuffled to meet it."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def unmatched_chunks(records: DataFrame, order: DataFrame, values: list[str], chunk_rows: int = CHUNK_ROWS, slice_rows: int = SLICE_ROWS, block: int = BLOCK) -> DataFrame:
    """(lineage, record_kind, slice, block, seq, rows, differs_base, differs_head): the chunks that a neighbour snapshot doesn't hold."""
    sizes = cut(records.groupBy("snapshot_id", "record_kind").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    slices = (
        sizes.join(order.select("snapshot_id", "lineage"), "snapshot_id")
        .groupBy("lineage", "record_kind")
        .agg(F.ceil(F.max("n") / slice_rows).cast("int").alias("slices"))
    )
    # a pair of snapshots belongs to the block of its base, so a block's first snapshot is the last head of the one before
    own = F.floor(F.col("seq") / block)
    blocks = F.explode(F.when((F.col("seq") % block == 0) & F.col("prev_id").isNotNull(), F.array(own - 1, own)).otherwise(F.array(own)))
    placed = order.join(slices, "lineage").select("snapshot_id", "record_kind", "lineage", "seq", "slices", blocks.alias("block"), (F.col("prev_id").isNotNull()).alias("has_base"), (F.col("next_id").isNotNull()).alias("has_head"))
    rows = records.where(F.col("record_key").isNotNull()).join(_small(cut(placed)), ["snapshot_id", "record_kind"])
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(F.lit(5), "record_key"), F.col("slices"))).drop("slices", "snapshot_id")
    rows = rows.repartition(tasks, "lineage", "record_kind", "slice", "block")
    at = ["lineage", "record_kind", "slice", "block"]
    one = rows.groupBy(*at, "seq", "has_base", "has_head", "record_key").agg(*[F.max(v).alias(v) for v in values])
    edge = F.when(F.pmod(F.xxhash64(F.lit(9), "record_key"), F.lit(chunk_rows)) == 0, F.col("record_key"))
    one = one.withColumn("chunk", F.coalesce(F.last(edge, True).over(W.partitionBy(*at, "seq").orderBy("record_key").rowsBetween(W.unboundedPreceding, 0)), F.lit("")))
    chunks = one.groupBy(*at, "seq", "has_base", "has_head", "chunk").agg(*_digest("record_key", *values), F.collect_list(F.struct("record_key", *values)).alias("rows"))
    near = W.partitionBy(*at, "chunk").orderBy("seq")
    digest = F.struct("d1", "d2", "n")
    same = lambda f, step: F.coalesce((f("seq").over(near) == F.col("seq") + step) & (f(digest).over(near) == digest), F.lit(False))
    chunks = chunks.withColumn("in_base", same(F.lag, -1)).withColumn("in_head", same(F.lead, 1))
    mine = lambda base: F.floor(base / block) == F.col("block")
    chunks = chunks.withColumn("differs_base", F.col("has_base") & ~F.col("in_base") & mine(F.col("seq") - 1))
    chunks = chunks.withColumn("differs_head", F.col("has_head") & ~F.col("in_head") & mine(F.col("seq")))
    return chunks.where("differs_base or differs_head").select(*at, "seq", "rows", "differs_base", "differs_head")


def changes(records: DataFrame, order: DataFrame, values: list[str], chunk_rows: int = CHUNK_ROWS, slice_rows: int = SLICE_ROWS, block: int = BLOCK) -> DataFrame:
    """(base, head, record_kind, record_key, change) of records(snapshot_id, record_kind, record_key, *values).

    order is what lineages() gives. A value counts as changed where both sides have one and they differ.
    """
    left = unmatched_chunks(records, order, values, chunk_rows, slice_rows, block)
    at = ["lineage", "record_kind", "slice", "block"]
    side = lambda on, head, is_head: F.when(F.col(on), F.struct(head.alias("head_seq"), F.lit(is_head).alias("is_head")))
    sides = F.filter(F.array(side("differs_base", F.col("seq"), True), side("differs_head", F.col("seq") + 1, False)), lambda x: x.isNotNull())
    left = left.select(*at, "rows", F.explode(sides).alias("side")).select(*at, "side.*", F.inline("rows"))
    pair = left.groupBy(*at, "head_seq", "record_key").agg(
        F.max("is_head").alias("added"),
        F.min("is_head").alias("kept"),
        *[F.max(F.when(F.col("is_head"), F.col(v))).alias(f"{v}_head") for v in values],
        *[F.max(F.when(~F.col("is_head"), F.col(v))).alias(f"{v}_base") for v in values],
    )
    differs = F.lit(False)
    for v in values:
        differs = differs | F.coalesce(F.col(f"{v}_head") != F.col(f"{v}_base"), F.lit(False))
    change = F.when(F.col("kept"), F.lit("added")).when(~F.col("added"), F.lit("removed")).when(differs, F.lit("changed"))
    pair = pair.select("lineage", "head_seq", "record_kind", "record_key", change.alias("change")).where("change is not null")
    names = order.where("prev_id is not null").select("lineage", F.col("seq").alias("head_seq"), F.col("prev_id").alias("base"), F.col("snapshot_id").alias("head"))
    return pair.join(_small(cut(names)), ["lineage", "head_seq"]).select("base", "head", "record_kind", "record_key", "change")


def graph_changes(analyses: DataFrame, nodes: DataFrame, edges: DataFrame, externals: DataFrame) -> DataFrame:
    """The changes of nodes (by id; loc and complexity) and edges (by source and target) between consecutive analyses."""
    n = nodes.select("analysis_id", "id", "loc", "complexity").join(externals.select("id").where("id is not null").distinct(), "id", "left_anti")
    n = n.select(F.col("analysis_id").alias("snapshot_id"), F.lit("node").alias("record_kind"), F.col("id").alias("record_key"), "loc", "complexity")
    none = F.lit(None).cast("int")
    e = edges.select(
        F.col("analysis_id").alias("snapshot_id"), F.lit("edge").alias("record_kind"), F.concat("src", F.lit("->"), "dst").alias("record_key"), none.alias("loc"), none.alias("complexity")
    )
    got = changes(n.unionByName(e), lineages(analyses), ["loc", "complexity"])
    return got.select(F.col("base").alias("base_analysis_id"), F.col("head").alias("head_analysis_id"), "record_kind", "record_key", "change")
