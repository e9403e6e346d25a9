"""Nearest vectors by cosine, exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.session import cut

#: Queries in a block, and the groups that vectors are dealt to.
BLOCK, GROUPS = 256, 64
#: Numbers of all queries together up to which they are broadcast, counted first; beyond it they meet each group in rounds of so many blocks.
BROADCAST_NUMBERS, ROUND = 8_000_000, 64


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (query_id, embedding) the k vectors of greatest cosine, ties by vec_id.

    Queries go to the groups of vectors in blocks: each partition of vectors keeps the k best of each query before anything is shuffled.
    Null vectors and vectors without length have no cosine and are left out; the query's own vector is too.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = vectors.where("embedding is not null").select("vec_id", F.col("embedding").alias("v"), norm(F.col("embedding")).alias("vn")).where("vn > 0")
    q = queries.where("embedding is not null").select("query_id", F.col("embedding").alias("q"), norm(F.col("embedding")).alias("qn")).where("qn > 0")
    lane = F.pmod(F.xxhash64("query_id"), F.lit(64))
    blocks = q.withColumn("block", F.floor((F.row_number().over(W.partitionBy(lane).orderBy("query_id")) - 1) / BLOCK) * 64 + lane)
    blocks = cut(blocks.groupBy("block").agg(F.collect_list(F.struct("query_id", "q", "qn")).alias("qs")))
    size = blocks.agg(F.sum(F.aggregate("qs", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x["q"]))).alias("numbers"), F.max("block").alias("last")).first()
    group = F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("g")
    v = v.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(GROUPS)).cast("int"))
    if (size["numbers"] or 0) <= BROADCAST_NUMBERS:
        met = v.join(F.broadcast(blocks.select("qs", group)), "g")
    else:  # a round of blocks at a time meets a group of vectors, so that no task holds all queries
        rounds = -(-(size["last"] + 1) // ROUND)
        blocks = blocks.select("qs", (F.col("block") % rounds).cast("int").alias("round"), group)
        met = v.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(int(rounds) - 1)))).join(blocks, ["g", "round"])
    met = met.select("vec_id", "v", "vn", F.explode("qs").alias("x")).select("vec_id", "v", "vn", "x.*").where("vec_id <> query_id")
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = met.select("query_id", "vec_id", (dot / (F.col("vn") * F.col("qn"))).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
