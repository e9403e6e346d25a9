"""Filling fixed-capacity containers with texts (problem 6) by hierarchical packing of several context sizes.

A container of a class is a window of its capacity or a row of shorter windows, TIERS. Each text is routed to the shortest
context size that holds it. Tiers are packed from the longest to the shortest:

1. the texts of a tier fill the gaps that longer windows left, the longest text first into the tightest gap;
2. what is left of the tier is packed into windows of its own size; full enough windows are put together to containers;
3. the rest of the tier goes into the gaps of these containers, and opens whole containers where there is no gap.

Equal lengths are interchangeable, so all of this is planned on the histogram of lengths, whose size is bounded by the capacity
and not by the number of texts. The plan says which ranks of a length go to which range of containers. The texts get their
rank in two steps over salted groups, and each salted group gets only the steps of its own ranks, so that neither a length which a
third of all texts have is a single task's work, nor a text meets more than its own step.

A text longer than the capacity is cut into pieces of the capacity and a rest. Containers are dealt to step groups in a snake
over their ranks by tokens, so that groups get nearly equal numbers of tokens.

Defined results: null and empty texts have no tokens and are in no container; a container class without capacity is left out.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.llm.tokens import VOCABULARY, token_count
from lodegraph.session import cut

#: Context sizes of the tiers as parts of the capacity, the salts of a length's ranks, and the step groups of a class.
TIERS = (1.0, 0.25, 0.0625)
SALTS = 64
STEP_GROUPS = 16
#: A window of a shorter context is kept where this part of it is full; of the shortest, which nothing fills later, only full ones.
WINDOW_FILL = 0.98

Step = tuple[int, int, int, int, int]


class _Bins:
    """Free spaces of numbered bins, as ranges of bins with equal space."""

    def __init__(self, size: int):
        self.size, self.opened = size, 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.order: list[int] = []  # the free spaces, ascending

    def put(self, free: int, first: int, end: int) -> None:
        if free > 0 and end > first:
            if not self.gaps[free]:
                bisect.insort(self.order, free)
            self.gaps[free].append((first, end))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The tightest gaps with that much space."""
        i = bisect.bisect_left(self.order, least)
        if i == len(self.order):
            return None
        free = self.order[i]
        first, end = self.gaps[free].pop()
        if not self.gaps[free]:
            self.order.pop(i)
        return free, first, end

    def add(self, left: dict[int, int], used: dict[int, int], opening: bool = True) -> list[Step]:
        """Puts the lengths, longest first, into the tightest gaps and into new bins; what finds no place stays in left."""
        out: list[Step] = []
        for s in sorted(left, reverse=True):
            while n := left[s]:
                got = self.take(s)
                if got is None:
                    if not opening:
                        break
                    fresh = -(-n // (self.size // s))
                    got = self.size, self.opened, self.opened + fresh
                    self.opened += fresh
                free, first, end = got
                each = free // s
                whole = min(end - first, n // each)
                if whole:
                    out.append((s, used[s], used[s] + whole * each, first, each))
                    self.put(free - each * s, first, first + whole)
                elif end > first:  # the last bin takes fewer
                    whole, each = 1, n
                    out.append((s, used[s], used[s] + n, first, n))
                    self.put(free - n * s, first, first + 1)
                used[s] += whole * each
                left[s] -= whole * each
                self.put(free, first + whole, end)
        return out


def _windows(left: dict[int, int], used: dict[int, int], size: int, per: int, bins: _Bins, filled: float) -> list[Step]:
    """Packs lengths into windows of a size and puts those that are full enough, per at a time, together to new bins."""
    own = _Bins(size)
    mine: dict[int, int] = defaultdict(int)
    steps = own.add(dict(left), mine)
    ranges = sorted((a, b, free) for free, v in own.gaps.items() for a, b in v)
    full, at = [], 0
    for a, b, _ in [*ranges, (own.opened, own.opened, 0)]:
        full.append((at, a, 0))
        at = max(at, b)
    kept = sorted((free, a, b) for a, b, free in [*ranges, *full] if b > a and free <= (1 - filled) * size)
    room = sum(b - a for _, a, b in kept) // per * per
    new: list[tuple[int, int, int]] = []  # old windows [a, b) become windows from the third on
    n = 0
    free_of: dict[int, int] = defaultdict(int)  # of the bins at the ends of ranges
    for free, a, b in kept:
        b = min(b, a + room - n)
        if b <= a:
            break
        new.append((a, b, n))
        lead = min(b - a, -n % per)
        whole = (b - a - lead) // per
        rest = b - a - lead - whole * per
        free_of[n // per] += lead * free
        bins.put(free * per, bins.opened + (n + lead) // per, bins.opened + (n + lead) // per + whole)
        free_of[(n + b - a) // per] += rest * free
        n += b - a
    for c, free in free_of.items():
        bins.put(free, bins.opened + c, bins.opened + c + 1)
    new.sort()
    starts = [a for a, _, _ in new]
    out: list[Step] = []
    for s, first, end, w, each in steps:
        until = w + -(-(end - first) // each)
        i = max(0, bisect.bisect_right(starts, w) - 1)
        while i < len(new) and new[i][0] < until:
            a, b, to = new[i]
            lo, hi = max(a, w), min(b, until)
            i += 1
            x, count = to + lo - a, hi - lo
            if count <= 0:
                continue
            lead = min(count, -x % per)
            whole = (count - lead) // per
            for windows, start, many in ((lead, x, 1), (whole * per, x + lead, whole), (count - lead - whole * per, x + lead + whole * per, 1)):
                if windows:
                    out.append((s, used[s], used[s] + windows * each, bins.opened + start // per, windows * each // many))
                    used[s] += windows * each
                    left[s] -= windows * each
    bins.opened += n // per
    return out


def plan(histogram: dict[int, int], capacity: int, tiers: tuple[float, ...] | None = None) -> list[Step]:
    """(length, first rank, end rank, first container, pieces in a container) for a histogram of lengths up to the capacity."""
    bins, used, out = _Bins(capacity), defaultdict(int), []
    sizes = sorted({int(capacity * x) for x in tiers or TIERS if int(capacity * x) > 0} | {capacity}, reverse=True)
    for size, shorter in zip(sizes, [*sizes[1:], 0]):
        left = {s: n for s, n in histogram.items() if shorter < s <= size and n > 0}
        out += bins.add(left, used, opening=False)
        if size < capacity:
            out += _windows(left, used, size, capacity // size, bins, WINDOW_FILL if shorter else 1.0)
        out += bins.add(left, used)
    return out


def ranked(rows: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """rows with `salt` and `rank`, their number from 0 among the rows with equal keys; a key's rows are ranked in SALTS groups.

    The table of groups is bounded by the number of different keys.
    """
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int")))
    groups = rows.groupBy(*keys, "salt").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy(*keys).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys, "salt").orderBy(*ids)) - 1)
    return own.join(groups.select(*keys, "salt", before.alias("before")), [*keys, "salt"]).withColumn("rank", F.col("before") + F.col("rn")).drop("rn", "before")


def pieces(docs: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_class, capacity, doc_id, piece_no, first_token, tokens): whole texts, or pieces of those beyond the capacity."""
    own = docs.where("doc_id is not null and text is not null and text <> ''")
    sizes = cut(own.select("doc_id", token_count(F.col("text"), vocabulary).alias("n")).where("n > 0"))
    kinds = containers.where("capacity_tokens > 0 and container_class is not null").groupBy("container_class").agg(F.max("capacity_tokens").alias("capacity"))
    classes = [(r["container_class"], r["capacity"]) for r in kinds.collect()]  # a handful: one row for a class of containers
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("container_class"), F.lit(k).cast("bigint").alias("capacity")) for c, k in classes]))
    many = sizes.select("doc_id", "n", each.alias("c")).select("doc_id", "n", "c.*")
    many = many.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1)).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity")
    return many.select("container_class", "capacity", "doc_id", "piece_no", start.alias("first_token"), F.least(F.col("capacity"), F.col("n") - start).alias("tokens"))


def pack(docs: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_class, capacity, doc_id, piece_no, first_token, tokens, tier, container_id): the container of each text or piece."""
    spark = docs.sparkSession
    own = pieces(docs, containers, vocabulary)
    own = cut(own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).cast("int")))
    # counts by class, length and salt: bounded by the capacities
    counts = cut(own.groupBy("container_class", "capacity", "tokens", "salt").agg(F.count("*").alias("k")))
    histograms: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for r in counts.groupBy("container_class", "capacity", "tokens").agg(F.sum("k").alias("k")).collect():
        histograms[r["container_class"], r["capacity"]][r["tokens"]] = r["k"]
    rows = [(c, *row) for (c, cap), h in histograms.items() for row in plan(h, cap)]
    steps = spark.createDataFrame(rows, "container_class string, tokens bigint, first_rank bigint, end_rank bigint, first_container bigint, each bigint")
    steps = steps.groupBy("container_class", "tokens").agg(F.collect_list(F.struct("first_rank", "end_rank", "first_container", "each")).alias("steps"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("container_class", "tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = counts.select("container_class", "tokens", "salt", before.alias("before"), "k").join(steps, ["container_class", "tokens"])
    # of a length's steps a salted group gets those that its own ranks meet
    mine = F.filter("steps", lambda x: (x["end_rank"] > F.col("before")) & (x["first_rank"] < F.col("before") + F.col("k")))
    groups = groups.select("container_class", "tokens", "salt", "before", mine.alias("steps"))
    placed = own.withColumn("rn", F.row_number().over(W.partitionBy("container_class", "tokens", "salt").orderBy("doc_id", "piece_no")) - 1)
    placed = placed.join(groups, ["container_class", "tokens", "salt"]).withColumn("rank", F.col("before") + F.col("rn"))
    placed = placed.withColumn("step", F.filter("steps", lambda x: (x["first_rank"] <= F.col("rank")) & (F.col("rank") < x["end_rank"]))[0])
    tier = F.lit(0)
    for i, part in enumerate(TIERS[1:], 1):
        tier = F.when(F.col("tokens") <= F.floor(F.lit(part) * F.col("capacity")), i).otherwise(tier)
    container = F.col("step.first_container") + F.floor((F.col("rank") - F.col("step.first_rank")) / F.col("step.each"))
    return placed.select("container_class", "capacity", "doc_id", "piece_no", "first_token", "tokens", tier.alias("tier"), container.cast("bigint").alias("container_id"))


def fills(packed: DataFrame) -> DataFrame:
    """(container_class, container_id, pieces, tokens, fill, step_group) of each container."""
    own = packed.groupBy("container_class", "capacity", "container_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    own = ranked(own, ["container_class", "tokens"], ["container_id"])
    # containers of equal tokens follow one another; the table of sums is bounded by the capacity
    sums = own.groupBy("container_class", "tokens").agg(F.count("*").alias("k"))
    above = F.coalesce(F.sum("k").over(W.partitionBy("container_class").orderBy(F.desc("tokens")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = own.join(sums.select("container_class", "tokens", above.alias("above")), ["container_class", "tokens"]).withColumn("place", F.col("above") + F.col("rank"))
    turn, at = F.floor(F.col("place") / STEP_GROUPS), F.col("place") % STEP_GROUPS
    group = F.when(turn % 2 == 0, at).otherwise(STEP_GROUPS - 1 - at)
    return own.select("container_class", "container_id", "pieces", "tokens", (F.col("tokens") / F.col("capacity")).alias("fill"), group.cast("int").alias("step_group"))


def holds(packed: DataFrame, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_class, texts, pieces_twice, over_full, split_needlessly, tokens_lost): what any packing must keep, the last four 0."""
    sizes = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", token_count(F.col("text"), vocabulary).alias("size")).dropDuplicates(["doc_id"])
    per = packed.groupBy("container_class", "doc_id").agg(F.first("capacity").alias("capacity"), F.count("*").alias("n"), F.count_distinct("piece_no").alias("d"), F.sum("tokens").alias("sum")).join(sizes, "doc_id")
    full = packed.groupBy("container_class", "container_id").agg((F.sum("tokens") > F.first("capacity")).cast("bigint").alias("over")).groupBy("container_class").agg(F.sum("over").alias("over_full"))
    out = per.groupBy("container_class").agg(
        F.count("*").alias("texts"), F.sum(F.col("n") - F.col("d")).alias("pieces_twice"),
        F.sum((F.col("n") > F.ceil(F.col("size") / F.col("capacity"))).cast("bigint")).alias("split_needlessly"), F.sum(F.col("size") - F.col("sum")).alias("tokens_lost"),
    )
    return out.join(full, "container_class").select("container_class", "texts", "pieces_twice", "over_full", "split_needlessly", "tokens_lost")


def summary(packed: DataFrame) -> DataFrame:
    """(container_class, containers, pieces, tokens, fill): the fill of all containers of a class together."""
    per = packed.groupBy("container_class", "capacity", "container_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return per.groupBy("container_class", "capacity").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens")).select(
        "container_class", "containers", "pieces", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill")
    )
