"""Mixing sources to target weights (problem 7): soft memberships and projected-gradient least squares.

A naive Bayes classifier of hashed words, counted over all labelled documents, gives each unlabelled document its posterior of
sources; a labelled one belongs to its label. Rates r >= 0 of the documents, at most the source's max_repeats, are fitted by
projected gradient to min |A r - T|^2, A being expected tokens of a source by document and T the target tokens. All a step needs
of the documents is a sum for each source, so only those travel. A document's rate follows from its posterior and the residuals
so far, and is computed anew from them: nothing is kept between steps but a vector for each mix.

The total is the largest at which no source that has documents needs more repeats than it may have. Rates become whole repeats
by a threshold on a hash, found for each source by histograms down to a single document. What is then missing is filled from the
histogram of the lengths not yet taken: the longest that fits, again and again, and last a longer one where that comes closer.
A source without documents can't reach its target; the report shows it with share 0. The gradient ends when all sums are within
TOLERANCE of their targets or a step no longer gains; the report gives the part of the total that was then missing.

Defined results: null and empty texts take no part; a document of a source outside the recipe takes no part in that mix;
documents with a null source are used only where their posterior's greatest source is in the recipe.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.llm.tokens import VOCABULARY, token_count
from lodegraph.session import cut

#: Hashed words of the classifier, and bins and rounds of the threshold search.
BUCKETS, BINS, ROUNDS = 1 << 12, 256, 3
#: The gradient ends within this part of the total, or when a step gains less than this part of what is missing.
TOLERANCE, LEAST_GAIN = 1e-4, 0.02
#: Groups of the documents that fill up a source.
SALTS = 64

_WORD = re.compile(r"[^\W\d_]+|[#*`|:]")


@lru_cache(100_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _features(text: str) -> dict[int, int]:
    """Hashed words, with the text's size and its first word."""
    out: dict[int, int] = defaultdict(int)
    words = Counter(_WORD.findall(text.lower()))
    for w, n in words.items():
        out[_bucket(w)] += n
    for w in (f"^{next(iter(words), '')}", f"size {len(text).bit_length()}", f"lines {text.count(chr(10)).bit_length()}", f"start {text[:2]}"):
        out[_bucket(w)] += 4
    return out


def _counted(batches):
    c: dict[tuple[str, int], int] = defaultdict(int)
    for b in batches:
        for source, text in zip(b["source"], b["text"]):
            for k, n in _features(text).items():
                c[source, k] += min(n, 8)
    yield pd.DataFrame([(s, k, n) for (s, k), n in c.items()], columns=["source", "k", "n"])


class Classifier:
    """Naive Bayes from sums by source and bucket: bounded by sources times BUCKETS."""

    def __init__(self, docs: DataFrame):
        own = docs.where("source is not null and text is not null and text <> ''").select("source", "text")
        sums = own.mapInPandas(_counted, "source string, k int, n bigint").groupBy("source", "k").agg(F.sum("n").alias("n"))
        counts = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.count("*").alias("n")).collect()}
        self.sources = sorted(counts)
        m = np.full((len(self.sources), BUCKETS), 0.1)
        at = {s: i for i, s in enumerate(self.sources)}
        for r in sums.collect():
            m[at[r["source"]], r["k"]] += r["n"]
        self.logs = np.log(m / m.sum(1, keepdims=True)) if len(m) else m
        total = sum(counts.values()) or 1
        self.prior = np.array([log(counts[s] / total) for s in self.sources])

    def posterior(self, text: str) -> np.ndarray:
        f = _features(text)
        k = np.fromiter(f, int)
        n = np.minimum(np.fromiter(f.values(), float), 8)
        s = self.prior + (self.logs[:, k] * n).sum(1) / max(1.0, n.sum() / 60)
        e = np.exp(s - s.max())
        return e / e.sum()


def memberships(docs: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[str]]:
    """(doc_id, source, own_label, tokens, p array) of every document with text, and the sources p refers to."""
    own = docs.where("doc_id is not null and text is not null and text <> ''")
    model = Classifier(own)
    names = model.sources

    @F.pandas_udf("array<double>")
    def soft(source: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(source, text):
            if s is not None and s in names:
                out.append([1.0 if x == s else 0.0 for x in names])
            else:
                out.append(model.posterior(t).tolist())
        return pd.Series(out)

    rows = own.select("doc_id", "source", "text").withColumn("tokens", token_count(F.col("text"), vocabulary)).where("tokens > 0")
    rows = rows.select("doc_id", F.col("source").alias("label"), "tokens", soft("source", "text").alias("p"))
    return cut(rows), names


def _rates(p: np.ndarray, cap: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """The rates after the steps so far, from the residuals of each."""
    r = np.zeros(len(p))
    top = cap[p.argmax(1)]
    for step in history:
        r = np.clip(r + p @ step, 0, top)
    return r


def _picks(histogram: dict[int, int], want: float) -> dict[int, int]:
    """How many of each length bring a sum closest to want, the longest that fits first."""
    out: dict[int, int] = {}
    for s in sorted(histogram, reverse=True):
        if n := min(histogram[s], int(want // s)):
            out[s] = n
            want -= n * s
    over = min((s for s, n in histogram.items() if s > want and n > out.get(s, 0)), default=None)
    if over is not None and over - want < want:
        out[over] = out.get(over, 0) + 1
    return out


def fill_up(spare: DataFrame, want: dict[tuple[str, str], float]) -> DataFrame:
    """(mix_name, doc_id, more): one repeat more for documents that bring each mix's source closest to the tokens it still wants.

    spare is (mix_name, doc_id, source, tokens, u). The driver gets the counts of lengths up to twice what is wanted, which is less
    than twice a document.
    """
    spark = spare.sparkSession
    wants = spark.createDataFrame([(m, s, float(x)) for (m, s), x in want.items()], "mix_name string, source string, want double")
    near = spare.join(wants, ["mix_name", "source"]).where("want >= 1 and tokens < 2 * want")
    lengths: dict[tuple[str, str], dict[int, int]] = defaultdict(dict)
    for r in near.groupBy("mix_name", "source", "tokens").agg(F.count("*").alias("n")).collect():
        lengths[r["mix_name"], r["source"]][r["tokens"]] = r["n"]
    picks = [(m, s, t, n) for (m, s), h in lengths.items() for t, n in _picks(h, want[m, s]).items()]
    picked = near.join(spark.createDataFrame(picks, "mix_name string, source string, tokens bigint, n bigint"), ["mix_name", "source", "tokens"])
    # the first n by hash: of each salted group first, as many documents may have one length
    picked = picked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for keys in (["mix_name", "source", "tokens", "salt"], ["mix_name", "source", "tokens"]):
        picked = picked.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("u", "doc_id"))).where("rn <= n")
    return picked.select("mix_name", "doc_id", F.lit(1).alias("more"))


def limits(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, twice, outside, beyond): documents a mix holds twice, of sources outside its recipe, beyond their repeats; all 0 in a valid mix."""
    own = targets.where("mix_name is not null and source is not null").select("mix_name", "source", "max_repeats")
    rows = chosen.groupBy("mix_name", "doc_id", "source").agg(F.count("*").alias("n"), F.max("repeats").alias("repeats")).join(own, ["mix_name", "source"], "left")
    sums_ = rows.groupBy("mix_name").agg(
        F.sum(F.col("n") - 1).alias("twice"), F.sum(F.col("max_repeats").isNull().cast("bigint")).alias("outside"), F.sum(F.coalesce(F.col("repeats") > F.col("max_repeats"), F.lit(False)).cast("bigint")).alias("beyond")
    )
    return own.select("mix_name").distinct().join(sums_, "mix_name", "left").na.fill(0)


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (mix_name, doc_id, source, tokens, repeats), and the report (mix_name, source, target_share, actual_share, tokens, documents, most_repeats, max_repeats, missing)."""
    spark = docs.sparkSession
    members, names = memberships(docs, vocabulary)
    recipe: dict[str, dict[str, tuple[float, int]]] = defaultdict(dict)
    for r in targets.where("mix_name is not null and source is not null").collect():  # recipes: a row for each mix and source
        recipe[r["mix_name"]][r["source"]] = (r["target_share"], r["max_repeats"])
    k = len(names)
    share = {m: np.array([v.get(s, (0.0, 0))[0] for s in names]) for m, v in recipe.items()}
    cap = {m: np.array([float(v.get(s, (0.0, 0))[1] or 0) for s in names]) for m, v in recipe.items()}

    def sums(weight) -> dict[str, np.ndarray]:
        """Expected tokens of each source under the weights of each mix."""

        def run(batches):
            acc = {m: np.zeros(k) for m in recipe}
            for b in batches:
                p = np.array(b["p"].tolist()).reshape(len(b), k)
                n = b["tokens"].to_numpy(float)
                for m in recipe:
                    acc[m] += (n * weight(m, p)) @ p
            yield pd.DataFrame([(m, i, x) for m, v in acc.items() for i, x in enumerate(v)], columns=["m", "i", "x"])

        out = {m: np.zeros(k) for m in recipe}
        for r in members.select("tokens", "p").mapInPandas(run, "m string, i int, x double").groupBy("m", "i").agg(F.sum("x").alias("x")).collect():
            out[r["m"]][r["i"]] = r["x"]
        return out

    allowed = lambda m, p: (cap[m][p.argmax(1)] > 0).astype(float)
    stock = sums(allowed)
    goal: dict[str, np.ndarray] = {}
    for m in recipe:
        use = (share[m] > 0) & (stock[m] > 0)
        total = min((cap[m][i] * stock[m][i] / share[m][i] for i in np.flatnonzero(use)), default=0.0)
        goal[m] = np.where(use, share[m] * total, 0.0)
    history: dict[str, list[np.ndarray]] = {m: [] for m in recipe}
    missing: dict[str, float] = {m: float("inf") for m in recipe}  # of the total, after the steps so far
    open_ = set(recipe)
    while open_:  # a step that doesn't gain is the last, so this ends
        have = sums(lambda m, p: _rates(p, cap[m], history[m])) if any(history.values()) else {m: np.zeros(k) for m in recipe}
        for m in [*open_]:
            off = float(np.abs(goal[m] - have[m]).sum() / max(goal[m].sum(), 1.0))
            if off > (1 - LEAST_GAIN) * missing[m] and history[m]:
                open_.discard(m)
                if off > missing[m]:
                    history[m].pop()
                    continue
            missing[m] = off
            if off <= TOLERANCE:
                open_.discard(m)
            if m in open_:
                history[m].append((goal[m] - have[m]) / np.maximum(stock[m], 1.0))

    schema = "mix_name string, doc_id bigint, source string, tokens bigint, rate double, u double"

    def rated(batches):
        for b in batches:
            if not len(b):
                continue
            p = np.array(b["p"].tolist()).reshape(len(b), k)
            best = p.argmax(1)
            for m in recipe:
                r = _rates(p, cap[m], history[m])
                on = r > 0
                if not on.any():
                    continue
                u = np.array([zlib.crc32(f"{m} {d}".encode()) / 2**32 for d in b["doc_id"][on]])
                yield pd.DataFrame({"mix_name": m, "doc_id": b["doc_id"][on], "source": [names[i] for i in best[on]], "tokens": b["tokens"][on], "rate": r[on], "u": u})

    rates = cut(members.mapInPandas(rated, schema)) if k else spark.createDataFrame([], schema)
    # whole repeats: the floor, and one more below the threshold of the source
    want = {(r["mix_name"], r["source"]): r["x"] for r in rates.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * (F.col("rate") - F.floor("rate"))).alias("x")).collect()}
    at = {key: (0.0, 1.0, 0.0) for key in want}  # the threshold lies in [low, high), tokens below low
    for _ in range(ROUNDS):
        bounds = spark.createDataFrame([(m, s, lo, hi) for (m, s), (lo, hi, _) in at.items()], "mix_name string, source string, lo double, hi double")
        near = rates.join(bounds, ["mix_name", "source"]).where("u >= lo and u < hi and rate > floor(rate)")
        bins = near.groupBy("mix_name", "source", F.floor((F.col("u") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).alias("bin")).agg(F.sum("tokens").alias("x"))
        got: dict[tuple[str, str], dict[int, int]] = defaultdict(dict)
        for r in bins.collect():
            got[r["mix_name"], r["source"]][r["bin"]] = r["x"]
        for key, (lo, hi, below) in at.items():
            width = (hi - lo) / BINS
            b = 0
            while b < BINS - 1 and below + got[key].get(b, 0) <= want[key]:
                below += got[key].get(b, 0)
                b += 1
            at[key] = (lo + b * width, lo + (b + 1) * width, below)
    cuts = spark.createDataFrame([(m, s, lo) for (m, s), (lo, _, _) in at.items()], "mix_name string, source string, cut double")
    more = (F.col("rate") > F.floor("rate")) & (F.col("u") < F.col("cut"))
    chosen = cut(rates.join(cuts, ["mix_name", "source"]).withColumn("repeats", (F.floor("rate") + F.when(more, 1).otherwise(0)).cast("int")).withColumn("spare", ~more & (F.col("rate") > F.floor("rate"))))
    extra = fill_up(chosen.where("spare"), {key: want[key] - below for key, (_, _, below) in at.items()})
    chosen = chosen.join(extra, ["mix_name", "doc_id"], "left").withColumn("repeats", F.col("repeats") + F.coalesce("more", F.lit(0)))
    chosen = chosen.where("repeats > 0").select("mix_name", "doc_id", "source", "tokens", "repeats")
    sums_ = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    total = sums_.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    report = targets.where("mix_name is not null and source is not null").join(sums_, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    left = spark.createDataFrame([(m, x if x < float("inf") else 0.0) for m, x in missing.items()], "mix_name string, missing double")
    report = report.join(left, "mix_name", "left").select(
        "mix_name", "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"), "max_repeats", "missing"
    )
    return chosen, report
