"""Containers and mixtures."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import mixing, packing, tokens


def fill(histogram, capacity):
    ranks, load = defaultdict(set), Counter()
    for s, a, b, first, each in packing.plan(histogram, capacity):
        for r in range(a, b):
            assert r not in ranks[s]
            ranks[s].add(r)
            load[first + (r - a) // each] += s
    assert {s: len(x) for s, x in ranks.items()} == {s: n for s, n in histogram.items() if n}
    return load


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_holds(histogram):
    load = fill(histogram, 40)
    assert all(0 < x <= 40 for x in load.values())
    total = sum(s * n for s, n in histogram.items())
    # at most one container is up to half empty beside those that hold a text of more than half the capacity
    assert len(load) <= max(1, 2 * -(-total // 40))


def test_plan_is_tight():
    rng = random.Random(5)
    h = Counter(min(512, int(rng.lognormvariate(4, 1)) + 1) for _ in range(20_000))
    load = fill(h, 512)
    assert sum(load.values()) / (512 * len(load)) > 0.99


def test_tokens():
    long = ("word é 漢字 " * 3000) + "x" * 9000
    whole = len(tokens._tokenizer(tokens.VOCABULARY).encode(long, add_special_tokens=False).ids)
    assert tokens.count(long) == whole and tokens.count("") == 0 and "".join(tokens._parts(long)) == long
    for t in ("a  b " * 3000, "\n \n" * 5000, "a\n" * 6000):
        assert tokens.count(t) == len(tokens._tokenizer(tokens.VOCABULARY).encode(t, add_special_tokens=False).ids)


def docs(spark, n=120):
    rng = random.Random(6)
    kinds = {"a": "alpha beta gamma", "b": "fix merge branch commit", "c": "## heading list | table"}
    rows = [(i, " ".join(rng.choices(kinds[k].split(), k=rng.randint(3, 60))), k) for i in range(n) for k in [rng.choice("aabc")]]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "fix merge branch commit fix merge", None), (1003, "alpha beta gamma alpha", None), (1004, "same text", "a"), (1005, "same text", "a"), (None, "lost", "a")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as n", "2 as salt", "3 as tokens", "4 as rank", "5 as p", "6 as label")


def test_pack(spark):
    c = spark.createDataFrame([("s", 16), ("l", 100), ("none", None), ("zero", 0)], "container_class string, capacity_tokens bigint")
    d = docs(spark)
    rows = packing.pack(d, c).collect()
    sizes = {r["doc_id"]: tokens.count(r["text"]) for r in d.where("doc_id is not null and text <> ''").collect()}
    for cls, cap in (("s", 16), ("l", 100)):
        own = [r for r in rows if r["container_class"] == cls]
        load = Counter()
        per = defaultdict(list)
        for r in own:
            load[r["container_id"]] += r["tokens"]
            per[r["doc_id"]].append(r)
        assert max(load.values()) <= cap and set(per) == set(sizes)
        for k, v in per.items():
            assert sum(x["tokens"] for x in v) == sizes[k] and len(v) == -(-sizes[k] // cap)
            assert sorted(x["first_token"] for x in v) == [i * cap for i in range(len(v))]
        assert sorted(load) == list(range(len(load)))
    f = packing.fills(packing.pack(d, c))
    assert f.where("fill > 1").count() == 0 and f.select("step_group").distinct().count() <= packing.STEP_GROUPS
    assert packing.pack(d.limit(0), c).count() == 0


def test_mix(spark):
    t = spark.createDataFrame([("m", "a", 0.25, 1), ("m", "b", 0.5, 3), ("m", "c", 0.25, 2), ("w", "a", 0.5, 1), ("w", "gone", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs(spark, 600), t)
    rep = {(r["mix_name"], r["source"]): r for r in report.collect()}
    for s, want in (("a", 0.25), ("b", 0.5), ("c", 0.25)):
        assert rep["m", s]["actual_share"] == pytest.approx(want, abs=0.02) and rep["m", s]["most_repeats"] <= rep["m", s]["max_repeats"]
    assert rep["w", "gone"]["actual_share"] == 0 and rep["w", "a"]["actual_share"] == 1
    ids = [(r["mix_name"], r["doc_id"]) for r in chosen.collect()]
    assert len(ids) == len(set(ids)) and not {1000, 1001, None} & {i for _, i in ids}
    chosen, report = mixing.mix(docs(spark).limit(0), t)
    assert chosen.count() == 0 and {r["actual_share"] for r in report.collect()} == {0.0}


def test_posteriors(spark):
    model = mixing.Classifier(docs(spark, 300).where("text is not null and text <> ''"))
    p = model.posterior("fix the merge of a branch commit")
    assert model.sources[p.argmax()] == "b" and abs(p.sum() - 1) < 1e-9


def test_tiers_change_the_plan():
    rng = random.Random(7)
    h = Counter(min(512, int(rng.lognormvariate(4, 1)) + 1) for _ in range(20_000))
    assert packing.plan(h, 512) != packing.plan(h, 512, (1.0,))
    # windows of a quarter: four full ones make a container, and no text lies across two of them
    assert sorted(packing.plan({5: 8, 20: 8}, 100, (1.0, 0.25))) == [(5, 0, 8, 0, 4), (20, 0, 8, 0, 4)]


def test_texts_without_spaces():
    whole = tokens._tokenizer(tokens.VOCABULARY)
    for t in ("数据处理，结果返回。" * 9000, "字" * 70_000, " " * 20_000 + "x", "a1" * 40_000, "can't" * 20_000):
        want = len(whole.encode(t, add_special_tokens=False).ids)
        assert tokens.count(t) == want
        assert sum(len(e.ids) for e in whole.encode_batch(tokens._parts(t), add_special_tokens=False)) == want


def test_hot_length_and_balance(spark):
    """A third of all texts have one length; each is placed once, and step groups get nearly equal tokens."""
    rows = [(i, "alpha " * (7 if i % 3 == 0 else 1 + i % 40)) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    c = spark.createDataFrame([("s", 64)], "container_class string, capacity_tokens bigint")
    packed = packing.pack(d, c)
    assert [tuple(r) for r in packing.holds(packed, d).collect()] == [("s", 3000, 0, 0, 0, 0)]
    groups = [r["t"] for r in packing.fills(packed).groupBy("step_group").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()]
    assert len(groups) == packing.STEP_GROUPS and max(groups) - min(groups) <= 128


def test_fill_up(spark):
    assert mixing._picks({10: 2, 4: 5, 3: 1}, 27) == {10: 2, 4: 1, 3: 1}
    assert mixing._picks({10: 2}, 6) == {10: 1} and mixing._picks({10: 2}, 4) == {} and mixing._picks({}, 5) == {}
    spare = spark.createDataFrame([("m", i, "a", 5 if i else 90, i / 100) for i in range(60)], "mix_name string, doc_id bigint, source string, tokens bigint, u double")
    assert mixing.fill_up(spare, {("m", "a"): 101.0}).count() in (3, 20)
    got = mixing.fill_up(spare, {("m", "a"): 51.0}).collect()
    assert len(got) == 10 and len({r["doc_id"] for r in got}) == 10 and 0 not in {r["doc_id"] for r in got}
    assert mixing.fill_up(spare, {("m", "a"): 0.0}).count() == 0


def test_limits_and_convergence(spark):
    t = spark.createDataFrame([("m", "a", 0.25, 1), ("m", "b", 0.5, 3), ("m", "c", 0.25, 2)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs(spark, 300), t)
    assert [tuple(r) for r in mixing.limits(chosen, t).collect()] == [("m", 0, 0, 0)]
    assert {r["missing"] < 0.01 for r in report.collect()} == {True}
    bad = spark.createDataFrame([("m", 1, "a", 5, 2), ("m", 1, "a", 5, 1), ("m", 2, "x", 5, 1)], "mix_name string, doc_id bigint, source string, tokens bigint, repeats int")
    assert [tuple(r) for r in mixing.limits(bad, t).collect()] == [("m", 1, 1, 1)]
