import re
from collections import defaultdict
from hashlib import md5

import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from flowspark.llm import mixing


def fill(sizes, weights, share, cap):
    """Plain water-filling, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if target[s] >= cap * sizes[s]]
        if not over:
            return {**capped, **target}
        capped |= {s: cap * sizes[s] for s in over}
        if len(capped) == len(names):
            return capped


def test_targets_and_samples(spark):
    rows = [(k, "w " * (k % 37), "en", [None, "", "a", "B", "é", "z", "hot"][min(k % 9, 6)]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1))
    got = mixing.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1]))
        assert 0 <= r.taken <= 2 * r.size
    want = fill(sizes, (5, 2, 1), 1.5, 2)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 37 / 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    other = mixing.mix(docs, seed=1).collect()
    assert sorted(map(str, other)) != sorted(map(str, got))


@pytest.mark.parametrize(("weights", "share"), [((1.0,), 1.5), ((100.0, 1.0, 1.0), 0.7), ((1.0, 9.0), 2.0), ((3.0, 1.0), 0.0)])
def test_water_filling(spark, weights, share):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 3, None: 77}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), weights, share, 2.0)
    want = fill(sizes, weights, share, 2)
    assert {r.source: r.target for r in got.collect()} == pytest.approx(want)


def test_odd_rows(table, spark):
    docs = table(ODD)
    assert mixing.mix(docs).count() == len(ODD)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {(r.size, r.taken) for r in mixing.mix(table([None, "", None])).collect()} == {(0, 0)}
    twice = docs.union(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.mix(twice).count() == 2 * len(ODD)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}


def test_only_the_slices_at_the_fraction_are_ranked(spark):
    """A hot source is taken by slices, not sorted as a whole, and the mix comes to the same documents as one plain order would."""
    rows = [(k, "w " * (k % 11), "hot" if k % 3 else "rare") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, weights=(1.0,), share=1.3).collect()}
    for source in ("hot", "rare"):
        own = sorted((k for k, _, s in rows if s == source), key=lambda k: md5(f"0:{k}".encode()).hexdigest())
        target, total, ahead = got[own[0]].target, got[own[0]].source_size, 0
        for k in own:
            size = len(rows[k][1].split())
            assert got[k].copies == target // total + (ahead + size / 2 < target % total), k
            ahead += size
    goals = mixing._goals(mixing._sizes(docs, 0, "doc_id", "source", "text"), (1.0,), 1.3, 2.0).collect()
    assert all(r["first"] == r["last"] for r in goals)
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
