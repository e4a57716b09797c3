"""The shard store: nothing lost, versions whole, tiers merged up to the target."""

import random

import pytest
from conftest_llm import ODD, prose

from flowspark.llm import sharding
from flowspark.llm._shared import scratch
from flowspark.llm.sharding import Conflict, Shard, ShardStore, plan


def test_plans():
    shards = tuple(Shard(f"s{k}", n) for k, n in enumerate([1, 1, 2, 3, 50, 60, 70, 100, 900]))
    assert [[s.n_bytes for s in g] for g in plan(shards, 1000)] == [[1, 1, 2, 3], [50, 60, 70, 100]]
    assert [[s.n_bytes for s in g] for g in plan(shards, 150)] == [[1, 1, 2, 3]]
    assert not plan(shards[1:4], 1000)
    draw = random.Random(0)
    shards = tuple(Shard(f"s{k}", draw.randrange(1, 5000)) for k in range(300))
    tiers = plan(shards, 8000)
    assert all(len(t) >= sharding.FAN_IN and max(s.n_bytes for s in t) <= min(3999, sharding.TIER_FACTOR * min(s.n_bytes for s in t)) for t in tiers)
    assert len({s for t in tiers for s in t}) == sum(map(len, tiers))


def test_nothing_is_lost(spark, table):
    draw = random.Random(1)
    texts = [*ODD, *(prose(draw, draw.randrange(200), 5000) for _ in range(400))]
    docs = table(texts)
    store = ShardStore(spark, scratch(spark, "shards"))
    for part in docs.randomSplit([0.5, 0.3, 0.2], 1):
        store.append(part.repartition(6), rows_per_shard=20)
    before = store.manifest()
    assert before.version == 3
    total = sum(s.n_bytes for s in before.shards)
    after = store.compact(total // 5)
    assert after.version > 3
    assert len(after.shards) < len(before.shards)
    assert not plan(after.shards, total // 5)
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, store.read(after).collect())) == want
    assert sorted(map(str, store.read(before).collect())) == want  # older versions stay readable
    assert store.vacuum(1) > 0
    assert store.versions() == [after.version]
    assert sorted(map(str, store.read(store.manifest()).collect())) == want
    with pytest.raises(Conflict):
        store.commit(before, set(), [])


def test_manifests_share_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_SHARDS", 4)
    store = ShardStore(spark, scratch(spark, "shards"))
    shards = [Shard(f"data/{k}", k) for k in range(20)]
    one = store.add(shards[:10])
    two = store.commit(one, {shards[0]}, shards[10:])
    assert {p.path for p in one.parts[1:2]} <= {p.path for p in two.parts}
    assert sorted(s.n_bytes for s in store.manifest(2).shards) == list(range(1, 20))
    assert store.manifest(1) == one
    assert store.manifest() == two


def test_placements(spark, table):
    docs = table([(1, "a"), (1, "a"), (None, None), (2, "b")]).withColumnRenamed("lang", "shard").withColumnRenamed("source", "version")
    got = sharding.placements(*sharding.sharded(docs.repartition(3), scratch(spark, "shards"))).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 2]
    assert len({(r.shard, r.row) for r in got}) == 4
    assert sharding.placements(*sharding.sharded(docs.limit(0), scratch(spark, "shards"))).count() == 0


def test_arrivals_are_compacted_by_tiers(spark, table, monkeypatch):
    """What is merged, job by job and version by version: whole tiers, each row kept once, and the version before still there."""
    draw = random.Random(4)
    docs = table([prose(draw, 200, 100_000) for _ in range(1200)]).coalesce(1)
    rounds, written = [], []
    replace = ShardStore._replace

    def spy(store, gone, new):
        rounds.append(gone)
        written.extend(new)
        replace(store, gone, new)

    monkeypatch.setattr(ShardStore, "_replace", spy)
    store, manifest = sharding.sharded(docs, scratch(spark, "shards"), target_bytes=200_000, rows_per_shard=25)
    assert len(rounds) > 1
    assert manifest.version == sharding.ARRIVALS + len(rounds)  # a commit for each arrival and each round
    assert max(s.n_bytes for s in written) <= 200_000
    assert any(2 * s.n_bytes >= 200_000 for s in manifest.shards)
    assert not plan(manifest.shards, 200_000)
    for gone in rounds:
        assert {s for t in plan(tuple(gone), 200_000) for s in t} == gone
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, store.read(manifest).collect())) == want
    before = store.manifest(manifest.version - 1)
    assert store.versions() == [before.version, manifest.version]
    assert before.shards != manifest.shards
    assert set(store.read(before).collect()) <= set(docs.collect())
    places = sharding.placements(store, manifest).collect()
    assert sorted(r.doc_id for r in places) == list(range(1200))
    assert len({(r.shard, r.row) for r in places}) == 1200


def test_a_round_merges_into_many_shards_without_a_shuffle(spark, table):
    draw = random.Random(5)
    store = ShardStore(spark, scratch(spark, "shards"))
    store.append(table([prose(draw, 100, 100_000) for _ in range(900)]).repartition(9), rows_per_shard=10)
    size = store.manifest().shards[0].n_bytes
    packed = store._packed(plan(store.manifest().shards, 10 * size), 10 * size)
    assert "Exchange" not in packed._jdf.queryExecution().toString()
    after = store.compact(10 * size)
    assert 9 <= len(store.manifest(2).shards) <= 15  # one round, one commit
    assert store.read(after).count() == 900


def test_names_that_differ_by_case(spark, table):
    with pytest.raises(ValueError, match="case"):
        sharding.sharded(table(["a"]).withColumnRenamed("lang", "Text"), scratch(spark, "shards"))


def test_shards_are_bounded_when_written(spark, table):
    draw = random.Random(4)
    docs = table([prose(draw, 200, 100_000) for _ in range(600)]).coalesce(1)
    store, manifest = sharding.sharded(docs, scratch(spark, "shards"), target_bytes=100_000)
    assert max(s.n_bytes for s in manifest.shards) <= 100_000
    assert store.read(manifest).count() == 600
    one = sharding.sharded(table(["x" * 50 + prose(draw, 3000, 100_000)]), scratch(spark, "shards"), target_bytes=5000)[1]
    assert any(s.n_bytes > 5000 for s in one.shards)  # a row is never cut
