"""SimHash groups, against plain code."""

import random

import numpy as np
import pytest
import xxhash
from conftest_llm import ODD, prose

from flowspark.llm import _components, simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(n, linked):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def clouds(seed, centres=5, each=60, flips=6):
    draw = np.random.default_rng(seed)
    out = []
    for centre in draw.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(centre)
            for _ in range(draw.integers(0, flips)):
                x ^= 1 << int(draw.integers(0, 64))
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def distance(a, b):
    return (int(a) ^ int(b)).bit_count()


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_planes_find_all_pairs(radius):
    prints = clouds(radius)
    got = {p for i, j in simhash.near_pairs(prints, radius, queries=50) for p in zip(i.tolist(), j.tolist())}
    assert got == {(i, j) for i in range(len(prints)) for j in range(i) if distance(prints[i], prints[j]) <= radius}


@pytest.mark.parametrize("limit", [4096, 30, 3])
def test_large_groups_are_cut_without_loss(monkeypatch, limit):
    monkeypatch.setattr(simhash, "KERNEL_ROWS", limit)
    prints = clouds(9)
    labels = np.arange(len(prints))
    simhash.link_group(prints, (1 << 64) - 1, 2, labels, np.arange(len(prints)))
    assert labels.tolist() == plain_labels(len(prints), lambda i, j: distance(prints[i], prints[j]) <= 2)


def test_near_prints_share_a_band():
    draw = random.Random(2)
    for radius in (1, 2, 3):
        masks = simhash.bands(radius)
        for _ in range(300):
            x = draw.getrandbits(64)
            y = x
            for _ in range(radius):
                y ^= 1 << draw.randrange(64)
            assert any(x & m == y & m for m in masks)


def test_links_over_tables(spark):
    prints = clouds(4, centres=3, each=80)
    df = spark.createDataFrame([(simhash._signed(int(p)),) for p in prints], "print long")
    linked = {r.node: r.label for r in _components.components(simhash.links(df, 2)).collect()}
    label = [linked.get(simhash._signed(int(p)), simhash._signed(int(p))) for p in prints]
    want = plain_labels(len(prints), lambda i, j: distance(prints[i], prints[j]) <= 2)
    groups = lambda xs: sorted(sorted(k for k, x in enumerate(xs) if x == y) for y in set(xs))
    assert groups(label) == groups(want)


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(None, 5), (7, 7)]
    got = {r.node: r.label for r in _components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    pairs = {(max(a, b), min(a, b)) for a, b in edges if a is not None}
    want = plain_labels(261, lambda i, j: (i, j) in pairs)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: want[n] for n in nodes}
    assert _components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_equal_plain_code(table):
    draw = random.Random(1)
    texts = [*ODD]
    for _ in range(12):
        words = prose(draw, 400).split()
        texts.append(" ".join(words))
        for _ in range(4):
            near = list(words)
            near[draw.randrange(len(near))] = "changed"
            texts.append(" ".join(near).upper() if draw.random() < 0.3 else " ".join(near))
    prints = [plain_print(t) for t in texts]
    want = plain_labels(len(texts), lambda i, j: distance(prints[i], prints[j]) <= 2)
    assert len(set(want)) < len(texts) - 10
    got = {r.doc_id: r for r in simhash.near_duplicates(table(texts)).collect()}
    assert [(got[k].fingerprint, got[k].component_id) for k in range(len(texts))] == [(f"{p:016x}", c) for p, c in zip(prints, want, strict=True)]
    kept = simhash.deduplicated(table(texts).withColumnRenamed("n_chars", "print"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert kept.columns == ["doc_id", "text", "lang", "source", "print"]


def test_null_and_repeated_ids(table):
    docs = table([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "x y z q"), (None, "alone here now"), (None, None)])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (3, 3), (None, None), (None, None)], key=str)
    assert sorted((r.doc_id for r in simhash.deduplicated(docs).collect()), key=str) == sorted([7, 3, None, None, None], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot_rows", [2, 8])
def test_hot_bands_are_dealt_by_further_bits(spark, hot_rows):
    """The same components, however often groups are dealt anew, and no group larger than what near fingerprints force."""
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 4, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (150, 3)).astype(np.uint64), axis=1) for b in base]))
    df = spark.createDataFrame([(simhash._signed(int(p)),) for p in prints], "print long")
    want = plain_labels(len(prints), lambda i, j: (int(prints[i]) ^ int(prints[j])).bit_count() <= 2)
    linked = {r.node: r.label for r in _components.components(simhash.links(df, 2, hot_rows)).collect()}
    label = [linked.get(simhash._signed(int(p)), simhash._signed(int(p))) for p in prints]
    assert [label.index(x) for x in label] == want
    sizes = simhash._dealt(df, 2, hot_rows).groupBy("mask", "key").count().agg({"count": "max"}).first()[0]
    assert sizes < simhash._dealt(df, 2, 10**9).groupBy("mask", "key").count().agg({"count": "max"}).first()[0]
