"""Near copies by exact Jaccard similarity, against plain code."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from conftest_llm import ODD, prose
from pyspark.sql import functions as F
from test_simhash import plain_labels

from flowspark.llm import _text, near_copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(draw, text, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"changed{draw.randrange(99)}"
    return " ".join(words)


def test_the_stage_drops_edited_copies(spark, table):
    """Copies with a word or more changed lie beyond radius 2 of a SimHash, but not beyond a similarity of 0.8."""
    draw = random.Random(5)
    texts = [*ODD, *(prose(draw, draw.randrange(8, 300), 3000) for _ in range(40))]
    for t in texts[-40:]:
        texts += [edited(draw, t, k) for k in (1, 2, 3, 5)]
    texts += [t.upper() + " one more" for t in texts[12:30]]
    sets = [plain_set(t) for t in texts]
    want = plain_labels(len(texts), lambda i, j: plain_near(sets[i], sets[j]))
    kept = corpus_pipeline.near_duplicates(spark, table(texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(table(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_many_copies_under_a_shingle(table):
    """Groups larger than what is compared pair by pair, of one text's copies and of unlike texts that share a passage."""
    draw = random.Random(6)
    shared, base = prose(draw, 30, 3000), prose(draw, 60, 3000)
    texts = [f"{prose(draw, 20, 3000)} {shared}" for _ in range(60)] + [edited(draw, base, 1) for _ in range(60)]
    sets = [plain_set(t) for t in texts]
    want = plain_labels(len(texts), lambda i, j: plain_near(sets[i], sets[j]))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(table(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_near_sets_have_one_of_the_others_rarest(spark):
    """Of near sets, the first hashes looked up, in any order of rarity, meet; larger ones but for one in millions."""
    draw, seen = np.random.default_rng(1), 0
    most = {n: r[0] for n, r in zip(range(1, 400), spark.range(1, 400).select(near_copies.needed(F.col("id"))).collect(), strict=True)}
    for _ in range(4000):
        whole = draw.permutation(np.unique(draw.integers(0, 2**63, int(draw.integers(1, 300)), dtype=np.uint64)))
        a, b = (np.sort(whole[draw.random(len(whole)) > draw.random() / 5])[: near_copies.SKETCH] for _ in range(2))
        sizes = [int(len(x)) for x in (a, b)]
        if min(sizes) and max(sizes) < near_copies.SKETCH and near_copies.near(a, b) or min(sizes) == near_copies.SKETCH and len(np.intersect1d(a, b)) >= near_copies.SHARED:
            seen += 1
            rank = {x: k for k, x in enumerate(draw.permutation(np.union1d(a, b)).tolist())}
            own = [set(sorted(x.tolist(), key=rank.get)[: most[len(x)]]) for x in (a, b)]
            assert own[0] & own[1]
    assert seen > 1000


def test_groups_are_whole_in_any_batches():
    draw = np.random.default_rng(2)
    rows = np.sort(draw.integers(0, 40, (500, 1)), axis=0) * [1, 0] + [0, 3]
    for size in (1, 3, 64, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + size, c]) for c in (0, 1)] + [pa.array(np.arange(k, min(k + size, 500)))], ["a", "b", "i"]) for k in range(0, 500, size)]
        got = list(_text.whole_groups(iter(batches), ("a", "b", "i")))
        assert np.concatenate([x[2] for x in got]).tolist() == list(range(500))
        assert all(x[0][-1] < y[0][0] for x, y in zip(got, got[1:], strict=False))


def test_odd_rows(table):
    docs = table([(None, "a b c d"), (7, "a b c d"), (7, "A b c d"), (3, "x y z q"), (None, None)])
    assert sorted((r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()) == [(3, 3), (7, 7), (7, 7)]
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_sets_near_by_very_common_shingles_only(table):
    """More texts than meet under a shingle share a passage; a few of them are near each other, by that passage only."""
    draw = random.Random(7)
    shared = prose(draw, 44, 3000)
    tails = [22] * 560 + [4, 5, 4, 3] + [22] * 40
    texts = [f"{shared} {' '.join(f'own{k}x{i}' for i in range(n))}" for k, n in enumerate(tails)]
    sets = [plain_set(t) for t in texts]
    assert len(texts) > near_copies.KEY_SETS
    want = plain_labels(len(texts), lambda i, j: plain_near(sets[i], sets[j]))
    assert want[560:564] == [560] * 4 and len(set(want)) == len(texts) - 3
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(table(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_blocks_find_all_near_sets(monkeypatch):
    """Counted pair by pair or in matrices, in one strip or many."""
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[draw.random(90) > draw.random() / 4], draw.integers(0, 2**63, int(draw.integers(1, 12)), dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(draw.integers(0, 2**63, 5, dtype=np.uint64)) for _ in range(5)]
    a, b = sets[:40], sets[25:]
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if near_copies.near(a[i], b[j])}
    assert 20 < len(want) < len(a) * len(b) / 2
    for strip, dense, columns in ((512, 512, 4096), (7, 3, 5), (16, 0, 4096), (64, 1 << 30, 1)):
        for name, x in (("STRIP", strip), ("DENSE", dense), ("COLUMNS", columns)):
            monkeypatch.setattr(near_copies, name, x)
        assert {(int(i), int(j)) for pair in near_copies.near_sets(a, b) for i, j in zip(*pair, strict=True)} == want
