"""Substring deduplication and repeated passages, against all windows."""

import random
import re
from collections import defaultdict

import pytest
from conftest_llm import ODD, prose

from flowspark.llm import substring_dedup, suffix_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_kept(docs, n):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        w, gone = words(text), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                gone |= set(range(k, k + n))
            seen.add(g)
        out[doc_id] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def plain_passages(docs, n):
    at = defaultdict(set)
    for doc_id, text in docs:
        w = words(text)
        for k in range(len(w) - n + 1):
            at[tuple(w[k : k + n])].add((doc_id, k))
    hit = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for doc_id, k in places:
                hit[doc_id] |= set(range(k, k + n))
    out = []
    for doc_id, h in hit.items():
        start = None
        for k in range(max(h) + 2):
            if k in h and start is None:
                start = k
            elif k not in h and start is not None:
                out.append((doc_id, start, k - start))
                start = None
    return sorted(out)


def corpus(seed):
    """Texts with copies, passages that several share with other words around them, short periods, and repeats within."""
    draw = random.Random(seed)
    passages = [prose(draw, draw.choice([20, 25, 60, 120]), 400) for _ in range(6)]
    texts = list(ODD)
    for _ in range(60):
        parts = [prose(draw, draw.randrange(40), draw.choice([3, 400])) for _ in range(3)]
        parts.insert(draw.randrange(4), draw.choice(passages))
        if draw.random() < 0.4:
            parts.insert(draw.randrange(5), draw.choice(passages))
        if draw.random() < 0.2:
            parts.append(" ".join(["p q r s t"] * draw.randrange(3, 30)))
        texts.append(" ".join(parts))
    texts += texts[20:35]
    docs = list(enumerate(texts))
    draw.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window", [20, 8])
def test_kept_words(table, seed, window):
    docs = corpus(seed)
    got = substring_dedup.deduplicated(table(docs), window=window, gram=5 if window > 8 else 3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got.collect()} == plain_kept(docs, window)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("least", [50, 12])
def test_passages(table, seed, least):
    docs = corpus(seed)
    got = suffix_dedup.repeats(table(docs), least=least, gram=8 if least > 12 else 4)
    assert sorted(tuple(r) for r in got.collect()) == plain_passages(docs, least)


def test_one_group_of_copies_over_many_tasks(spark, table):
    docs = [(k, "copy " + " ".join(f"v{i}" for i in range(80))) for k in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = substring_dedup.deduplicated(table(docs)).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == [(k, 81 if k else 0) for k in range(300)]
        found = suffix_dedup.repeats(table(docs)).collect()
        assert sorted(tuple(r) for r in found) == [(k, 0, 81) for k in range(300)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_null_and_repeated_ids(table):
    long = " ".join(f"v{i}" for i in range(70))
    docs = table([(None, long), (1, long), (1, long), (2, long), (3, None), (4, ""), (1, "other text of " + long)])
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.deduplicated(docs).collect()), key=str)
    # the first row of id 1 stays whole; null ids are left alone; the second text of id 1 repeats the first from its third word on
    assert got == sorted([(None, 70, 0), (1, 70, 0), (1, 70, 0), (2, 70, 70), (3, 0, 0), (4, 0, 0), (1, 73, 70)], key=str)
    assert sorted(tuple(r) for r in suffix_dedup.repeats(docs).collect()) == [(1, 0, 70), (1, 3, 70), (2, 0, 70)]
    assert substring_dedup.deduplicated(docs.limit(0)).count() == 0
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


def test_string_ids_are_refused_and_other_columns_not_read(table):
    docs = table([(1, "a b c " * 30), (2, "a b c " * 30)]).withColumnRenamed("lang", "place").withColumnRenamed("source", "mark")
    assert suffix_dedup.repeats(docs).count() == 2
    assert substring_dedup.deduplicated(docs).count() == 2
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    for op in (suffix_dedup.repeats, substring_dedup.deduplicated):
        with pytest.raises(TypeError, match="whole-number"):
            op(named)


def test_runs_that_only_distant_suffixes_share(table):
    """One common phrase with many texts on either side, of which some share both sides, but have neighbours that don't."""
    draw = random.Random(9)
    phrase, lefts, rights = prose(draw, 9, 300), [prose(draw, 24, 300) for _ in range(6)], [prose(draw, 24, 300) for _ in range(6)]
    docs = [(k, f"{prose(draw, 5, 300)} {draw.choice(lefts)} {phrase} {draw.choice(rights)} {prose(draw, 5, 300)}") for k in range(40)]
    got = suffix_dedup.repeats(table(docs), least=40, gram=8)
    assert sorted(tuple(r) for r in got.collect()) == plain_passages(docs, 40)
