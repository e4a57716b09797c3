"""Decontamination, against a plain search of all windows."""

import random
import re

import pytest
from conftest_llm import ODD, prose

from flowspark.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, bench, window):
    wanted = {}
    for item, text in bench:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if (found := wanted.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= {str(i) for i in found if i is not None}
        out.append((doc_id, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def test_words():
    for t in [t or "" for t in ODD] + ["Don't STOP_now 12x", "É—é"]:
        assert [w.decode() for w in d.bench_words(t.encode())] == words(t)


@pytest.mark.parametrize("block_bytes", [8_000_000, 900])
def test_hits_equal_plain_code(spark, table, block_bytes):
    draw = random.Random(4)
    bench = [(k, prose(draw, draw.choice([0, 1, 3, 9, 10, 11, 40]), 8)) for k in range(25)] + [(3, "again another text " + prose(draw, 12)), (None, prose(draw, 15)), (90, None), (91, "Tie")]
    texts = [*ODD, *(prose(draw, draw.choice([5, 60, 300]), 9) for _ in range(40))]
    texts += [f"{prose(draw, 9, 500)} {(bench[draw.randrange(25)][1] or 'x').upper()}! {prose(draw, 9, 500)}" for _ in range(20)]
    docs = list(enumerate(texts))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = d.contamination(table(texts), benchmark, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == plain(docs, bench, 10)
    for r in got:
        assert sum(s.words for s in r.spans) == r.n_hit
    clean = d.decontaminated(table(texts).withColumnRenamed("lang", "items"), benchmark, block_bytes=block_bytes)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in plain(docs, bench, 10) if not x[2])
    assert clean.columns == ["doc_id", "text", "items", "source", "n_chars"]


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, list(r["items"])) for r in d.contamination(table(["a b"]), none).collect()] == [(0, [])]
    assert d.contamination(table([]), none).count() == 0
    assert d.decontaminated(table(["a b"]), none).count() == 1
