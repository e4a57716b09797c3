"""Base statistics against plain code; verdicts on clean and odd documents."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, prose
from pyspark.sql import functions as F

from flowspark.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            hit |= set(range(k, k + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_plain_code(table):
    draw = random.Random(6)
    texts = [*ODD, "a\nb\na\n \na\r\n", "1 2 3 4 5 1 2 3 4 5", "# * $ % & | < > <<>>"]
    texts += [prose(draw, draw.randrange(80), draw.choice([2, 3, 40])).replace(" ", draw.choice([" ", "\n", "\t "])) for _ in range(60)]
    got = {r.doc_id: r for r in quality.quality(table(texts)).collect()}
    for k, t in enumerate(texts):
        want = plain(t)
        assert tuple(got[k])[1:6] == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[k].base_failed == failed
        assert not (failed and got[k].kept)


def corpus(draw):
    rows = []
    for k in range(400):
        lang, source = draw.choice(["en", None]), draw.choice(["a", "b"])
        n = int(np.exp(draw.gauss(5, 0.6))) + 12
        rows.append((k, " ".join("x" * max(1, round(draw.gauss(5, 2))) + str(draw.randrange(10**6)) for _ in range(n)), lang, source))
    for k in range(400, 420):  # fewer than the quarter that the estimate bears: symbols all over
        rows.append((k, " ".join(f"$$##{draw.randrange(10**6)}||%%" for _ in range(150)), "en", "a"))
    return rows


def test_outliers_go_and_clean_documents_stay(spark):
    rows = corpus(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("clash")).withColumn("group", F.lit(1))
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(not got[k].kept for k in range(400)) <= 2
    assert not any(got[k].kept for k in range(400, 420))
    again = {r.doc_id: r for r in quality.quality(docs.repartition(5)).collect()}
    assert again == got
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in got.items() if r.kept)


SCHEMA = "lang string, source string, s struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long>"


def cloud(seed, n, bad):
    """Statistics of n documents, spread in every statistic and correlated, and of bad far ones in two places."""
    draw = np.random.default_rng(seed)
    words = np.exp(draw.normal(6.5, 0.9, n)).astype(int) + 200
    chars = (words * np.exp(draw.normal(1.6, 0.2, n) + 0.1 * (np.log(words) - 6.5))).astype(int)
    share = lambda top: draw.uniform(0.05, top, n) ** 2
    rows = np.stack([words, chars, (chars * share(0.5)).astype(int), (words * share(0.45)).astype(int), (words * share(0.44)).astype(int)], axis=1)
    far = [[3000, 9000, 8000, 0, 10], [300, 9000, 20, 250, 10]]
    return np.concatenate([rows, [far[k % 2] for k in range(bad)]]) if bad else rows


def vectors(rows):
    words, chars, symbols, lines, again = np.maximum(rows, 1e-300).T
    return np.stack([np.log(words), np.log(chars / words), np.sqrt(symbols / chars), np.sqrt(again / words), np.sqrt(lines / words)], axis=1)


def plain_mcd(x, starts=60):
    """The least log-determinant, consistency factor included, of concentration from many random starts."""
    draw, h, best = np.random.default_rng(0), int(np.ceil(quality.SUBSET * len(x))), np.inf
    for _ in range(starts):
        own = x[draw.choice(len(x), 12, replace=False)]
        for _ in range(30):
            mean, cov = own.mean(axis=0), np.cov(own.T, bias=True) + 1e-9 * np.eye(5)
            z = x - mean
            own = x[np.argsort(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z), kind="stable")[:h]]
        best = min(best, np.linalg.slogdet(quality.CONSISTENCY * np.cov(own.T, bias=True))[1])
    return best


@pytest.mark.parametrize(("seed", "n", "bad"), [(0, 1500, 150), (1, 1500, 0), (2, 300, 60), (3, 60, 9)])
def test_determinants_are_those_of_many_random_starts(spark, monkeypatch, seed, n, bad):
    monkeypatch.setattr(quality, "FLOORS", (1e-6,) * 5)
    rows = cloud(seed, n, bad)
    stats = spark.createDataFrame([("en", "s", tuple(map(int, r))) for r in rows], SCHEMA)
    got = quality.fit(stats).first()
    assert got.fit == "source"
    assert got.logdet <= plain_mcd(vectors(rows)) + 0.1
    x = vectors(rows)
    inverse = np.array([[got[f"i{r}{c}"] if c <= r else 0.0 for c in range(5)] for r in range(5)])
    far = (((x - [got[f"m{k}"] for k in range(5)]) @ inverse.T) ** 2).sum(axis=1) > quality.CUTOFF
    assert far[n:].all()  # every planted one
    assert far[:n].mean() <= 0.02


def test_small_groups_are_judged_by_their_language_and_say_so(spark):
    rows = [("en", f"s{k % 60}", tuple(map(int, r))) for k, r in enumerate(cloud(4, 300, 0))] + [("en", "big", tuple(map(int, r))) for r in cloud(5, 200, 0)]
    rows += [("fr", "few", (200, 1000, 0, 0, 0))] * 3
    fit = {(r.fit_lang, r.fit_source): r for r in quality.fit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert fit["=en", "=big"].fit == "source"
    assert {r.fit for (lang, source), r in fit.items() if lang == "=en" and source != "=big"} == {"language"}
    assert len({r.logdet for (lang, source), r in fit.items() if lang == "=en" and source != "=big"}) == 1
    assert fit["=fr", "=few"].fit == "all"


def test_repeated_short_lines_and_symbols_are_caught(spark):
    """Nine of ten planted junk documents of each kind at least; clean ones stay."""
    draw = random.Random(12)
    word = lambda: "x" * max(1, round(draw.gauss(5, 2))) + str(draw.randrange(10**6))
    clean = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(draw.randrange(3, 40))) for _ in range(300)]
    lines = ["\n".join(x for _ in range(40) for x in (f"{word()} {word()} {word()}", draw.choice(["read more", "click here", "sign up now"]))) for _ in range(20)]
    symbols = [" ".join(draw.choice(["$$$", "<<>>", "|&|"]) + word() for _ in range(100)) for _ in range(20)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + lines + symbols)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    assert len(kept & set(range(300))) >= 297
    assert len(kept & set(range(300, 320))) <= 2
    assert len(kept & set(range(320, 340))) <= 2


def test_small_and_empty_groups(table):
    assert quality.quality(table([])).count() == 0
    assert quality.filtered(table([])).count() == 0
    few = table([(k, "some plain words in a text that is long enough to pass", None, None) for k in range(3)])
    assert [(r.kept, r.fit) for r in quality.quality(few).collect()] == [(True, "none")] * 3


def test_it_runs_no_python(table):
    docs = table(["a b c"])
    text = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
