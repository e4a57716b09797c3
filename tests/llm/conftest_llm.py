"""Shared by the tests of the corpus operators."""

import random

import pytest


@pytest.fixture
def table(spark):
    """A documents table from texts or (doc_id, text) pairs, or rows of all columns."""

    def make(rows, **more):
        full = []
        for k, r in enumerate(rows):
            doc_id, text, lang, source = (*((k, r) if isinstance(r, str) or r is None else r), "en", "src")[:4]
            full.append((doc_id, text, lang, source, len(text or "")))
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


def prose(draw: random.Random, n: int, vocabulary: int = 50) -> str:
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


#: Texts that any operator must take.
ODD = [None, "", "   \n\t ", "one", "two words", "ÀÉ ñandú ß İ ǅ", "a\x00b \x1c \x85 c", "日本語 テスト 😀👍🏽", "x" * 5000, "same " * 3000, "tie", "tie"]
