"""Token counts and binary ids, against the library."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
import unicodedata
from conftest_llm import ODD

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from flowspark.llm import id_output, token_count  # noqa: E402

SAMPLES = ["a<|endoftext|>b", "<|START oftext|><|startoftext|>", "İstanbul ΣΑΣ ς", "don't 's'S 'S can'T", "ÀÉ́ é àb", "’s x y \x1c z\x85w ​　b", "12 345½²", "ß ẞ ǅ Ŀ", *[t or "" for t in ODD]]


def noise():
    draw = random.Random(5)
    return ["".join(draw.choice("aB'sStT 1²é<|>́Σ.,!-_   \x1d") for _ in range(draw.randint(1, 40))) for _ in range(2000)]


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def test_counts_equal_the_library(tokenizer, library):
    texts = SAMPLES + noise()
    count = token_count.token_counter(tokenizer, token_count.whole_tokens(tokenizer))
    assert count([t.encode() for t in texts]) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_equal_the_library(tokenizer, library):
    encode = id_output.text_encoder(tokenizer)
    for t in SAMPLES + noise():
        assert list(np.frombuffer(encode(t.encode()), "<u4")) == library.encode(t, add_special_tokens=False).ids


def test_characters_are_proven(library):
    """Below PROVEN_BELOW the library's normal form and splits are those that the shortcut assumes."""
    import regex

    find = regex.compile(token_count.PRE_TOKEN).findall
    for cp in range(ord(token_count.PROVEN_BELOW)):
        c = chr(cp)
        normal = unicodedata.normalize("NFC", c).lower()
        assert library.normalizer.normalize_str(c) == (" " if regex.fullmatch(r"\s", normal) else normal)
        text = f"a{c}a1{c}1..{c}.."
        assert [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)] == find(text)


def test_whole_tokens_are_one_token(tokenizer, library):
    whole = sorted(token_count.whole_tokens(tokenizer))
    assert len(whole) > 30_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(whole[::50], add_special_tokens=False))


def test_count_tokens(table, tokenizer, library):
    docs = table(ODD + [None])
    got = {r.doc_id: r for r in token_count.count_tokens(docs, tokenizer, limit=100).collect()}
    for k, t in enumerate([*ODD, None]):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 100)
    assert token_count.count_tokens(docs.limit(0), tokenizer).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 4095, 4096, 4097, 20_000])
@pytest.mark.parametrize("top", [1, 2, 50, 40_000, 2**40, 2**60, 2**63])
def test_codec_round_trip(n, top):
    draw = np.random.default_rng(n)
    ids = draw.integers(0, top, n, dtype=np.uint64)
    ids[draw.random(n) < 0.3] = 0
    if n > 500:
        ids[100:400] = 0
    doc_ids, lengths, back = id_output.unpack(id_output.pack([None, -3], [n, 0], ids))
    assert doc_ids == [None, -3]
    assert list(lengths) == [n, 0]
    assert (back == ids).all()
    if top <= 2**32:
        assert (id_output.unpack(id_output.pack([], [], ids.astype("<u4")))[2] == ids).all()


def test_files_hold_all_ids_in_order(table, tokenizer, library):
    texts = [*ODD, *noise()[:50]]
    docs = table([(1000 - k, t) for k, t in enumerate(texts)]).repartition(3)
    for file_ids in (50, 10**6):
        got = sorted(id_output.round_trip(docs, tokenizer, end_id=1, file_ids=file_ids).collect())
        start = 0
        for r, (doc_id, t) in zip(got, sorted((1000 - k, t) for k, t in enumerate(texts)), strict=True):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            assert (r.doc_id, r.start, bytes(r.ids)) == (doc_id, start, struct.pack(f"<{len(ids)}I", *ids))
            start += len(ids)
    assert id_output.round_trip(docs.limit(0), tokenizer).count() == 0
    assert zlib.crc32(b"") == 0


def test_null_and_repeated_ids(table, tokenizer):
    docs = table([(5, "b"), (None, "a"), (5, "a"), (5, "b"), (None, None)])
    got = sorted(((r.start, r.doc_id, len(r.ids)) for r in id_output.round_trip(docs, tokenizer).collect()))
    assert [d for _, d, _ in got] == [None, None, 5, 5, 5]
    assert [s for s, _, _ in got] == [0, 1, 3, 5, 7]


def test_special_strings_match_in_their_own_case_only(tokenizer):
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(tokenizer), id_output.text_encoder(tokenizer)
    for s in ("<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "x<|EndOfText|>Y", "X<|endoftext|>Y", "<B>"):
        for text in (f"a {s} b", f"A {s.lower()} {s}", f"{s} {s.lower()}"):
            assert np.frombuffer(encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_string_ids_are_refused_and_other_columns_not_read(table, tokenizer):
    docs = table([(1, "a b"), (2, "c")]).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "start")
    assert sorted((r.doc_id, r.n_tokens) for r in token_count.count_tokens(docs, tokenizer, limit=2048).collect()) == [(1, 2), (2, 1)]
    assert sorted((r.doc_id, r.start) for r in id_output.round_trip(docs, tokenizer).collect()) == [(1, 0), (2, 3)]
    with pytest.raises(TypeError, match="whole-number"):
        id_output.round_trip(docs.withColumn("doc_id", docs.doc_id.cast("string")), tokenizer)
