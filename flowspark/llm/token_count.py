"""Token counts with the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import MEMO_PIECES, kept_in_worker

#: How the tokenizer splits lower-case text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Below this character the library's normal form is lower case alone, and its classes are those of PRE_TOKEN here (tested for each character).
PROVEN_BELOW = "\u0300"


@lru_cache
def whole_tokens(path: str) -> frozenset[str]:
    """Strings that the tokenizer encodes as one token when they stand alone, found by encoding every string of the vocabulary that ends a word.

    Runs on the driver, once for a vocabulary; its size is bounded by that of the vocabulary.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = [t.removesuffix(WORD_END) for t in tokenizer.get_vocab(with_added_tokens=False) if t.endswith(WORD_END)]
    texts = [tokenizer.decode([tokenizer.token_to_id(t + WORD_END)]).removesuffix(WORD_END).strip() if not t.isascii() else t for t in vocabulary]
    texts = sorted({t for t in texts if t and t < PROVEN_BELOW and t == t.lower()})
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, found, strict=True) if len(e.ids) == 1 and len(split(t)) == 1)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def piece_encoder(path: str):
    """Two functions: from a piece of UTF-8 text without ASCII white space to its pre-tokens, or None if it is best left to the library as it is; and from a pre-token, or such a piece, to its ids.

    Pieces with a character from PROVEN_BELOW on, or with a special string, are left to the library.
    """
    import os

    import regex

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    find, table, merge = regex.compile(PRE_TOKEN).findall, byte_symbols(), tokenizer.model.tokenize

    def cut(text: str) -> list[str] | None:
        if max(text) >= PROVEN_BELOW or ("<" in text and any(s in text for s in special)):
            return None
        return find(text.lower())

    def ids(text: str, whole_text: bool) -> list[int]:
        if whole_text:
            return tokenizer.encode(text, add_special_tokens=False).ids
        return [t.id for t in merge(text if text.isalnum() and text.isascii() else text.encode().decode("latin-1").translate(table))]

    return cut, ids


def token_counter(path: str, whole: frozenset[str]):
    """A function from UTF-8 texts to their numbers of tokens, as the library counts them without special tokens.

    White space never lies in a token, so a text counts as the sum of what stands between ASCII white space; each such
    piece is counted once and remembered. A new piece is cut into pre-tokens; those in ``whole`` are one token each and
    only the others are merged.
    """
    cut, ids = piece_encoder(path)
    merged: dict[str, int] = {}
    pieces: dict[bytes, int] = {}

    def learn(piece: bytes) -> int:
        text = piece.decode("utf-8", "replace")
        tokens = cut(text)
        if tokens is None:
            count = len(ids(text, True))
        else:
            count = 0
            for t in tokens:
                if t in whole:
                    count += 1
                else:
                    n = merged.get(t)
                    if n is None:
                        n = merged[t] = len(ids(t, False))
                    count += n
        pieces[piece] = count
        return count

    def count(texts: list[bytes | None]) -> list[int]:
        out = []
        for text in texts:
            if len(pieces) > MEMO_PIECES:
                pieces.clear()
                merged.clear()
            words = text.split() if text else []
            for w in words:
                if w not in pieces:
                    learn(w)
            out.append(sum(map(pieces.__getitem__, words)))
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); a row for each input row, no shuffle.

    The method holds for word-level BPE files whose merges end in a word-end mark. Null text counts as empty: 0 bytes,
    0 tokens. Ids may be null or repeat. The tokenizer file must be at its path on every executor. Other columns aren't
    read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(("token_counter", tokenizer_path), lambda: token_counter(tokenizer_path, whole.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(counter(texts), pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    out = slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
