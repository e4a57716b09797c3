"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._text import WordHashes, ngram_hashes, sliding_min

#: Benchmark text that one broadcast index covers; a larger benchmark is taken in blocks, one after the other.
BLOCK_BYTES = 8_000_000
#: Bytes of words: digits, a-z, and all beyond ASCII. A-Z become a-z, the rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def bench_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text whose A-Z count as a-z."""
    return text.translate(_TABLE).split() if text else []


class Index:
    """Windows of benchmark items: by length, the sorted hashes with item and offset of each, and the winnowed anchors of full windows."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.names = [name for name, _ in items]
        self.words = [bench_words(text) for _, text in items]
        self.held: dict = {}
        memo, parts = WordHashes(), defaultdict(list)
        for k, words in enumerate(self.words):
            if words:
                n = min(window, len(words))
                h = ngram_hashes(memo.of(words), n)
                parts[n].append((h, np.full(len(h), k, np.int64), np.arange(len(h))))
        self.by_length = {}
        for n, found in parts.items():
            h, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            self.by_length[n] = h[order], item[order], at[order]
        anchors = [self.anchors(memo.of(words)) for words in self.words if len(words) >= window]
        self.anchored = np.unique(np.concatenate(anchors)) if anchors else np.zeros(0, np.uint64)

    def anchors(self, hashes: np.ndarray) -> np.ndarray:
        """For each window, the least hash of its runs of `gram` words: equal windows have equal anchors."""
        return sliding_min(ngram_hashes(hashes, self.gram), self.window - self.gram + 1)

    def _holders(self, n: int, low: int) -> dict[tuple[bytes, ...], set[int]]:
        """The windows of n words whose hash stands at low, with the items that hold each; found once."""
        if (n, low) not in self.held:
            known, item, at = self.by_length[n]
            own = self.held[n, low] = {}
            for k in range(low, int(np.searchsorted(known, known[low], "right"))):
                own.setdefault(tuple(self.words[item[k]][at[k] : at[k] + n]), set()).add(int(item[k]))
        return self.held[n, low]

    def find(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Marks of the words that lie in an occurrence of a window, and the items whose windows occur."""
        marks, items = np.zeros(len(words) + 1, np.int64), set()
        for n, (known, item, at) in self.by_length.items():
            if len(words) < n:
                continue
            if n == self.window:
                anchors = self.anchors(hashes)
                place = np.searchsorted(self.anchored, anchors)
                place[place == len(self.anchored)] = 0
                seeds = np.flatnonzero(self.anchored[place] == anchors)
                if not len(seeds):
                    continue
                grams = ngram_hashes(hashes, n)[seeds]
            else:
                seeds = np.arange(len(words) - n + 1)
                grams = ngram_hashes(hashes, n)
            low = np.searchsorted(known, grams, "left")
            hits = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == grams)
            told = set()  # windows whose items are listed already
            for s, a in zip(seeds[hits].tolist(), low[hits].tolist(), strict=True):
                own = tuple(words[s : s + n])
                if own not in told:
                    if (holders := self._holders(n, a).get(own)) is None:  # the words decide, not the hash
                        continue
                    told.add(own)
                    items |= holders
                marks[s] += 1
                marks[s + n] -= 1
        return np.cumsum(marks[:-1]) > 0, items


def indexes(benchmark: DataFrame, window: int, gram: int, id_col: str, text_col: str, block_bytes: int) -> Iterator:
    """Broadcast indexes that cover the benchmark in blocks of about block_bytes of text; items with equal texts are dealt out like others."""
    slim = benchmark.select(benchmark[id_col].cast("string").alias("id"), benchmark[text_col].cast("binary").alias("text")).filter("text is not null").dropDuplicates()
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        own = slim if blocks == 1 else slim.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        items = [(r.id, bytes(r.text)) for r in own.collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(Index(items, window, gram))


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """What documents share with benchmark items: doc_id, n_words, n_hit, items (sorted strings), spans (start, words); a row for each input row.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Of each
    window, on both sides, the least hash of its runs of `gram` words is kept as its anchor; document windows whose
    anchor a benchmark window has are compared whole, by hash and then by word, and overlapping hits grow into spans.
    Equal windows have equal anchors, so no shared span of `window` words is missed, and none is reported falsely.

    Documents aren't shuffled. The benchmark's index is broadcast in blocks of at most block_bytes of text (a longer item
    is a block of its own); from the second on, the documents and what was found are written and read in between.

    Null or wordless texts, and an empty benchmark, give no words or hits. Items without text don't count; one with a null
    id marks words but isn't listed; items that repeat an id count once. Ids of documents may be null or repeat. Other
    columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"), F.lit(None).cast("binary").alias("marks"), F.array().cast("array<string>").alias("items"))

    def step(frame: DataFrame, index) -> DataFrame:
        def run(batches):
            memo, known = WordHashes(), index.value
            for batch in batches:
                marks, items = [], []
                for text, old, names in zip(*(batch.column(c) for c in ("text", "marks", "items")), strict=True):
                    words = bench_words(text.as_py())
                    hit, found = known.find(words, memo.of(words))
                    if old.is_valid:
                        hit |= np.frombuffer(old.as_py(), bool)
                    marks.append(hit.tobytes())
                    items.append(sorted({*names.as_py(), *(known.names[k] for k in found if known.names[k] is not None)}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "marks", "items"]
                )

        return frame.mapInArrow(run, f"doc_id {kind}, text binary, marks binary, items array<string>")

    def finish(batches):
        for batch in batches:
            words, hits, spans = [], [], []
            for mark in batch.column("marks"):
                hit = np.frombuffer(mark.as_py(), bool)
                edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                words.append(len(hit))
                hits.append(int(hit.sum()))
                spans.append([{"start": int(a), "words": int(b - a)} for a, b in edges.reshape(-1, 2)])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), batch.column("items"), pa.array(spans, kinds)],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    for k, index in enumerate(indexes(benchmark, window, gram, item_col, item_text_col, block_bytes)):
        state = step(written(state, "hits") if k else state, index)
    found = state.select("doc_id", "marks", "items")
    return found.mapInArrow(finish, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: bigint, words: bigint>>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, gram: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that share no window with the benchmark; see ``contamination``."""
    out = docs
    for index in indexes(benchmark, window, gram, item_col, item_text_col, block_bytes):

        def run(batches, index=index):
            memo, known = WordHashes(), index.value
            for batch in batches:
                clean = []
                for text in batch.column(text_col).cast(pa.binary()):
                    words = bench_words(text.as_py())
                    clean.append(not known.find(words, memo.of(words))[0].any())
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
