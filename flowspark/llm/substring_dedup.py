"""Substring deduplication by seed and extend."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, long_ids, written
from ._text import WordHashes, mix, ngram_hashes, sliding_min, split_words

# A run's place is one long: first window, number of windows (6 bits), and 24 bits of the text's hash, its mark, which tell
# texts apart that share an id.
_COUNT_BITS, _PRINT_BITS = 6, 24
#: Windows in a run at most; also fewer than the words of a window, so that a run's first and last window hold all its words.
RUN = 48


def places(start: np.ndarray, count: np.ndarray, mark: int) -> np.ndarray:
    return (start.astype(np.int64) << (_COUNT_BITS + _PRINT_BITS)) | (count.astype(np.int64) << _PRINT_BITS) | mark


def unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and text print of places."""
    return place >> (_COUNT_BITS + _PRINT_BITS), (place >> _PRINT_BITS) & ((1 << _COUNT_BITS) - 1), place & ((1 << _PRINT_BITS) - 1)


def hashed_windows(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, its anchor (the least hash of its runs of gram words, spread anew) and its own hash. Equal windows agree in both."""
    return mix(sliding_min(ngram_hashes(words, gram), window - gram + 1)), ngram_hashes(words, window)


def anchor_runs(anchors: np.ndarray, hashes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor, hash of the run's words, first window, number of windows.

    No run has a window twice: where a text repeats itself within `most` words, its runs are cut to that distance.
    """
    n = len(anchors)
    longest = next((k for k in range(1, min(most, n)) if (hashes[k:] == hashes[:-k]).any()), most)
    fresh = np.flatnonzero(np.diff(anchors, prepend=anchors[:1] ^ np.uint64(1)))
    begun = np.repeat(fresh, np.diff(fresh, append=n))
    start = np.flatnonzero((np.arange(n) - begun) % longest == 0)
    count = np.diff(start, append=n)
    with np.errstate(over="ignore"):
        content = mix(hashes[start] * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[start + count - 1]) + count.astype(np.uint64))
    return anchors[start], content, start, count


def seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The anchor runs of all documents (doc_id, text, mark): anchor, content, doc_id, place."""

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            out = [[], [], [], []]
            for doc_id, text, mark in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("mark").to_pylist(), strict=True):
                words = split_words(text.as_py())
                if len(words) < window:
                    continue
                anchor, content, start, count = anchor_runs(*hashed_windows(memo.of(words), window, gram), min(RUN, window - gram + 1, window - 1))
                for x, new in zip(out, (anchor.view(np.int64), content.view(np.int64), np.full(len(start), doc_id), places(start, count, mark)), strict=True):
                    x.append(new)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["anchor", "content", "doc_id", "place"])

    return docs.filter("doc_id is not null").mapInArrow(run, "anchor long, content long, doc_id long, place long")


def not_first(rows: DataFrame, alone: bool) -> DataFrame:
    """Of rows (anchor, content, doc_id, place), those that aren't the first of their anchor and content by doc_id and place, as kind 0.

    Rows are dealt by ranges of all four columns and sorted, so a group of any size is shared out over tasks, and each
    task goes through its rows once. What a task can't know, whether its first group began in a task before it, is left
    open: the first rows of a task's first and last group come back as kind 2, for ``resolved``.

    With alone, first rows come back too, as kind 1, unless theirs is the only content of its anchor; those of a task's
    first and last anchor always do.
    """

    def run(batches):
        last = None  # anchor, content, doc_id, place of the last group's first row
        many = opened = False  # the last anchor has a second content, or may have; its only first row is still held back
        edge = True  # the last group is the task's first
        names = ["kind", "anchor", "content", "doc_id", "place"]

        def out(kind, a, c, d, p):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *map(pa.array, (a, c, d, p))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            a, c, d, p = (np.asarray(batch.column(k)) for k in names[1:])
            before = last or (a[0] ^ 1, 0, 0, 0)
            new_anchor = a != np.concatenate([[before[0]], a[:-1]])
            new_group = new_anchor | (c != np.concatenate([[before[1]], c[:-1]]))
            first = np.flatnonzero(new_group)
            group = np.cumsum(new_group)
            fd, fp = np.concatenate([[before[2]], d[first]])[group], np.concatenate([[before[3]], p[first]])[group]
            again = np.flatnonzero(~new_group & ((d != fd) | (p != fp)))
            if len(again):
                yield out(0, a[again], c[again], d[again], p[again])
            if not alone:
                if last is None:
                    yield out(2, a[:1], c[:1], d[:1], p[:1])
            else:
                anchor = np.cumsum(new_anchor)
                firsts = np.bincount(anchor[first], minlength=anchor[-1] + 1)
                several = firsts >= 2
                if last is None:
                    several[anchor[0]] = True
                else:
                    several[0] = many or firsts[0] >= 1
                    if opened and several[0]:
                        yield out(1, *(np.array([x]) for x in last))
                        opened = False
                chosen = first[several[anchor[first]]]
                if len(chosen):
                    yield out(1, a[chosen], c[chosen], d[chosen], p[chosen])
                if anchor[-1] > 0:
                    opened = not several[anchor[-1]]
                many = bool(several[anchor[-1]])
            if len(first):
                edge = edge and last is None and len(first) == 1
                k = first[-1]
                last = (a[k], c[k], d[k], p[k])
        if last is not None and (opened if alone else not edge):
            yield out(1 if alone else 2, *(np.array([x]) for x in last))

    order = ["anchor", "content", "doc_id", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "kind byte, anchor long, content long, doc_id long, place long")


def resolved(found: DataFrame) -> DataFrame:
    """The places (doc_id, place) that ``not_first`` found, with what it left open; that is two rows of each task."""
    ends = found.filter("kind = 2").distinct()
    rank = F.row_number().over(Window.partitionBy("anchor", "content").orderBy("doc_id", "place"))
    late = ends.withColumn("rank", rank).filter("rank > 1")
    return found.filter("kind = 0").select("doc_id", "place").union(late.select("doc_id", "place"))


def listed(rows: DataFrame) -> DataFrame:
    """Places by document, as one array: of, by (mark), places."""
    mark = F.col("place").bitwiseAND(F.lit((1 << _PRINT_BITS) - 1))
    return rows.groupBy(F.col("doc_id").alias("of"), mark.alias("by")).agg(F.collect_list("place").alias("places"))


def meets(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, text, mark) with their listed places."""
    return docs.join(places, (F.col("doc_id") == F.col("of")) & (F.col("mark") == F.col("by")), how).select("doc_id", "text", "mark", "places")


def windows_of(docs: DataFrame, runs: DataFrame, window: int, gram: int) -> DataFrame:
    """Each window of the given runs (doc_id, place) as a row: anchor, content (the window's hash), doc_id, place."""

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            out = [[], [], [], []]
            for doc_id, text, mark, own in zip(*(batch.column(c) if c != "mark" else batch.column(c).to_pylist() for c in ("doc_id", "text", "mark", "places")), strict=True):
                start, count, _ = unplaced(np.asarray(own.values))
                doc_id = doc_id.as_py()
                anchor, content = hashed_windows(memo.of(split_words(text.as_py())), window, gram)
                at = np.unique(np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()))
                for x, new in zip(out, (anchor[at].view(np.int64), content[at].view(np.int64), np.full(len(at), doc_id), places(at, np.ones_like(at), mark)), strict=True):
                    x.append(new)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["anchor", "content", "doc_id", "place"])

    return meets(docs, listed(runs), "inner").mapInArrow(run, "anchor long, content long, doc_id long, place long")


def compared(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """What ``not_first`` finds among the anchor runs of docs (doc_id, text), and among the windows of those that have to be extended.

    Runs and windows are written before they are sorted: finding the ranges reads them once more, which would make them
    twice. They go as soon as they are sorted.
    """
    made = written(seeds(docs, window, gram), "seeds")
    runs = written(not_first(made, alone=True), "runs")
    discard(made)
    made = written(windows_of(docs, runs.filter("kind = 1").select("doc_id", "place"), window, gram), "windows")
    single = written(not_first(made, alone=False), "singles")
    discard(made)
    return runs, single


def deduplicated(docs: DataFrame, *, window: int = 20, gram: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without what an earlier text already has: doc_id, n_words, n_removed, kept (words joined by one space), spans (start, words); a row for each input row.

    A word goes if a window of `window` words that covers it also starts earlier: in a document with a smaller id, or
    before it in the same one. Windows are judged on the input.

    Seeds are winnowed anchors: of each window, the least hash of its runs of `gram` words; consecutive windows with one
    anchor make a run. All runs are sorted by anchor and content once. A run whose whole content stands earlier goes as
    a whole; of runs that share an anchor but not their content, the windows are compared one by one, which extends the
    match both ways as far as words agree. Equal windows share their anchor, so none is missed; runs and windows are
    compared by two 64-bit hashes, of the anchor and of all their words. Groups of copies of any size are shared out by ranges (``not_first``); texts move twice, to meet
    the places found in them.

    Null text has no words. A document with a null id stays as it is and removes nothing. Rows that repeat an id and
    text are one document; texts that share an id count as ordered by place. Words must number below 2**33 in a text.
    Other columns aren't read.
    """
    docs = docs.select(long_ids(docs, id_col), docs[text_col].cast("binary").alias("text"))
    docs = docs.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 64 - _PRINT_BITS))
    runs, single = compared(docs, window, gram)
    gone = runs.filter("kind = 0").select("doc_id", "place").union(resolved(single))

    def run(batches):
        for batch in batches:
            n_words, kept, spans = [], [], []
            for text, own in zip(batch.column("text"), batch.column("places"), strict=True):
                words = split_words(text.as_py())
                out = np.zeros(len(words) + 1, np.int64)
                if own.is_valid:
                    start, count, _ = unplaced(np.asarray(own.values))
                    np.add.at(out, start, 1)
                    np.add.at(out, start + count - 1 + window, -1)
                gone = np.cumsum(out[:-1]) > 0
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                n_words.append(len(words))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if len(edges) else b" ".join(words))
                spans.append([{"start": int(a), "words": int(b - a)} for a, b in edges])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kinds)], ["doc_id", "n_words", "kept", "spans"])

    out = meets(docs, listed(gone), "left").mapInArrow(run, "doc_id long, n_words long, kept string, spans array<struct<start: bigint, words: bigint>>")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), "kept", "spans")
