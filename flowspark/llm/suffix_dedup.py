"""Repeated passages by a sparse suffix array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, long_ids, written
from ._text import WordHashes, mix, ngram_hashes, split_words

#: Suffixes that a task hands back at once.
_ROWS = 16_384


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each run of width values, the first of equal ones."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    out, size = np.arange(len(grams)), 1

    def least(a, b):
        return np.where(grams[b] < grams[a], b, a)

    while size * 2 <= width:
        out, size = least(out[:-size], out[size:]), size * 2
    return least(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def _suffixes(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """The suffixes kept of docs (doc_id, text, mark): anchor (hash of the first `gram` words), doc_id, mark, at, low, high.

    A suffix is kept where a run of `least` words has its minimiser. It stands for the runs that chose it, which begin
    low to high words before it.
    """

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text, mark in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("mark").to_pylist(), strict=True):
                words = split_words(text.as_py())
                if len(words) < least:
                    continue
                grams = mix(ngram_hashes(memo.of(words), gram))
                chosen = minimisers(grams, least - gram + 1)
                first = np.flatnonzero(np.diff(chosen, prepend=-1))
                at, last = chosen[first], np.append(first[1:], len(chosen)) - 1
                for x, new in zip(out, (grams[at].view(np.int64), np.full(len(at), doc_id), np.full(len(at), mark), at, at - last, at - first), strict=True):
                    x.append(new)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["anchor", "doc_id", "mark", "at", "low", "high"])

    return docs.mapInArrow(run, "anchor long, doc_id long, mark long, at long, low long, high long")


def _contexts(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Of docs (doc_id, text, mark, own: suffixes), each suffix with its next `least` words and, from the nearest on, those before it that a run can reach, as 32-bit numbers of words."""
    before = least - gram

    def run(batches):
        memo = WordHashes()
        names = ["right", "left", "doc_id", "mark", "at", "low", "high"]
        for batch in batches:
            held, rows = [[] for _ in names], 0

            def out():
                rights, lefts = (pa.array([r.tobytes() for x in side for r in x], pa.binary()) for side in held[:2])
                return pa.RecordBatch.from_arrays([rights, lefts, *(pa.array(np.concatenate(x), pa.int64()) for x in held[2:])], names)

            for doc_id, text, mark, own in zip(*(batch.column(c) for c in ("doc_id", "text", "mark", "own")), strict=True):
                at, low, high = (np.asarray(own.values.field(c)) for c in ("at", "low", "high"))
                words = split_words(text.as_py())
                # 0 stands before and after the text, and no word has it
                line = np.zeros(len(words) + before + least, np.uint32)
                line[before : before + len(words)] = np.maximum(memo.of(words) >> np.uint64(32), np.uint64(1))
                held[0].append(line[at[:, None] + before + np.arange(least)])
                held[1].append(line[at[:, None] + before - 1 - np.arange(before)])
                for x, new in zip(held[2:], (np.full(len(at), doc_id.as_py()), np.full(len(at), mark.as_py()), at, low, high), strict=True):
                    x.append(new)
                rows += len(at)
                if rows >= _ROWS:
                    yield out()
                    held, rows = [[] for _ in names], 0
            if rows:
                yield out()

    return docs.mapInArrow(run, "right binary, left binary, doc_id long, mark long, at long, low long, high long")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of 4 * width bytes as rows of 32-bit numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)
    return np.frombuffer(column.buffers()[2], np.uint32, len(column) * width, int(ends[column.offset])).reshape(len(column), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their first words rows have in common."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


class Neighbours:
    """Compares neighbours of the suffix array.

    Of each two it knows how many words they share to the right and to the left. If these are `least` together, the match
    is a repeated passage of both. Else, runs of words of which the two share the part to the right, but not all of the
    part to the left, might stand at another suffix that shares both; such runs are given by hash, to be compared with
    all others. A run that occurs twice is found by one way or the other: all suffixes that share its right part lie side
    by side, and if no two neighbours among them share all of it, those that have it have a neighbour that doesn't.
    """

    def __init__(self, least: int, gram: int):
        self.least, self.before = least, least - gram
        self.factors = np.random.default_rng(1).integers(1, 1 << 63, (2, least), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def compare(self, x: dict, y: dict) -> tuple[dict, dict]:
        """Passages (doc_id, mark, start, n) and runs (h1, h2, doc_id, mark, start) from rows x and their next ones y."""
        other = (x["doc_id"] != y["doc_id"]) | (x["mark"] != y["mark"]) | (x["at"] != y["at"])  # else a text that is there twice
        right, left = _common(x["right"], y["right"]), _common(x["left"], y["left"])
        hit = np.flatnonzero(other & (right + left >= self.least))
        passages = {c: np.concatenate([x[c][hit], y[c][hit]]) for c in ("doc_id", "mark")}
        passages |= {"start": np.concatenate([x["at"][hit] - left[hit], y["at"][hit] - left[hit]]), "n": np.tile((right + left)[hit], 2)}
        runs = []
        for side in (x, y):
            first = np.maximum(np.maximum(side["low"], self.least - right), left + 1)
            count = np.where(other, np.maximum(side["high"] - first + 1, 0), 0)
            row = np.repeat(np.arange(len(count)), count)
            back = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            hashes = [np.zeros(len(row), np.uint64) for _ in self.factors]
            with np.errstate(over="ignore"):
                for k in range(self.least):  # the run's k-th word
                    place = k - back
                    word = np.where(place < 0, side["left"][row, np.clip(-1 - place, 0, self.before - 1)], side["right"][row, np.clip(place, 0, self.least - 1)]).astype(np.uint64)
                    for h, factors in zip(hashes, self.factors, strict=True):
                        h += word * factors[k]
            h1, h2 = (mix(h).view(np.int64) for h in hashes)
            runs.append({"h1": h1, "h2": h2, "doc_id": side["doc_id"][row], "mark": side["mark"][row], "start": side["at"][row] - back})
        return passages, {c: np.concatenate([r[c] for r in runs]) for c in runs[0]}


_NAMES = ["right", "left", "doc_id", "mark", "at", "low", "high"]
_PAIRED = "kind byte, h1 long, h2 long, doc_id long, mark long, start long, n long, part long, last boolean, right binary, left binary, low long, high long"


def _paired(rows: DataFrame, least: int, gram: int, part_of_rows: bool) -> DataFrame:
    """What neighbours in sorted rows give: passages as kind 0, runs as kind 1, and each task's first and last row as kind 2.

    With part_of_rows, the rows are such first and last ones, and only the last of a task and the first of the next are
    neighbours.
    """
    widths = {"right": least, "left": least - gram}
    columns = [x.split()[0] for x in _PAIRED.split(", ")]
    kinds = dict(zip(columns, (pa.int8(), *[pa.int64()] * 7, pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True))

    def table(kind, values):
        n = len(values["doc_id"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), t) if c == "kind" else pa.array(values[c], t) if c in values else pa.nulls(n, t) for c, t in kinds.items()], columns)

    def run(batches):
        from pyspark import TaskContext

        work, part, last = Neighbours(least, gram), TaskContext.get().partitionId(), None

        def edge(row, is_last):
            values = {c: ([row[c][0].tobytes()] if c in widths else row[c]) for c in _NAMES if c != "at"}
            return table(2, values | {"start": row["at"], "part": np.array([part]), "last": np.array([is_last])})

        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: _matrix(batch.column(c), widths[c]) if c in widths else np.asarray(batch.column(c)) for c in _NAMES}
            if part_of_rows:
                own["last"] = batch.column("last").to_numpy(zero_copy_only=False)
            if last is None and not part_of_rows:
                yield edge({c: v[:1] for c, v in own.items()}, False)
            both = {c: np.concatenate([last[c], v]) for c, v in own.items()} if last is not None else own
            x, y = ({c: v[a:b] for c, v in both.items()} for a, b in ((None, -1), (1, None)))
            if part_of_rows:
                keep = x["last"] & ~y["last"]
                x, y = ({c: v[keep] for c, v in side.items()} for side in (x, y))
            for kind, found in enumerate(work.compare(x, y)):
                for at in range(0, len(found["doc_id"]), _ROWS):
                    yield table(kind, {c: v[at : at + _ROWS] for c, v in found.items()})
            last = {c: v[-1:].copy() for c, v in own.items()}
        if last is not None and not part_of_rows:
            yield edge(last, True)

    return rows.mapInArrow(run, _PAIRED)


def repeats(docs: DataFrame, *, least: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal passages of `least` words or more that stand at another place too: doc_id, start (word), n_words; a row for each passage.

    A word belongs to one if a run of `least` words around it occurs twice or more in all texts, or in one; the result
    lists, for each document, the longest spans of such words, first occurrences included.

    Of all suffixes, those stay that start at a minimiser, the least hash of `gram` words in some run of `least` words,
    and whose first `gram` words occur twice. They are sorted by their words, then by those before them, and each is
    compared with the next: what both share to the right and to the left of the suffix is a passage if it is long enough.
    See ``Neighbours`` for runs that neighbours share in part only. Words are compared by 32-bit hashes of each, 50 in a
    row (a run that neighbours don't settle, by 128 bits).

    Sorting is by ranges that include the place, so copies of any number are shared out over tasks; where a task ends,
    its last row and the next one's first are compared apart, two rows of each task. Texts move once, for documents with
    a suffix that another may match.

    Null and short texts, and documents with a null id, have no passages; an id that isn't a whole number is refused.
    Rows that repeat an id and text are one document; texts that share an id are told apart by 24 bits of hash. Other
    columns aren't read.
    """
    docs = docs.select(long_ids(docs, id_col), docs[text_col].cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    docs = docs.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 40))
    kept = written(_suffixes(docs, least, gram), "suffixes")
    # written, so that both sides of the join are plain tables, of which the engine can split a hot anchor's rows
    shared = written(kept.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    own = kept.join(shared, "anchor").groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("by")).agg(F.collect_list(F.struct("at", "low", "high")).alias("own"))
    rows = docs.join(own, (F.col("doc_id") == F.col("of")) & (F.col("mark") == F.col("by"))).select("doc_id", "text", "mark", "own")
    made = written(_contexts(rows, least, gram), "contexts")
    discard(kept)
    discard(shared)
    order = ["right", "left", "doc_id", "mark", "at"]
    pairs = written(_paired(made.repartitionByRange(*order).sortWithinPartitions(*order), least, gram, False), "pairs")
    discard(made)
    ends = pairs.filter("kind = 2").withColumnRenamed("start", "at").repartition(1).sortWithinPartitions("part", "last")
    pairs = pairs.filter("kind < 2").unionByName(_paired(ends.select(*_NAMES, "last"), least, gram, True))
    runs = pairs.filter("kind = 1").select("h1", "h2", "doc_id", "mark", "start")
    place = F.struct("doc_id", "mark", "start")
    twice = runs.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("h1", "h2")
    spans = pairs.filter("kind = 0").select("doc_id", "mark", "start", "n")
    spans = spans.union(runs.join(twice, ["h1", "h2"]).select("doc_id", "mark", "start", F.lit(least).cast("long")))
    spans = spans.groupBy("doc_id", "mark", "start").agg(F.max("n").alias("n"))
    along = Window.partitionBy("doc_id", "mark").orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("long"), F.lit(1)))
    named = fresh.withColumn("k", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = named.groupBy("doc_id", "mark", "k").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return out.select("doc_id", "start", (F.col("end") - F.col("start")).alias("n_words")).distinct()
