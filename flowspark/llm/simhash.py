"""Near-duplicates by SimHash, compared in bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._shared import discard, written
from ._text import whole_groups

BITS = 64
#: Fingerprints that one call of the kernel compares with each other; larger groups are cut up by further bits first.
KERNEL_ROWS = 4096
#: Groups up to this size are compared pair by pair.
PAIRWISE_ROWS = 16
#: Groups above this size are dealt out by further bits before they meet.
HOT_ROWS = 1 << 15


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of a text's word shingles: a bit is 1 if set in over half of the shingles' XXH64, repeats counted.

    A-Z count as a-z; words are what ASCII white space separates. A text of fewer words than width is one shingle; one
    without words gives 0.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes, stored vertically: row b holds bit b of all fingerprints, 64 of them to a word; zeros fill the last word."""
    n = -(-len(prints) // 64) * 64
    bits = np.zeros((n, BITS), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def near_pairs(prints: np.ndarray, radius: int, queries: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i > j of distinct fingerprints at a distance of up to radius, from carry-save counters over bit planes.

    A word of counters holds 64 candidates of one query. Each plane's differing bits are added to counters that saturate
    beyond the radius; every 8 planes the (query, word) blocks in which all 64 candidates have exceeded it are given up.
    """
    table = planes(prints)
    digits = max(1, int(radius + 1).bit_length())
    limit = radius + 1
    words = table.shape[1]
    last = len(prints)
    for at in range(0, last, queries):
        own = prints[at : at + queries]
        # only candidates before the query: words beyond its own hold none
        q, w = np.nonzero(np.arange(words)[None, :] <= ((at + np.arange(len(own))) // 64)[:, None])
        count = [np.zeros(len(q), np.uint64) for _ in range(digits)]
        over = np.zeros(len(q), np.uint64)
        for b in range(BITS):
            flip = np.where((own >> np.uint64(b)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
            carry = table[b][w] ^ flip[q]
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            reached = ~np.uint64(0)
            for d in range(digits):
                reached = reached & (count[d] if limit >> d & 1 else ~count[d])
            over |= reached | carry
            if b % 8 == 7:
                alive = over != ~np.uint64(0)
                if not alive.all():
                    q, w, over = q[alive], w[alive], over[alive]
                    count = [c[alive] for c in count]
                if not len(q):
                    break
        if len(q):
            hit, bit = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
            i, j = at + q[hit], w[hit] * 64 + bit
            keep = j < i
            if keep.any():
                yield i[keep], j[keep]


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of the pairs; labels, changed in place, hold each index's smallest known companion."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels, further := labels[labels]):
            labels[:] = further


def link_group(prints: np.ndarray, free: int, radius: int, labels: np.ndarray, at: np.ndarray) -> None:
    """Joins, in labels, all of the given distinct fingerprints that lie within the radius; they agree on all bits not in free.

    A group too large for the kernel is cut by parts of its free bits, of which two near fingerprints share one at least.
    """
    own = prints[at]
    bits = [b for b in range(BITS) if free >> b & 1]
    if len(at) <= KERNEL_ROWS or len(bits) <= radius + 1:
        for i, j in near_pairs(own, radius):
            unite(labels, at[i], at[j])
        return
    for k in range(radius + 1):
        mask = sum(1 << b for b in bits[k :: radius + 1])
        key = own & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, edges):
            if len(part) > 1:
                link_group(prints, free & ~mask, radius, labels, at[part])


def bands(radius: int) -> list[int]:
    """Masks of which two fingerprints within the radius agree on one at least: all but `radius` of radius + 3 blocks of bits."""
    blocks = [0] * (radius + 3)
    for b in range(BITS):
        blocks[b * len(blocks) // BITS] |= 1 << b
    return [sum(chosen) for chosen in combinations(blocks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SimHash of each document: doc_id, print (the 64 bits as a signed long); a row for each input row, no shuffle."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            prints = np.fromiter((simhash(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, print long")


def parts(mask: int, radius: int) -> list[int]:
    """mask with one of radius + 1 parts of the other bits: two fingerprints within the radius that agree on mask agree on one of these as well."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: radius + 1]) for k in range(radius + 1)]


def _dealt(prints: DataFrame, radius: int, hot_rows: int) -> DataFrame:
    """Fingerprints under what they agree on: mask, key (the bits of the mask), print. Groups of over hot_rows are dealt by larger masks, as long as more than radius bits are left."""
    masks, now, done = bands(radius), prints, []
    bound = F.array(*(F.lit(_signed(m)) for m in masks))
    while True:
        now = now.select("print", F.explode(bound).alias("mask")).withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        if BITS - max(m.bit_count() for m in masks) <= 2 * radius + 2:
            done.append(now)
            break
        now = written(now, "bands") if done else now  # each level but the first is made of a few groups
        hot = written(now.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("mask", "key"), "hot")
        if hot.isEmpty():
            done.append(now)
            break
        done.append(now.join(hot, ["mask", "key"], "left_anti").select("print", "mask", "key"))
        now = now.join(hot, ["mask", "key"], "left_semi")
        finer = {m: parts(m, radius) for m in masks}
        bound = F.create_map(*(x for m, own in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(f)) for f in own)))))[F.col("mask")]
        masks = [f for own in finer.values() for f in own]
    return reduce(DataFrame.unionByName, done).select("mask", "key", "print")


def links(prints: DataFrame, radius: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (u, v) that join every two of the distinct fingerprints (column print) within the radius, directly or through others.

    Fingerprints meet in groups that agree on a mask of `bands`; groups of over hot_rows are first dealt out by further
    bits (``parts``), again and again, so what a task gets at once is bounded whatever the corpus holds. Each group sends
    back a tree of links, never its pairs.
    """
    dealt = _dealt(prints, radius, hot_rows).repartition("mask", "key").sortWithinPartitions("mask", "key", "print")

    def run(batches):
        for mask, key, signed in whole_groups(batches, ("mask", "key", "print")):
            prints = np.ascontiguousarray(signed).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1, [len(key)]])
            sizes = np.diff(starts)
            labels = np.arange(len(prints))
            small = np.repeat(np.where((sizes > 1) & (sizes <= PAIRWISE_ROWS), np.arange(len(sizes)), -1), sizes)
            for step in range(1, PAIRWISE_ROWS):
                if step >= len(prints):
                    break
                i = np.flatnonzero((small[step:] == small[:-step]) & (small[step:] >= 0))
                if not len(i):
                    break
                i = i[np.bitwise_count(prints[i + step] ^ prints[i]) <= radius]
                unite(labels, i + step, i)
            for g in np.flatnonzero(sizes > PAIRWISE_ROWS):
                free = ((1 << 64) - 1) & ~(int(mask[starts[g]]) & ((1 << 64) - 1))
                link_group(prints, free, radius, labels, np.arange(starts[g], starts[g + 1]))
            own = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(signed[own]), pa.array(signed[labels[own]])], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose SimHashes are linked: doc_id, fingerprint (16 hex digits), component_id; a row for each input row.

    Two documents are linked if their fingerprints differ in up to radius bits; component_id is the smallest doc_id that
    a chain of links reaches, the document itself included. Equal fingerprints are one node; of groups of near ones,
    trees of links are gathered, so thousands of copies make neither pairs nor one task's work.

    Null and wordless texts have fingerprint 0, linked like any other. A null id is never the smallest; a group without
    any other id has a null component_id. Rows that repeat an id are separate. Other columns aren't read.
    """
    prints = written(fingerprints(docs, width, id_col, text_col), "prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    classes = written(classes, "distinct")
    linked = components(links(classes.select("print"), radius))
    named = classes.join(linked, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("label", "print").alias("label"))
    named = written(named, "classes")
    discard(classes)
    merged = named.groupBy("label").agg(F.min("least").alias("component_id"))
    joined = named.join(merged, "label").select("print", "component_id")
    out = prints.join(joined, "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without near-duplicates: of each group of ``near_duplicates`` the one with the smallest id stays; see ``without``."""
    return without(docs, near_duplicates(docs, radius=radius, width=width, id_col=id_col, text_col=text_col), id_col, text_col)


def without(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which groups (doc_id, component_id) names the id as its component's, with all their columns.

    Rows that share an id are judged together: they stay if one of them is its group's smallest, and of those that share
    the text too one stays. Documents with a null id stay, as no group can name them.

    The ids that go are anti-joined: while they fit a broadcast by the engine's own measure the texts stay where they
    are; beyond that each text moves once. Only rows whose id repeats are looked at for equal texts.
    """
    groups = groups.filter("doc_id IS NOT NULL")
    ids = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    ids = written(ids.filter("n > 1 OR NOT stays"), "ids")
    names = [f"d{k}" for k in range(len(docs.columns))]
    own, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows, listed = docs.toDF(*names), ids.select(F.col("doc_id").alias(own))
    out = rows.join(listed, own, "left_anti")
    again = ids.filter("stays").select(F.col("doc_id").alias(own))
    if not again.isEmpty():
        out = out.unionByName(rows.join(again, own, "left_semi").dropDuplicates([own, text]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
