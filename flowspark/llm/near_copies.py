"""Near-duplicates by exact Jaccard similarity of word shingles; sketches and SimHashes in bit planes find candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._shared import discard, written
from ._text import WordHashes, ngram_hashes, split_words, whole_groups
from .simhash import BITS, PAIRWISE_ROWS, near_pairs, unite, without

#: Texts are near if the Jaccard similarity of their shingle sets is this fraction or more.
SIMILARITY = (4, 5)
#: A set's sketch are its least hashes, this many. Near sets share as many of them as a binomial draw of 64 with 0.8, which
#: is below SHARED once in ten million.
SKETCH, SHARED = 64, 34
#: Candidates with SimHashes further apart are left out. At a similarity of 0.8 a bit differs with probability 0.15 (0.19
#: in sets of few shingles), so of such pairs one in ten million lies beyond, and of nearer ones far fewer.
RADIUS = 30
#: Sets under a key that meet as candidates. Those of a commoner key, whose pairs would grow as the square, meet in blocks,
#: which send back trees of links.
KEY_SETS = 512
#: What a block holds, about: sets, and shingles. Fewer sets still make BLOCKS of them, as long as each has SMALL_BLOCK.
BLOCK_SETS, BLOCK_SHINGLES, BLOCKS, SMALL_BLOCK = 2048, 1 << 19, 8, 256
#: Sets of a block that are compared with another block at once, and pairs of them under a shingle above which it becomes
#: a column of a matrix, so many of them at once.
STRIP, DENSE, COLUMNS = 512, 512, 4096


def shingles(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of words, A-Z as a-z; a text of fewer words is one shingle."""
    words = split_words(text.lower() if text else text)
    return np.unique(ngram_hashes(hashes.of(words), min(width, len(words)))) if words else np.zeros(0, np.uint64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * common >= SIMILARITY[0] * (len(a) + len(b) - common)


def needed(n):
    """How many of the sketch of a set of n (a Column of numbers) have to be looked up, so that one at least is among those of any near set: all but those that near sketches must share, and one.

    A set so small that all near sets have whole sketches shares a known part with them.
    """
    num, den = SIMILARITY
    whole = n <= SKETCH * num // den
    return F.when(whole, n - F.ceil(num * n / den) + 1).otherwise(F.least(n, F.lit(SKETCH)) - SHARED + 1)


def _set_id(own: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(own.tobytes())


def _print(own: np.ndarray) -> int:
    """SimHash of a set."""
    counts = np.unpackbits(own.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<u8")[0])


def _marks(docs: DataFrame, width: int) -> DataFrame:
    """doc_id; of its set: id, SimHash, size and sketch. A row for each input row, no shuffle."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, prints, sizes, sketches = [], [], [], []
            for t in batch.column("text"):
                own = shingles(t.as_py(), width, hashes)
                ids.append(_set_id(own))
                prints.append(_print(own))
                sizes.append(len(own))
                sketches.append(own[:SKETCH].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sketches])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sketches, np.zeros(0, np.int64)])))
            longs = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, prints))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(sizes, pa.int32()), lists], ["doc_id", "node", "print", "n", "sketch"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, print long, n int, sketch array<bigint>")


def _keyed(classes: DataFrame) -> DataFrame:
    """Sets under the rarest hashes of their sketches: key, n_key (sets that have it), node, print, n. Hashes that one set only has are left out, as are the commonest, which near sets needn't share."""
    each = classes.select("node", "print", "n", F.explode("sketch").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("n_key")).filter("n_key > 1")
    shared = each.select("node", "n", "key").join(counts, "key")
    # of those that no other set has, none can be met, but they count among the rarest
    rank = F.row_number().over(Window.partitionBy("node").orderBy("n_key", "key")) + F.least(F.col("n"), F.lit(SKETCH)) - F.count("*").over(Window.partitionBy("node"))
    return shared.withColumn("rank", rank).filter(F.col("rank") <= needed(F.col("n"))).select("node", "key", "n_key").join(classes.select("node", "print", "n"), "node")


def _stars(keyed: DataFrame) -> DataFrame:
    """A first look: each set with the nearest, by SimHash, of those that are the first by id under one of its keys; pairs (u, v)."""
    firsts = keyed.groupBy("key").agg(F.min_by(F.struct("node", "n", "print"), "node").alias("first"))
    both = keyed.join(firsts, "key").filter((F.col("first.node") < F.col("node")) & _sizes_fit(F.col("n"), F.col("first.n")))
    far = F.bit_count(F.col("print").bitwiseXOR(F.col("first.print")))
    near = both.select("node", F.struct(far.alias("far"), F.col("first.node").alias("u")).alias("best")).filter(F.col("best.far") <= RADIUS)
    return near.groupBy("node").agg(F.min("best").alias("best")).select(F.col("best.u").alias("u"), F.col("node").alias("v"))


def _sizes_fit(a, b):
    return SIMILARITY[1] * F.least(a, b) >= SIMILARITY[0] * F.greatest(a, b)


def _step(n):
    """Sizes by powers of 5/4: near sets are of one step or of neighbouring ones."""
    return F.floor(F.ln(n) / F.ln(F.lit(1.25))).cast("int")


def _candidates(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets under a key, of other labels, with sizes and SimHashes that near sets can have.

    Keys whose sets all have one label are done. The others' sets meet in blocks by size, and large blocks in bit planes.
    """
    named = keyed.filter(F.col("n_key") <= KEY_SETS).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    dealt = named.join(mixed, "key").withColumn("step", _step("n")).select("key", "node", "print", "n", "label", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("block"), "step")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "node")

    def run(batches):
        num, den = SIMILARITY
        for key, block, node, signed, n, label, step in whole_groups(batches, ("key", "block", "node", "print", "n", "label", "step")):
            prints = np.ascontiguousarray(signed).view(np.uint64)
            fresh = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            starts = np.concatenate([[0], fresh, [len(key)]])
            sizes = np.diff(starts)

            def pairs():
                small = np.repeat(np.where(sizes <= PAIRWISE_ROWS, np.arange(len(sizes)), -1), sizes)
                for gap in range(1, PAIRWISE_ROWS):
                    i = np.flatnonzero((small[gap:] == small[:-gap]) & (small[gap:] >= 0))
                    if not len(i):
                        break
                    i = i[np.bitwise_count(prints[i + gap] ^ prints[i]) <= RADIUS]
                    yield i + gap, i
                for g in np.flatnonzero(sizes > PAIRWISE_ROWS):
                    a, b = starts[g], starts[g + 1]
                    if (label[a:b] != label[a]).any():
                        for i, j in near_pairs(prints[a:b], RADIUS):
                            yield a + i, a + j

            for i, j in pairs():
                # a pair of one step meets in its first block only
                ok = (label[i] != label[j]) & (np.minimum(step[i], step[j]) + (step[i] != step[j]) == block[i]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
                if ok.any():
                    u, v = node[i[ok]], node[j[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_sets(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the near sets, one of a and one of b. All pairs' common elements are counted: those of few sets pair by pair, others by products of matrices."""
    num, den = SIMILARITY
    n_a, n_b = (np.array([len(x) for x in side]) for side in (a, b))
    ids, codes = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    codes_b, rows_b = codes[n_a.sum() :], np.repeat(np.arange(len(b)), n_b)
    ends_a = np.concatenate([[0], np.cumsum(n_a)])
    held = np.bincount(codes_b, minlength=len(ids))
    holders, first = rows_b[np.argsort(codes_b, kind="stable")], np.cumsum(held) - held
    for at in range(0, len(a), STRIP):
        n = n_a[at : at + STRIP]
        own, rows = codes[ends_a[at] : ends_a[at + len(n)]], np.repeat(np.arange(len(n)), n)
        met = np.bincount(own, minlength=len(ids)) * held
        few = (met[own] > 0) & (met[own] <= DENSE)
        times = held[own[few]]
        j = holders[np.arange(times.sum()) + np.repeat(first[own[few]] - (np.cumsum(times) - times), times)]
        common = np.bincount(np.repeat(rows[few], times) * len(b) + j, minlength=len(n) * len(b)).reshape(len(n), len(b))
        many = np.flatnonzero(met > DENSE)
        for c in range(0, len(many), COLUMNS):
            place = np.full(len(ids), -1)
            place[many[c : c + COLUMNS]] = np.arange(len(many[c : c + COLUMNS]))
            left, right = (np.zeros((k, len(many[c : c + COLUMNS])), np.float32) for k in (len(n), len(b)))
            for matrix, r, of in ((left, rows, place[own]), (right, rows_b, place[codes_b])):
                matrix[r[of >= 0], of[of >= 0]] = 1
            common += (left @ right.T).astype(np.int64)
        i, j = np.nonzero(den * common >= num * (n[:, None] + n_b[None, :] - common))
        yield at + i, j


def _hot(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Sets with a key that over KEY_SETS sets have, dealt to blocks: node, label, pool, step (of sizes), block.

    Keys that a set has are of one pool, so near sets that share such keys only are too. Of a step, a label of many sets
    has blocks of its own, others are dealt whole.
    """
    hot = keyed.filter(F.col("n_key") > KEY_SETS)
    sets = written(hot.groupBy("node").agg(F.min("key").alias("least"), F.first("n").alias("n")), "hot")
    chains = components(hot.join(sets, "node").select(F.col("key").alias("u"), F.col("least").alias("v"))).toDF("least", "pool")
    sets = sets.join(chains, "least", "left").join(labels, "node", "left").withColumn("step", _step("n"))
    sets = sets.select("node", "n", F.coalesce("label", "node").alias("label"), F.coalesce("pool", "least").alias("pool"), "step")
    each = sets.groupBy("pool", "step", "label").agg(F.count("*").alias("own"), F.sum("n").alias("shingles"))
    whole = each.groupBy("pool", "step").agg(F.sum("own").alias("all"), F.sum("shingles").alias("shingles"))
    several = F.least(F.lit(BLOCKS), F.ceil(F.col("all") / SMALL_BLOCK))
    whole = whole.select("pool", "step", "all", F.greatest(F.ceil(F.col("all") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), several).alias("blocks"))
    share = F.col("blocks") * F.col("own") / F.col("all")
    each = each.join(whole, ["pool", "step"]).select("pool", "step", "label", "blocks", F.when(share >= 0.5, F.ceil(share)).alias("of_label"))
    block = F.when(F.col("of_label").isNull(), F.pmod(F.xxhash64("label"), "blocks")).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("node"), "of_label")))
    return written(sets.join(each, ["pool", "step", "label"]).select("node", "label", "pool", "step", block.alias("block")), "hot")


def _hot_links(texts: DataFrame, hot: DataFrame, width: int) -> DataFrame:
    """Links (u, v) that join, with the labels, every two near sets of a pool, directly or through others.

    Blocks of one step or of neighbouring ones meet, unless all their sets have one label; each meeting compares its
    sets, made again from the texts, pair by pair and sends back a tree of links.
    """
    blocks = written(hot.groupBy("pool", "step", "block").agg(F.min("label").alias("a"), F.max("label").alias("b")), "hot")
    x, y = (blocks.select("pool", *(F.col(c).alias(side + c) for c in ("step", "block", "a", "b"))) for side in "xy")
    once = ((F.col("xstep") == F.col("ystep")) & (F.col("xblock") <= F.col("yblock"))) | (F.col("xstep") + 1 == F.col("ystep"))
    meet = x.join(y, "pool").filter(once & (F.least("xa", "ya") != F.greatest("xb", "yb")))
    # a block that meets itself is on both sides
    alone = (F.col("xstep") == F.col("ystep")) & (F.col("xblock") == F.col("yblock"))
    sides = F.array(F.struct(F.col("xstep").alias("step"), F.col("xblock").alias("block"), F.when(alone, 2).otherwise(0).alias("side")), F.struct(F.col("ystep").alias("step"), F.col("yblock").alias("block"), F.when(~alone, 1).alias("side")))
    meet = meet.select("pool", F.xxhash64("xstep", "xblock", "ystep", "yblock").alias("meeting"), F.explode(sides).alias("s"))
    meet = meet.select("pool", "meeting", "s.step", "s.block", "s.side").filter("side IS NOT NULL")

    def made(batches):
        hashes = WordHashes()
        for batch in batches:
            own = pa.array([shingles(t.as_py(), width, hashes).tobytes() for t in batch.column("text")], pa.binary())
            yield batch.drop_columns(["text"]).append_column("own", own)

    sets = hot.join(texts, "node").select("node", "label", "pool", "step", "block", "text")
    sets = sets.mapInArrow(made, "node long, label long, pool long, step int, block long, own binary")
    dealt = sets.join(meet, ["pool", "step", "block"]).select("pool", "meeting", "side", "node", "label", "own")
    dealt = dealt.repartition("pool", "meeting").sortWithinPartitions("pool", "meeting")

    def run(batches):
        for pool, meeting, side, node, label, own in whole_groups(batches, ("pool", "meeting", "side", "node", "label", "own")):
            for g in np.split(np.arange(len(node)), np.flatnonzero((np.diff(pool) != 0) | (np.diff(meeting) != 0)) + 1):
                a, b = g[side[g] != 1], g[side[g] != 0]
                if not len(a) or not len(b):
                    continue
                _, first, kin = np.unique(label[g], return_index=True, return_inverse=True)
                known = first[kin]
                joined = known.copy()
                for i, j in near_sets(*([np.frombuffer(own[k], np.uint64) for k in s] for s in (a, b))):
                    unite(joined, a[i] - g[0], b[j] - g[0])
                moved = first[joined[first] != first]
                yield pa.RecordBatch.from_arrays([pa.array(node[g[moved]]), pa.array(node[g[joined[moved]]])], ["u", "v"])

    out = written(dealt.mapInArrow(run, "u long, v long"), "links")
    discard(blocks)
    return out


def _texts(docs: DataFrame, classes: DataFrame, keyed: DataFrame, width: int) -> DataFrame:
    """A text of each set that has a key: node, text. Of each set, the texts of its smallest id are looked at."""
    need = keyed.select("node").distinct().join(classes.select("node", "least"), "node").select("node", F.col("least").alias("doc_id"))
    texts = docs.join(need.select("doc_id").distinct(), "doc_id", "left_semi")

    def named(batches):
        hashes = WordHashes()
        for batch in batches:
            ids = np.array([_set_id(shingles(t.as_py(), width, hashes)) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids), batch.column("text")], ["doc_id", "node", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(named, f"doc_id {kind}, node long, text binary").join(need, ["doc_id", "node"], "left_semi").dropDuplicates(["node"]).select("node", "text")


def _verified(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets, made again from the texts, are near."""

    def compare(batches):
        hashes = WordHashes()
        for batch in batches:
            sides = ((shingles(x.as_py(), width, hashes) for x in batch.column(c)) for c in ("a", "b"))
            yield batch.select(["u", "v"]).filter(pa.array([near(a, b) for a, b in zip(*sides, strict=True)], pa.bool_()))

    both = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v")
    return written(both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), "links")


def near_copies(docs: DataFrame, *, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their shingle sets of 0.8 or more: doc_id, component_id; a row for each input row with an id.

    component_id is the smallest doc_id that a chain of links reaches. A set's sketch are its 64 least shingle hashes (all,
    if fewer, and then nothing is left to chance). Near sets share at least SHARED of them, so each must have one of the
    other's among the rarest of its sketch; under these they meet. What the first of a key links isn't compared again;
    sets of other components are, by SimHash in bit planes, and pairs within RADIUS by their sets as they are.

    Equal sets are one. Near sets that only share hashes common to over KEY_SETS sets (texts that are mostly a common
    passage, or copies of one text) each have such a hash among those they are looked up by. All sets of that kind that
    chains of such hashes join, and that the first look left in different groups, are compared with each other as they
    are, in blocks of sets of like size: exact, and never more than a tree of links for two blocks. Comparisons grow as
    the sets that the first look left apart times all sets of that kind that such a chain joins.

    Null and wordless texts are near each other; rows with a null id take no part; rows that repeat an id are separate.
    Other columns aren't read.
    """
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    marks = written(_marks(slim, width), "marks")
    classes = written(marks.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("print", "n", "sketch"))), "classes")
    keyed = written(_keyed(classes), "keyed")
    texts = written(_texts(slim, classes, keyed, width), "texts")
    pairs = _verified(texts, _stars(keyed), width)
    labels = written(components(pairs).withColumnRenamed("node", "of").select(F.col("of").alias("node"), "label"), "labels")
    pairs = pairs.union(_verified(texts, _candidates(keyed, labels), width))
    hot = _hot(keyed, labels)
    if not hot.isEmpty():
        pairs = pairs.union(_hot_links(texts, hot, width))
    named = classes.join(components(pairs), "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    named = written(named, "named")
    for table in (classes, keyed, labels, texts, hot):
        discard(table)
    merged = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return marks.select("doc_id", "node").join(named.join(merged, "label").select("node", "component_id"), "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, *, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without near copies: of each group of ``near_copies`` the one with the smallest id stays; see ``simhash.without``."""
    return without(docs, near_copies(docs, width=width, id_col=id_col, text_col=text_col), id_col, text_col)
