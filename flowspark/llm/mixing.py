"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written
from ._text import WORD

#: Slices of a source: the first four hexadecimal digits of a document's place in the random order.
SLICES = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Water-filling of the budget, share times all sizes, over the rows (source, source_size).

    Weights repeat along the sources in order of code points, null last. A source takes budget in proportion to its
    weight but at most max_epochs times its size; what it can't take goes to the others by weight. Capped sources are
    those with the smallest size for their weight, so with the sources in that order the level is found from running
    sums: source i is capped if the level that remains once those before it are capped would lift it over its cap.

    The input has a row for each source, so the windows over all of it hold as many rows as there are sources.
    Sources of size 0 get target 0, as does every source if share is 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("is_capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("open_level", F.max(F.when(~F.col("is_capped"), F.col("level"))).over(everything))
    )
    return filled.select("source", "source_size", F.when(F.col("is_capped"), F.col("cap")).otherwise(F.col("open_level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0,
    seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """How often the mix repeats each document: doc_id, size, source_size, target, copies, taken; a row for each input row.

    With e = target / source_size epochs, every document is taken floor(e) times, and once more if it comes early
    enough in a seeded random order of its source: as long as the middle of the document, measured along the sizes of
    those before it, lies below the fraction of the source that is still missing. So a source's words miss its target
    by half a document at most, and a rerun takes the same.

    The order is md5 of seed and id. Its first digits cut a source into SLICES slices, of which sizes are summed. Slices
    that end before the fraction are taken whole, those that begin behind it aren't, and only the documents of the slice
    between are ranked, so a source of any size costs no more than one slice's sort.

    Null text or one without words: size 0, taken 0. A null source is a source of its own. A null id is ordered as an
    empty one. Rows that repeat an id are separate documents; equal ones are told apart by size only, which leaves the
    result the same. Other columns, whatever their names, are not read.
    """
    sizes = _sizes(docs, seed, id_col, source_col, text_col)
    decided = _decided(sizes, F.col("size"), _goals(sizes, weights, share, max_epochs))
    return decided.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0,
    seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mix itself: the documents, with all their columns, each as often as ``mix`` takes it. Texts stay where they are, but for those of the slices that are ranked."""
    goals = _goals(_sizes(docs, seed, id_col, source_col, text_col), weights, share, max_epochs)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *_places(docs, seed, id_col, source_col))
    decided = _decided(rows, word_count(F.col("row").getField(text_col)), goals)
    repeated = decided.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select("row.*")


def _places(docs: DataFrame, seed: int, id_col: str, source_col: str) -> list[Column]:
    """doc_id, key (the source, never null), place in the random order, and slice."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    return [
        docs[id_col].alias("doc_id"), F.coalesce(F.concat(F.lit("="), docs[source_col]), F.lit("")).alias("key"), place.alias("place"),
        F.conv(F.substring(place, 1, 4), 16, 10).cast("int").alias("slice"),
    ]


def _sizes(docs: DataFrame, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Sizes and places of documents, written: the one pass that counts words of all texts."""
    return written(docs.select(docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), *_places(docs, seed, id_col, source_col)), "sizes")


def _goals(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """A row for each source: key, source_size, target, whole epochs, cut (the words of one more epoch), and the slices that hold the cut, with where the first begins."""
    per_slice = sizes.groupBy("key", "slice").agg(F.max("source").alias("source"), F.sum("size").alias("n"))
    totals = per_slice.groupBy("key").agg(F.max("source").alias("source"), F.sum("n").alias("source_size"))
    filled = targets(totals, weights, share, max_epochs).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = filled.withColumn("epochs", epochs).withColumn("whole", F.floor("epochs")).withColumn("cut", (F.col("epochs") - F.col("whole")) * F.col("source_size")).drop("epochs")
    cuts = goals.filter("cut > 0").select("key", "cut")
    coarse = F.shiftright("slice", 8).alias("coarse")
    held = _holding(per_slice.groupBy("key", coarse).agg(F.sum("n").alias("n")).withColumn("base", F.lit(0)), "coarse", cuts)
    fine = per_slice.withColumn("coarse", coarse).join(held.select("key", "coarse", F.col("start").alias("from")), ["key", "coarse"])
    held = _holding(fine.withColumn("base", F.min("from").over(Window.partitionBy("key"))), "slice", cuts)
    open_slices = held.groupBy("key").agg(F.min("slice").alias("first"), F.max("slice").alias("last"), F.min("start").alias("start"))
    return written(goals.join(open_slices, "key", "left"), "goals")


def _holding(parts: DataFrame, by: str, cuts: DataFrame) -> DataFrame:
    """Of the parts (key, n words, base) of sources, at most 256 or few more of each source, those in which its cut lies, with their start."""
    along = Window.partitionBy("key").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.withColumn("end", F.col("base") + F.sum("n").over(along)).withColumn("start", F.col("end") - F.col("n"))
    return ends.join(cuts, "key").filter("start <= cut AND end >= cut")


def _decided(rows: DataFrame, size: Column, goals: DataFrame) -> DataFrame:
    """rows (with key, slice, place, doc_id) with their source's goals and copies; size is looked at in the slices that are ranked only."""
    both = rows.join(goals, "key")
    between = F.coalesce((F.col("slice") >= F.col("first")) & (F.col("slice") <= F.col("last")), F.lit(False))
    clear = both.filter(~between).withColumn("copies", (F.col("whole") + F.coalesce(F.col("slice") < F.col("first"), F.lit(False)).cast("long")).cast("long"))
    ahead = Window.partitionBy("key").orderBy("place", "doc_id", "own").rowsBetween(Window.unboundedPreceding, -1)
    ranked = both.filter(between).withColumn("own", size).withColumn("ahead", F.coalesce(F.sum("own").over(ahead), F.lit(0)))
    extra = (F.col("start") + F.col("ahead") + F.col("own") / 2 < F.col("cut")).cast("long")
    return clear.unionByName(ranked.withColumn("copies", (F.col("whole") + extra).cast("long")).drop("own", "ahead"))
