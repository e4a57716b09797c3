"""Joins of any number of keyed streams."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import functions
from ..functions import before_slice, sliced
from ..items import schema_of
from ..streaming.logic import Itemwise, JoinLogic
from ..streaming.processor import stateful_stream
from ..stream import ARRIVAL, KEY, ORDER, SUB, VALUE, Stream, arrive, operator

INSERT_MODES = ("first", "last", "product")
EMIT_MODES = ("complete", "final", "running")


def check_modes(insert_mode: str, emit_mode: str) -> None:
    if insert_mode not in INSERT_MODES:
        raise ValueError(f"insert mode must be one of {INSERT_MODES}, not {insert_mode!r}")
    if emit_mode not in EMIT_MODES:
        raise ValueError(f"emit mode must be one of {EMIT_MODES}, not {emit_mode!r}")


def side_names(sides: tuple[Stream, ...], names: list[str] | None) -> list[str]:
    names = names or [f"side_{k}" for k in range(len(sides))]
    if len(names) != len(sides):
        raise ValueError("names must name each side")
    return names


def boxed(side: Stream) -> Column:
    """A side's value in a struct, which isn't null even if the value is."""
    return F.struct((F.col(VALUE) if side.value_columns == [VALUE] else F.struct(*side.value_columns)).alias("v"))


def labelled(sides: tuple[Stream, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """All rows of all sides: key, side, one boxed value column for each side (null but for its own), and their order."""
    kinds = [s.df.select(boxed(s).alias("b")).schema["b"].dataType for s in sides]
    parts = []
    for k, side in enumerate(sides):
        values = [boxed(side).alias(f"b{k}") if i == k else F.lit(None).cast(t).alias(f"b{i}") for i, t in enumerate(kinds)]
        order = [F.col(c) if c in side.df.columns else F.lit(0).cast("long").alias(c) for c in ORDER]
        parts.append(side.df.select(KEY, *extra, F.lit(k).alias("side"), *values, *order))
    return reduce(DataFrame.unionByName, parts)


def joined_rows(rows: DataFrame, n: int, names: list[str], insert_mode: str, emit_mode: str, group: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The join of labelled rows within each group, in the given order: the group's columns, a column for each side, and the order."""
    boxes = [f"b{k}" for k in range(n)]
    place = F.struct(*order, "side")
    out = [F.col(b)["v"].alias(name) for b, name in zip(boxes, names, strict=True)]
    if emit_mode == "final" and insert_mode != "product":
        # one pass with map-side maxima, for any number of sides
        pick = F.max_by if insert_mode == "last" else F.min_by
        chosen = rows.groupBy(*group).agg(*(pick(b, F.when(F.col(b).isNotNull(), place)).alias(b) for b in boxes), F.max(place).alias("at"))
        return chosen.select(*group, *out, *(F.col("at")[c].alias(c) for c in order))
    if emit_mode == "final":
        # every combination; a side without rows gives null
        last = rows.groupBy(*group).agg(F.max(place).alias("at"))
        sides = [rows.filter(F.col("side") == k).select(*group, b) for k, b in enumerate(boxes)]
        every = reduce(lambda a, b: a.join(b, list(group), "left"), sides, last)
        return every.select(*group, *out, *(F.col("at")[c].alias(c) for c in order))
    window = Window.partitionBy(*group).orderBy(*order, "side")
    sofar = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if emit_mode == "running" and insert_mode != "product":
        pick, best = (F.last, F.max_by) if insert_mode == "last" else (F.first, F.min_by)
        cut = sliced(rows, order[0], functions.ARRIVAL_SLICE_BITS if order[0] == ARRIVAL else functions.TIME_SLICE_BITS)
        slices = cut.groupBy(*group, "_slice").agg(*(best(b, F.when(F.col(b).isNotNull(), place)).alias(b) for b in boxes))
        earlier = before_slice(slices, group, {f"e{b}": pick(b, ignorenulls=True) for b in boxes})
        within = Window.partitionBy(*group, "_slice").orderBy(*order, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = cut.select(*group, "_slice", *order, *(pick(b, ignorenulls=True).over(within).alias(b) for b in boxes)).join(earlier, [*group, "_slice"])
        ranked = ((b, f"e{b}") if insert_mode == "last" else (f"e{b}", b) for b in boxes)
        return seen.select(*group, *(F.coalesce(x, y)["v"].alias(name) for (x, y), name in zip(ranked, names, strict=True)), *order)
    if emit_mode == "running":
        seen = rows.select(*group, *order, *(F.collect_list(b).over(sofar).alias(b) for b in boxes))
        for b in boxes:
            seen = seen.withColumn(b, F.explode_outer(b))
        return seen.select(*group, *out, *order)
    # complete: rows up to the one that completes a set make a round
    keys = rows.select(*group, *order, "side").repartition(*group).sortWithinPartitions(*group, *order, "side")
    rejoined = rows.join(_rounds(keys, n, group), [*group, *order, "side"])
    sets = joined_rows(rejoined, n, names_of(n), insert_mode, "final", (*group, "round"), order)
    full = rejoined.groupBy(*group, "round").agg(F.count_distinct("side").alias("n_sides")).filter(F.col("n_sides") == n).drop("n_sides")
    done = sets.join(full, [*group, "round"])
    return done.select(*group, *(F.col(a).alias(b) for a, b in zip(names_of(n), names, strict=True)), *order)


def _rounds(keys: DataFrame, n: int, group: tuple[str, ...]) -> DataFrame:
    """Sorted rows (group, order, side) with the number of their round; a task streams through them and holds a batch."""

    def run(batches):
        everything, last, seen, number = (1 << n) - 1, None, 0, 0
        for batch in batches:
            rounds = []
            for *own, side in zip(*(batch.column(c).to_pylist() for c in (*group, "side")), strict=True):
                if own != last:
                    last, seen, number = own, 0, 0
                rounds.append(number)
                seen |= 1 << side
                if seen == everything:
                    seen, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rounds, pa.int64())], [*batch.schema.names, "round"])

    return keys.mapInArrow(run, StructType([*keys.schema.fields, StructField("round", LongType())]))


def names_of(n: int) -> list[str]:
    return [f"v{k}" for k in range(n)]


@operator
def join(step_id: str, *sides: Stream, insert_mode: str = "last", emit_mode: str = "complete", names: list[str] | None = None) -> Stream:
    """Rows (key, a column for each side) from the values that the sides have for a key.

    insert_mode says which of a side's values count: the first, the last, or each of them (product). emit_mode says when
    rows are made: once every side has a value, after which all are forgotten (complete); at the end (final); or for each
    row that arrives (running). A side without values gives null.

    Bounded sides become aggregates, full combinations or window functions; streaming ones a keyed state, where final
    never emits.
    """
    check_modes(insert_mode, emit_mode)
    if not sides:
        raise TypeError(f"step {step_id!r} needs at least one side")
    for side in sides:
        side.require_key(step_id)
    names = side_names(sides, names)
    n = len(sides)
    rows = labelled(sides)
    if any(s.df.isStreaming for s in sides):
        kinds = {name: rows.schema[f"b{k}"].dataType["v"].dataType.simpleString() for k, name in enumerate(names)}
        out = schema_of(", ".join(f"`{a}` {b}" for a, b in kinds.items()), keyed=True)
        read = lambda r: (r["side"], r[f"b{r['side']}"]["v"])
        write = lambda key, row: [{KEY: key, **dict(zip(names, row, strict=True))}]
        build = lambda state: Itemwise(lambda s: JoinLogic(n, insert_mode, emit_mode, s), state)
        return sides[0].with_df(stateful_stream(rows, build, read, write, out, timers=False))
    out = joined_rows(rows, n, names, insert_mode, emit_mode, (KEY,), ORDER)
    return sides[0].with_df(out if any(s.ordered for s in sides) else arrive(out.drop(ARRIVAL, SUB)))
