"""Windows over keyed streams: clocks, windowers, and the operators that use them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions
from ..functions import FOREVER, before_slice, epoch_micros, from_micros, micros, sliced, sliding_ids, ts_micros, whole_div
from ..items import reader, schema_of, writer
from ..streaming.logic import EventClockLogic, FoldLogic, SessionLogic, SlidingLogic, SystemClockLogic, WindowDriver, WindowJoinLogic, WindowLogic
from ..streaming.processor import stateful_stream, utc_now
from ..stream import KEY, ORDER, VALUE, Stream, arrive, operator
from .joins import boxed, check_modes, joined_rows, side_names
from .stateful import key_pass
from .stateless import key_on

LATE_SESSION_ID = -1
WID, OPEN, CLOSE, AT, LATE = "window_id", "open_time", "close_time", "_ts", "_late"


class Clock(ABC):
    """Says when a row happened, and how far time has come."""

    @abstractmethod
    def ts(self) -> Column: ...

    @abstractmethod
    def logic(self): ...

    def mark(self, timed: DataFrame, up: Stream) -> DataFrame:
        """timed with the column _late."""
        return timed.withColumn(LATE, F.lit(False))


@dataclass(frozen=True)
class SystemClock(Clock):
    """A row happens when it is processed; none is late."""

    def ts(self) -> Column:
        return F.current_timestamp()

    def logic(self):
        return SystemClockLogic(utc_now)


@dataclass(frozen=True)
class EventClock(Clock):
    """A row happens at ts, a timestamp column. Each key's time has come to its latest row less the wait; rows before that are late.

    With per_key false, a streaming query goes by one time for all keys, Spark's watermark. Then tumbling and sliding
    windows with an aggregate Column run in the engine, with partial sums and no Python; the engine drops late rows, so
    there is no stream `late` (it is None), and a query's progress counts them (numRowsDroppedByWatermark).

    to_system_utc(time) says when, by the system's clock, a time of the rows comes, for a streaming query to wake up then;
    without it, times are taken to pass as fast as the system's.
    """

    ts_column: Column | str
    wait: timedelta = timedelta(0)
    now: Callable[[], datetime] = utc_now
    per_key: bool = True
    to_system_utc: Callable[[datetime], datetime | None] | None = None

    def ts(self) -> Column:
        return F.col(self.ts_column) if isinstance(self.ts_column, str) else self.ts_column

    def logic(self):
        return EventClockLogic(self.wait, self.now, self.to_system_utc)

    def mark(self, timed, up):
        if self.wait == FOREVER or not up.ordered:
            return super().mark(timed, up)
        rows = sliced(timed, ORDER[0], functions.ARRIVAL_SLICE_BITS)
        tops = rows.groupBy(KEY, "_slice").agg(F.max(AT).alias("_top"))
        sofar = Window.partitionBy(KEY, "_slice").orderBy(*up.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = rows.withColumn("_top", F.max(AT).over(sofar)).join(before_slice(tops, (KEY,), {"_before": F.max("_top")}), [KEY, "_slice"])
        return both.withColumn(LATE, F.col(AT) < F.greatest("_top", "_before") - F.lit(micros(self.wait))).drop("_slice", "_top", "_before")


class Windower(ABC):
    """Says which windows a time belongs to."""

    @abstractmethod
    def assign(self, rows: DataFrame) -> DataFrame:
        """Rows in time, with window_id added, one for each of their windows."""

    @abstractmethod
    def late_ids(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def bounds(self) -> tuple[Column, Column]:
        """Aggregates that give a window's open and close time in microseconds."""

    @abstractmethod
    def logic(self): ...


@dataclass(frozen=True)
class SlidingWindower(Windower):
    """Windows of the given length that begin every offset, one of them at align_to; windows overlap or touch."""

    length: timedelta
    offset: timedelta
    align_to: datetime

    def __post_init__(self):
        if self.offset > self.length:
            raise ValueError("sliding window offset must not exceed its length; there would be gaps")
        if self.offset <= timedelta(0):
            raise ValueError("sliding window offset must be positive")

    def assign(self, rows):
        length, offset, align = micros(self.length), micros(self.offset), epoch_micros(self.align_to)
        if length == offset:
            return rows.withColumn(WID, whole_div(F.col(AT) - F.lit(align), length))
        return rows.withColumn(WID, F.explode(sliding_ids(F.col(AT), length, offset, align)))

    late_ids = assign

    def bounds(self):
        start = F.lit(epoch_micros(self.align_to)) + F.first(WID) * F.lit(micros(self.offset))
        return start, start + F.lit(micros(self.length))

    def logic(self):
        return SlidingLogic(self.length, self.offset, self.align_to if self.align_to.tzinfo else self.align_to.replace(tzinfo=timezone.utc))


@dataclass(frozen=True)
class TumblingWindower(SlidingWindower):
    """Windows of the given length, one after the other."""

    offset: timedelta = field(init=False)

    def __init__(self, length: timedelta, align_to: datetime):
        object.__setattr__(self, "length", length)
        object.__setattr__(self, "offset", length)
        object.__setattr__(self, "align_to", align_to)
        self.__post_init__()


@dataclass(frozen=True)
class SessionWindower(Windower):
    """Runs of rows of a key that lie no more than gap apart, numbered from 0 in order of time."""

    gap: timedelta

    def __post_init__(self):
        if self.gap < timedelta(0):
            raise ValueError("session gap must not be negative")

    def assign(self, rows):
        order = [c for c in ORDER if c in rows.columns]
        own = sliced(rows, AT, functions.TIME_SLICE_BITS)
        window = Window.partitionBy(KEY, "_slice").orderBy(AT, *order)
        apart = lambda a, b: (a - b > F.lit(micros(self.gap))).cast("long")
        inner = own.withColumn("_inner", F.coalesce(apart(F.col(AT), F.lag(AT).over(window)), F.lit(0)))
        # a slice's first row begins a session if the slice before it ended too long ago
        slices = inner.groupBy(KEY, "_slice").agg(F.sum("_inner").alias("n"), F.min(AT).alias("a"), F.max(AT).alias("b"))
        slices = slices.withColumn("first", F.coalesce(apart(F.col("a"), F.lag("b").over(Window.partitionBy(KEY).orderBy("_slice"))), F.lit(1)))
        earlier = before_slice(slices.withColumn("all", F.col("n") + F.col("first")), (KEY,), {"_earlier": F.sum("all")})
        starts = slices.select(KEY, "_slice", "first").join(earlier, [KEY, "_slice"])
        starts = starts.select(KEY, "_slice", (F.coalesce("_earlier", F.lit(0)) + F.col("first") - 1).alias("_start"))
        upto = F.sum("_inner").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return inner.withColumn("_inner", upto).join(starts, [KEY, "_slice"]).withColumn(WID, F.col("_inner") + F.col("_start")).drop("_slice", "_inner", "_start")

    def late_ids(self, rows):
        return rows.withColumn(WID, F.lit(LATE_SESSION_ID).cast("long"))

    def bounds(self):
        return F.min(AT), F.max(AT)

    def logic(self):
        return SessionLogic(self.gap)


@dataclass(frozen=True)
class WindowOut:
    """down: results (key, window_id, ...); late: rows that came too late, for each window they missed; meta: (key, window_id, open_time, close_time, merged_ids)."""

    down: Stream
    late: Stream | None
    meta: Stream


@dataclass(frozen=True)
class Assigned:
    up: Stream
    rows: DataFrame  # in time: key, window_id, values, _ts, order
    late: Stream
    meta: Stream


def assign(up: Stream, clock: Clock, windower: Windower, step_id: str) -> Assigned:
    """Windows of bounded input in closed form; system time is taken to stand still while it is read.

    Without a finite wait there is nothing late and no order to look at: tumbling and sliding windows are then expressions
    on each row. All windows close at the end.
    """
    up.require_key(step_id)
    timed = up.df.withColumn(AT, ts_micros(clock.ts()))
    timed = timed.filter(F.coalesce(F.col(AT).isNotNull(), F.raise_error(F.lit(f"a row of step {step_id} has no time")).cast("boolean")))
    marked = clock.mark(timed, up)
    rows = windower.assign(marked.filter(~F.col(LATE)).drop(LATE))
    late = windower.late_ids(marked.filter(LATE).drop(LATE)).select(KEY, WID, *up.value_columns, *(c for c in ORDER if up.ordered))
    start, end = windower.bounds()
    meta = rows.groupBy(KEY, WID).agg(start.alias("_a"), end.alias("_b"))
    meta = meta.select(KEY, WID, from_micros(F.col("_a")).alias(OPEN), from_micros(F.col("_b")).alias(CLOSE), F.array().cast("array<bigint>").alias("merged_ids"))
    return Assigned(up, rows, up.with_df(late), up.with_df(arrive(meta)))


def _value(up: Stream) -> Column:
    return F.col(VALUE) if up.value_columns == [VALUE] else F.struct(*up.value_columns)


def _out(a: Assigned, down: DataFrame) -> WindowOut:
    return WindowOut(a.up.with_df(arrive(down)), a.late, a.meta)


def _unpacked(a: Assigned, df: DataFrame) -> WindowOut:
    return _out(a, df.select(KEY, WID, VALUE if a.up.value_columns == [VALUE] else f"{VALUE}.*"))


def _live(step_id: str, up: Stream, clock: Clock, windower: Windower, builder: Callable[[Any], WindowLogic], out, ordered: bool, read, late_columns: list[str], rows: DataFrame | None = None, write=None) -> WindowOut:
    """Windows of a streaming query: one keyed state runs the state machine, and its tagged rows are split into three streams."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, TimestampType

    source = (up.df if rows is None else rows).withColumn("_at", clock.ts().cast("timestamp") if isinstance(clock, EventClock) else F.lit(None).cast("timestamp"))
    made = StructType([f for f in out.fields if f.name != KEY])
    late = StructType([source.schema[c] for c in late_columns])
    tagged = StructType([StructField(KEY, StringType()), StructField("tag", StringType()), StructField(WID, LongType()), StructField("e", made), StructField("l", late), StructField(OPEN, TimestampType()), StructField(CLOSE, TimestampType()), StructField("merged_ids", ArrayType(LongType()))])
    write = write or writer(made.names, step_id)
    utc = lambda t: t.replace(tzinfo=timezone.utc) if t is not None and t.tzinfo is None else t

    def from_row(r):
        return utc(r["_at"]), (read(r), {c: r[c] for c in late_columns})

    class Own(WindowLogic):
        """Takes the value out of (value, row as it came)."""

        def __init__(self, state):
            self.inner = builder(state)

        def on_value(self, value):
            return self.inner.on_value(value[0])

        def on_merge(self, original):
            return self.inner.on_merge(original.inner)

        def on_close(self):
            return self.inner.on_close()

        def snapshot(self):
            return self.inner.snapshot()

    def to_rows(key, x):
        tag, wid, got = x
        row = {KEY: key, "tag": tag, WID: wid}
        if tag == "E":
            row["e"] = tuple(write(got).get(n) for n in made.names)
        elif tag == "L":
            row["l"] = tuple(got[1].get(n) for n in late.names)
        else:
            row |= {OPEN: got[0].replace(tzinfo=None), CLOSE: got[1].replace(tzinfo=None), "merged_ids": sorted(got[2])}
        return [row]

    build = lambda state: WindowDriver(clock.logic(), windower.logic(), Own, ordered, state)
    all_rows = stateful_stream(source, build, from_row, to_rows, tagged)
    pick = lambda tag, *cols: up.with_df(all_rows.filter(F.col("tag") == tag).select(KEY, WID, *cols))
    return WindowOut(pick("E", "e.*"), pick("L", "l.*"), pick("M", OPEN, CLOSE, "merged_ids"))


def _shared(step_id: str, up: Stream, clock: Clock, windower: Windower, columns: dict[str, Column]) -> WindowOut:
    """Windows of a streaming query by one watermark for all keys."""
    if not isinstance(clock, EventClock) or clock.per_key or not isinstance(windower, SlidingWindower) or clock.wait == FOREVER:
        raise TypeError(f"step {step_id!r}: an aggregate Column on a streaming query needs an EventClock with per_key=False and a finite wait, and tumbling or sliding windows")
    up.require_key(step_id)
    length, offset, align = micros(windower.length), micros(windower.offset), epoch_micros(windower.align_to)
    timed = up.df.withColumn("_at", clock.ts().cast("timestamp")).withWatermark("_at", f"{micros(clock.wait)} microseconds")
    span = F.window("_at", f"{length} microseconds", f"{offset} microseconds", f"{align % offset} microseconds")
    made = timed.groupBy(KEY, span.alias("w")).agg(*(c.alias(n) for n, c in columns.items()))
    wid = whole_div(F.unix_micros("w.start") - F.lit(align), offset).alias(WID)
    down = made.select(KEY, wid, *columns)
    meta = made.select(KEY, wid, F.col("w.start").alias(OPEN), F.col("w.end").alias(CLOSE), F.array().cast("array<bigint>").alias("merged_ids"))
    return WindowOut(up.with_df(down), None, up.with_df(meta))


@operator
def window(step_id: str, up: Stream, clock: Clock, windower: Windower, builder: Callable[[Any], WindowLogic], schema=None, ordered: bool = True) -> WindowOut:
    """Runs a WindowLogic in each window of each key; builder(state) makes it. With ordered, values come by time, else by arrival."""
    out = schema_of(schema, keyed=True)
    read, write = reader(up.value_columns), writer([n for n in out.names if n != KEY], step_id)
    if up.df.isStreaming:
        return _live(step_id, up, clock, windower, builder, out, ordered, read, up.value_columns)
    from pyspark.sql.types import LongType, StructField, StructType

    a = assign(up, clock, windower, step_id)
    full = StructType([out[KEY], StructField(WID, LongType()), *(f for f in out.fields if f.name != KEY)])

    def run_key(key, rows):
        logic, last = builder(None), None
        for row in rows:
            last = row
            for x in logic.on_value(read(row)):
                yield row, {KEY: key[0], WID: key[1], **write(x)}
        for x in logic.on_close():
            yield last, {KEY: key[0], WID: key[1], **write(x)}

    more = (WID, AT) if ordered else (WID,)
    source = up.with_df(a.rows)
    if not ordered:
        return _out(a, key_pass(source, full, run_key, (WID,)))
    return _out(a, _timed_pass(source, full, run_key, more))


def _timed_pass(source: Stream, full, run_key, more):
    """key_pass by key and window, with each window's rows in order of time."""
    order = [c for c in ORDER if c in source.df.columns]
    timed = source.df
    if order:  # the time leads the order of arrival
        rank = F.row_number().over(Window.partitionBy(KEY, WID).orderBy(AT, *order)).cast("long")
        timed = timed.withColumn(ORDER[0], rank).withColumn(ORDER[1], F.lit(0).cast("long"))
    else:
        rank = F.row_number().over(Window.partitionBy(KEY, WID).orderBy(AT)).cast("long")
        timed = timed.withColumns({ORDER[0]: rank, ORDER[1]: F.lit(0).cast("long")})
    return key_pass(source.with_df(timed), full, run_key, (more[0],))


@operator
def fold_window(step_id: str, up: Stream, clock: Clock, windower: Windower, builder: Callable | None = None, folder: Callable | None = None, merger: Callable | None = None, schema=None, ordered: bool = True, *, agg: Column | dict[str, Column] | None = None) -> WindowOut:
    """Folds each window's values into one when it closes.

    With agg, an aggregate Column or a dict of them, the engine does it, with map-side partial sums. Otherwise
    folder(accumulator, value) from builder(); merger joins two accumulators where sessions meet out of order.
    """
    if agg is not None:
        columns = agg if isinstance(agg, dict) else {VALUE: agg}
        if up.df.isStreaming:
            return _shared(step_id, up, clock, windower, columns)
        a = assign(up, clock, windower, step_id)
        return _out(a, a.rows.groupBy(KEY, WID).agg(*(c.alias(n) for n, c in columns.items())))
    make = lambda state: FoldLogic(folder, merger, builder() if state is None else state)
    return window("window", up, clock, windower, make, schema, ordered)


@operator
def reduce_window(step_id: str, up: Stream, clock: Clock, windower: Windower, reducer: Column | dict[str, Column] | Callable, schema=None) -> WindowOut:
    """Each window's values joined into one: an aggregate Column or a dict of them, or a Python callable (a, b) -> c."""
    if isinstance(reducer, (Column, dict)):
        return fold_window("fold_window", up, clock, windower, agg=reducer)
    both = lambda a, b: b if a is None else reducer(a, b)
    merge = lambda a, b: a if b is None else both(a, b)
    return fold_window("fold_window", up, clock, windower, lambda: None, both, merge, schema or up.df.select(*up.value_columns).schema, ordered=False)


@operator
def count_window(step_id: str, up: Stream, clock: Clock, windower: Windower, key: Column | Callable) -> WindowOut:
    """Rows by key and window."""
    keyed = key_on("key_on", up, key)
    if keyed.df.isStreaming and not (isinstance(clock, EventClock) and not clock.per_key):
        return fold_window("fold_window", keyed, clock, windower, int, lambda n, _: n + 1, lambda a, b: a + b, "bigint", ordered=False)
    return fold_window("fold_window", keyed, clock, windower, agg=F.count("*"))


def _extreme(step_id: str, up: Stream, clock: Clock, windower: Windower, by, largest: bool) -> WindowOut:
    if up.df.isStreaming or (callable(by) and not isinstance(by, Column)):
        pick, key = (max if largest else min), by if callable(by) else None
        return reduce_window("reduce_window", up, clock, windower, lambda a, b: pick(a, b, key=key))
    a = assign(up, clock, windower, step_id)
    by = _value(up) if by is None else by
    rank = F.struct(by.alias("by"), *((-F.col(c) if largest else F.col(c)).alias(f"o{k}") for k, c in enumerate(ORDER))) if up.ordered else by
    kind = F.max_by if largest else F.min_by
    return _unpacked(a, a.rows.groupBy(KEY, WID).agg(kind(_value(up), rank).alias(VALUE)))


@operator
def max_window(step_id: str, up: Stream, clock: Clock, windower: Windower, by: Column | Callable | None = None) -> WindowOut:
    """The item of each window with the largest `by`; of equals the first to arrive."""
    return _extreme(step_id, up, clock, windower, by, True)


@operator
def min_window(step_id: str, up: Stream, clock: Clock, windower: Windower, by: Column | Callable | None = None) -> WindowOut:
    """The item of each window with the smallest `by`; of equals the first to arrive."""
    return _extreme(step_id, up, clock, windower, by, False)


def _pair(step_id: str, up: Stream) -> list[str]:
    if len(up.value_columns) != 2:
        raise TypeError(f"step {step_id!r} needs two value columns, a key and a value, to collect a dict")
    return up.value_columns


@operator
def collect_window(step_id: str, up: Stream, clock: Clock, windower: Windower, into: type = list, ordered: bool = True) -> WindowOut:
    """Each window's values in a list, by time or by arrival, in a set (an array of different values), or in a dict (a map, from a stream with two value columns; the last value of a key stays)."""
    if into not in (list, set, dict):
        raise TypeError(f"step {step_id!r} can collect into a list, a set or a dict, not {into!r}")
    if up.df.isStreaming:
        kind = up.df.select(_value(up).alias(VALUE)).schema[VALUE].dataType
        if into is dict:
            k, v = _pair(step_id, up)
            types = ", ".join(up.df.schema[c].dataType.simpleString() for c in (k, v))
            return fold_window("fold_window", up, clock, windower, dict, lambda d, x: {**d, x[k]: x[v]}, lambda a, b: {**a, **b}, f"map<{types}>", ordered)
        add = (lambda xs, x: xs + [x]) if into is list else (lambda xs, x: xs if x in xs else xs + [x])
        return fold_window("fold_window", up, clock, windower, list, add, lambda a, b: a + b, f"array<{kind.simpleString()}>", ordered)
    a = assign(up, clock, windower, step_id)
    order = [F.col(c) for c in ORDER if up.ordered]
    place = F.struct(*([F.col(AT), *order] if ordered else order or [F.col(AT)]))
    if into is set:
        # values that are equal meet by a shuffle; array_distinct would compare structs all with all
        kept = a.rows.select(KEY, WID, _value(up).alias("v")).distinct()
        return _out(a, kept.groupBy(KEY, WID).agg(F.sort_array(F.collect_list("v")).alias(VALUE)))
    if into is dict:
        k, v = _pair(step_id, up)
        kept = a.rows.groupBy(KEY, WID, k).agg(F.max_by(v, place).alias(v))
        return _out(a, kept.groupBy(KEY, WID).agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias(VALUE)))
    lists = a.rows.groupBy(KEY, WID).agg(F.sort_array(F.collect_list(F.struct(place.alias("o"), _value(up).alias("v")))).alias("xs"))
    return _out(a, lists.select(KEY, WID, F.transform("xs", lambda x: x["v"]).alias(VALUE)))


@operator
def join_window(step_id: str, clock: Clock, windower: Windower, *sides: Stream, insert_mode: str = "last", emit_mode: str = "final", ordered: bool = True, names: list[str] | None = None) -> WindowOut:
    """Joins the values that the sides have for a key within a window; see ``join`` for the modes. An EventClock's column is read on each side."""
    check_modes(insert_mode, emit_mode)
    if not sides:
        raise TypeError(f"step {step_id!r} needs at least one side")
    names = side_names(sides, names)
    timed = tuple(s.with_df(s.df.withColumn("_side_ts", clock.ts().cast("timestamp"))) for s in sides)
    for s in timed:
        s.require_key(step_id)
    values = tuple(Stream(s.flow, s.stream_id, s.df) for s in sides)
    n = len(sides)
    rows = _labelled(timed, values)
    up = Stream(sides[0].flow, sides[0].stream_id, rows)
    inner = EventClock("_side_ts", clock.wait, clock.now, to_system_utc=clock.to_system_utc) if isinstance(clock, EventClock) else clock
    boxes = [f"b{k}" for k in range(n)]
    if rows.isStreaming:
        kinds = {name: rows.schema[b].dataType["v"].dataType.simpleString() for b, name in zip(boxes, names, strict=True)}
        out = schema_of(", ".join(f"`{a}` {b}" for a, b in kinds.items()), keyed=True)
        read = lambda r: (r["side"], r[f"b{r['side']}"]["v"])
        write = lambda row: dict(zip(names, row, strict=True))
        return _live(step_id, up, inner, windower, lambda s: WindowJoinLogic(n, insert_mode, emit_mode, s), out, ordered, read, ["side", *boxes], write=write)
    a = assign(up, inner, windower, step_id)
    order = (AT, *ORDER) if ordered else ORDER
    down = joined_rows(a.rows.drop("_side_ts"), n, names, insert_mode, emit_mode, (KEY, WID), order)
    late = a.late.df.select(KEY, WID, "side", *(F.col(b)["v"].alias(name) for b, name in zip(boxes, names, strict=True)), *ORDER)
    return WindowOut(up.with_df(arrive(down.drop(*order))), up.with_df(late), a.meta)


def _labelled(timed: tuple[Stream, ...], values: tuple[Stream, ...]) -> DataFrame:
    from functools import reduce

    kinds = [v.df.select(boxed(v).alias("b")).schema["b"].dataType for v in values]
    parts = []
    for k, (t, v) in enumerate(zip(timed, values, strict=True)):
        boxes = [boxed(v).alias(f"b{k}") if i == k else F.lit(None).cast(kind).alias(f"b{i}") for i, kind in enumerate(kinds)]
        order = [F.col(c) if c in t.df.columns else F.lit(0).cast("long").alias(c) for c in ORDER]
        parts.append(t.df.select(KEY, F.lit(k).alias("side"), *boxes, "_side_ts", *order))
    return reduce(DataFrame.unionByName, parts)
