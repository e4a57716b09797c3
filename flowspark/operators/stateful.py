"""Operators with a state for each key."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .. import functions
from ..functions import before_slice, sliced
from ..items import BATCH_ROWS, by_key, reader, schema_of, writer
from ..streaming.logic import CollectLogic, FlatMapLogic, Itemwise, StatefulBatchLogic, StatefulLogic, drive
from ..streaming.processor import stateful_stream, utc_now
from ..stream import ARRIVAL, KEY, ORDER, SUB, VALUE, Stream, operator, sub_place


def _schema(up: Stream, schema, step_id: str) -> StructType:
    if schema is None:
        raise TypeError(f"step {step_id!r}: a Python callable needs schema=")
    return schema_of(schema, keyed=True)


def key_pass(up: Stream, out: StructType, run_key: Callable, more: tuple[str, ...] = ()):
    """Streams through the keys of bounded input: run_key(key values, rows) yields (row it comes from, new columns). A task holds one row at a time."""
    group = (KEY, *more)
    has_order = ARRIVAL in up.df.columns
    full = StructType([*out.fields, *(StructField(c, LongType()) for c in ORDER if has_order)])
    arrow, names = to_arrow_schema(full, timestamp_utc=True), full.names

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        held: list[dict] = []
        for key, own in groupby(rows, key=lambda r: tuple(r[c] for c in group)):
            place, at = 0, None
            for source, new in run_key(key, own):
                if has_order:
                    place = place + 1 if at == (source[ARRIVAL], source[SUB]) else 0
                    at = (source[ARRIVAL], source[SUB])
                    new = {**new, ARRIVAL: at[0], SUB: sub_place(at[1], place)}
                held.append(new)
                if len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema=arrow)

    return by_key(up, more).mapInArrow(run, full)


def keyed_scan(step_id: str, up: Stream, make: Callable, schema) -> Stream:
    """Runs an object with step(value) and end() over each key's values in order of arrival."""
    out = schema_of(schema, keyed=True)
    read, write = reader(up.value_columns), writer([n for n in out.names if n != KEY], step_id)

    def run_key(key, rows):
        own, last = make(), None
        for row in rows:
            last = row
            for x in own.step(read(row)):
                yield row, {KEY: key[0], **write(x)}
        for x in own.end():
            yield last, {KEY: key[0], **write(x)}

    return up.with_df(key_pass(up, out, run_key))


@operator
def stateful_batch(step_id: str, up: Stream, builder: Callable[[object], StatefulBatchLogic], schema=None) -> Stream:
    """Runs a StatefulBatchLogic for each key; builder(state) makes it, from nothing or from a snapshot.

    Bounded input is sorted by key and order of arrival, streamed through, and ends with on_eof. On a streaming query the
    state is a snapshot in the state store, and notify_at sets the key's one timer.
    """
    up.require_key(step_id)
    out = _schema(up, schema, step_id)
    read, write = reader(up.value_columns), writer([n for n in out.names if n != KEY], step_id)
    if up.df.isStreaming:
        return up.with_df(stateful_stream(up.df, builder, read, lambda key, x: [{KEY: key, **write(x)}], out))

    def run_key(key, rows):
        for row, made in drive(builder, rows, read):
            yield row, {KEY: key[0], **write(made)}

    return up.with_df(key_pass(up, out, run_key))


@operator
def stateful(step_id: str, up: Stream, builder: Callable[[object], StatefulLogic], schema=None) -> Stream:
    """Runs a StatefulLogic for each key."""
    return stateful_batch("stateful_batch", up, lambda state: Itemwise(builder, state), schema)


@operator
def stateful_flat_map(step_id: str, up: Stream, mapper: Callable, schema=None) -> Stream:
    """mapper(state or None, value) -> (new state, iterable) for each value of a key; a null state is forgotten."""
    return stateful("stateful", up, lambda state: FlatMapLogic(step_id, mapper, state), schema)


@operator
def stateful_map(step_id: str, up: Stream, mapper: Callable | None = None, schema=None, *, over: Callable[..., Column] | dict | None = None) -> Stream:
    """mapper(state or None, value) -> (new state, new value): one row for each row.

    With over, a function from a window specification (the key's rows so far, in order of arrival) to a Column, or a
    dict of such, the engine's window functions do it.
    """
    up.require_key(step_id)
    if over is not None:
        window = Window.partitionBy(KEY).orderBy(*up.order)
        columns = over if isinstance(over, dict) else {VALUE: over}
        return up.with_df(up.df.select(KEY, *(f(window).alias(n) for n, f in columns.items()), *(c for c in ORDER if up.ordered)))

    def one(state, value):
        got = mapper(state, value)
        try:
            state, made = got
        except (TypeError, ValueError):
            raise TypeError(f"mapper of step {step_id!r} must return a pair (state, value), not {got!r}") from None
        return state, (made,)

    return stateful_flat_map("stateful_flat_map", up, one, schema)


@operator
def collect(step_id: str, up: Stream, timeout: timedelta, max_size: int) -> Stream:
    """Lists of up to max_size values of a key; in a streaming query, shorter ones after timeout without a value."""
    up.require_key(step_id)
    value = F.col(VALUE) if up.value_columns == [VALUE] else F.struct(*up.value_columns)
    if up.df.isStreaming:
        kind = up.df.select(value.alias(VALUE)).schema[VALUE].dataType
        return stateful("stateful", up, lambda state: CollectLogic(timeout, max_size, utc_now, state), f"array<{kind.simpleString()}>")
    if up.ordered:  # a row's number is that in its slice of the key, after all of the slices before
        own = sliced(up.df, ARRIVAL, functions.ARRIVAL_SLICE_BITS)
        earlier = before_slice(own.groupBy(KEY, "_slice").agg(F.count("*").alias("_n")), (KEY,), {"_earlier": F.sum("_n")})
        numbered = own.withColumn("_n", F.row_number().over(Window.partitionBy(KEY, "_slice").orderBy(*up.order))).join(earlier, [KEY, "_slice"])
        place = F.coalesce("_earlier", F.lit(0)) + F.col("_n") - 1
    else:
        numbered, place = up.df, F.row_number().over(Window.partitionBy(KEY).orderBy(*up.order)) - 1
    rows = numbered.select(KEY, value.alias("v"), up.order_key.alias("o"), F.floor(place / max_size).cast("long").alias("chunk"))
    lists = rows.groupBy(KEY, "chunk").agg(F.sort_array(F.collect_list(F.struct("o", "v"))).alias("xs"), F.max("o").alias("o"))
    out = lists.select(KEY, F.transform("xs", lambda x: x["v"]).alias(VALUE), *((F.col("o")[f"o{k}"]).alias(c) for k, c in enumerate(ORDER) if up.ordered))
    return up.with_df(out)
