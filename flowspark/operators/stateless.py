"""Operators that look at one row, or one batch of rows, at a time.

Where an operator takes a function of an item, it takes a Column as well, or a list or dict of Columns; then the whole
step stays in the engine and can be optimised. A Python callable needs ``schema``, the DDL of what it makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType

from ..items import map_items, reader, schema_of, writer
from ..stream import ARRIVAL, KEY, ORDER, SUB, VALUE, Flow, Stream, arrive, operator, sub_column

Mapper = Column | dict | list | Callable


@dataclass(frozen=True)
class BranchOut:
    """Rows for which the predicate holds, and the others."""

    trues: Stream
    falses: Stream


def _columns(mapper, keep: list[str]) -> list[Column] | None:
    """Columns of a mapper that isn't a callable: bare ones make `value`, named ones themselves."""
    if isinstance(mapper, Column):
        return [*(F.col(c) for c in keep), mapper.alias(VALUE)]
    if isinstance(mapper, dict):
        return [*(F.col(c) for c in keep), *(c.alias(n) for n, c in mapper.items())]
    if isinstance(mapper, (list, tuple)):
        return [*(F.col(c) for c in keep), *mapper]
    return None


def _order(up: Stream) -> list[str]:
    return [c for c in ORDER if c in up.df.columns]


def _need(schema, step_id):
    if schema is None:
        raise TypeError(f"step {step_id!r}: a Python callable needs schema=")
    return schema


@operator
def input(step_id: str, flow: Flow, source) -> Stream:  # noqa: A001
    """Rows of a source: a DataFrame, or an object with ``read(spark)``, as in ``flowspark.sources``."""
    df = source if isinstance(source, DataFrame) else source.read(flow.spark)
    flow.inputs += 1
    return flow.stream(step_id, df if ARRIVAL in df.columns else arrive(df, getattr(source, "arrival", None)))


@operator
def output(step_id: str, up: Stream, sink) -> None:
    """Sends rows to a sink once the flow runs."""
    if getattr(sink, "keyed", False):
        up.require_key(step_id)
    up.flow.outputs.append((step_id, up, sink))


@operator
def map(step_id: str, up: Stream, mapper: Mapper, schema=None) -> Stream:  # noqa: A001
    """One row for each row."""
    if (columns := _columns(mapper, [])) is not None:
        return up.with_df(up.df.select(*columns, *_order(up)))
    out = schema_of(_need(schema, step_id))
    write, keyed = writer(out.names, step_id), KEY in up.columns

    def run(rows):
        for row, item in rows:
            yield row, -1, write(mapper((row[KEY], item) if keyed else item))

    return up.with_df(map_items(up, step_id, run, out))


@operator
def map_value(step_id: str, up: Stream, mapper: Mapper, schema=None) -> Stream:
    """One row for each row; the key stays."""
    up.require_key(step_id)
    if (columns := _columns(mapper, [KEY])) is not None:
        return up.with_df(up.df.select(*columns, *_order(up)))
    out = schema_of(_need(schema, step_id), keyed=True)
    write = writer([n for n in out.names if n != KEY], step_id)

    def run(rows):
        for row, item in rows:
            yield row, -1, {KEY: row[KEY], **write(mapper(item))}

    return up.with_df(map_items(up, step_id, run, out))


def _exploded(up: Stream, array: Column, keep: list[str], field: str = VALUE) -> DataFrame:
    order = _order(up)
    made = up.df.select(*keep, *order, F.posexplode(array).alias("_place", field))
    if order:
        made = made.withColumn(SUB, sub_column(F.col(SUB), F.col("_place").cast("long")))
    kind = made.schema[field].dataType
    fields = [f"{field}.{n}" for n in kind.names] if hasattr(kind, "names") else [field]
    return made.select(*keep, *fields, *order)


@operator
def flat_map(step_id: str, up: Stream, mapper: Mapper, schema=None) -> Stream:
    """Any number of rows for each row; an array column gives a row for each element, and an array of structs their fields."""
    if isinstance(mapper, Column):
        return up.with_df(_exploded(up, mapper, []))
    out = schema_of(_need(schema, step_id))
    write, keyed = writer(out.names, step_id), KEY in up.columns

    def run(rows):
        for row, item in rows:
            for place, new in enumerate(mapper((row[KEY], item) if keyed else item)):
                yield row, place, write(new)

    return up.with_df(map_items(up, step_id, run, out))


@operator
def flat_map_value(step_id: str, up: Stream, mapper: Mapper, schema=None) -> Stream:
    """Any number of rows for each row; the key stays."""
    up.require_key(step_id)
    if isinstance(mapper, Column):
        return up.with_df(_exploded(up, mapper, [KEY]))
    out = schema_of(_need(schema, step_id), keyed=True)
    write = writer([n for n in out.names if n != KEY], step_id)

    def run(rows):
        for row, item in rows:
            for place, new in enumerate(mapper(item)):
                yield row, place, {KEY: row[KEY], **write(new)}

    return up.with_df(map_items(up, step_id, run, out))


@operator
def flat_map_batch(step_id: str, up: Stream, mapper: Callable[[list], Iterable], schema=None) -> Stream:
    """Any number of rows for each batch of rows; how many a batch has is up to the engine."""
    out = schema_of(_need(schema, step_id))
    arrow, write, read = to_arrow_schema(out, timestamp_utc=True), writer(out.names, step_id), reader(up.columns)

    def run(batches):
        for batch in batches:
            made = mapper([read(r) for r in batch.to_pylist()])
            try:
                made = iter(made)
            except TypeError:
                raise TypeError(f"mapper of step {step_id!r} must return an iterable, not {made!r}") from None
            if new := [write(x) for x in made]:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in out.names} for r in new], schema=arrow)

    return up.with_df(arrive(up.df.select(*up.columns).mapInArrow(run, out)))


@operator
def flatten(step_id: str, up: Stream) -> Stream:
    """A row for each element of the arrays in `value`."""
    if not isinstance(up.df.schema[VALUE].dataType, ArrayType):
        raise TypeError(f"step {step_id!r} needs arrays, not {up.df.schema[VALUE].dataType.simpleString()}")
    return up.with_df(_exploded(up, F.col(VALUE), [KEY] if KEY in up.columns else []))


def _checked(up: Stream, predicate: Column, step_id: str, strict: bool) -> Column:
    """The predicate, if it is boolean. With strict, a null in it stops the flow, at the price that no scan can take it over."""
    kind = up.df.select(predicate).schema[0]
    if not isinstance(kind.dataType, BooleanType):
        raise TypeError(f"predicate of step {step_id!r} must be boolean, not {kind.dataType.simpleString()}")
    if not kind.nullable or not strict:
        return predicate
    return F.coalesce(predicate, F.raise_error(F.lit(f"predicate of step {step_id} is null")).cast("boolean"))


def _truth(step_id: str, predicate, x) -> bool:
    got = predicate(x)
    if not isinstance(got, bool):
        raise TypeError(f"predicate of step {step_id!r} must return a bool, not {got!r}")
    return got


def _chosen(step_id: str, up: Stream, predicate, value_only: bool, strict: bool, wanted: bool = True) -> Stream:
    if isinstance(predicate, Column):
        kept = _checked(up, predicate, step_id, strict)
        return up.with_df(up.df.filter(kept if wanted else ~F.coalesce(kept, F.lit(False))))
    read, keyed = reader(up.value_columns if KEY in up.columns else up.columns), KEY in up.columns

    def run(batches):
        for batch in batches:
            keep = [_truth(step_id, predicate, read(r) if value_only or not keyed else (r[KEY], read(r))) is wanted for r in batch.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return up.with_df(up.df.mapInArrow(run, up.df.schema))


@operator
def filter(step_id: str, up: Stream, predicate: Column | Callable, strict: bool = False) -> Stream:  # noqa: A001
    """Rows for which the predicate is true.

    A callable that returns anything but a bool raises. A Column must be boolean; its nulls count as false, so that the
    filter can move into the scan, or raise with strict.
    """
    return _chosen(step_id, up, predicate, False, strict)


@operator
def filter_value(step_id: str, up: Stream, predicate: Column | Callable, strict: bool = False) -> Stream:
    """Rows whose value makes the predicate true; see ``filter``."""
    up.require_key(step_id)
    return _chosen(step_id, up, predicate, True, strict)


@operator
def branch(step_id: str, up: Stream, predicate: Column | Callable, strict: bool = False) -> BranchOut:
    """Rows for which the predicate is true, and all others; see ``filter``."""
    return BranchOut(_chosen(step_id, up, predicate, False, strict), _chosen(step_id, up, predicate, False, strict, wanted=False))


@operator
def filter_map(step_id: str, up: Stream, mapper: Mapper, schema=None) -> Stream:
    """map, without the rows that became null; zero, false and empty strings stay."""
    out = map("map", up, mapper, schema)
    return out.with_df(out.df.filter(_any_known(out.columns)))


@operator
def filter_map_value(step_id: str, up: Stream, mapper: Mapper, schema=None) -> Stream:
    """map_value, without the rows whose value became null."""
    out = map_value("map_value", up, mapper, schema)
    return out.with_df(out.df.filter(_any_known(out.value_columns)))


def _any_known(columns: list[str]) -> Column:
    known = F.lit(False)
    for c in columns:
        known = known | F.col(c).isNotNull()
    return known


@operator
def key_on(step_id: str, up: Stream, key: Column | Callable) -> Stream:
    """Gives each row a key; anything but a string raises."""
    if isinstance(key, Column):
        kind = up.df.select(key).schema[0].dataType.simpleString()
        if kind != "string":
            raise TypeError(f"key of step {step_id!r} must be a string, not {kind}; cast it")
        own = F.coalesce(key, F.raise_error(F.lit(f"key of step {step_id} is null")).cast("string"))
        rest = [c for c in up.columns if c != KEY]
        return up.with_df(up.df.select(own.alias(KEY), *rest, *_order(up)))
    out = schema_of(up.df.select(*[c for c in up.columns if c != KEY]).schema, keyed=True)
    rest = [c for c in up.columns if c != KEY]

    def run(rows):
        for row, item in rows:
            got = key(item)
            if not isinstance(got, str):
                raise TypeError(f"key of step {step_id!r} must be a str, not {got!r}")
            yield row, -1, {KEY: got, **{c: row[c] for c in rest}}

    return up.with_df(map_items(up, step_id, run, out))


@operator
def key_rm(step_id: str, up: Stream) -> Stream:
    """Drops the key."""
    up.require_key(step_id)
    return up.with_df(up.df.drop(KEY))


@operator
def merge(step_id: str, *ups: Stream) -> Stream:
    """All rows of one or more streams; columns are matched by name."""
    if not ups:
        raise TypeError(f"step {step_id!r} needs at least one stream to merge")
    df = ups[0].df
    for up in ups[1:]:
        df = df.unionByName(up.df, allowMissingColumns=True)
    return ups[0].with_df(df)


@operator
def redistribute(step_id: str, up: Stream, partitions: int | None = None) -> Stream:
    """Shares rows out evenly, whatever their key."""
    n = partitions or int(up.flow.spark.conf.get("spark.sql.shuffle.partitions"))
    return up.with_df(up.df.repartition(n))


def _print(step_id: str, item: Any) -> None:
    print(f"{step_id}: {item!r}")


@operator
def inspect(step_id: str, up: Stream, inspector: Callable[[str, Any], None] = _print) -> Stream:
    """Calls inspector(step_id, item) for each row on its way; by default prints it, in the worker's output."""
    return inspect_debug("inspect_debug", up, lambda _, item, epoch, worker: inspector(step_id, item))


def _print_debug(step_id: str, item: Any, epoch: int, worker: int) -> None:
    print(f"{step_id} W{worker} @{epoch}: {item!r}")


@operator
def inspect_debug(step_id: str, up: Stream, inspector: Callable[[str, Any, int, int], None] = _print_debug) -> Stream:
    """Calls inspector(step_id, item, epoch, worker) for each row on its way; epoch is the micro-batch, worker the partition."""
    read, keyed = reader(up.value_columns if KEY in up.columns else up.columns), KEY in up.columns

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        epoch = int(context.getLocalProperty("streaming.sql.batchId") or 0)
        for batch in batches:
            for row in batch.to_pylist():
                inspector(step_id, (row[KEY], read(row)) if keyed else read(row), epoch, context.partitionId())
            yield batch

    return up.with_df(up.df.mapInArrow(run, up.df.schema))


@operator
def raises(step_id: str, up: Stream) -> None:
    """Stops the flow on any row."""
    from ..sinks import RaisingSink

    up.flow.outputs.append((step_id, up, RaisingSink(step_id)))


class TTLCache:
    """Values of a getter, asked for again once they are older than ttl."""

    def __init__(self, getter: Callable, now: Callable[[], datetime], ttl: timedelta):
        self._getter, self._now, self._ttl = getter, now, ttl
        self._known: dict[Any, tuple[datetime, Any]] = {}

    def get(self, key):
        now = self._now()
        if key in self._known:
            since, value = self._known[key]
            if not now - since > self._ttl:
                return value
        value = self._getter(key)
        self._known[key] = (now, value)
        return value

    def remove(self, key) -> None:
        del self._known[key]


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


@operator
def enrich_cached(step_id: str, up: Stream, getter: DataFrame | Callable, mapper: Callable | Mapper | None = None, ttl: timedelta = timedelta.max, *, on=None, schema=None, now_getter: Callable[[], datetime] = _utc_now) -> Stream:
    """Adds what a lookup knows about each row.

    With a DataFrame as getter, a left join on the columns `on`, which the optimizer broadcasts if the lookup's size
    allows it; mapper, if given, are Columns over both. With a callable, mapper(cache, item) runs in Python; each task
    has a cache whose entries last for ttl, measured by one time for each batch.
    """
    if isinstance(getter, DataFrame):
        joined = up.df.join(getter, on, "left")
        keep = [KEY] if KEY in up.columns else []
        return up.with_df(joined if mapper is None else joined.select(*_columns(mapper, keep), *_order(up)))
    keyed = KEY in up.columns
    out = schema_of(_need(schema, step_id), keyed=keyed)
    read, write = reader(up.value_columns if keyed else up.columns), writer([n for n in out.names if not keyed or n != KEY], step_id)
    order = _order(up)
    from pyspark.sql.types import LongType, StructField, StructType

    full = StructType([*out.fields, *(StructField(c, LongType()) for c in order)])
    arrow = to_arrow_schema(full, timestamp_utc=True)

    def run(batches):
        held = [now_getter()]
        cache = TTLCache(getter, lambda: held[0], ttl)
        for batch in batches:
            held[0] = now_getter()
            new = [{**({KEY: r[KEY]} if keyed else {}), **write(mapper(cache, read(r))), **{c: r[c] for c in order}} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in full.names} for r in new], schema=arrow)

    return up.with_df(up.df.mapInArrow(run, full))
