"""Rows as Python items, for operators that take Python callables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .stream import ARRIVAL, KEY, ORDER, SUB, VALUE, Stream, sub_place

#: Rows that Python hands back to Spark at once.
BATCH_ROWS = 2048


def schema_of(ddl: str | StructType, keyed: bool = False) -> StructType:
    """Schema of items: a DDL list of columns, or a bare type for streams of values."""
    from pyspark.sql.types import DataType, StringType, StructField, _parse_datatype_string

    parsed = ddl if isinstance(ddl, DataType) else _parse_datatype_string(ddl)
    out = parsed if isinstance(parsed, StructType) and not (isinstance(ddl, str) and ddl.lower().startswith("struct")) else StructType([StructField(VALUE, parsed)])
    if keyed and KEY not in out.names:
        out = StructType([StructField(KEY, StringType()), *out.fields])
    return out


def reader(columns: list[str]) -> Callable[[dict], Any]:
    """Row dict to item: the bare value if there's just that column, else a dict."""
    if columns == [VALUE]:
        return lambda row: row[VALUE]
    return lambda row: {c: row[c] for c in columns}


def writer(columns: list[str], step_id: str) -> Callable[[Any], dict]:
    def write(item) -> dict:
        if columns == [VALUE]:
            return {VALUE: item}
        if isinstance(item, dict):
            return item
        if isinstance(item, (tuple, list)) and len(item) == len(columns):
            return dict(zip(columns, item, strict=True))
        raise TypeError(f"step {step_id!r} made {item!r}, which doesn't fit the columns {columns}")

    return write


def map_items(up: Stream, step_id: str, fn: Callable[[Iterator[tuple[dict, Any]]], Iterable[tuple[dict, int, dict]]], out: StructType, df: DataFrame | None = None) -> DataFrame:
    """Runs fn over the rows of each partition: from (row, item) it makes (row it came from, place among its rows, new columns).

    New rows keep the place of arrival of the row they came from.
    """
    from pyspark.sql.types import LongType, StructField

    source = up.df if df is None else df
    has_order = ARRIVAL in source.columns
    full = StructType([*out.fields, *([StructField(c, LongType()) for c in ORDER] if has_order else [])])
    arrow, read = to_arrow_schema(full, timestamp_utc=True), reader(up.value_columns if KEY in up.columns else up.columns)
    names = full.names

    def run(batches):
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    yield row, read(row)

        held: list[dict] = []
        for source_row, place, new in fn(rows()):
            if has_order:
                new = {**new, ARRIVAL: source_row[ARRIVAL], SUB: sub_place(source_row[SUB], place) if place >= 0 else source_row[SUB]}
            held.append(new)
            if len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema=arrow)

    return source.mapInArrow(run, full)


def by_key(up: Stream, more: tuple[str, ...] = ()) -> DataFrame:
    """The rows with those of a key together and in order of arrival: a shuffle and a sort, after which a task streams through its keys and holds one at a time."""
    order = [c for c in ORDER if c in up.df.columns]
    return up.df.repartition(KEY, *more).sortWithinPartitions(KEY, *more, *(F.col(c) for c in order))
