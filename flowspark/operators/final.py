"""Aggregates of a whole, finite stream: one result for each key, at its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


from ..stream import KEY, ORDER, VALUE, Stream, arrive, operator
from .stateful import keyed_scan
from .stateless import key_on


def _value(up: Stream) -> Column:
    return F.col(VALUE) if up.value_columns == [VALUE] else F.struct(*up.value_columns)


def _unpacked(up: Stream, df) -> Stream:
    """One value column `value` stays; a struct becomes its fields."""
    if up.value_columns == [VALUE]:
        return up.with_df(arrive(df.select(KEY, VALUE)))
    return up.with_df(arrive(df.select(KEY, f"{VALUE}.*")))


@operator
def count_final(step_id: str, up: Stream, key: Column | Callable) -> Stream:
    """Rows by key: key, value."""
    keyed = key_on("key_on", up, key)
    return up.with_df(arrive(keyed.df.groupBy(KEY).agg(F.count("*").alias(VALUE))))


@operator
def reduce_final(step_id: str, up: Stream, reducer: Column | dict[str, Column] | Callable, schema=None) -> Stream:
    """Values of a key joined into one.

    An aggregate Column (or a dict of them), such as F.sum("value"), is summed up before rows are shuffled. A Python
    callable (a, b) -> c, which must be associative, reduces each partition first and then what is left of each key.
    """
    up.require_key(step_id)
    if not callable(reducer) or isinstance(reducer, Column):
        columns = reducer if isinstance(reducer, dict) else {VALUE: reducer}
        return up.with_df(arrive(up.df.groupBy(KEY).agg(*(c.alias(n) for n, c in columns.items()))))
    part = _reduced(step_id, up, reducer)
    return keyed_scan(step_id, part, lambda: _Reduce(reducer), schema or up.df.select(*up.value_columns).schema)


class _Reduce:
    """Folds without a start value; a null result starts afresh."""

    def __init__(self, reducer):
        self.reducer, self.value = reducer, None

    def step(self, value):
        self.value = value if self.value is None else self.reducer(self.value, value)
        return ()

    def end(self):
        return (self.value,)


#: Keys that a partition's first pass holds at once.
PARTIAL_KEYS = 10_000


def _reduced(step_id: str, up: Stream, reducer: Callable) -> Stream:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..items import reader, writer

    names, read = up.df.columns, reader(up.value_columns)
    write, arrow = writer(up.value_columns, step_id), to_arrow_schema(up.df.schema, timestamp_utc=True)

    def run(batches):
        held: dict[str, tuple] = {}

        def rows():
            made = [{KEY: k, **write(v), **{c: r[c] for c in ORDER if c in names}} for k, (v, r) in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(made, schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                key, value = row[KEY], read(row)
                old = held.get(key)
                held[key] = (value if old is None or old[0] is None else reducer(old[0], value), row if old is None else old[1])
            if len(held) > PARTIAL_KEYS:
                yield rows()
        if held:
            yield rows()

    return up.with_df(up.df.mapInArrow(run, up.df.schema))


@operator
def fold_final(step_id: str, up: Stream, builder: Callable | None = None, folder: Callable | None = None, schema=None, *, agg: Column | dict[str, Column] | None = None) -> Stream:
    """Values of a key folded in order of arrival: folder(accumulator, value), from builder().

    With agg, an aggregate Column or a dict of them, the engine does it. A Python fold streams through a key's values
    and holds its accumulator only.
    """
    up.require_key(step_id)
    if agg is not None:
        columns = agg if isinstance(agg, dict) else {VALUE: agg}
        return up.with_df(arrive(up.df.groupBy(KEY).agg(*(c.alias(n) for n, c in columns.items()))))

    class Fold:
        def __init__(self):
            self.value = builder()

        def step(self, value):
            self.value = folder(self.value, value)
            return ()

        def end(self):
            return (self.value,)

    if schema is None:
        raise TypeError(f"step {step_id!r}: a Python callable needs schema=")
    return keyed_scan(step_id, up, Fold, schema)


def _extreme(step_id: str, up: Stream, by, largest: bool) -> Stream:
    up.require_key(step_id)
    if callable(by) and not isinstance(by, Column):
        pick = max if largest else min
        return _call_reduce(step_id, up, lambda a, b: pick(a, b, key=by))
    by = _value(up) if by is None else by
    kind = "max_by" if largest else "min_by"
    if up.ordered:  # the first to arrive wins a tie
        places = [F.col(c) for c in ORDER]
        rank = F.struct(by.alias("by"), *((-p if largest else p).alias(f"o{k}") for k, p in enumerate(places)))
    else:
        rank = by
    return _unpacked(up, up.df.groupBy(KEY).agg(getattr(F, kind)(_value(up), rank).alias(VALUE)))


def _call_reduce(step_id, up, reducer):
    return keyed_scan(step_id, _reduced(step_id, up, reducer), lambda: _Reduce(reducer), up.df.select(*up.value_columns).schema)


@operator
def max_final(step_id: str, up: Stream, by: Column | Callable | None = None) -> Stream:
    """The item of each key with the largest `by`, by default itself; of equals the first to arrive."""
    return _extreme(step_id, up, by, True)


@operator
def min_final(step_id: str, up: Stream, by: Column | Callable | None = None) -> Stream:
    """The item of each key with the smallest `by`, by default itself; of equals the first to arrive."""
    return _extreme(step_id, up, by, False)


