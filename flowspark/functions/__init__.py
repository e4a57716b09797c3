"""Column functions that the windowed and keyed operators are built from."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No event lies further from another; stands for a wait that never ends.
FOREVER = timedelta.max

#: A running value along a key is found slice by slice, so that no task goes through all of a key's rows. Slices are cut
#: every 2**20 places of arrival, or every 2**32 microseconds (71.6 minutes).
ARRIVAL_SLICE_BITS, TIME_SLICE_BITS = 20, 32


def micros(x: timedelta) -> int:
    return (x.days * 86_400 + x.seconds) * 1_000_000 + x.microseconds


def epoch_micros(x: datetime) -> int:
    return micros((x if x.tzinfo else x.replace(tzinfo=timezone.utc)) - datetime(1970, 1, 1, tzinfo=timezone.utc))


def ts_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a zone; the latter counts as the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def whole_div(a: Column, b: int) -> Column:
    """a / b rounded down, for whole numbers of any sign, without leaving whole numbers; `div` alone rounds to zero."""
    divisor = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, divisor), divisor)


def sliding_ids(at: Column, length: int, offset: int, align: int) -> Column:
    """Array of the ids of all windows that hold a time; all in microseconds. Window i is [align + i * offset, + length)."""
    since = at - F.lit(align)
    return F.sequence(whole_div(since - F.lit(length), offset) + 1, whole_div(since, offset))


def from_micros(at: Column) -> Column:
    return F.timestamp_micros(at)


def sliced(rows: DataFrame, along: str, bits: int) -> DataFrame:
    """rows with the column _slice, by the upper bits of a whole-number column."""
    return rows.withColumn("_slice", F.shiftright(F.col(along), bits))


def before_slice(slices: DataFrame, group: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """For each slice of a group, aggregates over the group's earlier slices; there are few slices to a group, whatever its rows."""
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select(*group, "_slice", *(v.over(earlier).alias(n) for n, v in values.items()))
