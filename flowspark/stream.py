"""Flows and streams: named DataFrames with an order of arrival."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, VALUE = "key", "value"
#: Columns that hold a row's place in the order of arrival: its source's number, and its place among rows made of one.
ARRIVAL, SUB = "_arrival", "_sub"
ORDER = (ARRIVAL, SUB)
#: Bits that one level of flat_map takes of the second: up to 2**20 rows made of one, three levels deep.
SUB_BITS = 20


def sub_place(sub: int, place: int) -> int:
    """The second place of a row that is the place-th made of one with the given second place."""
    if place >> SUB_BITS or sub >> (63 - SUB_BITS):
        raise OverflowError(f"order of arrival: more than {1 << SUB_BITS} rows made of one, or of rows made of rows more than three deep")
    return (sub << SUB_BITS) | place


def sub_column(sub: Column, place: Column) -> Column:
    """The same for columns."""
    fits = (F.shiftright(place, SUB_BITS) == 0) & (F.shiftright(sub, 63 - SUB_BITS) == 0)
    message = F.lit(f"order of arrival: more than {1 << SUB_BITS} rows made of one, or of rows made of rows more than three deep")
    return F.when(fits, F.shiftleft(sub, SUB_BITS).bitwiseOR(place)).otherwise(F.raise_error(message).cast("long"))


@dataclass
class Step:
    """An operator call: its id with those of the steps around it, its streams, and the steps inside."""

    step_id: str
    kind: str
    ups: dict[str, list[str]]
    downs: dict[str, str] = field(default_factory=dict)
    substeps: list[Step] = field(default_factory=list)


class Flow:
    """A named graph of steps; its plan is what Spark makes of its streams' DataFrames."""

    def __init__(self, flow_id: str, spark: SparkSession | None = None):
        if not flow_id or "." in flow_id:
            raise ValueError(f"flow id {flow_id!r} must be a name without a period")
        self.flow_id, self._spark = flow_id, spark
        self.steps: list[Step] = []
        self.outputs: list[tuple[str, Stream, Any]] = []
        self.inputs = 0
        self._open: list[Step] = []

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return self._spark

    def path(self, step_id: str) -> str:
        return ".".join([self._open[-1].step_id if self._open else self.flow_id, step_id])

    def siblings(self) -> list[Step]:
        return self._open[-1].substeps if self._open else self.steps

    def stream(self, stream_id: str, df: DataFrame) -> Stream:
        return Stream(self, stream_id, df)


@dataclass(frozen=True)
class Stream:
    """A DataFrame that steps of a flow pass on. A keyed stream has a string column `key`; a stream of bare values has the column `value`."""

    flow: Flow = field(repr=False)
    stream_id: str
    df: DataFrame = field(repr=False)

    def then(self, op: Callable, step_id: str, *args, **kwargs):
        """op(step_id, self, ...): calls in the order in which data flow."""
        return op(step_id, self, *args, **kwargs)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in ORDER]

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.columns if c != KEY]

    @property
    def ordered(self) -> bool:
        return ARRIVAL in self.df.columns

    @property
    def order(self) -> list[Column]:
        """Order of arrival; all rows tie where a source has none."""
        return [F.col(c) for c in ORDER if c in self.df.columns] or [F.lit(0)]

    @property
    def order_key(self) -> Column:
        return F.struct(*(c.alias(f"o{k}") for k, c in enumerate(self.order)))

    def require_key(self, step_id: str) -> None:
        if KEY not in self.df.columns:
            raise TypeError(f"step {step_id!r} needs a keyed stream; use key_on() first")
        kind = self.df.schema[KEY].dataType.simpleString()
        if kind != "string":
            raise TypeError(f"step {step_id!r} needs string keys, not {kind}")

    def with_df(self, df: DataFrame) -> Stream:
        return replace(self, df=df)


KeyedStream = Stream


def arrive(df: DataFrame, by: Column | str | None = None) -> DataFrame:
    """df with an order of arrival: by a column of whole numbers, or as its partitions list the rows."""
    if df.isStreaming:
        return df
    at = F.monotonically_increasing_id() if by is None else F.col(by) if isinstance(by, str) else by
    return df.withColumns({ARRIVAL: at.cast("long"), SUB: F.lit(0).cast("long")})


def _streams(x: Any) -> list[Stream]:
    if isinstance(x, Stream):
        return [x]
    if isinstance(x, (list, tuple)):
        return [s for y in x for s in _streams(y)]
    return []


def operator(builder: Callable) -> Callable:
    """Makes a function (step_id, up or flow, ...) an operator: step ids are checked, and what it calls becomes its substeps.

    The function returns a stream, a dataclass of streams, or None.
    """
    signature = inspect.signature(builder)
    if next(iter(signature.parameters), None) != "step_id":
        raise TypeError("builder function requires `step_id` as its first parameter")

    @wraps(builder)
    def call(step_id: str, *args, **kwargs):
        bound = signature.bind(step_id, *args, **kwargs)
        if not isinstance(step_id, str):
            raise TypeError(f"step id must be a str, not {step_id!r}; is it missing?")
        if not step_id or "." in step_id:
            raise ValueError(f"step id {step_id!r} must be a name without a period")
        ups = {n: _streams(v) for n, v in bound.arguments.items() if _streams(v)}
        flows = {id(f): f for f in [s.flow for ss in ups.values() for s in ss] + [v for v in bound.arguments.values() if isinstance(v, Flow)]}
        if not flows:
            raise TypeError(f"step {step_id!r} was given neither a flow nor a stream")
        if len(flows) > 1:
            raise ValueError(f"step {step_id!r} joins streams of different flows")
        flow = next(iter(flows.values()))
        path = flow.path(step_id)
        if any(s.step_id == path for s in flow.siblings()):
            raise ValueError(f"step id {path!r} is already taken")
        step = Step(path, builder.__name__, {n: [s.stream_id for s in ss] for n, ss in ups.items()})
        flow.siblings().append(step)
        flow._open.append(step)
        try:
            out = builder(step_id, *args, **kwargs)
        except Exception as e:
            e.add_note(f"in step {path!r} ({builder.__name__})")
            raise
        finally:
            flow._open.pop()
        if isinstance(out, Stream):
            step.downs["down"] = f"{path}.down"
            return replace(out, stream_id=f"{path}.down")
        fields = getattr(out, "__dataclass_fields__", {})
        named = {n: replace(s, stream_id=f"{path}.{n}") for n in fields if isinstance(s := getattr(out, n), Stream)}
        step.downs |= {n: s.stream_id for n, s in named.items()}
        return replace(out, **named) if named else out

    call.is_operator = True
    return call
