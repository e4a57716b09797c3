"""Where rows come from."""

from __future__ import annotations

import asyncio
import pickle
import queue
import random
import time
from abc import ABC, abstractmethod
from collections.abc import AsyncIterable, Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema

from ..items import BATCH_ROWS, schema_of, writer
from ..stream import ARRIVAL, SUB

__all__ = [
    "AbortExecution", "CSVSource", "DirSource", "DynamicSource", "FileSource", "FixedPartitionedSource", "KafkaSource", "ParquetSource",
    "RandomMetricSource", "Retry", "SimplePollingSource", "Source", "StatefulSourcePartition", "StatelessSourcePartition", "TableSource",
    "TestingSource", "batch", "batch_async", "batch_getter", "batch_getter_ex",
]


class Source(ABC):
    """Anything that a flow can read."""

    arrival = None

    @abstractmethod
    def read(self, spark: SparkSession) -> DataFrame: ...


class AbortExecution(RuntimeError):
    """Raised by a source to stop a flow as a crash would."""


@dataclass
class TableSource(Source):
    """A DataFrame made by a function of the session; arrival names a whole-number column that orders its rows."""

    make: Callable[[SparkSession], DataFrame]
    arrival: str | None = None

    def read(self, spark):
        return self.make(spark)


@dataclass
class ParquetSource(Source):
    """Parquet files; with stream, new files of a folder as they come."""

    path: str
    arrival: str | None = None
    stream: bool = False
    max_files_per_trigger: int | None = None

    def read(self, spark):
        if not self.stream:
            return spark.read.parquet(self.path)
        reader = spark.readStream.schema(spark.read.parquet(self.path).schema)
        if self.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_trigger)
        return reader.parquet(self.path)


def _lines(spark: SparkSession, path: str, stream: bool, glob: str | None, whole: int | None = None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if whole and stream:
        reader = reader.option("maxFilesPerTrigger", whole)
    return reader.option("lineSep", "\n").text(path)


@dataclass
class FileSource(Source):
    """Lines of a text file, without their ends; blank ones stay. With stream, path is a folder whose new files are read."""

    path: str
    stream: bool = False

    def read(self, spark):
        return _lines(spark, str(self.path), self.stream, None)


@dataclass
class DirSource(Source):
    """Lines of a folder's files that match glob_pat."""

    dir_path: str
    glob_pat: str = "*"
    stream: bool = False

    def read(self, spark):
        from py4j.protocol import Py4JJavaError

        at = spark._jvm.org.apache.hadoop.fs.Path(str(self.dir_path))
        try:
            status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        except Py4JJavaError:
            raise ValueError(f"input directory {self.dir_path!r} does not exist") from None
        if not status.isDirectory():
            raise ValueError(f"input directory {self.dir_path!r} is not a directory")
        return _lines(spark, str(self.dir_path), self.stream, self.glob_pat)


@dataclass
class CSVSource(Source):
    """Rows of CSV files with a header; all columns are strings. Further options are Spark's: sep, quote, escape and so on."""

    path: str
    options: dict[str, Any] = field(default_factory=dict)
    stream: bool = False

    def read(self, spark):
        batch = spark.read.options(header=True, inferSchema=False, **self.options)
        if not self.stream:
            return batch.csv(str(self.path))
        return spark.readStream.schema(batch.csv(str(self.path)).schema).options(header=True, **self.options).csv(str(self.path))


@dataclass
class KafkaSource(Source):
    """Messages of Kafka topics: key, value, topic, partition, offset, timestamp, headers. With tail a streaming query, else what there is now. Needs Spark's Kafka connector on the class path."""

    brokers: list[str]
    topics: list[str]
    tail: bool = True
    starting_offset: str = "earliest"
    add_config: dict[str, str] = field(default_factory=dict)
    batch_size: int | None = None

    def options(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": ",".join(self.brokers), "subscribe": ",".join(self.topics), "startingOffsets": self.starting_offset, "includeHeaders": "true"}
        out |= {f"kafka.{k}": v for k, v in self.add_config.items()}
        return out | ({"maxOffsetsPerTrigger": str(self.batch_size)} if self.batch_size and self.tail else {})

    def read(self, spark):
        reader = (spark.readStream if self.tail else spark.read).format("kafka").options(**self.options())
        return reader.load().select("key", "value", "topic", "partition", "offset", "timestamp", "headers")


# -- sources written in Python


class StatefulSourcePartition(ABC):
    """Reads one part of a source. next_batch raises StopIteration at its end; snapshot says where to go on."""

    @abstractmethod
    def next_batch(self) -> Iterable: ...

    def next_awake(self) -> datetime | None:
        return None

    @abstractmethod
    def snapshot(self) -> Any: ...

    def close(self) -> None:
        pass


class StatelessSourcePartition(ABC):
    """Reads a share of a source that can't go on from where it was."""

    @abstractmethod
    def next_batch(self) -> Iterable: ...

    def next_awake(self) -> datetime | None:
        return None

    def close(self) -> None:
        pass


def _drain(part) -> Iterator:
    """All items of a part, with the pauses it asks for."""
    try:
        while True:
            due = part.next_awake()
            if due is not None and (rest := (due - datetime.now(timezone.utc)).total_seconds()) > 0:
                time.sleep(rest)
            try:
                yield from part.next_batch()
            except StopIteration:
                return
    finally:
        part.close()


def _read_parts(spark: SparkSession, names: list[str], build: Callable[[str], Any], ddl: str) -> DataFrame:
    """A task for each part, which reads it to its end; rows are numbered part by part."""
    schema = schema_of(ddl)
    write = writer(schema.names, "input")
    arrow = to_arrow_schema(schema, timestamp_utc=True).append(pa.field(ARRIVAL, pa.int64()))

    def run(batches):
        for batch in batches:
            for number, name in zip(batch.column("number").to_pylist(), batch.column("name").to_pylist(), strict=True):
                held = []
                for place, item in enumerate(_drain(build(name))):
                    held.append({**write(item), ARRIVAL: (number << 40) + place})
                    if len(held) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    parts = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "number long, name string").repartition(max(1, len(names)), "number")
    from pyspark.sql.types import LongType, StructField, StructType

    full = StructType([*schema.fields, StructField(ARRIVAL, LongType())])
    return parts.mapInArrow(run, full).withColumn(SUB, F.lit(0).cast("long"))


class FixedPartitionedSource(Source):
    """A source of named parts. schema is the DDL of its items.

    Bounded parts are read to their end, each by one task. With stream, a streaming query polls them on the driver, a
    batch of each an epoch; its offset holds their snapshots, from which a restart goes on. That suits sources with few
    items; others should write files for ``ParquetSource`` or come through Kafka.
    """

    schema: str = "string"
    stream: bool = False

    @abstractmethod
    def list_parts(self) -> list[str]: ...

    @abstractmethod
    def build_part(self, step_id: str, for_part: str, resume_state: Any) -> StatefulSourcePartition: ...

    def read(self, spark):
        if not self.stream:
            return _read_parts(spark, sorted(self.list_parts()), lambda name: self.build_part("input", name, None), self.schema)
        name = f"flowspark_parts_{id(self)}"
        spark.dataSource.register(_data_source(name, schema_of(self.schema), _PartsReader, pickle_by_value(self)))
        return spark.readStream.format(name).load()


class DynamicSource(Source):
    """A source that each of `workers` tasks reads a share of."""

    schema: str = "string"
    workers: int = 1

    @abstractmethod
    def build(self, step_id: str, worker_index: int, worker_count: int) -> StatelessSourcePartition: ...

    def read(self, spark):
        n = self.workers
        return _read_parts(spark, [str(k) for k in range(n)], lambda name: self.build("input", int(name), n), self.schema)


class Retry(Exception):  # noqa: N818
    """Raised by next_item to be asked again after a while."""

    def __init__(self, timeout: timedelta):
        super().__init__(timeout)
        self.timeout = timeout


class SimplePollingSource(Source):
    """Asks next_item for an item at every interval, aligned to align_to if given; a streaming query with the state of snapshot and resume as its offset."""

    schema: str = "string"

    def __init__(self, interval: timedelta, align_to: datetime | None = None):
        self.interval, self.align_to = interval, align_to

    @abstractmethod
    def next_item(self) -> Any: ...

    def snapshot(self) -> Any:
        return None

    def resume(self, state: Any) -> None:
        pass

    def first_awake(self, now: datetime) -> datetime:
        """When to ask first: at once, or at the next time that lies whole intervals from align_to."""
        if self.align_to is None:
            return now
        missing = (self.align_to - now) % self.interval
        return now + missing

    def read(self, spark):
        name = f"flowspark_polling_{id(self)}"
        spark.dataSource.register(_data_source(name, schema_of(self.schema), _PollingReader, pickle_by_value(self)))
        return spark.readStream.format(name).load()


def pickle_by_value(x) -> bytes:
    from pyspark import cloudpickle

    return cloudpickle.dumps(x)


def _to_text(state: Any) -> str:
    return pickle.dumps(state).hex()


def _from_text(text: str) -> Any:
    return pickle.loads(bytes.fromhex(text))


class _PollingReader(SimpleDataSourceStreamReader):
    """Reads a SimplePollingSource: an item an epoch, when its time has come. What a crash leaves uncommitted is asked for anew."""

    def __init__(self, source: SimplePollingSource, kind):
        self.source, self.write, self.names, self.due = source, writer(kind.names, "input"), kind.names, None

    def initialOffset(self):
        return {"n": 0, "state": ""}

    def read(self, start):
        now = datetime.now(timezone.utc)
        if self.due is None:
            if start["state"]:
                self.source.resume(_from_text(start["state"]))
            self.due = self.source.first_awake(now)
        if now < self.due:
            return iter(()), start
        self.due += self.source.interval
        try:
            item = self.source.next_item()
        except Retry as e:
            self.due = now + e.timeout
            return iter(()), start
        new = [] if item is None else [self.write(item)]
        return iter([tuple(r[n] for n in self.names) for r in new]), {"n": start["n"] + 1, "state": _to_text(self.source.snapshot())}

    def readBetweenOffsets(self, start, end):
        return iter(())

    def commit(self, end):
        pass


class _PartsReader(SimpleDataSourceStreamReader):
    """Reads a FixedPartitionedSource: a batch of each part an epoch."""

    def __init__(self, source: FixedPartitionedSource, kind):
        self.source, self.write, self.names = source, writer(kind.names, "input"), kind.names
        self.parts: dict[str, StatefulSourcePartition] = {}
        self.ended: set[str] = set()

    def initialOffset(self):
        return {}

    def _part(self, name: str, offset: dict) -> StatefulSourcePartition:
        if name not in self.parts:
            self.parts[name] = self.source.build_part("input", name, _from_text(offset[name]) if name in offset else None)
        return self.parts[name]

    def _batch(self, part) -> list[tuple] | None:
        due = part.next_awake()
        if due is not None and due > datetime.now(timezone.utc):
            return []
        try:
            return [tuple(r[n] for n in self.names) for r in (self.write(x) for x in part.next_batch())]
        except StopIteration:
            return None

    def read(self, start):
        rows, end = [], dict(start)
        for name in sorted(self.source.list_parts()):
            if name in self.ended:
                continue
            part = self._part(name, start)
            if (new := self._batch(part)) is None:
                self.ended.add(name)
            elif new:
                rows += new
                end[name] = _to_text(part.snapshot())
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        rows = []
        for name, state in end.items():
            if start.get(name) == state:
                continue
            part = self.source.build_part("input", name, _from_text(start[name]) if name in start else None)
            while _to_text(part.snapshot()) != state and (new := self._batch(part)) is not None:
                rows += new
        return iter(rows)

    def commit(self, end):
        pass


def _data_source(name: str, kind, reader, pickled: bytes):
    class Own(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return kind

        def simpleStreamReader(self, schema):
            return reader(pickle.loads(pickled), kind)

    return Own


class _RandomMetricPoll(SimplePollingSource):
    """A random number at each interval; a restart draws on from where the last run was."""

    schema = "key string, value double"

    def __init__(self, name: str, interval: timedelta, next_random: Callable[[], float] | None, seed: int):
        super().__init__(interval)
        self.name, self.next_random, self.random = name, next_random, random.Random(seed)

    def next_item(self):
        return self.name, float((self.next_random or self.random.random)())

    def snapshot(self):
        return self.random.getstate()

    def resume(self, state):
        self.random.setstate(state)


@dataclass
class RandomMetricSource(Source):
    """Rows (key, value): a metric's name and a random number, count of them, or without count a streaming query with one each interval."""

    metric_name: str
    interval: timedelta = timedelta(seconds=0.7)
    count: int | None = None
    next_random: Callable[[], float] | None = None
    seed: int = 0

    def read(self, spark):
        if self.count is None:
            return _RandomMetricPoll(self.metric_name, self.interval, self.next_random, self.seed).read(spark)
        draw = self.next_random or random.Random(self.seed).random
        return spark.createDataFrame([(self.metric_name, float(draw())) for _ in range(self.count)], "key string, value double")


@dataclass
class TestingSource(Source):
    """Items of a list, in order; EOF and ABORT sentinels end a run, and the next run of the same object goes on behind them (ABORT: once)."""

    __test__ = False

    items: list
    schema: str = "string"
    batch_size: int = 1
    at: int = field(default=0, init=False)
    done: set = field(default_factory=set, init=False)

    class EOF:
        """Ends this run."""

    class ABORT:
        """Stops this run as a crash would; items since its start come again in the next."""

    @dataclass
    class PAUSE:
        """Waits before the next item."""

        for_duration: timedelta

    def read(self, spark):
        kind = schema_of(self.schema)
        write = writer(kind.names, "input")
        start, rows = self.at, []
        for k in range(start, len(self.items)):
            item = self.items[k]
            if isinstance(item, TestingSource.EOF) or item is TestingSource.EOF:
                self.at = k + 1
                break
            if isinstance(item, TestingSource.ABORT) or item is TestingSource.ABORT:
                if k not in self.done:
                    self.done.add(k)
                    raise AbortExecution()
                continue
            if isinstance(item, TestingSource.PAUSE):
                time.sleep(item.for_duration.total_seconds())
                continue
            rows.append((*(write(item)[n] for n in kind.names), k, 0))
        else:
            self.at = len(self.items)
        from pyspark.sql.types import LongType, StructField, StructType

        return spark.createDataFrame(rows, StructType([*kind.fields, StructField(ARRIVAL, LongType()), StructField(SUB, LongType())]))


# -- helpers for next_batch


def batch(items: Iterable, batch_size: int) -> Iterator[list]:
    """Lists of up to batch_size items."""
    held = []
    for x in items:
        held.append(x)
        if len(held) == batch_size:
            yield held
            held = []
    if held:
        yield held


def batch_getter(getter: Callable[[], Any], batch_size: int, yield_on: Any = None) -> Iterator[list]:
    """Lists of what getter returns, cut at batch_size and where it returns yield_on; StopIteration ends them after what there is."""
    more = True
    while more:
        held = []
        while more and len(held) < batch_size:
            try:
                x = getter()
            except StopIteration:
                more = False
                break
            if x == yield_on:
                break
            held.append(x)
        if more or held:
            yield held


def batch_getter_ex(getter: Callable[[], Any], batch_size: int, yield_ex: type[Exception] = queue.Empty) -> Iterator[list]:
    """Lists of what getter returns, cut at batch_size and where it raises yield_ex; StopIteration ends them after what there is."""
    more = True
    while more:
        held = []
        try:
            while len(held) < batch_size:
                held.append(getter())
        except yield_ex:
            pass
        except StopIteration:
            more = False
        if more or held:
            yield held


def batch_async(aib: AsyncIterable, timeout: timedelta, batch_size: int, loop: asyncio.AbstractEventLoop | None = None) -> Iterator[list]:
    """Lists of what an async iterable gives within timeout, up to batch_size; an item that is still on its way comes with the next list."""
    loop = loop or asyncio.new_event_loop()
    source, waiting, ended = aib.__aiter__(), None, False

    async def gather() -> list:
        nonlocal waiting, ended
        held, until = [], loop.time() + timeout.total_seconds()
        while len(held) < batch_size:
            if waiting is None:
                waiting = asyncio.ensure_future(anext(source))
            done, _ = await asyncio.wait([waiting], timeout=max(0, until - loop.time()))
            if not done:
                break
            task, waiting = waiting, None
            try:
                held.append(task.result())
            except StopAsyncIteration:
                ended = True
                break
        return held

    while not ended:
        held = loop.run_until_complete(gather())
        if held or not ended:
            yield held

