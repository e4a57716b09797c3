"""Where rows go."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice
from typing import Any
from zlib import adler32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..items import BATCH_ROWS, reader
from ..stream import KEY, ORDER, VALUE, Stream

__all__ = ["DirSink", "DynamicSink", "FileSink", "FixedPartitionedSink", "KafkaSink", "ParquetSink", "RaisingSink", "Sink", "StatefulSinkPartition", "StatelessSinkPartition", "StdOutSink", "TestingSink"]


class Sink(ABC):
    """Takes the rows of a batch: all of a bounded flow, or those of one epoch of a streaming query, which may come twice."""

    keyed = False

    @abstractmethod
    def write(self, up: Stream, df: DataFrame, epoch: int | None) -> None: ...


def plain(df: DataFrame) -> DataFrame:
    return df.drop(*ORDER)


def _by_arrival(df: DataFrame) -> DataFrame:
    """Each partition's rows in order of arrival; a global sort would run the flow twice, once to find its ranges."""
    order = [c for c in ORDER if c in df.columns]
    return plain(df.sortWithinPartitions(*order)) if order else df


@dataclass
class ParquetSink(Sink):
    """Parquet files in a folder, by the values of partition_by."""

    path: str
    partition_by: list[str] = field(default_factory=list)

    def write(self, up, df, epoch):
        at = self.path if epoch is None else f"{self.path}/epoch={epoch}"
        plain(df).write.mode("overwrite").partitionBy(*self.partition_by).parquet(at)


@dataclass
class FileSink(Sink):
    """A folder of text files with the values, one to a line; an epoch that comes again replaces its own."""

    path: str
    keyed = False

    def write(self, up, df, epoch):
        at = self.path if epoch is None else f"{self.path}/epoch={epoch}"
        _by_arrival(df).select(F.col(VALUE).cast("string")).write.mode("overwrite").text(at)


@dataclass
class DirSink(Sink):
    """file_count folders of text files; assign_file (by default adler32 of the key) says which takes a row, and file_namer what it is called."""

    dir_path: str
    file_count: int
    file_namer: Callable[[int, int], str] = lambda i, n: f"part_{i}"
    assign_file: Callable[[str], int] | None = None
    keyed = True

    def write(self, up, df, epoch):
        assign, n = self.assign_file or (lambda k: adler32(k.encode())), self.file_count
        names = [self.file_namer(i, n) for i in range(n)]

        @F.pandas_udf("string")
        def name(keys):
            return keys.map(lambda k: names[assign(k) % n])

        order = [c for c in ORDER if c in df.columns]
        rows = df.select(name(F.col(KEY)).alias("file"), F.col(VALUE).cast("string").alias(VALUE), *order)
        at = self.dir_path if epoch is None else f"{self.dir_path}/epoch={epoch}"
        rows.repartition("file").sortWithinPartitions("file", *order).select("file", VALUE).write.mode("overwrite").partitionBy("file").text(at)


@dataclass
class StdOutSink(Sink):
    """Prints items, on the driver, a partition at a time."""

    def write(self, up, df, epoch):
        keyed = KEY in up.columns
        read = reader(up.value_columns if keyed else up.columns)
        for row in _by_arrival(df).toLocalIterator():
            r = row.asDict(recursive=True)
            print((r[KEY], read(r)) if keyed else read(r))


@dataclass
class TestingSink(Sink):
    """Appends items to a list."""

    __test__ = False

    out: list

    def write(self, up, df, epoch):
        keyed = KEY in up.columns
        read = reader(up.value_columns if keyed else up.columns)
        order = [c for c in ORDER if c in df.columns]
        for row in sorted(df.collect(), key=lambda r: [r[c] for c in order]):
            r = row.asDict(recursive=True)
            self.out.append((r[KEY], read(r)) if keyed else read(r))


@dataclass
class RaisingSink(Sink):
    """Raises on any row."""

    step_id: str

    def write(self, up, df, epoch):
        if rows := plain(df).take(1):
            raise RuntimeError(f"step {self.step_id!r} got {rows[0].asDict(recursive=True)!r}")


@dataclass
class KafkaSink(Sink):
    """Messages key and value, with headers and topic if the rows have them; needs Spark's Kafka connector on the class path."""

    brokers: list[str]
    topic: str | None = None
    add_config: dict[str, str] = field(default_factory=dict)

    def rows(self, df: DataFrame) -> DataFrame:
        if self.topic is None and "topic" not in df.columns:
            raise ValueError("KafkaSink needs a topic, or rows with one")
        topic = F.coalesce("topic", F.lit(self.topic)) if "topic" in df.columns else F.lit(self.topic)
        return df.select(*(F.col(c) for c in ("key", "value", "headers") if c in df.columns), topic.alias("topic"))

    def write(self, up, df, epoch):
        options = {"kafka.bootstrap.servers": ",".join(self.brokers)} | {f"kafka.{k}": v for k, v in self.add_config.items()}
        self.rows(plain(df)).write.format("kafka").options(**options).save()


# -- sinks written in Python


class StatefulSinkPartition(ABC):
    """Writes one part of a sink."""

    @abstractmethod
    def write_batch(self, values: list) -> None: ...

    def snapshot(self) -> Any:
        return None

    def close(self) -> None:
        pass


class StatelessSinkPartition(ABC):
    @abstractmethod
    def write_batch(self, items: list) -> None: ...

    def close(self) -> None:
        pass


def _in_batches(rows: Iterable) -> Iterator[list]:
    rows = iter(rows)
    while held := list(islice(rows, BATCH_ROWS)):
        yield held


class FixedPartitionedSink(Sink):
    """Named parts, each written by one task, BATCH_ROWS at a time; part_fn, by default adler32, says which takes a key.

    When a task has written its rows, its part's snapshot goes to the driver, and the next epoch builds the part with it
    as resume_state. With state_dir, a folder that outlives the driver, snapshots are written there after each epoch, and
    an epoch begins from the newest before it, so one that comes twice begins from the same.
    """

    keyed = True
    state_dir: str | None = None

    @abstractmethod
    def list_parts(self) -> list[str]: ...

    def part_fn(self, item_key: str) -> int:
        return adler32(item_key.encode())

    @abstractmethod
    def build_part(self, step_id: str, for_part: str, resume_state: Any) -> StatefulSinkPartition: ...

    def _states(self, spark, epoch: int | None) -> dict[str, bytes]:
        known = self.__dict__.get("_known", {})
        if self.state_dir is None:
            return known
        at = spark._jvm.org.apache.hadoop.fs.Path(self.state_dir)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()] if fs.exists(at) else []
        before = [e for e in there if epoch is None or e < epoch]
        if not before:
            return {}
        return {r.part: bytes(r.state) for r in spark.read.parquet(f"{self.state_dir}/{max(before)}").collect()}

    def write(self, up, df, epoch):
        spark, names, read, part_fn, build = df.sparkSession, sorted(self.list_parts()), reader(up.value_columns), self.part_fn, self.build_part
        states = self._states(spark, epoch)

        @F.pandas_udf("int")
        def number(keys):
            return keys.map(lambda k: part_fn(k) % len(names))

        order = [c for c in ORDER if c in df.columns]
        dealt = df.withColumn("_part", number(F.col(KEY))).repartition(len(names), "_part").sortWithinPartitions("_part", *order)

        def run(batches):
            rows = (r for batch in batches for r in batch.to_pylist())
            for k, own in groupby(rows, key=lambda r: r["_part"]):
                state = states.get(names[k])
                part = build("output", names[k], None if state is None else pickle.loads(state))
                try:
                    for some in _in_batches(own):
                        part.write_batch([read(r) for r in some])
                    yield pa.RecordBatch.from_pydict({"part": [names[k]], "state": [pickle.dumps(part.snapshot())]}, schema=pa.schema([("part", pa.string()), ("state", pa.binary())]))
                finally:
                    part.close()

        made = dealt.mapInArrow(run, "part string, state binary").collect()  # a row for each part
        known = states | {r.part: bytes(r.state) for r in made}
        self.__dict__["_known"] = known
        if self.state_dir is not None and known:
            saved = spark.createDataFrame(list(known.items()), "part string, state binary").coalesce(1)
            saved.write.mode("overwrite").parquet(f"{self.state_dir}/{0 if epoch is None else epoch}")


class DynamicSink(Sink):
    """A part for each task, for rows as they lie, BATCH_ROWS at a time; no more tasks than `workers`, by default as many as the cluster runs at once."""

    workers: int | None = None

    @abstractmethod
    def build(self, step_id: str, worker_index: int, worker_count: int) -> StatelessSinkPartition: ...

    def write(self, up, df, epoch):
        keyed, build = KEY in up.columns, self.build
        read = reader(up.value_columns if keyed else up.columns)
        n = self.workers or df.sparkSession.sparkContext.defaultParallelism

        def run(rows):
            from pyspark import TaskContext

            part = build("output", TaskContext.get().partitionId(), n)
            try:
                for some in _in_batches(rows):
                    part.write_batch([(r[KEY], read(r)) if keyed else read(r) for r in (x.asDict(recursive=True) for x in some)])
            finally:
                part.close()

        plain(df).coalesce(n).foreachPartition(run)
