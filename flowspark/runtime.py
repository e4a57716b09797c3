"""Running flows: bounded ones as batch jobs, others as streaming queries with a checkpoint."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from .stream import Flow

#: How long an epoch lasts by default.
EPOCH = timedelta(seconds=10)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FlowError(RuntimeError):
    """A step failed while the flow ran; the cause says how."""


@dataclass(frozen=True)
class RecoveryConfig:
    """Where a streaming flow keeps its progress and states, and how many epochs of them."""

    db_dir: str
    backup_epochs: int = 10


def prepare(spark: SparkSession, recovery: RecoveryConfig | None = None) -> None:
    """Settings of streaming queries with keyed state: RocksDB, which spills, with changelogs as checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    if recovery:
        spark.conf.set("spark.sql.streaming.minBatchesToRetain", recovery.backup_epochs)


def run_main(flow: Flow, *, epoch_interval: timedelta | None = None, recovery_config: RecoveryConfig | None = None, available_now: bool = False, timeout: float | None = None) -> list[StreamingQuery]:
    """Runs a flow to its end, or until timeout seconds have passed.

    Outputs of bounded inputs are written as batches, one after the other. Each other output is a streaming query whose
    epochs are micro-batches of epoch_interval; with available_now it stops once what is there now has been read. With
    a recovery_config, a query goes on where the last run with the same folder stopped; sinks that write files replace an
    epoch that comes twice.
    """
    if not flow.inputs:
        raise ValueError(f"flow {flow.flow_id!r} has no input")
    if not flow.outputs:
        raise ValueError(f"flow {flow.flow_id!r} has no output")
    queries: list[StreamingQuery] = []
    for step_id, up, sink in flow.outputs:
        try:
            if not up.df.isStreaming:
                sink.write(up, up.df, None)
                continue
            prepare(flow.spark, recovery_config)
            writer = up.df.writeStream.queryName(f"{flow.flow_id}.{step_id}").foreachBatch(lambda df, epoch, up=up, sink=sink: sink.write(up, df, epoch))
            writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{(epoch_interval or EPOCH).total_seconds()} seconds")
            if recovery_config:
                writer = writer.option("checkpointLocation", f"{recovery_config.db_dir}/{flow.flow_id}/{step_id}")
            queries.append(writer.start())
        except Exception as e:
            e.add_note(f"in output {flow.flow_id}.{step_id}")
            for q in queries:
                q.stop()
            raise
    until = time.monotonic() + timeout if timeout is not None else None
    try:
        while any(q.isActive for q in queries) and (until is None or time.monotonic() < until):
            _failed(queries)
            time.sleep(0.05)
        _failed(queries)
    finally:
        for q in queries:
            if q.isActive and (until is None or time.monotonic() >= until):
                q.stop()
    return queries


def _failed(queries: list[StreamingQuery]) -> None:
    for q in queries:
        if (e := q.exception()) is not None:
            raise FlowError(f"query {q.name!r} failed") from e


def cluster_main(flow: Flow, addresses: list[str] | None = None, proc_id: int = 0, *, worker_count_per_proc: int = 1, **kwargs) -> list[StreamingQuery]:
    """run_main on the session's cluster: its master says where tasks run, so addresses and process ids have no use."""
    return run_main(flow, **kwargs)


def run_until_idle(flow: Flow, *, idle_epochs: int = 2, epoch_interval: timedelta = timedelta(0), recovery_config: RecoveryConfig | None = None, timeout: float = 120) -> list[StreamingQuery]:
    """Runs streaming outputs until each has had idle_epochs in a row without input; for flows with timers, which available_now doesn't end."""
    prepare(flow.spark, recovery_config)
    queries = []
    for step_id, up, sink in flow.outputs:
        writer = up.df.writeStream.queryName(f"{flow.flow_id}.{step_id}").foreachBatch(lambda df, epoch, up=up, sink=sink: sink.write(up, df, epoch)).trigger(processingTime=f"{epoch_interval.total_seconds()} seconds")
        if recovery_config:
            writer = writer.option("checkpointLocation", f"{recovery_config.db_dir}/{flow.flow_id}/{step_id}")
        queries.append(writer.start())
    until = time.monotonic() + timeout
    try:
        for q in queries:
            while q.isActive and time.monotonic() < until:
                recent = q.recentProgress[-idle_epochs:]
                if len(recent) == idle_epochs and len(q.recentProgress) > idle_epochs and all(p["numInputRows"] == 0 for p in recent):
                    break
                time.sleep(0.05)
        _failed(queries)
    finally:
        for q in queries:
            q.stop()
    return queries
