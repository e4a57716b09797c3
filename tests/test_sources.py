"""Sources, sinks, recovery, polling and the command line."""

import asyncio
import sys
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import flowspark.operators as op
from flowspark import Flow, FlowError, RecoveryConfig, run_main, run_until_idle
from flowspark.operators import kafka
from flowspark.run import load, locate
from flowspark.sinks import DirSink, DynamicSink, FileSink, FixedPartitionedSink, KafkaSink, ParquetSink, StatefulSinkPartition, StatelessSinkPartition, StdOutSink
from flowspark.sources import (
    AbortExecution, CSVSource, DirSource, DynamicSource, FileSource, FixedPartitionedSource, KafkaSource, ParquetSource, RandomMetricSource, Retry,
    SimplePollingSource, StatefulSourcePartition, StatelessSourcePartition, batch, batch_async, batch_getter, batch_getter_ex,
)
from flowspark.testing import TestingSink, TestingSource, TimeTestingGetter, ffwd_iter, poll_next_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read(spark, source):
    flow, out = Flow("test", spark), []
    op.output("out", op.input("inp", flow, source), TestingSink(out))
    run_main(flow)
    return out


def test_text_files(spark, tmp_path):
    (tmp_path / "blank.txt").write_text("one\n\ntwo\n\n\nthree\nfour\n\nfive\n")
    assert read(spark, FileSource(tmp_path / "blank.txt")) == ["one", "", "two", "", "", "three", "four", "", "five"]
    folder = tmp_path / "dir"
    folder.mkdir()
    for k, n in enumerate(["one", "two"]):
        (folder / f"part-{k}.txt").write_text(f"{n}1\n{n}2\n")
    (folder / "other.log").write_text("no\n")
    assert sorted(read(spark, DirSource(folder, "*.txt"))) == ["one1", "one2", "two1", "two2"]
    with pytest.raises(ValueError, match="does not exist"):
        read(spark, DirSource(tmp_path / "none"))
    with pytest.raises(ValueError, match="not a directory"):
        read(spark, DirSource(tmp_path / "blank.txt"))


def test_csv_has_strings(spark, tmp_path):
    (tmp_path / "m.csv").write_text("index,timestamp,value\n0,2022-02-24 11:42:08,0.132\n1,2022-02-24 11:42:09,5\n")
    assert read(spark, CSVSource(tmp_path / "m.csv"))[0] == {"index": "0", "timestamp": "2022-02-24 11:42:08", "value": "0.132"}
    (tmp_path / "s.csv").write_text("a;b\n1;2\n")
    assert read(spark, CSVSource(tmp_path / "s.csv", {"sep": ";"})) == [{"a": "1", "b": "2"}]


def write(spark, items, schema, sink):
    flow = Flow("test", spark)
    op.output("out", op.input("inp", flow, TestingSource(items, schema)), sink)
    run_main(flow)


def test_file_sinks(spark, tmp_path):
    write(spark, ["a", "b"], "string", FileSink(str(tmp_path / "f")))
    assert sorted(read(spark, FileSource(tmp_path / "f"))) == ["a", "b"]
    write(spark, [{"key": str(k), "value": str(k)} for k in range(3)], "key string, value string", DirSink(str(tmp_path / "d"), 3, assign_file=int))
    for k in range(3):
        assert read(spark, FileSource(tmp_path / "d" / f"file=part_{k}")) == [str(k)]
    write(spark, [1, 2], "bigint", ParquetSink(str(tmp_path / "p")))
    assert sorted(read(spark, ParquetSource(str(tmp_path / "p")))) == [1, 2]
    with pytest.raises(TypeError, match="keyed"):
        write(spark, [1], "bigint", DirSink(str(tmp_path / "x"), 1))


def test_stdout(spark, capsys):
    write(spark, [1, 2], "bigint", StdOutSink())
    assert sorted(capsys.readouterr().out.split()) == ["1", "2"]


class Numbers(StatefulSourcePartition):
    def __init__(self, first, state):
        self.next = state or first

    def next_batch(self):
        if self.next % 10 >= 3:
            raise StopIteration
        self.next += 1
        return [self.next - 1]

    def snapshot(self):
        return self.next


class Tens(FixedPartitionedSource):
    schema = "bigint"

    def list_parts(self):
        return ["10", "20"]

    def build_part(self, step_id, for_part, resume_state):
        return Numbers(int(for_part), resume_state)


class Shares(DynamicSource):
    schema, workers = "string", 3

    def build(self, step_id, worker_index, worker_count):
        class Once(StatelessSourcePartition):
            def __init__(self):
                self.left = [f"{worker_index}/{worker_count}"]

            def next_batch(self):
                if not self.left:
                    raise StopIteration
                return [self.left.pop()]

        return Once()


def test_sources_in_python(spark):
    assert read(spark, Tens()) == [10, 11, 12, 20, 21, 22]
    assert read(spark, Shares()) == ["0/3", "1/3", "2/3"]
    assert [k for k, _ in read(spark, RandomMetricSource("cpu", count=2))] == ["cpu", "cpu"]
    assert poll_next_batch(Numbers(10, None)) == [10]


def test_sinks_in_python(spark, tmp_path):
    folder = str(tmp_path)

    class Part(StatefulSinkPartition):
        def __init__(self, name):
            self.name = name

        def write_batch(self, values):
            with open(f"{folder}/{self.name}", "a") as f:
                f.writelines(f"{v}\n" for v in values)

    class Parts(FixedPartitionedSink):
        def list_parts(self):
            return ["a", "b"]

        def part_fn(self, item_key):
            return int(item_key)

        def build_part(self, step_id, for_part, resume_state):
            return Part(for_part)

    write(spark, [{"key": str(k), "value": k} for k in range(4)], "key string, value bigint", Parts())
    assert [(tmp_path / n).read_text() for n in "ab"] == ["0\n2\n", "1\n3\n"]

    class Free(StatelessSinkPartition):
        def write_batch(self, items):
            if items:
                with open(f"{folder}/free", "a") as f:
                    f.writelines(f"{v}\n" for v in items)

    class Anywhere(DynamicSink):
        def build(self, step_id, worker_index, worker_count):
            return Free()

    write(spark, [1, 2], "bigint", Anywhere())
    assert sorted((tmp_path / "free").read_text().split()) == ["1", "2"]


def test_sentinels(spark):
    source = TestingSource([0, 1, TestingSource.EOF(), 2, TestingSource.ABORT(), 3], "bigint")
    assert read(spark, source) == [0, 1]
    with pytest.raises(AbortExecution):
        read(spark, source)
    assert read(spark, source) == [2, 3]
    assert read(spark, source) == []


def test_batch_helpers():
    assert list(batch(range(5), 2)) == [[0, 1], [2, 3], [4]]
    items = iter([1, 2, None, 3])
    got = batch_getter(lambda: next(items), 5)
    assert next(got) == [1, 2]
    assert next(got) == [3]  # what is held when the getter ends
    assert list(got) == []
    queue = [1, 2, 3]

    def pop():
        return queue.pop(0)

    got = batch_getter_ex(pop, 2, IndexError)
    assert [next(got), next(got), next(got)] == [[1, 2], [3], []]
    items = iter([1, 2, 3])
    assert list(batch_getter_ex(lambda: next(items), 2)) == [[1, 2], [3]]
    assert list(batch_getter(lambda: next(iter([])), 2)) == []

    async def slow():
        for k in range(5):
            await asyncio.sleep(0)
            yield k

    assert [x for xs in batch_async(slow(), timedelta(seconds=2), 2) for x in xs] == [0, 1, 2, 3, 4]
    it = iter(range(5))
    ffwd_iter(it, 3)
    assert next(it) == 3


def test_polling_alignment():
    class Poll(SimplePollingSource):
        def next_item(self):
            return "x"

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    now = TimeTestingGetter(start + timedelta(minutes=7))
    assert Poll(timedelta(minutes=10)).first_awake(now.get()) == now.get()
    assert Poll(timedelta(minutes=10), start).first_awake(now.get()) == start + timedelta(minutes=10)
    now.advance(timedelta(minutes=3))
    assert Poll(timedelta(minutes=10), start).first_awake(now.get()) == now.get()


class Counter(SimplePollingSource):
    schema = "bigint"

    def __init__(self):
        super().__init__(timedelta(milliseconds=1))
        self.n = 0

    def next_item(self):
        if self.n >= 3:
            raise Retry(timedelta(seconds=60))
        self.n += 1
        return self.n

    def snapshot(self):
        return self.n

    def resume(self, state):
        self.n = state


def test_polling_stream(spark):
    flow, out = Flow("poll", spark), []
    op.output("out", op.input("inp", flow, Counter()), TestingSink(out))
    run_main(flow, epoch_interval=timedelta(milliseconds=10), timeout=12)
    assert out == [1, 2, 3]


class LiveTens(Tens):
    stream = True


def test_parts_stream_and_go_on(spark, tmp_path):
    recovery, got = RecoveryConfig(str(tmp_path / "state")), []
    for _ in range(2):
        flow, out = Flow("parts", spark), []
        op.output("out", op.input("inp", flow, LiveTens()), TestingSink(out))
        run_main(flow, epoch_interval=timedelta(milliseconds=10), recovery_config=recovery, timeout=12)
        got.append(sorted(out))
    assert got == [[10, 11, 12, 20, 21, 22], []]


def streamed(spark, folder, schema="_arrival long, key string, value long, _sub long"):
    return spark.readStream.schema(schema).parquet(f"{folder}/*")


def test_keyed_state_survives_restarts(spark, tmp_path):
    """Running maxima over two runs with one checkpoint."""
    folder, recovery = str(tmp_path / "in"), RecoveryConfig(str(tmp_path / "state"))
    highest = lambda best, x: (max(best or x, x),) * 2
    got = []
    for k, rows in enumerate([[(0, "a", 4), (1, "b", 4)], [(2, "a", 1), (3, "b", 5)], [(4, "a", 8), (5, "b", 1)]]):
        spark.createDataFrame([(*r, 0) for r in rows], "_arrival long, key string, value long, _sub long").coalesce(1).write.parquet(f"{folder}/{k}")
        flow, out = Flow("max", spark), []
        up = op.input("inp", flow, streamed(spark, folder))
        op.output("out", op.stateful_map("max", up, highest, "bigint"), TestingSink(out))
        run_until_idle(flow, recovery_config=recovery)
        got.append(sorted(out))
    assert got == [[("a", 4), ("b", 4)], [("a", 4), ("b", 5)], [("a", 8), ("b", 5)]]


def test_streams_collect_after_a_pause_and_join(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(k, "a", k, 0) for k in range(5)], "_arrival long, key string, value long, _sub long").coalesce(1).write.parquet(f"{folder}/0")
    flow, out = Flow("collect", spark), []
    op.output("out", op.collect("c", op.input("inp", flow, streamed(spark, folder)), timedelta(milliseconds=300), 3), TestingSink(out))
    run_until_idle(flow, idle_epochs=8, epoch_interval=timedelta(milliseconds=200))
    assert sorted(out) == [("a", [0, 1, 2]), ("a", [3, 4])]
    flow, out = Flow("join", spark), []
    up = op.input("inp", flow, streamed(spark, folder))
    both = op.branch("odd", up, F.col("value") % 2 == 1)
    op.output("out", op.join("j", both.trues, both.falses, names=["l", "r"]), TestingSink(out))
    run_main(flow, available_now=True, timeout=60)
    assert sorted((v["l"], v["r"]) for _, v in out) == [(1, 0), (3, 2)]


def test_streams_window_by_key(spark, tmp_path):
    folder, base = str(tmp_path / "in"), datetime(2024, 1, 1)
    rows = [(k, key, base + timedelta(seconds=s), 0) for k, (key, s) in enumerate([("a", 1), ("b", 500), ("a", 4), ("a", 12), ("a", 2), ("a", 25)])]
    spark.createDataFrame(rows, "_arrival long, key string, ts timestamp, _sub long").coalesce(1).write.parquet(f"{folder}/0")
    flow, outs = Flow("win", spark), {"down": [], "late": [], "meta": []}
    up = op.input("inp", flow, streamed(spark, folder, "_arrival long, key string, ts timestamp, _sub long"))
    now = TimeTestingGetter(datetime(2024, 6, 1, tzinfo=timezone.utc))
    got = op.count_window("c", up, op.EventClock("ts", timedelta(0), now.get), op.TumblingWindower(timedelta(seconds=10), base), F.col("key"))
    for n, out in outs.items():
        op.output(n, getattr(got, n), TestingSink(out))
    run_until_idle(flow, idle_epochs=2)
    assert sorted((k, v["window_id"], v["value"]) for k, v in outs["down"]) == [("a", 0, 2), ("a", 1, 1)]
    assert [(k, v["window_id"]) for k, v in outs["late"]] == [("a", 0)]
    assert sorted((k, v["window_id"]) for k, v in outs["meta"]) == [("a", 0), ("a", 1)]


def test_streams_collect_dicts(spark, tmp_path):
    folder, base = str(tmp_path / "in"), datetime(2024, 1, 1)
    schema = "_arrival long, key string, k string, ts timestamp, _sub long"
    rows = [(n, "a", k, base + timedelta(seconds=s), 0) for n, (k, s) in enumerate([("x", 1), ("y", 5), ("x", 4), ("x", 25)])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/0")
    flow, out = Flow("dicts", spark), []
    now = TimeTestingGetter(datetime(2024, 6, 1, tzinfo=timezone.utc))
    clock = op.EventClock("ts", timedelta(seconds=10), now.get)
    got = op.collect_window("c", op.input("inp", flow, streamed(spark, folder, schema)), clock, op.TumblingWindower(timedelta(seconds=10), base), into=dict)
    op.output("out", got.down, TestingSink(out))
    run_until_idle(flow, idle_epochs=2)
    assert [{k: t.second for k, t in v["value"].items()} for _, v in out] == [{"x": 4, "y": 5}]


def test_streams_window_by_one_watermark(spark, tmp_path):
    folder, base = str(tmp_path / "in"), datetime(2024, 1, 1)
    schema = "_arrival long, key string, ts timestamp, _sub long"
    flow, out = Flow("shared", spark), []
    for k, seconds in enumerate([(1, 4, 12), (25,), (60,)]):
        spark.createDataFrame([(s, "a", base + timedelta(seconds=s), 0) for s in seconds], schema).coalesce(1).write.parquet(f"{folder}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    up = op.input("inp", flow, stream)
    clock = op.EventClock("ts", timedelta(0), per_key=False)
    got = op.count_window("c", up, clock, op.SlidingWindower(timedelta(seconds=10), timedelta(seconds=10), base), F.col("key"))
    op.output("out", got.down, TestingSink(out))
    run_main(flow, available_now=True, timeout=60)
    assert sorted((v["window_id"], v["value"]) for _, v in out)[:2] == [(0, 2), (1, 1)]
    assert got.late is None  # the engine drops such rows
    with pytest.raises(TypeError, match="per_key=False"):
        op.fold_window("f", up, op.EventClock("ts"), op.SessionWindower(timedelta(seconds=1)), agg=F.count("*"))


def test_failures_stop_the_flow(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(0, "a", 1, 0)], "_arrival long, key string, value long, _sub long").write.parquet(f"{folder}/0")
    flow = Flow("bad", spark)
    op.raises("never", op.input("inp", flow, streamed(spark, folder)))
    with pytest.raises(FlowError):
        run_main(flow, available_now=True, timeout=60)


def test_kafka_plumbing(spark):
    assert KafkaSource(["a:1", "b:2"], ["t"], batch_size=10, add_config={"x": "y"}).options() == {
        "kafka.bootstrap.servers": "a:1,b:2", "subscribe": "t", "startingOffsets": "earliest", "includeHeaders": "true", "kafka.x": "y", "maxOffsetsPerTrigger": "10",
    }
    flow, oks, errs = Flow("kafka", spark), [], []
    rows = [{"key": b"k", "value": b'{"a": 1}'}, {"key": b"k", "value": b"no"}, {"key": None, "value": None}]
    up = op.input("inp", flow, TestingSource(rows, "key binary, value binary"))
    got = kafka.deserialize_value("json", up, kafka.json_deserializer("a int"))
    op.output("oks", got.oks, TestingSink(oks))
    op.output("errs", got.errs, TestingSink(errs))
    back = kafka.serialize_value("back", got.oks, kafka.json_serializer())
    op.output("bytes", back, TestingSink(made := []))
    run_main(flow)
    assert [v for _, v in oks] == [{"a": 1}, None]
    assert [v["value"] for _, v in errs] == [b"no"]
    assert [v for _, v in made] == [b'{"a":1}', None]
    with pytest.raises(ValueError, match="topic"):
        KafkaSink(["a:1"]).rows(up.df)
    assert KafkaSink(["a:1"], "t").rows(up.df).columns == ["key", "value", "topic"]


def test_import_strings(spark, tmp_path, monkeypatch):
    assert locate("a.b:c") == ("a.b", "c")
    assert locate("dir/mod.py") == ("dir.mod", "flow")
    (tmp_path / "flows_for_test.py").write_text("from flowspark import Flow\nflow = Flow('here')\ndef make(name, n=1):\n    return Flow(name)\nnumber = 5\n")
    monkeypatch.chdir(tmp_path)
    assert load("flows_for_test").flow_id == "here"
    assert load("flows_for_test:make('made', n=2)").flow_id == "made"
    with pytest.raises(TypeError):
        load("flows_for_test:number")
    with pytest.raises(ValueError, match="literals"):
        load("flows_for_test:make(number)")
    with pytest.raises(ValueError, match="name nor a call"):
        load("flows_for_test:1 +")


def test_progress_is_counted(spark, tmp_path):
    import time

    from flowspark.metrics import setup_tracing

    progress = setup_tracing(spark)
    try:
        folder = str(tmp_path / "in")
        spark.createDataFrame([(0, "a", 1, 0)], "_arrival long, key string, value long, _sub long").write.parquet(f"{folder}/0")
        flow = Flow("counted", spark)
        op.output("out", op.input("inp", flow, streamed(spark, folder)), TestingSink([]))
        run_main(flow, available_now=True, timeout=60)
        for _ in range(100):
            if progress.counts["counted.out"]["item_inp_count"]:
                break
            time.sleep(0.1)
        assert progress.counts["counted.out"]["item_inp_count"] == 1
    finally:
        spark.streams.removeListener(progress)


def test_random_metrics_come_at_their_interval(spark):
    source = RandomMetricSource("cpu", interval=timedelta(seconds=60), next_random=lambda: 1.5)
    query = source.read(spark).writeStream.format("memory").queryName("metrics").trigger(processingTime="0.2 seconds").start()
    try:
        time.sleep(6)
    finally:
        query.stop()
    assert [tuple(r) for r in spark.table("metrics").collect()] == [("cpu", 1.5)]


def test_sinks_get_batches_and_resume(spark, tmp_path, monkeypatch):
    from flowspark import sinks

    monkeypatch.setattr(sinks, "BATCH_ROWS", 4)
    log = str(tmp_path / "log")

    class Part(StatefulSinkPartition):
        def __init__(self, name, state):
            self.name, self.n = name, state or 0

        def write_batch(self, values):
            self.n += len(values)
            with open(log, "a") as f:
                f.write(f"{self.name} {len(values)} {self.n}\n")

        def snapshot(self):
            return self.n

    class Counted(FixedPartitionedSink):
        def __init__(self, state_dir):
            self.state_dir = state_dir

        def list_parts(self):
            return ["only"]

        def build_part(self, step_id, for_part, resume_state):
            return Part(for_part, resume_state)

    flow = Flow("sink", spark)
    up = flow.stream("s", spark.createDataFrame([("k", n, n, 0) for n in range(10)], "key string, value long, _arrival long, _sub long").coalesce(1))
    Counted(None).write(up, up.df, None)
    for _ in range(2):  # the second time the epoch comes again, from the same state
        Counted(str(tmp_path / "states")).write(up, up.df, 0)
    Counted(str(tmp_path / "states")).write(up, up.df, 1)
    lines = [x.split()[1:] for x in open(log).read().splitlines()]
    assert all(int(n) <= 4 for n, _ in lines)
    assert [int(total) for _, total in lines if int(total) % 10 == 0] == [10, 10, 10, 20]


def test_order_of_arrival_has_bounds(spark):
    from flowspark.stream import SUB_BITS, sub_column, sub_place

    assert sub_place(3, 5) == (3 << SUB_BITS) + 5
    for sub, place in ((0, 1 << SUB_BITS), (1 << 43, 0)):
        with pytest.raises(OverflowError):
            sub_place(sub, place)
        with pytest.raises(Exception, match="order of arrival"):
            spark.range(1).select(sub_column(F.lit(sub).cast("long"), F.lit(place).cast("long"))).collect()
