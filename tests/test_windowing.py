"""Windows: golden vectors, and the closed forms against the state machine on random rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import flowspark.operators as op
from flowspark import Flow, functions, run_main
from flowspark.functions import FOREVER
from flowspark.streaming.logic import UTC_MAX, UTC_MIN, EventClockLogic, FoldLogic, SessionLogic, SlidingLogic, WindowDriver, drive
from flowspark.testing import TestingSink, TestingSource, TimeTestingGetter

BASE = datetime(2022, 1, 1, tzinfo=timezone.utc)
SEC = timedelta(seconds=1)
SCHEMA = "key string, ts timestamp, v string"


def rows_at(*items, key="ALL"):
    return [{"key": key, "ts": BASE + s * SEC, "v": str(v)} for s, v in items]


def run(spark, build, rows, schema=SCHEMA):
    flow = Flow("test", spark)
    got = build(op.input("inp", flow, TestingSource(rows, schema)))
    outs = {n: [] for n in ("down", "late", "meta")}
    for n, out in outs.items():
        op.output(n, getattr(got, n), TestingSink(out))
    run_main(flow)
    return outs


def lists(spark, windower, wait, rows, ordered=True):
    fold = lambda s: op.fold_window("f", s, op.EventClock("ts", wait), windower, list, lambda a, x: [*a, x["v"]], lambda a, b: a + b, "array<string>", ordered)
    outs = run(spark, fold, rows)
    down = sorted((k, v["window_id"], v["value"]) for k, v in outs["down"])
    return down, sorted((k, v["window_id"], v["v"]) for k, v in outs["late"]), outs["meta"]


def test_tumbling_counts(spark):
    rows = rows_at((0, "login"), (4, "post"), (8, "post"), (16, "post"))
    down, late, _ = lists(spark, op.TumblingWindower(10 * SEC, BASE), timedelta(0), rows)
    assert down == [("ALL", 0, ["login", "post", "post"]), ("ALL", 1, ["post"])]
    assert late == []


def test_sessions_and_late_rows(spark):
    rows = rows_at((1, "a"), (5, "b"), (11, "c"), (12, "d"), (13, "e"), (14, "f"), (20, "g"), (1, "h"))
    down, late, meta = lists(spark, op.SessionWindower(5 * SEC), timedelta(0), rows)
    assert down == [("ALL", 0, ["a", "b"]), ("ALL", 1, ["c", "d", "e", "f"]), ("ALL", 2, ["g"])]
    assert late == [("ALL", -1, "h")]
    spans = sorted((v["window_id"], v["open_time"].replace(tzinfo=timezone.utc) - BASE, v["close_time"].replace(tzinfo=timezone.utc) - BASE, v["merged_ids"]) for _, v in meta)
    assert spans == [(0, SEC, 5 * SEC, []), (1, 11 * SEC, 14 * SEC, []), (2, 20 * SEC, 20 * SEC, [])]


def test_sliding_with_negative_ids(spark):
    rows = rows_at((1, "a"), (4, "b"), (8, "c"), (12, "d"), (13, "e"), (14, "f"), (16, "g"), (1, "h"))
    down, late, _ = lists(spark, op.SlidingWindower(10 * SEC, 5 * SEC, BASE), timedelta(0), rows)
    assert down == [("ALL", -1, ["a", "b"]), ("ALL", 0, ["a", "b", "c"]), ("ALL", 1, ["c", "d", "e", "f"]), ("ALL", 2, ["d", "e", "f", "g"]), ("ALL", 3, ["g"])]
    assert late == [("ALL", -1, "h"), ("ALL", 0, "h")]


def test_collect_window(spark):
    rows = rows_at((0, 1), (8, 3), (4, 2), (13, 5), (12, 4))
    clock, windower = op.EventClock("ts", FOREVER), op.TumblingWindower(10 * SEC, BASE)
    got = run(spark, lambda s: op.collect_window("c", op.map_value("m", s, {"v": F.col("v"), "ts": F.col("ts")}), clock, windower), rows)
    assert sorted((v["window_id"], [x["v"] for x in v["value"]]) for _, v in got["down"]) == [(0, ["1", "2", "3"]), (1, ["4", "5"])]
    pairs = [{"key": "a", "ts": BASE + s * SEC, "v": v} for s, v in ((0, "x"), (1, "x"), (2, "y"))]
    got = run(spark, lambda s: op.collect_window("c", op.map_value("m", s, {"ts": F.col("ts"), "v": F.col("v")}), clock, windower, set), pairs)
    assert len(got["down"][0][1]["value"]) == 3
    timed = "key string, v string, ts timestamp"
    got = run(spark, lambda s: op.collect_window("c", s, clock, windower, dict), pairs, timed)
    assert set(got["down"][0][1]["value"]) == {"x", "y"}
    with pytest.raises(TypeError, match="list, a set or a dict"):
        run(spark, lambda s: op.collect_window("c", s, clock, windower, tuple), pairs)


def test_collect_equal_values_into_a_set(spark):
    clock, windower = op.EventClock("ts", FOREVER), op.TumblingWindower(timedelta(days=1), BASE)
    rows = [{"key": "a", "ts": BASE + k % 3000 * SEC, "v": str(k % 2)} for k in range(6000)]
    got = run(spark, lambda s: op.collect_window("c", op.map_value("m", s, {"ts": F.col("ts"), "v": F.col("v")}), clock, windower, set), rows)
    ((_, out),) = got["down"]
    assert [(x["ts"].replace(tzinfo=timezone.utc), x["v"]) for x in out["value"]] == [(BASE + k * SEC, str(k % 2)) for k in range(3000)]
    rows = [{"key": "a", "ts": BASE, "v": v} for v in ("0.0", "-0.0", "NaN", "1.5", "NaN", "1.5")]
    got = run(spark, lambda s: op.collect_window("c", op.map_value("m", s, {"n": F.col("v").cast("double"), "ts": F.col("ts")}), clock, windower, set), rows)
    assert [str(abs(x["n"])) for x in got["down"][0][1]["value"]] == ["0.0", "1.5", "nan"]


def test_count_reduce_max_min_window(spark):
    rows = [{"key": k, "ts": BASE + s * SEC, "n": n} for k, s, n in (("a", 0, 1), ("a", 4, 9), ("b", 8, 3), ("a", 12, 10), ("a", 13, 4))]
    schema, clock, windower = "key string, ts timestamp, n bigint", op.EventClock("ts"), op.TumblingWindower(10 * SEC, BASE)
    got = run(spark, lambda s: op.count_window("c", s, clock, windower, F.col("key")), rows, schema)["down"]
    assert sorted((k, v["window_id"], v["value"]) for k, v in got) == [("a", 0, 2), ("a", 1, 2), ("b", 0, 1)]
    for native in (True, False):
        by = F.col("n") if native else lambda x: x["n"]
        got = run(spark, lambda s, by=by: op.max_window("m", s, clock, windower, by), rows, schema)["down"]
        assert sorted((k, v["window_id"], v["n"]) for k, v in got) == [("a", 0, 9), ("a", 1, 10), ("b", 0, 3)]
        got = run(spark, lambda s, by=by: op.min_window("m", s, clock, windower, by), rows, schema)["down"]
        assert sorted((k, v["window_id"], v["n"]) for k, v in got) == [("a", 0, 1), ("a", 1, 4), ("b", 0, 3)]
    got = run(spark, lambda s: op.reduce_window("r", s, clock, windower, F.sum("n")), rows, schema)["down"]
    assert sorted((k, v["window_id"], v["value"]) for k, v in got) == [("a", 0, 10), ("a", 1, 14), ("b", 0, 3)]
    add = lambda a, b: {**a, "n": a["n"] + b["n"]}
    got = run(spark, lambda s: op.reduce_window("r", s, clock, windower, add), rows, schema)["down"]
    assert sorted((k, v["window_id"], v["n"]) for k, v in got) == [("a", 0, 10), ("a", 1, 14), ("b", 0, 3)]


# offset, time in seconds, ids of windows of 10 s
SLIDES = [
    (5, 13, [1, 2]), (5, -3, [-2, -1]), (5, 3, [-1, 0]), (5, 7, [0, 1]), (5, 15, [2, 3]), (5, -5, [-2, -1]), (5, 0, [-1, 0]), (5, 10, [1, 2]),
    (3, 11, [1, 2, 3]), (3, 11.5, [1, 2, 3]), (3, -1, [-3, -2, -1]), (3, -1.5, [-3, -2, -1]), (3, 5, [-1, 0, 1]),
    (7, 14, [1, 2]), (7, -7, [-2, -1]), (7, 0, [-1, 0]), (7, 17, [2]), (7, -4, [-1]), (7, 10, [1]),
    (10, 15, [1]), (10, -5, [-1]), (10, 5, [0]), (10, 20, [2]), (10, -10, [-1]), (10, 0, [0]), (10, 10, [1]),
]


def test_sliding_ids(spark):
    for offset in (3, 5, 7, 10):
        own = [(t, ids) for o, t, ids in SLIDES if o == offset]
        windower = op.SlidingWindower(10 * SEC, offset * SEC, BASE)
        df = spark.createDataFrame([(BASE + t * SEC,) for t, _ in own], "ts timestamp").withColumn("_ts", F.unix_micros("ts"))
        got = windower.assign(df).groupBy("ts").agg(F.sort_array(F.collect_list("window_id")).alias("ids")).collect()
        assert {r.ts.replace(tzinfo=timezone.utc): r.ids for r in got} == {BASE + t * SEC: ids for t, ids in own}
        logic = SlidingLogic(10 * SEC, offset * SEC, BASE)
        assert [logic.ids(BASE + t * SEC) for t, _ in own] == [ids for _, ids in own]


def test_windowers_check_their_parameters():
    with pytest.raises(ValueError, match="gaps"):
        op.SlidingWindower(SEC, 2 * SEC, BASE)
    with pytest.raises(ValueError, match="negative"):
        op.SessionWindower(-SEC)


def test_event_clock():
    now = TimeTestingGetter(BASE)
    at = lambda s: BASE + s * SEC
    make = lambda wait=5 * SEC: EventClockLogic(wait, now.get)
    assert make().watermark() == UTC_MIN
    clock = make()
    assert clock.observe(at(7), now.get()) == at(2)
    now.advance(2 * SEC)
    assert clock.watermark() == at(4)
    assert clock.observe(at(8), now.get()) == at(4)  # 3 would go back
    clock = make()
    clock.observe(at(7), now.get())
    assert clock.observe(at(10), now.get()) == at(5)
    assert clock.observe(at(3), now.get()) == at(5)
    clock = make(FOREVER)
    clock.observe(at(7), now.get())
    now.advance(2 * SEC)
    assert clock.observe(at(10), now.get()) == UTC_MIN + 2 * SEC


def test_event_clock_stays_when_the_system_clock_steps_back():
    now = TimeTestingGetter(BASE)
    clock = EventClockLogic(5 * SEC, now.get)
    clock.observe(BASE + 7 * SEC, now.get())
    now.advance(4 * SEC)
    reached = clock.watermark()
    now.advance(-3 * SEC)
    assert clock.watermark() == reached
    assert clock.observe(BASE, now.get()) == reached
    now.advance(10 * SEC)
    assert clock.watermark() > reached
    timed = EventClockLogic(5 * SEC, now.get, lambda ts: None if ts > BASE + 60 * SEC else ts + 9 * SEC)
    assert timed.system_time(BASE, now.get()) == BASE + 9 * SEC
    assert timed.system_time(BASE + 61 * SEC, now.get()) == UTC_MAX


def test_sessions_merge():
    at = lambda s: BASE + s * SEC
    logic = SessionLogic(10 * SEC)
    assert [logic.open_for(at(s)) for s in (0, 10, 20)] == [[0], [0], [0]]
    logic = SessionLogic(10 * SEC)
    assert [logic.open_for(at(s)) for s in (0, 20)] == [[0], [1]]
    assert (logic.open_for(at(10)), logic.merged()) == ([0], [(1, 0)])
    logic = SessionLogic(10 * SEC)
    for s in (0, 20, 25, 40):
        logic.open_for(at(s))
    assert len(logic.open) == 3
    logic.open_for(at(32))
    assert logic.merged() == [(2, 1)]
    assert logic.close_for(at(10)) == []
    assert [i for i, _ in logic.close_for(at(10) + timedelta(microseconds=1))] == [0]


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
@pytest.mark.parametrize("wait", [0, 4, None])
@pytest.mark.parametrize("slices", [False, True])
def test_closed_forms_equal_the_state_machine(spark, monkeypatch, kind, wait, slices):
    if slices:  # keys cut into many pieces
        monkeypatch.setattr(functions, "ARRIVAL_SLICE_BITS", 4)
        monkeypatch.setattr(functions, "TIME_SLICE_BITS", 22)
    draw = random.Random(f"{kind}{wait}")
    rows = [{"key": f"k{draw.randrange(5)}", "ts": BASE + draw.randrange(60) * SEC, "v": str(n)} for n in range(120)]
    windower = {"tumbling": op.TumblingWindower(10 * SEC, BASE), "sliding": op.SlidingWindower(10 * SEC, 4 * SEC, BASE), "session": op.SessionWindower(3 * SEC)}[kind]
    span = FOREVER if wait is None else wait * SEC
    down, late, _ = lists(spark, windower, span, rows)
    want_down, want_late = [], []
    for key in {r["key"] for r in rows}:
        own = [(r["ts"], r["v"]) for r in rows if r["key"] == key]
        build = lambda state: WindowDriver(EventClockLogic(span, lambda: BASE), windower.logic(), lambda s: FoldLogic(lambda a, x: [*a, x], None, list(s or [])), True, state)
        state = None
        machine = build(None)  # one machine to the end: a key that is forgotten would forget its watermark
        made = [x for value in own for x in machine.on_batch([value])[0]] + list(machine.on_eof()[0])
        del state
        want_down += [(key, i, x) for tag, i, x in made if tag == "E"]
        want_late += [(key, i, x) for tag, i, x in made if tag == "L"]
    assert down == sorted(want_down)
    assert late == sorted(want_late)


def test_driver_goes_on_from_a_snapshot():
    make = lambda state=None: WindowDriver(EventClockLogic(timedelta(0), lambda: BASE), SlidingLogic(10 * SEC, 10 * SEC, BASE), lambda s: FoldLogic(lambda a, x: [*a, x], None, list(s or [])), True, state)
    first = make()
    first.on_batch([(BASE + SEC, "a")])
    second = make(first.snapshot())
    made, _ = second.on_batch([(BASE + 2 * SEC, "b"), (BASE + 11 * SEC, "c")])
    assert ("E", 0, ["a", "b"]) in made
    assert list(drive(make, [(BASE, "x")]))[0][1] == ("E", 0, ["x"])
