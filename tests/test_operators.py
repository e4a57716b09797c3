"""Operators, one small flow each; expected rows compare as bags unless order is inside a value."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import flowspark.operators as op
from flowspark import Flow, functions, operator, run_main
from flowspark.operators.helpers import map_dict_value, map_field
from flowspark.testing import TestingSink, TestingSource

KV = "key string, value bigint"


def keyed(values, key="ALL"):
    return [{"key": key, "value": v} for v in values]


@pytest.fixture
def go(spark):
    def run(build, items, schema):
        flow, out = Flow("test", spark), []
        op.output("out", build(op.input("inp", flow, TestingSource(list(items), schema))), TestingSink(out))
        run_main(flow)
        return out

    return run


def test_map_takes_columns_and_callables(go):
    assert go(lambda s: op.map("m", s, F.col("value") + 1), range(3), "bigint") == [1, 2, 3]
    assert go(lambda s: op.map("m", s, lambda x: x + 1, "bigint"), range(3), "bigint") == [1, 2, 3]


def test_map_value_keeps_the_key(go):
    assert go(lambda s: op.map_value("m", s, lambda x: f"<{x}>", "string"), keyed([1, 2], "a"), KV) == [("a", "<1>"), ("a", "<2>")]
    with pytest.raises(TypeError, match="keyed"):
        go(lambda s: op.map_value("m", s, F.lit(1)), [1], "bigint")


@pytest.mark.parametrize("mapper", [lambda x: list(range(x)), None])
def test_flat_map_keeps_order_of_arrival(go, mapper):
    native = F.when(F.col("value") > 0, F.sequence(F.lit(0), F.col("value") - 1)).otherwise(F.array().cast("array<bigint>"))
    assert go(lambda s: op.flat_map("f", s, mapper or native, "bigint"), [2, 0, 3], "bigint") == [0, 1, 0, 1, 2]


def test_flat_map_value(go):
    assert go(lambda s: op.flat_map_value("f", s, lambda x: [x, -x], "bigint"), keyed([1], "a"), KV) == [("a", 1), ("a", -1)]


def test_flat_map_batch(go):
    assert sorted(go(lambda s: op.flat_map_batch("f", s, lambda xs: (x * 2 for x in xs), "bigint"), range(4), "bigint")) == [0, 2, 4, 6]
    with pytest.raises(Exception, match="iterable"):
        go(lambda s: op.flat_map_batch("f", s, lambda xs: 5, "bigint"), [1], "bigint")


def test_flatten(go):
    assert go(lambda s: op.flatten("f", s), [[1, 2], [], [3]], "array<bigint>") == [1, 2, 3]
    with pytest.raises(TypeError, match="arrays"):
        go(lambda s: op.flatten("f", s), [1], "bigint")


def test_filter_and_branch_want_booleans(go, spark):
    assert go(lambda s: op.filter("f", s, lambda x: x % 2 == 0), range(5), "bigint") == [0, 2, 4]
    assert go(lambda s: op.filter("f", s, F.col("value") > 2), range(5), "bigint") == [3, 4]
    with pytest.raises(Exception, match="bool"):
        go(lambda s: op.filter("f", s, lambda x: x), [1], "bigint")
    with pytest.raises(TypeError, match="boolean"):
        go(lambda s: op.filter("f", s, F.col("value")), [1], "bigint")
    with pytest.raises(Exception, match="null"):
        go(lambda s: op.branch("b", s, F.col("value") > 1, strict=True).falses, [1, None], "bigint")
    assert go(lambda s: op.branch("b", s, F.col("value") > 1).falses, [1, 2, None], "bigint") == [1, None]
    for predicate in (F.col("value") % 2 == 0, lambda x: x % 2 == 0):
        assert go(lambda s, p=predicate: op.branch("b", s, p).trues, range(5), "bigint") == [0, 2, 4]
        assert go(lambda s, p=predicate: op.branch("b", s, p).falses, range(5), "bigint") == [1, 3]


def test_filter_value(go):
    assert go(lambda s: op.filter_value("f", s, lambda x: x > 1), keyed([1, 2]), KV) == [("ALL", 2)]


def test_filter_map_drops_null_only(go):
    assert go(lambda s: op.filter_map("f", s, lambda x: None if x % 2 else x + 1, "bigint"), range(6), "bigint") == [1, 3, 5]
    assert go(lambda s: op.filter_map("f", s, F.when(F.col("value") % 2 == 0, F.col("value"))), range(3), "bigint") == [0, 2]
    assert go(lambda s: op.filter_map_value("f", s, lambda x: x or None, "bigint"), keyed([0, 2]), KV) == [("ALL", 2)]


def test_key_on_and_key_rm(go):
    assert go(lambda s: op.key_on("k", s, lambda x: str(x % 2)), range(2), "bigint") == [("0", 0), ("1", 1)]
    assert go(lambda s: op.key_rm("r", op.key_on("k", s, F.col("value").cast("string"))), range(2), "bigint") == [0, 1]
    with pytest.raises(TypeError, match="string"):
        go(lambda s: op.key_on("k", s, F.col("value")), [1], "bigint")
    with pytest.raises(Exception, match="str"):
        go(lambda s: op.key_on("k", s, lambda x: x), [1], "bigint")


def test_merge_and_redistribute(spark):
    flow, out = Flow("test", spark), []
    a, b = (op.input(n, flow, TestingSource(x, "bigint")) for n, x in (("a", [1, 2]), ("b", [3])))
    op.output("out", op.redistribute("r", op.merge("m", a, b)), TestingSink(out))
    run_main(flow)
    assert sorted(out) == [1, 2, 3]
    with pytest.raises(TypeError):
        op.merge("none")


def test_inspect_passes_rows_on(go, tmp_path):
    log = tmp_path / "log"

    def note(step_id, item):
        with log.open("a") as f:
            f.write(f"{step_id} {item}\n")

    assert go(lambda s: op.inspect("look", s, note), [1, 2], "bigint") == [1, 2]
    assert sorted(log.read_text().split("\n")[:-1]) == ["look 1", "look 2"]


def test_raises(spark):
    flow = Flow("test", spark)
    op.raises("no", op.input("inp", flow, TestingSource([1], "bigint")))
    with pytest.raises(RuntimeError, match="'no' got"):
        run_main(flow)


def test_enrich_cached(go, spark):
    known = {"a": 1, "b": 2}
    assert go(lambda s: op.enrich_cached("e", s, known.get, lambda cache, x: cache.get(x), schema="bigint"), ["a", "b", "a"], "string") == [1, 2, 1]
    lookup = spark.createDataFrame(list(known.items()), "value string, n bigint")
    assert go(lambda s: op.enrich_cached("e", s, lookup, F.col("n"), on="value"), ["a", "c"], "string") == [1, None]


def test_ttl_cache_expires_after_its_time():
    now, calls = [datetime(2024, 1, 1, tzinfo=timezone.utc)], []
    cache = op.TTLCache(lambda k: calls.append(k) or len(calls), lambda: now[0], timedelta(seconds=5))
    assert [cache.get("x"), cache.get("x")] == [1, 1]
    now[0] += timedelta(seconds=5)
    assert cache.get("x") == 1
    now[0] += timedelta(seconds=1)
    assert cache.get("x") == 2


def test_count_final(go):
    assert sorted(go(lambda s: op.count_final("c", s, lambda x: x), list("aabcba"), "string")) == [("a", 3), ("b", 2), ("c", 1)]


def test_fold_and_reduce_final(go):
    xs = keyed([1, 4, 2, 9, 4, 3])
    assert go(lambda s: op.fold_final("f", s, lambda: 0, max, "bigint"), xs, KV) == [("ALL", 9)]
    assert go(lambda s: op.fold_final("f", s, agg=F.max("value")), xs, KV) == [("ALL", 9)]
    assert go(lambda s: op.reduce_final("r", s, max), xs, KV) == [("ALL", 9)]
    assert go(lambda s: op.fold_final("f", s, list, lambda a, x: [*a, x], "array<bigint>"), keyed([3, 1, 2]), KV) == [("ALL", [3, 1, 2])]


@pytest.mark.parametrize("native", [True, False])
def test_max_and_min_final_take_the_first_of_equals(go, native):
    by = F.col("val") if native else lambda x: x["val"]
    rows = [{"key": "a", "val": v, "n": n} for n, v in enumerate([1, 9, 9, 1])]
    assert go(lambda s: op.max_final("m", s, by), rows, "key string, val bigint, n bigint") == [("a", {"val": 9, "n": 1})]
    assert go(lambda s: op.min_final("m", s, by), rows, "key string, val bigint, n bigint") == [("a", {"val": 1, "n": 0})]


@pytest.mark.parametrize("bits", [1, 20])
def test_collect(go, monkeypatch, bits):
    monkeypatch.setattr(functions, "ARRIVAL_SLICE_BITS", bits)  # 1: the key is cut into five
    assert go(lambda s: op.collect("c", s, timedelta(seconds=10), 3), keyed(range(10)), KV) == [("ALL", x) for x in ([0, 1, 2], [3, 4, 5], [6, 7, 8], [9])]


def test_stateful_flat_map(go):
    def climb(last, x):
        return x, ([x] if last is None or x > last else [])

    assert go(lambda s: op.stateful_flat_map("s", s, climb, "bigint"), keyed([2, 5, 8, 1, 3]), KV) == [("ALL", x) for x in (2, 5, 8, 3)]


def test_stateful_map(go):
    def mean(seen, x):
        seen = [*(seen or []), x]
        out = sum(seen) / len(seen)
        return (seen[:-3] if len(seen) > 3 else seen), out

    assert go(lambda s: op.stateful_map("s", s, mean, "double"), keyed([2, 5, 8, 1, 3]), KV) == [("ALL", x) for x in (2.0, 3.5, 5.0, 4.0, 2.5)]
    assert go(lambda s: op.stateful_map("s", s, over=lambda w: F.sum("value").over(w)), keyed([1, 2, 3]), KV) == [("ALL", x) for x in (1, 3, 6)]
    with pytest.raises(Exception, match="pair"):
        go(lambda s: op.stateful_map("s", s, lambda st, x: x, "bigint"), keyed([1]), KV)


def test_stateful_discards_and_ends(go):
    class Pairs(op.StatefulLogic):
        def __init__(self, state):
            self.held = state or []

        def on_item(self, value):
            self.held.append(value)
            return ([self.held], self.DISCARD) if len(self.held) == 2 else ((), self.RETAIN)

        def on_eof(self):
            return [self.held], self.DISCARD

        def snapshot(self):
            return self.held

    rows = keyed([1, 2, 3], "a") + keyed([4], "b")
    assert sorted(go(lambda s: op.stateful("s", s, Pairs, "array<bigint>"), rows, KV)) == [("a", [1, 2]), ("a", [3]), ("b", [4])]


def test_helpers():
    assert map_dict_value("a", lambda x: x + 1)({"a": 1, "b": 2}) == {"a": 2, "b": 2}


def test_map_field(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', 2) AS s")
    assert df.select(map_field("s", "a", lambda c: c + 1).alias("s")).first()["s"].asDict() == {"a": 2, "b": 2}


def test_step_ids_are_checked(spark):
    flow = Flow("test", spark)
    up = op.input("inp", flow, TestingSource([1], "bigint"))
    op.map("m", up, F.lit(1))
    with pytest.raises(ValueError, match="taken"):
        op.map("m", up, F.lit(1))
    with pytest.raises(ValueError, match="period"):
        op.map("a.b", up, F.lit(1))
    with pytest.raises(TypeError, match="step id"):
        op.map(up, up, F.lit(1))
    with pytest.raises(ValueError, match="period"):
        Flow("a.b")
    with pytest.raises(ValueError, match="different flows"):
        op.merge("x", up, op.input("i", Flow("other", spark), TestingSource([1], "bigint")))


def test_own_operators_nest(spark):
    @operator
    def double(step_id, up):
        return op.map("twice", op.map("same", up, F.col("value")), F.col("value") * 2)

    flow, out = Flow("test", spark), []
    s = op.input("inp", flow, TestingSource([1, 2], "bigint")).then(double, "d").then(op.map, "m", F.col("value") + 1)
    op.output("out", s, TestingSink(out))
    run_main(flow)
    assert out == [3, 5]
    assert [s.step_id for s in flow.steps[1].substeps] == ["test.d.same", "test.d.twice"]
    with pytest.raises(TypeError, match="step_id"):
        operator(lambda up: up)


def test_flows_need_inputs_and_outputs(spark):
    with pytest.raises(ValueError, match="input"):
        run_main(Flow("test", spark))
    flow = Flow("test", spark)
    op.input("inp", flow, TestingSource([1], "bigint"))
    with pytest.raises(ValueError, match="output"):
        run_main(flow)
