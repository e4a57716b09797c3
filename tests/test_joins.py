"""Joins in all modes, against the nine small cases and a restated state machine on random rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest

import flowspark.operators as op
from flowspark import Flow, functions, run_main
from flowspark.streaming.logic import Itemwise, JoinLogic, JoinState, drive
from flowspark.testing import TestingSink, TestingSource

KV = "key string, value bigint, at bigint"


def joined(spark, sides, insert_mode, emit_mode):
    """sides: lists of (key, value, arrival)."""
    from pyspark.sql import functions as F

    flow, out = Flow("test", spark), []
    ups = []
    for k, rows in enumerate(sides):
        up = op.input(f"i{k}", flow, TestingSource([{"key": a, "value": b, "at": c} for a, b, c in rows], KV))
        ups.append(up.with_df(up.df.withColumn("_arrival", F.col("at")).drop("at")))
    op.output("out", op.join("join", *ups, insert_mode=insert_mode, emit_mode=emit_mode), TestingSink(out))
    run_main(flow)
    return [(k, *v.values()) if isinstance(v, dict) else (k, v) for k, v in out]


@pytest.mark.parametrize(
    ("left", "right", "insert_mode", "emit_mode", "want"),
    [
        ([1], [2], "last", "complete", [(1, 2)]),
        ([1], [2, 3], "first", "final", [(1, 2)]),
        ([1], [2, 3], "last", "final", [(1, 3)]),
        ([1], [2, 3], "last", "running", [(1, None), (1, 2), (1, 3)]),
        ([1, 2], [3, 4], "product", "final", [(1, 3), (1, 4), (2, 3), (2, 4)]),
    ],
)
def test_small_joins(spark, left, right, insert_mode, emit_mode, want):
    number = lambda xs, first: [("ALL", x, 2 * k + first) for k, x in enumerate(xs)]
    got = joined(spark, [number(left, 0), number(right, 1)], insert_mode, emit_mode)
    assert sorted(got, key=str) == sorted((("ALL", *w) for w in want), key=str)


@pytest.mark.parametrize("insert_mode", ["first", "last", "product"])
@pytest.mark.parametrize("emit_mode", ["complete", "final", "running"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_joins_equal_the_state_machine(spark, monkeypatch, insert_mode, emit_mode, n):
    monkeypatch.setattr(functions, "ARRIVAL_SLICE_BITS", n)  # keys cut into several pieces
    draw = random.Random(f"{insert_mode}{emit_mode}{n}")
    rows = [(f"k{draw.randrange(4)}", draw.choice([None, *range(9)]), at, draw.randrange(n)) for at in range(28)]
    want = []
    for key in {r[0] for r in rows}:
        own = [(side, v) for k, v, _, side in rows if k == key]
        build = lambda state: Itemwise(lambda s: JoinLogic(n, insert_mode, emit_mode, s), state)
        want += [(key, *made) for _, made in drive(build, own)]
    got = joined(spark, [[r[:3] for r in rows if r[3] == k] for k in range(n)], insert_mode, emit_mode)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_state_pads_missing_sides():
    assert list(JoinState(3, [[1, 2], [], [3, 4]]).rows()) == [(1, None, 3), (1, None, 4), (2, None, 3), (2, None, 4)]


def test_modes_are_checked(spark):
    up = op.input("i", Flow("test", spark), TestingSource([{"key": "a", "value": 1}], "key string, value bigint"))
    with pytest.raises(ValueError, match="insert mode"):
        op.join("j", up, insert_mode="middle")
    with pytest.raises(ValueError, match="emit mode"):
        op.join("j2", up, emit_mode="never")


BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("left", "right", "modes", "want"),
    [
        ([(0, 1)], [(2, 3), (1, 2)], {"insert_mode": "first", "emit_mode": "complete"}, [(1, 2)]),
        ([(0, 1)], [(1, 2), (2, 3)], {}, [(1, 3)]),
        ([(0, 1)], [(1, 2), (2, 3)], {"emit_mode": "running"}, [(1, None), (1, 2), (1, 3)]),
        ([(0, 1), (1, 2)], [(1, 3), (2, 4)], {"insert_mode": "product"}, [(1, 3), (1, 4), (2, 3), (2, 4)]),
    ],
)
def test_join_window(spark, left, right, modes, want):
    flow, out = Flow("test", spark), []
    sides = [
        op.input(n, flow, TestingSource([{"key": "ALL", "ts": BASE + timedelta(seconds=s), "v": v} for s, v in rows], "key string, ts timestamp, v bigint"))
        for n, rows in (("l", left), ("r", right))
    ]
    got = op.join_window("j", op.EventClock("ts", timedelta.max), op.SessionWindower(timedelta(seconds=10)), *sides, names=["l", "r"], **modes)
    op.output("out", got.down, TestingSink(out))
    run_main(flow)
    pick = lambda x: x["v"] if x else None
    assert sorted(((pick(v["l"]), pick(v["r"])) for _, v in out), key=str) == sorted(want, key=str)
    assert {v["window_id"] for _, v in out} == {0}
