"""Drawn graphs, and the plans that Spark makes."""

import json
import re

import pytest
from pyspark.sql import functions as F

import flowspark.operators as op
from flowspark import Flow
from flowspark.plans import explain, to_json, to_mermaid, to_plantuml, to_rendered
from flowspark.testing import TestingSink, TestingSource

SF = "/root/testdata/sf0.001"


@pytest.fixture
def flow(spark):
    out = Flow("drawn", spark)
    up = op.input("inp", out, TestingSource(["a"], "string"))
    op.output("out", op.count_final("count", up, F.col("value")), TestingSink([]))
    return out


def test_graphs(flow):
    assert [r.op_type for r in to_rendered(flow)] == ["input", "count_final", "output"]
    assert json.loads(to_json(flow))["operators"][1]["substeps"][0]["step_id"] == "drawn.count.key_on"
    assert 'drawn.inp -- "down → up" --> drawn.count' in to_mermaid(flow)
    assert "drawn.count --> drawn.out" in to_plantuml(flow)
    assert "key_on" in to_plantuml(flow, recursive=True)
    assert "HashAggregate" in explain(flow)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from flowspark.queries import QUERIES

    text = plan(QUERIES["filter_orders"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>", text)


@pytest.mark.parametrize("name", ["count_final_type", "tumbling_count", "sliding_count", "join_last_final", "fold_final_stats"])
def test_aggregates_shuffle_once_after_partial_sums(spark, name):
    from flowspark.queries import QUERIES

    text = plan(QUERIES[name](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "partial_" in text
    assert "Python" not in text and "Arrow" not in text


def test_sets_are_not_compared_all_with_all(spark):
    from flowspark.queries import QUERIES

    text = plan(QUERIES["tumbling_collect_set"](spark, SF))
    assert "array_distinct" not in text  # of structs it takes the square of a set's size
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_the_llm_package_is_not_needed():
    from pathlib import Path

    for path in (Path(__file__).parent.parent / "flowspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_graph_and_counts_are_served(flow):
    from urllib.request import urlopen

    from flowspark.metrics import Progress, serve

    progress = Progress()
    progress.counts["drawn.out"]["item_inp_count"] = 5
    server = serve(flow, progress, port=0)
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        assert json.loads(urlopen(f"{at}/dataflow").read())["flow_id"] == "drawn"
        assert urlopen(f"{at}/metrics").read() == b'item_inp_count{step_id="drawn.out"} 5\n'
    finally:
        server.shutdown()
