"""A query for each operator over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .operators import kafka
from .operators.helpers import map_dict_value
from .runtime import run_main
from .sinks import DirSink, FileSink, FixedPartitionedSink, ParquetSink, StatefulSinkPartition
from .sources import CSVSource, DirSource, FileSource, ParquetSource, RandomMetricSource, TableSource, TestingSource
from .stream import ORDER, Flow, Stream

ALIGN = datetime(2024, 1, 1)
HOUR, DAY = timedelta(hours=1), timedelta(days=1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of (flow, table) that returns a stream."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            flow = Flow(build.__name__, spark)

            def table(name: str, arrival: str | None = None, columns: list[str] | None = None) -> Stream:
                source = ParquetSource(f"{sf_dir}/{name}.parquet", arrival)
                up = op.input(f"{name}_{len(flow.steps)}", flow, source)
                return up.with_df(up.df.select(*columns, *ORDER)) if columns else up

            return build(flow, table).df.drop(*ORDER)

        QUERIES[build.__name__] = run
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add


def keyed_events(table, key="event_type", value="value", arrival="event_id") -> Stream:
    """Events (key, value, ts, event_id) in the order of their ids."""
    up = table("events", arrival)
    up = op.key_on("key", up, F.col(key).cast("string"))
    return op.map_value("slim", up, {"value": F.col(value), "ts": F.col("ts"), "event_id": F.col("event_id")})


# -- stateless


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS price FROM lineitem")
def map_price(flow, table):
    return op.map("net", table("lineitem"), [F.col("l_orderkey"), F.col("l_linenumber"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("price")])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_orders(flow, table):
    done = op.filter("done", table("orders"), F.col("o_orderstatus") == "F")
    return op.map("slim", done, [F.col("o_orderkey"), F.col("o_totalprice")])


@query("SELECT o_orderkey AS value FROM orders WHERE o_orderpriority LIKE '1%'")
def filter_value_urgent(flow, table):
    up = op.key_on("key", table("orders"), F.col("o_orderstatus"))
    urgent = op.filter_value("urgent", up, F.col("o_orderpriority").startswith("1"))
    return op.map("ids", urgent, F.col("o_orderkey"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def filter_map_props(flow, table):
    k = F.get_json_object("props", "$.k").cast("bigint")
    even = F.when(k % 2 == 0, k)
    up = op.filter_map("even", table("events"), {"e": F.when(even.isNotNull(), F.struct(F.col("event_id"), even.alias("k")))})
    return op.map("fields", up, [F.col("e.event_id"), F.col("e.k")])


@query("SELECT c_mktsegment AS key, upper(c_name) AS value FROM customer")
def map_value_upper(flow, table):
    return op.map_value("upper", op.key_on("key", table("customer"), F.col("c_mktsegment")), F.upper("c_name"))


@query("SELECT c_mktsegment AS key, c_acctbal AS value FROM customer WHERE c_acctbal > 0")
def filter_map_value_positive(flow, table):
    up = op.key_on("key", table("customer"), F.col("c_mktsegment"))
    return op.filter_map_value("positive", up, F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def flat_map_words(flow, table):
    return op.flat_map("words", table("part"), F.split("p_name", " "))


@query("SELECT unnest(string_split(p_type, ' ')) AS value FROM part")
def flatten_tokens(flow, table):
    return op.flatten("flat", op.map("lists", table("part"), F.split("p_type", " ")))


@query("SELECT p_brand AS key, unnest(string_split(p_name, ' ')) AS value FROM part")
def flat_map_value_words(flow, table):
    return op.flat_map_value("words", op.key_on("key", table("part"), F.col("p_brand")), F.split("p_name", " "))


@query("SELECT 2 * o_orderkey AS value FROM orders WHERE o_orderkey % 3 = 0")
def flat_map_batch_thirds(flow, table):
    ids = op.map("ids", table("orders"), F.col("o_orderkey"))
    return op.flat_map_batch("thirds", ids, lambda xs: [2 * x for x in xs if x % 3 == 0], "bigint")


@query("SELECT o_orderkey AS value FROM orders WHERE o_totalprice > 150000")
def branch_true(flow, table):
    return op.map("ids", op.branch("big", table("orders"), F.col("o_totalprice") > 150000).trues, F.col("o_orderkey"))


@query("SELECT o_orderkey AS value FROM orders WHERE NOT o_totalprice > 150000")
def branch_false(flow, table):
    return op.map("ids", op.branch("big", table("orders"), F.col("o_totalprice") > 150000).falses, F.col("o_orderkey"))


@query("SELECT c_custkey AS value FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def merge_branches(flow, table):
    return op.merge("all", op.map("c", table("customer"), F.col("c_custkey")), op.map("s", table("supplier"), F.col("s_suppkey")))


@query("SELECT p_partkey AS value FROM part")
def redistribute_noop(flow, table):
    return op.redistribute("spread", op.map("ids", table("part"), F.col("p_partkey")))


@query("SELECT event_id AS value FROM events")
def inspect_passthrough(flow, table):
    return op.inspect("look", op.map("ids", table("events"), F.col("event_id")), lambda step_id, item: None)


@query("SELECT event_id AS value FROM events")
def inspect_debug_passthrough(flow, table):
    return op.inspect_debug("look", op.map("ids", table("events"), F.col("event_id")), lambda step_id, item, epoch, worker: None)


@query("SELECT event_id, upper(event_type) AS event_type FROM events")
def map_dict_value_upper(flow, table):
    up = op.map("slim", table("events"), {"event_id": F.col("event_id"), "event_type": F.col("event_type")})
    return op.map("upper", up, map_dict_value("event_type", str.upper), "event_id bigint, event_type string")


@query("SELECT p_partkey AS value FROM part WHERE p_size > 25")
def key_rm_values(flow, table):
    up = op.key_on("key", op.filter("large", table("part"), F.col("p_size") > 25), F.col("p_brand"))
    return op.map("ids", op.key_rm("unkey", up), F.col("p_partkey"))


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def enrich_nation(flow, table):
    nations = table("nation").df.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return op.enrich_cached("nation", table("customer"), nations, [F.col("c_custkey"), F.col("n_name").alias("nation")], on="c_nationkey")


# -- at the end


@query("SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1")
def count_final_type(flow, table):
    return op.count_final("count", table("events"), F.col("event_type"))


@query("SELECT o_custkey::VARCHAR AS key, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def max_final_order(flow, table):
    up = op.key_on("key", table("orders", "o_orderkey", ["o_custkey", "o_orderkey", "o_totalprice"]), F.col("o_custkey").cast("string"))
    top = op.max_final("max", up, F.col("o_totalprice"))
    return op.map("fields", top, [F.col("key"), F.col("o_orderkey"), F.col("o_totalprice")])


@query("SELECT o_custkey::VARCHAR AS key, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def min_final_order(flow, table):
    up = op.key_on("key", table("orders", "o_orderkey", ["o_custkey", "o_orderkey", "o_totalprice"]), F.col("o_custkey").cast("string"))
    low = op.min_final("min", up, F.col("o_totalprice"))
    return op.map("fields", low, [F.col("key"), F.col("o_orderkey"), F.col("o_totalprice")])


@query("SELECT l_returnflag AS key, min(l_extendedprice) AS low, max(l_extendedprice) AS high, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE AS total FROM lineitem GROUP BY 1")
def fold_final_stats(flow, table):
    up = op.key_on("key", table("lineitem"), F.col("l_returnflag"))
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return op.fold_final("stats", up, agg={"low": F.min("l_extendedprice"), "high": F.max("l_extendedprice"), "total": total})


@query("SELECT l_suppkey::VARCHAR AS key, sum(l_linenumber)::BIGINT AS value FROM lineitem GROUP BY 1")
def reduce_final_lines(flow, table):
    up = op.map_value("n", op.key_on("key", table("lineitem"), F.col("l_suppkey").cast("string")), F.col("l_linenumber").cast("bigint"))
    return op.reduce_final("sum", up, F.sum("value"))


@query("SELECT event_type AS key, sum(event_id)::BIGINT AS value FROM events GROUP BY 1")
def reduce_final_python(flow, table):
    up = op.map_value("n", op.key_on("key", table("events", "event_id"), F.col("event_type")), F.col("event_id"))
    return op.reduce_final("sum", up, lambda a, b: a + b)


@query("""SELECT event_type AS key, max(event_id) AS last, coalesce(max(event_id - before), 0)::BIGINT AS gap FROM (
  SELECT *, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) GROUP BY 1""")
def fold_final_python(flow, table):
    up = op.map_value("e", op.key_on("key", table("events", "event_id"), F.col("event_type")), F.col("event_id"))
    return op.fold_final("fold", up, lambda: (None, 0), lambda acc, e: (e, max(acc[1], e - acc[0] if acc[0] is not None else 0)), "last bigint, gap bigint")


@query("""SELECT key, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS value FROM (
  SELECT user_id::VARCHAR AS key, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS chunk FROM events) GROUP BY key, chunk""")
def collect_chunks(flow, table):
    up = op.map_value("e", op.key_on("key", table("events", "event_id"), F.col("user_id").cast("string")), F.col("event_id"))
    lists = op.collect("seven", up, timedelta(seconds=10), 7)
    return op.map_value("text", lists, F.array_join(F.col("value").cast("array<string>"), ","))


# -- keyed state


@query("SELECT user_id::VARCHAR AS key, event_id, count(*) OVER w AS n, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def stateful_running(flow, table):
    up = keyed_events(table, "user_id")
    return op.stateful_map("run", up, over={"event_id": lambda w: F.col("event_id"), "n": lambda w: F.count("*").over(w), "high": lambda w: F.max("value").over(w)})


@query("SELECT user_id::VARCHAR AS key, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS value FROM events")
def stateful_map_python(flow, table):
    up = op.map_value("e", op.key_on("key", table("events", "event_id"), F.col("user_id").cast("string")), F.col("event_id"))
    return op.stateful_map("sum", up, lambda s, x: ((s or 0) + x,) * 2, "bigint")


@query("""SELECT key, event_id, value FROM (
  SELECT user_id::VARCHAR AS key, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
  WHERE before IS NULL OR value > before""")
def stateful_new_max(flow, table):
    up = op.map_value("e", op.key_on("key", table("events", "event_id"), F.col("user_id").cast("string")), {"event_id": F.col("event_id"), "value": F.col("value")})

    def record(best, row):
        new = best is None or row["value"] > best
        return (row["value"] if new else best), ([row] if new else [])

    return op.stateful_flat_map("max", up, record, "event_id bigint, value double")


@query("SELECT user_id::VARCHAR AS key, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY 1")
def stateful_batch_totals(flow, table):
    from .streaming.logic import StatefulBatchLogic

    class Totals(StatefulBatchLogic):
        def __init__(self, state):
            self.n, self.total = state or (0, 0)

        def on_batch(self, values):
            self.n, self.total = self.n + len(values), self.total + sum(values)
            return (), self.RETAIN

        def on_eof(self):
            return [(self.n, self.total)], self.DISCARD

        def snapshot(self):
            return self.n, self.total

    up = op.map_value("e", op.key_on("key", table("events", "event_id"), F.col("user_id").cast("string")), F.col("event_id"))
    return op.stateful_batch("totals", up, Totals, "n bigint, total bigint")


@query("""SELECT key, event_id FROM (SELECT user_id::VARCHAR AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k % 3 = 0""")
def stateful_every_third(flow, table):
    from .streaming.logic import StatefulLogic

    class Third(StatefulLogic):
        def __init__(self, state):
            self.n = state or 0

        def on_item(self, value):
            self.n += 1
            return ([(value,)], self.DISCARD) if self.n == 3 else ((), self.RETAIN)

        def snapshot(self):
            return self.n

    up = op.map_value("e", op.key_on("key", table("events", "event_id"), F.col("user_id").cast("string")), F.col("event_id"))
    return op.stateful("third", up, Third, "event_id bigint")


# -- joins


def _two_sides(table):
    left = op.filter("views", table("events", "event_id"), F.col("event_id") % 2 == 0)
    right = op.filter("others", table("events", "event_id"), F.col("event_id") % 2 == 1)
    pick = lambda n, s: op.map_value(f"v_{n}", op.key_on(f"k_{n}", s, F.col("user_id").cast("string")), F.col("event_id"))
    return pick("l", left), pick("r", right)


_SIDES = "l AS (SELECT user_id::VARCHAR AS key, event_id FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id::VARCHAR AS key, event_id FROM events WHERE event_id % 2 = 1)"


def _final_sql(f: str) -> str:
    return f"WITH {_SIDES} SELECT coalesce(a.key, b.key) AS key, a.v AS l, b.v AS r FROM (SELECT key, {f}(event_id) AS v FROM l GROUP BY key) a FULL JOIN (SELECT key, {f}(event_id) AS v FROM r GROUP BY key) b ON a.key = b.key"


@query(_final_sql("max"))
def join_last_final(flow, table):
    return op.join("join", *_two_sides(table), insert_mode="last", emit_mode="final", names=["l", "r"])


@query(_final_sql("min"))
def join_first_final(flow, table):
    return op.join("join", *_two_sides(table), insert_mode="first", emit_mode="final", names=["l", "r"])


@query(f"WITH {_SIDES} SELECT coalesce(l.key, r.key) AS key, l.event_id AS l, r.event_id AS r FROM l FULL JOIN r ON l.key = r.key")
def join_product_final(flow, table):
    return op.join("join", *_two_sides(table), insert_mode="product", emit_mode="final", names=["l", "r"])


def _running_sql(f: str) -> str:
    return f"""SELECT user_id::VARCHAR AS key, {f}_value(CASE WHEN event_id % 2 = 0 THEN event_id END IGNORE NULLS) OVER w AS l,
  {f}_value(CASE WHEN event_id % 2 = 1 THEN event_id END IGNORE NULLS) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(_running_sql("last"))
def join_last_running(flow, table):
    return op.join("join", *_two_sides(table), insert_mode="last", emit_mode="running", names=["l", "r"])


@query(_running_sql("first"))
def join_first_running(flow, table):
    return op.join("join", *_two_sides(table), insert_mode="first", emit_mode="running", names=["l", "r"])


@query("""WITH s AS (SELECT user_id || event_type AS key, event_id, event_id % 2 AS side FROM events)
SELECT t.key, a.event_id AS l, b.event_id AS r FROM s t LEFT JOIN s a ON a.key = t.key AND a.side = 0 AND a.event_id <= t.event_id
LEFT JOIN s b ON b.key = t.key AND b.side = 1 AND b.event_id <= t.event_id""")
def join_product_running(flow, table):
    up = table("events", "event_id")
    key = F.concat(F.col("user_id").cast("string"), F.col("event_type"))
    sides = [op.map_value(f"v_{n}", op.key_on(f"k_{n}", op.filter(f"f_{n}", up, F.col("event_id") % 2 == k), key), F.col("event_id")) for k, n in enumerate("lr")]
    return op.join("join", *sides, insert_mode="product", emit_mode="running", names=["l", "r"])


_ROUNDS = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
walk AS (
  SELECT key, i, event_id, CASE WHEN side = 0 THEN event_id END AS l, CASE WHEN side = 1 THEN event_id END AS r, false AS done FROM e WHERE i = 1
  UNION ALL
  SELECT e.key, e.i, e.event_id,
    CASE WHEN side = 0 THEN {keep_l} ELSE CASE WHEN w.done THEN NULL ELSE w.l END END,
    CASE WHEN side = 1 THEN {keep_r} ELSE CASE WHEN w.done THEN NULL ELSE w.r END END,
    (CASE WHEN w.done THEN NULL ELSE CASE WHEN side = 0 THEN w.r ELSE w.l END END) IS NOT NULL
  FROM walk w JOIN e ON e.key = w.key AND e.i = w.i + 1)
SELECT key, l, r FROM walk WHERE done"""


@query(_ROUNDS.format(keep_l="e.event_id", keep_r="e.event_id"))
def join_last_complete(flow, table):
    return op.join("join", *_two_sides(table), names=["l", "r"])


@query(_ROUNDS.format(keep_l="CASE WHEN w.done THEN e.event_id ELSE coalesce(w.l, e.event_id) END", keep_r="CASE WHEN w.done THEN e.event_id ELSE coalesce(w.r, e.event_id) END"))
def join_first_complete(flow, table):
    return op.join("join", *_two_sides(table), insert_mode="first", names=["l", "r"])


_PRODUCT_ROUNDS = """, numbered AS (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY {group} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS round FROM walk),
whole AS (SELECT {group}, round FROM numbered WHERE done)
SELECT {select}, a.event_id AS l, b.event_id AS r FROM whole w
JOIN numbered a ON {on_a} AND a.round = w.round AND a.event_id % 2 = 0 JOIN numbered b ON {on_b} AND b.round = w.round AND b.event_id % 2 = 1"""


@query(_ROUNDS.format(keep_l="e.event_id", keep_r="e.event_id").replace("SELECT key, l, r FROM walk WHERE done", "").rstrip() + _PRODUCT_ROUNDS.format(group="key", select="w.key", on_a="a.key = w.key", on_b="b.key = w.key"))
def join_product_complete(flow, table):
    return op.join("join", *_two_sides(table), insert_mode="product", names=["l", "r"])


# -- windows

_D = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))"
_US_DAY, _US_HOUR = 86_400_000_000, 3_600_000_000
_DAY_ID = f"floor({_D} / {_US_DAY}.0)::BIGINT"


def _clock(wait=timedelta.max):
    return op.EventClock("ts", wait)


@query(f"SELECT event_type AS key, {_DAY_ID} AS window_id, count(*) AS value FROM events GROUP BY 1, 2")
def tumbling_count(flow, table):
    return op.count_window("count", table("events", "event_id"), _clock(), op.TumblingWindower(DAY, ALIGN), F.col("event_type")).down


@query(f"SELECT event_type AS key, {_DAY_ID} AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS value FROM events GROUP BY 1, 2")
def tumbling_collect(flow, table):
    up = op.map_value("e", keyed_events(table), {"value": F.col("event_id"), "ts": F.col("ts")})
    lists = op.collect_window("list", op.map_value("v", up, {"e": F.col("value"), "ts": F.col("ts")}), _clock(), op.TumblingWindower(DAY, ALIGN)).down
    return op.map("text", lists, [F.col("key"), F.col("window_id"), F.array_join(F.transform("value", lambda x: x["e"].cast("string")), ",").alias("value")])


@query(f"SELECT event_type AS key, {_DAY_ID} AS window_id, max_by(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1, 2")
def tumbling_max(flow, table):
    top = op.max_window("max", keyed_events(table), _clock(), op.TumblingWindower(DAY, ALIGN), F.col("value")).down
    return op.map("fields", top, [F.col(c) for c in ("key", "window_id", "event_id", "value")])


@query(f"SELECT event_type AS key, {_DAY_ID} AS window_id, min_by(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY 1, 2")
def tumbling_min(flow, table):
    low = op.min_window("min", keyed_events(table), _clock(), op.TumblingWindower(DAY, ALIGN), F.col("value")).down
    return op.map("fields", low, [F.col(c) for c in ("key", "window_id", "event_id", "value")])


@query(f"SELECT event_type AS key, {_DAY_ID} AS window_id, sum(event_id)::BIGINT AS value FROM events GROUP BY 1, 2")
def tumbling_reduce(flow, table):
    return op.reduce_window("sum", keyed_events(table), _clock(), op.TumblingWindower(DAY, ALIGN), F.sum("event_id")).down


@query(f"""SELECT event_type AS key, {_DAY_ID} AS window_id, count(*) AS n, sum(user_id)::BIGINT AS users, sum(epoch_us(hour) // 1000000)::BIGINT AS hours
FROM (SELECT DISTINCT event_type, user_id, date_trunc('hour', ts) AS hour, date_trunc('hour', ts) AS ts FROM events) GROUP BY 1, 2""")
def tumbling_collect_set(flow, table):
    up = op.map_value("u", op.key_on("key", table("events", "event_id"), F.col("event_type")), {"user_id": F.col("user_id").cast("bigint"), "ts": F.date_trunc("hour", "ts")})
    sets = op.collect_window("set", up, _clock(), op.TumblingWindower(DAY, ALIGN), into=set).down
    total = lambda f: F.aggregate("value", F.lit(0).cast("bigint"), lambda acc, x: acc + f(x))
    return op.map("sums", sets, {"key": F.col("key"), "window_id": F.col("window_id"), "n": F.size("value").cast("bigint"), "users": total(lambda x: x["user_id"]), "hours": total(lambda x: F.unix_seconds(x["ts"].cast("timestamp")))})


@query(f"""SELECT key, window_id, count(*) AS n, sum(epoch_us(last))::BIGINT AS total FROM (
  SELECT event_type AS key, {_DAY_ID} AS window_id, user_id, max(ts) AS last FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def tumbling_collect_dict(flow, table):
    """The total is a bigint, as in the SQL. If one is beyond that, where the SQL stops with an error, all are decimal(38,0)."""
    up = op.map_value("u", op.key_on("key", table("events", "event_id"), F.col("event_type")), {"user_id": F.col("user_id"), "ts": F.col("ts")})
    maps = op.collect_window("dict", up, _clock(), op.TumblingWindower(DAY, ALIGN), into=dict).down
    total = F.aggregate(F.map_values("value"), F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + F.unix_micros(x.cast("timestamp"))).cast("decimal(38,0)"))
    sums = op.map("sums", maps, {"key": F.col("key"), "window_id": F.col("window_id"), "n": F.size("value").cast("bigint"), "total": total})
    path = _folder(flow.spark, "sums")
    sums = _through(flow, sums, ParquetSink(path), ParquetSource(path))
    fits = sums.df.filter(F.col("total").try_cast("bigint").isNull()).isEmpty()
    return op.map_value("typed", sums, {"window_id": F.col("window_id"), "n": F.col("n"), "total": F.col("total").cast("bigint" if fits else "decimal(38,0)")})


_SLIDES = f"""SELECT event_type AS key, event_id, value, unnest(generate_series(floor(({_D} - {_US_DAY}) / {6 * _US_HOUR}.0)::BIGINT + 1, floor({_D} / {6 * _US_HOUR}.0)::BIGINT)) AS window_id FROM events"""


@query(f"SELECT key, window_id, count(*) AS value FROM ({_SLIDES}) GROUP BY 1, 2")
def sliding_count(flow, table):
    return op.count_window("count", table("events", "event_id"), _clock(), op.SlidingWindower(DAY, 6 * HOUR, ALIGN), F.col("event_type")).down


@query(f"SELECT key, window_id, min(value) AS low, max(value) AS high, count(*) AS n FROM ({_SLIDES}) GROUP BY 1, 2")
def sliding_fold(flow, table):
    return op.fold_window("stats", keyed_events(table), _clock(), op.SlidingWindower(DAY, 6 * HOUR, ALIGN), agg={"low": F.min("value"), "high": F.max("value"), "n": F.count("*")}).down


_SESSIONS = f"""SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, event_id) - 1 AS window_id FROM (
  SELECT user_id::VARCHAR AS key, event_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {_US_HOUR} THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"SELECT key, window_id::BIGINT AS window_id, count(*) AS n, max(value) AS high FROM ({_SESSIONS}) GROUP BY 1, 2")
def session_fold(flow, table):
    return op.fold_window("stats", keyed_events(table, "user_id"), _clock(), op.SessionWindower(HOUR), agg={"n": F.count("*"), "high": F.max("value")}).down


@query(f"SELECT key, window_id::BIGINT AS window_id, epoch_us(min(ts)) AS open_us, epoch_us(max(ts)) AS close_us, 0 AS n_merged FROM ({_SESSIONS}) GROUP BY 1, 2")
def session_meta(flow, table):
    meta = op.fold_window("stats", keyed_events(table, "user_id"), _clock(), op.SessionWindower(HOUR), agg=F.count("*")).meta
    return op.map("fields", meta, [F.col("key"), F.col("window_id"), F.unix_micros("open_time").alias("open_us"), F.unix_micros("close_time").alias("close_us"), F.size("merged_ids").alias("n_merged")])


@query(f"SELECT DISTINCT event_type AS key, {_DAY_ID} AS window_id, epoch_us(TIMESTAMP '2024-01-01') + {_DAY_ID} * {_US_DAY} AS open_us, epoch_us(TIMESTAMP '2024-01-01') + ({_DAY_ID} + 1) * {_US_DAY} AS close_us FROM events")
def window_meta(flow, table):
    meta = op.count_window("count", table("events", "event_id"), _clock(), op.TumblingWindower(DAY, ALIGN), F.col("event_type")).meta
    return op.map("fields", meta, [F.col("key"), F.col("window_id"), F.unix_micros("open_time").alias("open_us"), F.unix_micros("close_time").alias("close_us")])


# a shuffled order of arrival, in which some rows come late
_SHUFFLED = "row_number() OVER (ORDER BY event_id + (event_id * 37) % 101, event_id)"
_LATE = f"""SELECT *, epoch_us(ts) < max(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id + (event_id * 37) % 101, event_id ROWS UNBOUNDED PRECEDING) - {6 * _US_HOUR} AS late FROM events"""


def _disordered(table) -> Stream:
    up = table("events", "event_id")
    place = (F.col("event_id") + (F.col("event_id") * 37) % 101) * 1_000_000_000 + F.col("event_id")
    up = up.with_df(up.df.withColumn(ORDER[0], place))
    return op.map_value("slim", op.key_on("key", up, F.col("event_type")), {"event_id": F.col("event_id"), "ts": F.col("ts")})


@query(f"SELECT event_type AS key, {_DAY_ID} AS window_id, event_id FROM ({_LATE}) WHERE late")
def tumbling_late(flow, table):
    late = op.fold_window("count", _disordered(table), _clock(6 * HOUR), op.TumblingWindower(DAY, ALIGN), agg=F.count("*")).late
    return op.map("fields", late, [F.col("key"), F.col("window_id"), F.col("event_id")])


@query(f"SELECT event_type AS key, {_DAY_ID} AS window_id, count(*) AS value FROM ({_LATE}) WHERE NOT late GROUP BY 1, 2")
def tumbling_on_time(flow, table):
    return op.fold_window("count", _disordered(table), _clock(6 * HOUR), op.TumblingWindower(DAY, ALIGN), agg=F.count("*")).down


@query(f"SELECT event_type AS key, {_DAY_ID} AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS value FROM events GROUP BY 1, 2")
def window_python(flow, table):
    from .streaming.logic import WindowLogic

    class Joined(WindowLogic):
        def __init__(self, ids):
            self.ids = ids or []

        def on_value(self, value):
            self.ids.append(str(value["event_id"]))
            return ()

        def on_merge(self, original):
            self.ids += original.ids
            return ()

        def on_close(self):
            return (",".join(self.ids),)

        def snapshot(self):
            return self.ids

    return op.window("ids", keyed_events(table), _clock(), op.TumblingWindower(DAY, ALIGN), Joined, "string").down


@query(f"SELECT event_type AS key, -1 AS window_id, event_id FROM ({_LATE}) WHERE late")
def session_late(flow, table):
    late = op.fold_window("count", _disordered(table), _clock(6 * HOUR), op.SessionWindower(HOUR), agg=F.count("*")).late
    return op.map("fields", late, [F.col("key"), F.col("window_id"), F.col("event_id")])


def _window_sides(table):
    left, right = (op.filter(n, table("events", "event_id"), F.col("event_id") % 2 == k) for n, k in (("even", 0), ("odd", 1)))
    pick = lambda n, s: op.map_value(f"v_{n}", op.key_on(f"k_{n}", s, F.col("user_id").cast("string")), {"e": F.col("event_id"), "ts": F.col("ts")})
    return pick("l", left), pick("r", right)


def _ids(out: Stream) -> Stream:
    return op.map("ids", out, [F.col("key"), F.col("window_id"), F.col("l.e").alias("l"), F.col("r.e").alias("r")])


_WSIDES = f"l AS (SELECT user_id::VARCHAR AS key, {_DAY_ID} AS window_id, ts, event_id FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id::VARCHAR AS key, {_DAY_ID} AS window_id, ts, event_id FROM events WHERE event_id % 2 = 1)"


@query(f"""WITH {_WSIDES} SELECT coalesce(a.key, b.key) AS key, coalesce(a.window_id, b.window_id) AS window_id, a.v AS l, b.v AS r
FROM (SELECT key, window_id, max_by(event_id, (ts, event_id)) AS v FROM l GROUP BY 1, 2) a FULL JOIN (SELECT key, window_id, max_by(event_id, (ts, event_id)) AS v FROM r GROUP BY 1, 2) b
ON a.key = b.key AND a.window_id = b.window_id""")
def join_window_last_final(flow, table):
    return _ids(op.join_window("join", _clock(), op.TumblingWindower(DAY, ALIGN), *_window_sides(table), names=["l", "r"]).down)


@query(f"""WITH {_WSIDES} SELECT coalesce(l.key, r.key) AS key, coalesce(l.window_id, r.window_id) AS window_id, l.event_id AS l, r.event_id AS r
FROM l FULL JOIN r ON l.key = r.key AND l.window_id = r.window_id""")
def join_window_product_final(flow, table):
    return _ids(op.join_window("join", _clock(), op.TumblingWindower(DAY, ALIGN), *_window_sides(table), insert_mode="product", names=["l", "r"]).down)


@query(f"""SELECT user_id::VARCHAR AS key, {_DAY_ID} AS window_id, last_value(CASE WHEN event_id % 2 = 0 THEN event_id END IGNORE NULLS) OVER w AS l,
last_value(CASE WHEN event_id % 2 = 1 THEN event_id END IGNORE NULLS) OVER w AS r FROM events
WINDOW w AS (PARTITION BY user_id, {_DAY_ID} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def join_window_last_running(flow, table):
    return _ids(op.join_window("join", _clock(), op.TumblingWindower(DAY, ALIGN), *_window_sides(table), emit_mode="running", names=["l", "r"]).down)


def _window_join(table, insert_mode, emit_mode):
    return _ids(op.join_window("join", _clock(), op.TumblingWindower(DAY, ALIGN), *_window_sides(table), insert_mode=insert_mode, emit_mode=emit_mode, names=["l", "r"]).down)


@query(f"""WITH {_WSIDES} SELECT coalesce(a.key, b.key) AS key, coalesce(a.window_id, b.window_id) AS window_id, a.v AS l, b.v AS r
FROM (SELECT key, window_id, min_by(event_id, (ts, event_id)) AS v FROM l GROUP BY 1, 2) a FULL JOIN (SELECT key, window_id, min_by(event_id, (ts, event_id)) AS v FROM r GROUP BY 1, 2) b
ON a.key = b.key AND a.window_id = b.window_id""")
def join_window_first_final(flow, table):
    return _window_join(table, "first", "final")


@query(f"""SELECT user_id::VARCHAR AS key, {_DAY_ID} AS window_id, first_value(CASE WHEN event_id % 2 = 0 THEN event_id END IGNORE NULLS) OVER w AS l,
first_value(CASE WHEN event_id % 2 = 1 THEN event_id END IGNORE NULLS) OVER w AS r FROM events
WINDOW w AS (PARTITION BY user_id, {_DAY_ID} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def join_window_first_running(flow, table):
    return _window_join(table, "first", "running")


_IN_WINDOW = f"SELECT user_id::VARCHAR AS key, {_DAY_ID} AS window_id, ts, event_id, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, {_DAY_ID} ORDER BY ts, event_id) AS i FROM events"


@query(f"""WITH s AS ({_IN_WINDOW}) SELECT t.key, t.window_id, a.event_id AS l, b.event_id AS r FROM s t
LEFT JOIN s a ON a.key = t.key AND a.window_id = t.window_id AND a.side = 0 AND a.i <= t.i LEFT JOIN s b ON b.key = t.key AND b.window_id = t.window_id AND b.side = 1 AND b.i <= t.i""")
def join_window_product_running(flow, table):
    return _window_join(table, "product", "running")


def _window_rounds(keep_l: str, keep_r: str) -> str:
    walk = _ROUNDS.format(keep_l=keep_l, keep_r=keep_r)
    start, rest = walk.index("(SELECT user_id"), walk.index(",\nwalk AS")
    walk = walk[:start] + f"({_IN_WINDOW})" + walk[rest:]
    walk = walk.replace("SELECT key, i, event_id", "SELECT key, window_id, i, event_id").replace("SELECT e.key, e.i", "SELECT e.key, e.window_id, e.i")
    return walk.replace("e.key = w.key AND", "e.key = w.key AND e.window_id = w.window_id AND").replace("SELECT key, l, r", "SELECT key, window_id, l, r")


@query(_window_rounds("e.event_id", "e.event_id"))
def join_window_last_complete(flow, table):
    return _window_join(table, "last", "complete")


@query(_window_rounds("CASE WHEN w.done THEN e.event_id ELSE coalesce(w.l, e.event_id) END", "CASE WHEN w.done THEN e.event_id ELSE coalesce(w.r, e.event_id) END"))
def join_window_first_complete(flow, table):
    return _window_join(table, "first", "complete")


_SAME = "{x}.key = w.key AND {x}.window_id = w.window_id"


@query(_window_rounds("e.event_id", "e.event_id").replace("SELECT key, window_id, l, r FROM walk WHERE done", "").rstrip() + _PRODUCT_ROUNDS.format(group="key, window_id", select="w.key, w.window_id", on_a=_SAME.format(x="a"), on_b=_SAME.format(x="b")))
def join_window_product_complete(flow, table):
    return _window_join(table, "product", "complete")


# -- sources and sinks


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="flowspark-")
    return f"{shared.rstrip('/')}/flowspark-query-{uuid.uuid4().hex}/{name}"


def _through(flow: Flow, up: Stream, sink, source) -> Stream:
    """What source reads of what sink has written of up."""
    op.output("out", up, sink)
    run_main(flow)
    return op.input("again", Flow("again", flow.spark), source)


@query("SELECT o_orderkey || ' ' || o_orderpriority AS value FROM orders")
def file_sink_and_source(flow, table):
    path = _folder(flow.spark, "lines")
    return _through(flow, op.map("line", table("orders"), F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority")), FileSink(path), FileSource(path))


@query("SELECT o_orderpriority || ' ' || o_orderkey AS value FROM orders")
def dir_sink_and_source(flow, table):
    path = _folder(flow.spark, "files")
    up = op.map_value("line", op.key_on("key", table("orders"), F.col("o_orderpriority")), F.concat_ws(" ", "key", F.col("o_orderkey").cast("string")))
    return op.map("value", _through(flow, up, DirSink(path, 3), DirSource(path)), F.col("value"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def parquet_sink_and_source(flow, table):
    path = _folder(flow.spark, "rows")
    up = op.map("slim", table("customer"), [F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal")])
    return _through(flow, up, ParquetSink(path), ParquetSource(path))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_source(flow, table):
    path = _folder(flow.spark, "csv")
    table("nation").df.select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return op.input("csv", flow, CSVSource(path))


@query("SELECT event_id, props::VARCHAR AS props FROM events")
def fixed_partitioned_sink(flow, table):
    """Rows by way of a sink in Python, a JSON file for each part and task."""
    path = _folder(flow.spark, "parts")

    class Part(StatefulSinkPartition):
        def __init__(self, name):
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(path)
            store.create_dir(root, recursive=True)
            self.out = store.open_output_stream(f"{root}/{name}-{uuid.uuid4().hex}.json")

        def write_batch(self, values):
            self.out.write("".join(json.dumps(v) + "\n" for v in values).encode())

        def close(self):
            self.out.close()

    class Parts(FixedPartitionedSink):
        def list_parts(self):
            return ["a", "b", "c"]

        def build_part(self, step_id, for_part, resume_state):
            return Part(for_part)

    up = op.map_value("slim", op.key_on("key", table("events"), F.col("event_type")), {"event_id": F.col("event_id"), "props": F.col("props").cast("string")})
    source = TableSource(lambda spark: spark.read.schema("event_id bigint, props string").json(path))
    return _through(flow, up, Parts(), source)


@query("SELECT unnest(range(5)) * 2 AS value")
def testing_source(flow, table):
    return op.map("twice", op.input("five", flow, TestingSource(list(range(5)), "bigint")), F.col("value") * 2)


@query("SELECT 'cpu' AS key, 10 AS n, true AS within")
def random_metric_source(flow, table):
    up = op.input("metric", flow, RandomMetricSource("cpu", count=10))
    return op.fold_final("stats", up, agg={"n": F.count("*"), "within": F.min((F.col("value") >= 0) & (F.col("value") < 10))})


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, length('{\"k\":' || json_extract_string(props, '$.k') || '}')::INT AS n_bytes FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def kafka_json_codecs(flow, table):
    messages = op.map("bytes", table("events"), {"key": F.col("event_id").cast("string").cast("binary"), "value": F.col("props").cast("string").cast("binary")})
    oks = kafka.deserialize_value("read", messages, kafka.json_deserializer("k bigint")).oks
    again = kafka.serialize_value("write", op.map("both", oks, {"key": F.col("key"), "k": F.col("value.k"), "value": F.col("value")}), kafka.json_serializer())
    return op.map("fields", again, [F.col("key").cast("string").cast("bigint").alias("event_id"), F.col("k"), F.octet_length("value").alias("n_bytes")])


__all__ = ["ORACLE_SQL", "QUERIES"]
