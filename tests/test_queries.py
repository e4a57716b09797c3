"""Every query against its SQL, at the smallest scale."""

import decimal
import os

import pytest

from flowspark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_totals_beyond_a_bigint(spark, tmp_path):
    users = 6000  # 6000 times in 2024, each about 1.7e15 microseconds
    rows = spark.range(users).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + id) AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    want = sum(1704067200000000 + k for k in range(users))
    assert want >= 2**63
    out = QUERIES["tumbling_collect_dict"](spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [("view", 0, users, want)]
    assert dict(out.dtypes)["total"] == "decimal(38,0)"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_totals_within_a_bigint(spark):
    assert dict(QUERIES["tumbling_collect_dict"](spark, SF).dtypes) == {"key": "string", "window_id": "bigint", "n": "bigint", "total": "bigint"}
