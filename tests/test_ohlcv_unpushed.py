"""format("ohlcv") in a session whose filters Spark doesn't push into Python sources."""

import datetime as dt

import duckdb
import pytest

from barloom.plans import oracle, series
from barloom.sources import ohlcv

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SF = "/root/testdata/sf0.01"


@pytest.fixture
def unpushed(spark):
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "false")
    yield spark
    spark.conf.set(PUSHDOWN, before)
    ohlcv.register(spark)


def test_reads_without_pushdown(unpushed, tmp_path):
    ohlcv.register(unpushed)
    rows = [(s, dt.date(2020, 1, k), 1.5, 3.0, 1.0, 2.0 + k, 10.0) for s in ("A", "B/C", "é") for k in range(1, 20)]
    bars = unpushed.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    bars.write.format("ohlcv").mode("append").save(f"{tmp_path}/t")
    read = unpushed.read.format("ohlcv").load(f"{tmp_path}/t")
    for cond in ("true", "symbol = 'B/C'", "symbol in ('A', 'é') and date > date'2020-01-10'", "symbol is null", "close > 5"):
        assert sorted(map(tuple, read.where(cond).collect())) == sorted(map(tuple, bars.where(cond).collect())), cond


def test_query_without_pushdown(unpushed):
    db = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "nation", "region"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(oracle.oracle_sql()["ohlcv_files"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, series.queries()["ohlcv_files"](unpushed, SF).select(*names).collect())) == sorted(want.fetchall())
