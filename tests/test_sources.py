"""format("ohlcv") and signal() of SQL."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import table_functions
from barloom.operators.arrays import Series
from barloom.operators.signals import signal
from barloom.sources import csv, ohlcv

DAY = dt.date(2020, 1, 1)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("symbol", "date", *ohlcv.FIELDS).collect())


@pytest.fixture(scope="module")
def source(spark):
    ohlcv.register(spark)
    table_functions.register(spark)
    return spark


TEXT = """date;ticker;open;high;low;close;volume
2020-01-01;abcdefghijklmnop;;;;"$1,234.50";
2020-01-02T10:00:00Z;;9;11;8;10;5%
bad;x;1;1;1;1;1
2020-01-03;x;1;1;1;zero;1
2020-01-04;x;1;1;1;-2;1
1/5/2020;x;3
2020-01-06;x;n/a;;2;3
 "Jan 7, 2020" ; "q""q" ;1;2;0.5;1.5;7

5 Jan 2020;y;1;2;0.5;1e2;
"""


@pytest.mark.parametrize("piece", [1 << 20, 64, 7, 1])
def test_reads_as_the_csv_operator(source, tmp_path, piece):
    (tmp_path / "a.csv").write_text("﻿" + TEXT)
    (tmp_path / "b.csv").write_text("Price,Time\n5,2021-02-03\r\n6,2021-02-04")
    (tmp_path / "_skipped.csv").write_text("nothing")
    lines = source.createDataFrame(list(enumerate(TEXT.split("\n"))), "line_no long, line string").where("trim(line) <> '' and line_no > 0")
    want = csv.clean(lines.select("line_no", csv.cells_of(F.col("line")).alias("cells")), csv.split_line(TEXT.split("\n")[0]))
    more = [("IMPORT", dt.date(2021, 2, 3), 5.0, 5.0, 5.0, 5.0, 0.0), ("IMPORT", dt.date(2021, 2, 4), 6.0, 6.0, 6.0, 6.0, 0.0)]
    got = source.read.format("ohlcv").option("pieceBytes", piece).load(str(tmp_path))
    assert rows_of(got) == sorted(rows_of(want) + more)


def some_bars(spark, n=40):
    rows = [(s, DAY + dt.timedelta(days=k), 1.5 + k, 3.0 + k, 1.0, 2.0 + k, None if k % 7 == 0 else 10.0 * k) for s in ("A", "B/C", "é") for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double").repartition(5)


def test_round_trip_and_filters(source, tmp_path):
    path = str(tmp_path / "t")
    bars = some_bars(source)
    bars.write.format("ohlcv").mode("append").save(path)
    read = lambda: source.read.format("ohlcv").load(path)
    assert rows_of(read()) == rows_of(bars.fillna(0.0, ["volume"]))
    day = DAY + dt.timedelta(days=30)
    for cond in ("symbol = 'B/C'", "symbol in ('A', 'é') and date > date'2020-01-31'", "date <= date'2020-01-03' and date >= date'2020-01-02'", "date = date'2020-01-05' and close > 3", "symbol = 'A' and symbol = 'é'", "symbol <> 'A'", "symbol is null"):
        assert rows_of(read().where(cond)) == rows_of(bars.fillna(0.0, ["volume"]).where(cond)), cond
    plan = read().where((F.col("symbol") == "A") & (F.col("date") >= F.lit(day)))._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan ohlcv" in plan and "Filter (" not in plan  # Spark has nothing left to look at
    assert "Filter (" in read().where("close > 3")._jdf.queryExecution().executedPlan().toString()
    few = read().where("symbol = 'A'")
    assert few.rdd.getNumPartitions() < read().rdd.getNumPartitions()


def test_writes_are_whole_or_nothing(source, tmp_path):
    path = str(tmp_path / "t")
    some_bars(source).write.format("ohlcv").mode("append").save(path)
    before = rows_of(source.read.format("ohlcv").load(path))
    broken = some_bars(source).withColumn("date", F.when(F.col("close") < 40, F.col("date")))
    with pytest.raises(Exception, match="no date"):
        broken.write.format("ohlcv").mode("append").save(path)
    assert rows_of(source.read.format("ohlcv").load(path)) == before
    some_bars(source, 2).write.format("ohlcv").mode("append").save(path)
    assert len(rows_of(source.read.format("ohlcv").load(path))) == len(before) + 6
    some_bars(source, 3).write.format("ohlcv").mode("overwrite").save(path)
    assert len(rows_of(source.read.format("ohlcv").load(path))) == 9
    with pytest.raises(Exception, match="no column"):
        some_bars(source).drop("close").write.format("ohlcv").mode("append").save(path)
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="date and a close"):
        source.read.format("ohlcv").load(str(tmp_path / "x.csv")).count()


def test_signal_function(source):
    rng = np.random.default_rng(2)
    rows = [(s, t, *(float(v) for v in 100 + rng.standard_normal(4).cumsum()), "x") for s in ("A", "B", None) for t in rng.permutation(150).tolist()]
    bars = source.createDataFrame(rows, "symbol string, t int, open double, high double, low double, close double, more string")
    bars.createOrReplaceTempView("some_bars")
    params = {"fast": 5.0, "slow": 20.0, "confirm": 5.0, "band": 0.0}
    text = ", ".join(f"'{k}', {v}D" for k, v in params.items())
    got = source.sql(f"SELECT * FROM signal(TABLE(some_bars), 'trend', map({text}), 'long')")
    assert got.dtypes == [("symbol", "string"), ("t", "int"), ("signal", "double")]
    by = {(r["symbol"], r["t"]): r["signal"] for r in got.collect()}
    for s in ("A", "B", None):
        own = sorted(r[1:6] for r in rows if r[0] == s)
        cols = [np.array(c, np.float64) for c in zip(*own)]
        want = signal(Series(*cols[1:], np.zeros(150)), "trend", params, "long")
        assert [by[s, t] for t in range(150)] == want.tolist()
    assert source.sql(f"SELECT * FROM signal(TABLE(SELECT * FROM some_bars WHERE t < 0), 'trend', map({text}))").count() == 0
    for call, why in (("'nothing', map('a', 1D)", "no family"), ("'trend', map('fast', 5D)", "needs band"), ("'trend', map('quick', 5D)", "no parameter quick")):
        with pytest.raises(Exception, match=why):
            source.sql(f"SELECT * FROM signal(TABLE(some_bars), {call})").collect()
    with pytest.raises(Exception, match="no column"):
        source.sql(f"SELECT * FROM signal(TABLE(SELECT symbol, t FROM some_bars), 'trend', map({text}))").collect()
