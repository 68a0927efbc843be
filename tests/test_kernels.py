"""Kernels against hand-computed values, as windows and on arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import arrays as A
from barloom.operators import kernels as K
from barloom.sources import bars as B

CLOSE = [10, 11, 10.5, 12, 11.5, 13, 12.5, 12]
N = None
WANT = {
    "sma": [N, N, 10.5, 11.166667, 11.333333, 12.166667, 12.333333, 12.5],
    "stdev": [N, N, 0.5, 0.763763, 0.763763, 0.763763, 0.763763, 0.5],
    "high": [N, N, 11.5, 12.5, 12.5, 13.5, 13.5, 13.5],
    "roc": [N, N, 0.05, 0.090909, 0.095238, 0.083333, 0.086957, -0.076923],
    "zscore": [N, N, 0, 1.091089, 0.218218, 1.091089, 0.218218, -1],
    "percentile": [N, N, N, 1, 0.666667, 1, 0.666667, 0.333333],
    "smooth": [N, N, N, 0.631881, 0.675842, 0.697822, 0.763763, 0.697822],
    "ema": [N, N, 10.5, 11.25, 11.375, 12.1875, 12.34375, 12.171875],
    "rsi": [N, N, N, 83.333333, 66.666667, 82.45614, 66.666667, 51.790634],
    "atr": [N, N, 1.1, 1.4, 1.233333, 1.488889, 1.292593, 1.161728],
}


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("x", i, c, c + 0.5, c - 0.4, float(c)) for i, c in enumerate(map(float, CLOSE))]
    rows += [("y", i, c, c + 0.5, c - 0.4, 2 * c) for i, c in enumerate(map(float, CLOSE[:2]))]
    return spark.createDataFrame(rows, "symbol string, t int, open double, high double, low double, close double").repartition(3)


def same(got, want):
    return all(b is None if a is None else b is not None and abs(a - b) < 1e-5 for a, b in zip(want, got, strict=True))


def column(df, name):
    return [r[name] for r in df.where("symbol = 'x'").orderBy("t").collect()]


def test_windows(bars):
    rows = bars.withColumn("sd", K.rolling_stdev("close", 3)).select(
        "symbol", "t", K.sma("close", 3).alias("sma"), "sd", F.col("sd").alias("stdev"), K.rolling_max("high", 3).alias("high"), K.roc("close", 2).alias("roc"),
        K.zscore("close", 3).alias("zscore"), K.rolling_percentile("close", 4).alias("percentile"), K.smooth("sd", 4).alias("smooth"),
    )
    for name in ("sma", "stdev", "high", "roc", "zscore", "percentile", "smooth"):
        assert same(column(rows, name), WANT[name]), name
    assert all(r["sma"] is None for r in rows.where("symbol = 'y'").collect())


def test_recursions(bars):
    for name, df in (("ema", K.ema(bars, 3)), ("ema", K.ema_native(bars, 3)), ("rsi", K.rsi(bars, 3)), ("atr", K.atr(bars, 3))):
        assert same(column(df, name), WANT[name]), name


def test_arrays():
    c = np.array(CLOSE, float)
    made = {"sma": A.sma(c, 3), "stdev": A.stdev(c, 3), "high": A.highest(c + 0.5, 3), "roc": A.roc(c, 2), "zscore": A.zscore(c, 3), "percentile": A.percentile(c, 4), "smooth": A.smooth(A.stdev(c, 3), 4)}
    for name, v in made.items():
        assert same([None if math.isnan(x) else x for x in v], WANT[name]), name
    assert np.isnan(A.sma(c, 9)).all() and K.rsi_of(CLOSE, 8) == [None] * 8


def test_moments(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9, 11)], "x double")
    r = df.agg(S.skew("x").alias("s"), S.excess_kurtosis("x").alias("k"), S.quantile("x", 0.95).alias("q"), S.upper_median("x").alias("m")).first()
    assert abs(r["s"] - 0.46704553) < 1e-8 and abs(r["k"] + 2.10671642) < 1e-8 and abs(r["q"] - 10.6) < 1e-9 and r["m"] == 4
    one = df.limit(1).agg(S.variance("x").alias("v"), S.skew("x").alias("s"), S.correlation("x", "x").alias("c"), S.mean("x").alias("m")).first()
    assert (one["v"], one["s"], one["c"]) == (0, 0, 0)
    assert df.limit(0).agg(S.mean("x").alias("m"), S.median("x").alias("q")).first() == (0, 0)


def test_constant_series_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert df.agg(S.correlation("x", "y").alias("c")).first()["c"] == 0


def test_common_calendar_and_packing(spark):
    import datetime as dt

    day = [dt.date(2020, 1, d) for d in (1, 2, 3, 6)]
    rows = [("a", d, 1.0 + i, 2.0, 0.5, 1.5, 1.0) for i, d in enumerate(day)] + [("b", d, 1.0, 2.0, 0.5, 1.5, 1.0) for d in day[1:]]
    df = B.on_common_calendar(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double"))
    assert sorted((r["symbol"], r["t"], r["date"]) for r in df.collect()) == [(s, i, d) for s in "ab" for i, d in enumerate(day[1:])]
    cols = ["symbol", "t", "date", "open", "high", "low", "close", "volume"]
    assert sorted(B.unpack(B.pack(df)).select(cols).collect()) == sorted(df.select(cols).collect())


def test_no_look_ahead(bars):
    """Results up to a bar do not change when later bars are dropped."""
    cols = [K.sma("close", 3).alias("a"), K.zscore("close", 3).alias("b"), K.rolling_percentile("close", 4).alias("c"), K.roc("close", 2).alias("d")]
    full = bars.select("symbol", "t", *cols).where("t < 6").collect()
    cut = bars.where("t < 6").select("symbol", "t", *cols).collect()
    assert sorted(map(str, full)) == sorted(map(str, cut))
