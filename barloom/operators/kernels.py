"""Rolling kernels as window expressions over bars(symbol, t, ...).

The frame of a kernel of width w is the row and the w - 1 rows before it; the result is
null until the frame is full. Recursive averages (exponential, Wilder) run as a fold over
a symbol's packed values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TRADING_DAYS

BY = ("symbol",)


def ordered(by=BY):
    return Window.partitionBy(*by).orderBy("t")


def frame(w: int, by=BY):
    return ordered(by).rowsBetween(-(w - 1), 0)


def full(value: Column, w: int, by=BY) -> Column:
    return F.when(F.row_number().over(ordered(by)) >= w, value)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sound(x: Column, w: int, value: Column, by=BY) -> Column:
    """value where the frame is full and none of its x is missing."""
    return full(F.when(F.count(x).over(frame(w, by)) == w, value), w, by)


def sma(x, w: int, by=BY) -> Column:
    x = _c(x)
    return _sound(x, w, F.avg(x).over(frame(w, by)), by) if w > 0 else F.lit(None).cast("double")


def rolling_stdev(x, w: int, by=BY) -> Column:
    x = _c(x)
    return _sound(x, w, F.stddev_samp(x).over(frame(w, by)), by) if w > 1 else F.lit(None).cast("double")


def rolling_max(x, w: int, by=BY) -> Column:
    return full(F.max(_c(x)).over(frame(w, by)), w, by)


def rolling_min(x, w: int, by=BY) -> Column:
    return full(F.min(_c(x)).over(frame(w, by)), w, by)


def roc(x, w: int, by=BY) -> Column:
    x = _c(x)
    return F.try_divide(x, F.lag(x, w).over(ordered(by))) - 1


def zscore(x, w: int, by=BY) -> Column:
    x = _c(x)
    sd = rolling_stdev(x, w, by)
    return F.try_divide(x - sma(x, w, by), F.when(sd > 0, sd))


def simple_returns(x="close", by=BY) -> Column:
    x = _c(x)
    return F.coalesce(F.try_divide(x, F.lag(x).over(ordered(by))) - 1, F.lit(0.0))


def log_returns(x="close", by=BY) -> Column:
    x = _c(x)
    return F.coalesce(F.ln(x / F.lag(x).over(ordered(by))), F.lit(0.0))


def realized_vol(ret, w: int, by=BY) -> Column:
    """Of simple returns, a year's."""
    return rolling_stdev(ret, w, by) * F.sqrt(F.lit(float(TRADING_DAYS)))


def rolling_percentile(x, w: int, by=BY) -> Column:
    """Share of the other present values of the frame that are at most the row's."""
    x = _c(x)
    held = F.collect_list(x).over(frame(w, by))
    below = F.size(F.filter(held, lambda y: y <= x)) - 1
    return full(F.when(x.isNotNull(), F.try_divide(below.cast("double"), F.size(held) - 1)), w, by)


def smooth(x, w: int, by=BY) -> Column:
    """Mean of the present values of a frame that may be short, if half of w are there."""
    x = _c(x)
    if w <= 1:
        return x
    return F.when(F.count(x).over(frame(w, by)) >= max(1, -(-w // 2)), F.avg(x).over(frame(w, by)))


def true_range(by=BY) -> Column:
    before = F.lag("close").over(ordered(by))
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(wide)


def donchian(w: int, by=BY) -> tuple[Column, Column]:
    return rolling_max("high", w, by), rolling_min("low", w, by)


def vol_percentile(bars: DataFrame, w: int, rank: int, name: str = "vol_pct", by=BY) -> DataFrame:
    """Two stacked windows: realised volatility of `ret`, then its percentile."""
    return bars.withColumn("_rv", realized_vol("ret", w, by)).withColumn(name, rolling_percentile("_rv", rank, by)).drop("_rv")


def carry_ir(bars: DataFrame, lookback: int, width: int, name: str = "carry", by=BY) -> DataFrame:
    """Yearly information ratio of ret over bench_ret, smoothed."""
    spread = bars.withColumn("_spread", F.col("ret") - F.col("bench_ret"))
    sd = rolling_stdev("_spread", lookback, by)
    ir = F.try_divide(sma("_spread", lookback, by), F.when(sd > 0, sd)) * F.sqrt(F.lit(float(TRADING_DAYS)))
    return spread.withColumn("_ir", ir).withColumn(name, smooth("_ir", width, by)).drop("_spread", "_ir")


def regime_observations(index: DataFrame) -> DataFrame:
    """t, date and four observations of an index (t, date, ret): short frames at the start count."""
    w = lambda n: Window.orderBy("t").rowsBetween(-(n - 1), 0)
    short, size, long_ = F.avg("ret").over(w(21)), F.avg(F.abs("ret")).over(w(21)), F.avg(F.abs("ret")).over(w(126))
    ratio = F.ln(F.greatest(F.lit(1e-6), size / F.greatest(F.lit(1e-6), long_)))
    return index.select("t", "date", (short * 100).alias("drift"), (size * 100).alias("size"), (F.avg("ret").over(w(126)) * 100).alias("trend"), ratio.alias("ratio"))


# --- recursive averages ----------------------------------------------------------


def ema_of(x: list[float], w: int) -> list[float | None]:
    """Weight 2 / (w + 1), from the mean of the first w values."""
    out: list[float | None] = [None] * len(x)
    if not 0 < w <= len(x):
        return out
    k, now = 2 / (w + 1), sum(x[:w]) / w
    out[w - 1] = now
    for i in range(w, len(x)):
        now = x[i] * k + now * (1 - k)
        out[i] = now
    return out


def _wilder(x: np.ndarray, w: int, start: int) -> list[float]:
    """Mean of x[start : start + w], then (mean * (w - 1) + x) / w."""
    now = float(x[start : start + w].sum()) / w
    out = [now]
    for v in x[start + w :].tolist():
        now = (now * (w - 1) + v) / w
        out.append(now)
    return out


def rsi_of(x: list[float], w: int) -> list[float | None]:
    out: list[float | None] = [None] * len(x)
    if not 0 < w < len(x):
        return out
    d = np.diff(np.array(x))
    up, down = _wilder(np.where(d >= 0, d, 0.0), w, 0), _wilder(np.where(d < 0, -d, 0.0), w, 0)
    out[w:] = [100.0 if b == 0 else 100 - 100 / (1 + a / b) for a, b in zip(up, down)]
    return out


def atr_of(high: list[float], low: list[float], close: list[float], w: int) -> list[float | None]:
    n = len(close)
    out: list[float | None] = [None] * n
    if not 0 < w < n:
        return out
    h, l, before = np.array(high), np.array(low), np.array(close)[:-1]
    tr = h - l
    tr[1:] = np.maximum(tr[1:], np.maximum(np.abs(h[1:] - before), np.abs(l[1:] - before)))
    out[w - 1 :] = _wilder(tr, w, 0)
    return out


def per_symbol(bars: DataFrame, names: list[str], work: Callable[[pd.DataFrame], dict[str, list]]) -> DataFrame:
    """symbol, t and the new double columns `names`, from each symbol's bars in order of t."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        return pd.DataFrame({"symbol": part["symbol"], "t": part["t"], **work(part)})

    schema = "symbol string, t int, " + ", ".join(f"{n} double" for n in names)
    return bars.groupBy("symbol").applyInPandas(run, schema)


def ema(bars: DataFrame, w: int, x: str = "close") -> DataFrame:
    return per_symbol(bars.select("symbol", "t", x), ["ema"], lambda p: {"ema": ema_of(p[x].tolist(), w)})


def rsi(bars: DataFrame, w: int) -> DataFrame:
    return per_symbol(bars.select("symbol", "t", "close"), ["rsi"], lambda p: {"rsi": rsi_of(p["close"].tolist(), w)})


def atr(bars: DataFrame, w: int) -> DataFrame:
    cols = bars.select("symbol", "t", "high", "low", "close")
    return per_symbol(cols, ["atr"], lambda p: {"atr": atr_of(p["high"].tolist(), p["low"].tolist(), p["close"].tolist(), w)})


def ema_native(bars: DataFrame, w: int, x: str = "close") -> DataFrame:
    """The exponential average as a fold over each bar's last rows, without Python, for series of any length.

    A row further back than `reach` weighs less than 1e-18 of the value, below a double's precision, so the
    fold starts there, from the mean of w rows as at the start of the series.
    """
    k = 2 / (w + 1)
    reach = max(1, math.ceil(math.log(1e-18) / math.log1p(-k))) if k < 1 else 1
    held = F.collect_list(x).over(Window.partitionBy(*BY).orderBy("t").rowsBetween(1 - w - reach, 0))
    seed = F.aggregate(F.slice("held", 1, w), F.lit(0.0), lambda a, e: a + e) / w
    value = F.aggregate(F.slice("held", w + 1, reach), seed, lambda s, e: e * k + s * (1 - k))
    return bars.select("symbol", "t", held.alias("held")).select("symbol", "t", F.when(F.size("held") >= w, value).alias("ema"))


def indicator_table(bars: DataFrame, requests: Iterator[tuple[str, int]]) -> DataFrame:
    """symbol, t, kernel, w, value of each distinct request once: the shared table of a population's indicators."""
    make = {
        "sma": lambda w: sma("close", w), "stdev": lambda w: rolling_stdev("close", w), "roc": lambda w: roc("close", w),
        "zscore": lambda w: zscore("close", w), "high": lambda w: rolling_max("high", w), "low": lambda w: rolling_min("low", w),
        "vol": lambda w: realized_vol("ret", w),
    }
    wanted = sorted(set(requests))
    cols = bars.withColumn("ret", simple_returns())
    wide = cols.select("symbol", "t", *(make[k](w).alias(f"{k}_{w}") for k, w in wanted))
    pairs = F.array(*(F.struct(F.lit(k).alias("kernel"), F.lit(w).alias("w"), F.col(f"{k}_{w}").alias("value")) for k, w in wanted))
    return wide.select("symbol", "t", F.explode(pairs).alias("i")).select("symbol", "t", "i.*")
