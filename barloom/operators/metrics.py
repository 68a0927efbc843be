"""Risk and return metrics of backtests over any slices of the calendar, as aggregations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..schema import TRADING_DAYS

#: name -> whether it is a count
METRICS = (
    "sharpe", "sortino", "calmar", "cagr", "vol", "max_drawdown", "ulcer", "win_rate", "profit_factor", "trades", "avg_hold",
    "exposure", "turnover", "skew", "kurtosis", "tail_ratio", "bench_corr", "best_month", "worst_month",
)
LEAST_BARS = 20
Slice = tuple[str, int, int]  # label, first bar, bar after the last


def sliced(rows: DataFrame, slices: list[Slice], t: str = "t") -> DataFrame:
    """rows once for each slice that holds their bar, with `slice`; no join."""
    if not slices:
        return rows.where(F.lit(False)).withColumn("slice", F.lit("").cast("string"))
    every = F.array(*(F.struct(F.lit(n).alias("slice"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in slices))
    inside = F.filter(every, lambda s: (F.col(t) >= s["a"]) & (F.col(t) < s["b"]))
    return rows.withColumn("slice", F.explode(F.transform(inside, lambda s: s["slice"])))


def with_equity(bars: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds eq and dd: equity from 1, and its distance from the highest so far, 1 included."""
    upto = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    grown = bars.withColumn("eq", F.product(1 + F.col("ret")).over(upto))
    return grown.withColumn("dd", F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(upto)) - 1)


def monthly_returns(bars: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, month (yyyy-MM), ret compounded. bars have date."""
    return bars.groupBy(*by, F.date_format("date", "yyyy-MM").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def _years(n: Column) -> Column:
    return F.greatest(n / TRADING_DAYS, F.lit(1e-6))


def metrics(bt: DataFrame, trades: DataFrame, market: DataFrame, slices: list[Slice]) -> DataFrame:
    """genome_id, slice and the 19 metrics; all 0 for slices of fewer than 20 bars.

    bt (genome_id, t, ret, position), trades (the ledger), market (t, date, bench).
    """
    by = ("genome_id", "slice")
    rows = sliced(bt.select("genome_id", "t", "ret", "position").join(market, "t"), slices)
    order = Window.partitionBy(*by).orderBy("t")
    eq = with_equity(rows, by).withColumn("move", F.abs(F.col("position") - F.lag("position").over(order)))
    # the month's return stands in each of its rows: a window that is dealt as the slice is, where a table of months would be shuffled and joined again
    month = Window.partitionBy(*by, F.date_format("date", "yyyy-MM"))
    eq = eq.withColumn("month", F.product(1 + F.col("ret")).over(month) - 1)
    r = F.col("ret")
    loss = F.when(r < 0, r * r)
    one = eq.groupBy(*by).agg(
        F.count("*").alias("n"), S.mean(r).alias("mu"), S.stdev(r).alias("sd"), F.sum(loss).alias("loss2"), F.count(loss).alias("losses"),
        F.min("dd").alias("max_drawdown"), F.avg(F.col("dd") * F.col("dd")).alias("dd2"), F.max_by("eq", "t").alias("final"),
        F.avg(F.when(F.col("position") != 0, 1.0).otherwise(0.0)).alias("exposure"), F.coalesce(F.sum("move"), F.lit(0.0)).alias("moved"),
        S.skew(r).alias("skew"), S.excess_kurtosis(r).alias("kurtosis"), S.quantile(r, 0.95).alias("p95"), S.quantile(r, 0.05).alias("p05"),
        S.correlation(r, F.col("bench")).alias("bench_corr"), F.max("month").alias("best"), F.min("month").alias("worst"),
    )
    x = F.col("return_pct")
    ledger = sliced(trades, slices, "exit_t").groupBy(*by).agg(
        F.count("*").alias("trades"), F.count(F.when(x > 0, 1)).alias("wins"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("won"),
        F.sum(F.when(x <= 0, -x).otherwise(0.0)).alias("lost"), F.avg("bars").alias("held"),
    )
    every = one.join(ledger, list(by), "left")
    zero = F.lit(0.0)
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    down = F.when(F.col("losses") > 1, F.sqrt(F.col("loss2") / F.col("losses")))
    cagr = F.when(F.col("final") > 0, F.pow("final", 1 / _years(F.col("n"))) - 1).otherwise(-1.0)
    count = F.coalesce("trades", F.lit(0))
    factor = F.when(F.coalesce("lost", zero) > 0, F.try_divide("won", "lost")).when(F.coalesce("won", zero) > 0, 4.0).otherwise(0.0)
    value = {
        "sharpe": S.sharpe(F.col("mu"), F.col("sd")),
        "sortino": F.coalesce(F.try_divide("mu", F.when(down > 0, down)) * year, zero),
        "calmar": F.coalesce(F.try_divide(cagr, F.abs("max_drawdown")), zero),
        "cagr": cagr,
        "vol": F.col("sd") * year,
        "max_drawdown": F.col("max_drawdown"),
        "ulcer": F.sqrt("dd2"),
        "win_rate": F.coalesce(F.try_divide("wins", "trades"), zero),
        "profit_factor": factor,
        "trades": count,
        "avg_hold": F.coalesce("held", zero),
        "exposure": F.col("exposure"),
        "turnover": F.col("moved") / _years(F.col("n")),
        "skew": F.col("skew"),
        "kurtosis": F.col("kurtosis"),
        "tail_ratio": F.coalesce(F.abs(F.try_divide("p95", "p05")), zero),
        "bench_corr": F.col("bench_corr"),
        "best_month": F.greatest(zero, F.coalesce("best", zero)),
        "worst_month": F.least(zero, F.coalesce("worst", zero)),
    }
    enough = F.col("n") >= LEAST_BARS
    return every.select(
        *by, *(F.when(enough, v).otherwise(F.lit(0)).cast("long" if k == "trades" else "double").alias(k) for k, v in value.items())
    )


def masked(bt: DataFrame, path: DataFrame, start: int) -> DataFrame:
    """genome_id, state, sharpe (0 below 15 bars), share and exposure of the bars in each state from `start` on."""
    rows = bt.where(F.col("t") >= start).join(path.select("t", "state"), "t")
    total = Window.partitionBy("genome_id")
    grouped = rows.groupBy("genome_id", "state").agg(
        F.count("*").alias("n"), S.mean("ret").alias("mu"), S.stdev("ret").alias("sd"), F.avg(F.when(F.col("position") != 0, 1.0).otherwise(0.0)).alias("exposure")
    )
    return grouped.select(
        "genome_id", "state", F.when(F.col("n") >= 15, S.sharpe(F.col("mu"), F.col("sd"))).otherwise(0.0).alias("sharpe"),
        (F.col("n") / F.sum("n").over(total)).alias("share"), "exposure",
    )


# --- the same for one result on an executor -----------------------------------------


def scores(ret: np.ndarray, position: np.ndarray, trades: list[tuple], start: int, end: int) -> dict[str, float]:
    """The metrics that a fitness needs."""
    r, end = ret[max(0, start) : end], min(end, len(ret))
    n = len(r)
    if n < LEAST_BARS:
        return dict.fromkeys(("sharpe", "calmar", "cagr", "vol", "max_drawdown", "exposure", "trades"), 0.0)
    sd = float(r.std(ddof=1))
    eq = np.cumprod(1 + r)
    worst = min(0.0, float((eq / np.maximum(1, np.maximum.accumulate(eq)) - 1).min()))
    cagr = float(eq[-1]) ** (1 / max(n / TRADING_DAYS, 1e-6)) - 1 if eq[-1] > 0 else -1.0
    return {
        "sharpe": float(r.mean()) / sd * math.sqrt(TRADING_DAYS) if sd > 0 else 0.0,
        "calmar": cagr / abs(worst) if worst else 0.0,
        "cagr": cagr,
        "vol": sd * math.sqrt(TRADING_DAYS),
        "max_drawdown": worst,
        "exposure": float((position[start:end] != 0).mean()),
        "trades": float(sum(start <= x[1] < end for x in trades)),
    }
