"""Fingerprints of strategies: risk and return features, and coarse period returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..schema import BEHAVIOUR_WEIGHT

# The names of the features, in their order.
FEATURES = (
    "Sharpe", "Sortino", "CAGR", "Volatility", "Max drawdown", "Ulcer", "Win rate", "Profit factor", "Avg hold", "Exposure", "Turnover",
    "Return skew", "Tail ratio", "Benchmark corr", "IS/OOS decay", "Trade count",
)


def _log(x: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), x.cast("double")))


def metric_features(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """genome_id, f0..f15 from in- and out-of-sample metrics; columns follow FEATURES. The bounds of the clamps are fixed values."""
    o = lambda k: F.col(f"o.{k}")
    decay = F.coalesce(S.clamp(F.try_divide(F.col("i.sharpe") - o("sharpe"), F.abs(F.col("i.sharpe"))), -3.0, 3.0), F.lit(0.0))
    cols = [
        S.clamp(o("sharpe"), -4.0, 4.0), S.clamp(o("sortino"), -6.0, 6.0), S.clamp(o("cagr"), -1.0, 2.0), S.clamp(o("vol"), 0.0, 1.2),
        S.clamp(o("max_drawdown"), -1.0, 0.0), S.clamp(o("ulcer"), 0.0, 1.0), S.clamp(o("win_rate"), 0.0, 1.0),
        S.clamp(_log(o("profit_factor")), 0.0, 3.0), S.clamp(_log(o("avg_hold")), 0.0, 6.0), S.clamp(o("exposure"), 0.0, 1.0),
        S.clamp(_log(o("turnover")), 0.0, 8.0), S.clamp(o("skew"), -3.0, 3.0), S.clamp(o("tail_ratio"), 0.0, 4.0),
        S.clamp(o("bench_corr"), -1.0, 1.0), decay, S.clamp(_log(o("trades")), 0.0, 8.0),
    ]
    both = outs.alias("o").join(ins.alias("i"), F.col("o.genome_id") == F.col("i.genome_id"))
    return both.select(F.col("o.genome_id").alias("genome_id"), *(c.alias(f"f{k}") for k, c in enumerate(cols)))


def behaviour(bt: DataFrame, start: int, end: int, buckets: int = 12) -> DataFrame:
    """genome_id, b0..: compounded return of equal parts of [start, end), the last with the rest, in -1..2."""
    names = [f"b{k}" for k in range(buckets)]
    size = (end - start) // buckets
    if end - start <= buckets:
        return bt.select("genome_id").distinct().select("genome_id", *(F.lit(0.0).alias(n) for n in names))
    at = F.least(F.lit(buckets - 1), F.floor((F.col("t") - start) / size)).cast("int")
    rows = bt.where((F.col("t") >= start) & (F.col("t") < end)).withColumn("k", at)
    wide = rows.groupBy("genome_id").pivot("k", list(range(buckets))).agg(F.product(1 + F.col("ret")) - 1)
    return wide.select("genome_id", *(S.clamp(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)), -1.0, 2.0).alias(names[k]) for k in range(buckets)))


def combined(features: DataFrame, signature: DataFrame) -> DataFrame:
    """genome_id, features: one array, the signature weighted."""
    f = [c for c in features.columns if c != "genome_id"]
    b = [c for c in signature.columns if c != "genome_id"]
    return features.join(signature, "genome_id").select("genome_id", F.array(*f, *(F.col(c) * BEHAVIOUR_WEIGHT for c in b)).alias("features"))


def standardised(rows: DataFrame) -> DataFrame:
    """genome_id, z: every column over its mean and spread, spread 0 counting 1, in -6..6."""
    by_column = rows.select(F.posexplode("features").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))
    stats = by_column.agg(F.array_sort(F.collect_list(F.struct("k", "mean", "sd")))).scalar()
    z = F.zip_with("features", "_stats", lambda x, s: S.clamp((x - s["mean"]) / F.when(s["sd"] > 0, s["sd"]).otherwise(1.0), -6.0, 6.0))
    return rows.withColumn("_stats", stats).select("genome_id", z.alias("z"))
