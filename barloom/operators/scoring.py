"""Fitness, in- and out-of-sample splits, walk-forward folds, robustness and ranks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..schema import Search
from .metrics import Slice, metrics, scores


def split_at(bars: int, ratio: float) -> int:
    """The first out-of-sample bar."""
    return max(460, math.floor(bars * ratio))


def thirds(warmup: int, end: int) -> list[Slice]:
    step = (end - warmup) // 3
    return [(f"third{k + 1}", warmup + k * step, end if k == 2 else warmup + (k + 1) * step) for k in range(3)]


def folds(bars: int, count: int, warmup: int) -> list[tuple[int, int, int, int, int]]:
    """(fold, train start, train end, test start, test end); none if a block has fewer than 60 bars."""
    block = (bars - warmup) // (count + 1)
    if block < 60:
        return []
    cuts = [warmup + block * (k + 1) for k in range(count)]
    return [(k + 1, warmup, c, c, bars if k == count - 1 else c + block) for k, c in enumerate(cuts)]


def objective(name: str, m: dict[str, Column], parts: list[Column] | None = None) -> Column:
    if name == "sharpe":
        return m["sharpe"]
    if name == "calmar":
        return S.clamp(m["calmar"], -5.0, 5.0)
    if name == "return":
        return m["cagr"] * 6
    a = F.array(*parts)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(parts)
    spread = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (len(parts) - 1))
    return mean - 0.55 * spread


def penalised(raw: Column, trades: Column, exposure: Column, drawdown: Column, vol: Column, least_trades: int) -> Column:
    """Fewer trades, little exposure, deep drawdowns and high volatility cost fitness; the result lies in -9..9."""
    few = F.when(trades < least_trades, 1.5 + 0.25 * (least_trades - trades)).otherwise(0.0)
    idle = F.when(exposure < 0.02, 3.0).otherwise(0.0)
    deep = F.when(drawdown < -0.5, (F.abs(drawdown) - 0.5) * 4).otherwise(0.0)
    wild = F.when(vol > 0.6, (vol - 0.6) * 2).otherwise(0.0)
    return S.clamp(S.finite(S.finite(raw, -5.0) - few - idle - deep - wild, -9.0), -9.0, 9.0)


def fitness(bt: DataFrame, trades: DataFrame, market: DataFrame, config: Search, end: int) -> DataFrame:
    """genome_id, raw and fitness of the in-sample span."""
    slices: list[Slice] = [("is", config.warmup, end), *thirds(config.warmup, end)]
    m = metrics(bt, trades, market, slices)
    whole = m.where("slice = 'is'").select("genome_id", "sharpe", "calmar", "cagr", "trades", "exposure", "max_drawdown", "vol")
    parts = m.where("slice <> 'is'").groupBy("genome_id").pivot("slice", [s[0] for s in slices[1:]]).agg(F.first("sharpe"))
    both = whole.join(parts, "genome_id")
    raw = objective(config.objective, {k: F.col(k) for k in ("sharpe", "calmar", "cagr")}, [F.col(s[0]) for s in slices[1:]])
    fit = penalised(raw, F.col("trades"), F.col("exposure"), F.col("max_drawdown"), F.col("vol"), config.min_trades)
    return both.select("genome_id", raw.alias("raw"), fit.alias("fitness"))


def walk_forward(bt: DataFrame, trades: DataFrame, market: DataFrame, bars: int, config: Search) -> DataFrame:
    """genome_id, fold, train_start, train_end, test_start, test_end, sharpe, cagr, max_drawdown."""
    cut = folds(bars, config.folds, config.warmup)
    m = metrics(bt, trades, market, [(str(k), c, d) for k, _, _, c, d in cut])
    table = bt.sparkSession.createDataFrame(cut, "fold int, train_start int, train_end int, test_start int, test_end int")
    return m.withColumn("fold", F.col("slice").cast("int")).join(F.broadcast(table), "fold").select(
        "genome_id", "fold", "train_start", "train_end", "test_start", "test_end", "sharpe", "cagr", "max_drawdown"
    )


def robustness(folded: DataFrame) -> DataFrame:
    """genome_id, robustness: mean less half the spread of fold Sharpes, over their size; 0 for one fold."""
    mean, sd = S.mean("sharpe"), S.stdev("sharpe")
    value = (mean - 0.5 * sd) / F.greatest(F.lit(0.35), F.abs(mean) + 0.35)
    return folded.groupBy("genome_id").agg(F.when(F.count("*") >= 2, S.clamp(value, -1.0, 1.0)).otherwise(0.0).alias("robustness"))


def final_rank(rows: DataFrame) -> DataFrame:
    """rows (genome_id, sharpe, robustness, ...) with rank from 1; ties by genome_id."""
    # survivors are capped before they come here: one task is enough
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("sharpe") + 0.25 * F.col("robustness")), "genome_id")))


def family_stats(rows: DataFrame, families: DataFrame) -> DataFrame:
    """family, count, median_sharpe (upper), best_sharpe; families without rows have zeros."""
    grouped = rows.groupBy("family").agg(F.count("*").alias("count"), S.upper_median("sharpe").alias("median_sharpe"), F.max("sharpe").alias("best_sharpe"))
    return families.join(grouped, "family", "left").select(
        "family", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("median_sharpe", F.lit(0.0)).alias("median_sharpe"), F.coalesce("best_sharpe", F.lit(0.0)).alias("best_sharpe")
    )


def fitness_of(ret: list[float], position: list[float], trades: list[tuple], config: Search, end: int) -> float:
    """fitness() for one result on an executor."""
    r, p = np.array(ret), np.array(position)
    m = scores(r, p, trades, config.warmup, end)
    if config.objective == "robust":
        parts = [scores(r, p, trades, a, b)["sharpe"] for _, a, b in thirds(config.warmup, end)]
        raw = float(np.mean(parts) - 0.55 * np.std(parts, ddof=1))
    else:
        raw = {"sharpe": m["sharpe"], "calmar": min(5.0, max(-5.0, m["calmar"])), "return": m["cagr"] * 6}[config.objective]
    out = raw if math.isfinite(raw) else -5.0
    out -= 1.5 + 0.25 * (config.min_trades - m["trades"]) if m["trades"] < config.min_trades else 0.0
    out -= 3.0 if m["exposure"] < 0.02 else 0.0
    out -= max(0.0, abs(m["max_drawdown"]) - 0.5) * 4 + max(0.0, m["vol"] - 0.6) * 2
    return min(9.0, max(-9.0, out if math.isfinite(out) else -9.0))
