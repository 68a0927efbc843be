"""Path-dependent backtest: the bars of a symbol are stepped once for a block of genomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RESIZE_TOLERANCE
from .arrays import Series
from .signals import signals

#: Blocks that the genomes of a symbol are dealt to, and the least partitions of all blocks. Blocks are work, not bytes: adaptive
#: execution would put them into one task, but leaves a number of partitions that is asked for as it is.
BLOCKS, PARTITIONS = 3, 32


@dataclass
class Risk:
    vol_target: float
    max_leverage: float
    stop_atr: float = 0.0
    take_atr: float = 0.0
    max_hold: int = 0
    cool_down: int = 0


@dataclass
class Result:
    """One genome's path and ledger: entry, exit, direction, return, bars, reason."""

    ret: np.ndarray
    position: np.ndarray
    equity: np.ndarray
    trades: list[tuple[int, int, int, float, int, str]]
    turnover: float


def size(vol: Column, vol_target, max_leverage, direction) -> Column:
    """Exposure that brings a year's volatility to the target, within the leverage; 0 if it is missing."""
    raw = F.when(vol.isNull() | (vol <= 1e-6), F.lit(0.0)).otherwise(F.try_divide(vol_target, vol))
    return F.greatest(F.lit(0.0), F.least(max_leverage, raw)) * direction


_REASONS = np.array(["stop", "target", "timeout", "signal", "end"], dtype=object)
_STOP, _TARGET, _TIMEOUT, _SIGNAL, _END = range(5)


def run(high, low, close, wanted: np.ndarray, vol, atr, risks: list[Risk], fee: float) -> list[Result]:
    """Step the bars once, for all genomes of a block at a time, one array operation for each rule.

    wanted: target exposure by bar and genome; vol, atr: for sizing and levels, NaN if missing; fee: per unit of change.
    A bar first earns on the exposure carried into it, ended by a stop, a target or a
    timeout, in this order; then the exposure for the next bar is set and its change charged.
    """
    high, low, close, vol, atr = (np.asarray(x, np.float64) for x in (high, low, close, vol, atr))
    n, k = wanted.shape
    target_vol, leverage, stop_atr, take_atr, hold, cool = (np.array([getattr(r, f) for r in risks], np.float64) for f in Risk.__dataclass_fields__)
    aims = np.nan_to_num(wanted, nan=0.0)
    ways = np.sign(aims)
    ret, position = np.zeros((n, k)), np.zeros((n, k))
    carried, side, growth, held = np.zeros(k), np.ones(k), np.ones(k), np.zeros(k)
    stop, goal, wait, turnover = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros(k)
    began = np.full(k, -1)
    ledger: list[tuple[np.ndarray, ...]] = []

    def close_trades(which: np.ndarray, t: int, reason) -> None:
        """Writes the open trades of `which` down and clears their books."""
        rows = np.flatnonzero(which & (began >= 0))
        if len(rows):
            why = reason[rows] if isinstance(reason, np.ndarray) else np.full(len(rows), reason)
            ledger.append((rows, began[rows], np.full(len(rows), t), side[rows], growth[rows] - 1, np.maximum(1, t - began[rows]), why))
        began[which], growth[which], held[which], stop[which], goal[which] = -1, 1.0, 0.0, 0.0, 0.0

    for t in range(1, n):
        position[t] = carried
        on = carried != 0
        earned, ended, start = np.zeros(k), None, carried
        if on.any():
            up = side > 0
            stopped = on & (stop > 0) & np.where(up, low[t] <= stop, high[t] >= stop)
            taken = on & ~stopped & (goal > 0) & np.where(up, high[t] >= goal, low[t] <= goal)
            fill = np.where(stopped, stop, np.where(taken, goal, close[t]))
            earned = np.where(on, carried * (fill / close[t - 1] - 1), 0.0)
            goes_on = on & ~stopped & ~taken
            held += goes_on
            timed = goes_on & (hold > 0) & (held >= hold)
            ended = stopped | taken | timed
            if ended.any():
                size_ = np.where(ended, np.abs(carried), 0.0)
                earned -= size_ * fee
                turnover += size_
                growth = np.where(ended, growth * (1 + earned), growth)
                close_trades(ended, t, np.where(stopped, _STOP, np.where(taken, _TARGET, _TIMEOUT)))
                start, wait = np.where(ended, 0.0, carried), np.where(ended, cool, wait)
        way, live = ways[t], start != 0
        enters = ~live & (way != 0) & (wait <= 0)
        side = np.where(enters, way, side)
        raw = np.zeros(k) if np.isnan(vol[t]) or vol[t] <= 1e-6 else target_vol / vol[t]
        sized = np.minimum(leverage, np.maximum(0.0, raw)) * side * np.abs(aims[t])
        resized = live & (way == side) & (np.abs(sized - start) > RESIZE_TOLERANCE * np.abs(start))
        fresh = enters & (np.abs(sized) >= 1e-4)
        after = np.where(resized | fresh, sized, np.where(live & (way == side), start, 0.0))
        wait = np.where(wait > 0, wait - 1, wait)
        change = np.abs(after - start)
        moved = change > 1e-9
        if moved.any():
            paid = np.where(moved, change, 0.0)
            earned = earned - paid * fee
            turnover += paid
            leaves = moved & live & (after == 0)
            if leaves.any():
                growth = np.where(leaves, growth * (1 + earned), growth)
                close_trades(leaves, t, _SIGNAL)
            opens = moved & ~live & (after != 0)
            if opens.any():
                began[opens], growth[opens], held[opens] = t, 1.0, 0.0
                known = not np.isnan(atr[t])
                level = lambda distance: np.where((distance != 0) & known, np.maximum(0.0, close[t] + side * distance * (atr[t] if known else 0.0)), 0.0)
                stop, goal = np.where(opens, level(-stop_atr), stop), np.where(opens, level(take_atr), goal)
        grows = (began >= 0) & (after != 0)
        if ended is not None:
            grows &= ~ended
        growth = np.where(grows, growth * (1 + earned), growth)
        ret[t], carried = earned, after
    close_trades(carried != 0, n - 1, _END)
    return _results(ret, position, turnover, ledger)


def _results(ret: np.ndarray, position: np.ndarray, turnover: np.ndarray, ledger: list[tuple[np.ndarray, ...]]) -> list[Result]:
    equity = np.cumprod(1 + ret, axis=0)
    rows = [np.concatenate(x) for x in zip(*ledger)] if ledger else [np.zeros(0, np.int64)] * 7
    order = np.argsort(rows[0], kind="stable")  # within a genome in order of time
    which, *cols = (x[order] for x in rows)
    trades: list[list[tuple]] = [[] for _ in turnover]
    for g, a, b, way, gain, bars, why in zip(which.tolist(), *(c.tolist() for c in cols)):
        trades[g].append((a, b, int(way), gain, bars, _REASONS[int(why)]))
    return [Result(ret[:, g], position[:, g], equity[:, g], trades[g], float(turnover[g])) for g in range(len(turnover))]


def evaluate(s: Series, genomes: list[tuple[str, dict, str]], risks: list[Risk], fee: float) -> list[Result]:
    """Backtests of (family, params, side) with their risk settings, all on one symbol."""
    want = np.round(signals(s, genomes), 10)
    return run(s.high, s.low, s.close, want, s.get("size_vol"), s.get("size_atr"), risks, fee)


# --- on Spark ---------------------------------------------------------------------


def unknown_symbols(genomes: DataFrame, packed: DataFrame) -> DataFrame:
    return genomes.join(packed.select("symbol"), "symbol", "left_anti")


def packed_with_market(bars: DataFrame) -> DataFrame:
    """symbol, and open, high, low, close, bench arrays in order of t."""
    from ..sources.bars import equal_weight_index

    market = equal_weight_index(bars).select("t", F.round("ret", 12).alias("bench"))
    rows = bars.join(market, "t").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("t", "open", "high", "low", "close", "bench"))).alias("b"))
    return rows.select("symbol", *(F.col(f"b.{f}").alias(f) for f in ("open", "high", "low", "close", "bench")))


def _risk(r) -> Risk:
    return Risk(*(r[k] for k in Risk.__dataclass_fields__))


def by_block(genomes: DataFrame, packed: DataFrame, work: Callable[[Series, pd.DataFrame], pd.DataFrame], schema: str, blocks: int = BLOCKS) -> DataFrame:
    """What `work` makes of each block of genomes and its symbol's series.

    Genomes alone are dealt, by symbol and a hash into `blocks` blocks; a symbol's packed arrays are
    copied once for each of its blocks, and never for a genome. An unknown symbol drops the genome (see unknown_symbols).
    """
    parts = max(PARTITIONS, int(genomes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = ["genome_id", "family", "symbol", "side", "params", "risk"]
    dealt = genomes.select(*cols).withColumn("block", F.pmod(F.xxhash64("genome_id"), F.lit(blocks)))
    used = dealt.select("symbol", F.col("block").alias("of_block")).distinct()
    series = used.join(packed, "symbol").withColumnRenamed("symbol", "of_symbol")

    def run_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame()
        row = right.iloc[0]
        return work(Series(*(np.asarray(row[f], np.float64) for f in ("open", "high", "low", "close", "bench"))), left)

    left, right = dealt.repartition(parts, "symbol", "block"), series.repartition(parts, "of_symbol", "of_block")
    return left.groupBy("symbol", "block").cogroup(right.groupBy("of_symbol", "of_block")).applyInPandas(run_block, schema)


def results_of(s: Series, rows: pd.DataFrame, fee: float) -> list[Result]:
    genomes = [(f, dict(p), side) for f, p, side in zip(rows["family"], rows["params"], rows["side"])]
    return evaluate(s, genomes, [_risk(r) for r in rows["risk"]], fee)


_PATH = "genome_id string, ret array<double>, position array<double>, equity array<double>, trades array<struct<entry_t:int,exit_t:int,direction:int,return_pct:double,bars:int,exit_reason:string>>, turnover double"
_TRADE = ("entry_t", "exit_t", "direction", "return_pct", "bars", "exit_reason")


def backtests(genomes: DataFrame, packed: DataFrame, fee: float, blocks: int = BLOCKS) -> DataFrame:
    """genome_id, ret, position, equity, trades, turnover: a row a genome, its path and ledger from one scan."""

    def work(s: Series, rows: pd.DataFrame) -> pd.DataFrame:
        done = results_of(s, rows, fee)
        return pd.DataFrame({
            "genome_id": rows["genome_id"], "ret": [r.ret for r in done], "position": [r.position for r in done], "equity": [r.equity for r in done],
            "trades": [[dict(zip(_TRADE, x)) for x in r.trades] for r in done], "turnover": [r.turnover for r in done],
        })

    return by_block(genomes, packed, work, _PATH, blocks)


def bars_of(done: DataFrame) -> DataFrame:
    """genome_id, t, ret, position, equity of backtests()."""
    at = done.select("genome_id", F.posexplode(F.arrays_zip("ret", "position", "equity")).alias("t", "x"))
    return at.select("genome_id", "t", "x.ret", "x.position", "x.equity")


def trades_of(done: DataFrame) -> DataFrame:
    """The trade ledger of backtests()."""
    return done.select("genome_id", F.explode("trades").alias("x")).select("genome_id", *(f"x.{c}" for c in _TRADE))


def backtest_bars(genomes: DataFrame, packed: DataFrame, fee: float) -> DataFrame:
    return bars_of(backtests(genomes, packed, fee))


def backtest_trades(genomes: DataFrame, packed: DataFrame, fee: float) -> DataFrame:
    return trades_of(backtests(genomes, packed, fee))


def turnover(genomes: DataFrame, packed: DataFrame, fee: float) -> DataFrame:
    return backtests(genomes, packed, fee).select("genome_id", "turnover")
