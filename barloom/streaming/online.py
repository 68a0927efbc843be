"""An online backtest: a latched channel rule per symbol whose ledger grows as bars arrive.

The rule: a close above the highest high of the last `entry` bars opens the long side, one below the lowest low the short side; a
close beyond the channel of the last `leave` bars on the other side closes it, and a closed bar may open the next side. A symbol
without a bar for `idle` is closed at its last close. The state of a symbol is those last bars, the side and where it was opened: of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.signals import latch

TRADES = "symbol string, direction int, opened timestamp, closed timestamp, entry_price double, exit_price double, reason string"


@dataclass
class Rule:
    entry: int = 20
    leave: int = 10
    idle_us: int = 6 * 3_600_000_000


@dataclass
class Book:
    """What is known of a symbol between bars. Times are microseconds."""

    highs: list[float] = field(default_factory=list)
    lows: list[float] = field(default_factory=list)
    side: int = 0
    opened: int = 0
    price: float = 0.0
    last: int = 0
    close: float = 0.0

    def expire(self, now: int, rule: Rule) -> tuple | None:
        """Closes a side whose symbol has been silent for too long."""
        if self.side and now - self.last > rule.idle_us:
            return self._closed(self.last + rule.idle_us, self.close, "expired")
        return None

    def step(self, at: int, high: float, low: float, close: float, rule: Rule) -> list[tuple]:
        """The trades that a bar closes."""
        out = [t for t in [self.expire(at, rule)] if t]
        n, m = len(self.highs), rule.leave
        if self.side and n >= m:
            beyond = close < min(self.lows[-m:]) if self.side > 0 else close > max(self.highs[-m:])
            if beyond:
                out.append(self._closed(at, close, "signal"))
        if not self.side and n >= rule.entry:
            side = 1 if close > max(self.highs[-rule.entry :]) else -1 if close < min(self.lows[-rule.entry :]) else 0
            if side:
                self.side, self.opened, self.price = side, at, close
        keep = max(rule.entry, rule.leave)
        self.highs, self.lows = [*self.highs, high][-keep:], [*self.lows, low][-keep:]
        self.last, self.close = at, close
        return out

    def _closed(self, at: int, price: float, reason: str) -> tuple:
        trade = (self.side, self.opened, at, self.price, price, reason)
        self.side = 0
        return trade


def _ledger(symbol: str, trades: list[tuple]) -> pd.DataFrame:
    time = lambda k: pd.to_datetime([t[k] for t in trades], unit="us")
    cols = {"direction": 0, "entry_price": 3, "exit_price": 4, "reason": 5}
    out = pd.DataFrame({c: [t[k] for t in trades] for c, k in cols.items()})
    return out.assign(symbol=symbol, opened=time(1), closed=time(2))[["symbol", "direction", "opened", "closed", "entry_price", "exit_price", "reason"]]


class _Online(StatefulProcessor):
    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "highs array<double>, lows array<double>, side int, opened long, price double, last long, close double")

    def _get(self) -> Book:
        if not self.book.exists():
            return Book()
        highs, lows, *rest = self.book.get()
        return Book(list(highs), list(lows), *rest)

    def _put(self, b: Book) -> None:
        self.book.update((b.highs, b.lows, b.side, b.opened, b.price, b.last, b.close))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = self._get()
        bars = pd.concat(list(rows)).sort_values("at")
        trades = [t for at, h, lo, c in zip(bars["at"], bars["high"], bars["low"], bars["close"]) for t in b.step(int(at), float(h), float(lo), float(c), self.rule)]
        self._put(b)
        if b.side:
            self.handle.registerTimer((b.last + self.rule.idle_us) // 1000 + 1)
        if trades:
            yield _ledger(key[0], trades)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = self._get()
        trade = b.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000, self.rule)  # a timer of an older bar finds the symbol alive
        if trade:
            self._put(b)
            yield _ledger(key[0], [trade])

    def close(self) -> None:
        pass


def online_trades(bars: DataFrame, rule: Rule, late: str = "0 seconds") -> DataFrame:
    """The ledger of a stream of bars (symbol, ts, high, low, close): each trade when it closes. Bars of a symbol arrive in order of time, from batch to batch."""
    timed = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("symbol", F.unix_micros("ts").alias("at"), "high", "low", "close")
    return rows.groupBy("symbol").transformWithStateInPandas(_Online(rule), TRADES, "append", "eventTime")


def batch_trades(bars: DataFrame, rule: Rule) -> DataFrame:
    """The same ledger of a whole table: channels by windows, sides by the latch over each run of bars without a silence, trades by islands of equal sides."""
    by = Window.partitionBy("symbol").orderBy("at")
    rows = bars.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "high", "low", "close")
    before = lambda f, c, n: F.when(F.count("*").over(by.rowsBetween(-n, -1)) >= n, f(c).over(by.rowsBetween(-n, -1)))
    silent = F.coalesce(F.col("at") - F.lag("at").over(by) > rule.idle_us, F.lit(False))
    flags = rows.select(
        "symbol", "at", "close", silent.alias("silent"), (F.col("close") > before(F.max, "high", rule.entry)).alias("up"), (F.col("close") < before(F.min, "low", rule.entry)).alias("down"),
        (F.col("close") < before(F.min, "low", rule.leave)).alias("leave_up"), (F.col("close") > before(F.max, "high", rule.leave)).alias("leave_down"),
    ).fillna(False)

    def sides(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("at", ignore_index=True)
        f = {c: p[c].to_numpy(bool) for c in ("silent", "up", "down", "leave_up", "leave_down")}
        # a silence leaves any side before its bar is looked at
        side = latch(f["up"], f["down"], f["leave_up"] | f["silent"], f["leave_down"] | f["silent"], np.zeros(len(p), bool))
        return p[["symbol", "at", "close", "silent", "leave_up", "leave_down"]].assign(side=side.astype(int))

    kept = flags.groupBy("symbol").applyInPandas(sides, "symbol string, at long, close double, silent boolean, leave_up boolean, leave_down boolean, side int")
    prior = F.lag("side", 1, 0).over(by)
    closes = (prior != 0) & (F.col("silent") | F.when(prior > 0, F.col("leave_up")).otherwise(F.col("leave_down")))
    opens = (F.col("side") != 0) & (closes | (prior == 0))
    marked = kept.select("*", closes.alias("closes"), opens.alias("opens"), prior.alias("was"), F.lag("at").over(by).alias("last_at"), F.lag("close").over(by).alias("last_close"))
    held = Window.partitionBy("symbol").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("opens"), F.struct("at", "close")), ignorenulls=True).over(held)
    time = lambda c: F.timestamp_micros(c)
    return marked.withColumn("o", opened).where("closes").select(
        "symbol", F.col("was").alias("direction"), time(F.col("o.at")).alias("opened"), time(F.when(F.col("silent"), F.col("last_at") + rule.idle_us).otherwise(F.col("at"))).alias("closed"),
        F.col("o.close").alias("entry_price"), F.when(F.col("silent"), F.col("last_close")).otherwise(F.col("close")).alias("exit_price"), F.when(F.col("silent"), "expired").otherwise("signal").alias("reason"),
    )
