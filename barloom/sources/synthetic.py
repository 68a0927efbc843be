"""A seeded synthetic universe: latent regimes, a market factor, momentum and jumps.

The streams of the instruments are independent given the market's path, so the driver
draws the path once and each instrument's bars come from one task.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.rng import gauss, hash_seed, mulberry32
from ..schema import BAR_SCHEMA


@dataclass(frozen=True)
class Instrument:
    symbol: str
    label: str
    asset_class: str
    start: float
    beta: float
    drift: float
    noise: float
    momentum: float
    jump_chance: float
    jump_size: float


# The instruments.
INSTRUMENTS = (
    Instrument("EQIX", "Broad Equity Index", "Equity", 2800, 1.0, 0.07, 0.05, 0.05, 0.004, 0.03),
    Instrument("TECH", "Growth / Tech Basket", "Equity", 1400, 1.35, 0.11, 0.12, 0.09, 0.007, 0.045),
    Instrument("DEFN", "Low-Beta Defensives", "Equity", 640, 0.55, 0.05, 0.06, 0.02, 0.003, 0.02),
    Instrument("GOLD", "Gold", "Metals", 1750, -0.25, 0.04, 0.11, 0.04, 0.005, 0.03),
    Instrument("CRUD", "Crude Oil", "Energy", 72, 0.45, 0.02, 0.26, 0.08, 0.012, 0.07),
    Instrument("BOND", "Long Duration Bonds", "Rates", 108, -0.35, 0.02, 0.05, 0.03, 0.002, 0.015),
    Instrument("FXEM", "EM FX Carry Basket", "FX", 96, 0.6, 0.03, 0.08, -0.06, 0.009, 0.04),
    Instrument("DGTL", "Digital Assets", "Crypto", 420, 1.6, 0.18, 0.42, 0.12, 0.018, 0.11),
)
# Name, yearly drift, yearly volatility, mean bars of a stay; and where a state goes when it ends.
REGIMES = (("expansion", 0.18, 0.11, 260), ("chop", 0.02, 0.15, 95), ("stress", -0.3, 0.34, 38), ("recovery", 0.26, 0.2, 75))
LEAVES = ((0.0, 0.62, 0.28, 0.1), (0.5, 0.0, 0.3, 0.2), (0.08, 0.22, 0.0, 0.7), (0.62, 0.28, 0.1, 0.0))


def transitions() -> list[list[float]]:
    """Row-stochastic: a state stays with 1 - 1 / its mean stay."""
    out = []
    for i, (_, _, _, stay) in enumerate(REGIMES):
        leave = 1 - (1 - 1 / stay)
        out.append([1 - 1 / stay if i == j else leave * LEAVES[i][j] for j in range(len(REGIMES))])
    return out


def draw_state(u: float, row: list[float]) -> int:
    """The first state whose cumulative probability reaches u; the last one if none does."""
    total = 0.0
    for k, p in enumerate(row):
        total += p
        if u <= total:
            return k
    return len(row) - 1


def dates(start: str, count: int) -> list[dt.date]:
    day, out = dt.date.fromisoformat(start), []
    while len(out) < count:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def market_path(seed: int, bars: int) -> tuple[list[int], list[float]]:
    """Regime and market return of every bar."""
    draw, rows = mulberry32(seed), transitions()
    state, swell = 0, 1.0
    path, returns = [], []
    for t in range(bars):
        if t:
            state = draw_state(draw(), rows[state])
        _, drift, vol, _ = REGIMES[state]
        swell = min(2.6, max(0.45, 0.92 * swell + 0.08 + 0.12 * gauss(draw)))
        path.append(state)
        returns.append(drift / 252 + vol / math.sqrt(252) * swell * gauss(draw))
    return path, returns


def instrument_bars(seed: int, spec: Instrument, market: list[float]) -> Iterator[tuple[float, float, float, float, float]]:
    """open, high, low, close, volume of one instrument; draws come in a fixed order."""
    draw = mulberry32(seed ^ hash_seed(spec.symbol))
    price, last = spec.start, 0.0
    for t, factor in enumerate(market):
        move = spec.drift / 252 + spec.beta * factor + spec.noise / math.sqrt(252) * gauss(draw) + spec.momentum * last
        if draw() < spec.jump_chance:
            move += spec.jump_size * gauss(draw)
        last = move = min(0.28, max(-0.28, move))
        before, price = price, max(0.5, price * (1 + move))
        body = abs(move) + 0.004
        opened = before * (1 + 0.28 * body * gauss(draw)) if t else spec.start
        high = max(opened, price) * (1 + abs(gauss(draw)) * body * 0.6)
        low = max(0.2, min(opened, price) * (1 - abs(gauss(draw)) * body * 0.6))
        volume = math.floor(1e6 * (1 + 3 * abs(move) / body) * (0.7 + 0.6 * draw()) + 0.5)
        yield opened, high, low, price, float(volume)


def synthetic(spark: SparkSession, seed: int = 20260912, bars: int = 3024, start: str = "2013-01-02") -> DataFrame:
    """Bars of all instruments, one task each."""
    _, market = market_path(seed, bars)
    days = dates(start, bars)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                made = list(instrument_bars(seed, Instrument(*row), market))
                frame = pd.DataFrame(made, columns=["open", "high", "low", "close", "volume"])
                frame.insert(0, "date", days)
                frame.insert(0, "t", range(bars))
                frame.insert(0, "symbol", row[0])
                yield frame

    names = "symbol string, label string, asset_class string, start double, beta double, drift double, noise double, momentum double, jump_chance double, jump_size double"
    rows = [tuple(float(v) if isinstance(v, int) else v for v in astuple(i)) for i in INSTRUMENTS]
    specs = spark.createDataFrame(rows, names).repartition(len(rows), "symbol")
    return specs.mapInPandas(run, BAR_SCHEMA)


def true_regimes(spark: SparkSession, seed: int = 20260912, bars: int = 3024) -> DataFrame:
    """t, state, name of the latent regimes."""
    path, _ = market_path(seed, bars)
    return spark.createDataFrame([(t, s, REGIMES[s][0]) for t, s in enumerate(path)], "t int, state int, name string")
