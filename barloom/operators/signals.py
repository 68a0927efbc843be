"""Target exposure of the five strategy families.

Trend and volatility are plain expressions of a bar. The other three are latches: what
opens and closes a side is known bar by bar, and one state is carried along, for all
genomes of a block at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .arrays import Series


def _before(x: np.ndarray) -> np.ndarray:
    """The previous bar's value."""
    return np.concatenate([[np.nan], x[:-1]])


@dataclass
class Latch:
    """What opens and closes a side, by bar, and the size of the exposure while it is open."""

    up: np.ndarray
    down: np.ndarray
    leave_up: np.ndarray
    leave_down: np.ndarray
    off: np.ndarray
    size: np.ndarray | float = 1.0


def latch(up: np.ndarray, down: np.ndarray, leave_up: np.ndarray, leave_down: np.ndarray, off: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 per bar (the first axis). A side is left first, and only a flat state is entered, the long side before the short."""
    on = ~off
    stay_up, stay_down, enter = ~leave_up & on, ~leave_down & on, np.where(up, 1, np.where(down, -1, 0)).astype(np.int8) * on
    out = np.zeros(up.shape, np.int8)
    state = np.zeros(up.shape[1:], np.int8)
    for t in range(len(up)):
        stays = np.where(state > 0, stay_up[t], stay_down[t]) & (state != 0)
        state = np.where(stays, state, enter[t])
        out[t] = state
    return out.astype(np.float64)


def _trend(s: Series, p: dict) -> np.ndarray:
    slow, way = s.get("sma", p["slow"]), s.get("roc", p["confirm"])
    spread = s.get("sma", p["fast"]) / np.where(slow == 0, np.nan, slow) - 1
    return np.where((spread > p["band"]) & (way > 0), 1.0, np.where((spread < -p["band"]) & (way < 0), -1.0, 0.0))


def _breakout(s: Series, p: dict) -> Latch:
    rank = s.get("vol_pct", p["volWindow"], max(60, 4 * p["volWindow"]))
    calm = np.isnan(rank) | (rank <= p["volCeil"])
    c, first = s.close, np.arange(len(s.close)) == 0
    return Latch(
        calm & (c > _before(s.get("high", p["entry"]))), calm & (c < _before(s.get("low", p["entry"]))),
        c < _before(s.get("low", p["exit"])), c > _before(s.get("high", p["exit"])), first,
    )


def _reversion(s: Series, p: dict) -> Latch:
    z, rsi = s.get("z", p["zWindow"]), s.get("rsi", p["rsiWindow"])
    near = np.abs(z) <= p["exitZ"]
    return Latch(
        (z <= -p["entryZ"]) & (rsi <= p["rsiBand"]), (z >= p["entryZ"]) & (rsi >= 100 - p["rsiBand"]), near, near,
        np.isnan(z) | np.isnan(rsi),
    )


def _carry(s: Series, p: dict) -> Latch:
    v, limit = s.get("carry", p["lookback"], p["smooth"]), p["threshold"]
    size = np.minimum(1, np.nan_to_num(np.abs(v)) / max(0.1, 2 * limit))
    return Latch(v > limit, v < -limit, v < limit * p["decay"], v > -limit * p["decay"], np.isnan(v), size)


def _volatility(s: Series, p: dict) -> np.ndarray:
    rank, low, high = s.get("vol_pct", p["volWindow"], p["pctWindow"]), p["lowPct"], p["highPct"]
    flip = -1.0 if p["mode"] == 1 else 1.0
    calm = np.minimum(1, (low - rank) / max(0.05, low) + 0.4)
    wild = np.minimum(1, (rank - high) / max(0.05, 1 - high) + 0.4)
    return flip * np.where(rank <= low, calm, np.where(rank >= high, -wild, 0.0))


RULES = {"trend": _trend, "breakout": _breakout, "meanReversion": _reversion, "carry": _carry, "volatility": _volatility}
_WHOLE = {"fast", "slow", "confirm", "entry", "exit", "volWindow", "zWindow", "rsiWindow", "lookback", "smooth", "pctWindow", "mode"}


def signals(s: Series, genomes: list[tuple[str, dict[str, float], str]]) -> np.ndarray:
    """Target exposure in [-1, 1] of each bar and each (family, params, side); an unknown family stays flat."""
    out, open_ = np.zeros((len(s.close), len(genomes))), {}
    with np.errstate(invalid="ignore", divide="ignore"):
        for k, (family, params, _) in enumerate(genomes):
            if family in RULES:
                p = {name: int(np.floor(v + 0.5)) if name in _WHOLE else v for name, v in params.items()}
                rule = RULES[family](s, p)
                if isinstance(rule, Latch):
                    open_[k] = rule
                else:
                    out[:, k] = rule
    if open_:
        both = list(open_.values())
        state = latch(*(np.stack([getattr(x, f) for x in both], axis=1) for f in ("up", "down", "leave_up", "leave_down", "off")))
        for k, x, column in zip(open_, both, state.T):
            out[:, k] = column * x.size
    side = np.array([x for _, _, x in genomes], dtype=object)
    return np.where(((side == "long") & (out < 0)) | ((side == "short") & (out > 0)), 0.0, out)


def signal(s: Series, family: str, params: dict[str, float], side: str) -> np.ndarray:
    return signals(s, [(family, params, side)])[:, 0]


# --- as expressions ---------------------------------------------------------------


def side_mask(value: Column, side: Column | str) -> Column:
    side = F.lit(side) if isinstance(side, str) else side
    wrong = ((side == "long") & (value < 0)) | ((side == "short") & (value > 0))
    return F.when(wrong, F.lit(0.0)).otherwise(value)


def trend(bars: DataFrame, fast: int, slow: int, confirm: int, band: float) -> DataFrame:
    """symbol, t, signal by windows alone."""
    cols = bars.select("symbol", "t", K.sma("close", fast).alias("f"), K.sma("close", slow).alias("s"), K.roc("close", confirm).alias("r"))
    spread = F.try_divide("f", "s") - 1
    up, down = (spread > band) & (F.col("r") > 0), (spread < -band) & (F.col("r") < 0)
    return cols.select("symbol", "t", F.when(up, 1.0).when(down, -1.0).otherwise(0.0).alias("signal"))


def volatility(bars: DataFrame, vol_window: int, pct_window: int, low: float, high: float, mode: int = 0) -> DataFrame:
    """symbol, t, signal by windows alone."""
    ranked = K.vol_percentile(bars.withColumn("ret", K.simple_returns()), vol_window, pct_window, "p")
    flip = -1.0 if mode == 1 else 1.0
    calm = F.least(F.lit(1.0), (low - F.col("p")) / max(0.05, low) + 0.4) * flip
    wild = F.least(F.lit(1.0), (F.col("p") - high) / max(0.05, 1 - high) + 0.4) * -flip
    return ranked.select("symbol", "t", F.when(F.col("p") <= low, calm).when(F.col("p") >= high, wild).otherwise(0.0).alias("signal"))
