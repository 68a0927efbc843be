"""The same kernels on numpy arrays, for work that scans one series: NaN stands for missing.

Used inside Arrow-grouped maps, where a genome's whole series is at hand.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from ..schema import ATR_WINDOW, SIZING_WINDOW, TRADING_DAYS
from .kernels import atr_of, rsi_of


def _framed(x: np.ndarray, w: int, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if 0 < w <= len(x):
        out[w - 1 :] = value(sliding_window_view(x, w))
    return out


def sma(x: np.ndarray, w: int) -> np.ndarray:
    return _framed(x, w, lambda v: v.mean(axis=1))


def stdev(x: np.ndarray, w: int) -> np.ndarray:
    return _framed(x, w, lambda v: v.std(axis=1, ddof=1)) if w > 1 else np.full(len(x), np.nan)


def highest(x: np.ndarray, w: int) -> np.ndarray:
    return _framed(x, w, lambda v: v.max(axis=1))


def lowest(x: np.ndarray, w: int) -> np.ndarray:
    return _framed(x, w, lambda v: v.min(axis=1))


def roc(x: np.ndarray, w: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if w < len(x):
        out[w:] = x[w:] / np.where(x[: len(x) - w] == 0, np.nan, x[: len(x) - w]) - 1
    return out


def zscore(x: np.ndarray, w: int) -> np.ndarray:
    sd = stdev(x, w)
    return (x - sma(x, w)) / np.where(sd > 0, sd, np.nan)


def percentile(x: np.ndarray, w: int) -> np.ndarray:
    def rank(v: np.ndarray) -> np.ndarray:
        n = (~np.isnan(v)).sum(axis=1) - 1
        below = (v <= v[:, -1:]).sum(axis=1) - 1
        return np.where(np.isnan(v[:, -1]) | (n < 1), np.nan, below / np.maximum(n, 1))

    return _framed(x, w, rank)


def smooth(x: np.ndarray, w: int) -> np.ndarray:
    if w <= 1:
        return x.copy()
    v = sliding_window_view(np.concatenate([np.full(w - 1, np.nan), x]), w)
    n = (~np.isnan(v)).sum(axis=1)
    return np.where(n >= max(1, math.ceil(w / 2)), np.nansum(v, axis=1) / np.maximum(n, 1), np.nan)


def returns(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    out[1:] = x[1:] / x[:-1] - 1
    return out


def _nan(x: list) -> np.ndarray:
    return np.array([math.nan if v is None else v for v in x])


@dataclass
class Series:
    """One symbol's bars and the market's returns, with its indicators computed once each."""

    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    bench: np.ndarray
    _kept: dict = field(default_factory=dict)

    def get(self, kernel: str, *w: int) -> np.ndarray:
        key = (kernel, *w)
        if key not in self._kept:
            self._kept[key] = getattr(self, "_" + kernel)(*w)
        return self._kept[key]

    def _ret(self):
        return returns(self.close)

    def _sma(self, w):
        return sma(self.close, w)

    def _roc(self, w):
        return roc(self.close, w)

    def _high(self, w):
        return highest(self.high, w)

    def _low(self, w):
        return lowest(self.low, w)

    def _z(self, w):
        return zscore(self.close, w)

    def _rsi(self, w):
        return _nan(rsi_of(self.close.tolist(), w))

    def _vol(self, w):
        return stdev(self.get("ret"), w) * math.sqrt(TRADING_DAYS)

    def _vol_pct(self, w, rank):
        return percentile(self.get("vol", w), rank)

    def _carry(self, lookback, width):
        spread = self.get("ret") - self.bench
        sd = stdev(spread, lookback)
        return smooth(sma(spread, lookback) / np.where(sd > 0, sd, np.nan) * math.sqrt(TRADING_DAYS), width)

    def _size_vol(self):
        return np.round(self.get("vol", SIZING_WINDOW), 10)

    def _size_atr(self):
        return np.round(_nan(atr_of(self.high.tolist(), self.low.tolist(), self.close.tolist(), ATR_WINDOW)), 10)
