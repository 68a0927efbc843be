"""Seeded random numbers on the driver, 32-bit state, the same stream for the same seed."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

_M = 0xFFFFFFFF


def mulberry32(seed: int) -> Callable[[], float]:
    """Uniform numbers in [0, 1)."""
    state = seed & _M

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & _M
        z = ((state ^ (state >> 15)) * (state | 1)) & _M
        z ^= (z + ((z ^ (z >> 7)) * (z | 61) & _M)) & _M
        return (z ^ (z >> 14)) / 4294967296

    return draw


def hash_seed(text: str) -> int:
    """FNV-1a over UTF-16 units."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = ((h ^ (raw[k] | raw[k + 1] << 8)) * 0x01000193) & _M
    return h


def gauss(draw: Callable[[], float]) -> float:
    """A standard normal number: the cosine branch of Box and Muller; zeros are drawn again."""

    def positive() -> float:
        while (x := draw()) == 0:
            pass
        return x

    u = positive()
    v = positive()
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def integer(draw: Callable[[], float], low: int, high: int) -> int:
    return low + math.floor(draw() * (high - low + 1))


def between(draw: Callable[[], float], low: float, high: float) -> float:
    return low + draw() * (high - low)


def pick(draw: Callable[[], float], items: Sequence):
    return items[min(len(items) - 1, math.floor(draw() * len(items)))]


def shuffle(draw: Callable[[], float], items: Sequence) -> list:
    """A shuffled copy, from the last place down."""
    out = list(items)
    for k in range(len(out) - 1, 0, -1):
        j = math.floor(draw() * (k + 1))
        out[k], out[j] = out[j], out[k]
    return out
