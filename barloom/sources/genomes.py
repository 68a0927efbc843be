"""A fixed list of genomes for queries whose results must not depend on a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.genome import Genome, frame

_NAMES = ("vol_target", "max_leverage", "stop_atr", "take_atr", "max_hold", "cool_down")
# Id, family, symbol, side, parameters, risk in the order of _NAMES.
FIXED = [
    ("g01", "trend", "A", "both", {"fast": 20, "slow": 100, "confirm": 40, "band": 0.002}, (0.12, 2, 0, 0, 0, 0)),
    ("g02", "trend", "R", "long", {"fast": 5, "slow": 30, "confirm": 10, "band": 0}, (0.10, 1, 2.5, 0, 0, 0)),
    ("g03", "breakout", "N", "both", {"entry": 40, "exit": 20, "volWindow": 20, "volCeil": 1}, (0.12, 2, 3, 6, 0, 2)),
    ("g04", "breakout", "A", "short", {"entry": 10, "exit": 5, "volWindow": 10, "volCeil": 0.8}, (0.08, 1.5, 0, 0, 30, 0)),
    ("g05", "meanReversion", "R", "both", {"zWindow": 30, "entryZ": 1.2, "exitZ": 0.3, "rsiWindow": 10, "rsiBand": 40}, (0.12, 2, 0, 0, 0, 0)),
    ("g06", "meanReversion", "N", "long", {"zWindow": 40, "entryZ": 1.2, "exitZ": 0.1, "rsiWindow": 6, "rsiBand": 35}, (0.15, 1, 4, 0, 20, 3)),
    ("g07", "carry", "A", "both", {"lookback": 60, "smooth": 10, "threshold": 0.4, "decay": 0.5}, (0.12, 2, 0, 0, 0, 0)),
    ("g08", "carry", "R", "short", {"lookback": 60, "smooth": 5, "threshold": 0.3, "decay": 0.3}, (0.10, 1, 3, 9, 0, 1)),
    ("g09", "volatility", "N", "both", {"volWindow": 20, "pctWindow": 120, "lowPct": 0.3, "highPct": 0.8, "mode": 0}, (0.12, 2, 0, 0, 0, 0)),
    ("g10", "volatility", "A", "both", {"volWindow": 10, "pctWindow": 250, "lowPct": 0.2, "highPct": 0.7, "mode": 1}, (0.12, 3, 0, 0, 60, 0)),
    ("g11", "meanReversion", "N", "long", {"zWindow": 60, "entryZ": 1.5, "exitZ": 0, "rsiWindow": 14, "rsiBand": 35}, (0.15, 1, 4, 0, 20, 3)),
]


def fixed_genomes() -> list[Genome]:
    return [Genome(i, f, s, side, dict(p), dict(zip(_NAMES, r)), "manual") for i, f, s, side, p, r in FIXED]


def fixed(spark: SparkSession) -> DataFrame:
    return frame(spark, fixed_genomes())
