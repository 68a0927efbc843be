"""Records of the engine: search settings, strategy families, parameter and risk bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

TRADING_DAYS = 252
WARMUP = 260
MOST_SURVIVORS = 140
DEDUPE_DISTANCE = 0.05
CURVE_POINTS, MANUAL_POINTS, INSPECT_POINTS = 420, 520, 700
SIZING_WINDOW, ATR_WINDOW, RESIZE_TOLERANCE = 20, 14, 0.2
BEHAVIOUR_WEIGHT = 0.6
STICKINESS, LEAST_VARIANCE = 0.03, 1e-8

BAR_SCHEMA = "symbol string, t int, date date, open double, high double, low double, close double, volume double"
GENOME_SCHEMA = (
    "genome_id string, family string, symbol string, side string, params map<string,double>, "
    "risk struct<vol_target:double,max_leverage:double,stop_atr:double,take_atr:double,max_hold:int,cool_down:int>, "
    "origin string, generation int, parents array<string>"
)
TRADE_SCHEMA = "genome_id string, entry_t int, exit_t int, direction int, return_pct double, bars int, exit_reason string"
BT_SCHEMA = "genome_id string, t int, ret double, position double, equity double"

# The five families with their labels and parameters (low, high, step; step 0 is an integer).
FAMILIES: dict[str, tuple[str, dict[str, tuple[float, float, float]]]] = {
    "trend": ("Trend", {"fast": (3, 60, 0), "slow": (20, 250, 0), "confirm": (5, 150, 0), "band": (0, 0.06, 0.001)}),
    "breakout": (
        "Breakout",
        {"entry": (10, 200, 0), "exit": (5, 100, 0), "volWindow": (10, 120, 0), "volCeil": (0.2, 1, 0.01)},
    ),
    "meanReversion": (
        "Mean Reversion",
        {
            "zWindow": (10, 150, 0), "entryZ": (0.6, 3.2, 0.05), "exitZ": (0, 1.6, 0.05), "rsiWindow": (4, 40, 0),
            "rsiBand": (5, 40, 1),
        },
    ),
    "carry": (
        "Carry",
        {"lookback": (20, 300, 0), "smooth": (2, 60, 0), "threshold": (0.05, 1.6, 0.05), "decay": (0.1, 0.9, 0.05)},
    ),
    "volatility": (
        "Volatility",
        {
            "volWindow": (5, 90, 0), "pctWindow": (60, 600, 0), "lowPct": (0.05, 0.55, 0.01), "highPct": (0.45, 0.98, 0.01),
            "mode": (0, 1, 0),
        },
    ),
}
# Bounds of the risk settings.
RISK = {
    "vol_target": (0.04, 0.35, 0.01), "max_leverage": (0.25, 3, 0.05), "stop_atr": (0, 8, 0.1), "take_atr": (0, 16, 0.1),
    "max_hold": (0, 160, 0), "cool_down": (0, 20, 0),
}
OBJECTIVES = ("sharpe", "calmar", "return", "robust")
EXIT_REASONS = ("signal", "stop", "target", "timeout", "end")


@dataclass(frozen=True)
class Search:
    """Settings of a search run."""

    seed: int = 20260912
    symbols: tuple[str, ...] = ("EQIX", "TECH", "GOLD", "CRUD", "BOND", "DGTL")
    families: tuple[str, ...] = tuple(FAMILIES)
    population: int = 180
    generations: int = 12
    elite_fraction: float = 0.18
    mutation_rate: float = 0.35
    crossover_rate: float = 0.55
    cost_bps: float = 2.0
    slippage_bps: float = 3.0
    vol_target: float = 0.12
    split_ratio: float = 0.62
    folds: int = 5
    regime_states: int = 4
    cluster_count: int | None = None
    min_trades: int = 12
    objective: str = "robust"
    warmup: int = WARMUP
    side: str | None = field(default=None)


def family_label(family: str) -> str:
    return FAMILIES[family][0] if family in FAMILIES else "Mixed"
