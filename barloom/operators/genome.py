"""Genomes: drawing, repair, change, distance, and what they say in words."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng as R
from ..schema import FAMILIES, GENOME_SCHEMA, RISK

Draw = Callable[[], float]
SIDES = ("long", "short", "both")


@dataclass
class Genome:
    genome_id: str
    family: str
    symbol: str
    side: str
    params: dict[str, float]
    risk: dict[str, float]
    origin: str = "seed"
    generation: int = 0
    parents: list[str] = field(default_factory=list)

    def row(self) -> tuple:
        r = self.risk
        risk = (*(float(r[k]) for k in ("vol_target", "max_leverage", "stop_atr", "take_atr")), int(r["max_hold"]), int(r["cool_down"]))
        params = {k: float(v) for k, v in self.params.items()}
        return self.genome_id, self.family, self.symbol, self.side, params, risk, self.origin, self.generation, self.parents or None


class Ids:
    """Ids of one run: a counter in base 36."""

    def __init__(self) -> None:
        self.n = 0

    def __call__(self) -> str:
        self.n = (self.n + 1) % 1_000_000
        digits, n = "", self.n
        while n or not digits:
            n, d = divmod(n, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return "s" + digits.rjust(4, "0")


def coerce(bounds: tuple[float, float, float], value: float) -> float:
    """Into the bounds and onto the step; step 0 makes whole numbers, halves up."""
    low, high, step = bounds
    v = min(high, max(low, value))
    if not step:
        return math.floor(v + 0.5)
    return round(math.floor(v / step + 0.5) * step, max(0, math.ceil(-math.log10(step) - 1e-12)))


class Apart(NamedTuple):
    """A parameter that must stand apart from another one: it is `low` if at most times * other + plus, or too high if at
    least other. It then becomes of * other + the larger of `least` and the rounded share * other (or `shift`, without a share),
    at most `most`."""

    family: str
    key: str
    low: bool
    other: str
    times: float = 1.0
    plus: float = 0.0
    of: float = 0.0
    share: float = 0.0
    shift: float = 0.0
    least: float = -math.inf
    most: float = math.inf


# Parameters that must stand apart, in the order in which they are looked at.
APART = (
    Apart("trend", "slow", True, "fast", of=1, share=0.8, least=5),
    Apart("breakout", "exit", False, "entry", share=0.5, least=5),
    Apart("meanReversion", "exitZ", False, "entryZ", of=1, shift=-0.4),
    Apart("carry", "smooth", False, "lookback", share=0.25, least=2),
    Apart("volatility", "highPct", True, "lowPct", plus=0.05, of=1, shift=0.2, most=0.98),
    Apart("volatility", "pctWindow", True, "volWindow", times=2, of=3),
)
# What a parameter is never beyond after that.
AT_LEAST, AT_MOST = {"exitZ": 0.0}, {"slow": 250.0}


def repair(family: str, p: dict[str, float]) -> dict[str, float]:
    """Parameters that must stand apart are moved apart."""
    p = dict(p)
    for r in APART:
        if r.family == family:
            other = p[r.other]
            if p[r.key] <= r.times * other + r.plus if r.low else p[r.key] >= other:
                added = max(r.least, math.floor(r.share * other + 0.5) if r.share else r.shift)
                p[r.key] = max(AT_LEAST.get(r.key, -math.inf), min(r.most, r.of * other + added))
            p[r.key] = min(AT_MOST.get(r.key, math.inf), p[r.key])
    return p


def _target(x: float) -> float:
    return min(0.4, max(0.03, x))


def _fresh(draw: Draw, bounds: tuple[float, float, float]) -> float:
    low, high, step = bounds
    return coerce(bounds, R.between(draw, low, high) if step else R.integer(draw, int(low), int(high)))


def _sometimes(draw: Draw, never: float, make: Callable[[], float]) -> float:
    return 0 if draw() < never else make()


def random_risk(draw: Draw, vol_target: float) -> dict[str, float]:
    return {
        "vol_target": _target(vol_target * R.between(draw, 0.6, 1.4)),
        "max_leverage": coerce(RISK["max_leverage"], R.between(draw, 0.5, 2.2)),
        "stop_atr": _sometimes(draw, 0.45, lambda: coerce(RISK["stop_atr"], R.between(draw, 1, 6))),
        "take_atr": _sometimes(draw, 0.6, lambda: coerce(RISK["take_atr"], R.between(draw, 2, 12))),
        "max_hold": _sometimes(draw, 0.55, lambda: R.integer(draw, 5, 120)),
        "cool_down": _sometimes(draw, 0.7, lambda: R.integer(draw, 1, 10)),
    }


def random_genome(draw: Draw, ids: Ids, families: Sequence[str], symbols: Sequence[str], vol_target: float, generation: int = 0) -> Genome:
    family = R.pick(draw, list(families) or list(FAMILIES))
    params = repair(family, {k: _fresh(draw, b) for k, b in FAMILIES[family][1].items()})
    name = ids()
    symbol, side = R.pick(draw, symbols), R.pick(draw, SIDES)
    return Genome(name, family, symbol, side, params, random_risk(draw, vol_target), "seed", generation)


def mutate(draw: Draw, ids: Ids, g: Genome, rate: float, symbols: Sequence[str], generation: int) -> Genome:
    """Each gene changes with its chance: parameters are drawn anew or moved by up to 22 % of their range."""
    params = dict(g.params)
    for k, b in FAMILIES[g.family][1].items():
        if draw() <= rate:
            moved = _fresh(draw, b) if draw() < 0.15 else params[k] + (2 * draw() - 1) * (b[1] - b[0]) * 0.22
            params[k] = coerce(b, moved)
    params, risk = repair(g.family, params), dict(g.risk)
    change = {
        "vol_target": (rate, lambda: _target(risk["vol_target"] * R.between(draw, 0.75, 1.3))),
        "max_leverage": (rate, lambda: coerce(RISK["max_leverage"], risk["max_leverage"] * R.between(draw, 0.75, 1.35))),
        "stop_atr": (rate, lambda: _sometimes(draw, 0.3, lambda: coerce(RISK["stop_atr"], R.between(draw, 1, 6)))),
        "take_atr": (rate, lambda: _sometimes(draw, 0.45, lambda: coerce(RISK["take_atr"], R.between(draw, 2, 12)))),
        "max_hold": (rate * 0.6, lambda: _sometimes(draw, 0.4, lambda: R.integer(draw, 5, 120))),
        "cool_down": (rate * 0.4, lambda: _sometimes(draw, 0.6, lambda: R.integer(draw, 1, 10))),
    }
    for k, (chance, make) in change.items():
        if draw() < chance:
            risk[k] = make()
    name = ids()
    symbol = R.pick(draw, symbols) if draw() < rate * 0.35 else g.symbol
    side = R.pick(draw, SIDES) if draw() < rate * 0.3 else g.side
    return Genome(name, g.family, symbol, side, params, risk, "mutation", generation, [g.genome_id])


def crossover(draw: Draw, ids: Ids, a: Genome, b: Genome, generation: int) -> Genome:
    """Of one family: parameters blended one by one. Of two: a's rules. Risk is blended either way."""
    params = dict(a.params)
    if a.family == b.family:
        for k, bounds in FAMILIES[a.family][1].items():
            w = draw()
            params[k] = coerce(bounds, a.params[k] * w + b.params[k] * (1 - w))
        params = repair(a.family, params)
    name = ids()
    either = lambda x, y: x if draw() < 0.5 else y
    symbol, side = either(a.symbol, b.symbol), either(a.side, b.side)
    w = draw()
    risk = {
        "vol_target": _target(a.risk["vol_target"] * w + b.risk["vol_target"] * (1 - w)),
        "max_leverage": coerce(RISK["max_leverage"], a.risk["max_leverage"] * w + b.risk["max_leverage"] * (1 - w)),
    }
    risk |= {k: either(a.risk[k], b.risk[k]) for k in ("stop_atr", "take_atr", "max_hold", "cool_down")}
    return Genome(name, a.family, symbol, side, params, risk, "crossover", generation, [a.genome_id, b.genome_id])


def distance(a: Genome, b: Genome) -> float:
    """0 to 1; 1 between families."""
    if a.family != b.family:
        return 1.0
    parts = [abs(a.params[k] - b.params[k]) / ((hi - lo) or 1) for k, (lo, hi, _) in FAMILIES[a.family][1].items()]
    parts += [float(a.symbol != b.symbol), abs(a.risk["vol_target"] - b.risk["vol_target"]) / 0.37, 0.5 * (a.side != b.side)]
    return min(1.0, max(0.0, sum(parts) / len(parts)))


def manual(g: Genome, **changes) -> Genome:
    """A genome edited by hand, in bounds and repaired."""
    made = replace(g, origin="manual", **changes)
    spec = FAMILIES[made.family][1]
    return replace(made, params=repair(made.family, {k: coerce(b, made.params[k]) for k, b in spec.items()}))


def frame(spark: SparkSession, genomes: Sequence[Genome]) -> DataFrame:
    return spark.createDataFrame([g.row() for g in genomes], GENOME_SCHEMA)


# --- as expressions ---------------------------------------------------------------


def coerce_column(value: Column, low: Column, high: Column, step: Column) -> Column:
    """coerce() for a column of values with the bounds of their parameter."""
    v = F.greatest(low, F.least(high, value))
    digits = F.greatest(F.lit(0.0), F.ceil(-F.log10(F.when(step > 0, step)) - 1e-12).cast("double"))
    scale = F.pow(F.lit(10.0), digits)
    snapped = F.floor(F.try_divide(v, F.when(step > 0, step)) + 0.5) * step
    return F.when(step > 0, F.round(snapped * scale) / scale).otherwise(F.floor(v + 0.5).cast("double"))


def repair_column(family: Column, params: Column) -> Column:
    """repair() on the params map."""
    p = lambda k: F.try_element_at(params, F.lit(k))
    number = lambda x: F.lit(float(x))
    new: dict[str, dict[str, Column]] = {}
    for r in APART:
        other, own = p(r.other), p(r.key)
        added = F.greatest(number(r.least), F.floor(r.share * other + 0.5).cast("double") if r.share else number(r.shift))
        moved = F.greatest(number(AT_LEAST.get(r.key, -math.inf)), F.least(number(r.most), r.of * other + added))
        wrong = own <= r.times * other + r.plus if r.low else own >= other
        new.setdefault(r.family, {})[r.key] = F.least(number(AT_MOST.get(r.key, math.inf)), F.when(wrong, moved).otherwise(own))
    out = params
    for name, changed in new.items():
        out = F.when(family == name, F.transform_values(params, _replacing(changed))).otherwise(out)
    return out


def _replacing(changed: dict[str, Column]) -> Callable[[Column, Column], Column]:
    return lambda k, v: F.coalesce(*(F.when(k == name, x) for name, x in changed.items()), v)


def distances(genomes: DataFrame) -> DataFrame:
    """a, b, distance of every pair a < b; families first, so that pairs are only made within one."""
    g = genomes.select("genome_id", "family", "symbol", "side", "params", F.col("risk.vol_target").alias("vol"))
    one, two = (g.select("family", *(F.col(c).alias(f"{c}_{k}") for c in g.columns if c != "family")) for k in (1, 2))
    pairs = one.join(two, "family").where("genome_id_1 < genome_id_2")
    span = F.create_map(*(x for k, v in _family_spans().items() for x in (F.lit(k), F.lit(float(v)))))
    keys = F.map_keys("params_1")
    apart = lambda k: F.abs(F.element_at("params_1", k) - F.element_at("params_2", k))
    diff = F.aggregate(keys, F.lit(0.0), lambda s, k: s + apart(k) / F.element_at(span, F.concat_ws(".", "family", k)))
    extra = (F.col("symbol_1") != F.col("symbol_2")).cast("double") + F.abs(F.col("vol_1") - F.col("vol_2")) / 0.37
    extra += F.when(F.col("side_1") == F.col("side_2"), 0.0).otherwise(0.5)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (diff + extra) / (F.size(keys) + 3)))
    return pairs.select(F.col("genome_id_1").alias("a"), F.col("genome_id_2").alias("b"), near.alias("distance"))


def _family_spans() -> dict[str, float]:
    return {f"{f}.{k}": (hi - lo) or 1 for f, (_, p) in FAMILIES.items() for k, (lo, hi, _) in p.items()}


def name_column(genomes: DataFrame) -> Column:
    """Family.SYMBOL.p1-p2 of the first two parameters, two decimals unless whole."""
    label = F.create_map(*(x for f, (text, _) in FAMILIES.items() for x in (F.lit(f), F.lit(text.replace(" ", "")))))
    firsts = F.create_map(*(x for f, (_, p) in FAMILIES.items() for x in (F.lit(f), F.array(*map(F.lit, list(p)[:2])))))
    text = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.2f", v))
    keys = F.element_at(firsts, F.col("family"))
    first = lambda k: text(F.element_at(F.col("params"), F.element_at(keys, k)))
    return F.concat(F.element_at(label, F.col("family")), F.lit("."), F.col("symbol"), F.lit("."), first(1), F.lit("-"), first(2))


def describe_column() -> Column:
    """Plain text of rules and risk, sentences separated by spaces."""
    p = lambda k: F.element_at(F.col("params"), F.lit(k))
    n = lambda k: F.floor(p(k)).cast("string")
    f = lambda v, d: F.format_string(f"%.{d}f", v)
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    rules = {
        "trend": say("Long while the ", n("fast"), "-bar mean is over ", f(p("band") * 100, 1), "% above the ", n("slow"), "-bar mean and the ", n("confirm"), "-bar change is positive; short on the mirror image; flat inside the band."),
        "breakout": say("Long above the ", n("entry"), "-bar high, short below the ", n("entry"), "-bar low; out through the ", n("exit"), "-bar channel; no entries while ", n("volWindow"), "-bar volatility ranks above ", f(p("volCeil") * 100, 0), "%."),
        "meanReversion": say("Against moves of ", f(p("entryZ"), 2), " deviations from the ", n("zWindow"), "-bar mean with the ", n("rsiWindow"), "-bar RSI beyond ", f(p("rsiBand"), 0), " or ", f(100 - p("rsiBand"), 0), "; out inside ", f(p("exitZ"), 2), "."),
        "carry": say("With the ", n("lookback"), "-bar information ratio over the market, smoothed over ", n("smooth"), " bars, beyond ", f(p("threshold"), 2), "; out below ", f(p("threshold") * p("decay"), 2), "."),
        "volatility": say("By the rank of ", n("volWindow"), "-bar volatility in ", n("pctWindow"), " bars: ", F.when(p("mode") == 1, "short").otherwise("long"), " below ", f(p("lowPct") * 100, 0), "%, ", F.when(p("mode") == 1, "long").otherwise("short"), " above ", f(p("highPct") * 100, 0), "%."),
    }
    out = F.lit("")
    for family, text in rules.items():
        out = F.when(F.col("family") == family, text).otherwise(out)
    r = lambda k: F.col(f"risk.{k}")
    side = F.when(F.col("side") == "long", " Long only.").when(F.col("side") == "short", " Short only.").otherwise(" Long and short.")
    risk = say(" Sized to ", f(r("vol_target") * 100, 0), "% a year, at most ", f(r("max_leverage"), 2), "x.")
    more = [
        F.when(r("stop_atr") > 0, say(" Stop at ", f(r("stop_atr"), 1), " ATR.")), F.when(r("take_atr") > 0, say(" Target at ", f(r("take_atr"), 1), " ATR.")),
        F.when(r("max_hold") > 0, say(" Out after ", r("max_hold").cast("string"), " bars.")), F.when(r("cool_down") > 0, say(" Wait ", r("cool_down").cast("string"), " bars.")),
    ]
    return F.concat(out, side, risk, *(F.coalesce(m, F.lit("")) for m in more))
