"""Regimes of a market index: a Gaussian hidden Markov model, its path, moments and names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..schema import LEAST_VARIANCE, STICKINESS, TRADING_DAYS
from .clustering import kmeans
from .kernels import regime_observations


@dataclass
class Hmm:
    start: np.ndarray  # k
    moves: np.ndarray  # k x k
    mean: np.ndarray  # k x d
    var: np.ndarray  # k x d
    log_likelihood: float = -math.inf
    rounds: int = 0

    def density(self, x: np.ndarray) -> np.ndarray:
        """n x k, floored so that one odd bar can't end a path."""
        v = np.maximum(LEAST_VARIANCE, self.var)[None]
        log = -0.5 * (np.log(2 * math.pi * v) + (x[:, None, :] - self.mean[None]) ** 2 / v).sum(axis=2)
        return np.maximum(1e-300, np.exp(log))


def initial(x: np.ndarray, k: int, seed: int) -> Hmm:
    """Moments of k-means clusters, equal starts and sticky moves."""
    labels, _ = kmeans(x, k, seed, 40)
    groups = [x[labels == c] if (labels == c).any() else x for c in range(k)]
    spread = [g.var(axis=0, ddof=1) if len(g) > 1 else np.zeros(x.shape[1]) for g in groups]
    var = np.array([np.maximum(LEAST_VARIANCE, np.where(v == 0, 1.0, v)) for v in spread])
    moves = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(moves, 0.9)
    return Hmm(np.full(k, 1 / k), moves, np.array([g.mean(axis=0) for g in groups]), var)


def _expect(m: Hmm, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(state shares per bar, expected moves, log likelihood) by scaled forward and backward passes."""
    b = m.density(x)
    n, k = b.shape
    ahead, back, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    now = m.start * b[0]
    for t in range(n):
        if t:
            now = (ahead[t - 1] @ m.moves) * b[t]
        scale[t] = now.sum() or 1e-300
        ahead[t] = now / scale[t]
    for t in range(n - 2, -1, -1):
        back[t] = m.moves @ (b[t + 1] * back[t + 1]) / scale[t + 1]
    share = ahead * back
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    joint = ahead[:-1, :, None] * m.moves[None] * (b[1:] * back[1:])[:, None, :]
    total = joint.sum(axis=(1, 2))
    return share, (joint / np.where(total == 0, 1e-300, total)[:, None, None]).sum(axis=0), float(np.log(scale).sum())


def fit(x: np.ndarray, k: int, seed: int = 11, rounds: int = 60, tolerance: float = 1e-4) -> Hmm:
    """Baum-Welch with a pseudo-count on staying; ends when the likelihood gains little."""
    m = initial(x, k, seed)
    n, stay = len(x), STICKINESS * len(x)
    for turn in range(rounds):
        share, moved, level = _expect(m, x)
        start = np.maximum(1e-6, share[0])
        moved = moved + stay * np.eye(k)
        moves = np.maximum(1e-6, moved / np.maximum(moved.sum(axis=1, keepdims=True), 1e-300))
        weight = np.maximum(share.sum(axis=0), 1e-300)[:, None]
        mean = share.T @ x / weight
        var = np.array([share[:, i] @ (x - mean[i]) ** 2 for i in range(k)]) / weight
        done = math.isfinite(m.log_likelihood) and abs(level - m.log_likelihood) < tolerance * abs(m.log_likelihood)
        m = Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), mean, np.maximum(LEAST_VARIANCE, var), level, turn + 1)
        if done or not n:
            break
    return m


def viterbi(m: Hmm, x: np.ndarray) -> np.ndarray:
    """The likeliest path, ties to the lowest state."""
    emit, moves = np.log(m.density(x)), np.log(np.maximum(1e-12, m.moves))
    score = np.log(np.maximum(1e-12, m.start)) + emit[0]
    came = np.zeros(emit.shape, np.int64)
    for t in range(1, len(x)):
        step = score[:, None] + moves
        came[t] = step.argmax(axis=0)
        score = step.max(axis=0) + emit[t]
    path = np.empty(len(x), np.int64)
    path[-1] = score.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def decode(index: DataFrame, k: int, seed: int = 11) -> DataFrame:
    """t, date, state, log_likelihood, rounds of an index (t, date, ret): one series, one task.

    States on fewer than 0.5 % of the bars go; their bars count to state 0.
    """
    names = ["drift", "size", "trend", "ratio"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        if not len(rows):
            return
        rows = rows.sort_values("t", ignore_index=True)
        x = rows[names].to_numpy()
        m = fit(x, min(k, len(x)), seed)
        path = viterbi(m, x)
        kept = [s for s in range(k) if (path == s).mean() >= 0.005]
        new = {s: i for i, s in enumerate(kept)}
        yield pd.DataFrame({"t": rows["t"], "date": rows["date"], "state": [new.get(s, 0) for s in path.tolist()], "log_likelihood": m.log_likelihood, "rounds": m.rounds})

    return regime_observations(index).coalesce(1).mapInPandas(run, "t int, date date, state int, log_likelihood double, rounds int")


def segments(path: DataFrame) -> DataFrame:
    """state, start, end (inclusive), length of each run of equal states of (t, state): gaps and islands."""
    by = Window.orderBy("t")
    turn = F.when(F.col("state") == F.lag("state").over(by), 0).otherwise(1)
    island = F.sum("turn").over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = path.select("t", "state", turn.alias("turn")).withColumn("island", island)
    return runs.groupBy("island", "state").agg(F.min("t").alias("start"), F.max("t").alias("end")).select("state", "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def moments(path: DataFrame) -> DataFrame:
    """state, share, mean_return, vol, avg_length of (t, state, ret)."""
    runs = segments(path).groupBy("state").agg(F.avg("length").alias("avg_length"))
    total = F.sum(F.count("*")).over(Window.partitionBy())
    stats = path.groupBy("state").agg(
        (F.count("*") / total).alias("share"), (F.avg("ret") * TRADING_DAYS).alias("mean_return"), (S.stdev("ret") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("vol")
    )
    return stats.join(runs, "state")


def labels(states: DataFrame) -> DataFrame:
    """states (state, mean_return, vol, ...) with label and tone: drift rank by thirds, volatility against the upper median."""
    every = Window.partitionBy()
    n = F.count("*").over(every)
    place = F.row_number().over(Window.orderBy(F.desc("mean_return"), "state")) - 1
    sorted_vol = F.array_sort(F.collect_list("vol").over(every))
    ranked = states.select("*", n.alias("_n"), place.alias("_place"), F.element_at(sorted_vol, F.floor(n / 2).cast("int") + 1).alias("_mid"))
    few = F.col("_n") <= 2
    high = F.when(few, F.col("_place") == 0).otherwise(F.col("_place") < F.col("_n") / 3)
    low = F.when(few, F.col("_place") > 0).otherwise(F.col("_place") >= 2 * F.col("_n") / 3)
    wild, falling = F.col("vol") > F.col("_mid") * 1.1, F.col("mean_return") < 0
    # The labels and tones.
    label = (
        F.when(high, F.when(wild, "Momentum Surge").otherwise("Calm Uptrend"))
        .when(low & falling, F.when(wild, "Stress Selloff").otherwise("Grinding Bear"))
        .when(low, F.when(wild, "Volatile Fade").otherwise("Slow Drift"))
        .otherwise(F.when(wild, "Choppy / High Vol").otherwise("Quiet Grind"))
    )
    tone = F.when(high, "bull").when(low & falling, F.when(wild, "stress").otherwise("bear")).otherwise(F.when(wild, "chop").otherwise("calm"))
    again = F.row_number().over(Window.partitionBy("_label").orderBy("state"))
    named = ranked.withColumn("_label", label).withColumn("tone", tone).withColumn("_again", again)
    text = F.when(F.col("_again") > 1, F.concat_ws(" ", "_label", F.col("_again").cast("string"))).otherwise(F.col("_label"))
    return named.withColumn("label", text).drop("_n", "_place", "_mid", "_label", "_again")


def rule_path(index: DataFrame) -> DataFrame:
    """t, date, ret, state 0..2 by thirds of the 21-bar mean size of returns: a path without a model."""
    seen = regime_observations(index).select("t", "date", "size").join(index.select("t", "ret"), "t")
    cut = seen.agg(F.struct(F.percentile("size", 1 / 3).alias("a"), F.percentile("size", 2 / 3).alias("b"))).scalar()
    state = F.when(F.col("size") <= F.col("cut.a"), 0).when(F.col("size") <= F.col("cut.b"), 1).otherwise(2)
    return seen.withColumn("cut", cut).select("t", "date", "ret", state.alias("state"))
