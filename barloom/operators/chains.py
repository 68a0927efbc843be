"""Hidden Markov models over series of any number and length: chunks as matrices, put together by prefixes, then replayed.

A bar is a matrix that moves a row of state weights one bar on, and matrix products are associative, so a chunk of bars is the product of
its matrices: sums of products for the forward and backward passes, maxima of sums for the likeliest
path. Chunks are multiplied on the executors, FAN of them at a time, tier by tier; going down, every chunk gets the weights
that enter it from the left and leave it to the right, and replays its own bars from them. A task holds one chunk, or the
matrices of FAN chunks, whatever the length of a series.

Models are rows (series, model): start, moves, means and variances as one array. Observations are rows (series, t, x)
with t from 0 without gaps; a chunk's bars are packed into one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LEAST_VARIANCE, STICKINESS
from ..shared import Scratch
from .regimes import Hmm

#: Bars of a chunk, and chunks whose matrices are put together at once.
CHUNK, FAN = 4096, 1024


def flat(m: Hmm) -> list[float]:
    return np.concatenate([m.start, m.moves.ravel(), m.mean.ravel(), m.var.ravel()]).tolist()


def model_of(values, k: int) -> Hmm:
    v = np.asarray(values, np.float64)
    d = (len(v) - k - k * k) // (2 * k)
    cut = np.cumsum([k, k * k, k * d])
    start, moves, mean, var = np.split(v, cut)
    return Hmm(start, moves.reshape(k, k), mean.reshape(k, d), var.reshape(k, d))


class Sums:
    """Weights that add up, scaled to a largest entry of 1; the scale's logarithm goes along."""

    @staticmethod
    def start(m: Hmm) -> np.ndarray:
        return m.start

    @staticmethod
    def bars(m: Hmm, x: np.ndarray, first: bool) -> Iterator[np.ndarray]:
        for t, b in enumerate(m.density(x)):
            yield np.diag(b) if first and t == 0 else m.moves * b

    @staticmethod
    def times(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        c = a @ b
        top = c.max() or 1e-300
        return c / top, float(np.log(top))

    end = staticmethod(np.ones)


class Bests:
    """Logarithms of the best path's weight."""

    @staticmethod
    def start(m: Hmm) -> np.ndarray:
        return np.log(np.maximum(1e-12, m.start))

    @staticmethod
    def bars(m: Hmm, x: np.ndarray, first: bool) -> Iterator[np.ndarray]:
        moves, k = np.log(np.maximum(1e-12, m.moves)), len(m.start)
        for t, b in enumerate(np.log(m.density(x))):
            yield np.where(np.eye(k, dtype=bool), b, -np.inf) if first and t == 0 else moves + b

    @staticmethod
    def times(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        return (a[:, :, None] + b[None, :, :]).max(axis=1), 0.0

    end = staticmethod(np.zeros)


Ring = type[Sums] | type[Bests]


def _product(ring: Ring, k: int, matrices: Iterator[np.ndarray]) -> tuple[np.ndarray, float]:
    out, scale = next(matrices), 0.0
    for m in matrices:
        out, more = ring.times(out, m)
        scale += more
    return out, scale


def packed(observations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """series, i, n, x: a row per chunk with its bars' observations in order, and the number of chunks of the series."""
    rows = observations.groupBy("series", F.floor(F.col("t") / chunk).alias("i")).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("b"))
    rows = rows.select("series", "i", F.transform("b", lambda e: e["x"]).alias("x"))
    n = rows.groupBy("series").agg(F.count("*").alias("n"))
    return rows.join(n, "series")


_NODE = "series string, i long, n long, p array<double>, scale double"
_EDGE = "series string, i long, enter array<double>, leave array<double>, level double"


def _each(rows: DataFrame, work: Callable[[pd.Series], pd.DataFrame | None], schema: str) -> DataFrame:
    """One call of `work` per row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                out = work(row)
                if out is not None:
                    yield out

    return rows.mapInPandas(run, schema)


def borders(chunks: DataFrame, models: DataFrame, k: int, ring: Ring, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """series, i, enter, leave, level: the weights before and after each chunk, each up to a factor, and the logarithm of the whole series' weight."""

    def chunk(row) -> pd.DataFrame:
        m, x = model_of(row.model, k), np.stack(row.x)
        p, scale = _product(ring, k, ring.bars(m, x, row.i == 0))
        return pd.DataFrame({"series": [row.series], "i": [row.i], "n": [row.n], "p": [p.ravel()], "scale": [scale]})

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        p, scale = _product(ring, k, (np.asarray(v).reshape(k, k) for v in rows["p"]))
        top = rows.iloc[0]
        return pd.DataFrame({"series": [top["series"]], "i": [top["i"] // fan], "n": [-(-top["n"] // fan)], "p": [p.ravel()], "scale": [scale + rows["scale"].sum()]})

    def top(row) -> pd.DataFrame:
        p, enter, leave = np.asarray(row.p).reshape(k, k), ring.start(model_of(row.model, k)), ring.end(k)
        whole, more = ring.times(enter[None, :], p)
        total, last = ring.times(whole, leave[:, None])
        level = float(total[0, 0]) if ring is Bests else row.scale + more + last + float(np.log(max(total[0, 0], 1e-300)))
        return pd.DataFrame({"series": [row.series], "i": [0], "enter": [enter], "leave": [leave], "level": [level]})

    def down(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, outer = rows.sort_values("i", ignore_index=True), above.iloc[0]
        each = [np.asarray(v).reshape(k, k) for v in rows["p"]]
        enter, leave = [np.asarray(outer["enter"])[None, :]], [np.asarray(outer["leave"])[:, None]]
        for p in each[:-1]:
            enter.append(ring.times(enter[-1], p)[0])
        for p in each[:0:-1]:
            leave.append(ring.times(p, leave[-1])[0])
        return pd.DataFrame({"series": rows["series"], "i": rows["i"], "enter": [v.ravel() for v in enter], "leave": [v.ravel() for v in leave[::-1]], "level": outer["level"]})

    tiers = [scratch.write(_each(chunks.join(models, "series"), chunk, _NODE), "chunks")]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        tiers.append(scratch.write(tiers[-1].groupBy("series", F.floor(F.col("i") / fan)).applyInPandas(several, _NODE), "tier"))
        most = -(-most // fan)
    edges = _each(tiers[-1].join(models, "series"), top, _EDGE)
    for nodes in reversed(tiers[:-1]):
        outer = edges.select(F.col("series").alias("series"), F.col("i").alias("group"), F.col("enter").alias("enter"), F.col("leave").alias("leave"), F.col("level").alias("level"))
        edges = nodes.groupBy("series", F.floor(F.col("i") / fan).alias("group")).cogroup(outer.groupBy("series", "group")).applyInPandas(down, _EDGE)
    return edges


def _replay(m: Hmm, x: np.ndarray, first: bool, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state shares per bar, expected moves into the chunk's bars) from the weights at its borders."""
    b = m.density(x)
    n, k = b.shape
    ahead, back = np.empty((n, k)), np.empty((n, k))
    now = enter * b[0] if first else (enter @ m.moves) * b[0]
    for t in range(n):
        if t:
            now = (ahead[t - 1] @ m.moves) * b[t]
        ahead[t] = now / (now.sum() or 1e-300)
    back[-1] = leave
    for t in range(n - 2, -1, -1):
        v = m.moves @ (b[t + 1] * back[t + 1])
        back[t] = v / (v.max() or 1e-300)
    share = ahead * back
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    before = ahead[:-1] if first else np.concatenate([enter[None, :], ahead[:-1]])
    into = b[1:] * back[1:] if first else b * back
    joint = before[:, :, None] * m.moves[None] * into[:, None, :]
    total = joint.sum(axis=(1, 2))
    return share, (joint / np.where(total == 0, 1e-300, total)[:, None, None]).sum(axis=0)


def _with_borders(chunks: DataFrame, models: DataFrame, edges: DataFrame) -> DataFrame:
    return chunks.join(models, "series").join(edges, ["series", "i"])


def shares(chunks: DataFrame, models: DataFrame, k: int, scratch: Scratch, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """series, t, share (of each state), log_likelihood: the smoothed states of every bar."""

    def work(row) -> pd.DataFrame:
        share, _ = _replay(model_of(row.model, k), np.stack(row.x), row.i == 0, np.asarray(row.enter), np.asarray(row.leave))
        return pd.DataFrame({"series": row.series, "t": row.i * chunk + np.arange(len(share)), "share": list(share), "log_likelihood": row.level})

    edges = borders(chunks, models, k, Sums, scratch, fan)
    return _each(_with_borders(chunks, models, edges), work, "series string, t long, share array<double>, log_likelihood double")


def best_paths(chunks: DataFrame, models: DataFrame, k: int, scratch: Scratch, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """series, t, state: the likeliest path, ties to the lowest state. A chunk's last state is the best one there of all paths; the rest follows backwards."""

    def work(row) -> pd.DataFrame:
        m, x = model_of(row.model, k), np.stack(row.x)
        emit, moves = np.log(m.density(x)), np.log(np.maximum(1e-12, m.moves))
        came, score = np.zeros(emit.shape, np.int64), np.asarray(row.enter)
        for t in range(len(x)):
            if t or row.i:
                step = score[:, None] + moves
                came[t], score = step.argmax(axis=0), step.max(axis=0)
            score = score + emit[t]
        path = np.empty(len(x), np.int64)
        path[-1] = (score + np.asarray(row.leave)).argmax()
        for t in range(len(x) - 1, 0, -1):
            path[t - 1] = came[t, path[t]]
        return pd.DataFrame({"series": row.series, "t": row.i * chunk + np.arange(len(path)), "state": path})

    edges = borders(chunks, models, k, Bests, scratch, fan)
    return _each(_with_borders(chunks, models, edges), work, "series string, t long, state int")


def start_models(observations: DataFrame, k: int, by: int) -> DataFrame:
    """series, model: means and variances of the bars between the k-quantiles of observation `by`, equal starts, sticky moves.

    A state without bars has the whole series' moments; a spread of 0 or of one bar counts as 1."""
    cuts = observations.groupBy("series").agg(F.percentile(F.element_at("x", by + 1), F.array(*(F.lit(q / k) for q in range(1, k)))).alias("cuts"))
    state = F.size(F.filter("cuts", lambda c: F.element_at("x", by + 1) > c))
    rows = observations.join(cuts, "series").select("series", state.alias("state"), F.posexplode("x").alias("d", "v"))
    moments = lambda *keys: rows.groupBy(*keys).agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    spread = F.greatest(F.lit(LEAST_VARIANCE), F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    own = moments("series", "state", "d").withColumn("s", spread)
    every = moments("series", "d").withColumn("s", spread).withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    both = every.select("series", "state", "d", F.col("m").alias("m0"), F.col("s").alias("s0")).join(own, ["series", "state", "d"], "left")
    both = both.select("series", "state", "d", F.coalesce("m", "m0").alias("m"), F.coalesce("s", "s0").alias("s"))
    made = both.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("state", "d", "m", "s"))).alias("e"))
    moves = [0.9 if i == j else 0.1 / max(1, k - 1) for i in range(k) for j in range(k)]
    fixed = F.array(*map(F.lit, [1.0 / k] * k + moves))
    return made.select("series", F.concat(fixed, F.transform("e", lambda x: x["m"]), F.transform("e", lambda x: x["s"])).alias("model"))


def improved(chunks: DataFrame, models: DataFrame, k: int, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """series, model, log_likelihood (of the models given), bars: one round of Baum-Welch, with a pseudo-count on staying.

    A chunk sends its sums, one number each, so a series' sums are partial ones before they are shuffled."""

    def sums(row) -> pd.DataFrame:
        x = np.stack(row.x)
        share, moved = _replay(model_of(row.model, k), x, row.i == 0, np.asarray(row.enter), np.asarray(row.leave))
        first = share[0] if row.i == 0 else np.zeros(k)
        values = np.concatenate([first, moved.ravel(), share.sum(axis=0), (share.T @ x).ravel(), (share.T @ (x * x)).ravel(), [len(x)]])
        return pd.DataFrame({"series": row.series, "e": np.arange(len(values)), "v": values, "level": row.level})

    def model(row) -> pd.DataFrame:
        v = np.asarray(row.v)
        d = (len(v) - 1 - 2 * k - k * k) // (2 * k)
        first, moved, weight, x1, x2 = np.split(v[:-1], np.cumsum([k, k * k, k, k * d]))
        start = np.maximum(1e-6, first)
        moved = moved.reshape(k, k) + STICKINESS * v[-1] * np.eye(k)
        moves = np.maximum(1e-6, moved / np.maximum(moved.sum(axis=1, keepdims=True), 1e-300))
        weight = np.maximum(weight, 1e-300)[:, None]
        mean = x1.reshape(k, d) / weight
        var = np.maximum(LEAST_VARIANCE, x2.reshape(k, d) / weight - mean**2)
        new = Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), mean, var)
        return pd.DataFrame({"series": [row.series], "model": [flat(new)], "log_likelihood": [row.level], "bars": [int(v[-1])]})

    edges = borders(chunks, models, k, Sums, scratch, fan)
    each = _each(_with_borders(chunks, models, edges), sums, "series string, e int, v double, level double")
    whole = each.groupBy("series", "e").agg(F.sum("v").alias("v"), F.first("level").alias("level"))
    whole = whole.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("e", "v"))), lambda s: s["v"]).alias("v"), F.first("level").alias("level"))
    return _each(whole, model, "series string, model array<double>, log_likelihood double, bars long")


def fit_all(chunks: DataFrame, models: DataFrame, k: int, rounds: int, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """series, model, log_likelihood, bars after `rounds` rounds: a written table each, of one row a series."""
    out = models
    for _ in range(rounds):
        out = scratch.write(improved(chunks, out.select("series", "model"), k, scratch, fan), "models")
    return out


def series_observations(returns: DataFrame, series: str = "symbol") -> DataFrame:
    """series, t, x: mean and mean size of the last 21 returns of (series, t, ret), in per cent; short frames at the start count."""
    w = Window.partitionBy(series).orderBy("t").rowsBetween(-20, 0)
    x = F.array(F.avg("ret").over(w) * 100, F.avg(F.abs("ret")).over(w) * 100)
    return returns.select(F.col(series).cast("string").alias("series"), F.col("t").cast("long").alias("t"), x.alias("x"))
