"""k-means over any number of rows: k-means|| seeding and Lloyd's rounds by partial sums.

Centres are k rows and travel with the tasks; rows never leave theirs but as sums. Rows are (id, z) with bigint ids; a null
vector, one of another length than the centres, or with a null or non-finite component, is in no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are sound, their vectors)."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = lengths == dims
    x = column.filter(pa.array(ok)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    sound = np.isfinite(x).all(axis=1)
    ok[np.flatnonzero(ok)[~sound]] = False
    return ok, x[sound]


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, ties to the lowest cluster: products find the near ones, differences decide among them."""
    d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
    slack = 1e-9 * ((x * x).sum(axis=1) + (c * c).sum(axis=1).max(initial=0.0))
    near = d <= (d.min(axis=1) + slack)[:, None]
    best, least = d.argmin(axis=1), np.empty(len(x))
    for i in np.flatnonzero(near.sum(axis=1) > 1):
        some = np.flatnonzero(near[i])
        best[i] = some[((x[i] - c[some]) ** 2).sum(axis=1).argmin()]
    least = ((x - c[best]) ** 2).sum(axis=1)
    return best, least


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared); both null where the vector is unsound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _vectors(b.column("z"), centres.shape[1])
            cluster, distance = _nearest(x, centres)
            at = np.full(len(ok), -1)
            at[ok] = np.arange(len(x))
            at = pa.array(at, mask=~ok)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()).take(at), pa.array(distance, pa.float64()).take(at)], ["id", "cluster", "distance"])

    return rows.select("id", "z").mapInArrow(run, "id long, cluster int, distance double")


def lloyd(rows: DataFrame, centres: np.ndarray, rounds: int, tolerance: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """(centres, cost before each round): ends when no centre moves by more than the tolerance. An empty cluster keeps its centre."""
    costs = []
    for _ in range(rounds):
        now = centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k, dims = now.shape
            sums, n, cost = np.zeros((k, dims)), np.zeros(k), np.zeros(k)
            for b in batches:
                _, x = _vectors(b.column("z"), dims)
                cluster, distance = _nearest(x, now)
                np.add.at(sums, cluster, x)
                n += np.bincount(cluster, minlength=k)
                cost += np.bincount(cluster, distance, minlength=k)
            some = np.flatnonzero(n)
            every = np.concatenate([sums, n[:, None], cost[:, None]], axis=1)[some]
            pos = np.tile(np.arange(dims + 2), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 2), pa.int32()), pa.array(pos, pa.int32()), pa.array(every.ravel(), pa.float64())], ["cluster", "e", "v"])

        sums = rows.select("z").mapInArrow(run, "cluster int, e int, v double").groupBy("cluster", "e").agg(F.sum("v").alias("v")).toPandas()  # k * (dims + 2) numbers
        table = np.zeros((len(centres), centres.shape[1] + 2))
        table[sums["cluster"], sums["e"]] = sums["v"]
        n = table[:, -2]
        costs.append(float(table[:, -1].sum()))
        centres = np.where(n[:, None] > 0, table[:, :-2] / np.maximum(n, 1)[:, None], now)
        if np.abs(centres - now).max(initial=0.0) <= tolerance:
            break
    return centres, costs


def _drawn(turn: int, seed: int) -> Column:
    """A number from 0 to 1 that depends on the row's id, the round and the seed alone: a task that runs again draws the same."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(turn), F.col("id")), 11) / F.lit(float(1 << 53))


def seeds(rows: DataFrame, k: int, rounds: int = 5, oversample: float = 2.0, seed: int = 7) -> np.ndarray:
    """k-means||: in each round every row is drawn with a chance in proportion to its squared distance to the
    candidates so far, oversample * k of them expected; candidates, weighted by the rows nearest to them, are then thinned to k by k-means++.

    Some (1 + rounds * oversample * k) candidates reach the driver, whatever the number of rows."""
    sound = rows.where("z is not null and size(z) > 0")
    first = sound.orderBy(_drawn(0, seed), "id").select("z").first()
    if first is None:
        return np.zeros((0, 0))
    found = np.array([first[0]], np.float64)
    for turn in range(1, rounds + 1):
        near = assigned(rows, found)
        cost = near.agg(F.sum("distance")).first()[0] or 0.0
        if cost == 0:
            break
        hit = near.where(_drawn(turn, seed) < F.col("distance") * F.lit(oversample * k / cost)).select("id")
        new = rows.join(hit, "id", "left_semi").select("id", "z").toPandas().sort_values("id")
        if len(new):
            found = np.unique(np.concatenate([found, np.stack(new["z"].to_numpy()).astype(np.float64)]), axis=0)
    weight = np.zeros(len(found))
    for r in assigned(rows, found).where("cluster is not null").groupBy("cluster").count().collect():
        weight[r["cluster"]] = r["count"]
    return _thinned(found, weight, k, seed)


def _thinned(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ and a few of Lloyd's rounds among the candidates."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    picked = [int(weight.argmax())]
    least = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        chance = least * weight
        p = chance / chance.sum() if chance.sum() > 0 else None
        picked.append(int(rng.choice(len(x), p=p)) if p is not None else int(np.setdiff1d(np.arange(len(x)), picked)[0]))
        least = np.minimum(least, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    c = x[picked]
    for _ in range(10):
        cluster, _ = _nearest(x, c)
        w = np.bincount(cluster, weight, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, cluster, x * weight[:, None])
        c = np.where(w[:, None] > 0, sums / np.maximum(w, 1e-300)[:, None], c)
    return c


def kmeans_all(rows: DataFrame, k: int, rounds: int = 20, seed: int = 7) -> DataFrame:
    """id, cluster, distance of all rows after k-means|| and Lloyd's rounds."""
    centres = seeds(rows, k, seed=seed)
    if not len(centres):
        return rows.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    centres, _ = lloyd(rows, centres, rounds, 1e-9)
    return assigned(rows, centres)
