"""Nearest-neighbour graph of any number of vectors, and a layout in two dimensions from it.

The graph: a forest of random-projection trees. The upper levels of a tree split at the medians of a bounded sample, so even a tight
group is cut in halves and no part is hot; each part is a task, which splits on to leaves and compares within them. The
neighbours of all trees are merged, then rounds of looking at the neighbours' neighbours find what the trees missed.

The layout: rows start at two random projections. In each round a row is pulled to its neighbours and pushed off a
sample of rows that is drawn anew, by steps that shrink: edges are joined with positions, pulls are summed by row, and
the positions are a written table. The sample is SAMPLE rows, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import Scratch
from .kmeans import _drawn, _vectors

#: Rows of a tree's sample, rows of a part and of a leaf, and rows that all others are pushed off in a round.
TREE_SAMPLE, PART, LEAF, SAMPLE = 20_000, 20_000, 256, 256

_EDGES = "id long, other long, distance double"


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cuts) of a complete tree of this depth over a sample: heap order, each cut the median of what comes there."""
    n = (1 << depth) - 1
    directions, cuts, at = rng.standard_normal((n, x.shape[1])), np.zeros(n), np.zeros(len(x), np.int64)
    for node in range(n):
        here = np.flatnonzero(at == node)
        if len(here) > 1:
            a, b = x[rng.choice(here, 2, replace=False)]
            if (a != b).any():
                directions[node] = a - b
            cuts[node] = np.median(x[here] @ directions[node])
        at[here] = 2 * node + 1 + (x[here] @ directions[node] > cuts[node])
    return directions, cuts


def _part(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    directions, cuts = tree
    at = np.zeros(len(x), np.int64)
    for _ in range(int(len(cuts)).bit_length()):
        at = 2 * at + 1 + ((x * directions[at]).sum(axis=1) > cuts[at])
    return at


def _leaves(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows of each leaf: halves along random differences, without recursion."""
    open_ = [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        a, b = x[rng.choice(rows, 2, replace=False)]
        along = x[rows] @ (a - b)
        order = np.argsort(along, kind="stable")
        half = len(rows) // 2
        open_ += [rows[order[:half]], rows[order[half:]]]


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = ((x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * x @ x.T).clip(min=0)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at].ravel(), np.sqrt(np.take_along_axis(d, at, axis=1)).ravel()


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row, each other row once."""
    once = edges.groupBy("id", "other").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return once.withColumn("k", place).where(F.col("k") <= k).drop("k")


def _further(near: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """near, improved by the neighbours of neighbours, both ways."""
    both = near.select("id", "other").union(near.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("id", "other")))
    both = both.withColumn("p", place).where(F.col("p") <= 2 * k).drop("p")  # a row that is many rows' neighbour leads to some of them
    pairs = both.select(F.col("other").alias("via"), "id").join(both.select(F.col("id").alias("via"), F.col("other").alias("other")), "via")
    pairs = pairs.where("id < other").select("id", "other").distinct()
    told = pairs.join(rows.select("id", F.col("z").alias("x")), "id").join(rows.select(F.col("id").alias("other"), F.col("z").alias("y")), "other")
    distance = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    found = told.select("id", "other", distance.alias("distance"))
    return _best(near.union(found).union(found.select(F.col("other").alias("id"), F.col("id").alias("other"), "distance")), k)


def graph(rows: DataFrame, k: int, scratch: Scratch, trees: int = 12, rounds: int = 2, part: int = PART, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """id, other, distance: about the k nearest rows of each row (id, z), by Euclidean distance, as a written table.

    Unique bigint ids; rows whose vector is null, of an odd size or not finite are left out. Equal vectors are rows like others."""
    spark: SparkSession = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("z").cast("array<double>").alias("z"))
    size = rows.where("z is not null").groupBy(F.size("z").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = size["n"] if size else 0
    rows = scratch.write(rows.where((F.size("z") == dims) & F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))), "vectors")
    n = rows.count()
    if n < 2:
        return scratch.write(spark.createDataFrame([], _EDGES), "graph")
    share = min(1.0, 2 * TREE_SAMPLE / n)
    some = rows.where(_drawn(0, seed) < share).orderBy(_drawn(0, seed), "id").limit(TREE_SAMPLE).select("z").toPandas()
    sample = np.stack(some["z"].to_numpy())
    depth = max(0, -(-n // part) - 1).bit_length()
    rng = np.random.default_rng(seed)
    forest = [_tree(sample, depth, rng) for _ in range(trees)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = _vectors(b.column("z"), dims)
            for t, tree in enumerate(forest):
                at = _part(x, tree) if depth else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(at), *b.columns], ["tree", "part", "id", "z"])

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        x, ids = np.stack(rows["z"].to_numpy()), rows["id"].to_numpy()
        own = np.random.default_rng(seed + 1 + int(rows["tree"].iloc[0]))
        out = [_nearest(ids[some], x[some], k) for some in _leaves(x, leaf, own) if len(some) > 1]
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("id", "other", "distance"), cols)))

    found = rows.mapInArrow(dealt, "tree int, part long, id long, z array<double>").groupBy("tree", "part").applyInPandas(compared, _EDGES)
    near = scratch.write(_best(found, k), "graph")
    for _ in range(rounds):
        old, near = near, scratch.write(_further(near, rows, k), "graph")
        scratch.drop(old)
    return near


def layout(rows: DataFrame, near: DataFrame, scratch: Scratch, rounds: int = 12, seed: int = 7) -> DataFrame:
    """id, x, y of the rows of the graph, as a written table: neighbours close together, others apart."""
    dims = rows.select(F.size("z").alias("n")).first()
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((2, dims["n"])) if dims else np.zeros((2, 0))
    dot = lambda a: F.aggregate(F.zip_with("z", F.array(*map(F.lit, axes[a].tolist())), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    at = scratch.write(rows.join(near.select("id").distinct(), "id", "left_semi").select("id", dot(0).alias("x"), dot(1).alias("y")), "layout")
    both = near.select("id", "other").union(near.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    n = at.count()
    for turn in range(rounds):
        step = 1.0 - turn / rounds
        some = at.orderBy(_drawn(turn, seed), "id").limit(SAMPLE).select("id", "x", "y").collect()
        away = np.array([(r["x"], r["y"]) for r in some], np.float64).reshape(-1, 2)
        drawn = np.array([r["id"] for r in some], np.int64)
        ends = both.join(at, "id").join(at.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")), "other")
        gap = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
        pull = -2.0 / (1.0 + gap)
        pulled = ends.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum(pull * (F.col("x") - F.col("ox"))).alias("gx"), F.sum(pull * (F.col("y") - F.col("oy"))).alias("gy"), F.count("*").alias("edges"))

        def moved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                xy = p[["x", "y"]].to_numpy()
                d = xy[:, None, :] - away[None]
                gap = (d * d).sum(axis=2)
                push = 2.0 / ((0.1 + gap) * (1.0 + gap))
                push[p["id"].to_numpy()[:, None] == drawn[None, :]] = 0
                # five rows are pushed off for each edge, as if drawn from all
                force = (push[:, :, None] * d).sum(axis=1) * (5 * p["edges"].to_numpy() / len(away))[:, None]
                new = xy + 0.1 * step * np.clip(p[["gx", "gy"]].to_numpy() + force, -4, 4)
                yield pd.DataFrame({"id": p["id"], "x": new[:, 0], "y": new[:, 1]})

        old, at = at, scratch.write(pulled.mapInPandas(moved, "id long, x double, y double"), "layout")
        scratch.drop(old)
        if n < 2:
            break
    return at
