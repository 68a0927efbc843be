"""Sliding extremes and ranks whose cost doesn't grow with the width, over blocks of w bars.

A window of w bars is the end of one block of w and the beginning of the next. Extremes: a running one from each block's begin and
one from its end, so a window's is the larger of two numbers, whatever w. Ranks: a window's values that are at most the bar's are
counted in the tail of one block and the head of the next, by sorted runs of powers of two. Blocks are tasks of their own, so a long series
is no single one. Bars are numbered from 0 without gaps (t).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extremes(bars: DataFrame, x: str, w: int, by: str = "symbol") -> DataFrame:
    """by, t, highest, lowest of x over the last w bars: null while there are fewer; missing values don't count.

    Each row gives its block's running extremes at its own bar, and those of the rest of its block at the bar w - 1 later:
    two sums of bounded size meet for every bar."""
    block = F.floor(F.col("t") / w)
    rows = bars.select(by, F.col("t").cast("long").alias("t"), F.col(x).alias("x"), block.alias("block"))
    head = Window.partitionBy(by, "block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy(by, "block").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(by, "t", *(f("x").over(o).alias(f"{n}_{e}") for n, o in (("head", head), ("tail", tail)) for e, f in (("high", F.max), ("low", F.min))))
    here = F.struct(F.col("t").alias("t"), F.col("head_high").alias("high"), F.col("head_low").alias("low"), F.lit(1).alias("own"))
    later = F.struct((F.col("t") + w - 1).alias("t"), F.col("tail_high").alias("high"), F.col("tail_low").alias("low"), F.lit(0).alias("own"))
    parts = rows.select(by, F.explode(F.array(here, later)).alias("p")).groupBy(by, F.col("p.t").alias("t")).agg(
        F.max("p.high").alias("highest"), F.min("p.low").alias("lowest"), F.max("p.own").alias("own")
    ).where("own = 1")
    full = F.col("t") >= w - 1
    return parts.select(by, F.col("t").cast("int").alias("t"), F.when(full, F.col("highest")).alias("highest"), F.when(full, F.col("lowest")).alias("lowest"))


def at_most(rank: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each query (a rank, and a prefix of `end` places), how many of the first `end` entries of `rank` are at most `low`.

    The prefix is cut into runs of powers of two; each power's runs are sorted at once, and one search answers all queries that have such a run."""
    n = len(rank)
    out = np.zeros(len(low), np.int64)
    if not n:
        return out
    size = 1 << max(0, n - 1).bit_length()
    top = int(max(rank.max(), low.max(initial=0))) + 2
    padded = np.full(size, top - 1, np.int64)
    padded[:n] = rank
    step = 1
    while step <= size:
        runs = np.sort(padded.reshape(-1, step), axis=1) + np.arange(size // step)[:, None] * top
        asks = np.flatnonzero(end & step)
        run = (end[asks] // step) ^ 1
        out[asks] += np.searchsorted(runs.ravel(), run * top + low[asks], side="right") - run * step
        step <<= 1
    return out


def _block_ranks(t: np.ndarray, x: np.ndarray, own: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, share, present) of a block's own bars, from it and the block before; x NaN where missing."""
    order = np.argsort(t, kind="stable")
    t, x, own = t[order], x[order], own[order]
    there = ~np.isnan(x)
    seen = np.concatenate([[0], np.cumsum(there)])
    rank = np.unique(x[there], return_inverse=True)[1].astype(np.int64)
    mine = np.flatnonzero(own & there)
    place = seen[mine]  # of the bar among the present values
    begin = seen[np.maximum(np.searchsorted(t, t[mine] - w + 1), 0)]
    low = rank[place]
    count = at_most(rank, low, place + 1) - at_most(rank, low, begin)
    present = place + 1 - begin
    share = np.full(len(t), np.nan)
    share[mine] = np.where(present > 1, (count - 1) / np.maximum(present - 1, 1), np.nan)
    return t[own], share[own], own


def percentiles(bars: DataFrame, x: str, w: int, by: str = "symbol") -> DataFrame:
    """by, t, value: the share of the other present values of the last w bars that are at most the bar's; null while there are fewer bars, where the bar's
    value is missing, or is the only one. A block goes to two tasks, its own and the next one's: two rows for a bar, whatever w."""
    block = F.floor(F.col("t") / w)
    rows = bars.select(by, F.col("t").cast("long").alias("t"), F.col(x).cast("double").alias("x"), F.explode(F.array(block, block + 1)).alias("block"))

    def work(rows: pa.Table) -> pa.Table:
        t = rows.column("t").to_numpy()
        held = rows.column("x").combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
        own = t // w == rows.column("block").to_numpy()
        t, share, _ = _block_ranks(t, np.asarray(held, np.float64), own, w)
        value = pa.array(share, pa.float64(), mask=np.isnan(share) | (t < w - 1))
        return pa.table([pa.array([rows.column(by)[0].as_py()] * len(t), rows.schema.field(by).type), pa.array(t.astype(np.int32)), value], [by, "t", "value"])

    kind = dict(bars.dtypes)[by]
    return rows.groupBy(by, "block").applyInArrow(work, f"`{by}` {kind}, t int, value double")
