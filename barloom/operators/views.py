"""Leaderboards, atlases, grids and resampled curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..schema import TRADING_DAYS


def downsampled(rows: DataFrame, by: str, points: int) -> DataFrame:
    """rows (by, i from 0, ...): row floor(k * n / points) for each k; all rows if they are no more than points. Adds k."""
    n = F.max("i").over(Window.partitionBy(by)) + 1
    sized = rows.withColumn("_n", n)
    ks = F.when(F.col("_n") <= points, F.array(F.col("i"))).otherwise(
        # the k with floor(k * n / points) = i are those from ceil(i * points / n) on, below ceil((i + 1) * points / n)
        F.when(
            F.ceil(F.col("i") * points / F.col("_n")) < F.ceil((F.col("i") + 1) * points / F.col("_n")),
            F.sequence(F.ceil(F.col("i") * points / F.col("_n")).cast("int"), (F.ceil((F.col("i") + 1) * points / F.col("_n")) - 1).cast("int")),
        )
    )
    return sized.withColumn("k", F.explode(ks)).drop("_n")


def resampled(rows: DataFrame, points: int) -> DataFrame:
    """k, v of rows (i from 0, v): the nearest row on the normalised position of each of `points` places."""
    n = rows.agg(F.max("i") + 1).scalar()
    places = rows.sparkSession.range(points).select(F.col("id").cast("int").alias("k")).withColumn("n", n)
    at = S.half_up(F.col("k") / max(1, points - 1) * (F.col("n") - 1)).cast("int")
    wanted = places.select("k", F.least(at, (F.col("n") - 1).cast("int")).alias("i"))
    return wanted.join(rows, "i").select("k", "v")


def from_first(v: Column, by: str, order: str) -> Column:
    """v over its first value; a first value of 0 counts 1."""
    first = F.first(v).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return v / F.when(first == 0, 1.0).otherwise(first)


def leaderboard(rows: DataFrame, family: str | None = None, cluster: int | None = None, positive: bool = False, sort: str = "rank") -> DataFrame:
    """Filtered and sorted: by rank upward, by any other key downward; ties by genome_id."""
    if family:
        rows = rows.where(F.col("family") == family)
    if cluster is not None:
        rows = rows.where(F.col("cluster") == cluster)
    if positive:
        rows = rows.where("sharpe > 0")
    return rows.orderBy(F.asc("rank") if sort == "rank" else F.desc(sort), "genome_id")


def overview(rows: DataFrame) -> DataFrame:
    """hit_rate, median_out, median_in, decay of rows (sharpe, is_sharpe)."""
    kpi = rows.agg(
        S.mean(F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), S.median("sharpe").alias("median_out"), S.median("is_sharpe").alias("median_in")
    )
    return kpi.withColumn("decay", F.coalesce(1 - F.try_divide("median_out", "median_in"), F.lit(0.0)))


def atlas(rows: DataFrame, key: str, states: list[int], measure: str = "sharpe", middle: bool = False) -> DataFrame:
    """key by state: the measure, or its median."""
    value = S.median(measure) if middle else F.first(measure)
    wide = rows.groupBy(key).pivot("state", states).agg(value)
    return wide.select(key, *(F.col(f"`{s}`").alias(f"state_{s}") for s in states))


def monthly_grid(monthly: DataFrame, by: str) -> DataFrame:
    """by, year, m01..m12 and year_total, compounded, of monthly returns (by, month, ret)."""
    months = [f"{m:02d}" for m in range(1, 13)]
    rows = monthly.select(by, F.substring("month", 1, 4).cast("int").alias("year"), F.substring("month", 6, 2).alias("m"), "ret")
    total = rows.groupBy(by, "year").agg((F.product(1 + F.col("ret")) - 1).alias("year_total"))
    grid = rows.groupBy(by, "year").pivot("m", months).agg(F.first("ret"))
    return grid.join(total, [by, "year"]).select(by, "year", *(F.col(f"`{m}`").alias(f"m{m}") for m in months), "year_total")


def exit_mix(trades: DataFrame) -> DataFrame:
    return trades.groupBy("genome_id", "exit_reason").agg(F.count("*").alias("n"))


def recent_trades(trades: DataFrame, count: int = 160) -> DataFrame:
    """Each genome's last trades, the newest first in `k`."""
    by = Window.partitionBy("genome_id").orderBy(F.desc("exit_t"), F.desc("entry_t"))
    return trades.withColumn("k", F.row_number().over(by)).where(F.col("k") <= count)


def instrument_stats(bars: DataFrame) -> DataFrame:
    """symbol, last_close, total_return, vol, max_drawdown."""
    by = Window.partitionBy("symbol").orderBy("t")
    rows = bars.withColumn("ret", F.coalesce(F.col("close") / F.lag("close").over(by) - 1, F.lit(0.0)))
    peak = F.max("close").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("dd", F.col("close") / peak - 1).groupBy("symbol").agg(
        F.max_by("close", "t").alias("last_close"), (F.max_by("close", "t") / F.min_by("close", "t") - 1).alias("total_return"),
        (S.stdev("ret") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("vol"), F.min("dd").alias("max_drawdown"),
    )


def bands(segments: DataFrame, start: int, end: int) -> DataFrame:
    """Segments (state, start, end) that overlap [start, end], clipped, with their ends in 0..1 of the span."""
    a, b = F.greatest("start", F.lit(start)), F.least("end", F.lit(end))
    span = max(1, end - start)
    cut = segments.where((F.col("end") >= start) & (F.col("start") <= end))
    return cut.select("state", a.alias("start"), b.alias("end"), ((a - start) / span).alias("x0"), ((b - start) / span).alias("x1"))


def extents(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, low, high of the finite values; equal ends are moved apart by 1."""
    v = F.col(value)
    ok = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    e = rows.groupBy(by).agg(F.min(ok).alias("low"), F.max(ok).alias("high"))
    same = F.col("low") == F.col("high")
    return e.select(by, F.when(same, F.col("low") - 1).otherwise(F.col("low")).alias("low"), F.when(same, F.col("high") + 1).otherwise(F.col("high")).alias("high"))


def dominant_and_worst(states: DataFrame) -> DataFrame:
    """dominant: the state with the largest share; worst: that with the lowest mean return; ties to the first."""
    return states.agg(
        F.max_by("state", F.struct("share", -F.col("state"))).alias("dominant"), F.min_by("state", F.struct("mean_return", "state")).alias("worst")
    )


def benchmark_curve(index: DataFrame, start: int, points: int) -> DataFrame:
    """k, date, level of an index (t, date, level) from bar `start` on, from 1, downsampled."""
    rows = index.where(F.col("t") >= start).select(F.lit("index").alias("of"), (F.col("t") - start).cast("int").alias("i"), "date", "level", "t")
    based = rows.withColumn("level", from_first(F.col("level"), "of", "t"))
    return downsampled(based, "of", points).select("k", "date", "level")


def split_labels(calendar: DataFrame, start: int, end: int) -> DataFrame:
    """One row: is_end, total, and the first and last dates in and out of sample, of (t, date)."""
    date = lambda t: F.max(F.when(F.col("t") == t, F.date_format("date", "yyyy-MM-dd")))
    n = F.max("t") + 1
    ends = calendar.agg(n.alias("total"), date(start).alias("a"), date(end - 1).alias("b"), date(end).alias("c"), F.max_by(F.date_format("date", "yyyy-MM-dd"), "t").alias("d"))
    return ends.select(F.lit(end).alias("is_end"), "total", F.concat_ws(" to ", "a", "b").alias("is_label"), F.concat_ws(" to ", "c", "d").alias("oos_label"))


def split_marker(total: int, end: int, start: int, points: int) -> int:
    """The place of the split on a curve of so many points."""
    return math.floor((end - start) / max(1, total - start) * (points - 1) + 0.5)


def tail_rebased(curve: DataFrame, out_bars: int, scored_bars: int, points: int) -> DataFrame:
    """k, v of the out-of-sample part of a curve (k, v), from 1, resampled to `points` places."""
    n = F.max("k") + 1
    cut = F.greatest(F.lit(0), n - F.floor(out_bars / max(1, scored_bars) * n + 0.5))
    tail = curve.withColumn("cut", curve.agg(cut.cast("int")).scalar()).where("k >= cut")
    based = tail.select(F.lit("tail").alias("of"), (F.col("k") - F.col("cut")).cast("int").alias("i"), "v")
    return resampled(based.select("i", from_first(F.col("v"), "of", "i").alias("v")), points)


def cluster_members(rows: DataFrame, cluster: int | None = None, most: int = 60) -> DataFrame:
    """The best-ranked survivors, of one cluster or of all."""
    some = rows if cluster is None else rows.where(F.col("cluster") == cluster)
    return some.orderBy("rank").limit(most)


def visible_series(rows: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """The rows of the chosen symbols; of all if none are chosen."""
    return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))
