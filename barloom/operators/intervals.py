"""Interval join: pairs of intervals that overlap, by equality on the cells of a dyadic grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The level whose cells, 2 ** level long, are the shortest that are as long as the interval: it touches two of them at most."""
    n = end - start
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def _cells(level: str) -> Column:
    return F.explode(F.sequence(F.expr(f"shiftright(_start, {level})"), F.expr(f"shiftright(_end, {level})"))).alias("_cell")


def _ready(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    span = df.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.struct(*(F.col(c) for c in df.columns)).alias("_row"),
        F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"),
    ).where("_start <= _end")
    return span.withColumn("_level", _level(F.col("_start"), F.col("_end")))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """left, right (structs), first, last, shared: each pair with equal `by` whose whole-number spans [start, end] overlap, once, and what they share.

    An interval has the level of its length. A pair meets at the larger of its two levels, where each touches two cells
    at most, so a long interval is no list of short cells. Equal cells are an equi-join, shuffled by key, level and
    cell; of the two cells where a pair may meet, only the one with its first common cell counts. Two joins, by which
    side is the longer one, keep short intervals from meeting at levels that neither has. The levels (64 at most) of the
    two sides are looked up first. Intervals with a null or turned span, and rows with a null key, overlap nothing.
    """
    a, b = _ready(left, by, *left_span), _ready(right, by, *right_span)
    levels = {x: sorted(r[0] for r in side.select("_level").distinct().collect()) for x, side in (("a", a), ("b", b))}
    keys = [f"_k{i}" for i in range(len(by))]

    def own(side: DataFrame) -> DataFrame:
        return side.select("*", F.col("_level").alias("_at")).select("*", _cells("_at"))

    def under(side: DataFrame, at: list[int], strictly: bool) -> DataFrame:
        """The side's intervals at those levels of the other side that are as long as theirs, or longer."""
        fits = F.filter(F.array(*map(F.lit, at)) if at else F.array().cast("array<int>"), lambda x: x > F.col("_level") if strictly else x >= F.col("_level"))
        return side.select("*", F.explode(fits).alias("_at")).select("*", _cells("_at"))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.select(*keys, "_at", "_cell", F.col("_row").alias("left"), F.col("_start").alias("s1"), F.col("_end").alias("e1"))
        y = y.select(*keys, "_at", "_cell", F.col("_row").alias("right"), F.col("_start").alias("s2"), F.col("_end").alias("e2"))
        pairs = x.join(y, [*keys, "_at", "_cell"]).where("s1 <= e2 and s2 <= e1 and _cell = shiftright(greatest(s1, s2), _at)")
        return pairs.select("left", "right", F.greatest("s1", "s2").alias("first"), F.least("e1", "e2").alias("last"))

    both = met(own(a), under(b, levels["a"], False)).union(met(under(a, levels["b"], True), own(b)))
    return both.withColumn("shared", F.col("last") - F.col("first") + 1)
