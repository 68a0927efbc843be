"""As-of join: to each row the last earlier row of another table with the same key, at most a tolerance old."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of both tables that a time bucket of one key should hold, were they spread evenly over time.
BUCKET_ROWS = 1 << 20


def _ticks(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp, days of a date, else the number itself."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.unix_date(F.col(name)) if kind == "date" else F.col(name)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], tolerance: timedelta | float | None = None, width: float | None = None) -> DataFrame:
    """left with the columns `values` of the last right row with the same `by` and right_at <= left_at; nulls where there is none,
    or it is older than the tolerance (microseconds of timestamps, days of dates).

    Both tables go into one, which is sorted once by key and time; the last right row is carried along. A key's time
    is cut into buckets of `width`, each a window of its own, so a hot key is no single task; what a bucket begins
    with comes from the last right rows of earlier buckets, one row a bucket. Of right rows with equal time the one with the largest
    values counts. Left rows with a null key or time match nothing, right ones aren't matched.
    """
    here, there = _ticks(left, left_at), _ticks(right, right_at)
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    held = right.select(*named, there.alias("_at"), F.struct(there.alias("_at"), *values).alias("_right")).where(_all_there(["_at", *keys]))
    kind = held.schema["_right"].dataType
    rows = left.select(*named, here.alias("_at"), F.struct(*(F.col(c) for c in left.columns)).alias("_left"))
    sound = rows.where(_all_there(["_at", *keys]))
    rest = rows.where(~_all_there(["_at", *keys])).select("_left", F.lit(None).cast(kind).alias("_right"))
    both = sound.withColumn("_right", F.lit(None).cast(kind)).unionByName(held.withColumn("_left", F.lit(None).cast(rows.schema["_left"].dataType)))
    if width is None:
        width = _width(both)
    both = both.withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)))
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_at", F.col("_left").isNotNull(), "_right").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_found", F.last("_right", ignorenulls=True).over(upto)).where("_left is not null")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "_bucket").agg(F.max("_right").alias("_last")).withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
    out = inside.join(carried.select(*keys, "_bucket", "_carried"), [*keys, "_bucket"], "left").withColumn("_right", F.coalesce("_found", "_carried"))
    if tolerance is not None:
        most = tolerance // timedelta(microseconds=1) if isinstance(tolerance, timedelta) else tolerance
        out = out.withColumn("_right", F.when(F.col("_at") - F.col("_right._at") <= F.lit(most), F.col("_right")))
    return out.select("_left", "_right").unionByName(rest).select("_left.*", *(F.col(f"_right.{c}").alias(c) for c in values))


def _all_there(names: list[str]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    return ok


def _width(both: DataFrame) -> float:
    """Ticks of BUCKET_ROWS rows, from the span of time and the number of rows."""
    low, high, n = both.agg(F.min("_at"), F.max("_at"), F.count("*")).first()
    return max(1, (float(high) - float(low) + 1) * BUCKET_ROWS / n) if n else 1
