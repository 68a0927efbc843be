"""Bars on a common calendar, from tables and streams of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def common_calendar(rows: DataFrame, symbol: str = "symbol", time: str = "date") -> DataFrame:
    """The times that every symbol has: a count of distinct symbols per time, no join per symbol."""
    pairs = rows.select(symbol, time).distinct()
    total = pairs.agg(F.countDistinct(symbol).alias("_all"))
    return (
        pairs.groupBy(time).agg(F.count("*").alias("_n")).join(F.broadcast(total), F.col("_n") == F.col("_all")).select(time)
    )


def on_common_calendar(rows: DataFrame, symbol: str = "symbol", time: str = "date") -> DataFrame:
    """rows on the common calendar with t, the number of the time from 0."""
    kept = rows.join(common_calendar(rows, symbol, time), time, "left_semi")
    return kept.withColumn("t", (F.row_number().over(Window.partitionBy(symbol).orderBy(time)) - 1).cast("int"))


def _walk(x: DataFrame, time: str) -> DataFrame:
    """Damped index prices from (symbol, time, x, volume): returns follow x over its symbol's mean."""
    whole = Window.partitionBy("symbol")
    upto = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    by = Window.partitionBy("symbol").orderBy("t")
    stats = on_common_calendar(x, "symbol", time).select(
        "*", F.avg("x").over(whole).alias("m"), F.max("x").over(whole).alias("top"), F.min("x").over(whole).alias("low_x")
    )
    step = F.round(F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.lit(0.02) * (F.col("x") / F.col("m") - 1))), 10)
    close = stats.withColumn("close", F.round(100 * F.product(1 + step).over(upto), 4))
    opened = close.withColumn("open", F.coalesce(F.lag("close").over(by), F.lit(100.0)))
    return opened.select(
        "symbol", "t", time, "open",
        F.round(F.greatest("open", "close") * (1 + 0.01 * (F.col("top") - F.col("x")) / F.col("top")), 4).alias("high"),
        F.round(F.least("open", "close") * (1 - 0.01 * (F.col("x") - F.col("low_x")) / F.col("x")), 4).alias("low"),
        "close", F.col("volume").cast("double").alias("volume"),
    )


def _exact_mean(price: str):
    """Mean of money to two decimals, the same in whatever order rows come."""
    return F.sum(F.col(price).cast("decimal(18,2)")).cast("double") / F.count("*")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the return flags of lineitem."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = rows.groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        _exact_mean("l_extendedprice").alias("x"), F.count("*").alias("volume")
    )
    return _walk(x, "date")


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of the order priorities of orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x = rows.groupBy(
        F.col("o_orderpriority").alias("symbol"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")
    ).agg(_exact_mean("o_totalprice").alias("x"), F.count("*").alias("volume"))
    return _walk(x, "date")


def bars_of_events(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV of raw events (event_type, ts, value) in time buckets; batch or streaming."""
    bucket = F.window("ts", width)
    return events.groupBy(F.col("event_type").alias("symbol"), bucket.alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def bars_intraday(spark: SparkSession, sf_dir: str, width: str = "3 hours") -> DataFrame:
    """Bars of the event types on their common buckets."""
    return on_common_calendar(bars_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"), width), "symbol", "ts")


def equal_weight_index(bars: DataFrame) -> DataFrame:
    """t, date, level, ret: 100 at the start, then the mean simple return of all symbols each bar."""
    by = Window.partitionBy("symbol").orderBy("t")
    ret = F.coalesce(F.col("close") / F.lag("close").over(by) - 1, F.lit(0.0))
    day = bars.select("t", "date", ret.alias("r")).groupBy("t", "date").agg(F.avg("r").alias("ret"))
    # one row a bar of the calendar from here on
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("t", "date", (100 * F.product(1 + F.col("ret")).over(upto)).alias("level"), "ret")


def pack(bars: DataFrame) -> DataFrame:
    """One row a symbol with arrays in order of t."""
    fields = ["t", "date", "open", "high", "low", "close", "volume"]
    packed = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("b"))
    return packed.select("symbol", *(F.col(f"b.{f}").alias(f) for f in fields))


def unpack(packed: DataFrame) -> DataFrame:
    """pack undone."""
    fields = ["t", "date", "open", "high", "low", "close", "volume"]
    return packed.select("symbol", F.explode(F.arrays_zip(*fields)).alias("b")).select("symbol", *(F.col(f"b.{f}") for f in fields))


def business_days(spark: SparkSession, start: str, count: int) -> DataFrame:
    """t, date: the first `count` days from start that are no Saturday or Sunday."""
    days = spark.range(count * 7 // 5 + 9).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"))
    kept = days.where(~F.dayofweek("date").isin(1, 7))
    return kept.select((F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("t"), "date").where(F.col("t") < count)


def catalog(spark: SparkSession) -> DataFrame:
    """symbol, label, asset_class of the instruments of the synthetic source."""
    from .synthetic import INSTRUMENTS

    return spark.createDataFrame([(i.symbol, i.label, i.asset_class) for i in INSTRUMENTS], "symbol string, label string, asset_class string")
