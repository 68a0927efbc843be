"""Joins in time, chunked chains and k-means of whole tables as named queries; their twins are in series_sql.py."""

from __future__ import annotations

import uuid
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import apart, chains, kmeans, neighbours, regimes, sliding, table_functions
from ..operators.asof import asof_join as joined_asof
from ..operators.intervals import interval_join as joined_intervals
from ..shared import Scratch, shared_dir
from ..sources import ohlcv
from ..sources.genomes import FIXED
from ..streaming.bars import stream_bars
from ..streaming.online import Rule, batch_trades
from ..streaming.sessions import sessions
from .queries import Query, _packed, _path, _trades, bars, r, with_returns

QUERIES: dict[str, Query] = {}
STATES = 3


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- joins in time ------------------------------------------------------------------------


@query
def asof_join(spark, d):
    """Each event with the close of the last hourly bar of its type that had ended, if that was at most two hours ago."""
    events = spark.read.parquet(f"{d}/events.parquet")
    bars = stream_bars(events, "1 hour").select(F.col("symbol"), (F.col("ts") + F.expr("interval 1 hour")).alias("ended"), F.col("close").alias("prior_close"))
    out = joined_asof(events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol")), bars, ["symbol"], "ts", "ended", ["ended", "prior_close"], timedelta(hours=2))
    age = (F.unix_micros("ts") - F.unix_micros("ended")) / 1e6
    return out.select("event_id", "symbol", "prior_close", r(age, 3).alias("age"))


@query
def interval_join(spark, d):
    """Which regime segments each trade lies in, and how many bars they share."""
    pairs = joined_intervals(_trades(spark, d), regimes.segments(_path(spark, d)), [], ("entry_t", "exit_t"), ("start", "end"))
    return pairs.select(
        F.col("left.genome_id").alias("genome_id"), F.col("left.entry_t").alias("entry_t"), F.col("left.exit_t").alias("exit_t"), F.col("right.state").alias("state"),
        F.col("right.start").alias("segment_start"), "first", "last", "shared",
    )


@query
def event_sessions(spark, d):
    """The streaming sessions on a batch of events: runs of a user's events with gaps under two hours."""
    out = sessions(spark.read.parquet(f"{d}/events.parquet"), "2 hours")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("user_id", text("started"), text("ended"), "events", r("total", 4).alias("total"))


@query
def channel_trades(spark, d):
    """The batch ledger of the online channel rule on three-hour bars of the events."""
    trades = batch_trades(stream_bars(spark.read.parquet(f"{d}/events.parquet"), "3 hours"), Rule(8, 4))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return trades.select("symbol", "direction", text("opened"), text("closed"), "entry_price", "exit_price", "reason")


# --- sliding windows of any width ------------------------------------------------------------


@query
def sliding_extremes(spark, d):
    """Highest and lowest close of the last 250 bars."""
    return sliding.extremes(bars(spark, d), "close", 250)


@query
def sliding_percentile(spark, d):
    """The percentile of volume among the last 500 bars."""
    return sliding.percentiles(bars(spark, d), "volume", 500).select("symbol", "t", r("value").alias("value"))


# --- hidden Markov models of every symbol --------------------------------------------------


def _observed(spark, d) -> DataFrame:
    return chains.series_observations(with_returns(spark, d).select("symbol", "t", "ret"))


def _decoded(spark, d, work) -> DataFrame:
    observed = _observed(spark, d)
    with Scratch(spark) as scratch:
        parts = scratch.write(chains.packed(observed), "series")
        models = scratch.write(chains.start_models(observed, STATES, 1), "models")
        return scratch.keep(scratch.write(work(parts, models, scratch), "decoded"))


@query
def symbol_regime_shares(spark, d):
    """The smoothed chance of each state on every bar of every symbol, under the models that quantiles of the size of returns give."""
    out = _decoded(spark, d, lambda parts, models, scratch: chains.shares(parts, models, STATES, scratch))
    return out.select(F.col("series").alias("symbol"), F.col("t").cast("int").alias("t"), *(r(F.col("share")[s], 6).alias(f"p{s}") for s in range(STATES)))


@query
def symbol_regime_path(spark, d):
    """The likeliest path of states of every symbol under the same models."""
    out = _decoded(spark, d, lambda parts, models, scratch: chains.best_paths(parts, models, STATES, scratch))
    return out.select(F.col("series").alias("symbol"), F.col("t").cast("int").alias("t"), "state")


@query
def symbol_regime_fit(spark, d):
    """The model of every symbol after eight rounds of Baum-Welch, one row a state."""
    out = _decoded(spark, d, lambda parts, models, scratch: chains.fit_all(parts, models, STATES, 8, scratch))
    k, at = STATES, lambda n: F.element_at("model", F.lit(n) + F.col("state"))
    rows = out.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    mean = lambda e: F.element_at("model", F.lit(k + k * k + 1 + e) + 2 * F.col("state"))
    stay = F.element_at("model", F.lit(k + 1) + (k + 1) * F.col("state"))
    return rows.select(F.col("series").alias("symbol"), "state", r(at(1), 6).alias("start"), r(stay, 6).alias("stays"), r(mean(0), 6).alias("drift"), r(mean(1), 6).alias("size"), r("log_likelihood", 4).alias("log_likelihood"), "bars")


# --- k-means of all embeddings -----------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("z"), "label")


@query
def kmeans_rounds(spark, d):
    """Clusters of all embeddings after three of Lloyd's rounds from the first vector of each label."""
    rows = _vectors(spark, d)
    first = rows.groupBy("label").agg(F.min_by("z", "id").alias("z")).orderBy("label").collect()
    centres, _ = kmeans.lloyd(rows, np.array([x["z"] for x in first], np.float64), 3)
    return kmeans.assigned(rows, centres).select(F.col("id").alias("vec_id"), "cluster", r("distance", 6).alias("distance"))


@query
def kmeans_parallel(spark, d):
    """Clusters of all embeddings from k-means|| seeds, by size: the cost of a chosen k and each cluster's share of it."""
    out = kmeans.kmeans_all(_vectors(spark, d), 10)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), r(F.sum("distance"), 4).alias("cost"))


# --- rows apart --------------------------------------------------------------------------------


@query
def greedy_apart(spark, d):
    """The greedy choice among all embeddings, in order of vec_id, of vectors that are at least 0.9 apart."""
    rows = _vectors(spark, d).select("id", F.col("id").alias("place"), "z")
    return apart.first_apart(rows, 0.9).select(F.col("id").alias("vec_id"), "kept")


@query
def neighbour_graph(spark, d):
    """About the ten nearest of every embedding; a test measures how many are."""
    rows = _vectors(spark, d).select("id", F.col("z").cast("array<double>").alias("z"))
    with Scratch(spark) as scratch:
        near = scratch.keep(neighbours.graph(rows, 10, scratch))
    return near.select(F.col("id").alias("vec_id"), "other", r("distance", 6).alias("distance"))


@query
def neighbour_layout(spark, d):
    """A place in two dimensions for every embedding, from its ten nearest."""
    rows = _vectors(spark, d).select("id", F.col("z").cast("array<double>").alias("z"))
    with Scratch(spark) as scratch:
        placed = neighbours.layout(rows, neighbours.graph(rows, 10, scratch), scratch)
        return scratch.keep(placed).select(F.col("id").alias("vec_id"), r("x", 6).alias("x"), r("y", 6).alias("y"))


# --- SQL and sources ---------------------------------------------------------------------------


@query
def signal_function(spark, d):
    """signal() called from SQL for every fixed genome, on the bars of its symbol."""
    table_functions.register(spark)
    _packed(spark, d).select("symbol", F.posexplode(F.arrays_zip("open", "high", "low", "close", "bench")).alias("t", "b")).select("symbol", "t", "b.*").createOrReplaceTempView("bars_with_bench")
    calls = []
    for g, family, symbol, side, params, _ in FIXED:
        pairs = ", ".join(f"'{k}', {float(v)!r}D" for k, v in params.items())
        calls.append(f"SELECT '{g}' AS genome_id, round(signal, 8) + 0.0 AS signal FROM signal(TABLE(SELECT * FROM bars_with_bench WHERE symbol = '{symbol}'), '{family}', map({pairs}), side => '{side}')")
    long, short = (f"count(CASE WHEN signal {op} 0 THEN 1 END)" for op in "><")
    return spark.sql(f"SELECT genome_id, {long} AS long_bars, {short} AS short_bars, round(sum(signal), 5) + 0.0 AS total FROM ({' UNION ALL '.join(calls)}) GROUP BY genome_id")


@query
def ohlcv_files(spark, d):
    """Bars written with format("ohlcv") and read back for two symbols from one day on."""
    ohlcv.register(spark)
    path = f"{shared_dir(spark)}/barloom-ohlcv-{uuid.uuid4().hex}"
    bars(spark, d).select("symbol", "date", *ohlcv.FIELDS).write.format("ohlcv").mode("append").save(path)
    some = spark.read.format("ohlcv").load(path).where("symbol in ('A', 'R') and date >= date'1995-01-01'")
    out = some.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), r(F.sum("close"), 4).alias("closes"), r(F.sum("volume"), 4).alias("volumes"))
    with Scratch(spark) as scratch:
        out = scratch.keep(scratch.write(out, "ohlcv-sums"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def queries() -> dict[str, Query]:
    return dict(QUERIES)
