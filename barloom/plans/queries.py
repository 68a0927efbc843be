"""The engine's operators as named queries over the test tables; every one has a DuckDB twin
in oracle.py unless it draws random numbers or fits a model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, rng
from ..functions import stats as S
from ..operators import backtest as B
from ..operators import clustering, features
from ..operators import genome as G
from ..operators import kernels as K
from ..operators import metrics as M
from ..operators import regimes, scoring, search, signals, views
from ..schema import FAMILIES, RISK, Search
from ..sources import bars as bars_source
from ..sources import csv, synthetic
from ..sources.genomes import fixed
from ..streaming.bars import stream_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONFIG = Search(symbols=("A", "N", "R"))
FEE = search.fee(CONFIG)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(x: Column | str, digits: int = 8) -> Column:
    """Rounded for comparison between engines, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_KEPT: dict[tuple, DataFrame] = {}
_RUNS: dict[tuple, search.Run] = {}


def _key(name: str, spark: SparkSession, d: str) -> tuple:
    """name and the data: the application, the folder, and when its bars were written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/lineitem.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return spark.sparkContext.applicationId, d, status.getModificationTime(), name


def kept(name: str, spark: SparkSession, d: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A persisted intermediate that several steps of a query read: bars, packed series and
    backtests, all of the size of the calendar. Dropped by clearCache, it is computed again."""
    key = _key(name, spark, d)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key].persist()


def bars(spark: SparkSession, d: str) -> DataFrame:
    return kept("bars", spark, d, lambda: bars_source.bars_daily(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return kept("packed", spark, d, lambda: B.packed_with_market(bars(spark, d)))


def with_returns(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).withColumn("ret", K.simple_returns())


def market(spark: SparkSession, d: str) -> DataFrame:
    return kept("market", spark, d, lambda: bars_source.equal_weight_index(bars(spark, d)).withColumn("ret", F.round("ret", 12)))


def bench(spark: SparkSession, d: str) -> DataFrame:
    return market(spark, d).select("t", "date", F.col("ret").alias("bench"))


def one(kernel: Callable[[], Column], digits: int = 8) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return with_returns(spark, d).select("symbol", "t", r(kernel(), digits).alias("value"))

    return run


# --- sources -------------------------------------------------------------------------


@query
def bars_daily(spark, d):
    return bars(spark, d)


@query
def bars_weekly(spark, d):
    return bars_source.bars_weekly(spark, d)


@query
def bars_intraday(spark, d):
    return bars_source.bars_intraday(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query
def windowed_bars(spark, d):
    """The streaming operator on a batch of events."""
    return stream_bars(spark.read.parquet(f"{d}/events.parquet"), "1 hour").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query
def calendar_intersection(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("date"))
    return bars_source.common_calendar(rows)


@query
def business_calendar(spark, d):
    return bars_source.business_days(spark, "2013-01-02", 3024)


@query
def packed_series(spark, d):
    packed = bars_source.pack(bars(spark, d))
    back = bars_source.unpack(packed)
    return back.groupBy("symbol").agg(F.count("*").alias("n"), F.max("t").alias("last_t"), r(F.sum("close"), 4).alias("closes"))


@query
def instrument_catalog(spark, d):
    return bars_source.catalog(spark)


def _csv_lines(spark, d) -> DataFrame:
    """Orders as messy price lines: unreadable days, money signs, blanks, quotes and duplicates.

    There is no low column, so the header's one-letter fallback for it finds the close."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderpriority")
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    close = F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('"$'), price, F.lit('"'))).otherwise(price)
    opened = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.lit("100.5"))
    symbol = F.when(F.col("o_orderkey") % 13 == 0, F.lit("")).otherwise(F.lower("o_orderpriority"))
    sep = F.when(F.col("o_orderkey") % 2 == 0, ",").otherwise(";")
    return o.select(F.col("o_orderkey").alias("line_no"), F.concat(day, sep, symbol, sep, opened, sep, close).alias("line"))


@query
def csv_clean_rows(spark, d):
    lines = _csv_lines(spark, d).select("line_no", csv.cells_of(F.col("line")).alias("cells"))
    return csv.last_wins(csv.clean(lines, ["Date", "Ticker", "Open", "Adj Close"]))


@query
def csv_report(spark, d):
    lines = _csv_lines(spark, d).select("line_no", csv.cells_of(F.col("line")).alias("cells"))
    kept = csv.clean(lines, ["Date", "Ticker", "Open", "Adj Close"])
    read = lines.agg(F.count("*")).scalar()
    return kept.agg(F.count("*").alias("rows_kept"), F.countDistinct("symbol").alias("symbols")).withColumn("rows_read", read)


@query
def synthetic_universe(spark, d):
    return synthetic.synthetic(spark)


# --- kernels ---------------------------------------------------------------------------

QUERIES["simple_returns"] = one(lambda: K.simple_returns(), 10)
QUERIES["log_returns"] = one(lambda: K.log_returns(), 10)
QUERIES["sma"] = one(lambda: K.sma("close", 20))
QUERIES["rolling_stdev"] = one(lambda: K.rolling_stdev("close", 20))
QUERIES["roc"] = one(lambda: K.roc("close", 10))
QUERIES["true_range"] = one(lambda: K.true_range())
QUERIES["zscore"] = one(lambda: K.zscore("close", 30), 6)
QUERIES["realized_vol"] = one(lambda: K.realized_vol("ret", 20))
QUERIES["rolling_percentile"] = one(lambda: K.rolling_percentile("volume", 60))


@query
def rolling_extremes(spark, d):
    return bars(spark, d).select("symbol", "t", K.rolling_max("close", 25).alias("highest"), K.rolling_min("close", 25).alias("lowest"))


@query
def donchian(spark, d):
    hi, lo = K.donchian(40)
    return bars(spark, d).select("symbol", "t", hi.alias("channel_high"), lo.alias("channel_low"))


@query
def vol_percentile(spark, d):
    return K.vol_percentile(with_returns(spark, d), 20, 120).select("symbol", "t", r("vol_pct").alias("value"))


@query
def smooth_ignore_null(spark, d):
    rows = with_returns(spark, d).withColumn("x", F.when(F.col("volume") % 3 != 0, F.col("close")))
    return rows.select("symbol", "t", r(K.smooth("x", 8)).alias("value"))


@query
def carry_ir(spark, d):
    rows = with_returns(spark, d).join(bench(spark, d).select("t", F.col("bench").alias("bench_ret")), "t")
    return K.carry_ir(rows, 60, 10).select("symbol", "t", r("carry", 6).alias("value"))


@query
def equal_weight_index(spark, d):
    return market(spark, d).select("t", "date", r("level").alias("level"), r("ret", 12).alias("ret"))


@query
def ema(spark, d):
    return K.ema(bars(spark, d), 20).select("symbol", "t", r("ema").alias("value"))


@query
def ema_fold(spark, d):
    return K.ema_native(bars(spark, d), 20).select("symbol", "t", r("ema").alias("value"))


@query
def rsi(spark, d):
    return K.rsi(bars(spark, d), 14).select("symbol", "t", r("rsi").alias("value"))


@query
def atr(spark, d):
    return K.atr(bars(spark, d), 14).select("symbol", "t", r("atr").alias("value"))


@query
def indicator_table(spark, d):
    wanted = [("sma", 20), ("sma", 100), ("roc", 40), ("high", 40), ("low", 40), ("sma", 20)]
    return K.indicator_table(bars(spark, d), wanted).select("symbol", "t", "kernel", "w", r("value").alias("value"))


# --- signals and backtest ----------------------------------------------------------------


@query
def signal_trend(spark, d):
    return signals.trend(bars(spark, d), 20, 100, 40, 0.002)


@query
def signal_volatility(spark, d):
    return signals.volatility(bars(spark, d), 20, 120, 0.3, 0.8).select("symbol", "t", r("signal").alias("signal"))


@query
def signal_side_mask(spark, d):
    rows = signals.trend(bars(spark, d), 20, 100, 40, 0.002)
    return rows.select("symbol", "t", *(signals.side_mask(F.col("signal"), s).alias(s) for s in G.SIDES))


def _signals(spark, d, families: tuple[str, ...]) -> DataFrame:
    import numpy as np
    import pandas as pd

    def work(s, rows):
        v = np.round(signals.signals(s, [(f, dict(p), side) for f, p, side in zip(rows["family"], rows["params"], rows["side"])]), 8) + 0.0
        return pd.DataFrame({"genome_id": np.repeat(rows["genome_id"].to_numpy(), len(v)), "t": np.tile(np.arange(len(v)), len(rows)), "signal": v.T.ravel()})

    some = fixed(spark).where(F.col("family").isin(*families))
    return B.by_block(some, _packed(spark, d), work, "genome_id string, t int, signal double")


@query
def signal_breakout(spark, d):
    return _signals(spark, d, ("breakout",))


@query
def signal_mean_reversion(spark, d):
    return _signals(spark, d, ("meanReversion",))


@query
def signal_carry(spark, d):
    return _signals(spark, d, ("carry",))


@query
def signal_all(spark, d):
    return _signals(spark, d, tuple(FAMILIES)).groupBy("genome_id").agg(
        F.count(F.when(F.col("signal") > 0, 1)).alias("long_bars"), F.count(F.when(F.col("signal") < 0, 1)).alias("short_bars"), r(F.sum("signal"), 5).alias("total")
    )


@query
def position_sizing(spark, d):
    rows = with_returns(spark, d).withColumn("vol", K.realized_vol("ret", 20))
    return rows.select("symbol", "t", r(B.size(F.col("vol"), F.lit(0.12), F.lit(2.0), F.lit(1))).alias("size"))


def _done(spark, d) -> DataFrame:
    return kept("backtests", spark, d, lambda: B.backtests(fixed(spark), _packed(spark, d), FEE))


def _bt(spark, d) -> DataFrame:
    return B.bars_of(_done(spark, d))


def _trades(spark, d) -> DataFrame:
    return B.trades_of(_done(spark, d))


@query
def backtest_bars(spark, d):
    return rounded(_bt(spark, d), 7)


@query
def backtest_trades(spark, d):
    return rounded(_trades(spark, d), 8)


@query
def backtest_turnover(spark, d):
    return rounded(_done(spark, d).select("genome_id", "turnover"))


@query
def unknown_symbols(spark, d):
    more = fixed(spark).withColumn("symbol", F.when(F.col("genome_id") == "g05", "??").otherwise(F.col("symbol")))
    return B.unknown_symbols(more, bars(spark, d).select("symbol").distinct()).select("genome_id", "symbol")


# --- metrics and scoring -----------------------------------------------------------------


def _span(spark, d) -> tuple[int, int]:
    n = bars_source.common_calendar(
        spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("date"))
    ).count()
    return n, scoring.split_at(n, CONFIG.split_ratio)


def _metrics(spark, d, slices) -> DataFrame:
    return M.metrics(_bt(spark, d), _trades(spark, d), bench(spark, d), slices)


@query
def equity_curve(spark, d):
    rows = M.with_equity(_bt(spark, d).where(F.col("t") >= CONFIG.warmup), ("genome_id",))
    return rows.select("genome_id", "t", r("eq").alias("equity"))


@query
def drawdown_curve(spark, d):
    rows = M.with_equity(_bt(spark, d).where(F.col("t") >= CONFIG.warmup), ("genome_id",))
    return rows.select("genome_id", "t", r("dd").alias("drawdown"))


@query
def metrics_full(spark, d):
    n, _ = _span(spark, d)
    return rounded(_metrics(spark, d, [("all", CONFIG.warmup, n)]))


@query
def metrics_is_oos(spark, d):
    n, end = _span(spark, d)
    return rounded(_metrics(spark, d, [("is", CONFIG.warmup, end), ("oos", end, n)]))


def _monthly(spark, d) -> DataFrame:
    rows = _bt(spark, d).where(F.col("t") >= CONFIG.warmup).join(bench(spark, d), "t")
    return M.monthly_returns(rows, ("genome_id",))


@query
def monthly_returns(spark, d):
    return rounded(_monthly(spark, d), 8)


@query
def monthly_grid(spark, d):
    return rounded(views.monthly_grid(_monthly(spark, d), "genome_id"), 8)


@query
def year_totals(spark, d):
    return rounded(_monthly(spark, d).groupBy("genome_id", F.substring("month", 1, 4).alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("ret")), 8)


@query
def exit_mix(spark, d):
    return views.exit_mix(_trades(spark, d))


@query
def recent_trades(spark, d):
    return rounded(views.recent_trades(_trades(spark, d)), 8)


def _fitness(spark, d, objective: str) -> DataFrame:
    _, end = _span(spark, d)
    return scoring.fitness(_bt(spark, d), _trades(spark, d), bench(spark, d), replace(CONFIG, objective=objective), end)


@query
def objective_scores(spark, d):
    return rounded(_fitness(spark, d, "robust").select("genome_id", F.col("raw")), 6)


@query
def fitness_penalised(spark, d):
    return rounded(_fitness(spark, d, "sharpe"), 6)


def _folds(spark, d) -> DataFrame:
    n, _ = _span(spark, d)
    return scoring.walk_forward(_bt(spark, d), _trades(spark, d), bench(spark, d), n, CONFIG)


@query
def walk_forward_folds(spark, d):
    return rounded(_folds(spark, d))


@query
def robustness(spark, d):
    return rounded(scoring.robustness(_folds(spark, d)))


def _ranked(spark, d) -> DataFrame:
    n, end = _span(spark, d)
    m = _metrics(spark, d, [("is", CONFIG.warmup, end), ("oos", end, n)])
    outs, ins = m.where("slice = 'oos'"), m.where("slice = 'is'").select("genome_id", F.col("sharpe").alias("is_sharpe"))
    rows = outs.select("genome_id", "sharpe", "cagr", "max_drawdown", "vol", "avg_hold", "bench_corr").join(ins, "genome_id")
    rows = rows.join(scoring.robustness(_folds(spark, d)), "genome_id", "left").fillna(0.0, ["robustness"])
    return scoring.final_rank(rows.join(fixed(spark).select("genome_id", "family", "symbol"), "genome_id"))


@query
def final_ranking(spark, d):
    return rounded(_ranked(spark, d).select("genome_id", "family", "sharpe", "is_sharpe", "robustness", "rank"))


@query
def family_stats(spark, d):
    families = spark.createDataFrame([(f,) for f in FAMILIES], "family string")
    return rounded(scoring.family_stats(_ranked(spark, d), families))


@query
def leaderboard_filtered(spark, d):
    return rounded(views.leaderboard(_ranked(spark, d), positive=True).select("genome_id", "rank", "sharpe"))


@query
def overview_kpis(spark, d):
    return rounded(views.overview(_ranked(spark, d)))


@query
def top_k_hall(spark, d):
    docs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("generation"), F.col("o_orderkey").cast("string").alias("genome_id"), F.col("o_totalprice").alias("fitness"))
    return search.hall_of_fame(docs, 20)


@query
def downsample_curve(spark, d):
    level = market(spark, d).select(F.lit("m").alias("s"), F.col("t").alias("i"), "level")
    return views.downsampled(level, "s", 420).select("k", "i", r("level").alias("level"))


@query
def resample_nearest(spark, d):
    return views.resampled(market(spark, d).select(F.col("t").alias("i"), r("level").alias("v")), 333)


@query
def normalised_index(spark, d):
    rows = bars(spark, d).where("t >= 260")
    return rows.select("symbol", "t", r(views.from_first(F.col("close"), "symbol", "t")).alias("value"))


# --- regimes -----------------------------------------------------------------------------


def _path(spark, d) -> DataFrame:
    return regimes.rule_path(market(spark, d))


@query
def regime_observations(spark, d):
    return rounded(K.regime_observations(market(spark, d)), 8)


@query
def regime_segments(spark, d):
    return regimes.segments(_path(spark, d))


@query
def regime_moments(spark, d):
    return rounded(regimes.moments(_path(spark, d)))


@query
def regime_labels(spark, d):
    return regimes.labels(regimes.moments(_path(spark, d))).select("state", "label", "tone")


@query
def regime_dominant(spark, d):
    return views.dominant_and_worst(regimes.moments(_path(spark, d)))


@query
def regime_bands(spark, d):
    return rounded(views.bands(regimes.segments(_path(spark, d)), 260, 400))


@query
def masked_sharpe(spark, d):
    return rounded(M.masked(_bt(spark, d), _path(spark, d), CONFIG.warmup))


@query
def regime_atlas_strategy(spark, d):
    return rounded(views.atlas(M.masked(_bt(spark, d), _path(spark, d), CONFIG.warmup), "genome_id", [0, 1, 2]))


@query
def regime_atlas_family(spark, d):
    rows = M.masked(_bt(spark, d), _path(spark, d), CONFIG.warmup).join(fixed(spark).select("genome_id", "family"), "genome_id")
    return rounded(views.atlas(rows, "family", [0, 1, 2], middle=True))


@query
def regime_fit(spark, d):
    return regimes.decode(market(spark, d), CONFIG.regime_states, CONFIG.seed)


# --- genomes -----------------------------------------------------------------------------


@query
def genome_distance(spark, d):
    return rounded(G.distances(fixed(spark)), 8)


@query
def genome_repair(spark, d):
    broken = fixed(spark).withColumn("params", F.transform_values("params", lambda k, v: F.when(k.isin("exit", "exitZ", "smooth", "volWindow"), v * 6).otherwise(v)))
    fixed_up = broken.select("genome_id", F.explode(G.repair_column(F.col("family"), F.col("params"))).alias("key", "value"))
    return rounded(fixed_up, 8)


@query
def genome_coerce(spark, d):
    spec = [(k, float(a), float(b), float(s)) for _, p in FAMILIES.values() for k, (a, b, s) in p.items()]
    spec += [(f"risk.{k}", float(a), float(b), float(s)) for k, (a, b, s) in RISK.items()]
    bounds = spark.createDataFrame(sorted(set(spec)), "key string, low double, high double, step double")
    tried = bounds.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("k") * 0.173 - 0.1)
    return rounded(tried.select("key", "low", "high", "k", G.coerce_column(value, F.col("low"), F.col("high"), F.col("step")).alias("value")), 8)


@query
def genome_names(spark, d):
    g = fixed(spark)
    return g.select("genome_id", G.name_column(g).alias("name"), G.describe_column().alias("text"))


@query
def random_population(spark, d):
    draw, ids = rng.mulberry32(CONFIG.seed ^ 0x9E3779B9), G.Ids()
    people = [G.random_genome(draw, ids, CONFIG.families, CONFIG.symbols, CONFIG.vol_target) for _ in range(CONFIG.population)]
    return G.frame(spark, people)


# --- features and clusters ----------------------------------------------------------------


def _features(spark, d) -> DataFrame:
    n, end = _span(spark, d)
    m = _metrics(spark, d, [("is", CONFIG.warmup, end), ("oos", end, n)])
    return features.metric_features(m.where("slice = 'is'"), m.where("slice = 'oos'"))


@query
def metric_features(spark, d):
    return rounded(_features(spark, d))


@query
def behaviour_signature(spark, d):
    n, end = _span(spark, d)
    return rounded(features.behaviour(_bt(spark, d), end, n))


def _run(spark, d) -> search.Run:
    """The default search: 180 genomes, 12 generations. Its figures and survivors are small and stay on the driver."""
    key = _key("search", spark, d)
    if key not in _RUNS:
        _RUNS[key] = search.search(bars(spark, d), CONFIG)
    return _RUNS[key]


def _survivor_genomes(spark, d) -> DataFrame:
    return search.survivors_frame(spark, _run(spark, d))


def _evaluated(spark, d) -> dict[str, DataFrame]:
    return search.evaluate(bars(spark, d), _survivor_genomes(spark, d).drop("fitness"), CONFIG)


def _survivors(spark, d) -> DataFrame:
    """genome_id, z: the standardised features of the survivors of a search, capped by the search itself."""
    return kept("survivors", spark, d, lambda: _evaluated(spark, d)["z"])


def _all_vectors(spark, d) -> DataFrame:
    """All embeddings with all their components."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.col("vec_id").cast("string").alias("genome_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster"))


def _standardised(vectors: DataFrame) -> DataFrame:
    z = features.standardised(vectors)
    return z.select("genome_id", F.posexplode("z").alias("k", "z")).select("genome_id", "k", r("z").alias("z"))


@query
def feature_standardise(spark, d):
    return _standardised(_all_vectors(spark, d))


QUERIES["feature_standardise_all"] = feature_standardise


def _nearest(vectors: DataFrame) -> DataFrame:
    v = vectors.withColumnRenamed("features", "z")
    long = v.select("cluster", F.posexplode("z").alias("k", "x")).groupBy("cluster", "k").agg(F.avg("x").alias("x"))
    c = long.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("c"))
    return rounded(clustering.nearest_centroid(v.select("genome_id", "z"), c))


@query
def nearest_centroid(spark, d):
    return _nearest(_all_vectors(spark, d))


QUERIES["nearest_centroid_all"] = nearest_centroid


@query
def silhouette(spark, d):
    return rounded(clustering.silhouette(_all_vectors(spark, d).withColumnRenamed("features", "z")))


QUERIES["silhouette_all"] = silhouette


@query
def kmeans_labels(spark, d):
    return clustering.kmeans_labels(_survivors(spark, d), CONFIG.cluster_count, CONFIG.seed)


@query
def tsne_embedding(spark, d):
    return clustering.embedding(_survivors(spark, d), CONFIG.seed)


def _clustered(spark, d) -> DataFrame:
    """The fixed genomes with their standardised features, two clusters by symbol."""
    n, end = _span(spark, d)
    z = features.standardised(features.combined(_features(spark, d), features.behaviour(_bt(spark, d), end, n)))
    return _ranked(spark, d).withColumn("cluster", F.when(F.col("symbol") == "A", 0).otherwise(1)).join(z, "genome_id")


@query
def combined_features(spark, d):
    n, end = _span(spark, d)
    both = features.combined(_features(spark, d), features.behaviour(_bt(spark, d), end, n))
    z = features.standardised(both.withColumn("features", F.transform("features", lambda x: F.round(x, 8))))
    return z.select("genome_id", F.posexplode("z").alias("k", "z")).select("genome_id", "k", r("z", 5).alias("z"))


@query
def cluster_members(spark, d):
    rows = _ranked(spark, d).withColumn("cluster", F.when(F.col("symbol") == "A", 0).otherwise(1))
    return views.cluster_members(rows, 1).select("genome_id", "cluster", "rank")


@query
def cluster_summary(spark, d):
    s = clustering.summary(_clustered(spark, d))
    return rounded(s.select("cluster", "size", "sharpe", "cagr", "max_drawdown", "vol", "medoid_id"))


@query
def cluster_labels(spark, d):
    return clustering.summary(_clustered(spark, d)).select("cluster", "label")


def _blobs(vectors: DataFrame) -> DataFrame:
    v = vectors.select("cluster", (F.element_at("features", 1) * 100).alias("x"), (F.element_at("features", 2) * 100).alias("y"))
    return rounded(clustering.blobs(v))


@query
def cluster_blobs(spark, d):
    return _blobs(_all_vectors(spark, d))


QUERIES["cluster_blobs_all"] = cluster_blobs


@query
def instrument_stats(spark, d):
    return rounded(views.instrument_stats(bars(spark, d)), 8)


@query
def extents(spark, d):
    return rounded(views.extents(bars(spark, d), "symbol", "close"))


@query
def moments_of_returns(spark, d):
    x = F.col("ret")
    return with_returns(spark, d).groupBy("symbol").agg(
        r(S.mean(x), 10).alias("mean"), r(S.variance(x), 10).alias("variance"), r(S.stdev(x), 10).alias("stdev"), r(S.skew(x), 6).alias("skew"),
        r(S.excess_kurtosis(x), 6).alias("kurtosis"), r(S.quantile(x, 0.95), 10).alias("p95"), r(S.median(x), 10).alias("median"),
        r(S.upper_median(x), 10).alias("upper_median"), r(S.lower_median(x), 10).alias("lower_median"), r(S.correlation(x, F.col("volume")), 6).alias("corr"),
    )


@query
def display_text(spark, d):
    v = F.col("close") * 12_345.678 - 1_000_000
    return bars(spark, d).select(
        "symbol", "t", formats.integer(F.col("close") * 1000).alias("integer"), formats.compact(F.floor(v) + 0.25).alias("compact"), formats.short_date(F.col("date")).alias("short_date"),
        formats.month_label(F.col("date")).alias("month"), formats.duration(F.floor(F.col("close") * 777) + 0.25).alias("duration"),
    )


# --- runs, inspection, preview -----------------------------------------------------------------


@query
def search_run(spark, d):
    run = _run(spark, d)
    return spark.createDataFrame([tuple(g[k] for k in ("generation", "best", "median", "worst", "diversity", "evaluated")) for g in run.generations], "generation int, best double, median double, worst double, diversity double, evaluated int")


@query
def search_survivors(spark, d):
    """The survivors of the search: distinct genomes of the hall, capped at 140 as the feature is, with fitness and final rank."""
    ranked = _evaluated(spark, d)["ranked"].select("genome_id", "sharpe", "is_sharpe", "robustness", "rank")
    return _survivor_genomes(spark, d).join(ranked, "genome_id")


@query
def survivor_clusters(spark, d):
    placed, _ = search.clusters(_evaluated(spark, d), CONFIG)
    return placed


@query
def survivor_cluster_summary(spark, d):
    _, summary = search.clusters(_evaluated(spark, d), CONFIG)
    return rounded(summary)


@query
def benchmark_curve(spark, d):
    return views.benchmark_curve(market(spark, d), CONFIG.warmup, 420).select("k", "date", r("level").alias("level"))


@query
def split_labels(spark, d):
    _, end = _span(spark, d)
    return views.split_labels(market(spark, d), CONFIG.warmup, end)


@query
def split_marker(spark, d):
    n, end = _span(spark, d)
    return spark.createDataFrame([(views.split_marker(n, end, CONFIG.warmup, 700),)], "marker int")


@query
def benchmark_tail(spark, d):
    n, end = _span(spark, d)
    curve = views.benchmark_curve(market(spark, d), CONFIG.warmup, 420).select("k", F.col("level").alias("v"))
    return views.tail_rebased(curve, n - end, n - CONFIG.warmup, 420).select("k", r("v").alias("v"))


@query
def visible_series(spark, d):
    return views.visible_series(bars(spark, d), ["A", "R"]).groupBy("symbol").agg(F.count("*").alias("n"), r(F.sum("close"), 4).alias("closes"))


@query
def custom_universe(spark, d):
    return search.universe(spark, CONFIG, bars(spark, d)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def _inspected(spark, d, part: str) -> DataFrame:
    return rounded(search.inspect(bars(spark, d), fixed(spark).where("genome_id = 'g03'"), CONFIG)[part])


@query
def inspect_curves(spark, d):
    return _inspected(spark, d, "curves")


@query
def inspect_metrics(spark, d):
    return _inspected(spark, d, "metrics")


@query
def inspect_trades(spark, d):
    return _inspected(spark, d, "trades")


@query
def inspect_monthly(spark, d):
    return _inspected(spark, d, "monthly")


@query
def inspect_regime_path(spark, d):
    return _inspected(spark, d, "path")


def _by_hand(spark, d, part: str) -> DataFrame:
    return rounded(search.evaluate_manual(bars(spark, d), fixed(spark).where("genome_id = 'g05'"), CONFIG)[part])


@query
def manual_metrics(spark, d):
    return _by_hand(spark, d, "metrics")


@query
def manual_folds(spark, d):
    return _by_hand(spark, d, "folds")


@query
def manual_curves(spark, d):
    return _by_hand(spark, d, "curves")


@query
def preview_index(spark, d):
    return search.preview(bars(spark, d))["index"].select("t", "date", r("level").alias("level"))


@query
def preview_instruments(spark, d):
    return rounded(search.preview(bars(spark, d))["instruments"], 8)


@query
def preview_states(spark, d):
    return rounded(search.preview(bars(spark, d))["states"])


@query
def flagship(spark, d):
    """A trend rule held from the next bar, scored per symbol: bars, windows and aggregation alone."""
    b = with_returns(spark, d)
    fast, slow, way = K.sma("close", 20), K.sma("close", 60), K.roc("close", 20)
    by = Window.partitionBy("symbol").orderBy("t")
    spread = F.try_divide(fast, slow) - 1
    sig = F.when((spread > 0.002) & (way > 0), 1.0).when((spread < -0.002) & (way < 0), -1.0).otherwise(0.0)
    held = b.withColumn("sig", sig).withColumn("pos", F.coalesce(F.lag("sig").over(by), F.lit(0.0)))
    rows = M.with_equity(held.select(F.col("symbol").alias("genome_id"), "t", (F.col("pos") * F.col("ret")).alias("ret"), "pos"), ("genome_id",))
    year = F.sqrt(F.lit(252.0))
    return rows.groupBy(F.col("genome_id").alias("symbol")).agg(
        F.count("*").alias("bars"), r(S.sharpe(S.mean("ret"), S.stdev("ret")), 6).alias("sharpe"), r(S.stdev("ret") * year, 6).alias("vol"),
        r(F.max_by("eq", "t"), 6).alias("final"), r(F.min("dd"), 6).alias("max_drawdown"), r(F.avg(F.when(F.col("pos") != 0, 1.0).otherwise(0.0)), 6).alias("exposure"),
    )


def queries() -> dict[str, Query]:
    from . import series  # it builds on the queries above

    return QUERIES | series.queries()
