"""The genetic search: draws and breeding on the driver, one Spark job a generation for fitness."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng as R
from ..schema import CURVE_POINTS, DEDUPE_DISTANCE, INSPECT_POINTS, MANUAL_POINTS, MOST_SURVIVORS, Search
from ..sources.bars import equal_weight_index
from ..sources.synthetic import synthetic
from . import backtest as B
from .arrays import Series
from . import clustering, features, genome as G, metrics as M, regimes, scoring, views


@dataclass
class Scored:
    genome: G.Genome
    fitness: float


@dataclass
class Run:
    generations: list[dict] = field(default_factory=list)
    survivors: list[Scored] = field(default_factory=list)
    evaluated: int = 0


def fee(config: Search) -> float:
    return (config.cost_bps + config.slippage_bps) / 10_000


def score_population(genomes: DataFrame, packed: DataFrame, config: Search, end: int, blocks: int = B.BLOCKS) -> DataFrame:
    """genome_id, fitness: backtest and score in one pass on the executors."""
    cost = fee(config)

    def work(s: Series, rows: pd.DataFrame) -> pd.DataFrame:
        done = B.results_of(s, rows, cost)
        return pd.DataFrame({"genome_id": rows["genome_id"], "fitness": [scoring.fitness_of(r.ret, r.position, r.trades, config, end) for r in done]})

    return B.by_block(genomes, packed, work, "genome_id string, fitness double", blocks)


def tournament(draw: G.Draw, pool: list[Scored], size: int = 3) -> Scored:
    """The fittest of some drawn; the first drawn of equals."""
    return max((pool[math.floor(draw() * len(pool))] for _ in range(size)), key=lambda s: s.fitness)


def diversity(draw: G.Draw, pool: list[Scored]) -> float:
    """Mean distance of drawn pairs."""
    if len(pool) < 4:
        return 0.0
    n = min(140, 2 * len(pool))
    one = lambda: pool[math.floor(draw() * len(pool))].genome
    return sum(G.distance(one(), one()) for _ in range(n)) / n


def breed(draw: G.Draw, ids: G.Ids, scored: list[Scored], config: Search, symbols: list[str], generation: int) -> list[G.Genome]:
    """Elites, then children of tournament winners, then fresh genomes."""
    size = config.population
    out = [s.genome for s in scored[: max(2, math.floor(size * config.elite_fraction))]]
    fresh = max(2, math.floor(size * 0.08))
    while len(out) < size - fresh:
        if draw() < config.crossover_rate:
            a, b = tournament(draw, scored), tournament(draw, scored)
            child = G.crossover(draw, ids, a.genome, b.genome, generation)
            if draw() < 0.5:
                child = G.mutate(draw, ids, child, config.mutation_rate * 0.5, symbols, generation)
        else:
            child = G.mutate(draw, ids, tournament(draw, scored).genome, config.mutation_rate, symbols, generation)
        out.append(child)
    while len(out) < size:
        out.append(G.random_genome(draw, ids, config.families, symbols, config.vol_target, generation))
    return out


def distinct_best(hall: list[Scored], most: int = MOST_SURVIVORS, apart: float = DEDUPE_DISTANCE) -> list[Scored]:
    """From the fittest down, those at least `apart` from all that are kept."""
    kept: list[Scored] = []
    for s in sorted(hall, key=lambda s: -s.fitness):
        if len(kept) < most and all(G.distance(k.genome, s.genome) >= apart for k in kept):
            kept.append(s)
    return kept


def search(
    bars: DataFrame, config: Search, progress: Callable[[dict], None] | None = None, stop: Callable[[], bool] | None = None
) -> Run:
    """Run the generations. progress gets each generation's figures; stop ends the search before the next one."""
    packed = B.packed_with_market(bars).persist()
    try:
        return _generations(packed, config, progress, stop)
    finally:
        packed.unpersist()


def _generations(packed: DataFrame, config: Search, progress: Callable[[dict], None] | None, stop: Callable[[], bool] | None) -> Run:
    spark = packed.sparkSession
    size = packed.select("symbol", F.size("close").alias("n")).collect()  # one row a symbol
    n = size[0]["n"]
    there = sorted(r["symbol"] for r in size)
    symbols = [s for s in config.symbols if s in there] or there
    end = scoring.split_at(n, config.split_ratio)
    draw, ids, run = R.mulberry32(config.seed ^ 0x9E3779B9), G.Ids(), Run()
    people = [G.random_genome(draw, ids, config.families, symbols, config.vol_target) for _ in range(config.population)]
    hall: dict[str, Scored] = {}
    known: dict[str, float] = {}
    for turn in range(config.generations):
        if stop and stop():
            break
        began = time.time()
        new = [g for g in people if g.genome_id not in known]  # elites keep their fitness
        known = {g.genome_id: known[g.genome_id] for g in people if g.genome_id in known}
        known |= {r["genome_id"]: r["fitness"] for r in score_population(G.frame(spark, new), packed, config, end).collect()}
        scored = sorted((Scored(g, known[g.genome_id]) for g in people), key=lambda s: -s.fitness)
        run.evaluated += len(scored)
        hall |= {s.genome.genome_id: s for s in scored[: max(20, math.floor(config.population * 0.3))]}
        fits = [s.fitness for s in scored]
        stat = {
            "generation": turn + 1, "best": fits[0], "median": fits[len(fits) // 2], "worst": fits[-1],
            "diversity": diversity(draw, scored), "evaluated": run.evaluated, "elapsed_ms": int((time.time() - began) * 1000),
        }
        run.generations.append(stat)
        if progress:
            progress(stat)
        if turn < config.generations - 1:
            people = breed(draw, ids, scored, config, symbols, turn + 1)
    run.survivors = distinct_best(list(hall.values()))
    return run


def evaluate(bars: DataFrame, genomes: DataFrame, config: Search, path: DataFrame | None = None) -> dict[str, DataFrame]:
    """All that is known of some genomes: bt, trades, metrics (is, oos), folds, robustness, ranks, features, regimes."""
    market = equal_weight_index(bars).select("t", "date", F.round("ret", 12).alias("bench"))
    n = market.count()
    end = scoring.split_at(n, config.split_ratio)
    packed = B.packed_with_market(bars)
    done = B.backtests(genomes, packed, fee(config)).persist()  # a row a genome, read by each part below
    bt, trades = B.bars_of(done), B.trades_of(done)
    both = M.metrics(bt, trades, market, [("is", config.warmup, end), ("oos", end, n)])
    ins, outs = both.where("slice = 'is'"), both.where("slice = 'oos'")
    folded = scoring.walk_forward(bt, trades, market, n, config)
    robust = scoring.robustness(folded)
    ranked = scoring.final_rank(
        outs.select("genome_id", "sharpe", "cagr", "max_drawdown", "vol", "avg_hold", "bench_corr").join(robust, "genome_id", "left").fillna(0.0, ["robustness"])
        .join(ins.select("genome_id", F.col("sharpe").alias("is_sharpe")), "genome_id").join(genomes.select("genome_id", "family", "symbol"), "genome_id")
    )
    # one row a genome, read twice
    z = features.standardised(features.combined(features.metric_features(ins, outs), features.behaviour(bt, end, n)).persist())
    out = {"bt": bt, "trades": trades, "metrics": both, "folds": folded, "robustness": robust, "ranked": ranked, "z": z}
    if path is not None:
        out["regimes"] = M.masked(bt, path, config.warmup)
    return out


def curves(bt: DataFrame, market: DataFrame, start: int, end: int, points: int = CURVE_POINTS) -> DataFrame:
    """genome_id, k, date, equity from 1, drawdown of [start, end), downsampled."""
    rows = M.with_equity(bt.where((F.col("t") >= start) & (F.col("t") < end)), ("genome_id",))
    based = rows.withColumn("equity", views.from_first(F.col("equity"), "genome_id", "t")).withColumn("i", (F.col("t") - start).cast("int"))
    dated = based.join(market.select("t", "date"), "t").select("genome_id", "i", "date", "equity", F.col("dd").alias("drawdown"))
    return views.downsampled(dated, "genome_id", points).select("genome_id", "k", "date", "equity", "drawdown")


def universe(spark: SparkSession, config: Search, custom: DataFrame | None = None) -> DataFrame:
    """The bars of a run: the caller's, or synthetic ones of its seed."""
    return synthetic(spark, config.seed) if custom is None else custom


def inspect(bars: DataFrame, genome: DataFrame, config: Search, seed: int | None = None) -> dict[str, DataFrame]:
    """One strategy in detail: curves with the index, the position, the price and the regime, last trades, metrics and
    months from the warm-up on, its regimes."""
    index = equal_weight_index(bars)
    market = index.select("t", "date", "level", F.round("ret", 12).alias("bench"))
    n = market.count()
    packed = B.packed_with_market(bars)
    done = B.backtests(genome, packed, fee(config)).persist()
    bt, trades = B.bars_of(done), B.trades_of(done)
    late = bt.where(F.col("t") >= config.warmup)
    path = regimes.decode(index, config.regime_states, config.seed if seed is None else seed)
    return {
        "curves": inspection_curves(bt, bars.join(genome.select("genome_id", "symbol"), "symbol"), market, config.warmup, n),
        "path": views.downsampled(path.where(F.col("t") >= config.warmup).select(F.lit("path").alias("of"), (F.col("t") - config.warmup).cast("int").alias("i"), "state"), "of", INSPECT_POINTS).select("k", "state"),
        "trades": views.recent_trades(trades),
        "metrics": M.metrics(bt, trades, market, [("all", config.warmup, n)]),
        "monthly": M.monthly_returns(late.join(market, "t"), ("genome_id",)),
        "regimes": M.masked(bt, path, config.warmup),
        "exits": views.exit_mix(trades),
        "position": late.select("genome_id", "t", "position"),
    }


def inspection_curves(bt: DataFrame, own: DataFrame, market: DataFrame, start: int, end: int) -> DataFrame:
    """genome_id, k, date, equity, drawdown, benchmark, position, price; the index (t, date, level) and the genome's own
    bars (genome_id, t, close) from 1."""
    rows = M.with_equity(bt.where((F.col("t") >= start) & (F.col("t") < end)), ("genome_id",))
    rows = rows.join(market.select("t", "date", "level"), "t").join(own.select("genome_id", "t", "close"), ["genome_id", "t"])
    first = lambda c: views.from_first(F.col(c), "genome_id", "t")
    based = rows.select(
        "genome_id", (F.col("t") - start).cast("int").alias("i"), "date", first("equity").alias("equity"), F.col("dd").alias("drawdown"), first("level").alias("benchmark"),
        "position", first("close").alias("price"),
    )
    return views.downsampled(based, "genome_id", INSPECT_POINTS).drop("i")


def evaluate_manual(bars: DataFrame, genome: DataFrame, config: Search) -> dict[str, DataFrame]:
    """A hand-made genome: metrics in and out of sample, folds and curves."""
    known = evaluate(bars, genome, config)
    market = equal_weight_index(bars).select("t", "date")
    n = market.count()
    return {"metrics": known["metrics"], "folds": known["folds"], "curves": curves(known["bt"], market, config.warmup, n, MANUAL_POINTS)}


def preview(bars: DataFrame, states: int = 4, seed: int = 11) -> dict[str, DataFrame]:
    """A universe at a glance: index from 1, regimes, and each instrument's figures."""
    index = equal_weight_index(bars)
    path = regimes.decode(index, states, seed).join(index.select("t", "ret"), "t")
    return {
        "index": index.withColumn("level", F.col("level") / 100),
        "path": path,
        "states": regimes.labels(regimes.moments(path)),
        "instruments": views.instrument_stats(bars),
    }


def survivors_frame(spark: SparkSession, run: Run) -> DataFrame:
    base = G.frame(spark, [s.genome for s in run.survivors])
    fits = spark.createDataFrame([(s.genome.genome_id, s.fitness) for s in run.survivors], "genome_id string, fitness double")
    return base.join(fits, "genome_id")


def hall_of_fame(scored: DataFrame, count: int, by: str = "generation") -> DataFrame:
    """The best `count` of each generation of (generation, genome_id, fitness)."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("fitness"), "genome_id"))
    return scored.withColumn("k", k).where(F.col("k") <= count)


def clusters(known: dict[str, DataFrame], config: Search) -> tuple[DataFrame, DataFrame]:
    """(genome_id, cluster, x, y), cluster summary) of evaluated genomes."""
    z = known["z"]
    placed = clustering.kmeans_labels(z, config.cluster_count, config.seed).join(clustering.embedding(z, config.seed), "genome_id")
    rows = known["ranked"].join(placed.select("genome_id", "cluster"), "genome_id").join(z, "genome_id")
    return placed, clustering.summary(rows)
