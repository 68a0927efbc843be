import math
from dataclasses import replace

import numpy as np
import pytest

from barloom.functions import rng as R
from barloom.operators import clustering as C
from barloom.operators import genome as G
from barloom.operators import regimes, search
from barloom.schema import FAMILIES, RISK, Search
from barloom.sources import synthetic


def test_random_numbers():
    for seed, want in ((1, 0.6270739405881613), (42, 0.6011037519201636), (20260912, 0.2859411621466279)):
        assert R.mulberry32(seed)() == want
    d = R.mulberry32(42)
    assert [d() for _ in range(4)][1:] == [0.44829055899754167, 0.8524657934904099, 0.6697340414393693]
    assert [R.hash_seed(s) for s in ("EQIX", "TECH", "DGTL")] == [3377928402, 2801781105, 3168150300]
    assert sorted(R.shuffle(R.mulberry32(3), range(9))) == list(range(9))


def people(n=60, seed=5):
    draw, ids = R.mulberry32(seed), G.Ids()
    return [G.random_genome(draw, ids, tuple(FAMILIES), ["A", "N"], 0.12) for _ in range(n)], draw, ids


def in_bounds(g):
    assert g.params == G.repair(g.family, g.params)
    for k, (lo, hi, _) in FAMILIES[g.family][1].items():
        assert g.params[k] >= lo - 1e-9 and (k in ("slow", "pctWindow", "smooth", "exitZ") or g.params[k] <= hi + 1e-9)
    assert 0.03 <= g.risk["vol_target"] <= 0.4 and all(RISK[k][0] <= g.risk[k] <= RISK[k][1] for k in ("max_leverage", "stop_atr", "take_atr", "max_hold", "cool_down"))


def test_genomes_stay_in_bounds():
    pool, draw, ids = people()
    for g in pool:
        in_bounds(g)
    for a, b in zip(pool, pool[1:]):
        child = G.crossover(draw, ids, a, b, 1)
        in_bounds(child)
        in_bounds(G.mutate(draw, ids, child, 0.9, ["A"], 2))
        assert 0 <= G.distance(a, b) <= 1 and G.distance(a, a) == 0 and G.distance(a, b) == G.distance(b, a)
    assert len({g.genome_id for g in pool}) == len(pool)
    assert [g.row() for g in people()[0]] == [g.row() for g in pool]
    edited = G.manual(pool[0], params={k: 1e9 for k in pool[0].params})
    in_bounds(edited)


def parent(family="trend", **more):
    risk = {"vol_target": 0.12, "max_leverage": 2.0, "stop_atr": 2.5, "take_atr": 5.0, "max_hold": 10, "cool_down": 3}
    params = {"trend": {"fast": 20, "slow": 100, "confirm": 40, "band": 0.002}, "carry": {"lookback": 60, "smooth": 10, "threshold": 0.4, "decay": 0.5}}[family]
    return G.Genome("p", family, "N", "both", params | more.pop("params", {}), risk | more, "seed", 0)


def test_mutation_with_draws_given():
    ids = G.Ids()
    low = G.mutate(lambda: 0.0, ids, parent(), 1.0, ["A", "N"], 4)
    assert low.params == {"fast": 3, "slow": 20, "confirm": 5, "band": 0.0} and (low.symbol, low.side) == ("A", "long")
    assert low.risk == {"vol_target": pytest.approx(0.09), "max_leverage": 1.5, "stop_atr": 0, "take_atr": 0, "max_hold": 0, "cool_down": 0}
    half = G.mutate(lambda: 0.5, ids, parent(), 1.0, ["A", "N"], 4)
    assert half.params == parent().params and (half.symbol, half.side, half.origin, half.parents, half.generation) == ("N", "both", "mutation", ["p"], 4)
    assert half.risk == {"vol_target": pytest.approx(0.123), "max_leverage": 2.1, "stop_atr": 3.5, "take_atr": 7.0, "max_hold": 63, "cool_down": 3}
    same = G.mutate(lambda: 0.99, ids, parent(), 0.5, ["A"], 1)
    assert (same.params, same.risk, same.symbol, same.side) == (parent().params, parent().risk, "N", "both")


def test_crossover_with_draws_given():
    other = parent(vol_target=0.2, max_leverage=1.0, stop_atr=0.0, params={"fast": 30, "slow": 50, "band": 0.01})
    child = G.crossover(lambda: 0.25, G.Ids(), parent(), other, 2)
    # a quarter of the first, three of the second, onto the steps
    assert child.params == {"fast": 28, "slow": 63, "confirm": 40, "band": 0.008} and child.risk["vol_target"] == pytest.approx(0.18)
    assert child.risk["max_leverage"] == 1.25 and child.risk["stop_atr"] == 2.5 and child.origin == "crossover" and child.parents == ["p", "p"]
    late = G.crossover(lambda: 0.75, G.Ids(), parent(), other, 2)
    assert late.risk["stop_atr"] == 0.0 and late.risk["take_atr"] == 5.0
    far = G.crossover(lambda: 0.25, G.Ids(), parent(), parent("carry", vol_target=0.2), 2)
    assert far.family == "trend" and far.params == parent().params and far.risk["vol_target"] == pytest.approx(0.18)


def test_distinct_best_is_greedy():
    pool, *_ = people(80, 9)
    hall = [search.Scored(g, float((7 * k) % 13)) for k, g in enumerate(pool)]
    kept = search.distinct_best(hall, most=10, apart=0.3)
    want = []
    for s in sorted(hall, key=lambda s: -s.fitness):
        if len(want) < 10 and min((G.distance(s.genome, w.genome) for w in want), default=1) >= 0.3:
            want.append(s)
    assert [s.genome.genome_id for s in kept] == [s.genome.genome_id for s in want] and len(kept) == 10


def test_coerce():
    assert G.coerce((0, 10, 0), 2.5) == 3 and G.coerce((0.6, 3.2, 0.05), 1.2249) == 1.2 and G.coerce((0, 8, 0.1), 4.8000001) == 4.8 and G.coerce((0, 8, 0.1), 99) == 8


@pytest.fixture(scope="module")
def bars(spark):
    return synthetic.synthetic(spark, seed=3, bars=700).cache()


def test_synthetic_bars(bars):
    bad = bars.where("low > least(open, close) or high < greatest(open, close) or close < 0.5").count()
    assert bad == 0 and bars.count() == 8 * 700 and bars.groupBy("symbol").count().where("count <> 700").count() == 0
    assert all(abs(sum(row) - 1) < 1e-12 for row in synthetic.transitions())


SMALL = Search(population=24, generations=3, min_trades=2, warmup=60)


def test_search_is_repeatable_and_improves(bars):
    seen = []
    one = search.search(bars, SMALL, progress=seen.append)
    two = search.search(bars.repartition(5), SMALL)
    assert [g["best"] for g in one.generations] == [g["best"] for g in two.generations]
    assert [s.genome.row() for s in one.survivors] == [s.genome.row() for s in two.survivors]
    assert len(seen) == 3 and one.evaluated == 72
    best = [g["best"] for g in one.generations]
    assert best == sorted(best)  # elites stay
    kept = [s.genome for s in one.survivors]
    assert all(G.distance(a, b) >= 0.05 for i, a in enumerate(kept) for b in kept[:i])
    assert search.search(bars, SMALL, stop=lambda: True).generations == []


def test_whole_evaluation(spark, bars):
    config = replace(SMALL, generations=1)
    run = search.search(bars, config)
    genomes = search.survivors_frame(spark, run).drop("fitness")
    known = search.evaluate(bars, genomes, config)
    placed, summary = search.clusters(known, config)
    n = len(run.survivors)
    assert placed.count() == n and known["ranked"].count() == n
    assert summary.agg({"size": "sum"}).first()[0] == n
    some = genomes.limit(1)
    shown = search.inspect(bars, some, config)
    assert shown["curves"].count() == 640 and shown["metrics"].count() == 1 and shown["regimes"].count() >= 1
    assert search.evaluate_manual(bars, some, config)["metrics"].count() == 2


def test_preview(bars):
    p = search.preview(bars, 3)
    assert p["instruments"].count() == 8 and p["path"].count() == 700
    states = p["states"].collect()
    assert abs(sum(s["share"] for s in states) - 1) < 1e-9 and len({s["label"] for s in states}) == len(states)


def test_hidden_markov_model_finds_two_regimes():
    rng = np.random.default_rng(0)
    truth = np.repeat([0, 1, 0, 1], 150)
    x = np.stack([rng.normal(truth * 3.0, 0.5), rng.normal(-truth * 2.0, 0.7)], axis=1)
    m = regimes.fit(x, 2)
    path = regimes.viterbi(m, x)
    assert max(np.mean(path == truth), np.mean(path != truth)) > 0.99
    assert np.allclose(m.moves.sum(axis=1), 1) and math.isfinite(m.log_likelihood)


def test_segments_cover_the_path(spark):
    states = [0, 0, 1, 1, 1, 0, 2]
    path = spark.createDataFrame(list(enumerate(states)), "t int, state int")
    got = sorted((r["start"], r["end"], r["state"]) for r in regimes.segments(path).collect())
    assert got == [(0, 1, 0), (2, 4, 1), (5, 5, 0), (6, 6, 2)]


def test_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (30, 4)), rng.normal(3, 0.2, (30, 4)), rng.normal(-3, 0.2, (30, 4))])
    labels, centres = C.auto_kmeans(x, 2, 6, 7)
    assert len(centres) == 3 and len(set(labels[:30])) == len(set(labels[30:60])) == 1
    assert C.silhouette_of(x, labels) > 0.8
    y = C.tsne(x, 10, 200)
    inside = np.linalg.norm(y[:30] - y[:30].mean(axis=0), axis=1).mean()
    assert inside < np.linalg.norm(y[:30].mean(axis=0) - y[30:60].mean(axis=0)) and abs(y.mean()) < 1e-9
    assert C.tsne(x[:2], 5).tolist() == [[-2, 0], [0, 0]]
