import math

import numpy as np
import pandas as pd
import pytest

from barloom.operators import backtest as B
from barloom.operators import metrics as M
from barloom.operators.arrays import Series
from barloom.operators.signals import latch, signal
from barloom.schema import Search
from barloom.operators import scoring

CLOSE = [100, 102, 101, 104, 99, 103, 105, 104, 108, 107]


def trace(**risk):
    r = B.Risk(**({"vol_target": 0.12, "max_leverage": 2, "stop_atr": 1.5, "cool_down": 2} | risk))
    want = np.array([0.0, 1, 1, 1, 1, 1, 1, -1, -1, 0])[:, None]
    return B.run([c + 1 for c in CLOSE], [c - 1 for c in CLOSE], CLOSE, want, [0.24] * 10, [2.0] * 10, [r], 5e-4)[0]


def test_trace():
    r = trace()
    assert r.position.tolist() == [0, 0, 0.5, 0.5, 0.5, 0, 0, 0.5, 0, -0.5]
    want = [0, -0.00025, -0.00490196, 0.01485149, -0.02428846, 0, -0.00025, -0.0050119, -0.00025, 0.00437963]
    assert np.allclose(r.ret, want, atol=1e-8) and abs(r.equity[-1] - 0.98396539) < 1e-8 and abs(r.turnover - 3) < 1e-12
    assert [(a, b, d, n, why) for a, b, d, _, n, why in r.trades] == [(1, 4, 1, 3, "stop"), (6, 7, 1, 1, "signal"), (8, 9, -1, 1, "signal")]
    assert np.allclose([x[3] for x in r.trades], [-0.01489797, -0.00526065, 0.00412853], atol=1e-8)


def test_timeout_and_target():
    assert "timeout" in {x[5] for x in trace(stop_atr=0, max_hold=1).trades}
    assert "target" in {x[5] for x in trace(stop_atr=0, take_atr=0.5).trades}


def random_series(seed=1, n=700):
    rng = np.random.default_rng(seed)
    c = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
    o = np.concatenate([[100], c[:-1]])
    return Series(o, np.maximum(o, c) * 1.002, np.minimum(o, c) * 0.998, c, rng.normal(0, 0.005, n))


def test_cost_is_linear_in_turnover():
    s = random_series()
    made = [B.evaluate(s, [("trend", {"fast": 10, "slow": 40, "confirm": 10, "band": 0.0}, "both")], [B.Risk(0.1, 2)], fee)[0] for fee in (0, 0.0005)]
    gap = sum(made[0].ret) - sum(made[1].ret)
    assert abs(gap - 0.0005 * made[0].turnover) < 1e-9


@pytest.mark.parametrize("family,params", [
    ("trend", {"fast": 10, "slow": 40, "confirm": 10, "band": 0.0}), ("breakout", {"entry": 20, "exit": 10, "volWindow": 10, "volCeil": 0.9}),
    ("meanReversion", {"zWindow": 20, "entryZ": 1.0, "exitZ": 0.2, "rsiWindow": 8, "rsiBand": 40}), ("carry", {"lookback": 40, "smooth": 5, "threshold": 0.3, "decay": 0.5}),
    ("volatility", {"volWindow": 10, "pctWindow": 80, "lowPct": 0.3, "highPct": 0.8, "mode": 1}),
])
def test_signals_do_not_look_ahead(family, params):
    s = random_series()
    cut = Series(*(getattr(s, f)[:500] for f in ("open", "high", "low", "close", "bench")))
    full = signal(s, family, params, "both")
    assert np.allclose(full[:500], signal(cut, family, params, "both")) and (full != 0).any()
    assert (signal(s, family, params, "long") >= 0).all() and (signal(s, family, params, "short") <= 0).all()


def test_latch_ignores_entries_while_in():
    t, f = True, False
    out = latch(*(np.array(x) for x in ([t, f, f, t, f], [f, t, f, t, f], [f, f, t, f, f], [f, f, f, f, f], [f, f, f, f, t])))
    assert out.tolist() == [1, 1, 0, 1, 0]
    assert (signal(random_series(), "none", {}, "both") == 0).all()


def stepped(high, low, close, wanted, vol, atr, r, fee):
    """One genome, one bar after the other, in plain Python."""
    ret, position, trades, turnover = [0.0], [0.0], [], 0.0
    carried, side, wait, book = 0.0, 1, 0, None
    for t in range(1, len(close)):
        position.append(carried)
        earned, why = 0.0, None
        if carried:
            if book["stop"] > 0 and (low[t] <= book["stop"] if side > 0 else high[t] >= book["stop"]):
                why, price = "stop", book["stop"]
            elif book["goal"] > 0 and (high[t] >= book["goal"] if side > 0 else low[t] <= book["goal"]):
                why, price = "target", book["goal"]
            else:
                price = close[t]
                book["held"] += 1
                if r.max_hold > 0 and book["held"] >= r.max_hold:
                    why = "timeout"
            earned = carried * (price / close[t - 1] - 1)
        now = carried
        if why:
            earned -= abs(carried) * fee
            turnover += abs(carried)
            trades.append((book["t"], t, side, book["growth"] * (1 + earned) - 1, max(1, t - book["t"]), why))
            book, now, wait = None, 0.0, r.cool_down
        aim = 0.0 if math.isnan(wanted[t]) else wanted[t]
        way = int(np.sign(aim))
        amount = 0.0 if math.isnan(vol[t]) or vol[t] <= 1e-6 else min(r.max_leverage, r.vol_target / vol[t]) * abs(aim)
        nxt = now
        if now:
            nxt = 0.0 if way != side else amount * side if abs(amount * side - now) > 0.2 * abs(now) else now
        elif way and wait <= 0:
            side = way
            nxt = amount * side if amount >= 1e-4 else 0.0
        wait = max(0, wait - 1)
        if abs(nxt - now) > 1e-9:
            earned -= abs(nxt - now) * fee
            turnover += abs(nxt - now)
            if now and not nxt:
                trades.append((book["t"], t, side, book["growth"] * (1 + earned) - 1, max(1, t - book["t"]), "signal"))
                book = None
            elif nxt and not now:
                known = not math.isnan(atr[t])
                level = lambda x: max(0.0, close[t] + side * x * atr[t]) if x and known else 0.0
                book = {"t": t, "growth": 1.0, "held": 0, "stop": level(-r.stop_atr), "goal": level(r.take_atr)}
        if book and nxt and not why:
            book["growth"] *= 1 + earned
        ret.append(earned)
        carried = nxt
    if carried and book:
        trades.append((book["t"], len(close) - 1, side, book["growth"] - 1, max(1, len(close) - 1 - book["t"]), "end"))
    return ret, position, trades, turnover


def test_a_block_steps_like_each_genome_alone():
    rng = np.random.default_rng(4)
    s = random_series(7, 400)
    risks = [B.Risk(rng.uniform(0.05, 0.3), rng.uniform(0.3, 3), rng.choice([0, 1.0, 2.5]), rng.choice([0, 2.0, 5.0]), int(rng.choice([0, 5, 20])), int(rng.choice([0, 1, 4]))) for _ in range(60)]
    want = np.repeat(rng.choice([-1, -0.5, 0, 0.4, 1, np.nan], (80, 60), p=[0.2, 0.1, 0.3, 0.1, 0.2, 0.1]), 5, axis=0)
    vol, atr = s.get("size_vol"), s.get("size_atr")
    for g, (one, r) in enumerate(zip(B.run(s.high, s.low, s.close, want, vol, atr, risks, 5e-4), risks)):
        ret, position, trades, turnover = stepped(s.high, s.low, s.close, want[:, g], vol, atr, r, 5e-4)
        # a trade that is stopped and reopened on its last bar has no growth of that bar in either
        assert np.allclose(one.ret, ret, atol=1e-12) and np.allclose(one.position, position, atol=1e-12) and abs(one.turnover - turnover) < 1e-9
        assert [x[:3] + x[4:] for x in one.trades] == [x[:3] + x[4:] for x in trades] and np.allclose([x[3] for x in one.trades], [x[3] for x in trades], atol=1e-12)


R = [0.01, -0.02, 0.015, 0, -0.005, 0.02, -0.01, 0.005, 0.012, -0.018] * 2


def test_metrics_by_hand(spark):
    days = pd.bdate_range("2020-01-01", periods=20)
    bt = spark.createDataFrame([("g", t, float(x), 1.0, 1.0) for t, x in enumerate(R)], "genome_id string, t int, ret double, position double, equity double")
    trades = spark.createDataFrame([], "genome_id string, entry_t int, exit_t int, direction int, return_pct double, bars int, exit_reason string")
    market = spark.createDataFrame([(t, d.date(), 0.0) for t, d in enumerate(days)], "t int, date date, bench double")
    got = {r["slice"]: r for r in M.metrics(bt, trades, market, [("all", 0, 20), ("short", 0, 19)]).collect()}
    want = {
        "sharpe": 1.05722484, "sortino": 0.98066106, "vol": 0.21452390, "max_drawdown": -0.02801640, "ulcer": 0.01227005, "cagr": 0.22731494,
        "calmar": 8.11363856, "tail_ratio": 1, "skew": -0.25689081, "kurtosis": -1.41482584, "bench_corr": 0, "trades": 0, "exposure": 1,
    }
    for k, v in want.items():
        assert abs(got["all"][k] - v) < 1e-7, k
    assert all(got["short"][k] == 0 for k in M.METRICS)
    one = M.scores(np.array(R), np.ones(20), [], 0, 20)
    assert all(abs(one[k] - got["all"][k]) < 1e-9 for k in one)


def test_fitness_matches_the_executors_version(spark):
    """The native fitness and the one computed with the backtest agree."""
    from barloom.plans import queries as Q
    from barloom.sources.genomes import fixed
    from barloom.operators import search

    d = "/root/testdata/sf0.01"
    n, end = Q._span(spark, d)
    want = {r["genome_id"]: r["fitness"] for r in Q._fitness(spark, d, "robust").collect()}
    got = search.score_population(fixed(spark), B.packed_with_market(Q.bars(spark, d)), Q.CONFIG, end).collect()
    assert len(got) == 11 and all(math.isclose(want[r["genome_id"]], r["fitness"], abs_tol=1e-9) for r in got)


def test_folds_and_split():
    assert scoring.split_at(2496, 0.62) == 1547 and scoring.split_at(400, 0.62) == 460
    assert scoring.folds(500, 5, 260) == []
    f = scoring.folds(2496, 5, 260)
    assert [x[0] for x in f] == [1, 2, 3, 4, 5] and f[-1][4] == 2496 and f[0][3] == 260 + (2496 - 260) // 6
    assert [s[1:] for s in scoring.thirds(Search().warmup, 1000)] == [(260, 506), (506, 752), (752, 1000)]
