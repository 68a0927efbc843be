"""Joins in time, chunked chains and k-means against plain versions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import apart, chains, kmeans, neighbours, regimes, sliding
from barloom.operators.asof import asof_join
from barloom.operators.intervals import interval_join
from barloom.shared import Scratch


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- as-of ------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [None, 1, 7])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_asof(spark, width, tolerance):
    rng = np.random.default_rng(3)
    left = [(int(i), ["hot", "b", None][int(k)], int(t) if t > -50 else None, "x") for i, (k, t) in enumerate(zip(rng.choice(3, 300, p=[0.8, 0.15, 0.05]), rng.integers(-51, 60, 300)))]
    right = [(["hot", "b", None][int(k)], int(t), float(v)) for k, t, v in zip(rng.choice(3, 60, p=[0.7, 0.2, 0.1]), rng.integers(-40, 60, 60), rng.integers(0, 9, 60))] + [("hot", None, 1.0), ("c", 1, None)]
    ldf = spark.createDataFrame(left, "id int, key string, at long, v string")  # `v` is no column of the result
    rdf = spark.createDataFrame(right, "key string, seen long, price double")
    got = {r["id"]: (r["seen"], r["price"]) for r in asof_join(ldf, rdf, ["key"], "at", "seen", ["seen", "price"], tolerance, width).collect()}
    assert len(got) == len(left)
    for i, k, t, _ in left:
        some = [(s, p) for key, s, p in right if k is not None and key == k and t is not None and s is not None and s <= t and (tolerance is None or t - s <= tolerance)]
        assert got[i] == (max(some) if some else (None, None)), (i, k, t)


def test_asof_of_times(spark):
    day = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, "a", day + timedelta(seconds=5)), (2, "a", day), (3, "b", day), (4, "a", day + timedelta(hours=3))], "id int, key string, ts timestamp")
    right = spark.createDataFrame([("a", day, 1.5), ("a", day + timedelta(microseconds=1), None)], "key string, ts timestamp, price double")
    got = asof_join(left, right.withColumnRenamed("ts", "seen"), ["key"], "ts", "seen", ["price", "seen"], timedelta(hours=1)).orderBy("id")
    assert [(r["id"], r["price"], r["seen"]) for r in got.collect()] == [(1, None, day + timedelta(microseconds=1)), (2, 1.5, day), (3, None, None), (4, None, None)]
    assert asof_join(left.limit(0), right.withColumnRenamed("ts", "seen"), ["key"], "ts", "seen", ["price"]).count() == 0
    assert asof_join(left, right.limit(0).withColumnRenamed("ts", "seen"), ["key"], "ts", "seen", ["price"]).where("price is not null").count() == 0
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


# --- intervals ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, seed):
    rng = np.random.default_rng(seed)

    def some(n, first):
        start = rng.integers(-60, 60, n)
        length = rng.choice([0, 1, 2, 3, 7, 8, 9, 40, 1000], n)
        return [(first + i, ["a", "b", None][int(k)], int(s), int(s + x)) for i, (k, s, x) in enumerate(zip(rng.choice(3, n, p=[0.7, 0.2, 0.1]), start, length))]

    left, right = some(80, 0) + [(900, "a", 5, 4), (901, "a", None, 3)], some(60, 1000) + [(1900, "b", 3, None)]
    schema = "id int, key string, start long, `end` long"
    ldf, rdf = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    pairs = interval_join(ldf, rdf, ["key"], ("start", "end"), ("start", "end"))
    got = sorted((r["left"]["id"], r["right"]["id"], r["first"], r["last"], r["shared"]) for r in pairs.collect())
    ok = lambda x: x[1] is not None and None not in x and x[2] <= x[3]
    want = sorted((a[0], b[0], max(a[2], b[2]), min(a[3], b[3]), min(a[3], b[3]) - max(a[2], b[2]) + 1) for a in left for b in right if ok(a) and ok(b) and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert got == want and len(want) > 100
    assert "NestedLoop" not in plan_of(pairs) and "Cartesian" not in plan_of(pairs)
    keyless = interval_join(ldf.where("start <= `end`"), rdf.where("start <= `end`"), [], ("start", "end"), ("start", "end")).count()
    sound = lambda rows: [x for x in rows if None not in x[2:] and x[2] <= x[3]]
    assert keyless == sum(a[2] <= b[3] and b[2] <= a[3] for a in sound(left) for b in sound(right))


def test_intervals_of_any_length(spark):
    one = spark.createDataFrame([(1, 0, 0), (2, 0, 2**61), (3, -(2**61), 2**61), (4, 2**62, 2**62 + 1)], "id int, a long, b long")
    got = {(r["left"]["id"], r["right"]["id"]) for r in interval_join(one, one, [], ("a", "b"), ("a", "b")).collect()}
    assert got == {(i, j) for i in (1, 2, 3) for j in (1, 2, 3)} | {(4, 4)}
    assert interval_join(one.limit(0), one, [], ("a", "b"), ("a", "b")).count() == 0


# --- chains ------------------------------------------------------------------------------------


def series(k=3, d=2, seed=5):
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.standard_normal((n, d)) + np.repeat(rng.integers(0, k, -(-n // 9)), 9)[:n, None] * 1.5
    xs = {"long": draw(150), "short": draw(8), "one": draw(1), "even": draw(40)}

    def model():
        moves = rng.random((k, k)) + np.eye(k) * 3
        start = rng.random(k)
        return regimes.Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), rng.standard_normal((k, d)) * 2, rng.random((k, d)) + 0.3)

    return xs, {s: model() for s in xs}


def as_frames(spark, xs, models):
    rows = [(s, t, v.tolist()) for s, x in xs.items() for t, v in enumerate(x)]
    observed = spark.createDataFrame(rows, "series string, t long, x array<double>").repartition(3)
    return observed, spark.createDataFrame([(s, chains.flat(m)) for s, m in models.items()], "series string, model array<double>")


@pytest.mark.parametrize("chunk,fan", [(7, 2), (64, 1024)])
def test_chunks_equal_the_whole(spark, chunk, fan):
    xs, models = series()
    observed, frame = as_frames(spark, xs, models)
    with Scratch(spark) as scratch:
        parts = scratch.write(chains.packed(observed, chunk), "parts")
        shares = chains.shares(parts, frame, 3, scratch, chunk, fan).collect()
        paths = chains.best_paths(parts, frame, 3, scratch, chunk, fan).collect()
        after = chains.improved(parts, frame, 3, scratch, fan).collect()
    for s, x in xs.items():
        share, moved, level = regimes._expect(models[s], x)
        mine = sorted((r["t"], r["share"], r["log_likelihood"]) for r in shares if r["series"] == s)
        assert [r[0] for r in mine] == list(range(len(x)))
        np.testing.assert_allclose(np.array([r[1] for r in mine]), share, atol=1e-9)
        np.testing.assert_allclose([r[2] for r in mine], level, rtol=1e-9)
        assert [st for _, st in sorted((r["t"], r["state"]) for r in paths if r["series"] == s)] == regimes.viterbi(models[s], x).tolist()
        new = chains.model_of(next(r["model"] for r in after if r["series"] == s), 3)
        weight = share.sum(axis=0)[:, None]
        mean = share.T @ x / weight
        np.testing.assert_allclose(new.mean, mean, atol=1e-8)
        np.testing.assert_allclose(new.var, np.maximum(1e-8, share.T @ (x * x) / weight - mean**2), atol=1e-8)
        moved = moved + 0.03 * len(x) * np.eye(3)
        np.testing.assert_allclose(new.moves, moved / moved.sum(axis=1, keepdims=True), atol=1e-5)


def test_rounds_raise_the_likelihood(spark):
    xs, _ = series(seed=8)
    xs.pop("one")
    observed, _ = as_frames(spark, xs, {})
    with Scratch(spark) as scratch:
        parts = scratch.write(chains.packed(observed, 16), "parts")
        start = chains.start_models(observed, 3, 0)
        got = [{r["series"]: r["log_likelihood"] for r in chains.fit_all(parts, start, 3, n, scratch, 4).collect()} for n in (1, 4)]
    assert all(got[1][s] > got[0][s] for s in ("long", "even"))


def test_start_models(spark):
    observed, _ = as_frames(spark, {"flat": np.ones((5, 2)), "ramp": np.arange(12.0).reshape(6, 2)}, {})
    got = {r["series"]: chains.model_of(r["model"], 3) for r in chains.start_models(observed, 3, 1).collect()}
    assert (got["flat"].mean == 1).all() and (got["flat"].var == 1).all()
    assert got["ramp"].mean[:, 0].tolist() == [1.0, 5.0, 9.0] and got["ramp"].var[0].tolist() == [2.0, 2.0]
    assert got["ramp"].moves.sum(axis=1).round(9).tolist() == [1.0] * 3


# --- k-means -------------------------------------------------------------------------------------


def points(spark, n=400, k=5, d=6, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((k, d)) * 8
    x = c[rng.integers(0, k, n)] + rng.standard_normal((n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, z array<double>").repartition(5)


def plain_lloyd(x, c, rounds):
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(len(c))])
    return c


def test_lloyd(spark):
    x, rows = points(spark)
    start = np.concatenate([x[:4], [[1e6] * 6]])  # no row is nearest to the last one
    got, costs = kmeans.lloyd(rows, start, 6)
    np.testing.assert_allclose(got, plain_lloyd(x, start, 6), atol=1e-9)
    assert costs == sorted(costs, reverse=True) and (got[4] == 1e6).all()
    label = ((x[:, None] - got[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [r["cluster"] for r in kmeans.assigned(rows, got).orderBy("id").collect()] == label.tolist()


def test_seeds_find_the_clusters(spark):
    x, rows = points(spark)
    found = kmeans.seeds(rows, 5)
    assert found.shape == (5, 6)
    again = kmeans.seeds(rows.repartition(2), 5)
    np.testing.assert_allclose(found, again)  # draws depend on ids, not on tasks
    out = kmeans.kmeans_all(rows, 5)
    assert out.agg(F.sum("distance")).first()[0] < 1.3 * 6 * len(x)


def test_kmeans_edges(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, []), (8, [4.0, 0.0]), (9, [2.0, 0.0])], "id long, z array<double>")
    got = {r["id"]: (r["cluster"], r["distance"]) for r in kmeans.assigned(rows, np.array([[4.0, 0.0], [0.0, 0.0]])).collect()}
    assert got == {1: (1, 0.0), 2: (1, 0.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: (0, 0.0), 9: (0, 4.0)}
    assert kmeans.kmeans_all(rows.where("z is null"), 3).where("cluster is not null").count() == 0
    assert kmeans.kmeans_all(rows.where("id < 3"), 3).where("cluster = 0").count() == 2


# --- rows apart --------------------------------------------------------------------------------------


@pytest.mark.parametrize("cells,walk,part", [(64, 2048, 8192), (5, 11, 7), (1, 3, 50)])
def test_greedy_choice(spark, cells, walk, part):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((140, 3)).round(1)
    x[40:70] = x[3] + rng.standard_normal((30, 3)) * 0.01  # near copies
    x[100:110] = x[5]
    place = rng.integers(0, 90, len(x))
    rows = [(i, int(p), v.tolist()) for i, (p, v) in enumerate(zip(place, x))] + [(900, 1, None), (901, 1, [1.0]), (902, 1, [float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, place long, z array<double>").repartition(4)
    kept = []
    for i in sorted(range(len(x)), key=lambda i: (place[i], i)):
        if all(np.sqrt(((x[i] - x[j]) ** 2).sum()) >= 0.8 for j in kept):
            kept.append(i)
    got = apart.first_apart(df, 0.8, cells=cells, walk=walk, part=part)
    assert {r["id"]: r["kept"] for r in got.collect()} == {i: i in kept for i in range(len(x))}
    if walk == 2048:
        few = apart.first_apart(df, 0.8, most=5)
        assert {r["id"] for r in few.where("kept").collect()} == set(kept[:5])
        assert apart.first_apart(df.limit(0), 0.8).count() == 0


# --- sliding windows ---------------------------------------------------------------------------------


@pytest.mark.parametrize("w", [1, 2, 7, 50])
def test_sliding(spark, w):
    rng = np.random.default_rng(w)
    rows = [(s, t, None if rng.random() < 0.2 else float(rng.integers(0, 9))) for s, n in (("a", 61), ("b", 5), ("c", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "symbol string, t int, x double").repartition(4)
    top = {(r["symbol"], r["t"]): (r["highest"], r["lowest"]) for r in sliding.extremes(df, "x", w).collect()}
    rank = {(r["symbol"], r["t"]): r["value"] for r in sliding.percentiles(df, "x", w).collect()}
    values = {(s, t): x for s, t, x in rows}
    assert set(top) == set(rank) == set(values)
    for (s, t), x in values.items():
        held = [values[s, k] for k in range(max(0, t - w + 1), t + 1) if values[s, k] is not None]
        full = t >= w - 1
        assert top[s, t] == ((max(held), min(held)) if full and held else (None, None))
        want = (sum(h <= x for h in held) - 1) / (len(held) - 1) if full and x is not None and len(held) > 1 else None
        assert rank[s, t] == want


def test_ranks_in_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, q = rng.integers(0, 40), rng.integers(1, 20)
        rank, low, end = rng.integers(0, 9, n), rng.integers(0, 9, q), rng.integers(0, n + 1, q)
        assert sliding.at_most(rank, low, end).tolist() == [(rank[:e] <= x).sum() for x, e in zip(low, end)]


# --- nearest neighbours ------------------------------------------------------------------------------


def recall(got, ids, x, k, asked):
    near = {}
    for r in got:
        near.setdefault(r["id"], []).append((r["distance"], r["other"]))
    right = 0
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        tenth = np.sort(d)[k - 1]
        mine = near[ids[i]]
        assert len({o for _, o in mine}) == len(mine) == k and all(o != ids[i] for _, o in mine)
        right += sum(dist <= tenth * (1 + 1e-9) for dist, _ in mine)
    return right / (k * len(asked))


@pytest.mark.parametrize("part", [20_000, 150])
def test_neighbour_graph(spark, part):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((500, 24)), 5 + rng.standard_normal((300, 24)) * 0.01])  # a third lies close together
    ids = [7 * i for i in range(len(x))]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(1, None), (2, [1.0]), (3, [float("nan")] * 24)]
    df = spark.createDataFrame(rows, "id long, z array<double>").repartition(4)
    with Scratch(spark) as scratch:
        got = neighbours.graph(df, 10, scratch, part=part, leaf=64).collect()
        assert recall(got, ids, x, 10, range(0, len(x), 9)) >= 0.9
        if part == 150:
            assert neighbours.graph(df.limit(0), 10, scratch).count() == neighbours.graph(df.where("id < 4"), 10, scratch).count() == 0
            two = neighbours.graph(df.where("id in (0, 7)"), 10, scratch)
            assert sorted((r["id"], r["other"]) for r in two.collect()) == [(0, 7), (7, 0)]


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"))
    told = rows.orderBy("id").toPandas()
    x, ids = np.stack(told["z"].to_numpy()), told["id"].tolist()
    with Scratch(spark) as scratch:
        got = neighbours.graph(rows, 10, scratch).collect()
    assert recall(got, ids, x, 10, [k for k, i in enumerate(ids) if i % 50 == 0]) >= 0.9


def test_layout_keeps_groups_apart(spark):
    rng = np.random.default_rng(2)
    of = np.repeat([0, 1, 2], 40)
    x = np.eye(12)[of] * 6 + rng.standard_normal((120, 12)) * 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, z array<double>").repartition(3)
    with Scratch(spark) as scratch:
        near = neighbours.graph(df, 8, scratch, trees=3, rounds=1)
        placed = neighbours.layout(df, near, scratch, rounds=8).orderBy("id").toPandas()
    y = placed[["x", "y"]].to_numpy()
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert len(placed) == 120 and np.isfinite(y).all()
    assert np.mean(of[np.argsort(d, axis=1)[:, :5]] == of[:, None]) > 0.9
