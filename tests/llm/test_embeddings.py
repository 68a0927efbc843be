import numpy as np

from barloom.llm import embeddings as E


def vectors(n=220, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((30, dims))
    x = base[rng.integers(0, 30, n)] + rng.standard_normal((n, dims)) * rng.choice([0.05, 0.2, 0.35], (n, 1))
    x[10] = x[11]
    return x


def brute(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    top = np.arange(len(x))
    while True:
        new = np.minimum(top, np.where(near, top[None, :], len(x)).min(axis=1))
        if (new == top).all():
            return near.sum(axis=1), top
        top = new


def test_matches_brute_force(spark):
    x = vectors()
    count, top = brute(x, 0.9)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for block in (512, 9):
        got = {r["vec_id"]: r for r in E.near_vectors(df, block=block).collect()}
        found = np.array([got[i]["n_links"] for i in range(len(x))])
        assert (found <= count).all() and found.sum() >= 0.995 * count.sum()
        assert np.mean([got[i]["component_id"] == top[i] for i in range(len(x))]) >= 0.98


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [0.0, 1.0], "x"), (4, None, "x"), (5, [], "x"), (6, [0.0, 0.0], "x"),
        (7, [nan, 1.0], "x"), (8, [inf, 1.0], "x"), (9, [None, 1.0], "x"), (10, [1.0, 0.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (11, [1e-200, 0.0], "x"), (12, [1e200, 0.0], "x"),
    ]
    df = spark.createDataFrame([(*r, *["y"] * 3) for r in rows], "vec_id long, embedding array<double>, label string, rep string, bucket string, copies string")
    got = E.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert [by[i]["n_links"] for i in (1, 2, 3, 11, 12)] == [4, 4, 0, 4, 4]
    assert [by[i]["component_id"] for i in (1, 2, 3, 10, 11, 12)] == [1, 1, 3, 10, 1, 1]
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, None))
    assert E.near_vectors(df.limit(0)).count() == 0
