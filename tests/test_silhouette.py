"""The silhouette by parts: all pairs, and no row written for every chunk that it meets."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from barloom.operators import clustering as C
from barloom.plans import oracle, queries


def frame(spark, x, labels, more=()):
    rows = [(str(k), v.tolist(), label) for k, (v, label) in enumerate(zip(x, labels))]
    return spark.createDataFrame([*rows, *more], "genome_id string, z array<double>, cluster int").repartition(3)


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    some = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(some.apply(k).totalShuffleWrite() for k in range(some.size()))


def test_rows_are_not_copied(spark):
    """Each row was shuffled twice for each of 30 blocks: 3.9 MB, as compressed, of 0.3."""
    rng = np.random.default_rng(5)
    x, labels = rng.standard_normal((600, 64)), [k % 3 for k in range(600)]
    df, before = frame(spark, x, labels), shuffled(spark)
    assert abs(C.silhouette(df, 20).first()[0] - C.silhouette_of(x, np.array(labels))) < 1e-9
    took = shuffled(spark) - before
    assert took < 2e6


@pytest.mark.parametrize("block", [4096, 200, 7])
def test_large_and_many_small_clusters(spark, block):
    rng = np.random.default_rng(6)
    labels = np.array([0] * 250 + [1 + k % 149 for k in range(300)] + [900, 901] + [950] * 40)
    x = rng.standard_normal((len(labels), 3)) + 1e3
    x[::7] = x[3]  # equal vectors, within clusters and across
    x = x.astype(np.float32).astype(np.float64)
    x[5] += 1e-9  # one that four bytes don't hold
    df = frame(spark, x, labels.tolist(), [("n1", [0.0, 0.0, 0.0], None), ("n2", None, 0)])
    want = C.silhouette_of(x, labels) * len(x) / (len(x) + 2)  # rows without a cluster or a vector count 0, as in SQL
    assert abs(C.silhouette(df, block).first()[0] - want) < 1e-9


def test_few_rows(spark):
    df = frame(spark, np.eye(3), [0, 0, 1])
    assert C.silhouette(df.limit(0)).first()[0] is None
    assert C.silhouette(df.where("genome_id = '0'")).first()[0] == 0.0
    assert C.silhouette(df.where("cluster = 0")).first()[0] == 0.0


@pytest.mark.parametrize("few", [1, 64])
def test_pairs_both_ways(monkeypatch, few):
    """Sums from the columns of a pass are those of a pass of their own."""
    monkeypatch.setattr(C, "FEW", few)
    monkeypatch.setattr(C, "TILE", 5)
    rng = np.random.default_rng(7)
    make = lambda at, split, ends: C._Chunk(pa.RecordBatch.from_pylist([{"chunk": at, "split": split, "n": 50, "dims": 2, "ends": ends, "z": rng.standard_normal((ends[-1], 2)).tobytes()}], C._CHUNK), 0)
    for a, b in ((make(0, -1, [3, 9, 13]), make(1, -1, [4, 11])), (make(0, -1, [3, 9]), make(1, 1, [8])), (make(2, 2, [6]), make(3, 2, [7]))):
        totals = C._Totals()
        totals.meet(a, b)
        d = np.sqrt(((a.x[:, None] - b.x[None]) ** 2).sum(axis=2))
        for p, q, m in ((a, b, d), (b, a, d.T)):
            sums = np.add.reduceat(m, q.starts, axis=1)
            want = sums[:, 0] if q.split >= 0 else (sums / q.size).min(axis=1)
            assert np.allclose(totals.held[p.at, q.split if q.split >= 0 else C.NEXT][-1], want, rtol=1e-12)


@pytest.mark.parametrize("name", ["silhouette", "silhouette_all"])
def test_query_reads_parts_of_rows(spark, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroup" not in plan


@pytest.mark.parametrize("name", ["silhouette", "silhouette_all"])
def test_query_equals_sql_with_nulls(spark, name, tmp_path):
    """A null vector had stopped the query."""
    db = duckdb.connect()
    some = "CASE WHEN vec_id = 7 THEN NULL ELSE embedding END AS embedding, CASE WHEN vec_id % 50 = 3 THEN NULL WHEN vec_id = 9 THEN 77 ELSE label END AS label"
    db.execute(f"COPY (SELECT vec_id, {some} FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id < 300) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = db.execute(oracle.oracle_sql()[name]).fetchone()[0]
    assert abs(queries.queries()[name](spark, str(tmp_path)).first()[0] - want) < 1e-9
