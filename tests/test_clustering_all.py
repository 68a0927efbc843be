"""The clustering queries read whole tables, and fits read the survivors of a search."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import clustering as C
from barloom.plans import queries

import test_entry
from test_entry import SF

ALL = ("feature_standardise_all", "nearest_centroid_all", "silhouette_all", "cluster_blobs_all")


@pytest.mark.parametrize("name", ALL)
def test_whole_twin(spark, name):
    test_entry.test_twin(spark, name)


def test_all_rows_and_components(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    size = len(rows["embedding"].iloc[0])
    got = queries.queries()["feature_standardise_all"](spark, SF)
    assert got.count() == len(rows) * size and got.select("genome_id").distinct().count() == len(rows)
    assert queries.queries()["nearest_centroid_all"](spark, SF).count() == len(rows)


def test_silhouette_by_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5))
    x[1] = x[0]
    labels = [0] + [k % 3 for k in range(88)] + [7]
    df = spark.createDataFrame([(str(k), x[k].tolist(), labels[k]) for k in range(90)], "genome_id string, z array<double>, cluster int")
    want = C.silhouette_of(x, np.array(labels))
    for block in (4096, 20):
        assert abs(C.silhouette(df, block).first()[0] - want) < 1e-9


def test_fits_read_the_survivors(spark):
    labels = queries.queries()["kmeans_labels"](spark, SF).toPandas()
    z = queries._survivors(spark, SF).toPandas()
    assert sorted(labels["genome_id"]) == sorted(z["genome_id"]) and 2 < len(labels) <= 140
    assert {len(v) for v in z["z"]} == {28}


def test_embedding_runs_all_rounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "embedding", lambda rows, seed, rounds=480: seen.append(rounds))
    monkeypatch.setattr(queries, "_survivors", lambda spark, d: None)
    queries.queries()["tsne_embedding"](spark, SF)
    assert seen == [480]
