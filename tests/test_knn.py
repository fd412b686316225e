"""Exact kNN (J6) and SMOTE (N12) against brute force on sf0.001."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn as K
from tessera.plans import fixtures as V

SF = "/root/testdata/sf0.001"
COLS = ["f1", "f2", "f3", "f4"]


def _minority(spark, coarse=False):
    f = V.v_features(spark, SF).fillna(0.0, subset=["f3"]).where("label_type = 2").select("id", *COLS)
    if coarse:  # heavy duplicates and ties
        f = f.select("id", "f1", F.round(F.col("f2") / 20000).alias("f2"), F.lit(0.0).alias("f3"), F.lit(0.0).alias("f4"))
    return f


def _brute(ids, X, k):
    out = {}
    for i, key in enumerate(ids):
        d = np.zeros(len(X))
        for c in range(X.shape[1]):
            d += np.square(X[:, c] - X[i, c])
        d = np.sqrt(d)
        out[key] = sorted((float(d[j]), int(ids[j])) for j in range(len(ids)) if j != i)[:k]
    return out


@pytest.mark.parametrize("cell_rows", [8, 100, 2048])
@pytest.mark.parametrize("coarse", [False, True])
def test_knn_matches_brute_force(spark, coarse, cell_rows):
    f = _minority(spark, coarse)
    got = {r.id: [(n.d, n.id) for n in r.nbrs] for r in K.knn_self_join(f, "id", COLS, k=5, cell_rows=cell_rows).collect()}
    pdf = f.toPandas().sort_values("id")
    assert got == _brute(pdf["id"].to_numpy(), pdf[COLS].to_numpy(float), 5)


@pytest.mark.parametrize("visits", [40, 50_000])
def test_knn_high_dimension_duplicates_and_ties(spark, monkeypatch, visits):
    monkeypatch.setattr(K, "VISITS_PER_TASK", visits)
    rng = np.random.default_rng(0)
    X = np.vstack([rng.random((600, 12)), np.repeat(rng.random((1, 12)), 60, axis=0), np.eye(12), -np.eye(12)])
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], "id long, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {r.id: [(n.d, n.id) for n in r.nbrs] for r in K.knn_self_join(df, "id", names, k=5, cell_rows=64).collect()}
    assert got == _brute(np.arange(len(X)), X, 5)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_knn_of_few_points(spark, n):
    got = K.knn_self_join(spark.range(n).withColumn("a", F.col("id") * 1.0), "id", ["a"], k=5).collect()
    assert sorted(len(r.nbrs) for r in got) == [max(0, n - 1)] * n


def test_smote_counts_and_segments(spark):
    f = V.v_features(spark, SF).fillna(0.0, subset=["f3"]).select("id", *COLS, (F.col("label_type") - 1).alias("y"))
    out = K.smote(f, "id", COLS, "y", minority=1, ratio=1.0, k=5)
    n_maj = f.where("y = 0").count()
    n_min = f.where("y = 1").count()
    assert out.where("not synthetic").count() == f.count()
    assert out.where("synthetic").count() == n_maj - n_min
    assert out.where("y = 1").count() == n_maj
    # every synthetic point lies between its origin and some minority point, per feature
    syn = out.where("synthetic").join(f.select("id", *[F.col(c).alias(f"o_{c}") for c in COLS]), "id")
    for c in COLS:
        assert syn.where(F.col(c).isNull()).count() == 0
    assert syn.count() == n_maj - n_min
