"""Leaf-wise boosted trees against trees grown one split at a time in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting as B
from tessera.operators import metrics as M
from tessera.operators import ranking as W


def table(spark, n=900, seed=1, missing=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.2) ^ (rng.random(n) < 0.1)).astype(float)
    x[:, 3] = 5.0  # constant
    rows = []
    for i in range(n):
        v = [float(a) for a in x[i]]
        if missing and i % 17 == 0:
            v[0] = None
        if missing and i % 23 == 0:
            v[1] = float("nan")
        rows.append((i, *v, float(y[i]), 1.0 + (i % 3), i % 5 == 0))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, w double, held boolean"), rows


FEATURES = ["a", "b", "c", "d"]


def codes(rows, edges):
    out = np.zeros((len(rows), len(edges)), int)
    for i, r in enumerate(rows):
        for j, e in enumerate(edges):
            v = r[1 + j]
            out[i, j] = 0 if v is None or v != v else 1 + sum(x < v for x in e)
    return out


def brute_boost(rows, edges, max_leaves, rate, rounds, min_rows):
    """Plain best-first boosting on the bins; per round the leaves' (rows, value)."""
    bins = codes(rows, edges)
    y, w = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    held = np.array([r[7] for r in rows])
    t = np.flatnonzero(~held)
    share = (w[t] * y[t]).sum() / w[t].sum()
    margin = np.full(len(rows), np.log(share / (1 - share)))
    losses = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def best(members):
            m = members[~held[members]]
            top = (1e-9, None)
            for f in range(bins.shape[1]):
                for cut in range(63):
                    go = bins[m, f] <= cut
                    a, b = m[go], m[~go]
                    if min(len(a), len(b)) < min_rows:
                        continue
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[m].sum() ** 2 / h[m].sum()
                    if gain > top[0] + 1e-7:
                        top = (gain, (f, cut))
            return top

        leaves = [(np.arange(len(rows)), best(np.arange(len(rows))))]
        while len(leaves) < max_leaves:
            i = max(range(len(leaves)), key=lambda k: leaves[k][1][0] if leaves[k][1][1] else -1)
            members, (_, cut) = leaves[i]
            if cut is None:
                break
            go = bins[members, cut[0]] <= cut[1]
            leaves[i : i + 1] = [(x, best(x)) for x in (members[go], members[~go])]
        for members, _ in leaves:
            m = members[~held[members]]
            margin[members] -= rate * g[m].sum() / h[m].sum()
        losses.append(tuple((w[s] * (np.logaddexp(0, margin[s]) - y[s] * margin[s])).sum() / w[s].sum() for s in (~held, held)))
    return 1 / (1 + np.exp(-margin)), losses


@pytest.mark.parametrize("max_leaves", [2, 7, 31])
def test_equal_to_plain_best_first_growth(spark, max_leaves):
    df, rows = table(spark)
    m = B.fit_leafwise(df.repartition(5), FEATURES, "y", "w", "held", max_leaves=max_leaves, max_iter=3, learning_rate=0.3)
    assert m.edges[3] == [] and all(2 <= t.leaves <= max_leaves for t in m.trees) and len(m.trees) == 3
    prob, losses = brute_boost(rows, m.edges, max_leaves, 0.3, 3, 20)
    assert np.allclose([h[1:] for h in m.history], losses, atol=1e-6)
    m.best = 3
    got = {r["id"]: r["prob"] for r in m.score(df, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], prob, atol=1e-5)


def test_prefetch_and_partitions_change_nothing(spark, monkeypatch):
    df, _ = table(spark)
    want = B.fit_leafwise(df.repartition(7), FEATURES, "y", "w", "held", max_iter=3).to_json()
    monkeypatch.setattr(B, "PREFETCH", 1)  # one split, one job
    monkeypatch.setattr(B, "REFRESH", 1)
    assert B.fit_leafwise(df.coalesce(1), FEATURES, "y", "w", "held", max_iter=3).to_json() == want


def test_stops_where_the_tracker_stops(spark):
    df, rows = table(spark, 600)
    noise = df.withColumn("y", F.when(F.col("held"), 1 - F.col("y")).otherwise(F.col("y")))  # validation gets worse
    m = B.fit_leafwise(noise, FEATURES, "y", validation="held", patience=2, max_iter=20, max_leaves=4)
    (t,) = W.early_stopping(m.history_table(spark), "run_id", "step", "val_loss", patience=2, min_delta=0.0, mode="min").collect()
    assert (m.best, m.stopped) == (t["best_step"], t["stop_step"]) and m.stopped == m.best + 2
    train = [h[1] for h in m.history]
    assert train == sorted(train, reverse=True)
    free = B.fit_leafwise(df, FEATURES, "y", max_iter=4, max_leaves=4)
    assert free.stopped is None and free.best == 4 and all(h[2] is None for h in free.history)


def test_model_goes_through_json_and_beats_chance(spark):
    df, _ = table(spark, 1200)
    m = B.fit_leafwise(df, FEATURES, "y", "w", "held", max_iter=12)
    again = B.LeafwiseModel.from_json(m.to_json())
    a, b = (x.score(df, ["id", "y", "held"]).orderBy("id").collect() for x in (m, again))
    assert a == b
    scored = m.score(df.where("held"), ["y"]).select(F.lit("v").alias("g"), F.col("y").cast("int").alias("label"), "prob")
    assert M.auc(scored, "g").first()["auc"] > 0.85
    gains = {r["feature"]: r["importance"] for r in m.importance(spark).collect()}
    assert gains["d"] == 0 and min(gains["a"], gains["b"], gains["c"]) > 0


def test_degenerate_tables(spark):
    df, _ = table(spark, 60)
    for d in (df.withColumn("y", F.lit(1.0)), df.where("id < 10"), df.limit(0), df.withColumn("y", F.lit(None).cast("double"))):
        m = B.fit_leafwise(d, FEATURES, "y", "w", "held", max_iter=2)
        assert m.trees == [] and m.score(df, ["id"]).where("prob is null or prob < 0 or prob > 1").count() == 0
