"""Memory, disk and time at size: what a task holds, and how often rows travel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting as BO
from tessera.operators import joins as JO
from tessera.operators import neighbours as NB


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def small_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_rows_of_bags_come_as_a_stream(spark, monkeypatch, small_batches):
    """No task holds a group of rows; keys whose rows lie in several batches, null
    keys, vectors that come twice, and groups that get only what they look up."""
    rng = np.random.default_rng(21)
    rows = [(int(k) if k % 9 else None, [int(v) for v in rng.integers(-2, 30, rng.integers(0, 6))]) for k in rng.integers(0, 60, 200)]
    rows += [(77, [3, 4])] * 40
    vecs = [(i, [float(i), None if i % 5 == 0 else i / 4]) for i in [*range(1, 20), 4, 4, 12]] + [(22, None)]
    seen, want = {}, []
    for k, own in rows:
        seen.setdefault(k, []).extend([v or [0.0, 0.0] for i in own if k is not None and 0 < i < 25 for v in [v for j, v in vecs if j == i] or [[0.0, 0.0]]])
    for k, _ in rows:
        per = [[v[d] for v in seen[k] or [[0.0, 0.0]] if v[d] is not None] for d in (0, 1)]
        want.append((k, *(round(sum(x) / len(x), 5) if x else None for x in per)))
    df = spark.createDataFrame(rows, "row long, ids array<long>").repartition(3)
    table = spark.createDataFrame(vecs, "k long, v array<float>")
    for held in (256 << 20, 8 * 50):
        monkeypatch.setattr(JO, "HELD_BYTES", held, raising=False)
        out = JO.embedding_bag_mean(df, "row", "ids", table, "k", "v", 25, 2)
        assert "CoGroups" not in _plan(out)
        got = [(r["row"], *(x if x is None else round(x, 5) for x in r["bag"])) for r in out.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_all_pairs_copy_no_vectors(spark, monkeypatch):
    """Blocks meet where they are pinned: no exchange has vectors in it but the one
    that makes the blocks; results as by brute force, ids that repeat included."""
    x = np.random.default_rng(22).integers(-4, 5, (300, 20)).astype(float)
    x[250:] = x[:50]
    points = spark.createDataFrame([(i % 280, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)
    monkeypatch.setattr(NB, "BLOCK_BYTES", 20 * 8 * 70)
    out = NB.exact_pairs(points.localCheckpoint(), 300, 20, 4)
    plan = _plan(out).split("== Physical Plan ==")[1]
    assert "CartesianProduct" in plan and "CoGroups" not in plan
    assert not any("x#" in line or "y#" in line for line in plan.splitlines() if "Exchange" in line)
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == sorted(i % 280 for i in range(300))
    want = {}
    for i in range(300):
        d = sorted((float(np.sqrt(np.square(x[i] - x[j]).sum())), j % 280) for j in range(300) if j % 280 != i % 280)[:4]
        want.setdefault(i % 280, []).append([(round(a, 9), j) for a, j in d])
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append([(round(e["d"], 9), e["id"]) for e in r["nbrs"]])
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_boosting_reads_blocks_in_few_passes(spark, monkeypatch):
    """Rows are pinned as blocks, one record each; a tree of 31 leaves takes about as
    many passes as it has levels; neither changes a tree."""
    rng = np.random.default_rng(23)
    x = rng.normal(size=(1500, 4))
    y = (rng.random(1500) < 0.5).astype(float)  # noise: the best leaf is often a new one
    df = spark.createDataFrame([(*map(float, v), float(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))], "a double, b double, c double, d double, y double, held boolean")
    names = ["a", "b", "c", "d"]
    edges = BO.bin_edges(df, names, 64)
    assert BO._binned(df.coalesce(2), names, edges, "y", None, "held", 0.0).count() <= 2
    calls, whole = [], BO._sums
    monkeypatch.setattr(BO, "_sums", lambda *a: calls.append(a) or whole(*a))
    fit = lambda: BO.fit_leafwise(df.coalesce(2), names, "y", None, "held", max_iter=1, min_rows=5)
    m = fit()
    assert m.trees[0].leaves == 31 and len(calls) - 2 <= 15
    few = len(calls)
    monkeypatch.setattr(BO, "BLOCK_ROWS", 70)
    monkeypatch.setattr(BO, "PREFETCH", 1)
    assert fit().to_json() == m.to_json() and len(calls) - few == 32  # one split, one pass


def test_bin_edges_are_summed_up_in_arrays(spark, monkeypatch):
    """No sketch a row and feature in the aggregate; few values give exact quantiles,
    many near ones, nulls and NaN none."""
    rng = np.random.default_rng(24)
    many = rng.normal(size=6000)
    df = spark.createDataFrame([(float(i % 5), float(v), None if i % 3 else float("nan"), -0.0 if i % 2 else 0.0) for i, v in enumerate(many)], "a double, b double, c double, d double")
    monkeypatch.setattr(BO, "BLOCK_ROWS", 500)
    a, b, c, d = BO.bin_edges(df.repartition(3), ["a", "b", "c", "d"], 12, accuracy=300)
    assert a == [0.0, 1.0, 2.0, 3.0] and c == [] and d == []
    ranks = np.searchsorted(np.sort(many), b, side="right") / len(many)
    assert len(b) == 10 and np.abs(ranks - np.arange(1, 11) / 11).max() < 5 / 300
    exact = spark.createDataFrame([(float(i),) for i in range(400)], "a double")
    want = exact.selectExpr(f"percentile_approx(a, array({', '.join(f'{i}/11d' for i in range(1, 11))}), 10000) e").first()["e"]
    assert BO.bin_edges(exact, ["a"], 12)[0] == want
    seen = []
    monkeypatch.setattr(BO.F, "percentile_approx", lambda *x: seen.append(x), raising=False)
    BO.bin_edges(exact, ["a"], 12)
    assert not seen
