"""Operators for many dimensions, many codes, hot ids, long runs and growing
folders, against numpy or plain Python."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import codes as CO
from tessera.operators import heavy as HV
from tessera.operators import joins as J
from tessera.operators import models as ML
from tessera.operators import neighbours as NB
from tessera.operators import newton as NW
from tessera.operators import ordering as O
from tessera.operators import profile as G
from tessera.operators import ranking as W
from tessera.operators import scorer as SC
from tessera.operators import sketches as SS
from tessera.streaming import stream as ST

# ---------------------------------------------------------------- neighbours in many dimensions


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)


def brute_neighbours(x, k):
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(-1))
    np.fill_diagonal(d, np.inf)
    return [sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))]


def test_forest_reaches_its_recall_in_200_dimensions(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 200)) * 2
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 200))
    got, recall = NB.knn_forest(vectors(spark, x), "id", "x", k=10, cell_rows=256, target_recall=0.95)
    want = brute_neighbours(x, 10)
    mine = {r["id"]: [(n["d"], n["id"]) for n in r["nbrs"]] for r in got.collect()}
    true = np.mean([len({i for _, i in mine[q]} & {i for _, i in want[q]}) / 10 for q in range(len(x))])
    assert len(mine) == len(x) and recall >= 0.95 and true >= 0.9
    for q in range(0, len(x), 97):  # real distances, in order, never itself
        assert mine[q] == sorted(mine[q]) and q not in {i for _, i in mine[q]}
        assert all(math.isclose(d, np.sqrt(np.square(x[q] - x[i]).sum()), rel_tol=1e-9) for d, i in mine[q])


def test_forest_falls_back_to_the_exact_search(spark):
    x = np.random.default_rng(1).normal(size=(400, 6))
    got, recall = NB.knn_forest(vectors(spark, x), "id", "x", k=5, cell_rows=32, target_recall=1.1, max_rounds=1, trees=1)
    assert recall == 1.0
    assert {r["id"]: [n["id"] for n in r["nbrs"]] for r in got.collect()} == {i: [j for _, j in n] for i, n in enumerate(brute_neighbours(x, 5))}


def test_forest_with_copies_nulls_and_few_rows(spark):
    x = np.repeat(np.random.default_rng(2).normal(size=(20, 8)), 9, axis=0)
    got, recall = NB.knn_forest(vectors(spark, x), "id", "x", k=4)
    rows = {r["id"]: [(n["d"], n["id"]) for n in r["nbrs"]] for r in got.collect()}
    assert len(rows) == 180 and recall == 1.0
    for i, nbrs in rows.items():  # the lowest other ids of the own vector
        assert nbrs == [(0.0, j) for j in range(i // 9 * 9, i // 9 * 9 + 9) if j != i][:4]
    odd = spark.createDataFrame([(1, [0.0]), (2, None), (None, [1.0])], "id long, x array<double>")
    assert [(r["id"], r["nbrs"]) for r in NB.knn_forest(odd, "id", "x")[0].collect()] == [(1, [])]
    assert NB.knn_forest(odd.limit(0), "id", "x")[0].count() == 0


# ---------------------------------------------------------------- many codes


def test_pruned_codes_equal_the_full_scan_and_scan_few(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 16)) * 10
    codes = np.round(centres[rng.integers(0, 100, 10_000)] + rng.normal(size=(10_000, 16)), 3)
    codes[5000:5050] = codes[:50]  # ties
    x = np.round(centres[rng.integers(0, 100, 300)] + rng.normal(size=(300, 16)), 3)
    book, rows = vectors(spark, codes), vectors(spark, x)
    want = {}
    for i, v in enumerate(x):
        d2 = np.square(codes - v).sum(axis=1)
        want[i] = (int(np.lexsort((np.arange(len(d2)), d2))[0]), d2.min())
    for cap in (None, 200_000):  # one block, and many
        if cap:
            monkeypatch.setattr(CO, "BROADCAST_BYTES", cap)
        got = {r["id"]: (r["code"], r["d2"], r["scanned"]) for r in CO.nearest_code_pruned(rows, "id", "x", book, "id", "x").collect()}
        assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
        assert all(math.isclose(got[i][1], want[i][1], rel_tol=1e-12) for i in want)
        if cap is None:
            assert sum(g[2] for g in got.values()) < 0.15 * len(x) * len(codes)


def test_pruned_codes_edges(spark):
    odd = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "id long, x array<double>")
    book = spark.createDataFrame([(9, [0.0, 1.0]), (4, [0.0, 1.0]), (None, [0.0, 1.0]), (7, None)], "id long, x array<double>")
    assert sorted((r["id"], r["code"], r["d2"]) for r in CO.nearest_code_pruned(odd, "id", "x", book, "id", "x").collect()) == [(1, 4, 0.0), (2, None, None)]
    assert {r["code"] for r in CO.nearest_code_pruned(odd, "id", "x", book.limit(0), "id", "x").collect()} == {None}


# ---------------------------------------------------------------- all folds at once


def test_fold_fits_equal_single_fits(spark):
    rng = np.random.default_rng(5)
    n = 600
    a, b, c = rng.normal(size=n) * 100 + 5000, rng.normal(size=n), np.full(n, 3.0)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.01 * (a - 5000) + b)))).astype(float)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), i % 4) for i in range(n)], "id long, a double, b double, c double, y double, fold int")
    names = ["a", "b", "c"]
    m = NW.fit_folds(df.repartition(3), "fold", "y", names, 4)
    for fold in range(4):
        train = ML.with_balanced_weight(df.where(F.col("fold") != fold), "y")
        w = train.agg(F.sum("weight")).first()[0]
        # centred: the same problem, in a form that the quasi-Newton fit solves to the last digits
        shift = train.agg(F.avg("a").alias("a")).first()["a"]
        lr = LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight", regParam=1 / w, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-14)
        one = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="v"), lr]).fit(train.withColumn("a", F.col("a") - shift)).stages[-1]
        assert np.allclose(m.coefficients[fold], one.coefficients.toArray(), atol=1e-6)
        assert math.isclose(m.intercepts[fold], one.intercept - one.coefficients[0] * shift, abs_tol=1e-3)
    scored = m.score(df, "fold", ["id", "fold", "a", "b", "c"]).collect()
    for r in scored[::50]:
        z = m.coefficients[r["fold"]] @ [r["a"], r["b"], r["c"]] + m.intercepts[r["fold"]]
        assert math.isclose(r["prob"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    table = ML.cross_validate(df, "id", "y", names, 3).collect()
    assert sorted(r["fold"] for r in table) == [0, 1, 2] and all(r["n_train"] + r["n_test"] == n and 0.6 < r["auc"] < 1 for r in table)


# ---------------------------------------------------------------- quantiles without a sort


@pytest.mark.parametrize("few", [O.FEW_ROWS, 0])
def test_describe_equals_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW_ROWS", few)
    rng = np.random.default_rng(6)
    n = 30_001
    cols = {"normal": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "one": np.full(n, 2.5), "skewed": np.exp(rng.normal(size=n) * 5)}
    rows = [tuple(float(cols[c][i]) for c in cols) + (None,) for i in range(n)]
    rows[7] = (None, *rows[7][1:])
    rows[8] = (float("nan"), *rows[8][1:])
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", empty double").repartition(7)
    got = {r["column"]: r for r in G.describe(df, [*cols, "empty"]).collect()}
    for j, c in enumerate(cols):
        v = np.array([r[j] for r in rows if r[j] is not None and r[j] == r[j]])
        want = np.quantile(v, [0.25, 0.5, 0.75])
        assert np.allclose([got[c][q] for q in ("p25", "p50", "p75")], want, rtol=1e-12)
    assert got["empty"]["p50"] is None and got["empty"]["count"] == 0


def test_wrong_brackets_are_found_out(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    for bad in ([900.0, 950.0], [0.0, 1.0], None):
        got = O.bracketed_quantiles(df, {"v": F.col("v")}, {"v": bad}, {"v": 1000}, [0.5]).collect()
        assert [r["value"] for r in got] == ([499.5] if bad else [])


def test_describe_plan_has_no_sort_of_the_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    row = df.agg(O.bracket_of(F.col("v"), [0.5]).alias("b")).first()
    seen = []
    whole = O.grouped_prefix_sums
    try:
        O.grouped_prefix_sums = lambda *a, **k: seen.append(a) or whole(*a, **k)
        assert O.bracketed_quantiles(df, {"v": F.col("v")}, {"v": row["b"]}, {"v": 1000}, [0.5]).first()["value"] == 499.5
    finally:
        O.grouped_prefix_sums = whole
    assert seen == []


# ---------------------------------------------------------------- hot ids


def bags(spark, n=4000, seed=8):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([7, rng.randint(-1, 60)]) for _ in range(rng.randint(0, 6))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row long, ids array<long>").repartition(4)


def test_one_id_in_half_of_all_bags(spark):
    rows, df = bags(spark)
    table = spark.createDataFrame([(i, [i / 7, -i / 1e9, float(i)]) for i in range(1, 50)], "k long, v array<float>")
    ids = df.select("row", F.explode("ids").alias("id"))
    assert 7 in {r["_hot"] for r in J.hot_ids(ids, "id", 100).collect()}
    got = {r["row"]: r["bag"] for r in J.embedding_bag_mean(df, "row", "ids", table, "k", "v", 55, 3).collect()}
    vec = {r["k"]: r["v"] for r in table.collect()}
    for row, own in rows:
        use = [vec.get(i, [0.0] * 3) for i in own if 0 < i < 55]
        want = np.mean(np.array(use, float), axis=0) if use else np.zeros(3)
        assert np.allclose(got[row], want, rtol=1e-12)
    found = J.lookup_vectors(ids, "id", table, "k", "v", 55, 3).collect()
    assert Counter((r["row"], r["id"], tuple(r["v"])) for r in found) == Counter((row, i, tuple(vec.get(i, [0.0] * 3) if 0 < i < 55 else [0.0] * 3)) for row, own in rows for i in own)
    # what is left to the shuffle has no frequent id
    hot = [r["_hot"] for r in J.hot_ids(ids, "id", 100).collect()]
    per = ids.where(~F.col("id").isin(hot)).groupBy("id").count().agg(F.max("count"), F.sum("count")).first()
    assert per[1] is None or per[0] <= max(2 * per[1] / 40, len(rows) * 7 * J.HOT_SHARE)


def test_bags_without_hot_ids_or_rows(spark):
    table = spark.createDataFrame([(1, [1.0])], "k long, v array<float>")
    none = spark.createDataFrame([(1, []), (2, None), (3, [0, -1])], "row long, ids array<long>")
    assert {r["row"]: r["bag"] for r in J.embedding_bag_mean(none, "row", "ids", table, "k", "v", 9, 1).collect()} == {1: [0.0], 2: [0.0], 3: [0.0]}
    assert J.embedding_bag_mean(none.limit(0), "row", "ids", table, "k", "v", 9, 1).count() == 0


def test_minus_zero_is_seen(spark):
    from test_oracle import _norm

    assert _norm([0.0]) != _norm([-0.0]) and _norm(0.0) == _norm(-0.0) and _norm((1.0, [0.0])) == _norm((1.0, [0.0]))
    rounded = spark.range(1).select(F.transform(F.array(F.lit(-1e-7)), lambda x: F.round(x, 6) + F.lit(0.0)).alias("v")).first()["v"]
    assert math.copysign(1, rounded[0]) == 1


# ---------------------------------------------------------------- long runs


def histories(seed=9, runs=12):
    rng = random.Random(seed)
    return [(f"r{g}" if g else None, s, rng.choice([None, float("nan")]) if rng.random() < 0.05 else round(rng.random(), 2)) for g in range(runs) for s in range(rng.randint(1, 80))]


def replay(rows, patience, margin, mode):
    out = {}
    for g, s, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        t = out.setdefault(g, W.Tracker(patience, margin, mode))
        t.see(s, v)
    return {g: (t.best, t.best_step, t.stop_step) for g, t in out.items()}


@pytest.mark.parametrize("mode", ["max", "min"])
def test_early_stopping_scan(spark, mode):
    rows = histories()
    df = spark.createDataFrame(rows, "run string, step int, v double").repartition(6)
    got = W.early_stopping(df, "run", "step", "v", patience=4, min_delta=0.05, mode=mode)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {r["run"]: (r["best_value"], r["best_step"], r["stop_step"]) for r in got.collect()} == replay(rows, 4, 0.05, mode)
    assert W.early_stopping(df.limit(0), "run", "step", "v", min_delta=0.05).count() == 0


@pytest.mark.parametrize("mode", ["max", "min"])
def test_early_stopping_online_equals_the_replay(spark, tmp_path, mode):
    rows = [r for r in histories(10, 5) if r[0] is not None and r[2] is not None and r[2] == r[2]]
    df = spark.createDataFrame(rows, "run string, step int, v double")
    for a, z in ((0, 20), (15, 50), (50, 99)):  # steps 15 to 19 come twice
        df.where((F.col("step") >= a) & (F.col("step") < z)).coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    got = {r["run"]: r for r in ST.track_run_files(spark, str(tmp_path / "runs"), "run", "step", "v", patience=6, min_delta=0.02, mode=mode, top_k=2).collect()}
    assert {g: (r["best_value"], r["best_step"], r["stop_step"]) for g, r in got.items()} == replay(rows, 6, 0.02, mode)
    for g, r in got.items():
        best = sorted(((v, s) for h, s, v in rows if h == g), key=lambda x: (-x[0] if mode == "max" else x[0], x[1]))[:2]
        assert list(zip(r["kept_values"], r["kept_steps"])) == best and r["last_step"] == max(s for h, s, _ in rows if h == g)


# ---------------------------------------------------------------- sketches, heavy values, scorers


def test_sketches_read_new_files_only(spark, tmp_path):
    data, state = str(tmp_path / "data"), str(tmp_path / "state")
    df = spark.range(50_000).select("id", (F.col("id") % 1000).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id") * 0.5).alias("v"), F.lit(None).cast("string").alias("e"))
    cols = ["id", "k", "v", "e"]
    df.where("id < 20000").coalesce(1).write.parquet(data)
    assert SS.refresh(spark, state, data, cols) == 1
    df.where("id >= 15000").repartition(3).write.mode("append").parquet(data)
    assert [SS.refresh(spark, state, data, cols) for _ in range(2)] == [3, 0]
    got = {r["column"]: r for r in SS.report(spark, state, data, cols).collect()}
    for c, n in (("id", 50_000), ("k", 1000), ("v", 16_667), ("e", 0)):
        assert abs(got[c]["n_distinct"] - n) <= 4 * SS.relative_error() * n and got[c]["rows"] == 55_000 and got[c]["files"] == 4
    # a file that is gone, or written anew, no longer counts as it was
    first = [r["file"] for r in SS.files_of(spark, data).collect()]
    df.where("id < 10").coalesce(1).write.mode("overwrite").parquet(data)
    assert SS.refresh(spark, state, data, cols) == 1 and len(first) == 4
    assert {r["column"]: r["rows"] for r in SS.report(spark, state, data, cols).collect()}["id"] == 10


def test_most_frequent_values(spark):
    rng = random.Random(12)
    values = [f"hot{i}" for i in range(5) for _ in range(400 - i)] + [f"v{rng.randint(0, 3000)}" for _ in range(4000)] + [None] * 50
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    want = sorted(Counter(v for v in values if v).items(), key=lambda x: (-x[1], x[0]))
    for n, tracked, proven in ((5, 300, True), (5, 10_000, True), (50, 40, False)):
        got, sure = HV.most_frequent(df, "v", n, tracked)
        assert [(r["v"], r["n"]) for r in got.collect()] == want[:n] and sure is proven
    low = {r["value"]: r["low"] for r in HV.summary(df, "v", 300).groupBy("value").agg(F.sum("low").alias("low")).collect()}
    error = low.pop(None)
    assert all(low.get(v, 0) <= c <= low.get(v, 0) + error for v, c in want)
    got, sure = HV.most_frequent(df.limit(0), "v", 3)
    assert got.count() == 0 and sure


def test_external_scorer(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([1.0, -2.0]))
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("nan"), 0.0)], "id long, a double, b double")
    load = lambda data: np.array(json.loads(data))
    s = SC.Scorer.read(spark, str(tmp_path / "m.json"), ["a", "b"], load, lambda m, x: np.nan_to_num(x) @ m)
    assert {r["id"]: r["prob"] for r in SC.score_external(df, s, ["id"]).collect()} == {1: -3.0, 2: -2.0, 3: 0.0}
    short = SC.Scorer(["a"], s.model, load, lambda m, x: x[:-1, 0])
    with pytest.raises(Exception, match="scores for"):
        SC.score_external(df, short, ["id"]).collect()
    assert SC.score_external(df.limit(0), s, ["id"]).count() == 0


# ---------------------------------------------------------------- row groups


def test_row_groups_follow_the_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.sources import rowgroups as RG

    for name, n, size in (("b", 1000, 300), ("a", 250, 100), ("c", 0, 10)):
        t = pa.table({"k": pa.array(range(n), pa.int64()), "s": [f"{name}{i}" for i in range(n)], "v": [i / 2 if i % 3 else None for i in range(n)]})
        pq.write_table(t.cast(pa.schema([("k", pa.int64()), ("s", pa.string()), ("v", pa.float64())])), tmp_path / f"{name}.parquet", row_group_size=size)
    (tmp_path / "notes.txt").write_text("x")
    path = str(tmp_path)
    blocks = RG.row_groups(spark, path)
    got = [(r["file"].rsplit("/", 1)[1], r["row_group"], r["rows"], r["first_row"], r["block"]) for r in blocks.orderBy("block").collect()]
    want = [(f, g, pq.ParquetFile(tmp_path / f).metadata.row_group(g).num_rows) for f in ("a.parquet", "b.parquet", "c.parquet") for g in range(pq.ParquetFile(tmp_path / f).metadata.num_row_groups)]
    assert [g[:3] for g in got] == want and [g[4] for g in got] == list(range(len(want))) and [g[3] for g in got if g[0] == "b.parquet"] == [0, 300, 600, 900]
    rows = RG.read_row_groups(spark, path, columns=["k", "s"])
    assert rows.columns == ["k", "s", "_block"] and rows.rdd.getNumPartitions() == len(want)
    assert Counter(r["_block"] for r in rows.collect()) == {g[4]: g[2] for g in got if g[2]}
    tail = RG.read_row_groups(spark, path, blocks.where("block >= 5"))
    assert sorted(r["s"] for r in tail.collect()) == sorted(f"b{i}" for i in range(600, 1000))
    some = RG.read_row_groups(spark, path).where("k >= 900 and v is not null").select("s", "v")
    assert sorted(map(tuple, some.collect())) == sorted((f"b{i}", i / 2) for i in range(900, 1000) if i % 3)
    one = RG._Reader(spark.read.parquet(path).schema, {"groups": "[]"})
    one.filters = [("k", ">=", 900)]
    meta = pq.ParquetFile(tmp_path / "b.parquet").metadata
    assert [one._may_hold(meta.row_group(g)) for g in range(4)] == [False, False, False, True]
    with pytest.raises(FileNotFoundError):
        RG.row_groups(spark, str(tmp_path / "none"))
