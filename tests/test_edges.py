"""Hand-made edge values (null / empty / -1 / 0 / = vocab / > vocab /
too long / future ts / ts = 0 / single class / ties / NaN / duplicate ids)."""

import math

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scalars as S
from tessera.operators import encode as EN
from tessera.operators import metrics as M
from tessera.operators import ranking as W


def test_pad_ids_edges(spark):
    df = spark.createDataFrame(
        [(1, None), (2, []), (3, [-1, 0, 5, 4, 7, 3, 2, 1])], "k int, x array<bigint>"
    )
    got = {r.k: r.p for r in df.select("k", A.pad_ids("x", 4, 5).alias("p")).collect()}
    assert got[1] == [0, 0, 0, 0]
    assert got[2] == [0, 0, 0, 0]
    # head-first truncation to 4, -1/0 -> 0, 5 (= vocab) -> 0, 4 kept
    assert got[3] == [0, 0, 0, 4]


def test_vocab_zero_forces_zero(spark):
    df = spark.createDataFrame([([3, 4],)], "x array<bigint>")
    assert df.select(A.pad_ids("x", 3, 0)).first()[0] == [0, 0, 0]
    assert spark.range(1).select(S.clean_scalar(F.lit(7), 0)).first()[0] == 0


def test_scalar_clean(spark):
    df = spark.createDataFrame([(None,), (-1,), (0,), (5,), (6,), (3,)], "x bigint")
    assert [r[0] for r in df.select(S.clean_scalar("x", 6)).collect()] == [0, 0, 0, 5, 0, 3]


def test_time_bucket_edges(spark):
    now = 1_700_000_000  # a real Unix time: ts = -1 is then > 1 year old
    rows = [(0, 0), (now + 100, 1), (now, 1), (now - 5, 1), (now - 6, 2), (now - 10**9, 63), (-1, 63)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "ts bigint")
    got = [r[0] for r in df.select(S.time_bucket(F.lit(now), "ts")).collect()]
    assert got == [b for _, b in rows]


def test_time_bucket_matches_searchsorted(spark):
    import numpy as np

    b = np.array(S.BUCKET_BOUNDARIES)
    dts = list(range(0, 70)) + [b_ - 1 for b_ in S.BUCKET_BOUNDARIES] + S.BUCKET_BOUNDARIES + [b_ + 1 for b_ in S.BUCKET_BOUNDARIES]
    df = spark.createDataFrame([(int(d),) for d in dts], "dt bigint")
    got = [r[0] for r in df.select(S.time_bucket(F.lit(10**10), F.lit(10**10) - F.col("dt"))).collect()]
    want = [int(np.clip(np.searchsorted(b, d), 0, len(b) - 1) + 1) for d in dts]
    assert got == want


def test_domain_encode_length_and_buckets(spark):
    cfg = {"prefix": "d", "ts_fid": 2, "features": [[1, 10], [2, 0], [3, 10]]}
    df = spark.createDataFrame(
        [(100, [1, 2, 3, 4, 5], [99, 98, 0, -1, 50], [1, 2])], "timestamp bigint, d_1 array<bigint>, d_2 array<bigint>, d_3 array<bigint>"
    )
    r = df.select(*EN.domain_columns("dom", cfg, 4)).first()
    assert r["dom"] == [[1, 2, 3, 4], [1, 2, 0, 0]]
    assert r["dom_len"] == 4
    # ts 99, 98 -> dt 1, 2 -> bucket 1; ts 0 -> 0; ts -1 is not cleaned: dt 101 -> 12 edges below -> 13
    assert r["dom_time_bucket"] == [1, 1, 0, 13]


def test_latest_k_right_aligned(spark):
    df = spark.createDataFrame([([5, 6, 7, 0, 0], 3), ([5, 6, 7, 8, 9], 5)], "x array<bigint>, n int")
    got = [r[0] for r in df.select(A.latest_k("x", "n", 4)).collect()]
    assert got == [[0, 5, 6, 7], [6, 7, 8, 9]]


def test_auc_single_class_and_ties(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.9), ("b", 1, 0.1), ("c", 1, 0.8), ("c", 0, 0.2), ("c", 0, float("nan"))],
        "g string, label int, prob double",
    )
    got = {r.g: r.auc for r in M.auc(df, "g").collect()}
    assert got["a"] == 0.5  # tie = half credit
    assert math.isnan(got["b"])  # one class
    assert got["c"] == 1.0  # NaN score excluded
    zero = {r.g: r.auc for r in M.auc(df, "g", single_class=0.0).collect()}
    assert zero["b"] == 0.0


def test_auc_sign_flip_symmetry(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        (F.col("event_type") == "purchase").cast("int").alias("label"), F.col("value").alias("prob"), F.lit(1).alias("g")
    )
    a = M.auc(df, "g").first()[1]
    b = M.auc(df.withColumn("prob", -F.col("prob")), "g").first()[1]
    assert abs(a + b - 1.0) < 1e-12


def test_dedupe_last_wins(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (2, 0, 0.3)], "user_id int, pos int, prob double")
    got = {r.user_id: r.prob for r in W.dedupe(df, "user_id", "pos", "last").collect()}
    assert got == {1: 0.9, 2: 0.3}


def test_array_pool_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ([],), ([1, 2, 6],)], "x array<bigint>")
    r = df.select(A.pool_mean("x", True), A.pool_max("x"), A.pool_min("x"), A.pool_sum("x"), A.length("x")).collect()
    assert [tuple(x) for x in r] == [(0.0, 0, 0, 0, 0), (0.0, 0, 0, 0, 0), (3.0, 6, 1, 9, 3)]


def test_calculate_metrics_ignores_unknown(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("a", 1, 0.4)], "g string, label int, prob double")
    r = M.calculate_metrics(df, "g", ["auc", "bogus", "f1"]).first()
    assert r.asDict().keys() == {"g", "auc", "f1"}
    assert r.auc == 1.0 and abs(r.f1 - 2 / 3) < 1e-12


def _tracker(values, patience, min_delta):
    """Plain-Python replay of an early-stopping tracker (mode max)."""
    best, best_step, counter = None, None, 0
    for step, v in values:
        if best is None or v > best + min_delta:
            best, best_step, counter = v, step, 0
        else:
            counter += 1
            if counter >= patience:
                return best, best_step, step
    return best, best_step, None


def test_early_stopping_matches_replay(spark):
    from tessera.plans import fixtures as V

    runs = V.v_runs(spark, "/root/testdata/sf0.001")
    hist = {}
    for r in runs.collect():
        hist.setdefault(r.run_id, []).append((r.step, r.val_auc))
    for patience, delta in [(3, 0.0), (2, 0.001), (5, 0.0005)]:
        got = {r.run_id: (r.best_value, r.best_step, r.stop_step) for r in W.early_stopping(runs, "run_id", "step", "val_auc", patience, delta).collect()}
        for run, vals in hist.items():
            assert got[run] == _tracker(sorted(vals), patience, delta)


def test_public_api_smoke(spark):
    from tessera import api

    v = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label")
    )
    s = api.split(v, "id", "label")
    assert s.count() == v.count()
    folds = api.kfold(v, "id", "label", 3).select("fold").distinct().count()
    assert folds == 3


def test_sidecar_resolution(spark):
    from tessera.sources import sinks as SK

    good = SK.scratch_path(spark, "model")
    SK.write_json_sidecar(spark, {"user_int": [[1, 5, 1]], "item_int": [], "user_dense": []}, f"{good}/schema.json")
    got = SK.resolve_sidecar(spark, "schema.json", SK.scratch_path(spark, "missing"), good)
    assert got.first().user_int == [[1, 5, 1]]


def test_early_stopping_window_path_matches_replay(spark):
    from tessera.plans import fixtures as V

    runs = V.v_runs(spark, "/root/testdata/sf0.001")
    hist = {}
    for r in runs.collect():
        hist.setdefault(r.run_id, []).append((r.step, r.val_auc))
    for patience in (1, 3, 6):
        got = {r.run_id: (r.best_value, r.best_step, r.stop_step) for r in W.early_stopping(runs, "run_id", "step", "val_auc", patience, 0.0).collect()}
        for run, vals in hist.items():
            assert got[run] == _tracker(sorted(vals), patience, 0.0)
