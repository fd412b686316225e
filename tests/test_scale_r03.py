"""Scale faults of round 3: where rows land and which work is done twice."""

import json

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import codes as CO
from tessera.operators import joins as JO
from tessera.operators import knn as KN
from tessera.operators import models as ML
from tessera.operators import neighbours as NB
from tessera.plans import fixtures as V
from tessera.plans import registry as Q
from tessera.sources import rowgroups as RG
from tessera.streaming import stream as ST

from conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_balanced_weights_leave_rows_where_they_are(spark):
    """The class table is broadcast: rows of a class do not meet in one partition."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        d = spark.range(0, 4000, 1, 16).select("id", (F.col("id") % 2).cast("double").alias("y"))
        got = ML.with_balanced_weight(d, "y")
        assert got.groupBy(F.spark_partition_id()).count().count() == 16
        assert {r["weight"] for r in got.select("weight").distinct().collect()} == {1.0}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_training_frame_has_bounded_partitions(spark, monkeypatch):
    rows = V.read_table(spark, SMALL, "orders").count()
    monkeypatch.setattr(Q, "TRAIN_ROWS", max(1, rows // 40))
    d, _ = Q._train_frame(spark, SMALL)
    sizes = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 35 and max(sizes) <= 3 * rows // 40


def test_features_with_ids_of_a_narrow_table(spark):
    wide = V.v_wide(spark, SMALL)
    a, b = ML.features_ml(wide), ML.features_ml(wide, V.v_interactions(spark, SMALL))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_wide_view_makes_no_baskets_where_none_is_read(spark):
    assert "collect_list(struct(l_linenumber" not in _plan(Q.q_filters(spark, SMALL)).lower()
    assert "collect_list(struct(l_linenumber" not in _plan(Q.q_seq_stats(spark, SMALL)).lower()


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    e = V.read_table(spark, SMALL, "embeddings").select("vec_id", "embedding")
    e.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ST.stream_transform_to_parquet(spark, str(tmp_path), "embeddings", lambda b: b.select("vec_id"))
    assert sorted(r["vec_id"] for r in got.collect()) == sorted(r["vec_id"] for r in e.collect())
    V.read_table(spark, SMALL, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    n = ST.category_counts_stream(spark, str(tmp_path), "events", "event_type")
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in V.read_table(spark, SMALL, "events").groupBy("event_type").count().collect()}


def test_wide_files_are_many_and_batches_few(spark, monkeypatch):
    seen = []
    real = ST.encode_stream

    def spy(spark, path, *args, **kw):
        seen.append((len(spark.read.parquet(path).inputFiles()), kw["max_files"]))
        return real(spark, path, *args, **kw)

    monkeypatch.setattr(ST, "encode_stream", spy)
    monkeypatch.setattr(Q, "FILE_ROWS", 100)
    got, counts = ST_queries(spark)
    (files, per_batch), _ = seen
    assert files > 10 and -(-files // per_batch) in (2, 3)
    assert got == Q.QUERIES["A10_A13_encode_batch"](spark, SMALL).count()
    assert counts == sorted(map(tuple, Q.QUERIES["G15_oob_stats"](spark, SMALL).select("grp", "column", "oob_count").collect()))


def ST_queries(spark):
    rows = Q.QUERIES["ST_encode_stream"](spark, SMALL).count()
    return rows, sorted(map(tuple, Q.QUERIES["ST_G15_oob_over_batches"](spark, SMALL).select("grp", "column", "oob_count").collect()))


def test_many_row_groups_share_partitions(spark, tmp_path, monkeypatch):
    """Partitions do not grow with the row groups; rows and blocks stay."""
    path = f"{tmp_path}/rg"
    d = spark.range(0, 20_000, 1, 2).select("id", F.xxhash64("id").alias("h"))
    d.write.option("parquet.block.size", "1024").option("parquet.block.size.row.check.min", "100").parquet(path)
    blocks = RG.row_groups(spark, path).collect()
    assert len(blocks) > 20
    plain = RG.read_row_groups(spark, path)
    want = sorted(map(tuple, plain.collect()))
    assert plain.rdd.getNumPartitions() == len(blocks)
    monkeypatch.setattr(RG, "MOST_PARTITIONS", 7)
    got = RG.read_row_groups(spark, path)
    # the limit is read where the partitions are planned, in a worker of its own
    assert sorted(map(tuple, got.collect())) == want and len(want) == 20_000
    reader = RG._Reader(plain.schema, {"groups": json.dumps([(b["file"], b["row_group"], b["block"]) for b in blocks])})
    parts = reader.partitions()
    assert len(parts) <= 7 and sum(len(p.groups) for p in parts) == len(blocks)
    read = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(read) == want


def test_forest_that_cannot_reach_its_recall_compares_blocks(spark, monkeypatch):
    """Vectors without structure: no round after one that shows it, then all
    pairs in blocks, with ties and copies, exactly."""
    x = np.random.default_rng(8).normal(size=(900, 40))
    x[300:320] = x[7]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    asked = []
    real = NB.recall_of
    monkeypatch.setattr(NB, "recall_of", lambda *a, **kw: asked.append(1) or real(*a, **kw))
    monkeypatch.setattr(NB, "BLOCK_BYTES", 40 * 8 * 200)
    got, recall = NB.knn_forest(df, "id", "x", k=5, cell_rows=32)
    rows = {r["id"]: [n["id"] for n in r["nbrs"]] for r in got.collect()}
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert recall == 1.0 and len(asked) == 1
    assert rows == {i: [int(j) for j in np.lexsort((np.arange(900), d[i]))[:5]] for i in range(900)}


def test_matrix_product_finds_what_a_scan_finds():
    """Far from zero, with ties and copies, in single and double precision."""
    rng = np.random.default_rng(9)
    for dims, far in ((4, 1e6), (40, 1e3)):
        x = np.round(rng.normal(size=(1500, dims)), 1) + far
        x[::50] = x[0]
        ids = rng.permutation(1500)
        d = np.zeros((1500, 1500))
        for i in range(dims):
            d += np.square(x[:, None, i] - x[None, :, i])
        d = np.sqrt(d)
        row, dist, near = KN.nearest_flat(x, x, ids, 6)
        want = [np.lexsort((ids, d[i]))[:6] for i in range(1500)]
        assert (row.reshape(-1, 6) == np.arange(1500)[:, None]).all()
        assert (near.reshape(-1, 6) == ids[np.array(want)]).all()
        assert (dist.reshape(-1, 6) == np.take_along_axis(d, np.array(want), 1)).all()


def test_bags_add_up_where_their_vectors_meet(spark, monkeypatch):
    """Copies of ids and of rows, nulls and missing vectors; whole table and
    looked-up part; no sums pass a shuffle."""
    rng = np.random.default_rng(10)
    rows = [(int(k) if k % 9 else None, [int(v) if v % 7 else None for v in rng.integers(-2, 30, rng.integers(0, 6))]) for k in rng.integers(0, 80, 150)]
    vecs = [(i, [float(i), None if i % 5 == 0 else i / 3]) for i in [*range(1, 20), 4, 4, 12]] + [(22, None)]
    df = spark.createDataFrame([*rows, (500, None)], "row long, ids array<long>").repartition(3)
    table = spark.createDataFrame(vecs, "k long, v array<float>")
    want, seen = {}, {}
    for k, own in rows:
        for i in own:
            if k is not None and i is not None and 0 < i < 25:
                seen.setdefault(k, []).extend([v or [0.0, 0.0] for j, v in vecs if j == i] or [[0.0, 0.0]])
    for k, own in [*rows, (500, None)]:
        per = [[v[d] for v in seen.get(k, [[0.0, 0.0]]) if v[d] is not None] for d in (0, 1)]
        want.setdefault(k, []).append([round(sum(x) / len(x), 5) if x else None for x in per])
    for added in (JO.ADDED, 3):
        monkeypatch.setattr(JO, "ADDED", added)
        out = JO.embedding_bag_mean(df, "row", "ids", table, "k", "v", 25, 2)
        assert "avg(" not in _plan(out)
        got = {}
        for r in out.collect():
            got.setdefault(r["row"], []).append([x if x is None else round(x, 5) for x in r["bag"]])
        assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
    many = spark.range(0, 3000).select(F.col("id").alias("row"), F.expr("array(1L, 2L, 3L, 4L)").alias("ids"))
    out = JO.embedding_bag_mean(many, "row", "ids", table.where("k < 4"), "k", "v", 25, 2)
    assert {tuple(round(x, 5) for x in r["bag"]) for r in out.collect()} == {(1.5, 0.5)} and out.count() == 3000


def test_codes_by_matrix_products_equal_a_scan(spark, monkeypatch):
    """Vectors without structure, where little is pruned, ties and far values:
    as in a scan; one file feeds all cores."""
    rng = np.random.default_rng(12)
    codes, x = (np.round(rng.normal(size=(n, 24)), 1) + 50 for n in (3000, 400))
    codes[900:960] = codes[:60]
    x[:20] = codes[:20]
    block = CO.Block.build(np.arange(3000), codes, 40)
    d2, ids, scanned = block.nearest(x, np.full(400, np.inf), np.full(400, np.iinfo(np.int64).max))
    want = np.array([np.square(codes - v).sum(axis=1) for v in x])
    assert (ids == want.argmin(axis=1)).all() and (d2 == want.min(axis=1)).all()
    assert scanned.min() > 40 and scanned.sum() > 0.5 * want.size
    x[0, 0], x[1] = 1e18, np.nan
    far = np.square(codes - x[0]).sum(axis=1)
    d2, ids, _ = block.nearest(x, np.full(400, np.inf), np.full(400, np.iinfo(np.int64).max))
    assert ids[0] == far.argmin() and d2[0] == far.min() and (ids[2:] == want[2:].argmin(axis=1)).all()
    make = lambda m: spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(m)], "id long, x array<double>")
    got = CO.nearest_code_pruned(make(codes).coalesce(1), "id", "x", make(codes[:50]), "id", "x")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_augmented_copies_come_from_one_pass(spark):
    plan = _plan(Q.q_aug_dataset(spark, SMALL))
    assert "Union" not in plan and plan.count("events.parquet") <= 1 and plan.lower().count("collect_list(struct(t") <= 1
    got = Q.q_aug_dataset(spark, SMALL)
    first = V.v_wide(spark, SMALL).select("sample_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in Q.AUG_SCALARS], *Q.AUG_ARRAYS, *Q.AUG_SEQS)
    mine = got.where("copy = 0").drop("copy")
    assert mine.exceptAll(first).count() == 0 and first.exceptAll(mine).count() == 0
    assert {r["copy"]: r["count"] for r in got.groupBy("copy").count().collect()} == dict.fromkeys((0, 1, 2), first.count())


def test_forest_keeps_rows_that_come_twice(spark, monkeypatch):
    x = np.random.default_rng(13).normal(size=(200, 30))
    df = spark.createDataFrame([(i % 200, [float(a) for a in x[i % 200]]) for i in range(260)], "id long, x array<double>").repartition(3)
    monkeypatch.setattr(NB, "BLOCK_BYTES", 30 * 8 * 90)
    for reach in (0.0, 1.1):  # by the first round, by all pairs
        rows = NB.knn_forest(df, "id", "x", k=4, cell_rows=64, target_recall=reach)[0].collect()
        assert sorted(r["id"] for r in rows) == sorted(i % 200 for i in range(260))
        assert all(len(r["nbrs"]) == 4 for r in rows)
