"""Split / fold / shard / augmentation invariants and partition independence."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import augment as N
from tessera.operators import split as R
from tessera.plans import fixtures as V

SF = "/root/testdata/sf0.001"


def test_split_sizes_disjoint_and_exact(spark):
    v = V.v_interactions(spark, SF)
    s = R.stratified_split(v, "sample_id", "label_type", 0.2, 0.1, 42, bits=4)
    rows = s.select("sample_id", "label_type", "split").collect()
    assert len(rows) == v.count()
    assert len({r.sample_id for r in rows}) == len(rows)
    from collections import Counter

    n = Counter(r.label_type for r in rows)
    c = Counter((r.label_type, r.split) for r in rows)
    for lab, tot in n.items():
        nt = int(tot * 0.2 + 0.5)
        nv = int((tot - nt) * 0.125 + 0.5)
        assert c[(lab, "test")] == nt and c[(lab, "val")] == nv


def test_split_partition_independent(spark):
    v = V.v_interactions(spark, SF)
    a = {(r.sample_id, r.split) for r in R.stratified_split(v.repartition(1), "sample_id", "label_type").collect()}
    b = {(r.sample_id, r.split) for r in R.stratified_split(v.repartition(8), "sample_id", "label_type").collect()}
    assert a == b


def test_split_bucket_bits_do_not_change_result(spark):
    v = V.v_interactions(spark, SF)
    a = {(r.sample_id, r.split) for r in R.stratified_split(v, "sample_id", "label_type", bits=2).collect()}
    b = {(r.sample_id, r.split) for r in R.stratified_split(v, "sample_id", "label_type", bits=16).collect()}
    assert a == b


def test_kfold_balance(spark):
    v = V.v_interactions(spark, SF)
    f = R.stratified_kfold(v, "sample_id", "label_type", 5)
    g = f.groupBy("label_type", "fold").count().collect()
    by = {}
    for r in g:
        by.setdefault(r.label_type, []).append(r["count"])
    for sizes in by.values():
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_shards_cover_once(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("block", F.floor(F.col("event_id") / 20))
    s = R.shard(e, "block", 3, 2)
    assert s.count() == e.count() == s.select("event_id").distinct().count()


def test_augment_keeps_ids_and_lengths(spark):
    u = V.v_user_seq(spark, SF)
    a = N.sequence_random_mask(u, ["seq_val"], "user_id", 0.15)
    rows = a.join(u.select("user_id", F.col("seq_val").alias("orig")), "user_id").collect()
    assert len(rows) == u.count()
    for r in rows:
        assert len(r.seq_val) == len(r.orig)
        zeros = sum(1 for x, y in zip(r.seq_val, r.orig) if x == 0 and y != 0)
        assert zeros <= max(1, int(len(r.orig) * 0.15))


def test_augmented_dataset_copies(spark):
    f = V.v_features(spark, SF).select("id", "f1", "f2")
    d = N.augmented_dataset(f, ["f1", "f2"], [], [], "id", factor=3)
    assert d.count() == 3 * f.count()
    assert d.where("copy = 0").select("id").distinct().count() == f.count()


def test_split_histogram_refinement_keeps_result(spark, monkeypatch):
    v = V.v_interactions(spark, SF)
    a = {(r.sample_id, r.split) for r in R.stratified_split(v, "sample_id", "label_type", bits=16).collect()}
    monkeypatch.setattr(R, "MAX_BUCKET_ROWS", 40)  # force the extra-bits pass
    b = {(r.sample_id, r.split) for r in R.stratified_split(v, "sample_id", "label_type", bits=1).collect()}
    assert a == b


def test_pair_partners_bits_do_not_drop_rows(spark):
    f = V.v_features(spark, SF).select("id", "f2")
    for bits in (2, 10):
        p = N.pair_partners(f, "id", ["f2"], bits=bits)
        assert p.count() == f.count() and p.where("f2_partner is null").count() == 0


def test_augmentation_partition_independent(spark):
    from tessera.plans import registry as REG

    w = V.v_wide(spark, SF).select("sample_id", *REG.AUG_SCALARS, *REG.AUG_ARRAYS, *REG.AUG_SEQS)

    def run(d):
        # the noise scale is a sample std (a float sum whose order follows the
        # partitioning), so compare the noisy scalars to 9 places
        out = N.aggressive(d, REG.AUG_SCALARS, REG.AUG_ARRAYS, REG.AUG_SEQS, "sample_id")
        out = out.withColumns({c: F.round(F.col(c), 9) for c in REG.AUG_SCALARS})
        return {tuple(map(str, r)) for r in out.collect()}

    assert run(w.repartition(1)) == run(w.repartition(7))


def test_block_ordinal_dense(spark):
    from tessera.sources import tables as T

    d = T.with_block_ordinal(T.read_parquet_dir(spark, f"{SF}/events.parquet"), 100)
    got = sorted({(r.block_in_file, r.block) for r in d.select("block_in_file", "block").collect()})
    assert [b for _, b in got] == list(range(len(got)))
    assert all(int(a) == b for a, b in got)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_feature_ids_are_unique(spark, sf):
    f = V.v_features(spark, f"/root/testdata/sf{sf}")
    assert f.select("id").distinct().count() == f.count()


def test_blocks_follow_file_names(spark, tmp_path):
    from tessera.sources import tables as T

    for name, lo, n in (("b.parquet", 100, 25), ("a.parquet", 0, 12), ("c.parquet", 200, 10)):
        spark.range(lo, lo + n).coalesce(1).write.parquet(f"{tmp_path}/x")
        part = next((tmp_path / "x").glob("part-*.parquet"))
        part.rename(tmp_path / name)
        import shutil

        shutil.rmtree(tmp_path / "x")
    (tmp_path / "notes.txt").write_text("not a table")
    table = T.read_parquet_dir(spark, str(tmp_path))
    rows, n = T.with_block_ordinal(table, 10), T.block_table(table, 10).count()
    got = sorted((r["block"], r["_pos"], r["id"]) for r in rows.collect())
    ids = [*range(12)], [*range(100, 125)], [*range(200, 210)]
    cut = [f[i : i + 10] for f in ids for i in range(0, len(f), 10)]
    assert n == 6 and got == [(b, p, x) for b, block in enumerate(cut) for p, x in enumerate(block)]
    with pytest.raises(FileNotFoundError):
        T.read_parquet_dir(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("bits", [0, 3, 20, None])
def test_partners_are_one_cycle_a_class(spark, bits):
    from tessera.operators import augment as N

    rows = [(i, c) for c, n in (("a", 40), (None, 7), ("one", 1)) for i in range(len(c or "") * 1000, len(c or "") * 1000 + n)]
    got = N.pair_partners(spark.createDataFrame(rows, "id long, c string"), "id", ["id", "c"], by=["c"], bits=bits).collect()
    to = {r["id"]: r["id_partner"] for r in got}
    assert all(r["c"] == r["c_partner"] for r in got) and len(to) == len(rows)
    for first, n in ((1000, 40), (0, 7), (3000, 1)):
        seen, at = [], first
        while at not in seen:
            seen.append(at)
            at = to[at]
        assert len(seen) == n
    test_partners_are_one_cycle_a_class.seen = getattr(test_partners_are_one_cycle_a_class, "seen", to)
    assert test_partners_are_one_cycle_a_class.seen == to  # the same at any bucket setting


@pytest.mark.parametrize("alpha", [0.2, 1.0, 2.0])
def test_beta_moments(spark, alpha):
    from tessera.operators import augment as N

    x = spark.range(40_000).select(N.beta_sample(F.col("id"), "t", alpha).alias("x"))
    m = x.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count_if(F.col("x") == 0.5).alias("half")).first()
    assert abs(m["m"] - 0.5) < 0.01 and abs(m["v"] - 1 / (4 * (2 * alpha + 1))) < 0.01 and m["half"] < 5


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_exact_quantiles_match_numpy(spark, parts):
    import numpy as np

    from tessera.operators import ordering as O

    f = V.v_features(spark, SF, with_id=False)
    long = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ["f1", "f2", "f3"]])).alias("e")).select("e.*")
    long = long.withColumn("k", F.when(F.col("k") != "f3", F.col("k")))  # null is a key too
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {(r.k, r.q): r.value for r in O.exact_quantiles(long, "k", "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    pdf = f.toPandas()
    for c, k in [("f1", "f1"), ("f2", "f2"), ("f3", None)]:
        x = pdf[c].dropna().to_numpy()
        for q in [0.0, 0.25, 0.5, 0.9, 1.0]:
            assert abs(got[(k, q)] - float(np.quantile(x, q))) < 1e-9 * max(1.0, abs(float(np.quantile(x, q))))


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_grouped_running_sums_keep_the_null_group(spark, parts):
    from tessera.operators import metrics as M
    from tessera.operators import ordering as O

    rows = [(g, i * 0.5, i % 4, 1) for g, n in ((None, 30), ("a", 200), ("b", 1), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o double, x long, y long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    for desc in (False, True):
        got = {(r.g, r.o): (r.cum_x, r.cum_y) for r in O.grouped_prefix_sums(df, "g", "o", ["x", "y"], desc).collect()}
        want = {(g, o): (sum(r[2] for r in rows if r[0] == g and (r[1] >= o if desc else r[1] <= o)), sum(r[3] for r in rows if r[0] == g and (r[1] >= o if desc else r[1] <= o))) for g, o, *_ in rows}
        assert got == want
    scored = df.select("g", F.pmod(F.col("x"), F.lit(2)).cast("int").alias("label"), (F.col("o") / 200).alias("prob"))
    groups = {None, "a", "b", "c"}
    for t in (M.auc, M.roc_curve, M.pr_curve, M.average_precision, M.metric_table, M.calculate_metrics):
        assert {r.g for r in t(scored, "g").collect()} == groups
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_physical_shards(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("block", F.floor(F.col("event_id") / 20))
    s = R.shard(e, "block", 2, 2, physical=True).withColumn("pid", F.spark_partition_id())
    per = s.groupBy("pid").agg(F.countDistinct("rank", "worker").alias("k")).collect()
    assert all(r.k == 1 for r in per) and s.count() == e.count()
