"""Splits, folds, block splits, sharding, shuffling and batching.

Exact stratified assignment without a per-class window
------------------------------------------------------
Each row gets a 32-bit md5 key ``h(id, salt, seed)``; the order inside a
class is ``(h, id)``. Ranks are needed only to compare with a few cut
points, so:

1. histogram: ``count`` per (class, top ``bits`` of h) — partial
   aggregation, at most classes x 2^bits rows;
2. bucket start offsets: a window over that small table;
3. buckets that lie wholly on one side of every cut point are assigned by
   a broadcast join (map-only); only the few buckets that straddle a cut
   get an exact ``row_number`` — those are hash-uniform, so each holds
   about n / 2^bits rows whatever the class skew.

Same result as ``row_number() over (partition by class order by h, id)``,
which is what the DuckDB oracle runs.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rand import hash32
from tessera.session import broadcast_if_small, materialize

DEFAULT_SEED = 42
DEFAULT_BITS = 16
# A bucket that straddles a cut point is ranked inside one task: keep it small.
MAX_BUCKET_ROWS = 1 << 22


def _cut(n: Column, frac: float) -> Column:
    """round-half-up(n * frac) as bigint (same formula in the oracle)."""
    return F.floor(n * F.lit(float(frac)) + F.lit(0.5)).cast("bigint")


def rank_assign(
    df: DataFrame,
    id_col: str,
    class_col: str | None,
    assign: Callable[[Column, Column], Column],
    out_col: str,
    salt: str = "split",
    seed: int = DEFAULT_SEED,
    bits: int = DEFAULT_BITS,
) -> DataFrame:
    """Add ``out_col = assign(rank, n)`` where rank is the exact 0-based rank
    of the row in its class under the (h, id) order and n the class size.
    ``assign`` must be monotone non-decreasing in rank."""
    cls = F.col(class_col) if class_col else F.lit(0)
    d = df.withColumn("_cls", cls).withColumn("_h", hash32(F.col(id_col), salt, seed))
    run = Window.partitionBy("_cls").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        # histogram over (class, top ``bits`` of h) with bucket start offsets,
        # pinned once; one small job gives its size and largest bucket. It is
        # rebuilt with more bits if a bucket is too large to rank in one task
        # (only on huge inputs).
        d = d.withColumn("_b", F.shiftright("_h", 32 - bits))
        hist = d.groupBy("_cls", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
        hist = hist.select(
            "_cls", "_b", "_cnt",
            (F.sum("_cnt").over(run) - F.col("_cnt")).alias("_start"),
            F.sum("_cnt").over(Window.partitionBy("_cls")).alias("_n"),
        )
        hist = materialize(hist)
        size = hist.agg(F.count(F.lit(1)).alias("rows"), F.max("_cnt").alias("biggest")).first()
        if (size["biggest"] or 0) <= MAX_BUCKET_ROWS or bits >= 32:
            break
        bits = min(32, bits + max(1, math.ceil(math.log2(size["biggest"] / MAX_BUCKET_ROWS))))
    lo = assign(F.col("_start"), F.col("_n"))
    hi = assign(F.col("_start") + F.col("_cnt") - 1, F.col("_n"))
    hist = hist.select(F.col("_cls").alias("_hc"), F.col("_b").alias("_hb"), "_start", "_n", F.when(lo == hi, lo).alias("_whole"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # the few rows of buckets that straddle a cut point are ranked by themselves, keys alone
    key = d.select("_cls", "_b", "_h", F.col(id_col).alias("_id"))
    edge = key.join(hist.where("_whole is null"), same("_cls", "_hc") & same("_b", "_hb"))
    w = Window.partitionBy("_cls", "_b").orderBy("_h", "_id")
    edge = edge.withColumn("_got", assign(F.col("_start") + F.row_number().over(w) - 1, F.col("_n")))
    edge = materialize(edge.groupBy(F.col("_cls").alias("_ec"), F.col("_id").alias("_eid")).agg(F.min("_got").alias("_got")))
    # classes x 2^bits rows at most, and about n / 2^bits a cut point: both measured
    j = d.join(broadcast_if_small(hist.select("_hc", "_hb", "_whole"), size["rows"], 96), same("_cls", "_hc") & same("_b", "_hb"))
    j = j.join(broadcast_if_small(edge, edge.count(), 96), same("_cls", "_ec") & same(id_col, "_eid"), "left")
    return j.withColumn(out_col, F.coalesce("_whole", "_got")).drop("_cls", "_h", "_b", "_hc", "_hb", "_whole", "_ec", "_eid", "_got")


def stratified_split(
    df: DataFrame,
    id_col: str,
    label_col: str | None,
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = DEFAULT_SEED,
    bits: int = DEFAULT_BITS,
) -> DataFrame:
    """Exact per-class train/val/test split. Test takes round(n*test_size)
    of each class; val takes round(rest * val_size/(1-test_size)); the rest
    is train. Adds a ``split`` column ('train' | 'val' | 'test')."""
    val_ratio = val_size / (1.0 - test_size)

    def assign(r: Column, n: Column) -> Column:
        n_test = _cut(n, test_size)
        n_val = _cut(n - n_test, val_ratio)
        return F.when(r < n_test, "test").when(r < n_test + n_val, "val").otherwise("train")

    return rank_assign(df, id_col, label_col, assign, "split", "split", seed, bits)


def split_report(df: DataFrame, label_col: str, split_col: str = "split") -> DataFrame:
    """R2: per (split, label) counts, split size and share of all rows, and the
    label share inside the split (all from one small aggregate)."""
    g = df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    by_split = Window.partitionBy(split_col)
    return g.select(
        split_col, label_col, "n",
        F.sum("n").over(by_split).alias("split_rows"),
        F.round(F.sum("n").over(by_split) * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("split_pct"),
        F.round(F.col("n") / F.sum("n").over(by_split), 6).alias("label_share"),
    )


def stratified_kfold(
    df: DataFrame, id_col: str, label_col: str | None, k: int = 5, seed: int = DEFAULT_SEED, bits: int = DEFAULT_BITS
) -> DataFrame:
    """R3 (fold column): shuffled stratified k folds; per class, fold sizes
    differ by at most one. fold = ceil((rank+1)*k/n) - 1."""

    def assign(r: Column, n: Column) -> Column:
        return F.floor(((r + 1) * F.lit(k) - 1) / n).cast("int")

    return rank_assign(df, id_col, label_col, assign, "fold", "fold", seed, bits)


# ---------------------------------------------------------------- block splits

def tail_split(
    df: DataFrame, block_col: str, n_blocks: int, valid_ratio: float, train_ratio: float = 1.0, legacy_tail: bool = False
) -> DataFrame:
    """The last max(1, int(n_blocks*valid_ratio)) blocks are 'valid'
    (none when valid_ratio == 0); train keeps the first
    max(1, int(n_train*train_ratio)) training blocks. ``legacy_tail=True``
    reproduces the reference quirk where dropped train blocks become valid.
    A single block goes to valid, leaving train empty."""
    n_valid = 0 if valid_ratio <= 0 else max(1, int(n_blocks * valid_ratio))
    n_train = n_blocks - n_valid
    keep = max(1, int(n_train * train_ratio)) if train_ratio < 1.0 else n_train
    valid_start = keep if legacy_tail else n_train
    b = F.col(block_col)
    part = F.when(b >= valid_start, "valid").when(b < keep, "train")
    return df.withColumn("part", part).where(F.col("part").isNotNull())


def shard(df: DataFrame, block_col: str, world_size: int, num_workers: int = 1, physical: bool = False) -> DataFrame:
    """Strided sharding of blocks: rank = block % world_size, worker =
    (block // world_size) % num_workers. Union over ranks covers each row once.
    ``physical=True`` also lays the data out one Spark partition per
    (rank, worker) so each consumer reads only its own partition."""
    b = F.col(block_col)
    out = df.withColumn("rank", F.pmod(b, F.lit(world_size)).cast("int")).withColumn(
        "worker", F.pmod(F.floor(b / world_size), F.lit(num_workers)).cast("int")
    )
    if physical:
        out = out.repartitionByRange(world_size * num_workers, "rank", "worker")
    return out


def batch_ids(df: DataFrame, pos_col: str, batch_size: int) -> DataFrame:
    """Batch id inside a block = (position in block) div batch_size. The
    position comes from the in-file row index, so no window is needed."""
    return df.withColumn("batch", F.floor(F.col(pos_col) / batch_size).cast("bigint"))


def batch_count(block_sizes: DataFrame, rows_col: str, batch_size: int) -> DataFrame:
    """Upper bound on batches = sum over blocks of ceil(rows / batch_size)."""
    return block_sizes.agg(F.sum(F.ceil(F.col(rows_col) / batch_size)).cast("bigint").alias("n_batches"))


def cut_batches(shuffled: DataFrame, id_col: str, batch_size: int) -> DataFrame:
    """The shuffled rows of a buffer window cut again into batches; the
    last of a window may be smaller. A window holds ``buffer_blocks`` blocks."""
    w = Window.partitionBy("shuffle_window").orderBy("shuffle_key", id_col)
    return shuffled.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch_size).cast("bigint"))


def windowed_shuffle(
    df: DataFrame, block_col: str, id_col: str, buffer_blocks: int, seed: int = DEFAULT_SEED, partitions: int | None = None
) -> DataFrame:
    """Buffered shuffle: blocks are grouped into windows of ``buffer_blocks``
    and rows are permuted inside a window by a seeded hash. Physically one
    exchange on the window id plus a sort inside each partition."""
    win = F.floor(F.col(block_col) / buffer_blocks).cast("bigint")
    d = df.withColumn("shuffle_window", win).withColumn("shuffle_key", hash32(F.col(id_col), "shuffle", seed))
    d = d.repartition(partitions, "shuffle_window") if partitions else d.repartition("shuffle_window")
    return d.sortWithinPartitions("shuffle_window", "shuffle_key", id_col)
