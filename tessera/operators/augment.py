"""Augmentation and resampling.

All randomness is ``rand.uniform(key, salt, seed[, index])``: a pure
function of the row key, so results do not depend on partitioning and a
retried task redraws the same numbers. Every transform is a narrow,
map-only projection except the partner pairing (J3), which is one window
over hash buckets of uniform size.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rand as RD
from tessera.functions.rand import gaussian, uniform


def _key(key_col: str) -> Column:
    return F.col(key_col)


def scalar_gaussian_noise(
    df: DataFrame, cols: Sequence[str], key_col: str, sigma_ratio: float = 0.01, seed: int = 42, std_source: DataFrame | None = None
) -> DataFrame:
    """X + N(0, sigma_ratio * sample_std(x)); columns with std 0 / NaN
    are left as is; null stays null. The std row (one row) is attached by a
    broadcast cross join."""
    stats = (std_source if std_source is not None else df).agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(stats))
    out = []
    for c in df.columns:
        if c in cols:
            sd = F.col(f"_sd_{c}")
            noisy = F.col(c) + gaussian(_key(key_col), f"n1:{c}", seed) * F.lit(sigma_ratio) * sd
            ok = sd.isNotNull() & ~F.isnan(sd) & (sd != 0)
            out.append(F.when(ok, noisy).otherwise(F.col(c).cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return d.select(*out)


def scalar_random_scale(df: DataFrame, cols: Sequence[str], key_col: str, lo: float = 0.95, hi: float = 1.05, seed: int = 42) -> DataFrame:
    """X * U(lo, hi), one factor per (row, column)."""
    return df.withColumns(
        {c: F.col(c) * (F.lit(lo) + F.lit(hi - lo) * uniform(_key(key_col), f"n2:{c}", seed)) for c in cols}
    )


def array_random_mask(df: DataFrame, cols: Sequence[str], key_col: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Each element kept when u > ratio, else 0."""
    def m(c):
        return F.transform(
            F.col(c), lambda v, i: F.when(uniform(_key(key_col), f"n3:{c}", seed, i) > ratio, v).otherwise(v * 0)
        )
    return df.withColumns({c: m(c) for c in cols})


def _start(key: Column, salt: str, seed: int, n: Column, length: Column) -> Column:
    """uniform integer in [0, n - length]."""
    return F.floor(uniform(key, salt, seed) * (n - length + 1)).cast("int")


def array_random_crop(df: DataFrame, cols: Sequence[str], key_col: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Len <= 2 unchanged; else a contiguous run of max(1, int(len*ratio))."""
    def crop(c):
        n = F.size(F.col(c))
        L = F.greatest(F.lit(1), F.floor(n * ratio).cast("int"))
        st = _start(_key(key_col), f"n4:{c}", seed, n, L)
        return F.when(F.col(c).isNull() | (n <= 2), F.col(c)).otherwise(F.slice(F.col(c), st + 1, L))
    return df.withColumns({c: crop(c) for c in cols})


def sequence_random_mask(df: DataFrame, cols: Sequence[str], key_col: str, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """Len <= 2 unchanged; else exactly max(1, int(len*ratio)) distinct
    positions (those with the smallest per-position hash) are set to 0."""
    def mask(c):
        x = F.col(c)
        n = F.size(x)
        k = F.greatest(F.lit(1), F.floor(n * ratio).cast("int"))
        ranked = F.array_sort(F.transform(x, lambda v, i: F.struct(uniform(_key(key_col), f"n5:{c}", seed, i).alias("u"), i.alias("i"))))
        # back to index order with a "chosen" flag: every HOF reads its input
        # once, so the per-row cost stays O(len log len)
        flags = F.transform(
            F.array_sort(F.transform(ranked, lambda s, r: F.struct(s["i"].alias("i"), (r < k).alias("m")))), lambda s: s["m"]
        )
        masked = F.zip_with(x, flags, lambda v, m: F.when(m, v * 0).otherwise(v))
        return F.when(x.isNull() | (n <= 2), x).otherwise(masked)
    return df.withColumns({c: mask(c) for c in cols})


def sequence_subsample(df: DataFrame, cols: Sequence[str], key_col: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Len <= 3 unchanged; else a contiguous run of max(2, int(len*ratio))."""
    def sub(c):
        n = F.size(F.col(c))
        L = F.greatest(F.lit(2), F.floor(n * ratio).cast("int"))
        st = _start(_key(key_col), f"n6:{c}", seed, n, L)
        return F.when(F.col(c).isNull() | (n <= 3), F.col(c)).otherwise(F.slice(F.col(c), st + 1, L))
    return df.withColumns({c: sub(c) for c in cols})


def chunk_reorder(df: DataFrame, cols: Sequence[str], key_col: str, chunk: int = 3, seed: int = 42) -> DataFrame:
    """Cut into chunks of ``chunk`` elements, shuffle the chunks, flatten."""
    def re(c):
        x = F.col(c)
        n_chunks = F.ceil(F.size(x) / chunk).cast("int")
        idx = F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0)))
        parts = F.transform(idx, lambda j: F.struct(uniform(_key(key_col), f"n7:{c}", seed, j).alias("u"), F.slice(x, j * chunk + 1, chunk).alias("p")))
        out = F.flatten(F.transform(F.array_sort(parts), lambda s: s["p"]))
        return F.when(x.isNull() | (F.size(x) == 0), x).otherwise(out)
    return df.withColumns({c: re(c) for c in cols})


def conservative(df: DataFrame, scalar_cols, array_cols, seq_cols, key_col: str, seed: int = 42, std_source=None) -> DataFrame:
    """N1(.01) -> N3(.1) -> N5(.1) -> N6(.8)."""
    d = scalar_gaussian_noise(df, scalar_cols, key_col, 0.01, seed, std_source)
    d = array_random_mask(d, array_cols, key_col, 0.1, seed)
    d = sequence_random_mask(d, seq_cols, key_col, 0.1, seed)
    return sequence_subsample(d, seq_cols, key_col, 0.8, seed)


def aggressive(df: DataFrame, scalar_cols, array_cols, seq_cols, key_col: str, seed: int = 42, std_source=None) -> DataFrame:
    """N1(.05) -> N2(.9,1.1) -> N3(.2) -> N4(.8) -> N5(.15) -> N6(.7)."""
    d = scalar_gaussian_noise(df, scalar_cols, key_col, 0.05, seed, std_source)
    d = scalar_random_scale(d, scalar_cols, key_col, 0.9, 1.1, seed)
    d = array_random_mask(d, array_cols, key_col, 0.2, seed)
    d = array_random_crop(d, array_cols, key_col, 0.8, seed)
    d = sequence_random_mask(d, seq_cols, key_col, 0.15, seed)
    return sequence_subsample(d, seq_cols, key_col, 0.7, seed)


STRATEGIES = {"conservative": conservative, "aggressive": aggressive}


def augmented_dataset(
    df: DataFrame, scalar_cols, array_cols, seq_cols, key_col: str, factor: int = 2, strategy: str = "conservative", seed: int = 42, std_source: DataFrame | None = None
) -> DataFrame:
    """The original rows (copy 0) plus factor-1 augmented copies, copy i
    drawn with seed + i + 1. All are produced by one ``explode`` (map-side), so
    the rows are made once; the per-copy seed is mixed into the row key. The noise
    scale comes from ``std_source``, by default the original rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    if factor <= 1:
        return df.withColumn("copy", F.lit(0))
    changed = [c for c in df.columns if c in {*scalar_cols, *array_cols, *seq_cols}]
    first = F.col("copy") == 0
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    # the original's values wait beside; null takes their place, nothing is drawn for it
    copies = copies.withColumns({f"_first_{c}": F.when(first, F.col(c)) for c in changed})
    copies = copies.withColumns({c: F.when(~first, F.col(c)) for c in changed})
    # the draw key is (row key, copy): seeds 43, 44, ... as in the reference
    copies = copies.withColumn("_akey", F.concat_ws("#", F.col(key_col).cast("string"), (F.col("copy") + seed).cast("string")))
    aug = STRATEGIES[strategy](copies, scalar_cols, array_cols, seq_cols, "_akey", seed, std_source=df if std_source is None else std_source)
    both = {c: F.when(first, F.col(f"_first_{c}").cast(aug.schema[c].dataType)).otherwise(F.col(c)) for c in changed}
    return aug.select(*[both.get(c, F.col(c)).alias(c) for c in df.columns if c != "copy"], "copy")


def batch_dense_augment(
    df: DataFrame, col: str, key_col: str, block_col: str, pos_col: str, batch_size: int, ratio: float = 0.1, noise_std: float = 0.01,
    scale_range: tuple[float, float] = (0.9, 1.1), seed: int = 42,
) -> DataFrame:
    """Within each batch the first int(B*ratio) rows have their dense
    vector replaced by x*s + N(0, std) (s uniform per row); row count and
    other columns are unchanged. Batches are cut block by block from the
    positions in a block, so B is smaller for the last batch of a block."""
    sizes = df.groupBy(F.col(block_col).alias("_blk")).agg(F.count(F.lit(1)).alias("_rows"))
    df = df.join(sizes, df[block_col].eqNullSafe(sizes["_blk"])).drop("_blk")
    pos = F.pmod(F.col(pos_col), F.lit(batch_size))
    rows = F.least(F.lit(batch_size), F.col("_rows") - (F.col(pos_col) - pos))
    in_head = pos < F.floor(rows * F.lit(float(ratio)) + F.lit(1e-9))
    s = F.lit(scale_range[0]) + F.lit(scale_range[1] - scale_range[0]) * uniform(_key(key_col), "n11s", seed)
    new = F.transform(F.col(col), lambda v, i: (v * s + gaussian(_key(key_col), "n11g", seed, i) * noise_std).cast("float"))
    return df.withColumn(col, F.when(in_head, new).otherwise(F.col(col))).drop("_rows")


# ---------------------------------------------------------------- pairing (J3) and mixing

PAIR_BUCKET_ROWS = 1 << 20


def pair_partners(
    df: DataFrame, key_col: str, cols: Sequence[str], by: Sequence[str] = (), seed: int = 42, bits: int | None = None
) -> DataFrame:
    """A random cyclic permutation of the rows of each class (``by``; null
    is a class): rows in the order of a seeded hash take the ``cols`` of the
    next row, the last row those of the first. Only the row of a class of its
    own is its own partner.

    The order is cut by the leading ``bits`` of the hash, so that a window
    partition has about PAIR_BUCKET_ROWS rows or fewer, whatever the class
    sizes; the last row of a bucket takes the first row of the class's next
    bucket, from a table of one row a bucket. ``bits`` does not change results."""
    if bits is None:
        bits = min(32, max(4, (df.count() // PAIR_BUCKET_ROWS).bit_length()))
    h = RD.hash32(F.col(key_col), "pair", seed)
    d = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 32 - bits))
    row = F.struct(*[F.col(c).alias(f"{c}_partner") for c in cols])
    heads = d.groupBy(*by, "_b").agg(F.min_by(row, F.struct("_h", key_col)).alias("_head"))
    order = Window.partitionBy(*by).orderBy("_b")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("_next", F.coalesce(F.lead("_head").over(order), F.first("_head").over(whole)))
    heads = heads.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_b").alias("_hb"), "_next")
    d = d.withColumn("_lead", F.lead(row).over(Window.partitionBy(*by, "_b").orderBy("_h", key_col)))
    cond = F.col("_b") == F.col("_hb")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    partner = F.coalesce("_lead", "_next")
    return d.join(heads, cond).select(*df.columns, *[partner[f"{c}_partner"].alias(f"{c}_partner") for c in cols])


def beta_sample(key: Column, salt: str, a: float, seed: int = 42) -> Column:
    """Beta(a, a) for any a > 0 from four hash uniforms, without rejection.

    Y ~ Beta(a+1, a+1) by the closed form for symmetric beta variables; as a
    Gamma(a) variable is a Gamma(a+1) variable times U^(1/a), the odds of the
    result are Y / (1 - Y) * (U1 / U2)^(1/a)."""
    u = {s: uniform(key, f"{salt}:{s}", seed) for s in "uvab"}
    spread = F.sqrt(F.lit(1.0) - F.pow(F.lit(1.0) - u["v"], F.lit(2.0 / (2.0 * a + 1.0))))
    y = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(2 * math.pi) * u["u"]) * spread)
    y = F.least(F.greatest(y, F.lit(1e-16)), F.lit(1.0 - 1e-16))
    odds = F.log(y) - F.log(F.lit(1.0) - y) + (F.log(F.lit(1.0) - u["a"]) - F.log(F.lit(1.0) - u["b"])) / a
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def mixup(df: DataFrame, key_col: str, feat_cols: Sequence[str], label_col: str, alpha: float = 0.2, seed: int = 42) -> DataFrame:
    """Lam ~ Beta(alpha, alpha) per row; features and label become
    lam*x + (1-lam)*x_partner (soft label)."""
    p = pair_partners(df, key_col, list(feat_cols) + [label_col], seed=seed)
    lam = beta_sample(F.col(key_col), "mixup", alpha, seed)
    p = p.withColumn("lam", lam)
    mixed = {c: F.col("lam") * F.col(c) + (F.lit(1.0) - F.col("lam")) * F.col(f"{c}_partner") for c in list(feat_cols) + [label_col]}
    return p.withColumns(mixed).drop(*[f"{c}_partner" for c in list(feat_cols) + [label_col]])


def array_mix(df: DataFrame, key_col: str, col: str, weight: float = 0.5, seed: int = 42) -> DataFrame:
    """a*x + (1-a)*x_partner element-wise."""
    p = pair_partners(df, key_col, [col], seed=seed)
    return p.withColumn(
        col, F.zip_with(F.col(col), F.col(f"{col}_partner"), lambda x, y: F.lit(weight) * x.cast("double") + F.lit(1.0 - weight) * y.cast("double"))
    ).drop(f"{col}_partner")


def same_label_concat(df: DataFrame, key_col: str, col: str, label_col: str, n: int, seed: int = 42) -> DataFrame:
    """Append at most n elements of a same-label partner's sequence."""
    p = pair_partners(df, key_col, [col], by=[label_col], seed=seed)
    empty = F.array().cast(df.schema[col].dataType)
    joined = F.concat(F.coalesce(F.col(col), empty), F.coalesce(F.slice(F.col(f"{col}_partner"), 1, n), empty))
    return p.withColumn(col, joined).drop(f"{col}_partner")


def augment_train_only(df_split: DataFrame, augment, split_col: str = "split") -> DataFrame:
    """Augment the training rows only; val/test pass through unchanged."""
    train = df_split.where(F.col(split_col) == "train")
    rest = df_split.where(F.col(split_col) != "train")
    aug = augment(train)
    for c in aug.columns:
        if c not in rest.columns:
            rest = rest.withColumn(c, F.lit(0))
    return aug.unionByName(rest.select(*aug.columns).withColumns({c: F.col(c).cast(aug.schema[c].dataType) for c in aug.columns}))
