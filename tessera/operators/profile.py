"""Profiling aggregates.

Wide tables are profiled with as few jobs as possible: one ``agg`` per
question (partial aggregation leaves one row per task), then the single
wide row is unpivoted with ``inline``. Per-key counts are two-level
``groupBy`` (partial aggregation absorbs hot keys). Quantiles are exact
and distributed (``exact_quantiles``), never a per-group value buffer.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.ordering import bracket_of, bracketed_quantiles, exact_quantiles
from tessera.session import materialize


def _missing(c: str, dtype: str) -> Column:
    x = F.col(c)
    if dtype in ("double", "float"):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def basic_info(df: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """G1: rows, columns, distinct users and items (one aggregate)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(len(df.columns)).cast("bigint").alias("n_features"),
        F.countDistinct(user_col).alias("n_users"),
        F.countDistinct(item_col).alias("n_items"),
    )


def _unpivot_one_row(wide: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(n).alias("column"), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names
    ]
    return wide.select(F.inline(F.array(*entries)))


def missing_values(df: DataFrame) -> DataFrame:
    """G13 (and G1 missing part): null (or NaN) count per column."""
    types = dict(df.dtypes)
    wide = df.agg(*[F.count_if(_missing(c, types[c])).alias(f"{c}__n_missing") for c in df.columns])
    return _unpivot_one_row(wide, df.columns, ["n_missing"]).withColumn("n_missing", F.col("n_missing").cast("bigint"))


def missing_summary(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Number of columns with missing values and missing ids in the id block."""
    m = missing_values(df)
    return m.agg(
        F.count_if(F.col("n_missing") > 0).cast("bigint").alias("n_cols_with_missing"),
        F.sum(F.when(F.col("column").isin(*id_cols), F.col("n_missing")).otherwise(0)).cast("bigint").alias("id_missing"),
    )


QUARTILES = [0.25, 0.5, 0.75]


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact 25/50/75% (linear), max per column.
    One aggregate gives the moments and brackets the quartiles, a second pass
    reads the quartiles off the few values inside the brackets."""
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        known = F.when(~F.isnan(v), v)
        aggs += [
            F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"), F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"), F.count(known).alias(f"{c}__known"), bracket_of(known, QUARTILES).alias(f"{c}__bracket"),
        ]
    wide = materialize(df.agg(*aggs))
    stats = _unpivot_one_row(wide, cols, ["count", "mean", "std", "min", "max"])
    row = wide.first()
    q = bracketed_quantiles(df, {c: F.col(c) for c in cols}, {c: row[f"{c}__bracket"] for c in cols}, {c: row[f"{c}__known"] for c in cols}, QUARTILES)
    qw = q.groupBy(F.col("key").alias("column")).pivot("q", QUARTILES).agg(F.first("value"))
    qw = qw.select("column", F.col("`0.25`").alias("p25"), F.col("`0.5`").alias("p50"), F.col("`0.75`").alias("p75"))
    return stats.join(qw, "column", "left")


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (exact, or HyperLogLog++).
    Exact: narrow (column, value) rows, numbers as numbers, through one distinct
    and one count, so a row is not copied whole for every column."""
    if approx:
        return _unpivot_one_row(df.agg(*[F.approx_count_distinct(c).alias(f"{c}__n_distinct") for c in cols]), cols, ["n_distinct"])
    types = dict(df.dtypes)

    def slots(i: int, c: str) -> Column:
        whole, real = types[c] in ("bigint", "int", "smallint", "tinyint"), types[c] in ("double", "float")
        none = F.lit(None)
        # adding zero makes -0.0 and 0.0 one value
        return F.struct(
            F.lit(i).alias("i"), (F.col(c) if whole else none).cast("long").alias("l"), (F.col(c) + F.lit(0.0) if real else none).cast("double").alias("d"),
            (none if whole or real else F.col(c)).cast("string").alias("s"),
        )

    long = df.select(F.explode(F.array(*[slots(i, c) for i, c in enumerate(cols)])).alias("e")).select("e.*")
    values = long.where("l is not null or d is not null or s is not null").distinct()
    wide = values.agg(*[F.count_if(F.col("i") == i).alias(f"{c}__n_distinct") for i, c in enumerate(cols)])
    return _unpivot_one_row(wide, cols, ["n_distinct"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value (nulls excluded) and share of non-null rows."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # the total is a one-row aggregate attached by broadcast: no global window
    # over a possibly high-cardinality count table
    total = g.agg(F.sum("n").alias("_total"))
    return g.crossJoin(F.broadcast(total)).select(col, "n", (F.col("n") / F.col("_total")).alias("share"))


def time_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min and max of time columns."""
    return df.agg(*[a for c in cols for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram; last bin closed on the right; a constant
    column is widened by +-0.5 like numpy. The range row is tiny and
    broadcast to the scan."""
    rng = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).select(
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(rng))
        .groupBy(b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))
        .select("bin", "n", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("edge_lo"))
    )


def array_length_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per array column: min, max, mean, median of lengths (null = 0)."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), A.length(c).alias("len")) for c in cols])).alias("e")
    ).select("e.*")
    # one pass over the table: (column, length) counts, pinned; everything
    # else (min / max / mean / exact median) reads that small table
    vc = materialize(long.groupBy("column", "len").agg(F.count(F.lit(1)).alias("k")))
    stats = vc.groupBy("column").agg(
        F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        (F.sum(F.col("len") * F.col("k")) / F.sum("k")).alias("mean_len"),
    )
    med = exact_quantiles(vc, "column", "len", [0.5], count_col="k").select("column", F.col("value").alias("median_len"))
    return stats.join(med, "column")


def dense_profile(df: DataFrame, col: str) -> DataFrame:
    """Over all elements of a dense vector column: count, mean, population
    std, min, max (null elements do not count) and mean vector length (null
    vectors: 0). Elements are exploded where they are read and go through
    Spark's merged moments, which keep their digits when the mean is large."""
    v = F.col("v").cast("double")
    g = df.select(F.explode(col).alias("v")).agg(
        F.count("v").alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    length = df.agg(F.avg(F.coalesce(F.when(F.col(col).isNotNull(), F.size(col)), F.lit(0))).alias("mean_len"))
    return g.crossJoin(F.broadcast(length))


def interaction_summary(df: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """Per-user and per-item interaction counts: min / max / mean, and
    rows per user / item."""
    out = None
    for key in (user_col, item_col):
        per = df.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
        s = per.agg(
            F.lit(key).alias("key"), F.count(F.lit(1)).alias("n_keys"), F.sum("k").alias("n_rows"),
            F.min("k").alias("min_per_key"), F.max("k").alias("max_per_key"), F.avg("k").alias("mean_per_key"),
        )
        out = s if out is None else out.unionByName(s)
    return out


def per_key_histogram(df: DataFrame, key: str, bins: int = 20) -> DataFrame:
    """Histogram of interactions per key."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    return histogram(per, "k", bins)


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each group of identical values (null and
    NaN compare equal); partial aggregation keeps a hot duplicate cheap."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("k"))
    return g.agg(F.sum(F.col("k") - 1).cast("bigint").alias("n_duplicates"))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class and neg/pos ratio."""
    g = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    allw = Window.partitionBy()
    return g.select(
        label_col, "n_c",
        (F.sum("n_c").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("n_c"))).alias("weight"),
        (F.sum(F.when(F.col(label_col) == 0, F.col("n_c"))).over(allw) /
         F.sum(F.when(F.col(label_col) == 1, F.col("n_c"))).over(allw)).alias("scale_pos_weight"),
    )


def feature_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample std per column; columns with std 0 / NaN / null are marked
    as skipped (no noise is added to them)."""
    wide = df.agg(*[F.stddev_samp(c).alias(f"{c}__std") for c in cols])
    s = _unpivot_one_row(wide, cols, ["std"])
    return s.withColumn("skip", F.col("std").isNull() | F.isnan("std") | (F.col("std") == 0))


def grouped_mean_std(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and population std per group."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
