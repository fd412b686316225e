"""Distributed total-order primitives.

Global ``row_number()`` / running sums without a partition key move every
row into one task. These helpers keep the work spread out: a range-
partitioned sort (sampled bounds, so a hot key range is split), a
per-partition pass, and a tiny table of per-partition totals turned into
offsets and broadcast back (its size is the partition count).
"""

from __future__ import annotations

from typing import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import broadcast_if_small, materialize

_POS_BITS = 33  # monotonically_increasing_id = partition_index << 33 | position


def _offsets(totals: DataFrame, part_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over the (small, one row per partition) totals."""
    w = Window.orderBy(part_col).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        part_col, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_off_{c}") for c in value_cols]
    )


def global_row_number(df: DataFrame, order_cols: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """1-based row number over a total order, computed without a single-task
    window. ``order_cols`` must be a unique key (ties are ordered arbitrarily)."""
    s = df.orderBy(*order_cols).withColumn("__mid", F.monotonically_increasing_id())
    s = materialize(s.withColumn("__part", F.shiftright("__mid", _POS_BITS)))
    totals = s.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offs = _offsets(totals, "__part", ["__n"])
    pos = F.col("__mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    return (
        s.join(F.broadcast(offs), "__part")
        .withColumn(name, (F.col("_off___n") + pos + 1).cast("bigint"))
        .drop("__mid", "__part", "_off___n")
    )


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return (a == b) | (a.isna() & b.isna())


def _segment_sums(group: str | None, value_cols: Sequence[str]):
    """Running sums that start again with each group, over the sorted batches
    of one partition; ``_seg`` numbers the groups of the partition from 0."""

    def run(batches: Iterable[pd.DataFrame]):
        last, seg, pos = None, 0, 0
        carry = {c: 0 for c in value_cols}
        for pdf in batches:
            if not len(pdf):
                continue
            if group is None:
                segs = pd.Series(0, index=pdf.index)
            else:
                g = pdf[group]
                new = ~_same(g, g.shift())
                new.iloc[0] = last is not None and not _same(last, g.iloc[:1].reset_index(drop=True)).iloc[0]
                segs = new.cumsum() + seg
                last = g.iloc[-1:].reset_index(drop=True)
            for c in value_cols:
                run_sum = pdf.groupby(segs, sort=False)[c].cumsum()
                pdf[f"_cum_{c}"] = run_sum + (segs == seg) * carry[c]
                carry[c] = pdf[f"_cum_{c}"].iloc[-1]
            seg = int(segs.iloc[-1])
            pdf["_seg"] = segs.astype("int64")
            pdf["_pos"] = range(pos, pos + len(pdf))
            pos += len(pdf)
            yield pdf

    return run


def grouped_prefix_sums(
    df: DataFrame, group_col: str | None, order_cols, value_cols: Sequence[str], descending: bool = False
) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of ``value_cols`` along ``order_cols``
    inside each group (null is a group; ``(group, order)`` must be unique, so
    pre-aggregate ties first; without ``group_col`` the table is one group).

    Range-partitioned sort over (group, order) with sampled bounds, so a hot
    group is split -> running sums per partition over Arrow batches -> one row
    of totals per partition gives the offset of a partition's first group if it
    goes on from the partition before -> offsets broadcast back. One path for
    every size; no window over the data or over the groups."""
    if isinstance(order_cols, (str, Column)):
        order_cols = [order_cols]
    keys = [(F.col(c).desc() if descending else F.col(c).asc()) if isinstance(c, str) else c for c in order_cols]
    if group_col is not None:
        keys = [F.col(group_col).asc(), *keys]
    s = df.orderBy(*keys).withColumn("_p", F.spark_partition_id())
    out_schema = T.StructType(
        list(s.schema.fields)
        + [T.StructField(f"_cum_{c}", s.schema[c].dataType, True) for c in value_cols]
        + [T.StructField("_seg", T.LongType()), T.StructField("_pos", T.LongType())]
    )
    s = materialize(s.mapInPandas(_segment_sums(group_col, value_cols), schema=out_schema))
    at_end = lambda c: F.max_by(c, "_pos")
    group = F.col(group_col) if group_col is not None else F.lit(0)
    totals = s.groupBy("_p").agg(
        F.min_by(F.struct(group.alias("g")), "_pos").alias("first"), F.max_by(F.struct(group.alias("g")), "_pos").alias("last"),
        F.max("_seg").alias("segs"), *[at_end(f"_cum_{c}").alias(c) for c in value_cols],
    )
    # one row a partition, in order: what is carried into its first group
    offsets, before, carried = [], None, {c: 0 for c in value_cols}
    for r in sorted(totals.collect(), key=lambda r: r["_p"]):
        same = _continues(before, r["first"]["g"])
        into = {c: carried[c] if same else 0 for c in value_cols}
        offsets.append((r["_p"], *[into[c] for c in value_cols]))
        carried = {c: r[c] + (into[c] if r["segs"] == 0 else 0) for c in value_cols}
        before = (r["last"]["g"],)
    off_schema = T.StructType([T.StructField("_p", T.IntegerType())] + [T.StructField(f"_off_{c}", s.schema[c].dataType) for c in value_cols])
    offs = df.sparkSession.createDataFrame(offsets, off_schema)
    out = s.join(F.broadcast(offs), "_p")
    for c in value_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_cum_{c}") + F.when(F.col("_seg") == 0, F.col(f"_off_{c}")).otherwise(0)).drop(f"_cum_{c}", f"_off_{c}")
    return out.drop("_p", "_seg", "_pos")


def _continues(before: tuple | None, group) -> bool:
    """Whether ``group`` is that of the row before: null equals null, NaN equals NaN."""
    if before is None:
        return False
    was = before[0]
    return was is group or was == group or (was != was and group != group)


def prefix_sums(df: DataFrame, order_cols, value_cols: Sequence[str], descending: bool = False) -> DataFrame:
    """Running sums of the whole table as one group."""
    return grouped_prefix_sums(df, None, order_cols, value_cols, descending)


#: Tables of at most so many rows are summed up by a window.
FEW_ROWS = 1 << 16


def running_sums(df: DataFrame, group_col: str, order_col: str, value_col: str) -> DataFrame:
    """``grouped_prefix_sums`` of one column; a table that is counted to have at
    most FEW_ROWS rows takes a window a group, which needs fewer jobs."""
    df = materialize(df)
    if df.count() > FEW_ROWS:
        return grouped_prefix_sums(df, group_col, order_col, [value_col])
    w = Window.partitionBy(group_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"cum_{value_col}", F.sum(value_col).over(w))


def exact_quantiles(
    long_df: DataFrame, key_col: str, value_col: str, qs: Sequence[float], count_col: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value_col`` per ``key_col``
    (pandas ``describe`` / DuckDB ``quantile_cont``), without holding any
    group's values in one task:

    1. value counts per (key, value) — partial aggregation;
    2. running counts per key along the values by ``grouped_prefix_sums``;
    3. the ranks floor(h), ceil(h) with h = (n-1)q of every quantile are both
       located in one pass: a value covers ranks [before, upto) of its key, and
       only values that cover a wanted rank leave it.
    Output: key, q, value (double). Null values are ignored; a null key is a key.
    """
    ok = F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double"))
    n = F.count(F.lit(1)) if count_col is None else F.sum(count_col)
    vc = long_df.where(ok).groupBy(key_col, F.col(value_col).cast("double").alias("_v")).agg(n.alias("_c"))
    cum = running_sums(vc, key_col, "_v", "_c")
    sizes = materialize(cum.groupBy(F.col(key_col).alias("_k")).agg(F.max("cum__c").alias("_n")))
    c = cum.join(broadcast_if_small(sizes, sizes.count(), 128), F.col(key_col).eqNullSafe(F.col("_k"))).drop("_k")
    rank = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    wanted = F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.floor(rank(q)).cast("bigint").alias("lo"), F.ceil(rank(q)).cast("bigint").alias("hi"), (rank(q) - F.floor(rank(q))).alias("frac"))
        for q in qs
    ])
    covers = lambda r: (F.col("cum__c") - F.col("_c") <= r) & (r < F.col("cum__c"))
    hits = c.select(key_col, "_v", "_c", "cum__c", F.explode(F.filter(wanted, lambda w: covers(w["lo"]) | covers(w["hi"]))).alias("w"))
    at = hits.groupBy(key_col, F.col("w.q").alias("q")).agg(
        F.max(F.when(covers(F.col("w.lo")), F.col("_v"))).alias("_vlo"), F.max(F.when(covers(F.col("w.hi")), F.col("_v"))).alias("_vhi"), F.first("w.frac").alias("_frac")
    )
    return at.select(key_col, "q", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("value"))


#: Ranks of the sketches that bracket a quantile are off by at most 1 / ACCURACY.
ACCURACY = 10_000


def bracket_of(value: Column, qs: Sequence[float]) -> Column:
    """An aggregate: mergeable quantile sketches' values a little below and above
    every quantile (an array of two a quantile; a group's state is bounded)."""
    ps = [min(1.0, max(0.0, q + side * 2 / ACCURACY)) for q in qs for side in (-1, 1)]
    return F.percentile_approx(value, ps, ACCURACY)


def bracketed_quantiles(df: DataFrame, values: dict[str, Column], brackets: dict[str, list[float] | None], sizes: dict[str, int], qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of several columns without a sort
    of their values: ``brackets`` (``bracket_of``) and ``sizes`` (values that are
    neither null nor NaN) come from an aggregate over the same rows.

    One pass counts what lies below a bracket and keeps the values inside: about
    4 / ACCURACY of the rows a quantile, collapsed to value counts. Running sums
    over those alone find the two ranks around the quantile. Brackets are
    checked; if a sketch was off, that column's values are all ranked.
    Output: key, q, value (double).
    """
    picks, wanted = [], []
    for i, (name, v) in enumerate(values.items()):
        v = v.cast("double")
        known = v.isNotNull() & ~F.isnan(v)
        for j, q in enumerate(qs):
            if not sizes[name] or brackets[name] is None:
                continue
            a, z = (F.lit(float(x)) for x in brackets[name][2 * j : 2 * j + 2])
            slot = F.lit(i * len(qs) + j)
            picks.append(F.when(known & (v < a), F.struct(slot.alias("slot"), F.lit(None).cast("double").alias("v"))).when(known & (v <= z), F.struct(slot.alias("slot"), v.alias("v"))))
            h = (sizes[name] - 1) * float(q)
            wanted.append((i * len(qs) + j, name, float(q), int(h), -int(-h // 1), h - int(h)))
    spark = df.sparkSession
    out = spark.createDataFrame([], "key string, q double, value double")
    if not picks:
        return out
    kept = df.select(F.explode(F.array_compact(F.array(*picks))).alias("e")).groupBy("e.slot", "e.v").agg(F.count(F.lit(1)).alias("c"))
    kept = materialize(kept)
    w = spark.createDataFrame(wanted, "slot int, key string, q double, lo long, hi long, frac double")
    below = kept.where("v is null").select("slot", F.col("c").alias("below"))
    # one row a column and quantile
    w = w.join(F.broadcast(below), "slot", "left").fillna(0, ["below"])
    cum = running_sums(kept.where("v is not null"), "slot", "v", "c").join(F.broadcast(w), "slot")
    end = F.col("below") + F.col("cum_c")
    covers = lambda r: (end - F.col("c") <= F.col(r)) & (F.col(r) < end)
    at = cum.where(covers("lo") | covers("hi")).groupBy("key", "q").agg(
        F.max(F.when(covers("lo"), F.col("v"))).alias("vlo"), F.max(F.when(covers("hi"), F.col("v"))).alias("vhi"), F.first("frac").alias("frac")
    )
    at = materialize(at)
    found = {(r["key"], r["q"]) for r in at.where("vlo is not null and vhi is not null").select("key", "q").collect()}
    off = sorted({name for _, name, q, *_ in wanted if (name, q) not in found})
    out = at.where(~F.col("key").isin(off)).select("key", "q", (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias("value"))
    if off:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), values[n].cast("double").alias("v")) for n in off])).alias("e")).select("e.*")
        out = out.unionByName(exact_quantiles(long, "key", "v", qs))
    return out
