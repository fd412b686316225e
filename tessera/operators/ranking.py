"""Sorts, top-k, best-step and early-stopping scans, dedupe, union."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sort_desc(df: DataFrame, col: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Descending by value (ties by the given keys, ascending)."""
    return df.orderBy(F.col(col).desc(), *[F.col(t).asc() for t in tiebreak])


def head(df: DataFrame, col: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Top n by value — a TakeOrderedAndProject (per-task top-n, then merge)."""
    return sort_desc(df, col, tiebreak).limit(n)


def top_k_per_group(df: DataFrame, group: str, metric: str, step: str, k: int = 3, salt_buckets: int = 64) -> DataFrame:
    """Keep the best k steps per run by metric; an equal metric never
    displaces an earlier step (ties ordered by step).

    Two-stage top-k so a huge run is not sorted in one task: top k inside
    (run, hash(step) % salt_buckets), then top k over the <= salt_buckets*k
    survivors of each run. Exact, because the order (metric desc, step asc)
    is total within a run."""
    order = [F.col(metric).desc(), F.col(step).asc()]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(step)), F.lit(salt_buckets)))
    first = salted.withColumn("_r1", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_r1") <= k)
    w = Window.partitionBy(group).orderBy(*order)
    return first.drop("_salt", "_r1").withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def best_step(df: DataFrame, group: str, metric: str, step: str, mode: str = "max") -> DataFrame:
    """Arg-best step per run, earliest step on ties (a partial aggregate;
    no per-run sort)."""
    if mode == "max":
        pick = F.max_by(F.struct(F.col(step).alias("step"), F.col(metric).alias("value")), F.struct(F.col(metric), -F.col(step)))
    else:
        pick = F.min_by(F.struct(F.col(step).alias("step"), F.col(metric).alias("value")), F.struct(F.col(metric), F.col(step)))
    return df.groupBy(group).agg(pick.alias("b")).select(group, F.col("b.step").alias("best_step"), F.col("b.value").alias("best_value"))


def rank_rows(df: DataFrame, col: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """1..n ranking of a small table (feature importances)."""
    top = head(df, col, n, tiebreak)
    w = Window.orderBy(F.col(col).desc(), *[F.col(t).asc() for t in tiebreak])
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


def dedupe(df: DataFrame, key: str, order: str, keep: str = "last") -> DataFrame:
    """One row per key — the last (or first) by ``order``. A ``max_by`` /
    ``min_by`` partial aggregate, so a hot key is combined map-side instead of
    sorting its rows in one task."""
    others = [c for c in df.columns if c != key]
    payload = F.struct(*[F.col(c) for c in others])
    pick = F.max_by(payload, F.col(order)) if keep == "last" else F.min_by(payload, F.col(order))
    return df.groupBy(key).agg(pick.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def early_stopping(
    df: DataFrame, group: str, step: str, value: str, patience: int = 10, min_delta: float = 1e-4, mode: str = "max"
) -> DataFrame:
    """Replay an early-stopping tracker over each run's metric history:
    best value, its step, and the first step where ``patience``
    non-improving steps in a row were seen (null if never). min_delta = 0 runs
    as windows; a positive min_delta (hysteresis, inherently sequential)
    reads each run once in order."""
    if min_delta == 0:
        return _early_stopping_windows(df, group, step, value, patience, mode)
    return _early_stopping_scan(df, group, step, value, patience, min_delta, mode)


class Tracker:
    """One run's early stopping, step by step: the best value and its step, the
    steps since, and the step that stopped it. Null and NaN never improve."""

    def __init__(self, patience: int, min_delta: float, mode: str, state: tuple | None = None):
        self.patience, self.min_delta, self.sign = patience, min_delta, 1.0 if mode == "max" else -1.0
        self.best, self.best_step, self.counter, self.stop_step = state or (None, None, 0, None)

    def see(self, step: int, value: float) -> None:
        if self.stop_step is not None:
            return
        known = value is not None and value == value
        better = known and (self.best is None or (value > self.best + self.min_delta if self.sign > 0 else value < self.best - self.min_delta))
        if better:
            self.best, self.best_step, self.counter = value, step, 0
            return
        self.counter += 1
        if self.counter >= self.patience:
            self.stop_step = step

    @property
    def state(self) -> tuple:
        return self.best, self.best_step, self.counter, self.stop_step


def _early_stopping_scan(df: DataFrame, group: str, step: str, value: str, patience: int, min_delta: float, mode: str) -> DataFrame:
    """W8 with a margin: each step depends on the one before, so a run is read in
    order, by a sort within partitions (which spills) and one pass that holds
    the tracker's four values; no run is collected."""
    src = df.select(F.col(group).alias("g"), F.col(step).cast("long").alias("s"), F.col(value).cast("double").alias("v"))
    of = df.schema[group].dataType.simpleString()
    names = ["g", "best_value", "best_step", "stop_step"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, tracker, out = None, None, []
        for b in batches:
            out = []
            for g, s, v in zip(*(c.to_pylist() for c in b.columns)):
                if tracker is None or g != run:
                    if tracker is not None:
                        out.append((run, tracker.best, tracker.best_step, tracker.stop_step))
                    run, tracker = g, Tracker(patience, min_delta, mode)
                tracker.see(s, v)
            yield _rows(out, b.schema.field(0).type, names)
        if tracker is not None:
            yield _rows([(run, tracker.best, tracker.best_step, tracker.stop_step)], b.schema.field(0).type, names)

    runs = src.repartition("g").sortWithinPartitions("g", "s").mapInArrow(scan, f"g {of}, best_value double, best_step long, stop_step long")
    return runs.withColumnRenamed("g", group)


def _rows(rows: list[tuple], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key, pa.float64(), pa.int64(), pa.int64()))], names)


def _early_stopping_windows(df: DataFrame, group: str, step: str, value: str, patience: int, mode: str) -> DataFrame:
    """W8 with min_delta = 0 as sort-based windows (no per-run arrays): a
    step improves when it beats every earlier value; the counter is the
    distance to the last improvement; the run stops at the first step whose
    counter reaches ``patience``."""
    w = Window.partitionBy(group).orderBy(step)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    prev = F.max(v).over(before) if mode == "max" else F.min(v).over(before)
    better = (v > prev) if mode == "max" else (v < prev)
    d = df.select(group, step, value, F.row_number().over(w).alias("_rn"), (prev.isNull() | better).alias("_imp"))
    d = d.withColumn("_last", F.max(F.when(F.col("_imp"), F.col("_rn"))).over(upto))
    d = d.withColumn("_stop_rn", F.min(F.when(F.col("_rn") - F.col("_last") >= patience, F.col("_rn"))).over(Window.partitionBy(group)))
    kept = d.where(F.col("_stop_rn").isNull() | (F.col("_rn") <= F.col("_stop_rn")))
    key = F.struct(-v, F.col(step)) if mode == "max" else F.struct(v, F.col(step))
    return kept.groupBy(group).agg(
        F.min_by(F.struct(v.alias("v"), F.col(step).cast("long").alias("s")), key).alias("_b"),
        F.max(F.when(F.col("_rn") == F.col("_stop_rn"), F.col(step).cast("long"))).alias("stop_step"),
    ).select(group, F.col("_b.v").alias("best_value"), F.col("_b.s").alias("best_step"), "stop_step")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Row-wise concat by column name (UNION ALL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
