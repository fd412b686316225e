"""The most frequent values of a column without counting all of them.

Every task keeps at most ``tracked`` counters (Misra and Gries): when there are
more values, all counters fall by the size of the largest that must go, and what
fell is the task's error. Summed over the tasks, a value without a counter
has at most the sum of the errors. The tracked values are then counted exactly.
If the n-th of them has more than that sum, no other value can be among the first
n and the answer is proven; else all values are counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import broadcast_if_small, materialize


def summary(df: DataFrame, col: str, tracked: int) -> DataFrame:
    """value and low (a lower bound of its count), at most ``tracked`` rows a task, and
    a row without value whose low is the task's error."""
    src = df.select(F.col(col).alias("value")).where("value is not null")
    of = src.schema["value"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        error, kind = 0, None
        for b in batches:
            kind = b.schema.field(0).type
            counted = b.column(0).value_counts()
            new = pa.table({"value": counted.field("values"), "low": counted.field("counts").cast(pa.int64())})
            held = new if held is None else pa.concat_tables([held, new]).group_by("value").aggregate([("low", "sum")]).rename_columns(["value", "low"])
            if held.num_rows > tracked:
                low = held["low"].to_numpy()
                fall = int(np.partition(low, len(low) - tracked - 1)[len(low) - tracked - 1])
                error += fall
                held = held.set_column(1, "low", pc.subtract(held["low"], fall)).filter(pa.array(low > fall))
        if held is not None:
            yield from held.to_batches()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([error], pa.int64())], ["value", "low"])

    return src.mapInArrow(run, f"value {of}, low long")


def most_frequent(df: DataFrame, col: str, n: int, tracked: int = 10_000) -> tuple[DataFrame, bool]:
    """The ``n`` most frequent values (value, n; ties by value) and
    whether the summary sufficed. Nulls do not count."""
    got = materialize(summary(df, col, tracked).groupBy("value").agg(F.sum("low").alias("low")))
    error = got.where("value is null").agg(F.max("low")).first()[0] or 0
    # at least 4 n candidates, the best by their lower bounds; any value left out
    # has at most the error more than the lower bound of the last of them
    candidates = materialize(got.where("value is not null").orderBy(F.col("low").desc(), "value").limit(max(4 * n, 1000)).select("value", "low"))
    total, kept = got.where("value is not null").count(), candidates.count()
    others = error + ((candidates.agg(F.min("low")).first()[0] or 0) if kept < total else 0)
    values = df.select(F.col(col).alias("value"))
    few = broadcast_if_small(candidates.select("value"), kept, 256)
    exact = values.join(few, "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    top = materialize(exact.orderBy(F.col("n").desc(), "value").limit(n))
    last = top.agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).first()
    if others == 0 or last["k"] == n and last["least"] > others:
        return top.withColumnRenamed("value", col), True
    every = values.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return every.orderBy(F.col("n").desc(), "value").limit(n).withColumnRenamed("value", col), False
