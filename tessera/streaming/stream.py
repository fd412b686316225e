"""Streaming variants of the batch operators: a Parquet file stream through a
map-only transform (for example the encode projection A10-A13), and running
counts by category. Both write Parquet under the shared checkpoint folder
and keep their progress there, so a restarted query resumes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import encode
from tessera.operators.ranking import Tracker
from tessera.sources.sinks import scratch_path


def parquet_stream(spark: SparkSession, directory: str, glob: str, schema, max_files: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
        .parquet(directory)
    )


#: Bytes of files of a table's micro-batch (one file at least).
BATCH_BYTES = 256 << 20


def table_stream(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """The files of ``<directory>/<table>.parquet`` as a stream, be it one file
    or a folder of files. The braces make it a pattern: a file source takes a
    plain path for that of a folder."""
    schema = spark.read.parquet(f"{directory}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{directory.rstrip('/')}/{{{table}}}.parquet")


def category_counts_stream(spark: SparkSession, directory: str, table: str, key: str) -> DataFrame:
    """Run a file stream over ``<directory>/<table>.parquet`` to completion
    (availableNow) with a running count per ``key``. Each micro-batch writes
    the counts that changed as Parquet; the result is the last of each key."""
    s = table_stream(spark, directory, table)
    out = scratch_path(spark, f"stream-counts-{table}")

    def write(batch: DataFrame, epoch: int):
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (
        s.groupBy(key).agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{out}/epoch=*").groupBy(key).agg(F.max_by("n", "epoch").alias("n"))


def encode_stream_to(spark: SparkSession, source: DataFrame, encode, path: str):
    """foreachBatch sink: encode each micro-batch and append it as Parquet."""
    def write(batch: DataFrame, epoch: int):
        encode(batch).write.mode("append").parquet(path)

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, "encode-ckpt"))
        .trigger(availableNow=True).start()
    )


def stream_transform_to_parquet(spark: SparkSession, directory: str, table: str, transform) -> DataFrame:
    """File stream over ``<directory>/<table>.parquet`` -> ``transform`` per
    micro-batch (map-only) -> Parquet under the shared checkpoint folder, run
    to completion (availableNow); returns the written table."""
    out = scratch_path(spark, f"stream-{table}")
    q = encode_stream_to(spark, table_stream(spark, directory, table), transform, out)
    q.awaitTermination()
    return spark.read.parquet(out)


_RUN = "best double, best_step long, counter long, stop_step long, last long, kept array<struct<value:double,step:long>>"


def track_runs(source: DataFrame, group: str, step: str, value: str, patience: int = 10, min_delta: float = 1e-4, mode: str = "max", top_k: int = 3) -> DataFrame:
    """W8 and W3 online: a stream of (run, step, value) as one state a run, the
    early-stopping tracker's four values and the ``top_k`` best steps (a later
    step does not displace an equal one). Each micro-batch gives the runs that
    went on, as they stand: best, where the run stops (null while it goes on),
    kept values and steps, best first.

    Steps of a run come in order from batch to batch; inside a batch they are
    sorted. A step at or before the last one seen (a repeat) is passed over.
    """
    types = dict(source.dtypes)
    out = f"{group} {types[group]}, best_value double, best_step long, stop_step long, kept_values array<double>, kept_steps array<long>, last_step long"
    sign = 1.0 if mode == "max" else -1.0

    def go_on(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("s", kind="stable")  # one run's steps of one micro-batch
        none = lambda v: None if v is None or v != v else v
        best, best_step, counter, stop, last, kept = state.get if state.exists else (None, None, 0, None, None, [])
        tracker = Tracker(patience, min_delta, mode, (none(best), none(best_step), counter, none(stop)))
        last = none(last)
        top = [(k["value"], k["step"]) for k in kept]
        for s, v in zip(rows["s"], rows["v"]):
            if last is not None and s <= last:
                continue
            last = int(s)
            tracker.see(last, v)
            if v == v and v is not None:
                top = sorted([*top, (float(v), last)], key=lambda x: (-sign * x[0], x[1]))[:top_k]
        state.update((tracker.best, tracker.best_step, tracker.counter, tracker.stop_step, last, [{"value": v, "step": s} for v, s in top]))
        yield pd.DataFrame([(key[0], tracker.best, tracker.best_step, tracker.stop_step, [v for v, _ in top], [s for _, s in top], last)], columns=[group, "best_value", "best_step", "stop_step", "kept_values", "kept_steps", "last_step"]).astype({"best_step": "Int64", "stop_step": "Int64", "last_step": "Int64"})

    src = source.select(group, F.col(step).cast("long").alias("s"), F.col(value).cast("double").alias("v"))
    return src.groupBy(group).applyInPandasWithState(go_on, out, _RUN, "update", GroupStateTimeout.NoTimeout)


def track_run_files(spark: SparkSession, directory: str, group: str, step: str, value: str, **settings) -> DataFrame:
    """``track_runs`` over the Parquet files of a folder, a file a micro-batch in
    the order of their times, run to completion; the last state of every run."""
    schema = spark.read.parquet(directory).schema
    out = scratch_path(spark, "runs")

    def write(batch: DataFrame, epoch: int):
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    tracked = track_runs(parquet_stream(spark, directory, "*.parquet", schema), group, step, value, **settings)
    q = tracked.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch_path(spark, "runs-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/epoch=*")
    others = [c for c in got.columns if c not in (group, "epoch")]
    return got.groupBy(group).agg(F.max_by(F.struct(*others), "epoch").alias("r")).select(group, "r.*")


def encode_stream(spark: SparkSession, directory: str, schema: Mapping, max_lens: Mapping[str, int], score: Callable[[DataFrame], DataFrame] | None = None, is_training: bool = False, max_files: int = 1) -> tuple[DataFrame, DataFrame]:
    """Wide rows as a stream of Parquet files: each micro-batch is encoded
    (A10-A13), scored by ``score`` if given, and written; its out-of-vocabulary
    counts (G15) are written beside it. Run to completion; the written rows and
    the counts accumulated over all micro-batches. A micro-batch takes
    ``max_files`` files; its tasks are theirs, so many small files spread it.

    A micro-batch that is run again after a failure writes to the same place, so
    rows and counts are those of every file once."""
    out, counts = scratch_path(spark, "encoded"), scratch_path(spark, "oob")

    def write(batch: DataFrame, epoch: int) -> None:
        encoded = encode.encode_batch(batch, schema, max_lens, is_training=is_training)
        (score(encoded) if score else encoded).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        encode.oob_stats(batch, schema, max_lens).write.mode("overwrite").parquet(f"{counts}/epoch={epoch}")

    source = parquet_stream(spark, directory, "*.parquet", spark.read.parquet(directory).schema, max_files)
    q = source.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "encode-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/epoch=*"), merge_oob(spark.read.parquet(f"{counts}/epoch=*"))


def merge_oob(parts: DataFrame) -> DataFrame:
    """G15 over batches: counts add up, extremes are those of all batches."""
    merged = parts.groupBy("grp", "column", "vocab").agg(F.sum("oob_count").alias("oob_count"), F.min("min_oob").alias("min_oob"), F.max("max_oob").alias("max_oob"))
    return merged.withColumn("direction", F.when(F.col("min_oob") >= F.col("vocab"), "TOO_HIGH").otherwise("TOO_LOW"))
