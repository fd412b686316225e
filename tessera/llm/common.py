"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize

#: A derived table is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 16 << 20

#: Whole texts travel to Python in Arrow batches of about so many bytes.
BATCH_BYTES = 2 << 20

#: The white space of the operators' contracts: `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, everything else as it is (``lower`` folds all of Unicode)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``fn`` turns one Arrow batch into a dict of columns, batch by batch."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(fn(b), schema=target)

    return df.mapInArrow(lean(run), schema)


def give_back() -> None:
    """Freed memory goes back to the system: Spark reuses a Python worker, and
    what its allocators hold on to would add up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES at most in this session: for every task
    the JVM holds a batch outside its heap, as column buffers and once more as
    the bytes to send. Changes no result; a limit that the session sets stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


Batches = Iterable[pa.RecordBatch]


def lean(run: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a partition, then ``give_back``."""

    def run_lean(batches: Batches) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return run_lean


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


arrow_schema = _arrow_schema


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    return materialize(df)


def small_or_not(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast hint for a pinned table whose counted rows times ``row_bytes``
    (an upper bound of a row in a hash table, with its copy of the key) stay
    under BROADCAST_BYTES; else no hint."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def settle_rows(docs: DataFrame, marks: DataFrame, keys: dict[str, Column], row_bytes: int) -> DataFrame:
    """Rows of ``docs`` after the decisions in ``marks``.

    ``keys`` names expressions over docs that also are columns of ``marks``
    (one row per key, compared null-safely) beside its boolean ``once``: rows
    whose key is marked go; where ``once`` is true one row of the key stays.
    Unmarked rows stay untouched, with all their columns.
    """
    marks = pinned(marks)
    m = small_or_not(marks, row_bytes)
    tmp = {f"__k_{k}": v for k, v in keys.items()}
    left = docs.withColumns(tmp)
    m = m.select(F.col("once").alias("__once"), *[F.col(k).alias(f"__m_{k}") for k in keys])
    cond = None
    for k in keys:
        c = left[f"__k_{k}"].eqNullSafe(m[f"__m_{k}"])
        cond = c if cond is None else cond & c
    names = [docs[c] for c in docs.columns]
    joined = left.join(m, cond, "left")
    out = joined.where("__once is null").select(*names)
    if marks.where("once").limit(1).count():
        again = joined.where("__once").dropDuplicates(list(tmp)).select(*[F.col(f"`{c}`") for c in docs.columns])
        out = out.unionByName(again)
    return out
