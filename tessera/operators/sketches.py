"""Profile state that merges: distinct counts over a growing folder.

Each file's columns become one row of HyperLogLog sketches beside its row count.
The rows are a table; a refresh reads only files that it does not hold yet, and a
report unions the sketches. Files are told apart by path, length and time of
change, so a file that was written anew is sketched anew and its old row left
out. The relative standard error of a sketch is 1.04 / sqrt(2^lg_k), 0.8 % for
lg_k = 14 (16 KB a sketch at most).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 14


def relative_error(lg_k: int = LG_K) -> float:
    """One standard error of an estimate, relative to it."""
    return 1.04 / 2 ** (lg_k / 2)


def _text(c: str, dtype: str) -> Column:
    # adding zero makes -0.0 and 0.0 one value
    return (F.col(c) + F.lit(0.0) if dtype in ("double", "float") else F.col(c)).cast("string")


def _version() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed")]


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """The folder's files as they are now, from the listing (no content is read)."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def sketch(data: DataFrame, cols: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """file, size, changed, rows and a sketch of each column's non-null values,
    one row a file; map-side sums of one small state a file."""
    types = dict(data.dtypes)
    rows = data.select(*_version(), *[_text(c, types[c]).alias(c) for c in cols])
    return rows.groupBy("file", "size", "changed").agg(F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(c, lg_k).alias(c) for c in cols])


def refresh(spark: SparkSession, state: str, path: str, cols: Sequence[str], lg_k: int = LG_K) -> int:
    """Appends the sketches of the folder's files that the table at ``state``
    does not hold yet; how many files were read."""
    now = files_of(spark, path)
    try:
        held = spark.read.parquet(state)
    except AnalysisException:  # no table yet
        held = None
    new = now if held is None else now.join(held.select("file", "size", "changed"), ["file", "size", "changed"], "left_anti")
    names = [r["file"] for r in new.select("file").collect()]  # one path a new file
    if names:
        sketch(spark.read.parquet(*names), cols, lg_k).write.mode("append").parquet(state)
    return len(names)


def report(spark: SparkSession, state: str, path: str, cols: Sequence[str]) -> DataFrame:
    """column, n_distinct (estimated), rows, files of what the folder holds now."""
    held = spark.read.parquet(state).join(files_of(spark, path), ["file", "size", "changed"], "left_semi").dropDuplicates(["file", "size", "changed"])
    one = held.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct"), "rows", "files") for c in cols])))
