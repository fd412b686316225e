"""Parquet scans."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import broadcast_if_small, materialize

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, lazily (Catalyst prunes columns / pushes filters)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_parquet_dir(spark: SparkSession, path: str) -> DataFrame:
    """The ``*.parquet`` files of a directory, or a single file. Keeps the
    file's name and path and the row index in it, so that the order by file
    name, then row, survives the distributed scan. Raises FileNotFoundError
    when no file matches."""
    try:
        df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no *.parquet file in {path}") from e
    name = F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0)
    return df.select("*", name.alias("_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))


def blocks(df_with_meta: DataFrame, block_rows: int) -> DataFrame:
    """S3: block listing (file, block index within file, rows). A block is a
    run of ``block_rows`` consecutive rows of one file — the row-group
    stand-in Spark exposes. Aggregation is partial per task, so it scales
    with the file count, not the row count."""
    return (
        df_with_meta.groupBy("_file", F.floor(F.col("_row") / block_rows).alias("block_in_file"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def block_table(df_with_meta: DataFrame, block_rows: int) -> DataFrame:
    """S3: one row per block with its dense ordinal in (file name, block)
    order, numbered by a distributed range sort; pinned."""
    from tessera.operators.ordering import global_row_number

    blk = blocks(df_with_meta, block_rows).select("_file", "block_in_file")
    return materialize(global_row_number(blk, ["_file", "block_in_file"], "block").withColumn("block", F.col("block") - 1))


def with_block_ordinal(df_with_meta: DataFrame, block_rows: int, table: DataFrame | None = None) -> DataFrame:
    """Rows with ``block``, the ordinal of their block (``table``, by default
    made here), and ``_pos``, their position in it."""
    table = block_table(df_with_meta, block_rows) if table is None else table
    out = df_with_meta.withColumn("block_in_file", F.floor(F.col("_row") / block_rows)).withColumn("_pos", F.pmod("_row", F.lit(block_rows)))
    return out.join(broadcast_if_small(table, table.count(), 256), ["_file", "block_in_file"])


def select_family(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Projection by column-family prefix (plus explicitly kept columns)."""
    pat = re.compile("^(" + "|".join(re.escape(p) for p in prefixes) + ")")
    cols = [c for c in df.columns if c in keep or pat.match(c)]
    return df.select(*cols)
