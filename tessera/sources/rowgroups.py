"""Parquet row groups as Spark partitions.

Spark's Parquet reader does not say which row group a row is in. This source
reads the footers: its listing has a row a row group, in the order of file names
and places, and its reader takes row groups as they are, a partition each, with
columns and simple filters pushed into the read (row groups whose statistics rule
a filter out are not opened). Blocks, tail splits and shards can so follow the
row groups of the files.

Paths are those of Arrow's file systems (local or mounted paths, file:, s3:,
gs:, hdfs:); executors read the footers, a task a file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_LISTING = "file string, row_group int, rows long, bytes long, first_row long"
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


def _files(path: str) -> list[str]:
    """The Parquet files of a folder in name order, or the one file."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    names = sorted(x.base_name for x in found if x.type == fs.FileType.File and x.base_name.endswith(".parquet"))
    if not names:
        raise FileNotFoundError(f"no *.parquet in {path}")
    return [f"{path.rstrip('/')}/{n}" for n in names]


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """file, row_group, rows, bytes, first_row (of the file) from the footers,
    and block, the dense number in file and row-group order."""
    files = _files(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name in b.column(0).to_pylist():
                system, inner = _open(name)
                meta = pq.read_metadata(inner, filesystem=system)
                first = 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    out.append((name, g, group.num_rows, group.total_byte_size, first))
                    first += group.num_rows
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "row_group", "rows", "bytes", "first_row"])

    names = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, at int")
    listed = names.select("file").repartition(max(1, min(len(files), 1000))).mapInArrow(read, _LISTING)
    rank = F.row_number().over(Window.orderBy("file", "row_group"))  # one row a row group: footers, not data
    return listed.withColumn("block", (rank - 1).cast("long"))


#: Most partitions of a read; beyond it neighbouring row groups share one.
MOST_PARTITIONS = 512


class _Groups(InputPartition):
    """Row groups (file, row group, block) that one task reads, in order."""

    def __init__(self, groups: list[tuple[str, int, int]]):
        self.groups = groups


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [n for n in schema.names if n != "_block"]
        self.fields = schema.names
        self.groups = json.loads(options["groups"])
        self.filters: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in _COMPARE and column and len(column) == 1 and column[0] in self.names:
                self.filters.append((column[0], _COMPARE[type(f)], f.value))
            yield f  # Spark applies it to the rows as well

    def partitions(self) -> list[InputPartition]:
        size = max(1, -(-len(self.groups) // MOST_PARTITIONS))
        return [_Groups(self.groups[at : at + size]) for at in range(0, len(self.groups), size)]

    def read(self, partition: _Groups) -> Iterator[pa.RecordBatch]:
        for name, groups in groupby(partition.groups, key=lambda g: g[0]):
            system, inner = _open(name)
            with system.open_input_file(inner) as source:
                file = pq.ParquetFile(source)  # the footer once for all of the file's groups
                for _, group, block in groups:
                    if not self._may_hold(file.metadata.row_group(group)):
                        continue
                    for b in file.iter_batches(row_groups=[group], columns=self.names or [file.schema_arrow.names[0]], batch_size=8192):
                        cols = {n: b.column(n) for n in self.names} | {"_block": pa.array([block] * b.num_rows, pa.int64())}
                        yield pa.RecordBatch.from_arrays([cols[n] for n in self.fields], self.fields)

    def _may_hold(self, group: Any) -> bool:
        """Whether the row group's statistics leave room for every filter."""
        stats = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for column, op, value in self.filters:
            s = stats.get(column)
            if s is None or not s.has_min_max:
                continue
            try:
                if {"=": s.min > value or s.max < value, ">": s.max <= value, ">=": s.max < value, "<": s.min >= value, "<=": s.min > value}[op]:
                    return False
            except TypeError:  # statistics of another type than the literal
                continue
        return True


class RowGroupSource(DataSource):
    """``spark.read.format("rowgroups")``; use ``read_row_groups``."""

    @classmethod
    def name(cls) -> str:
        return "rowgroups"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_row_groups(spark: SparkSession, path: str, blocks: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of a folder's row groups with their ``_block``, a partition a row
    group up to MOST_PARTITIONS, then some row groups each; ``blocks`` (with file, row_group and block, a part of ``row_groups``)
    chooses which are opened at all, ``columns`` which columns are read."""
    chosen = (row_groups(spark, path) if blocks is None else blocks).select("file", "row_group", "block").orderBy("block").collect()  # footers: a row a row group
    schema = spark.read.parquet(path).schema
    wanted = StructType([f for f in schema if columns is None or f.name in columns]).add("_block", "long")
    spark.dataSource.register(RowGroupSource)
    # filters reach a Python source only when the session says so
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    groups = json.dumps([(r["file"], r["row_group"], r["block"]) for r in chosen])
    return spark.read.format("rowgroups").option("groups", groups).option("schema", wanted.json()).load()
