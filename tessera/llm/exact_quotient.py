"""Exact deduplication by counting quotient filters.

Every partition builds a counting quotient filter over the 64-bit
fingerprints of its normalised texts: the leading bits of a fingerprint (its
quotient) choose a range, the remaining bits are kept as sorted remainders
beside their counts. Filters of different partitions merge range by range,
losslessly, by merging sorted remainders and adding counts. Fingerprints
counted more than once route their rows to byte verification (grouping by the
normalised bytes themselves); only verified groups lose rows.

Bounds: a filter block holds one range of one partition; a range holds about
``RANGE_FINGERPRINTS`` distinct fingerprints whatever the input, because the
number of ranges grows with the row count. A hot text is one counted entry in
each partition's filter and one partial count in verification.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, arrow_schema, lean, pinned, settle_rows, shuffle_width, small_or_not

RANGE_FINGERPRINTS = 1 << 22

_BLOCK = "quotient int, remainders binary, counts binary"


def normalised(text: Column) -> Column:
    """The text without any of `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def _blocks(fps: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted fingerprints and counts cut into one block per quotient."""
    quotient = (fps >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fps), np.int64)
    starts = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(fps) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(fps)] if len(fps) else starts
    remainder = fps & np.uint64((1 << (64 - bits)) - 1)
    return pa.RecordBatch.from_pydict(
        {
            "quotient": [int(quotient[a]) for a in starts],
            "remainders": [remainder[a:b].tobytes() for a, b in zip(starts, ends)],
            "counts": [counts[a:b].tobytes() for a, b in zip(starts, ends)],
        },
        schema=pa.schema([("quotient", pa.int32()), ("remainders", pa.binary()), ("counts", pa.binary())]),
    )


def _merge(fps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal fingerprints added up, in sorted order."""
    order = np.argsort(fps, kind="stable")  # timsort merges the sorted runs
    fps, counts = fps[order], counts[order]
    if not len(fps):
        return fps, counts
    starts = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
    return fps[starts], np.add.reduceat(counts, starts)


def partition_filters(fingerprints: DataFrame, bits: int) -> DataFrame:
    """One counting quotient filter per partition of the one-column (long) table.
    Batches become sorted runs; runs of like size are merged, so a fingerprint
    is moved about log2(batches) times."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            new = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            runs.append(_merge(new, np.ones(len(new), np.int64)))
            while len(runs) > 1 and 2 * len(runs[-1][0]) > len(runs[-2][0]):
                runs[-2:] = [_merge(*map(np.concatenate, zip(*runs[-2:])))]
        if runs:
            yield _blocks(*_merge(*map(np.concatenate, zip(*runs))), bits)

    return fingerprints.mapInArrow(lean(build), _BLOCK)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fps = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["remainders"]])
    return _merge(fps, np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["counts"]]))


def merge_filters(filters: DataFrame) -> DataFrame:
    """All blocks of a quotient merged to one."""

    def merge(table: pa.Table) -> pa.Table:
        fps, counts = _merged(table)
        return pa.table({"quotient": pa.array([table["quotient"][0].as_py()], pa.int32()), "remainders": [fps.tobytes()], "counts": [counts.tobytes()]})

    return filters.groupBy("quotient").applyInArrow(merge, _BLOCK)


def repeated(filters: DataFrame, bits: int) -> DataFrame:
    """(fp, n) of the entries that the filters of all partitions together count
    more than once: a quotient's blocks are merged and read off in one step."""

    def read(table: pa.Table) -> pa.Table:
        fps, counts = _merged(table)
        more = counts > 1
        high = np.uint64(table["quotient"][0].as_py() << (64 - bits)) if bits else np.uint64(0)
        return pa.table({"fp": (fps[more] | high).view(np.int64), "n": counts[more]})

    return filters.groupBy("quotient").applyInArrow(read, "fp long, n long")


def quotient_bits(rows: int, width: int) -> int:
    """Leading bits, so that ranges are at least ``width`` and bounded in size."""
    return max(0, (max(width, rows // RANGE_FINGERPRINTS + 1) - 1).bit_length())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after deleting `[\\x20\\x09-\\x0D]`; a null
    text counts as empty, so null, empty and blank texts form one group. The
    row with the most code points in its original text stays; ties go to the
    smallest id, null ids last; of rows that tie in all of that exactly one
    is kept. An empty table gives an empty result. Only ``id_col`` and
    ``text_col`` are read, so other columns cannot clash.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), normalised(text).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    keys = pinned(src.select("doc_id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"), "fp"))
    bits = quotient_bits(keys.count(), shuffle_width(docs))
    dup = pinned(repeated(partition_filters(keys.select("fp"), bits), bits))
    few = small_or_not(dup.select("fp"), 64)
    # rows of fingerprints that the filter counts once are alone; of the others
    # the bytes decide
    alone = keys.join(few, "fp", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "n_chars")
    routed = src.join(few, "fp", "left_semi").withColumn("row", F.monotonically_increasing_id())
    routed = pinned(routed)  # the rows' numbers must not change between the two uses
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    groups = routed.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = pinned(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")))
    of = routed.select("doc_id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"), "row").join(small_or_not(groups, 176), "sha")
    both = alone.unionByName(of.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha", "n_chars"))
    return both.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "n_chars")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    g = exact_groups(docs, id_col, text_col).where("group_size > 1")
    # a key is dropped, unless one of its rows is the kept one
    marks = g.groupBy("doc_id", "text_sha256", "n_chars").agg(F.max("kept").alias("once"), F.count(F.lit(1)).alias("n"))
    marks = marks.where("not once or n > 1").select("doc_id", "text_sha256", "n_chars", "once")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = {"doc_id": F.col(f"`{id_col}`"), "text_sha256": F.sha2(normalised(text), 256), "n_chars": F.length(text).cast("long")}
    return settle_rows(docs, marks, keys, 320)
