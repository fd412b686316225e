"""Join-shaped operators.

Only one-row tables (statistics, blocks of a codebook) and the vectors of a
bounded number of hot ids are broadcast by a hint; everything else is left to
Catalyst/AQE (sort-merge or shuffled hash join on the key, or a broadcast of what
is measured small).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.operators.ordering import global_row_number
from tessera.session import BROADCAST_BYTES, materialize


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F1 fit: one row of mean and population std per column (NaN/null
    ignored; zero variance -> 1)."""
    aggs = []
    for c in cols:
        x = F.when(~F.isnan(F.col(c)), F.col(c))
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__sd")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Attach the one-row stats by broadcast and standardize; columns
    without stats pass through."""
    fitted = [c for c in cols if f"{c}__mean" in stats.columns]
    d = df.crossJoin(F.broadcast(stats))
    out = []
    for c in df.columns:
        if c in fitted:
            sd = F.col(f"{c}__sd")
            scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
            out.append(((F.col(c) - F.col(f"{c}__mean")) / scale).alias(c))
        else:
            out.append(F.col(c))
    return d.select(*out)


def fit_label_codes(df: DataFrame, col: str) -> DataFrame:
    """F2 fit: code = 0-based rank of the value among the sorted distinct
    string values (distributed row numbering, no one-task window)."""
    vals = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    return global_row_number(vals, ["value"], "code").select("value", (F.col("code") - 1).alias("code"))


def fit_label_codes_of(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """F2 fit of several columns in one pass over their (narrow) values."""
    vals = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])).alias("e"))
    vals = vals.select("e.*").where(F.col("value").isNotNull()).distinct()
    ranked = materialize(global_row_number(vals, ["col", "value"], "rn"))
    first = {r["col"]: r["rn"] for r in ranked.groupBy("col").agg(F.min("rn").alias("rn")).collect()}  # a row a column
    return {c: ranked.where(F.col("col") == c).select("value", (F.col("rn") - first.get(c, 1)).alias("code")) for c in cols}


def apply_label_codes(df: DataFrame, codes: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Value -> code; an unseen value raises (like the fitted encoder)."""
    out = out or col
    j = df.join(codes.withColumnRenamed("value", "_v"), F.col(col).cast("string") == F.col("_v"), "left")
    code = F.when(F.col("code").isNull() & F.col(col).isNotNull(), F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string")))).otherwise(F.col("code"))
    return j.withColumn(out, code.cast("bigint")).drop("_v", "code")


#: An id is hot if it has at least this share of the looked-up ids; the sketch
#: that finds such ids tracks TRACKED of them in every task.
HOT_SHARE = 1 / 512
TRACKED = 8192


def hot_ids(ids: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` ids that a mergeable frequent-items sketch estimates at
    HOT_SHARE of the rows or more. Which ids it finds changes no result, only how
    their vectors travel."""
    est = ids.agg(F.count(id_col).alias("n"), F.expr(f"approx_top_k(`{id_col}`, {min(int(1 / HOT_SHARE), most)}, {TRACKED})").alias("top")).first()
    hot = [(int(t["item"]),) for t in est["top"] or [] if t["item"] is not None and t["count"] >= HOT_SHARE * est["n"]]
    return ids.sparkSession.createDataFrame(hot, "_hot long")


def _with_vectors(ids: DataFrame, id_col: str, table: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """``ids`` with ``_vec`` (null where the table has no such key). Vectors of
    hot ids are broadcast, at most as many as fit BROADCAST_BYTES; all other ids
    meet theirs by a shuffle in which no id is frequent any more."""
    t = table.select(F.col(key).cast("long").alias("_k"), F.col(vec).alias("_vec"))
    most = min(int(1 / HOT_SHARE), BROADCAST_BYTES // (4 * dim + 64))
    hot = hot_ids(ids, id_col, most) if most else None
    if hot is None or hot.isEmpty():
        return ids.join(t, F.col(id_col) == F.col("_k"), "left").drop("_k")
    keys = F.broadcast(hot)
    few = F.broadcast(t.join(keys, F.col("_k") == F.col("_hot"), "right").select("_hot", "_vec"))
    warm = ids.join(few, F.col(id_col) == F.col("_hot")).drop("_hot")
    cold = ids.join(keys, F.col(id_col) == F.col("_hot"), "left_anti").join(t, F.col(id_col) == F.col("_k"), "left").drop("_k")
    return warm.unionByName(cold)


def lookup_vectors(ids: DataFrame, id_col: str, table: DataFrame, key: str, vec: str, vocab: int, dim: int) -> DataFrame:
    """Id -> vector; id <= 0 or id >= vocab (padding / OOV) -> zero vector.
    Ids out of range do not take part in the join."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    valid = F.coalesce((F.col(id_col) > 0) & (F.col(id_col) < vocab), F.lit(False))
    found = _with_vectors(ids.where(valid), id_col, table, key, vec, dim).withColumn(vec, F.coalesce("_vec", zero)).drop("_vec")
    return found.unionByName(ids.where(~valid).withColumn(vec, zero))


#: Looked-up ids of a group of rows that meet their vectors in one task, about.
IDS_PER_GROUP = 1 << 23
#: Bytes of vectors that a task holds, about.
HELD_BYTES = 256 << 20
#: Vectors that are added up at once.
ADDED = 1 << 11


class _Held:
    """Vectors of one group in the order of their ids; a value that is null is
    marked in ``there``."""

    def __init__(self, dim: int, expected: int):
        self.dim, self.n, self.room = dim, 0, max(expected, 1)
        self.ids: np.ndarray | None = None
        self.x: np.ndarray | None = None
        self.there: np.ndarray | None = None

    def add(self, ids: np.ndarray, vectors: pa.ListArray) -> None:
        flat = vectors.flatten()
        nulls = flat.null_count > 0
        x = (flat.fill_null(0) if nulls else flat).to_numpy().reshape(-1, self.dim)
        n = self.n + len(ids)
        if self.ids is None or n > len(self.ids):
            size = max(n, self.room if self.ids is None else 2 * len(self.ids))
            self.ids, self.x = self._grown(self.ids, (size,), np.int64), self._grown(self.x, (size, self.dim), x.dtype)
            if self.there is not None:
                self.there = self._grown(self.there, (size, self.dim), bool)
        if nulls and self.there is None:
            self.there = np.ones((len(self.ids), self.dim), bool)
        self.ids[self.n : n], self.x[self.n : n] = ids, x
        if self.there is not None:
            self.there[self.n : n] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        self.n = n

    def _grown(self, old: np.ndarray | None, shape: tuple[int, ...], kind) -> np.ndarray:
        new = np.empty(shape, kind)
        if old is not None:
            new[: self.n] = old[: self.n]
        return new

    def sums(self, code: np.ndarray, ids: np.ndarray, keys: int, added: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums and numbers of values by dimension of the vectors of ``ids``, for every
        key 0 to ``keys`` - 1; ``code`` is the id's key, in ascending order."""
        total, count = np.zeros((keys, self.dim)), np.zeros((keys, self.dim), np.int64)
        known = self.ids[: self.n] if self.ids is not None else np.zeros(0, np.int64)
        first, last = (np.searchsorted(known, ids, side=side) for side in ("left", "right"))
        times = np.maximum(last - first, 1)  # an id that the table lacks counts as a zero vector
        ends = np.cumsum(times)
        at = 0
        while at < len(ids):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + added, side="right")))
            n = times[at:upto]
            own = np.repeat(code[at:upto], n)
            missing = np.repeat(first[at:upto] == last[at:upto], n)
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:upto], n)
            place[missing] = 0
            x = self.x[place].astype(np.float64) if self.n else np.zeros((len(own), self.dim))
            x[missing] = 0.0
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[starts]] += np.add.reduceat(x, starts, axis=0)
            if self.there is None:
                count[own[starts]] += np.diff(np.r_[starts, len(own)])[:, None]
            else:
                count[own[starts]] += np.add.reduceat((self.there[place] | missing[:, None]).astype(np.int64), starts, axis=0)
            at = upto
        return total, count


def _bag_means(row_key: str, dim: int, expected: int, added: int):
    """A function of batches (_p, _id, _vec, key, _ids) that come group by group
    (_p), of each first the vectors by _id, then the rows by key: the mean of each
    row's vectors. Rows of one key share a bag. It holds a group's vectors and a
    batch of rows."""

    def bags(keys: pa.Array, of_row: np.ndarray, total: np.ndarray, count: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        absent = (count == 0) & some[:, None]  # only nulls in a dimension
        mean = np.r_[np.divide(total, count, out=np.zeros_like(total), where=count > 0), np.zeros((1, dim))][of_row]
        flat = pa.array(mean.ravel(), mask=np.r_[absent, np.zeros((1, dim), bool)][of_row].ravel() if absent.any() else None)
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), flat)], [row_key, "bag"])

    def means(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, _Held(dim, expected)
        last, rows = (), 0  # the key that may go on, its sums, and its rows so far

        def closed() -> Iterator[pa.RecordBatch]:
            for at in range(0, rows, added):
                of_row = np.zeros(min(added, rows - at), np.int64)
                yield bags(last[0].take(pa.array(of_row)), of_row, *last[1:])

        for b in batches:
            p, of_vector = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (of_vector[1:] != of_vector[:-1])) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(p)]) if len(p) else ():
                part = b.slice(start, end - start)
                if group != p[start]:
                    yield from closed()
                    group, last, rows, held.n = p[start], (), 0, 0
                if of_vector[start]:
                    held.add(part.column(1).to_numpy(), part.column(2))
                    continue
                codes = part.column(3).dictionary_encode()  # in the order of the keys
                of_row, lists = codes.indices.fill_null(-1).to_numpy(), part.column(4)  # a null key meets no bag
                code, ids, keys = np.repeat(of_row, lists.value_lengths().fill_null(0).to_numpy()), lists.flatten().to_numpy(), len(codes.dictionary)
                sums = [*held.sums(code[code >= 0], ids[code >= 0], keys, added), np.bincount(code[code >= 0], minlength=keys) > 0]
                goes_on = bool(last and keys) and len(pa.concat_arrays([last[0], codes.dictionary[:1]]).dictionary_encode().dictionary) == 1
                if goes_on:
                    for mine, before in zip(sums, last[1:]):
                        mine[0] = mine[0] + before[0]
                    last = (last[0], *(v[:1].copy() for v in sums))
                if keys > goes_on:
                    yield from closed()
                    last, rows = (codes.dictionary[-1:], *(v[-1:].copy() for v in sums)), 0
                later = int((of_row == keys - 1).sum()) if keys else 0
                rows += later
                if later < len(of_row):
                    yield bags(part.column(3)[: len(of_row) - later], of_row[: len(of_row) - later], *sums)
        yield from closed()

    return means


def embedding_bag_mean(
    rows: DataFrame, row_key: str, ids_col: str, table: DataFrame, key: str, vec: str, vocab: int, dim: int
) -> DataFrame:
    """Mean of looked-up vectors over the valid (non-padding, in-vocab)
    ids of each row; zero vector when none.

    Rows are dealt by key to groups. A task gets a group's vectors once, however
    many of its rows look them up, then its rows as a stream, and adds up; no sums
    travel and no group of rows is held. Where all vectors fit HELD_BYTES and are
    fewer than the ids, each group gets all of them, else those that it looks up,
    and has no more ids than vectors that fit."""
    spark = rows.sparkSession
    bags = materialize(rows.select(row_key, F.filter(F.col(ids_col).cast("array<long>"), lambda x: (x > 0) & (x < vocab)).alias("_ids")))
    total = bags.agg(F.sum(F.greatest(F.size("_ids"), F.lit(0)))).first()[0] or 0
    element = table.schema[vec].dataType.elementType
    zero = F.array_repeat(F.lit(0.0).cast(element), dim)
    whole = F.when(F.col(vec).isNull(), zero).otherwise(F.array(*[F.get(F.col(vec), F.lit(i)) for i in range(dim)]))
    t = table.where((F.col(key) > 0) & (F.col(key) < vocab)).select(F.col(key).cast("long").alias("_id"), whole.alias("_vec"))
    n, fit = t.count(), max(1, HELD_BYTES // ((8 if element.typeName() == "double" else 4) * dim))
    least = 2 * spark.sparkContext.defaultParallelism
    groups = max(-(-total // IDS_PER_GROUP), least)
    every = n <= fit and n * groups <= total
    if not every:
        groups = max(-(-total // min(IDS_PER_GROUP, fit)), least)
    bags = bags.withColumn("_p", F.pmod(F.xxhash64(row_key), F.lit(groups)).cast("int"))
    if every:
        met = t.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    else:
        met = bags.select("_p", F.explode("_ids").alias("_id")).distinct().join(t, "_id")
    none = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    both = met.select("_p", "_id", "_vec", none(bags, row_key), none(bags, "_ids")).unionByName(bags.select("_p", none(met, "_id"), none(met, "_vec"), row_key, "_ids"))
    # vectors first, in the order of their ids, then rows
    dealt = both.repartitionById(groups, "_p").sortWithinPartitions("_p", F.col("_id").asc_nulls_last(), row_key)
    out = StructType([rows.schema[row_key], StructField("bag", ArrayType(DoubleType()))])
    return dealt.mapInArrow(_bag_means(row_key, dim, min(n, fit), ADDED), out)


CODES_PER_BLOCK = 1024


def nearest_code(df: DataFrame, key: str, vec: str, codebook: DataFrame, code_key: str, code_vec: str) -> DataFrame:
    """Nearest codebook row by squared L2 (lowest code id on ties).

    The codebook is cut into blocks of about CODES_PER_BLOCK codes, each packed
    into ONE row (an array of (id, vector)) and attached by broadcast; each row
    scans a block inside a higher-order function and keeps the better of its
    best and the block's — no pair rows, and no limit on the number of codes."""
    book = materialize(codebook.select(F.col(code_key).alias("id"), F.col(code_vec).alias("v")))
    n_blocks = max(1, -(-book.count() // CODES_PER_BLOCK))
    x = F.col(vec)

    def dist(c):
        return F.aggregate(F.zip_with(x, c["v"], lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v)

    d, best = df, None
    for i in range(n_blocks):
        block = book.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i)
        d = d.crossJoin(F.broadcast(block.agg(F.collect_list(F.struct("id", "v")).alias("_codes"))))
        found = F.array_min(F.transform("_codes", lambda c: F.struct(dist(c).alias("d2"), c["id"].alias("id"), c["v"].alias("q"))))
        d = d.withColumn("_best", found if best is None else F.least("_best", found)).drop("_codes")
        best = F.col("_best")
    return d.select(key, best["id"].alias("code"), best["d2"].alias("d2"), best["q"].alias("quantized"))


def vq_losses(assigned: DataFrame, dim: int, commitment_cost: float = 0.25) -> DataFrame:
    """Codebook and commitment terms (both the mean squared error of the
    assignment; commitment scaled by its cost) and their sum."""
    mse = F.avg(F.col("d2") / dim)
    return assigned.agg(mse.alias("codebook_loss"), (mse * commitment_cost).alias("commitment_loss"),
                        (mse * (1 + commitment_cost)).alias("vq_loss"))


def coverage(pred: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Ids expected but not predicted, and predicted but not expected
    (two anti joins; both must be 0 for a valid submission)."""
    missing = expected.select(key).join(pred.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    extra = pred.select(key).join(expected.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_extra"))
    return missing.crossJoin(extra)
