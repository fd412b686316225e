"""Nearest code by pivots and the triangle inequality (J5, F11), exact.

Some codes serve as pivots; every code belongs to its nearest pivot and knows
its distance r to it. A vector at distance D from a pivot and with a code already
known at distance u can only find a nearer code in that pivot's list where
D - u <= r <= D + u, a contiguous stretch of a list sorted by r. A vector's
distances to the pivots and to the list of the nearest one give u; then the
stretches of the other lists are scanned: a matrix product gives the distances up
to a known rounding error, and those within it of the best are computed exactly.
Bounds have a margin above the rounding of the distances, and ties go to the lowest
id, so the result is that of a full scan. The number of distances that were
computed, in the one way or the other, is part of the result.

A codebook of any size is taken in blocks of a fixed number of bytes: block by
block, each beginning with the best that the blocks before have found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.knn import FLOAT_DIMS
from tessera.session import BROADCAST_BYTES, materialize

#: Pairs of a vector and a code whose distances are computed at once.
PAIRS = 1 << 16
#: Vectors of a task, about.
TASK_ROWS = 20_000
_FOUND = "struct<d2:double,id:long,scanned:long>"


@dataclass
class Block:
    """Codes by pivot and, within a pivot, by distance to it."""

    pivots: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    r: np.ndarray
    starts: np.ndarray  # of each pivot's list, and the end

    @staticmethod
    def build(ids: np.ndarray, codes: np.ndarray, n_pivots: int) -> Block:
        """Pivots far from each other: each the code farthest from those before."""
        order = np.argsort(ids)
        ids, codes = ids[order], codes[order]
        at, near = [0], _d2(codes, codes[:1])[:, 0]
        while len(at) < min(n_pivots, len(codes)):
            far = int(np.argmax(near))
            if near[far] == 0:  # equal codes only
                break
            at.append(far)
            near = np.minimum(near, _d2(codes, codes[far : far + 1])[:, 0])
        pivots = codes[at]
        to = np.sqrt(_d2(codes, pivots))
        home = np.argmin(to, axis=1)
        r = to[np.arange(len(codes)), home]
        order = np.lexsort((ids, r, home))
        return Block(pivots, ids[order], codes[order], r[order], np.searchsorted(home[order], np.arange(len(pivots) + 1)))

    def nearest(self, x: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Better of the given best and this block's: d2, id, distances computed."""
        d2, ids, scanned = d2.copy(), ids.copy(), np.full(len(x), len(self.pivots), np.int64)
        to = np.sqrt(_d2(x, self.pivots))
        # a pivot is a code too: its distance bounds that of the nearest
        home = np.argmin(to, axis=1)
        for first in (True, False):
            for j in range(len(self.pivots)):
                rows = np.flatnonzero(home == j) if first else np.flatnonzero(home != j)
                s, e = self.starts[j], self.starts[j + 1]
                if not len(rows) or s == e:
                    continue
                u = np.minimum(np.sqrt(d2[rows]), to[rows, home[rows]])
                slack = 1e-9 * (u + to[rows, j]) + 1e-12
                lo = s + np.searchsorted(self.r[s:e], to[rows, j] - u - slack, side="left")
                hi = s + np.searchsorted(self.r[s:e], to[rows, j] + u + slack, side="right")
                some = hi > lo
                self._scan(x, rows[some], lo[some], hi[some], d2, ids)
                scanned[rows] += np.maximum(hi - lo, 0)
        return d2, ids, scanned

    def _side(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The codes' middle, the codes less it as columns, their squares and the
        unit of the product's error; made once where it is used."""
        if "_made" not in self.__dict__:
            dims = self.codes.shape[1]
            mid = self.codes.mean(axis=0)
            c = self.codes - mid
            size = np.square(c).sum(axis=1)
            kind = np.float32 if dims > FLOAT_DIMS and size.max() < 1e30 else np.float64
            self.__dict__["_made"] = mid, np.ascontiguousarray(c.T, dtype=kind), size, 4 * (dims + 8) * float(np.finfo(kind).eps)
        return self.__dict__["_made"]

    def _scan(self, x: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> None:
        """Stretches [lo, hi) of the codes against their rows, some pairs at a time."""
        if not len(rows):
            return
        mid, side, size, unit = self._side()
        most = size.max()
        order = np.argsort(lo, kind="stable")
        rows, lo, hi = rows[order], lo[order], hi[order]
        step = max(1, PAIRS // int(hi.max() - lo[0]))
        for at in range(0, len(rows), step):
            r, f, t = rows[at : at + step], lo[at : at + step], hi[at : at + step]
            a, z = f[0], t.max()
            c = x[r] - mid
            own = np.square(c).sum(axis=1)
            if own.max() < 1e30 and np.isfinite(most):
                near = (-2 * c).astype(side.dtype) @ side[:, a:z]
                near += size[a:z].astype(side.dtype)
                if f[-1] > a or t.min() < z:
                    span = np.arange(a, z)
                    near[(span < f[:, None]) | (span >= t[:, None])] = np.inf
                slack = 2 * unit * (own + most)
                row, code = np.nonzero(near <= (np.minimum(near.min(axis=1), d2[r] - own) + slack)[:, None])
            else:  # too far, or not a number
                span = np.arange(a, z)
                row, code = np.nonzero((span >= f[:, None]) & (span < t[:, None]))
            if not len(row):
                continue
            code += a
            dist = np.square(x[r[row]] - self.codes[code]).sum(axis=1)
            order = np.lexsort((self.ids[code], dist, row))
            row, first = np.unique(row, return_index=True)  # sorted already
            top = order[first]
            r, d, i = r[row], dist[top], self.ids[code[top]]
            better = (d < d2[r]) | ((d == d2[r]) & (i < ids[r]))
            d2[r[better]], ids[r[better]] = d[better], i[better]


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for j, c in enumerate(b):
        out[:, j] = np.square(a - c).sum(axis=1)
    return out


def _better(block: Block, spark: SparkSession):
    """A function of a vector and its best so far: the better of that and the block's."""
    shared = spark.sparkContext.broadcast(block)

    @F.arrow_udf(_FOUND)
    def better(x: pa.Array, best: pa.Array) -> pa.Array:
        there = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
        m = np.array(x.drop_null().flatten()).reshape(len(there), -1 if len(there) else 1)
        was = [f.take(pa.array(there)) for f in best.flatten()]  # nulls of the struct go down to its fields
        d2 = was[0].fill_null(np.inf).to_numpy(zero_copy_only=False)
        ids = was[1].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        d2, ids, scanned = shared.value.nearest(m, d2, ids) if len(there) else (d2, ids, np.zeros(0, np.int64))
        scanned = scanned + was[2].fill_null(0).to_numpy(zero_copy_only=False)
        full = [np.zeros(len(x), v.dtype) for v in (d2, ids, scanned)]
        for f, v in zip(full, (d2, ids, scanned)):
            f[there] = v
        return pa.StructArray.from_arrays([pa.array(f) for f in full], ["d2", "id", "scanned"], mask=x.is_null())

    return better


def nearest_code_pruned(df: DataFrame, key: str, vec: str, codebook: DataFrame, code_key: str, code_vec: str, pivots: int | None = None) -> DataFrame:
    """(key, code, d2, scanned): the nearest codebook row by squared L2
    (lowest id on ties) and how many distances the row took. ``pivots`` a block:
    by default about the square root of its codes. A row without a vector, and
    every row if the codebook is empty, has no code (null)."""
    spark = df.sparkSession
    book = materialize(codebook.select(F.col(code_key).cast("long").alias("id"), F.col(code_vec).cast("array<double>").alias("v")).where("id is not null and v is not null"))
    size = book.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    per_block = max(64, BROADCAST_BYTES // (8 * ((size["dims"] or 1) + 2)))
    blocks = -(-size["n"] // per_block)
    # a file of many vectors is little to read and much to do: all cores take part
    tasks = max(-(-df.count() // TASK_ROWS), 2 * spark.sparkContext.defaultParallelism)
    out = df.select(key, vec).repartition(tasks).select(key, F.col(vec).cast("array<double>").alias("_x"), F.lit(None).cast(_FOUND).alias("_best"))
    for i in range(blocks):
        part = book.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()  # about BROADCAST_BYTES
        if not part.num_rows:
            continue
        codes = np.array(part["v"].combine_chunks().flatten()).reshape(part.num_rows, -1)
        out = out.withColumn("_best", _better(Block.build(part["id"].to_numpy(), codes, pivots or max(1, round(part.num_rows**0.5))), spark)("_x", "_best"))
    return out.select(key, F.col("_best.id").alias("code"), F.col("_best.d2").alias("d2"), F.col("_best.scanned").alias("scanned"))
