"""Array / sequence Column functions (A1-A19). All JVM-side higher-order
functions: no Python per row, and null arrays behave like empty ones."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length(x) -> Column:
    """A5: array length, 0 for null (bigint)."""
    return F.coalesce(F.size(_c(x)), F.lit(0)).cast("bigint")


def pool_sum(x) -> Column:
    """A4: sum of elements, 0 for null/empty (element type kept)."""
    x = _c(x)
    return F.coalesce(F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v), F.lit(0))


def pool_sum_double(x) -> Column:
    return F.coalesce(F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))


def pool_mean(x, integral: bool = False) -> Column:
    """A1: mean of elements, 0.0 for null/empty. Integral arrays are summed
    exactly in bigint first, so the mean is one correctly rounded division."""
    x = _c(x)
    if integral:
        s = F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v).cast("double")
    else:
        s = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return F.coalesce(s / F.nullif(F.size(x), F.lit(0)), F.lit(0.0))


def pool_max(x) -> Column:
    """A2: max element, 0 for null/empty."""
    return F.coalesce(F.array_max(_c(x)), F.lit(0))


def pool_min(x) -> Column:
    """A3: min element, 0 for null/empty."""
    return F.coalesce(F.array_min(_c(x)), F.lit(0))


def last(x) -> Column:
    """Last element, 0 if null/empty."""
    return F.coalesce(F.try_element_at(_c(x), F.lit(-1)), F.lit(0))


def positive_only(x) -> Column:
    """Keep positive elements."""
    return F.filter(_c(x), lambda v: v > 0)


def clean_ids(x, vocab: int) -> Column:
    """Element rule of the encoder: <=0 (incl. -1 = missing) -> 0, >= vocab -> 0,
    vocab == 0 -> everything 0."""
    if vocab <= 0:
        return F.transform(_c(x), lambda v: F.lit(0).cast("bigint"))
    return F.transform(_c(x), lambda v: F.when((v > 0) & (v < vocab), v).otherwise(F.lit(0)).cast("bigint"))


def pad_ids(x, dim: int, vocab: int) -> Column:
    """Multi-hot clean + pad: keep the first ``dim`` elements, clean them,
    right-pad with 0 to exactly ``dim``. Null -> all zeros."""
    head = F.slice(F.coalesce(_c(x), F.array().cast("array<bigint>")), 1, dim)
    cleaned = clean_ids(head, vocab)
    return F.slice(F.concat(cleaned, F.array_repeat(F.lit(0).cast("bigint"), dim)), 1, dim)


def pad_raw(x, dim: int, fill=0, dtype: str = "bigint") -> Column:
    """Truncate head-first and right-pad with ``fill`` (no cleaning)."""
    head = F.slice(F.coalesce(_c(x).cast(f"array<{dtype}>"), F.array().cast(f"array<{dtype}>")), 1, dim)
    return F.slice(F.concat(head, F.array_repeat(F.lit(fill).cast(dtype), dim)), 1, dim)


def pad_dense(x, dim: int) -> Column:
    """Dense vector truncated / zero-padded to ``dim`` (float)."""
    return pad_raw(x, dim, 0.0, "float")


def padded_len(x, max_len: int) -> Column:
    return F.least(length(x), F.lit(max_len).cast("bigint"))


def domain_len(cols: Sequence, max_len: int) -> Column:
    """Domain length = max over side-info columns of min(len, max_len)."""
    lens = [padded_len(c, max_len) for c in cols]
    return lens[0] if len(lens) == 1 else F.greatest(*lens)


def padding_mask(x, n) -> Column:
    """True where position index >= valid length."""
    return F.transform(_c(x), lambda v, i: i >= _c(n))


def masked_mean(x, n) -> Column:
    """Mean over the first ``n`` positions, count floored at 1."""
    n = _c(n)
    head = F.slice(_c(x), 1, F.greatest(n, F.lit(0)).cast("int"))
    s = F.aggregate(head, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return s / F.greatest(n, F.lit(1))


def latest_k(x, n, k: int) -> Column:
    """The latest ``k`` valid tokens (valid = first n positions),
    right-aligned and left-padded with 0 to length k."""
    x, n = _c(x), _c(n).cast("int")
    take = F.least(n, F.lit(k))
    tail = F.slice(x, F.greatest(n - F.lit(k), F.lit(0)) + 1, F.greatest(take, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(k) - F.size(tail)), tail)


def chunks(x, n_chunks: int, total: int) -> Column:
    """Zero-pad a vector of length ``total`` to n*ceil(total/n) and split it
    into ``n_chunks`` equal chunks."""
    size = math.ceil(total / n_chunks)
    padded = pad_raw(x, size * n_chunks, 0.0, "float")
    return F.transform(F.sequence(F.lit(0), F.lit(n_chunks - 1)), lambda i: F.slice(padded, i * size + 1, size))


def concat_bounded(a, b, n: int) -> Column:
    """A followed by at most n elements of b."""
    return F.concat(_c(a), F.slice(_c(b), 1, n))


def mix(a, b, lam) -> Column:
    """Element-wise lam*a + (1-lam)*b (arrays of equal length)."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.zip_with(_c(a), _c(b), lambda x, y: lam * x + (F.lit(1.0) - lam) * y)
