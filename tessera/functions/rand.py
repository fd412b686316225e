"""Stateless, retry-safe randomness.

A draw is a pure function of (row key, salt, seed): the first 32 bits of
``md5("key:salt:seed")`` scaled to [0, 1). It does not depend on
partitioning, survives task retries and executor loss, and DuckDB
computes the identical number, which makes every augmentation oracle
checkable. Gaussians use Box-Muller over two independent uniforms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash32(*parts) -> Column:
    """Unsigned 32-bit integer from md5 of the ':'-joined parts (bigint)."""
    return F.conv(F.substring(F.md5(_key(parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """U[0,1) keyed by the parts (columns or literals)."""
    return hash32(*parts) / F.lit(TWO32)


def gaussian(*parts) -> Column:
    """N(0,1) by Box-Muller; uses salts '<key>:g1' and '<key>:g2'."""
    u1 = F.lit(1.0) - uniform(*parts, "g1")  # (0, 1]
    u2 = uniform(*parts, "g2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


# ---- DuckDB twins (used to write oracle SQL that draws the same numbers) ----

def _key_sql(parts) -> str:
    out = []
    for p in parts:
        if isinstance(p, SqlExpr):
            out.append(f"cast({p.text} as varchar)")
        else:
            out.append("'" + str(p).replace("'", "''") + "'")
    return "concat_ws(':', " + ", ".join(out) + ")"


class SqlExpr:
    """Marks a SQL expression (as opposed to a literal) in the *_sql helpers."""

    def __init__(self, text: str):
        self.text = text


def hash32_sql(*parts) -> str:
    return f"cast(('0x' || substr(md5({_key_sql(parts)}), 1, 8)) as bigint)"


def uniform_sql(*parts) -> str:
    return f"({hash32_sql(*parts)} / 4294967296.0)"


def gaussian_sql(*parts) -> str:
    u1 = f"(1.0 - {uniform_sql(*parts, 'g1')})"
    u2 = uniform_sql(*parts, "g2")
    return f"(sqrt(-2.0 * ln({u1})) * cos({2 * math.pi!r} * {u2}))"
