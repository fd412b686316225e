"""Encode batch (A10-A13, A19, G15): wide rows -> fixed-length model inputs.

One ``select`` built from the schema (a small dict, like schema.json):
scalar ids cleaned, multi-hot ids padded, dense vectors padded, every
feature laid out at its fid-ordered offset; each sequence domain becomes a
[n_side_features][max_len] matrix plus its length and time buckets.
Everything is a narrow, map-only projection — no shuffle at any scale.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scalars as S


def _int_part(col: str, vocab: int, dim: int, is_array: bool) -> Column:
    if is_array:
        return A.pad_ids(col, dim, vocab)
    return F.array(S.clean_scalar(col, vocab))


def _is_array(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() == "array"


def offsets(entries: Sequence[Sequence[int]]) -> list[tuple[int, int, int]]:
    """(fid, offset, length) in fid order; offset = running sum of dims."""
    out, off = [], 0
    for e in sorted(entries, key=lambda e: e[0]):
        dim = e[-1]
        out.append((e[0], off, dim))
        off += dim
    return out


def int_block(df: DataFrame, prefix: str, entries: Sequence[Sequence[int]]) -> Column:
    """A10: concat of the cleaned/padded int features in fid order."""
    parts = [
        _int_part(f"{prefix}{fid}", vocab, dim, _is_array(df, f"{prefix}{fid}"))
        for fid, vocab, dim in sorted(entries, key=lambda e: e[0])
    ]
    return F.concat(*parts) if parts else F.array().cast("array<bigint>")


def dense_block(entries: Sequence[Sequence[int]], prefix: str = "user_dense_feats_") -> Column:
    parts = [A.pad_dense(f"{prefix}{fid}", dim) for fid, dim in sorted(entries, key=lambda e: e[0])]
    return F.concat(*parts) if parts else F.array().cast("array<float>")


def side_fids(dom_cfg: Mapping) -> list[tuple[int, int]]:
    """Side-info features of a domain: every fid but the ts fid, schema order."""
    return [(fid, vs) for fid, vs in dom_cfg["features"] if fid != dom_cfg.get("ts_fid")]


def domain_columns(domain: str, dom_cfg: Mapping, max_len: int, now_col: str = "timestamp") -> list[Column]:
    """A11-A13 for one domain: matrix, length, time buckets."""
    prefix = dom_cfg["prefix"] + "_"
    sides = side_fids(dom_cfg)
    mat = F.array(*[A.pad_ids(f"{prefix}{fid}", max_len, vs) for fid, vs in sides])
    length = A.domain_len([f"{prefix}{fid}" for fid, _ in sides], max_len)
    ts_fid = dom_cfg.get("ts_fid")
    if ts_fid is None:
        tb = F.array_repeat(F.lit(0).cast("bigint"), max_len)
    else:
        tb = S.time_bucket_array(now_col, A.pad_raw(f"{prefix}{ts_fid}", max_len))
    return [mat.alias(domain), length.alias(f"{domain}_len"), tb.alias(f"{domain}_time_bucket")]


def encode_batch(
    df: DataFrame,
    schema: Mapping,
    max_lens: Mapping[str, int],
    keep: Sequence[str] = ("sample_id",),
    is_training: bool = True,
) -> DataFrame:
    """Rows -> training batch columns (label 0 everywhere in inference mode)."""
    label = S.label_binary("label_type") if is_training else F.lit(0).cast("bigint")
    cols = [F.col(k) for k in keep] + [
        label.alias("label"),
        F.col("timestamp"),
        int_block(df, "user_int_feats_", schema.get("user_int", [])).alias("user_int_feats"),
        int_block(df, "item_int_feats_", schema.get("item_int", [])).alias("item_int_feats"),
        dense_block(schema.get("user_dense", [])).alias("user_dense_feats"),
    ]
    for dom in sorted(schema.get("seq", {})):
        cols += domain_columns(dom, schema["seq"][dom], max_lens.get(dom, 50))
    return df.select(*cols)


def feature_groups(
    df: DataFrame, prefix: str, entries: Sequence[Sequence[int]], groups: Mapping[str, Sequence[int]] | None,
    keep: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """One array column per feature group (members concatenated in the
    listed order). Without groups, each feature is its own group. An unknown
    member fid is an error."""
    by_fid = {e[0]: e for e in entries}
    if not groups:
        groups = {f"f{fid}": [fid] for fid in sorted(by_fid)}
    cols = [F.col(k) for k in keep]
    for name, members in groups.items():
        missing = [m for m in members if m not in by_fid]
        if missing:
            raise ValueError(f"group {name!r}: unknown fids {missing}")
        parts = [
            _int_part(f"{prefix}{m}", by_fid[m][1], by_fid[m][2], _is_array(df, f"{prefix}{m}")) for m in members
        ]
        cols.append(F.concat(*parts).alias(name))
    return df.select(*cols)


def oob_stats(df: DataFrame, schema: Mapping, max_lens: Mapping[str, int]) -> DataFrame:
    """Out-of-vocabulary counts per (group, column) after truncation and
    <=0 cleaning: count, min and max of values >= vocab. Per-row HOF counts +
    one partially aggregated ``agg`` (no explode), then stacked long."""
    specs = []  # (group, column, vocab, truncate_to or None)
    for kind in ("user_int", "item_int"):
        for fid, vocab, dim in schema.get(kind, []):
            col = f"{kind}_feats_{fid}"
            if vocab > 0:
                specs.append((kind, col, vocab, dim if _is_array(df, col) else None))
    for dom, cfg in schema.get("seq", {}).items():
        for fid, vocab in side_fids(cfg):
            if vocab > 0:
                specs.append((dom, f"{cfg['prefix']}_{fid}", vocab, max_lens.get(dom, 50)))
    aggs = []
    for i, (_, col, vocab, trunc) in enumerate(specs):
        if trunc is None:
            x = F.col(col)
            bad = x >= vocab
            aggs += [F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, x)).alias(f"lo{i}"), F.max(F.when(bad, x)).alias(f"hi{i}")]
        else:
            over = F.filter(F.slice(F.col(col), 1, trunc), lambda v: v >= vocab)
            aggs += [
                F.sum(F.coalesce(F.size(over), F.lit(0))).cast("bigint").alias(f"n{i}"),
                F.min(F.array_min(over)).alias(f"lo{i}"),
                F.max(F.array_max(over)).alias(f"hi{i}"),
            ]
    wide = df.agg(*aggs)
    entries = [
        F.struct(
            F.lit(g).alias("grp"), F.lit(c).alias("column"), F.lit(v).cast("bigint").alias("vocab"),
            F.col(f"n{i}").cast("bigint").alias("oob_count"),
            F.col(f"lo{i}").cast("bigint").alias("min_oob"), F.col(f"hi{i}").cast("bigint").alias("max_oob"),
        )
        for i, (g, c, v, _) in enumerate(specs)
    ]
    out = wide.select(F.inline(F.array(*entries))).where(F.col("oob_count") > 0)
    return out.withColumn(
        "direction", F.when(F.col("min_oob") >= F.col("vocab"), "TOO_HIGH").otherwise("TOO_LOW")
    )
