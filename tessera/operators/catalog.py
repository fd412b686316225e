"""Feature catalog and schema inference.

The catalog is column metadata (a few hundred entries at most) walked from
``df.schema``; the data facts (vocab, dims, timestamp column) come from ONE
aggregate job whose partial aggregation leaves one row per task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_LABEL = ["user_id", "item_id", "label_type", "label_time", "timestamp"]
FAMILIES = [
    "id_label", "user_int_scalar", "user_int_array", "user_dense", "item_int_scalar",
    "item_int_array", "domain_a", "domain_b", "domain_c", "domain_d",
]
_PATTERNS = [
    (re.compile(r"^user_int_feats_(\d+)$"), "user_int"),
    (re.compile(r"^item_int_feats_(\d+)$"), "item_int"),
    (re.compile(r"^user_dense_feats_(\d+)$"), "user_dense"),
    (re.compile(r"^domain_([a-z])_seq_(\d+)$"), "seq"),
]
TS_VOCAB_MIN = 1_000_000


@dataclass(frozen=True)
class Feature:
    column: str
    family: str  # one of FAMILIES
    kind: str  # user_int | item_int | user_dense | seq
    fid: int
    is_array: bool
    domain: str | None
    ordinal: int  # position in the table schema


def catalog(df: DataFrame) -> list[Feature]:
    """Classify columns into families from names and Spark types."""
    out = []
    for i, f in enumerate(df.schema.fields):
        is_arr = isinstance(f.dataType, T.ArrayType)
        for pat, kind in _PATTERNS:
            m = pat.match(f.name)
            if not m:
                continue
            if kind == "seq":
                dom = m.group(1)
                out.append(Feature(f.name, f"domain_{dom}", kind, int(m.group(2)), is_arr, f"seq_{dom}", i))
            elif kind == "user_dense":
                out.append(Feature(f.name, "user_dense", kind, int(m.group(1)), is_arr, None, i))
            else:
                fam = f"{kind}_{'array' if is_arr else 'scalar'}"
                out.append(Feature(f.name, fam, kind, int(m.group(1)), is_arr, None, i))
            break
        else:
            if f.name in ID_LABEL:
                out.append(Feature(f.name, "id_label", "meta", -1, is_arr, None, i))
    return out


def catalog_df(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(c.column, c.family, c.fid, c.is_array, c.domain, c.ordinal) for c in catalog(df)]
    schema = "column string, family string, fid int, is_array boolean, domain string, ordinal int"
    return spark.createDataFrame(rows, schema)


def _pos_max(x: Column, is_array: bool) -> Column:
    if is_array:
        return F.max(F.array_max(F.filter(x, lambda v: v > 0)))
    return F.max(F.when(x > 0, x))


def infer_schema(df: DataFrame, row_key: str) -> DataFrame:
    """One aggregate -> long table (column, kind, domain, fid, ordinal,
    vocab, dim).

    int features: vocab = max(positive)+1 (else 1); dim = max array length
    (arrays) or 1 (scalars and all-null columns).
    dense: dim = length of the first non-null row by ``row_key`` (else 1).
    sequence: vocab = max(positive)+1 (else 1); dim unused (1).
    """
    feats = [c for c in catalog(df) if c.kind != "meta"]
    aggs = []
    for c in feats:
        x = F.col(c.column)
        if c.kind == "user_dense":
            vocab = F.lit(0).cast("bigint")
            dim = F.coalesce(F.min_by(F.size(x), F.when(x.isNotNull(), F.col(row_key))), F.lit(1))
        else:
            vocab = F.coalesce(_pos_max(x, c.is_array) + 1, F.lit(1))
            if c.is_array and c.kind != "seq":
                dim = F.coalesce(F.max(F.size(x)), F.lit(1))
            else:
                dim = F.lit(1)
        aggs += [vocab.cast("bigint").alias(f"{c.column}__v"), dim.cast("bigint").alias(f"{c.column}__d")]
    wide = df.agg(*aggs)
    entries = [
        F.struct(
            F.lit(c.column).alias("column"), F.lit(c.kind).alias("kind"),
            F.lit(c.domain).cast("string").alias("domain"), F.lit(c.fid).alias("fid"),
            F.lit(c.ordinal).alias("ordinal"),
            F.col(f"{c.column}__v").alias("vocab"), F.col(f"{c.column}__d").alias("dim"),
        )
        for c in feats
    ]
    return wide.select(F.inline(F.array(*entries)))


def infer_ts_fid(inferred: DataFrame) -> DataFrame:
    """Per sequence domain, the fid with the strictly largest vocab (first
    column wins ties) if that vocab > 1e6, else null."""
    s = inferred.where(F.col("kind") == "seq")
    w = Window.partitionBy("domain").orderBy(F.col("vocab").desc(), F.col("ordinal").asc())
    top = s.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return top.select("domain", F.when(F.col("vocab") > TS_VOCAB_MIN, F.col("fid")).alias("ts_fid"))


def cardinality_flags(inferred: DataFrame, emb_skip_threshold: int = 0, id_threshold: int = 10000) -> DataFrame:
    """Per family, how many features would be skipped (vocab <= 0 or above
    a positive skip threshold) and how many are id-like (vocab > threshold)."""
    v = F.col("vocab")
    fam = F.coalesce(F.col("domain"), F.col("kind"))
    skip = (v <= 0) | ((F.lit(emb_skip_threshold) > 0) & (v > emb_skip_threshold))
    return (
        inferred.where(F.col("kind") != "user_dense")
        .groupBy(fam.alias("family"))
        .agg(
            F.count(F.lit(1)).alias("n_features"),
            F.count_if(skip).alias("n_skip"),
            F.count_if(v > id_threshold).alias("n_id_like"),
        )
    )


def schema_dict(inferred: DataFrame) -> dict:
    """S6 helper: the small inferred table as the schema.json dict (user_int /
    item_int [[fid,vocab,dim]], user_dense [[fid,dim]], seq {domain: ...})."""
    rows = inferred.collect()  # one row per feature column: metadata, not data
    ts = {r["domain"]: r["ts_fid"] for r in infer_ts_fid(inferred).collect()}
    out = {"user_int": [], "item_int": [], "user_dense": [], "seq": {}}
    for r in sorted(rows, key=lambda r: r["fid"]):
        if r["kind"] in ("user_int", "item_int"):
            out[r["kind"]].append([r["fid"], r["vocab"], r["dim"]])
        elif r["kind"] == "user_dense":
            out["user_dense"].append([r["fid"], r["dim"]])
        else:
            d = out["seq"].setdefault(
                r["domain"], {"prefix": f"domain_{r['domain'][-1]}_seq", "ts_fid": ts.get(r["domain"]), "features": []}
            )
            d["features"].append([r["fid"], r["vocab"]])
    return out
