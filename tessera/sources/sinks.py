"""Sidecars and sinks (S5-S10). Paths are shared storage (the checkpoint
dir's parent on a cluster, or any path the caller gives); nothing is
written to machine-local temp folders."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-out/{name}-{uuid.uuid4().hex[:12]}"


def write_json_sidecar(spark: SparkSession, obj: dict, path: str) -> None:
    """Write a small JSON document (schema.json, ns_groups.json) as one file."""
    spark.createDataFrame([(json.dumps(obj),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON sidecar (multi-line) as a one-row DataFrame."""
    return spark.read.option("multiLine", True).json(path)


def schema_catalog(sidecar: DataFrame) -> DataFrame:
    """Schema.json -> long catalog (kind, domain, fid, vocab, dim): int and
    dense features, and the features of every sequence domain."""
    none = F.lit(None)
    ints = [
        sidecar.select(F.lit(k).alias("kind"), F.explode(k).alias("e")).select(
            "kind", none.cast("string").alias("domain"), F.col("e")[0].alias("fid"), F.col("e")[1].alias("vocab"), F.col("e")[2].alias("dim"))
        for k in ("user_int", "item_int")
    ]
    dense = sidecar.select(F.lit("user_dense").alias("kind"), F.explode("user_dense").alias("e")).select(
        "kind", none.cast("string").alias("domain"), F.col("e")[0].alias("fid"), none.cast("long").alias("vocab"), F.col("e")[1].alias("dim"))
    out = ints[0].unionByName(ints[1]).unionByName(dense)
    domains = sidecar.schema["seq"].dataType.names if "seq" in sidecar.columns else []
    for d in domains:
        seq = sidecar.select(F.explode(F.col(f"seq.{d}.features")).alias("e"))
        out = out.unionByName(seq.select(F.lit("seq").alias("kind"), F.lit(d).alias("domain"), F.col("e")[0].alias("fid"), F.col("e")[1].alias("vocab"), none.cast("long").alias("dim")))
    return out


def parse_groups(sidecar: DataFrame) -> dict[str, list[int]]:
    """A one-row groups sidecar as {group: member fids} (a schema, not data)."""
    row = sidecar.first()
    return {g: list(row[g]) for g in sidecar.columns if row[g] is not None}


def dedupe_predictions(df: DataFrame, key: str, prob: str, order: str) -> DataFrame:
    """One probability per key; a later row (by ``order``) wins."""
    return df.groupBy(key).agg(F.max_by(F.col(prob), F.col(order)).alias(prob))


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines {key, prob} (scales with the data; no driver map)."""
    df.write.mode("overwrite").json(path)


def write_results(metrics_long: DataFrame, path: str) -> None:
    """Long metrics table (run, split, metric, value) as JSON."""
    metrics_long.write.mode("overwrite").json(path)


def write_importance_csv(importance: DataFrame, path: str) -> None:
    """Importance sorted descending, CSV with header."""
    importance.orderBy(F.col("importance").desc(), "feature").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path: str) -> None:
    """Persist a fitted PipelineModel."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def probability_range_ok(df: DataFrame, prob: str) -> DataFrame:
    """Count of probabilities outside [0, 1] or NaN."""
    p = F.col(prob)
    return df.agg(F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).cast("bigint").alias("n_bad_prob"))



def resolve_sidecar(spark: SparkSession, name: str, *dirs: str) -> DataFrame:
    """Read sidecar ``name`` from the first directory that has it (model
    directory first, then the data directory)."""
    from pyspark.errors import AnalysisException

    last = None
    for d in dirs:
        try:
            return read_json_sidecar(spark, f"{d.rstrip('/')}/{name}")
        except AnalysisException as e:  # path does not exist
            last = e
    raise FileNotFoundError(f"{name} not found in {dirs}") from last
