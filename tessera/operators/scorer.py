"""Scoring by a model that MLlib does not hold.

A scorer is a loader and a batch function. The model's bytes are broadcast (their
size is checked), the loader runs once in a worker process, and the batch
function gets a matrix of at most ``rows`` rows and gives one score each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import BROADCAST_BYTES

_LOADED: dict[str, Any] = {}


@dataclass(frozen=True)
class Scorer:
    """``load`` makes the model of its bytes, ``predict`` scores a matrix
    (rows, features) of doubles; missing values are NaN."""

    features: Sequence[str]
    model: bytes
    load: Callable[[bytes], Any]
    predict: Callable[[Any, np.ndarray], np.ndarray]
    rows: int = 4096

    def __post_init__(self):
        if len(self.model) > 64 * BROADCAST_BYTES:
            raise ValueError(f"a model of {len(self.model)} bytes is too large to be broadcast")

    @staticmethod
    def read(spark: SparkSession, path: str, features: Sequence[str], load: Callable[[bytes], Any], predict: Callable[[Any, np.ndarray], np.ndarray]) -> Scorer:
        """The model file at ``path``, read through Spark wherever it lies."""
        row = spark.read.format("binaryFile").load(path).select("content").first()
        if row is None:
            raise FileNotFoundError(path)
        return Scorer(features, bytes(row["content"]), load, predict)


def score_external(df: DataFrame, scorer: Scorer, keep: Sequence[str], out: str = "prob") -> DataFrame:
    """``keep`` and the score of every row, in Arrow batches. A score count that
    differs from the rows' raises."""
    key = hashlib.sha256(scorer.model).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(scorer.model)
    load, predict, step = scorer.load, scorer.predict, scorer.rows

    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = load(shared.value)
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        parts = [np.asarray(predict(_LOADED[key], x[s : s + step]), float) for s in range(0, len(x), step)]
        got = np.concatenate([np.zeros(0), *parts])
        if len(got) != len(x):
            raise ValueError(f"{len(got)} scores for {len(x)} rows")
        return pa.array(got)

    return df.select(*keep, score(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in scorer.features]).alias(out))
