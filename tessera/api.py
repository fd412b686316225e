"""Public API: the entry points a user of the original toolkit reaches for,
as lazy DataFrame functions (names follow the toolkit's workflow)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import scalars as _S
from tessera.operators import augment as augment  # noqa: F401  (augment.* presets and transforms)
from tessera.operators import boosting as _BO
from tessera.operators import catalog as _C
from tessera.operators import codes as _CO
from tessera.operators import encode as _EN
from tessera.operators import heavy as _HV
from tessera.operators import joins as _J
from tessera.operators import knn as _K
from tessera.operators import metrics as _M
from tessera.operators import models as _ML
from tessera.operators import neighbours as _NB
from tessera.operators import profile as _G
from tessera.operators import ranking as _W
from tessera.operators import scorer as _SC
from tessera.operators import split as _R
from tessera.sources import rowgroups as _RG
from tessera.sources import sinks as _SK


def catalog(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Column families of a wide table."""
    return _C.catalog_df(spark, df)


def infer_schema(df: DataFrame, row_key: str) -> dict:
    """schema.json-style dict inferred in one aggregate job."""
    return _C.schema_dict(_C.infer_schema(df, row_key))


def profile(df: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> dict[str, DataFrame]:
    """Lazy profiling tables (G1, G12, G13); describe / histograms are separate calls."""
    return {
        "basic": _G.basic_info(df, user_col, item_col),
        "missing": _G.missing_values(df),
        "interactions": _G.interaction_summary(df, user_col, item_col),
    }


def features_ml(df: DataFrame) -> DataFrame:
    """Numeric feature table for classic models."""
    return _ML.features_ml(df)


def encode_batch(df: DataFrame, schema: Mapping, max_lens: Mapping[str, int], is_training: bool = True) -> DataFrame:
    """Padded, clipped, time-bucketed model inputs."""
    return _EN.encode_batch(df, schema, max_lens, is_training=is_training)


def time_bucket(ts, now):
    """Time-delta bucket id of a timestamp column against ``now``."""
    return _S.time_bucket(now, ts)


def split(df: DataFrame, id_col: str, label_col: str | None, test_size: float = 0.2, val_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Exact stratified train/val/test split."""
    return _R.stratified_split(df, id_col, label_col, test_size, val_size, seed)


def kfold(df: DataFrame, id_col: str, label_col: str | None, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold column."""
    return _R.stratified_kfold(df, id_col, label_col, k, seed)


def smote(df: DataFrame, id_col: str, cols: Sequence[str], label_col: str, ratio: float = 1.0, k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE oversampling with exact k nearest neighbours."""
    return _K.smote(df, id_col, cols, label_col, 1, ratio, k, seed)


def mixup(df: DataFrame, key_col: str, feat_cols: Sequence[str], label_col: str, alpha: float = 0.2, seed: int = 42) -> DataFrame:
    """Mixup with Beta(alpha, alpha) weights and shuffled partners."""
    return augment.mixup(df, key_col, feat_cols, label_col, alpha, seed)


def fit(pipeline, df: DataFrame):
    """Fit an MLlib pipeline built by ``models.logistic_regression`` / ``models.gbt``."""
    return pipeline.fit(df)


def score(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Positive-class probability and class."""
    return _ML.score(model, df, keep)


def metrics(df: DataFrame, group: str, label: str = "label", score_col: str = "prob") -> DataFrame:
    """AUC, log-loss and accuracy per group."""
    return _M.metric_table(df, group, label, score_col)


def roc(df: DataFrame, group: str, label: str = "label", score_col: str = "prob") -> DataFrame:
    return _M.roc_curve(df, group, label, score_col)


def pr(df: DataFrame, group: str, label: str = "label", score_col: str = "prob") -> DataFrame:
    return _M.pr_curve(df, group, label, score_col)


def threshold(df: DataFrame, group: str, label: str = "label", score_col: str = "prob") -> DataFrame:
    """Best-F1 threshold on the 0.10..0.99 grid (M8)."""
    return _M.best_f1_threshold(df, group, label, score_col)


def topk_runs(df: DataFrame, run: str, metric: str, step: str, k: int = 3) -> DataFrame:
    """Best k steps per run."""
    return _W.top_k_per_group(df, run, metric, step, k)


def early_stop(df: DataFrame, run: str, step: str, value: str, patience: int = 10, min_delta: float = 1e-4, mode: str = "max") -> DataFrame:
    """Early-stopping replay per run."""
    return _W.early_stopping(df, run, step, value, patience, min_delta, mode)


def predictions(df: DataFrame, key: str, prob: str, order: str, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Last-wins predictions per key (S7) and, given the expected ids, the
    missing / extra coverage counts (S11)."""
    p = _SK.dedupe_predictions(df, key, prob, order)
    return p, (_J.coverage(p, expected, key) if expected is not None else None)


def cross_validate(df: DataFrame, id_col: str, label: str, features: Sequence[str], k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Logistic regression refitted per stratified fold (R3): metrics of each
    held-out fold, and their mean and population standard deviation."""
    folds = _ML.cross_validate(df, id_col, label, features, k, seed)
    return folds, _ML.cv_summary(folds)


def history(df: DataFrame, run: str, step: str, label: str = "label", score_col: str = "prob", logit: str = "logit") -> DataFrame:
    """Loss, AUC, log-loss and accuracy per (run, step) of scored rows."""
    return _M.history(df, run, step, label, score_col, logit)


def fit_leafwise(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, validation: str | None = None, **settings) -> _BO.LeafwiseModel:
    """Leaf-wise boosted trees with early stopping by patience."""
    return _BO.fit_leafwise(df, features, label, weight, validation, **settings)


def score_external(df: DataFrame, scorer: _SC.Scorer, keep: Sequence[str]) -> DataFrame:
    """Scores of a model that MLlib does not hold."""
    return _SC.score_external(df, scorer, keep)


def nearest_neighbours(df: DataFrame, id_col: str, vec_col: str, k: int = 10, target_recall: float = 0.95) -> tuple[DataFrame, float]:
    """k nearest neighbours in many dimensions and their measured recall."""
    return _NB.knn_forest(df, id_col, vec_col, k, target_recall)


def nearest_codes(df: DataFrame, key: str, vec: str, codebook: DataFrame, code_key: str, code_vec: str) -> DataFrame:
    """Nearest codebook row, exactly, by few distances."""
    return _CO.nearest_code_pruned(df, key, vec, codebook, code_key, code_vec)


def most_frequent(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values of a column, exactly."""
    return _HV.most_frequent(df, col, n)[0]


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """Row groups of a folder's Parquet files from their footers (S3)."""
    return _RG.row_groups(spark, path)
