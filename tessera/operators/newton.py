"""Logistic regressions of all folds at once (R3 with F5).

A row outside a fold belongs to that fold's training rows, so it adds to the
sums of every model but one. One pass over the rows a Newton step gives the
loss, the gradient X'g and the Hessian X'WX of all models: each task sums over
its rows, one aggregate adds the tasks, and the driver solves k small systems
(features + 1 squared numbers a model, whatever the rows). A model whose
penalised loss went up goes back half its step.

Same problem as the pipeline fit: L2 penalty 1/2 |b|^2 / C on the coefficients as
they stand (not of the intercept), rows weighted. Centring and scaling only help
the arithmetic; the penalty is carried over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

_SUMS = "cell long, v double"


@dataclass
class FoldModels:
    """Coefficients (folds, features) and intercepts of the models that leave
    out one fold each; ``steps`` passes were taken."""

    features: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    steps: int
    gradient: float

    def score(self, df: DataFrame, fold: str, keep: Sequence[str]) -> DataFrame:
        """``keep`` and the probability by the model that left out the row's fold."""
        model = df.sparkSession.sparkContext.broadcast((self.coefficients, self.intercepts))

        @F.arrow_udf("double")
        def prob(of: pa.Array, *columns: pa.Array) -> pa.Array:
            b, b0 = model.value
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
            k = of.to_numpy(zero_copy_only=False).astype(np.int64)
            return pa.array(1 / (1 + np.exp(-((x * b[k]).sum(axis=1) + b0[k]))))

        return df.select(*keep, prob(F.col(fold), *[F.col(c).cast("double") for c in self.features]).alias("prob"))


def fold_weights(df: DataFrame, fold: str, label: str, k: int) -> np.ndarray:
    """(k, 2) balanced weights n / (2 n_c) of the classes 0 and 1 among the rows
    outside each fold; 0 for a class without rows."""
    n = np.zeros((k, 2))
    for r in df.groupBy(fold, label).count().collect():  # folds x classes rows
        n[r[fold], int(r[label])] += r["count"]
    out = n.sum(axis=0) - n
    with np.errstate(divide="ignore"):
        return np.where(out > 0, out.sum(axis=1, keepdims=True) / (np.count_nonzero(out, axis=1)[:, None] * np.maximum(out, 1)), 0.0)


def fit_folds(df: DataFrame, fold: str, label: str, features: Sequence[str], k: int, C: float = 1.0, max_steps: int = 60, tol: float = 1e-10) -> FoldModels:
    """The models of all ``k`` folds (0 to k - 1), with balanced class weights
    of each model's training rows, label 0 or 1, numbers without nulls. Ends when
    no model's squared Newton decrement is above ``tol``."""
    d = len(features) + 1
    x = [F.col(c).cast("double") for c in features]
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(d - 1)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(d - 1)])
    weights = fold_weights(df, fold, label, k)
    penalty = np.r_[0.0, 1 / (C * scale**2)]
    rows = materialize(df.select(F.col(fold).cast("long").alias("fold"), F.col(label).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]))

    def sums(beta: np.ndarray, open_models: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shared = rows.sparkSession.sparkContext.broadcast((beta, open_models, weights, mean, scale))
        width = 1 + d + d * d

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, models, w, m, s = shared.value
            acc = np.zeros((len(models), width))
            for batch in batches:
                of, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                z = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(d - 1)], axis=1)
                z = np.hstack([np.ones((len(z), 1)), (z - m) / s])
                for j, model in enumerate(models):
                    t = of != model
                    zt, yt = z[t], y[t]
                    wt = w[model][yt.astype(np.int64)]
                    margin = zt @ b[model]
                    p = 1 / (1 + np.exp(-margin))
                    acc[j, 0] += (wt * (np.logaddexp(0, margin) - yt * margin)).sum()
                    acc[j, 1 : 1 + d] += zt.T @ (wt * (p - yt))
                    acc[j, 1 + d :] += ((zt * (wt * p * (1 - p))[:, None]).T @ zt).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(acc.size)), pa.array(acc.ravel())], ["cell", "v"])

        got = rows.mapInArrow(run, _SUMS).groupBy("cell").agg(F.sum("v").alias("v")).toArrow()  # models x features^2 rows
        flat = np.zeros(len(open_models) * width)
        flat[got["cell"].to_numpy()] = got["v"].to_numpy()
        flat = flat.reshape(len(open_models), width)
        at = beta[open_models]
        loss = flat[:, 0] + 0.5 * (penalty * at**2).sum(axis=1)
        return loss, flat[:, 1 : 1 + d] + penalty * at, flat[:, 1 + d :].reshape(-1, d, d) + np.diag(penalty)

    beta, before = np.zeros((k, d)), np.zeros((k, d))
    last = np.full(k, np.inf)
    slope = np.zeros(k)
    open_models, steps = list(range(k)), 0
    while open_models and steps < max_steps:
        steps += 1
        loss, gradient, hessian = sums(beta, open_models)
        going = []
        for j, model in enumerate(open_models):
            if loss[j] > last[model] * (1 + 1e-12) + 1e-12:
                beta[model] = (beta[model] + before[model]) / 2
                going.append(model)
                continue
            # the intercept's row keeps the system regular but for a class without rows
            step = np.linalg.lstsq(hessian[j], gradient[j], rcond=None)[0]
            last[model], slope[model] = loss[j], gradient[j] @ step
            if slope[model] > tol:
                before[model] = beta[model]
                beta[model] = beta[model] - step
                going.append(model)
        open_models = going
    coefficients = beta[:, 1:] / scale
    return FoldModels(list(features), coefficients, beta[:, 0] - coefficients @ mean, steps, float(slope.max(initial=0.0)))
