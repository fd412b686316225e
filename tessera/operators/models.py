"""Feature table, selection, MLlib fits, scoring and evaluation.

Models are MLlib estimators (distributed fits); the feature table is one
wide ``select`` built from the catalog.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scalars as S
from tessera.operators import catalog as C
from tessera.operators import joins as J
from tessera.operators import metrics as M
from tessera.operators import newton
from tessera.operators import split as R
from tessera.session import broadcast_if_small, materialize


def features_ml(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """arrays -> mean (A1); sequences -> len/mean/max (A6); user_id and
    item_id -> label codes (F2, fitted on this frame); label_time -> hour and
    weekday (P5); timestamp dropped; numeric nulls/NaN -> 0 (P3). ``ids`` may
    give the frame's ids from a narrower table, so that the fit need not make
    the frame."""
    cat = C.catalog(df)
    arrays = [c.column for c in cat if c.family in ("user_int_array", "user_dense", "item_int_array")]
    seqs = [c.column for c in cat if c.kind == "seq"]
    out = []
    for f in df.schema.fields:
        c = f.name
        if c == "timestamp":
            continue
        if c in arrays:
            integral = f.dataType.elementType.typeName() in ("long", "integer")
            out.append(A.pool_mean(c, integral).alias(f"{c}_mean"))
        elif c in seqs:
            out += [A.length(c).alias(f"{c}_len"), A.pool_mean(c, True).alias(f"{c}_mean"),
                    A.pool_max(c).cast("bigint").alias(f"{c}_max")]
        else:
            out.append(F.col(c))
    if "label_time" in df.columns:
        out += [S.hour_of_day("label_time").alias("label_time_hour"), S.weekday("label_time").alias("label_time_dayofweek")]
    d = df.select(*out)
    keys = [k for k in ("user_id", "item_id") if k in df.columns]
    for key, codes in (J.fit_label_codes_of(df if ids is None else ids, keys) if keys else {}).items():
        d = J.apply_label_codes(d, codes, key)
    num = [n for n, t in d.dtypes if t in ("double", "float")]
    ints = [n for n, t in d.dtypes if t in ("bigint", "int")]
    return d.fillna(0.0, subset=num).fillna(0, subset=ints)


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """one-way ANOVA F statistic per feature from per-class count, mean
    and sample variance: one grouped aggregate over the table (one row per
    class), unpivoted to (feature, class) rows, and one small aggregate."""
    aggs = []
    for c in features:
        aggs += [F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__m"), F.var_samp(c).alias(f"{c}__v")]
    per_class = df.groupBy(label).agg(*aggs)
    long = per_class.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__m").alias("m"), F.col(f"{c}__v").alias("v")) for c in features
    ])))
    n, m = F.col("n"), F.col("m")
    g = long.groupBy("feature").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.sum(n * m * m).alias("nmm"), F.sum(n * m).alias("nm"),
        F.sum(F.coalesce((n - 1) * F.col("v"), F.lit(0.0))).alias("within"),
    )
    between = (F.col("nmm") - F.col("nm") * F.col("nm") / F.col("total")) / (F.col("k") - 1)
    return g.select("feature", (between / (F.col("within") / (F.col("total") - F.col("k")))).alias("f_score"))


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def select_top_k(df: DataFrame, features: Sequence[str], label: str, k: int = 50) -> list[str]:
    """ANOVA top-k (only when there are more than k features)."""
    if len(features) <= k:
        return list(features)
    sel = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="sel",
                                    selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical")
    sel.setSelectionThreshold(k)
    model = sel.fit(assemble(df, features))
    return [features[i] for i in model.selectedFeatures]


def with_balanced_weight(df: DataFrame, label: str, out: str = "weight", fit_on: DataFrame | None = None) -> DataFrame:
    """G16 weights n / (k * n_c), fitted on ``fit_on`` (by default ``df``) and
    attached by the per-class table; a class it lacks gets no weight (null).
    That table is broadcast when measured small: a join by shuffle would put
    all rows of a class into one partition."""
    g = (df if fit_on is None else fit_on).groupBy(F.col(label).alias("_cls")).agg(F.count(F.lit(1)).alias("_nc"))
    every = Window.partitionBy()
    g = g.select("_cls", (F.sum("_nc").over(every) / (F.count(F.lit(1)).over(every) * F.col("_nc"))).alias(out))
    g = materialize(g)
    return df.join(broadcast_if_small(g, g.count(), 64), df[label].eqNullSafe(g["_cls"]), "left").drop("_cls")


def logistic_regression(features: Sequence[str], label: str = "y", C_inv: float = 1.0, n_rows: float | None = None,
                        weight: str | None = "weight") -> Pipeline:
    """L2 logistic regression, C=1, balanced weights, 1000 iterations,
    no standardization. MLlib's regParam is per (weighted) row, so
    regParam = 1 / (C * sum of weights)."""
    reg = 1.0 / (C_inv * n_rows) if n_rows else 0.0
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, regParam=reg, elasticNetParam=0.0,
                            standardization=False, maxIter=1000)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), lr])


def gbt(features: Sequence[str], label: str = "y", max_iter: int = 100, depth: int = 6, lr: float = 0.1,
        subsample: float = 0.8, colsample: float = 0.8, weight: str | None = None, validation: str | None = None,
        seed: int = 42) -> Pipeline:
    """level-wise boosted trees (MLlib). With weights and a validation
    indicator also a depth-capped form of F7; ``boosting`` grows leaf by leaf."""
    kw = dict(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=depth, stepSize=lr,
              subsamplingRate=subsample, featureSubsetStrategy=str(colsample), seed=seed)
    if weight:
        kw["weightCol"] = weight
    if validation:
        kw["validationIndicatorCol"] = validation
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), GBTClassifier(**kw)])


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Positive-class probability and predicted class."""
    t = model.transform(df)
    return t.select(*keep, vector_to_array("probability")[1].alias("prob"), F.col("prediction").cast("int").alias("pred"))


def importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """coefficients (LR: coef and |coef|) or tree importances, sorted desc."""
    m = model.stages[-1]
    if hasattr(m, "coefficients"):
        vals = m.coefficients.toArray().tolist()
        rows = [(f, float(v), abs(float(v))) for f, v in zip(features, vals)]
    else:
        vals = m.featureImportances.toArray().tolist()
        rows = [(f, float(v), float(v)) for f, v in zip(features, vals)]
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    return s.createDataFrame(rows, "feature string, value double, importance double").orderBy(F.col("importance").desc(), "feature")


def kmeans_codebook(df: DataFrame, vec: str, k: int = 256, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """learn a K-entry codebook with MLlib KMeans; returns (code, center)."""
    data = df.select(array_to_vector(F.col(vec)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().createDataFrame(rows, "code long, center array<double>")


def cross_validate(df: DataFrame, id_col: str, label: str, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Refit per stratified fold with weights and penalty from the fold's
    training rows, all folds in one pass a Newton step; (fold, n_train, n_test,
    auc, logloss, accuracy) of each held-out fold."""
    folded = materialize(R.stratified_kfold(df.select(id_col, label, *features), id_col, label, k, seed))
    scored = newton.fit_folds(folded, "fold", label, features, k).score(folded, "fold", ["fold", label])
    scored = materialize(scored.withColumn("label", F.col(label).cast("int")))
    size = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))  # a row a fold
    size = size.withColumn("n_train", F.sum("n_test").over(Window.partitionBy()) - F.col("n_test"))
    table = size.select("fold", "n_train", "n_test").join(M.metric_table(scored, "fold", "label", "prob"), "fold")
    return materialize(table)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds."""
    metrics = ("auc", "logloss", "accuracy")
    long = folds.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics])))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds"))


def penalised_gradient(scored: DataFrame, model: PipelineModel, features: Sequence[str], label: str, weight: str, prob: str = "prob") -> DataFrame:
    """F5 check: one row a coefficient (and the intercept): the gradient of the
    weighted mean loss plus the L2 term, in units of the feature's deviation.
    All are zero at the optimum."""
    lr = model.stages[-1]
    reg, coef = lr.getRegParam(), lr.coefficients.toArray().tolist()
    err = F.col(weight) * (F.col(prob) - F.col(label))
    one = scored.agg(
        F.sum(weight).alias("w"), F.sum(err).alias("g"),
        *[F.sum(err * F.col(c)).alias(f"{c}__g") for c in features], *[F.stddev_pop(c).alias(f"{c}__s") for c in features],
    )
    rows = [F.struct(F.lit("(intercept)").alias("feature"), (F.col("g") / F.col("w")).alias("gradient"))]
    for c, b in zip(features, coef):
        g = F.col(f"{c}__g") / F.col("w") + F.lit(reg * b)
        rows.append(F.struct(F.lit(c).alias("feature"), F.when(F.col(f"{c}__s") > 0, g / F.col(f"{c}__s")).otherwise(F.lit(0.0)).alias("gradient")))
    return one.select(F.inline(F.array(*rows)))
