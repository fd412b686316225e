"""Classification metrics on a scored DataFrame (M1-M11), grouped by any key.

Curve metrics first collapse rows to distinct (group, score) with positive
and negative counts (partial aggregation), then take distributed running
sums (range sort + offsets), so no global window ever sees raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.ordering import grouped_prefix_sums
from tessera.session import broadcast_if_small, materialize

NAN = float("nan")


def _safe_div(a: Column, b: Column, default) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def score_counts(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """(group, score) -> pos, neg counts. NaN scores are excluded (see M9)."""
    return (
        df.where(~F.isnan(F.col(score)) & F.col(score).isNotNull())
        .groupBy(group, score)
        .agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))
    )


def auc(df: DataFrame, group: str, label: str = "label", score: str = "prob", single_class=NAN) -> DataFrame:
    """M1: ROC AUC per group, ties count half. ``single_class`` is the value
    when a group has only one class (NaN in the classic path, 0.0 in the
    deep-training path)."""
    sc = score_counts(df, group, label, score)
    cum = grouped_prefix_sums(sc, group, score, ["neg"])
    contrib = F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") / 2.0)
    g = cum.groupBy(group).agg(F.sum(contrib).alias("_num"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.select(group, F.when(F.col("P") * F.col("N") > 0, F.col("_num") / (F.col("P") * F.col("N"))).otherwise(F.lit(single_class)).alias("auc"))


def logloss(df: DataFrame, group: str, label: str = "label", score: str = "prob") -> DataFrame:
    """M2: mean log-loss with probabilities clipped to [1e-15, 1-1e-15]."""
    p, y = S.clip_prob(score), F.col(label).cast("double")
    ll = -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
    return df.groupBy(group).agg(F.avg(ll).alias("logloss"))


def bce_logits_mean(df: DataFrame, group: str, label: str, logit: str) -> DataFrame:
    """M2 (deep path): mean BCE-with-logits; +inf for an empty group."""
    b = S.bce_with_logits(logit, label)
    g = df.groupBy(group).agg(F.sum(b).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select(group, _safe_div(F.col("s"), F.col("n"), float("inf")).alias("bce"))


def _confusion_counts(df: DataFrame, group: str, label: str, pred: Column) -> DataFrame:
    y = F.col(label)
    return df.groupBy(group).agg(
        F.count_if((y == 1) & (pred == 1)).alias("tp"), F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"), F.count_if((y == 0) & (pred == 0)).alias("tn"),
    )


def threshold_metrics(df: DataFrame, group: str, label: str = "label", score: str = "prob", t: float = 0.5) -> DataFrame:
    """M3: accuracy, precision, recall, F1 of the positive class (0 if undefined)."""
    c = _confusion_counts(df, group, label, S.threshold(score, t))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        group,
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        _safe_div(tp, tp + fp, 0.0).alias("precision"),
        _safe_div(tp, tp + fn, 0.0).alias("recall"),
        _safe_div(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
    )


def confusion_matrix(df: DataFrame, group: str, label: str = "label", score: str = "prob", t: float = 0.5) -> DataFrame:
    """M5: long-form confusion matrix (group, label, pred, n)."""
    return df.groupBy(group, label, S.threshold(score, t).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, group: str, label: str = "label", score: str = "prob", t: float = 0.5) -> DataFrame:
    """M4: per-class precision / recall / F1 / support plus macro and weighted
    averages, from one (group, label, pred) count table."""
    cm = confusion_matrix(df, group, label, score, t)
    rows = []
    for cls in (0, 1):
        tp = F.sum(F.when((F.col(label) == cls) & (F.col("pred") == cls), F.col("n")).otherwise(0))
        pp = F.sum(F.when(F.col("pred") == cls, F.col("n")).otherwise(0))
        sup = F.sum(F.when(F.col(label) == cls, F.col("n")).otherwise(0))
        rows.append(cm.groupBy(group).agg(
            F.lit(str(cls)).alias("cls"), _safe_div(tp, pp, 0.0).alias("precision"), _safe_div(tp, sup, 0.0).alias("recall"),
            _safe_div(2 * tp, pp + sup, 0.0).alias("f1"), sup.alias("support"),
        ))
    per = rows[0].unionByName(rows[1])
    macro = per.groupBy(group).agg(
        F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").alias("support"),
    )
    wsum = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    weighted = per.groupBy(group).agg(
        F.lit("weighted avg").alias("cls"), wsum("precision").alias("precision"), wsum("recall").alias("recall"),
        wsum("f1").alias("f1"), F.sum("support").alias("support"),
    )
    return per.unionByName(macro).unionByName(weighted)


def _desc_curve(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    sc = score_counts(df, group, label, score)
    cum = grouped_prefix_sums(sc, group, score, ["pos", "neg"], descending=True)
    # one row a group, broadcast only if that is measured small; the null group stays
    tot = materialize(cum.groupBy(F.col(group).alias("_g")).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    return cum.join(broadcast_if_small(tot, tot.count(), 128), cum[group].eqNullSafe(F.col("_g"))).drop("_g")


def roc_curve(df: DataFrame, group: str, label: str = "label", score: str = "prob", with_origin: bool = True) -> DataFrame:
    """One ROC point per distinct score (descending thresholds), plus
    the (0, 0) point at threshold +inf as sklearn reports it."""
    c = _desc_curve(df, group, label, score)
    pts = c.select(
        group, F.col(score).alias("threshold"),
        _safe_div(F.col("cum_neg"), F.col("N"), NAN).alias("fpr"), _safe_div(F.col("cum_pos"), F.col("P"), NAN).alias("tpr"),
    )
    if not with_origin:
        return pts
    origin = c.select(group).distinct().select(
        group, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return pts.unionByName(origin)


def pr_curve(df: DataFrame, group: str, label: str = "label", score: str = "prob") -> DataFrame:
    """M7: precision / recall per distinct score (descending thresholds)."""
    c = _desc_curve(df, group, label, score)
    return c.select(
        group, F.col(score).alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        _safe_div(F.col("cum_pos"), F.col("P"), NAN).alias("recall"),
        F.col("pos"), F.col("P"),
    )


def average_precision(df: DataFrame, group: str, label: str = "label", score: str = "prob") -> DataFrame:
    """M7: AP = sum_n (R_n - R_{n-1}) P_n = sum(pos_s * precision_s) / P."""
    c = pr_curve(df, group, label, score)
    return c.groupBy(group).agg(
        _safe_div(F.sum(F.col("pos") * F.col("precision")), F.first("P"), NAN).alias("average_precision")
    )


def best_f1_threshold(df: DataFrame, group: str, label: str = "label", score: str = "prob", lo: int = 10, hi: int = 99) -> DataFrame:
    """M8: best F1 over thresholds i/100, i in [lo, hi]; first max wins.

    Each score is binned to the largest grid index i with i/100 <= score
    (exact double comparisons), so the sweep runs on <= 102 cells per group."""
    p = F.col(score)
    c0 = F.floor(p * 100).cast("int")
    cell = F.when((c0 + 1) / 100.0 <= p, c0 + 1).when(c0 / 100.0 > p, c0 - 1).otherwise(c0)
    cells = (
        df.where(~F.isnan(p) & p.isNotNull())
        .groupBy(group, F.least(F.greatest(cell, F.lit(lo - 1)), F.lit(hi)).alias("cell"))
        .agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))
    )
    grid = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("i"))
    # tp(i) = positives with cell >= i ; the cell table is tiny (<= 92 rows per group)
    j = cells.crossJoin(F.broadcast(grid)).groupBy(group, "i").agg(
        F.sum(F.when(F.col("cell") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("cell") >= F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("P"),
    )
    f1 = _safe_div(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P"), 0.0)
    j = j.withColumn("f1", f1)
    best = j.groupBy(group).agg(F.max_by(F.struct("i", "f1"), F.struct("f1", -F.col("i"))).alias("b"))
    return best.select(group, (F.col("b.i") / 100.0).alias("threshold"), F.col("b.f1").alias("f1"))


def nan_filter(df: DataFrame, score: str = "prob") -> tuple[DataFrame, DataFrame]:
    """M9: (rows with a usable score, count of NaN scores)."""
    bad = F.isnan(F.col(score)) | F.col(score).isNull()
    return df.where(~bad), df.agg(F.count_if(bad).cast("bigint").alias("n_nan"))


def _join_groups(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Left join on the group, where null is a group like any other."""
    right = right.withColumnRenamed(group, "_g")
    return left.join(right, left[group].eqNullSafe(right["_g"]), "left").drop("_g")


def metric_table(df: DataFrame, group: str, label: str = "label", score: str = "prob", single_class=NAN) -> DataFrame:
    """Auc, logloss, accuracy per group (e.g. split)."""
    a = auc(df, group, label, score, single_class)
    ll = logloss(df, group, label, score)
    tm = threshold_metrics(df, group, label, score).select(group, "accuracy")
    return _join_groups(_join_groups(a, ll, group), tm, group)


def split_comparison(metrics_by_split: DataFrame, key: str = "model") -> DataFrame:
    """Metrics pivoted by split and the train - test AUC gap."""
    p = metrics_by_split.groupBy(key).pivot("split", ["train", "val", "test"]).agg(F.first("auc"))
    return p.select(
        key, F.col("train").alias("auc_train"), F.col("val").alias("auc_val"), F.col("test").alias("auc_test"),
        (F.col("train") - F.col("test")).alias("auc_gap"),
    )


_KNOWN = ("auc", "logloss", "accuracy", "precision", "recall", "f1")


def calculate_metrics(df: DataFrame, group: str, names=("auc", "logloss", "accuracy"), label: str = "label",
                      score: str = "prob", t: float = 0.5) -> DataFrame:
    """M3 entry point: the requested metrics per group; unknown names are
    ignored, undefined values come back as NaN (AUC) or 0 (ratios)."""
    want = [n for n in names if n in _KNOWN]
    out = df.select(group).distinct()
    if "auc" in want:
        out = _join_groups(out, auc(df, group, label, score), group)
    if "logloss" in want:
        out = _join_groups(out, logloss(df, group, label, score), group)
    rest = [n for n in want if n in ("accuracy", "precision", "recall", "f1")]
    if rest:
        out = _join_groups(out, threshold_metrics(df, group, label, score, t).select(group, *rest), group)
    return out.select(group, *want)


def history(df: DataFrame, run: str, step: str, label: str = "label", score: str = "prob", logit: str = "logit") -> DataFrame:
    """The metric history of scored rows: one row a (run, step) with the
    mean loss on logits, AUC, logloss and accuracy."""
    d = df.withColumn("_hist", F.concat_ws(":", F.col(run).cast("string"), F.col(step).cast("string")))
    names = d.groupBy("_hist").agg(F.first(run).alias(run), F.first(step).alias(step))
    loss = bce_logits_mean(d, "_hist", label, logit).withColumnRenamed("bce", "loss")
    table = _join_groups(_join_groups(names, loss, "_hist"), metric_table(d, "_hist", label, score), "_hist")
    return table.select(run, step, "loss", "auc", "logloss", "accuracy")
