"""Model metrics over a long prediction table.

Input shape (one row per sample and model):
``(sample_id, model, [type], y, probability, prediction)``.  Every metric
is grouped by the model columns, so all models are evaluated in the same
jobs.

Curves and AUC first collapse ties with ``groupBy(model, probability)``
(map-side combine: the table shrinks to distinct scores per model), then
take running sums with the distributed prefix-sum helper -- never a
window that pulls a whole model into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.operators.ranks import prefix_sum

MODEL = ["model"]


def _div(a: Column, b: Column) -> Column:
    """a / b with 0 on a zero denominator (the reference's zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_counts(preds: DataFrame, keys: Sequence[str] = MODEL, score: str = "probability",
                 label: str = "y") -> DataFrame:
    """(keys, score, pos, neg): labels counted per distinct score."""
    y = F.col(label).cast("long")
    return preds.groupBy(*keys, score).agg(F.sum(y).alias("pos"),
                                           F.sum(F.lit(1) - y).alias("neg"))


def roc_auc(preds: DataFrame, keys: Sequence[str] = MODEL, score: str = "probability",
            label: str = "y") -> DataFrame:
    """T1 exact ROC-AUC (ties count 1/2) per key; NULL when one class is absent."""
    keys = list(keys)
    sc = score_counts(preds, keys, score, label)
    cum = prefix_sum(sc, [score], ["neg"], group_cols=keys)
    contrib = F.col("pos") * ((F.col("neg_cum") - F.col("neg")) + F.col("neg") * F.lit(0.5))
    agg = cum.groupBy(*keys).agg(F.sum(contrib).alias("u"), F.sum("pos").alias("P"),
                                 F.sum("neg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0),
                 F.col("u") / (F.col("P").cast("double") * F.col("N").cast("double")))
    return agg.select(*keys, auc.alias("roc_auc"))


def confusion_matrix(preds: DataFrame, keys: Sequence[str] = MODEL, label: str = "y",
                     prediction: str = "prediction") -> DataFrame:
    """T2 tn/fp/fn/tp per key."""
    y, p = F.col(label), F.col(prediction)
    return preds.groupBy(*keys).agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"))


def derived_metrics(cm: DataFrame) -> DataFrame:
    """T3 from a confusion table: accuracy, precision, recall, F1,
    specificity, sensitivity (0 on a zero denominator)."""
    tn, fp = F.col("true_negatives"), F.col("false_positives")
    fn, tp = F.col("false_negatives"), F.col("true_positives")
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return cm.select(
        "*",
        _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        _div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1_score"),
        _div(tn, tn + fp).alias("specificity"),
        rec.alias("sensitivity"))


def classification_metrics(preds: DataFrame, keys: Sequence[str] = MODEL, label: str = "y",
                           prediction: str = "prediction") -> DataFrame:
    return derived_metrics(confusion_matrix(preds, keys, label, prediction))


def _desc_cum(preds, keys, score, label):
    sc = score_counts(preds, keys, score, label).withColumn("__neg_s", -F.col(score))
    cum = prefix_sum(sc, ["__neg_s"], ["pos", "neg"], group_cols=keys)
    # the written running sums end with the totals
    tot = cum.groupBy(*keys).agg(F.max("pos_cum").alias("P"), F.max("neg_cum").alias("N"))
    return cum.join(F.broadcast(tot), list(keys)).withColumnRenamed("pos_cum", "tps").withColumnRenamed("neg_cum", "fps")


def roc_curve(preds: DataFrame, keys: Sequence[str] = MODEL, score: str = "probability",
              label: str = "y") -> DataFrame:
    """T4 one point per distinct threshold (score >= t), plus the start
    point (threshold +inf, fpr 0, tpr 0).  All points are kept."""
    keys = list(keys)
    c = _desc_cum(preds, keys, score, label)
    pts = c.select(*keys, F.col(score).cast("double").alias("threshold"),
                   _div(F.col("fps"), F.col("N")).alias("fpr"), _div(F.col("tps"), F.col("P")).alias("tpr"))
    start = (c.select(*keys).distinct()
             .select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                     F.lit(0.0).alias("tpr")))
    return pts.unionByName(start)


def pr_curve(preds: DataFrame, keys: Sequence[str] = MODEL, score: str = "probability",
             label: str = "y") -> DataFrame:
    """T5 precision/recall per threshold down to the first one reaching full
    recall, plus the end point (threshold NULL, recall 0, precision 1)."""
    keys = list(keys)
    every = _desc_cum(preds, keys, score, label)
    c = every.where(F.col("tps") - F.col("pos") < F.col("P"))
    pts = c.select(*keys, F.col(score).cast("double").alias("threshold"),
                   _div(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
                   _div(F.col("tps"), F.col("P")).alias("recall"))
    end = (every.select(*keys).distinct()
           .select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                   F.lit(0.0).alias("recall")))
    return pts.unionByName(end)


def average_precision(preds: DataFrame, keys: Sequence[str] = MODEL, score: str = "probability",
                      label: str = "y") -> DataFrame:
    """T6 step-wise AP = sum_n (R_n - R_{n-1}) P_n = sum(pos_n * precision_n) / P."""
    keys = list(keys)
    c = _desc_cum(preds, keys, score, label)
    prec = F.col("tps") / (F.col("tps") + F.col("fps"))
    return (c.groupBy(*keys).agg(F.sum(F.col("pos") * prec).alias("s"), F.max("P").alias("P"))
             .select(*keys, F.when(F.col("P") > 0, F.col("s") / F.col("P")).alias("average_precision")))


def calibration_edges(n_bins: int = 10) -> list[float]:
    """Inner edges of ``n_bins`` uniform bins on [0, 1] (linspace values)."""
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]


def calibration_bin(score: str = "probability", n_bins: int = 10) -> Column:
    """Bin id = number of inner edges strictly below the score
    (right-closed bins, 0 in the first)."""
    s = F.col(score)
    return sum((F.when(s > F.lit(e), F.lit(1)).otherwise(F.lit(0)) for e in calibration_edges(n_bins)),
               F.lit(0))


def calibration_curve(preds: DataFrame, keys: Sequence[str] = MODEL, score: str = "probability",
                      label: str = "y", n_bins: int = 10) -> DataFrame:
    """T7 mean predicted probability and positive share per non-empty bin."""
    return (preds.withColumn("bin", calibration_bin(score, n_bins))
                 .groupBy(*keys, "bin")
                 .agg(F.avg(score).alias("mean_predicted"),
                      F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                      F.count(F.lit(1)).alias("n")))


def evaluate_models(preds: DataFrame, keys: Sequence[str] = ("type", "model"),
                    hard: Sequence[str] = ("voting_hard",)) -> DataFrame:
    """T8 one metric row per (type, model): confusion, derived metrics, AUC.
    A hard vote decides classes, so its AUC is that of the class."""
    keys = list(keys)
    m = classification_metrics(preds, keys)
    score = F.when(F.col("model").isin(list(hard)), F.col("prediction").cast("double")).otherwise(F.col("probability"))
    a = roc_auc(preds.withColumn("probability", score), keys)
    return m.join(a, keys, "left")


def top_models(metrics: DataFrame, n: int, by: str = "roc_auc") -> DataFrame:
    """T9/T10 top-n by a metric (ties by model name); the metric table has
    one row per model."""
    return metrics.orderBy(F.desc_nulls_last(by), F.asc("model")).limit(n)


def metric_matrix(metrics: DataFrame, keys: Sequence[str] = MODEL,
                  names: Sequence[str] = ("accuracy", "precision", "recall", "f1_score",
                                          "roc_auc", "specificity")) -> DataFrame:
    """T11/T14 long (model, metric, value)."""
    arr = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                    for n in names])
    return metrics.select(*keys, F.inline(arr))


def best_model(metrics: DataFrame, order: Sequence[str] | None = None, by: str = "roc_auc") -> DataFrame:
    """T12 first model with the maximal metric; ``order`` is the insertion
    order that breaks ties (default: model name)."""
    if order:
        pos = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    else:
        pos = F.lit(0)
    m = metrics.withColumn("__ord", -pos)
    if not order:
        return (m.orderBy(F.desc_nulls_last(by), F.asc("model")).limit(1)
                 .select("model", F.col(by)))
    return m.agg(F.max_by("model", F.struct(F.col(by), F.col("__ord"))).alias("model"),
                 F.max(by).alias(by))


def count_by_type(metrics: DataFrame) -> DataFrame:
    """T15 models per type."""
    return metrics.groupBy("type").agg(F.count(F.lit(1)).alias("n_models"))


PROFILE = ("accuracy", "precision", "recall", "f1_score", "specificity")


def best_model_profile(metrics: DataFrame, by: str = "roc_auc", names: Sequence[str] = PROFILE) -> DataFrame:
    """T14 (model, metric, value) of the model with the highest ``by`` (ties by
    type and name: the metric table has one row per model)."""
    first = metrics.orderBy(F.desc_nulls_last(by), F.desc("type"), F.asc("model")).limit(1)
    return metric_matrix(first, names=names)


def report_sections(metrics: DataFrame, importance: DataFrame, top: int = 20) -> DataFrame:
    """T13 the evaluation report as one table (section, type, model, item, value,
    text): ``summary`` (models in all and by type, the best one and its AUC),
    ``metrics`` and ``confusion`` of every model, the ``top`` importances
    (model, feature, importance, rank) and ``recommendations`` worded from the
    best model's figures."""
    none = F.lit(None).cast("string")
    first = metrics.orderBy(F.desc_nulls_last("roc_auc"), F.desc("type"), F.asc("model")).limit(1)
    counts = metrics.agg(*[F.count(c).cast("double").alias(n) for n, c in (
        ("total_models", F.lit(1)), ("individual_models", F.when(F.col("type") == "individual", 1)),
        ("ensemble_models", F.when(F.col("type") == "ensemble", 1)))])

    def shaped(df, section, type_, model, item, value, text=none):
        return df.select(F.lit(section).alias("section"), type_.alias("type"), model.alias("model"), item.alias("item"),
                         value.cast("double").alias("value"), text.alias("text"))

    def listed(df, *pairs):
        return df.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("_item"), c.cast("double").alias("_value"), t.alias("_text")) for n, c, t in pairs])))

    totals = listed(counts, *[(n, F.col(n), none) for n in ("total_models", "individual_models", "ensemble_models")])
    best = listed(first, ("best_roc_auc", F.col("roc_auc"), F.col("model")))
    words = [("best", F.col("roc_auc"), F.format_string("%s has the highest ROC-AUC, %.4f", F.col("model"), F.col("roc_auc"))),
             ("recall", F.col("recall"), F.format_string("it finds %.2f%% of the prospective samples", F.col("recall") * 100)),
             ("specificity", F.col("specificity"), F.format_string("it clears %.2f%% of the barren samples", F.col("specificity") * 100)),
             ("type", F.lit(None), F.format_string("the best model is of type %s", F.col("type")))]
    shapes = [shaped(totals, "summary", none, none, F.col("_item"), F.col("_value")),
              shaped(best, "summary", F.col("type"), F.col("model"), F.col("_item"), F.col("_value"), F.col("_text"))]
    for section, names in (("metrics", ("accuracy", "precision", "recall", "f1_score", "roc_auc", "specificity", "sensitivity")),
                           ("confusion", ("true_positives", "false_positives", "true_negatives", "false_negatives"))):
        shapes.append(shaped(metric_matrix(metrics, ["type", "model"], names), section, F.col("type"), F.col("model"), F.col("metric"), F.col("value")))
    shapes.append(shaped(importance.where(F.col("rank") <= top), "importance", F.lit("individual"), F.col("model"), F.col("feature"), F.col("importance")))
    shapes.append(shaped(listed(first, *words), "recommendations", F.col("type"), F.col("model"), F.col("_item"), F.col("_value"), F.col("_text")))
    out = shapes[0]
    for x in shapes[1:]:
        out = out.unionByName(x)
    return out
