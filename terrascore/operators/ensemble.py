"""Ensembles over the long prediction table.

Every ensemble is a ``groupBy(sample_id)`` over the members' rows (each
group holds one row per member, so groups are tiny and evenly spread),
and every ensemble yields the same long shape as the members --
``(sample_id, model, type, y, probability, prediction)`` -- so the metric
operators evaluate members and ensembles together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.operators import metrics as T
from terrascore.operators.ranks import ordinal_rank
from terrascore.session import materialize

KEY = "sample_id"


# Ensemble scores are rounded to this many decimals: a mean of member
# scores is otherwise off by an ulp depending on the (partial-aggregation)
# summation order, which splits ties and makes AUC and ranks unstable.
SCORE_DECIMALS = 12


def _long(df: DataFrame, name: str, score: str = "probability", threshold: float = 0.5) -> DataFrame:
    p = F.round(F.col(score).cast("double"), SCORE_DECIMALS)
    return df.select(KEY, F.lit(name).alias("model"), F.lit("ensemble").alias("type"), "y",
                     p.alias("probability"), (p >= F.lit(threshold)).cast("int").alias("prediction"))


def vote_soft(preds: DataFrame, name: str = "voting_soft") -> DataFrame:
    """N1 mean member probability; class at >= 0.5."""
    g = preds.groupBy(KEY).agg(F.first("y").alias("y"), F.avg("probability").alias("p"))
    return _long(g, name, "p")


def vote_hard(preds: DataFrame, name: str = "voting_hard") -> DataFrame:
    """N2 majority of member classes (a tie goes to the lower class);
    its score is the vote share."""
    g = preds.groupBy(KEY).agg(F.first("y").alias("y"), F.sum("prediction").alias("votes"),
                                F.count(F.lit(1)).alias("n"))
    return g.select(KEY, F.lit(name).alias("model"), F.lit("ensemble").alias("type"), "y",
                    (F.col("votes") / F.col("n")).alias("probability"),
                    (F.lit(2) * F.col("votes") > F.col("n")).cast("int").alias("prediction"))


def weighted_average(preds: DataFrame, weights: Mapping[str, float] | DataFrame | None = None,
                     name: str = "weighted_average") -> DataFrame:
    """N4 sum(w * p) with weights normalised over all given weights;
    members without a weight are skipped; default equal weights.

    The weight table has one row per member model (bounded by the number
    of models), so it is broadcast."""
    wdf = _weight_table(preds, weights)
    j = preds.join(F.broadcast(wdf), "model")
    g = j.groupBy(KEY).agg(F.first("y").alias("y"), F.sum(F.col("w") * F.col("probability")).alias("p"))
    return _long(g, name, "p")


def _weight_table(preds: DataFrame, weights: Mapping[str, float] | DataFrame | None) -> DataFrame:
    """(model, w) with the weights' sum 1."""
    if weights is None:
        models = [r[0] for r in preds.select("model").distinct().collect()]
        weights = {m: 1.0 / len(models) for m in models}
    if isinstance(weights, Mapping):
        wdf = preds.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "model string, w double")
    else:
        wdf = weights.select(F.col(weights.columns[0]).alias("model"),
                             F.col(weights.columns[1]).cast("double").alias("w"))
    total = F.sum("w").over(_all())
    return wdf.select("model", (F.col("w") / total).alias("w"))


def _all():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(1))  # over the member-weight table only


def auc_weights(preds: DataFrame) -> DataFrame:
    """N5 weight = AUC^2 per member."""
    a = T.roc_auc(preds)
    return a.select("model", F.pow(F.col("roc_auc"), 2).alias("weight"))


def mean_ranks(preds: DataFrame) -> DataFrame:
    """(sample_id, y, avg_rank): mean over members of the ordinal rank."""
    r = ordinal_rank(preds, ["probability", KEY], ["model"], out="rank")
    return r.groupBy(KEY).agg(F.first("y").alias("y"), F.avg(F.col("rank").cast("double")).alias("avg_rank"))


def rank_average(preds: DataFrame, name: str = "rank_average") -> DataFrame:
    """N6 ascending ordinal rank per member (ties by sample id), mean over
    members, divided by the largest mean rank.

    Ranks come from the distributed prefix-sum helper (a member's rows are
    spread over many partitions); the normaliser is one scalar aggregate."""
    g = mean_ranks(preds)
    mx = g.agg(F.max("avg_rank")).collect()[0][0]
    s = g.select(KEY, "y", (F.col("avg_rank") / F.lit(float(mx or 1.0))).alias("p"))
    return _long(s, name, "p")


def ensemble_scores(ens: DataFrame, hard: Sequence[str] = ("voting_hard",)) -> DataFrame:
    """N8 accuracy, F1 and AUC per ensemble at >= 0.5; a hard-vote ensemble
    reports AUC 0.0."""
    m = T.classification_metrics(ens)
    a = T.roc_auc(ens)
    j = m.join(a, "model", "left")
    auc = F.when(F.col("model").isin(list(hard)), F.lit(0.0)).otherwise(F.col("roc_auc"))
    return j.select("model", "accuracy", "f1_score", auc.alias("roc_auc"))


def ensemble_summary(scores: DataFrame) -> DataFrame:
    """N10 (Ensemble_Method, ROC_AUC, Accuracy, F1_Score) sorted by AUC desc."""
    return (scores.select(F.col("model").alias("Ensemble_Method"), F.col("roc_auc").alias("ROC_AUC"),
                          F.col("accuracy").alias("Accuracy"), F.col("f1_score").alias("F1_Score"))
                  .orderBy(F.desc("ROC_AUC"), F.asc("Ensemble_Method")))


def all_ensembles(preds: DataFrame, weights: Mapping[str, float] | DataFrame | None = None) -> DataFrame:
    """N1, N2, N4, N6 in one long table (stacking/blending need fitted
    models, see ``models.stack``).

    The rows of each are those of ``vote_soft``, ``vote_hard``,
    ``weighted_average`` and ``rank_average``.  The ranked predictions are
    grouped by sample once for all four, and the groups are written, as
    the largest mean rank and the metrics read them."""
    w = _weight_table(preds, weights if weights is not None else auc_weights(preds))
    w = w.groupBy("model").agg(F.sum("w").alias("__w"), F.lit(1).alias("__known"))
    r = ordinal_rank(preds, ["probability", KEY], ["model"], out="__rank").join(F.broadcast(w), "model", "left")
    g = materialize(r.groupBy(KEY).agg(
        F.first("y").alias("y"), F.avg("probability").alias("soft"), F.sum("prediction").alias("votes"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("__w") * F.col("probability")).alias("weighted"), F.count("__known").alias("known"),
        F.avg(F.col("__rank").cast("double")).alias("avg_rank")), "ensembles")
    mx = g.agg(F.max("avg_rank")).collect()[0][0]

    def row(name, p, prediction=None):
        return F.struct(F.lit(name).alias("model"), F.lit("ensemble").alias("type"), "y", p.alias("probability"),
                        (prediction if prediction is not None else p >= F.lit(0.5)).cast("int").alias("prediction"))

    soft, weighted, rank = (F.round(c, SCORE_DECIMALS) for c in ("soft", "weighted", F.col("avg_rank") / F.lit(float(mx or 1.0))))
    rows = F.array(row("voting_soft", soft), row("voting_hard", F.col("votes") / F.col("n"), F.lit(2) * F.col("votes") > F.col("n")),
                   row("weighted_average", weighted), row("rank_average", rank))
    # members without a weight are skipped
    return g.select(KEY, "known", F.inline(rows)).where("known > 0 OR model <> 'weighted_average'").drop("known")
