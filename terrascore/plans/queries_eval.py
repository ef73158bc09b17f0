"""Queries over metrics (2.8) and ensembles (2.7), on the predictions view."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from terrascore.operators import ensemble as N
from terrascore.operators import metrics as T
from terrascore.plans import sqltext as Q
from terrascore.plans.registry import query
from terrascore.session import materialize
from terrascore.sources.fixtures import predictions


def preds(spark, sf):
    """The long prediction table, written once to the checkpoint folder:
    the metric and ensemble queries read it in several jobs (member AUCs,
    ranks, normalisers, final metrics), as the training workflow does."""
    from terrascore.session import materialize

    return materialize(predictions(spark, sf).withColumn("type", F.lit("individual")), "predictions")


def rnd(df, n=6):
    return df.select(*[F.round(F.col(f.name), n).alias(f.name)
                       if isinstance(f.dataType, (T_.DoubleType, T_.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


SP = Q.SP.rstrip()
SC_CTE = ("sc AS (SELECT model, probability, CAST(SUM(y) AS DOUBLE) AS pos, CAST(SUM(1 - y) AS DOUBLE) AS neg "
          "FROM predictions GROUP BY model, probability)")
AUC_CTE = SC_CTE + """,
ac AS (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY probability
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM sc),
auc AS (SELECT model, SUM(pos * (neg_cum - neg + neg * 0.5)) / (SUM(pos) * SUM(neg)) AS roc_auc
        FROM ac GROUP BY model)"""
DESC_CTE = SC_CTE + """,
dc AS (SELECT *, SUM(pos) OVER w AS tps, SUM(neg) OVER w AS fps,
              SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N
       FROM sc WINDOW w AS (PARTITION BY model ORDER BY probability DESC
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
CM_SELECT = """COUNT(*) FILTER (WHERE y = 0 AND prediction = 0) AS true_negatives,
  COUNT(*) FILTER (WHERE y = 0 AND prediction = 1) AS false_positives,
  COUNT(*) FILTER (WHERE y = 1 AND prediction = 0) AS false_negatives,
  COUNT(*) FILTER (WHERE y = 1 AND prediction = 1) AS true_positives"""


def _d(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


DERIVED = ", ".join([
    f"ROUND({_d('true_positives + true_negatives', 'true_positives + true_negatives + false_positives + false_negatives')}, 6) AS accuracy",
    f"ROUND({_d('true_positives', 'true_positives + false_positives')}, 6) AS precision",
    f"ROUND({_d('true_positives', 'true_positives + false_negatives')}, 6) AS recall",
    f"ROUND({_d('2.0 * true_positives', '2.0 * true_positives + false_positives + false_negatives')}, 6) AS f1_score",
    f"ROUND({_d('true_negatives', 'true_negatives + false_positives')}, 6) AS specificity",
    f"ROUND({_d('true_positives', 'true_positives + false_negatives')}, 6) AS sensitivity"])
METRICS_CTE = (f"cm AS (SELECT 'individual' AS type, model, {CM_SELECT} FROM predictions GROUP BY model),\n"
               f"met AS (SELECT cm.*, {DERIVED}, ROUND(auc.roc_auc, 6) AS roc_auc "
               f"FROM cm LEFT JOIN auc USING (model))")


@query("roc_auc", SP + ",\n" + AUC_CTE + "\nSELECT model, ROUND(roc_auc, 6) AS roc_auc FROM auc")
def q_roc_auc(spark, sf):
    return rnd(T.roc_auc(preds(spark, sf)))


@query("confusion_matrix", SP + f"\nSELECT model, {CM_SELECT} FROM predictions GROUP BY model")
def q_confusion_matrix(spark, sf):
    return T.confusion_matrix(preds(spark, sf))


@query("classification_metrics", SP + f",\ncm AS (SELECT model, {CM_SELECT} FROM predictions GROUP BY model)\n"
       f"SELECT cm.*, {DERIVED} FROM cm")
def q_classification_metrics(spark, sf):
    return rnd(T.classification_metrics(preds(spark, sf)))


@query("roc_curve", SP + ",\n" + DESC_CTE + """
SELECT model, probability AS threshold, ROUND(fps / N, 6) AS fpr, ROUND(tps / P, 6) AS tpr FROM dc
UNION ALL
SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM predictions""")
def q_roc_curve(spark, sf):
    return rnd(T.roc_curve(preds(spark, sf)))


@query("pr_curve", SP + ",\n" + DESC_CTE + """
SELECT model, probability AS threshold, ROUND(tps / (tps + fps), 6) AS precision, ROUND(tps / P, 6) AS recall
FROM dc WHERE tps - pos < P
UNION ALL
SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM predictions""")
def q_pr_curve(spark, sf):
    return rnd(T.pr_curve(preds(spark, sf)))


@query("average_precision", SP + ",\n" + DESC_CTE + """
SELECT model, ROUND(SUM(pos * tps / (tps + fps)) / MAX(P), 6) AS average_precision FROM dc GROUP BY model""")
def q_average_precision(spark, sf):
    return rnd(T.average_precision(preds(spark, sf)))


# ten equal bins, right-closed: the number of edges below the score
_BIN_SQL = "CAST(list_sum([CASE WHEN probability > i * CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END FOR i IN range(1, 10)]) AS INTEGER)"


@query("calibration_curve", SP + f"""
SELECT model, {_BIN_SQL} AS bin, ROUND(AVG(probability), 6) AS mean_predicted,
       ROUND(AVG(CAST(y AS DOUBLE)), 6) AS fraction_positive, COUNT(*) AS n
FROM predictions GROUP BY model, bin""")
def q_calibration_curve(spark, sf):
    return rnd(T.calibration_curve(preds(spark, sf)))


@query("evaluate_models", SP + ",\n" + AUC_CTE + ",\n" + METRICS_CTE + "\nSELECT * FROM met")
def q_evaluate_models(spark, sf):
    return rnd(T.evaluate_models(preds(spark, sf)))


@query("top_models", SP + ",\n" + AUC_CTE + ",\n" + METRICS_CTE +
       "\nSELECT * FROM met ORDER BY roc_auc DESC, model LIMIT 2")
def q_top_models(spark, sf):
    return T.top_models(rnd(T.evaluate_models(preds(spark, sf))), 2)


@query("top_models_f1", SP + ",\n" + AUC_CTE + ",\n" + METRICS_CTE +
       "\nSELECT * FROM met ORDER BY f1_score DESC, model LIMIT 2")
def q_top_models_f1(spark, sf):
    return T.top_models(rnd(T.evaluate_models(preds(spark, sf))), 2, by="f1_score")


_MM = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "specificity"]


@query("metric_matrix", SP + ",\n" + AUC_CTE + ",\n" + METRICS_CTE + "\n" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM met" for m in _MM))
def q_metric_matrix(spark, sf):
    return T.metric_matrix(rnd(T.evaluate_models(preds(spark, sf))))


@query("best_model", SP + ",\n" + AUC_CTE + """
SELECT model, ROUND(roc_auc, 6) AS roc_auc FROM auc ORDER BY roc_auc DESC, model LIMIT 1""")
def q_best_model(spark, sf):
    m = rnd(T.roc_auc(preds(spark, sf)))
    return T.best_model(m, order=["m_a", "m_b", "m_c"])


# ---------------------------------------------------------------- ensembles

ENS_SQL = {
    "voting_soft": """SELECT sample_id, 'voting_soft' AS model, 'ensemble' AS type, MIN(y) AS y,
        ROUND(AVG(probability), 12) AS probability,
        CAST(ROUND(AVG(probability), 12) >= 0.5 AS INTEGER) AS prediction
      FROM predictions GROUP BY sample_id""",
    "voting_hard": """SELECT sample_id, 'voting_hard' AS model, 'ensemble' AS type, MIN(y) AS y,
        CAST(SUM(prediction) AS DOUBLE) / COUNT(*) AS probability,
        CAST(2 * SUM(prediction) > COUNT(*) AS INTEGER) AS prediction
      FROM predictions GROUP BY sample_id""",
    "weighted_average": """SELECT sample_id, 'weighted_average' AS model, 'ensemble' AS type, MIN(y) AS y,
        ROUND(SUM(w.w * p.probability), 12) AS probability,
        CAST(ROUND(SUM(w.w * p.probability), 12) >= 0.5 AS INTEGER) AS prediction
      FROM predictions p JOIN (SELECT model, roc_auc * roc_auc / SUM(roc_auc * roc_auc) OVER () AS w FROM auc) w
        USING (model) GROUP BY sample_id""",
    "rank_average": """SELECT sample_id, 'rank_average' AS model, 'ensemble' AS type, y,
        ROUND(ar / MAX(ar) OVER (), 12) AS probability,
        CAST(ROUND(ar / MAX(ar) OVER (), 12) >= 0.5 AS INTEGER) AS prediction
      FROM (SELECT sample_id, MIN(y) AS y, AVG(CAST(rk AS DOUBLE)) AS ar FROM (
              SELECT sample_id, y, row_number() OVER (PARTITION BY model ORDER BY probability, sample_id) AS rk
              FROM predictions) GROUP BY sample_id)""",
}
ENS_CTE = AUC_CTE + ",\nens AS (" + "\nUNION ALL\n".join(ENS_SQL.values()) + ")"
ENS_R = "SELECT sample_id, model, type, y, ROUND(probability, 6) AS probability, prediction FROM "


@query("vote_soft", SP + "\n" + ENS_R + "(" + ENS_SQL["voting_soft"] + ")")
def q_vote_soft(spark, sf):
    return rnd(N.vote_soft(preds(spark, sf)))


@query("vote_hard", SP + "\n" + ENS_R + "(" + ENS_SQL["voting_hard"] + ")")
def q_vote_hard(spark, sf):
    return rnd(N.vote_hard(preds(spark, sf)))


@query("vote_hard_even", SP + "\n" + ENS_R + "(" + ENS_SQL["voting_hard"].replace("FROM predictions", "FROM predictions WHERE model <> 'm_c'") + ")")
def q_vote_hard_even(spark, sf):
    """N2 with two members: where they differ, the lower class wins."""
    return rnd(N.vote_hard(preds(spark, sf).where("model <> 'm_c'")))


@query("auc_weights", SP + ",\n" + AUC_CTE + "\nSELECT model, ROUND(roc_auc * roc_auc, 6) AS weight FROM auc")
def q_auc_weights(spark, sf):
    return rnd(N.auc_weights(preds(spark, sf)))


@query("weighted_average", SP + ",\n" + AUC_CTE + "\n" + ENS_R + "(" + ENS_SQL["weighted_average"] + ")")
def q_weighted_average(spark, sf):
    p = preds(spark, sf)
    return rnd(N.weighted_average(p, N.auc_weights(p)))


@query("rank_average", SP + "\n" + ENS_R + "(" + ENS_SQL["rank_average"] + ")")
def q_rank_average(spark, sf):
    return rnd(N.rank_average(preds(spark, sf)))


_ENS_SCORES = ENS_CTE + """,
esc AS (SELECT model, probability, CAST(SUM(y) AS DOUBLE) AS pos, CAST(SUM(1 - y) AS DOUBLE) AS neg
        FROM ens GROUP BY model, probability),
eac AS (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY probability
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM esc),
eauc AS (SELECT model, SUM(pos * (neg_cum - neg + neg * 0.5)) / (SUM(pos) * SUM(neg)) AS roc_auc
         FROM eac GROUP BY model),
ecm AS (SELECT model, """ + CM_SELECT + """ FROM ens GROUP BY model),
escore AS (SELECT ecm.model,
     ROUND(""" + _d('true_positives + true_negatives',
                   'true_positives + true_negatives + false_positives + false_negatives') + """, 6) AS accuracy,
     ROUND(""" + _d('2.0 * true_positives', '2.0 * true_positives + false_positives + false_negatives') + """, 6) AS f1_score,
     ROUND(CASE WHEN ecm.model = 'voting_hard' THEN 0.0 ELSE eauc.roc_auc END, 6) AS roc_auc
   FROM ecm LEFT JOIN eauc USING (model))"""


def _ens_scores(spark, sf):
    return rnd(N.ensemble_scores(N.all_ensembles(preds(spark, sf))))


@query("ensemble_scores", SP + ",\n" + _ENS_SCORES + "\nSELECT * FROM escore")
def q_ensemble_scores(spark, sf):
    return _ens_scores(spark, sf)


@query("ensemble_summary", SP + ",\n" + _ENS_SCORES + """
SELECT model AS Ensemble_Method, roc_auc AS ROC_AUC, accuracy AS Accuracy, f1_score AS F1_Score
FROM escore ORDER BY ROC_AUC DESC""")
def q_ensemble_summary(spark, sf):
    return N.ensemble_summary(_ens_scores(spark, sf))


_ALL_EVAL = _ENS_SCORES + """,
allp AS (SELECT sample_id, model, 'individual' AS type, y, probability, prediction FROM predictions
         UNION ALL SELECT sample_id, model, type, y, probability, prediction FROM ens),
asc_ AS (SELECT type, model, probability, CAST(SUM(y) AS DOUBLE) AS pos, CAST(SUM(1 - y) AS DOUBLE) AS neg
         FROM (SELECT type, model, y, CASE WHEN model = 'voting_hard' THEN CAST(prediction AS DOUBLE)
                                           ELSE probability END AS probability FROM allp)
         GROUP BY type, model, probability),
aac AS (SELECT *, SUM(neg) OVER (PARTITION BY type, model ORDER BY probability
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM asc_),
aauc AS (SELECT type, model, SUM(pos * (neg_cum - neg + neg * 0.5)) / (SUM(pos) * SUM(neg)) AS roc_auc
         FROM aac GROUP BY type, model),
acm AS (SELECT type, model, """ + CM_SELECT + """ FROM allp GROUP BY type, model)"""
_ALL_METRICS = """SELECT acm.*, """ + DERIVED + """, ROUND(aauc.roc_auc, 6) AS roc_auc
FROM acm LEFT JOIN aauc USING (type, model)"""


def all_metrics(spark, sf):
    """Metrics of the pseudo-models and their ensembles."""
    p = preds(spark, sf)
    # the members' AUCs are their weights as well
    members = materialize(T.evaluate_models(p), "member-metrics")
    weights = members.select("model", F.pow("roc_auc", 2).alias("weight"))
    return rnd(members.unionByName(T.evaluate_models(N.all_ensembles(p, weights))))


@query("evaluate_all", SP + ",\n" + _ALL_EVAL + "\n" + _ALL_METRICS)
def q_evaluate_all(spark, sf):
    return all_metrics(spark, sf)


_FIRST = "first_ AS (SELECT * FROM am ORDER BY roc_auc DESC NULLS LAST, type DESC, model LIMIT 1)"


@query("model_count_by_type", SP + ",\n" + _ALL_EVAL + ",\nam AS (" + _ALL_METRICS + ")\nSELECT type, COUNT(*) AS n_models FROM am GROUP BY type")
def q_model_count_by_type(spark, sf):
    return T.count_by_type(all_metrics(spark, sf))


@query("best_model_profile", SP + ",\n" + _ALL_EVAL + ",\nam AS (" + _ALL_METRICS + "),\n" + _FIRST + "\n" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM first_" for m in T.PROFILE))
def q_best_model_profile(spark, sf):
    """T14 five metrics of the best of all members and ensembles."""
    return T.best_model_profile(materialize(all_metrics(spark, sf), "metrics"))


@query("report_sections", SP + ",\n" + _ALL_EVAL + ",\nam AS (" + _ALL_METRICS + "),\n" + _FIRST + """,
weights AS (SELECT 'individual' AS type, model, model || '_auc' AS item, ROUND(roc_auc * roc_auc, 6) AS value FROM am WHERE type = 'individual')
SELECT 'summary' AS section, NULL AS type, NULL AS model, item, value, NULL AS text
FROM (UNPIVOT (SELECT CAST(COUNT(*) AS DOUBLE) AS total_models, CAST(COUNT(*) FILTER (WHERE type = 'individual') AS DOUBLE) AS individual_models,
                      CAST(COUNT(*) FILTER (WHERE type = 'ensemble') AS DOUBLE) AS ensemble_models FROM am) ON COLUMNS(*) INTO NAME item VALUE value)
UNION ALL SELECT 'summary', type, model, 'best_roc_auc', roc_auc, model FROM first_
""" + "".join(f"UNION ALL SELECT '{s}', type, model, '{m}', CAST({m} AS DOUBLE), NULL FROM am\n" for s, ms in (
    ("metrics", ("accuracy", "precision", "recall", "f1_score", "roc_auc", "specificity", "sensitivity")),
    ("confusion", ("true_positives", "false_positives", "true_negatives", "false_negatives"))) for m in ms) + """
UNION ALL SELECT 'importance', type, model, item, value, NULL FROM weights
UNION ALL SELECT 'recommendations', type, model, 'best', roc_auc, printf('%s has the highest ROC-AUC, %.4f', model, roc_auc) FROM first_
UNION ALL SELECT 'recommendations', type, model, 'recall', recall, printf('it finds %.2f%% of the prospective samples', recall * 100) FROM first_
UNION ALL SELECT 'recommendations', type, model, 'specificity', specificity, printf('it clears %.2f%% of the barren samples', specificity * 100) FROM first_
UNION ALL SELECT 'recommendations', type, model, 'type', NULL, 'the best model is of type ' || type FROM first_""")
def q_report_sections(spark, sf):
    """T13 the report over the pseudo-models and their ensembles; their AUC
    weights stand where fitted models have importances."""
    m = materialize(all_metrics(spark, sf), "metrics")
    weights = m.where("type = 'individual'").select("model", F.concat("model", F.lit("_auc")).alias("feature"),
                                                    F.round(F.col("roc_auc") * F.col("roc_auc"), 6).alias("importance"), F.lit(1).alias("rank"))
    return T.report_sections(m, weights)
