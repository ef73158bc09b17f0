"""Queries that fit models (2.6, N3, N7, 2.9 C1/C9, V5, V7, V8, S3-S5).

They have no SQL oracle (the driver records a rows-only check); unit
tests check them against planted-signal bars and brute force.  All run
over the whole sample table and search the reference grids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrascore.config import HYPERPARAMETERS, SCORING_MAX_DISTANCE, TESTDATA
from terrascore.operators import clean as Cl
from terrascore.operators import encode as EN
from terrascore.operators import ensemble as N
from terrascore.operators import features as FE
from terrascore.operators import metrics as T
from terrascore.operators import models as M
from terrascore.operators import score as C
from terrascore.operators import scorers as SC
from terrascore.operators import spatial as V
from terrascore.plans import training as PL
from terrascore.plans.registry import query
from terrascore.plans.sqltext import SC as CLEAN_SQL
from terrascore.session import checkpoint_root, materialize
from terrascore.sources.fixtures import samples

_PREP: dict = {}


def prepared(spark, sf, select: bool = True) -> PL.Prepared:
    """Training preparation of the sample table, memoised per session and
    input (its tables are materialised in the checkpoint folder)."""
    key = (spark.sparkContext.applicationId, sf, select)
    if key not in _PREP:
        _PREP[key] = PL.prepare_training(samples(spark, sf), TESTDATA, select=select)
    return _PREP[key]


def _single(name):
    def fn(spark, sf):
        p = prepared(spark, sf)
        t = M.tune_model(p.train, name, M.SEARCH_GRIDS[name])
        return M.predict_long(t.model, p.test, name)
    return fn


query("model_logistic")(_single("logistic_regression"))
query("model_forest")(_single("random_forest"))
query("model_randomized_trees")(_single("extra_trees"))
query("model_gbt")(_single("gradient_boosting"))
query("model_gbt_subsampled")(_single("xgboost"))


_TRAINED: dict = {}


def trained(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        p = prepared(spark, sf)
        _TRAINED[key] = M.train_all(p.train, p.test)
    return _TRAINED[key]


def evaluated(spark, sf):
    """(predictions of members and all five ensembles, their metrics),
    written once per session and input."""
    key = (spark.sparkContext.applicationId, sf, "evaluated")
    if key not in _TRAINED:
        p = prepared(spark, sf)
        tuned, preds = trained(spark, sf)
        preds = materialize(preds, "predictions")
        meta = M.fit_stack(p.train, tuned)
        both = materialize(preds.unionByName(N.all_ensembles(preds)).unionByName(M.stack(p.train, p.test, tuned, meta=meta)),
                           "evaluated")
        _TRAINED[key] = both, materialize(T.evaluate_models(both), "metrics"), SC.all_scorers(
            {n: t.model for n, t in tuned.items()}, preds, meta)
    return _TRAINED[key][:2]


@query("tune_model")
def q_tune_model(spark, sf):
    p = prepared(spark, sf)
    t = M.tune_model(p.train, "logistic_regression", HYPERPARAMETERS["logistic_regression"])
    return M.model_summary(spark, {t.name: t})


@query("train_all")
def q_train_all(spark, sf):
    return trained(spark, sf)[1]


@query("feature_importance")
def q_feature_importance(spark, sf):
    tuned, _ = trained(spark, sf)
    feats = prepared(spark, sf).state.features
    out = None
    for t in tuned.values():
        d = M.feature_importance(spark, t, feats)
        out = d if out is None else out.unionByName(d)
    return out.orderBy("model", F.desc("importance"), "feature")


@query("importance_by_group")
def q_importance_by_group(spark, sf):
    return V.importance_by_group(q_feature_importance(spark, sf))


@query("model_summary")
def q_model_summary(spark, sf):
    return M.model_summary(spark, trained(spark, sf)[0])


@query("stack")
def q_stack(spark, sf):
    return evaluated(spark, sf)[0].where(F.col("model") == "stacking")


@query("blend")
def q_blend(spark, sf):
    p = prepared(spark, sf)
    tuned, val_preds = trained(spark, sf)
    train_preds = None
    for n, t in tuned.items():
        d = M.predict_long(t.model, p.train, n)
        train_preds = d if train_preds is None else train_preds.unionByName(d)
    return M.blend(train_preds, val_preds)


@query("train_ensembles")
def q_train_ensembles(spark, sf):
    """N9 all ensembles over the fitted members' validation predictions."""
    return evaluated(spark, sf)[0].where(F.col("type") == "ensemble")


@query("evaluation_report")
def q_evaluation_report(spark, sf):
    """T13 one long table: summary, metrics and confusion counts of members
    and ensembles, the top-20 feature importances of every member, advice."""
    return T.report_sections(evaluated(spark, sf)[1], V.importance_by_group(q_feature_importance(spark, sf), top=20))


def _best(spark, sf):
    """The best of all ten models, and its AUC."""
    metrics = evaluated(spark, sf)[1]
    scorers = _TRAINED[(spark.sparkContext.applicationId, sf, "evaluated")][2]
    return SC.best_scorer(scorers, metrics, [*M.MODEL_NAMES, *SC.ENSEMBLES])


def scoring_table(spark, sf):
    """Entry B input: known categories (learned weights) within the distance."""
    s = materialize(samples(spark, sf), "scoring")  # read for the weights and for the rows
    known = EN.learn_weights(s, "lithology", "likely").select("lithology")
    s = Cl.filter_membership(s, "lithology", known)
    return Cl.filter_range(s, "fault_dist", max_value=SCORING_MAX_DISTANCE)


def scored(spark, sf):
    p = prepared(spark, sf)
    best, _ = _best(spark, sf)
    x = PL.prepare_scoring(scoring_table(spark, sf), p.state)
    return best.score(x)


@query("score_samples")
def q_score_samples(spark, sf):
    """C1-C4 best model -> raw score -> [0.70, 0.95] rescale -> class."""
    s = C.rescale_scores(scored(spark, sf))
    return s.select("sample_id", "raw_score", "prospectivity_score",
                    C.score_class("prospectivity_score").alias("prospectivity_class"),
                    "xcoord", "ycoord", "fault_dist")


def _summary(spark, sf):
    p = prepared(spark, sf)
    best, auc = _best(spark, sf)
    st = p.state
    made = set(FE.created_features(st.preset))
    return C.summary_table(scored(spark, sf), len(st.extra["candidates"]), len(st.features), len(made),
                           evaluated(spark, sf)[1].count(), best.name, auc)


@query("scoring_summary")
def q_scoring_summary(spark, sf):
    return _summary(spark, sf)


@query("pipeline_summary")
def q_pipeline_summary(spark, sf):
    """C9/S4 the run's summary, written as JSON by the report sink and read back."""
    from terrascore.sources.sinks import write_report

    path = f"{checkpoint_root(spark).rstrip('/')}/summary-{uuid.uuid4().hex}"
    summary = _summary(spark, sf)
    write_report(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query("summary_texts")
def q_summary_texts(spark, sf):
    """C9 the run's findings and advice."""
    return C.summary_texts(_summary(spark, sf))


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """S5 save the best of all ten models, with its members, load it back,
    score the validation part."""
    best, _ = _best(spark, sf)
    path = f"{checkpoint_root(spark).rstrip('/')}/scorer-{uuid.uuid4().hex}"
    SC.save_scorer(best, path, spark)
    return SC.load_scorer(path, spark).score(prepared(spark, sf).test)


@query("prepare_training")
def q_prepare_training(spark, sf):
    """E10 the assembled, scaled training part (with folds)."""
    p = prepared(spark, sf)
    from pyspark.ml.functions import vector_to_array
    return p.train.select("sample_id", "label", "fold", vector_to_array("features").alias("features"))


@query("prepare_scoring")
def q_prepare_scoring(spark, sf):
    """E11 the scoring table transformed with the training state."""
    from pyspark.ml.functions import vector_to_array
    x = PL.prepare_scoring(scoring_table(spark, sf), prepared(spark, sf).state)
    return x.select("sample_id", vector_to_array("features").alias("features"))


@query("dbf_source", CLEAN_SQL + """
SELECT sample_id, xcoord, ycoord, CAST(q1 AS DOUBLE) AS q1, q2, q3, q4, q5, CAST(lineament AS BIGINT) AS lineament, fault_dist, lithology, formation,
       CAST(likely AS BIGINT) AS likely FROM clean""")
def q_dbf_source(spark, sf):
    """S1/S2 the cleaned sample table written as dBase part files (one per
    task) and read back through the dbf source (record-range partitions)."""
    from terrascore.operators.clean import clean_data
    from terrascore.sources.dbf import register_dbf
    from terrascore.sources.tables import load_table

    register_dbf(spark)
    folder = f"{checkpoint_root(spark).rstrip('/')}/dbf-{uuid.uuid4().hex}"
    clean_data(samples(spark, sf)).write.format("dbf").mode("append").save(folder)
    return load_table(spark, folder, fmt="dbf")


@query("stream_scoring")
def q_stream_scoring(spark, sf):
    """Streaming scoring: the scoring table lands as parquet files, a stream
    (availableNow) scores it micro-batch by micro-batch with the frozen
    training state, and the sink is read back."""
    from terrascore.streaming.scoring import start_scoring_stream

    root = f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    src = scoring_table(spark, sf)
    src.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    p = prepared(spark, sf)
    model = M.estimator("logistic_regression").fit(p.train)
    q = start_scoring_stream(stream, p.state, model, f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")
