"""Encodings, split, scaling, metrics (golden arithmetic) and ensembles."""

import math

import pytest
from pyspark.sql import functions as F

from terrascore.config import LITHOLOGY_GOLD_COUNTS
from terrascore.operators import encode as EN
from terrascore.operators import ensemble as N
from terrascore.operators import metrics as T
from terrascore.operators import sample as SA
from terrascore.operators import scale as SC
from terrascore.operators import score as C


def test_weight_encode_unknown(spark):
    df = spark.createDataFrame([("META-BASALT",), ("ARGILLITE",), ("nothing",), (None,)], "lithology string")
    got = [r[1] for r in EN.weight_encode(df, "lithology", LITHOLOGY_GOLD_COUNTS).collect()]
    assert got == [1.0, 15 / 16, 0.5 / 16, 0.5 / 16]
    w = EN.weights_frame(spark, LITHOLOGY_GOLD_COUNTS, "category", "count")
    got2 = [r[1] for r in EN.weight_encode(df, "lithology", w).orderBy("lithology").collect()]
    assert sorted(got2) == sorted(got)


def test_one_hot_vocabulary_and_drop_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "c string")
    out = EN.one_hot(df, "c", vocabulary=["a", "b"]).collect()
    assert [tuple(r) for r in out] == [(0, 1), (1, 0), (0, 0), (0, 0)]
    d = EN.one_hot(df, "c", drop_first=True, as_bool=True)
    assert d.columns == ["c_b", "c_z"]


def test_stratified_split_is_balanced_partition(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "sample_id long, likely int")
    s = SA.stratified_split(df)
    c = {(r[0], r[1]): r[2] for r in s.groupBy("likely", "is_test").count().collect()}
    assert c[(1, True)] == math.ceil(0.2 * 334) and c[(0, True)] == math.ceil(0.2 * 666)
    assert s.count() == 1000 and s.select("sample_id").distinct().count() == 1000
    f = SA.stratified_folds(df, k=5).groupBy("likely", "fold").count().collect()
    sizes = {}
    for r in f:
        sizes.setdefault(r[0], []).append(r[2])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())


def test_robust_scale_zero_iqr(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(8)] + [(5.0, 0.0)] * 24, "c double, z double")
    p = SC.fit_robust_scaler(df, ["c", "z"])
    assert p["c"] == (5.0, 1.0)  # constant -> divide by 1
    assert p["z"] == (0.0, 1.0)  # 75 % zero -> zero IQR
    assert SC.robust_scale(df, ["c"]).agg(F.max("c")).first()[0] == 0.0


# Golden arithmetic: the reference's published confusion matrices and metrics
GOLDEN = [  # model, tn, fp, fn, tp, accuracy, precision, recall, f1, specificity
    ("logistic_regression", 9, 2, 2, 8, 0.8095, 0.8000, 0.8000, 0.8000, 0.8182),
    ("random_forest", 11, 0, 2, 8, 0.9048, 1.0, 0.8, 0.8889, 1.0),
    ("extra_trees", 11, 0, 4, 6, 0.8095, 1.0, 0.6, 0.75, 1.0),
    ("gradient_boosting", 11, 0, 1, 9, 0.9524, 1.0, 0.9, 0.9474, 1.0),
    ("xgboost", 11, 0, 1, 9, 0.9524, 1.0, 0.9, 0.9474, 1.0),
    ("voting_soft", 11, 0, 1, 9, 0.9524, 1.0, 0.9, 0.9474, 1.0),
    ("voting_hard", 11, 0, 2, 8, 0.9048, 1.0, 0.8, 0.8889, 1.0),
    ("stacking", 11, 0, 1, 9, 0.9524, 1.0, 0.9, 0.9474, 1.0),
    ("weighted_average", 11, 0, 1, 9, 0.9524, 1.0, 0.9, 0.9474, 1.0),
    ("rank_average", 10, 1, 1, 9, 0.9048, 0.9, 0.9, 0.9, 0.9091),
]


def test_golden_metric_arithmetic(spark):
    cm = spark.createDataFrame([g[:5] for g in GOLDEN],
                               "model string, true_negatives long, false_positives long, "
                               "false_negatives long, true_positives long")
    got = {r["model"]: r for r in T.derived_metrics(cm).collect()}
    for m, *_, acc, prec, rec, f1, spec in GOLDEN:
        r = got[m]
        for k, v in (("accuracy", acc), ("precision", prec), ("recall", rec), ("f1_score", f1),
                     ("specificity", spec)):
            assert abs(r[k] - v) < 5e-5, (m, k)


def _preds(spark, scores, labels, model="m"):
    rows = [(i, model, y, float(p), int(p >= 0.5)) for i, (p, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "sample_id long, model string, y int, probability double, prediction int")


def test_average_precision_and_auc_fixture(spark):
    p = _preds(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])
    assert math.isclose(T.average_precision(p).first()["average_precision"], 5 / 6)
    assert math.isclose(T.roc_auc(p).first()["roc_auc"], 0.75)


def test_auc_ties_single_class_and_monotone(spark):
    tied = _preds(spark, [0.3] * 6, [0, 1, 0, 1, 1, 0])
    assert T.roc_auc(tied).first()["roc_auc"] == 0.5
    one = _preds(spark, [0.1, 0.2], [1, 1])
    assert T.roc_auc(one).first()["roc_auc"] is None
    s = [0.1, 0.2, 0.2, 0.5, 0.7, 0.9, 0.3]
    y = [0, 1, 0, 1, 0, 1, 1]
    a = T.roc_auc(_preds(spark, s, y)).first()[1]
    b = T.roc_auc(_preds(spark, [v ** 3 for v in s], y)).first()[1]
    assert math.isclose(a, b)


def test_precision_zero_division(spark):
    p = _preds(spark, [0.1, 0.2], [0, 1])
    r = T.classification_metrics(p).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1_score"] == 0.0


def test_rank_average_ties_by_id(spark):
    rows = [(i, m, 0, 0.5, 1) for m in ("a", "b") for i in range(4)]
    p = spark.createDataFrame(rows, "sample_id long, model string, y int, probability double, prediction int")
    got = [r["probability"] for r in N.rank_average(p).orderBy("sample_id").collect()]
    assert got == [0.25, 0.5, 0.75, 1.0]


def test_weighted_average_normalises_all_given_weights(spark):
    rows = [(0, "a", 1, 0.2, 0), (0, "b", 1, 0.8, 1)]
    p = spark.createDataFrame(rows, "sample_id long, model string, y int, probability double, prediction int")
    got = N.weighted_average(p, {"a": 1.0, "b": 1.0, "absent": 2.0}).first()["probability"]
    assert math.isclose(got, 0.25 * 0.2 + 0.25 * 0.8)


def test_rescale_constant_and_range(spark):
    df = spark.createDataFrame([(0.3,), (0.3,)], "raw_score double")
    assert [r[1] for r in C.rescale_scores(df).collect()] == [None, None]
    df = spark.createDataFrame([(x / 10,) for x in range(11)], "raw_score double")
    v = [r[1] for r in C.rescale_scores(df).collect()]
    assert min(v) == 0.7 and math.isclose(max(v), 0.95) and all(0.7 <= x <= 0.95 + 1e-12 for x in v)


def test_calibration_bins_right_closed(spark):
    p = _preds(spark, [0.0, 0.1, 0.1000001, 1.0], [0, 0, 1, 1])
    got = {r["bin"]: r["n"] for r in T.calibration_curve(p).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_hard_vote_auc_is_that_of_the_class(spark):
    # the published confusion matrix of the hard vote: recall 0.8, specificity 1.0
    rows = [(i, "voting_hard", "ensemble", int(i < 10), 0.8 if i < 8 else 0.4 if i % 2 else 0.2, int(i < 8)) for i in range(21)]
    df = spark.createDataFrame(rows, "sample_id long, model string, type string, y int, probability double, prediction int")
    assert math.isclose(T.evaluate_models(df).first()["roc_auc"], 0.9)
