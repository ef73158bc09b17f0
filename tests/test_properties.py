"""Property tests (hypothesis): few examples each, every example is a Spark job."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terrascore.functions import stats
from terrascore.operators import metrics as T
from terrascore.operators import sample as SA
from terrascore.operators import score as C

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60)


@SETTINGS
@given(vals=values, p=st.sampled_from([0.0, 0.1, 0.5, 0.75, 0.95, 1.0]))
def test_quantile_matches_numpy(spark, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = stats.exact_quantiles(df, ["x"], [p])["x"][0]
    arr = np.array([v for v in vals if v is not None])
    if arr.size == 0:
        assert got is None
    else:
        assert math.isclose(got, float(np.quantile(arr, p)), rel_tol=1e-9, abs_tol=1e-9)


@SETTINGS
@given(labels=st.lists(st.integers(0, 1), min_size=2, max_size=80), seed=st.integers(0, 1000))
def test_split_is_balanced_partition(spark, labels, seed):
    df = spark.createDataFrame(list(enumerate(labels)), "sample_id long, likely int")
    s = SA.stratified_split(df, seed=seed, test_size=0.25).collect()
    assert sorted(r["sample_id"] for r in s) == list(range(len(labels)))
    for cls in (0, 1):
        n = labels.count(cls)
        assert sum(1 for r in s if r["likely"] == cls and r["is_test"]) == math.ceil(0.25 * n)


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=2, max_size=60))
def test_auc_invariant_under_monotone_map(spark, data):
    rows = [(i, "m", y, s / 20.0, 0) for i, (s, y) in enumerate(data)]
    df = spark.createDataFrame(rows, "sample_id long, model string, y int, probability double, prediction int")
    a = T.roc_auc(df).first()["roc_auc"]
    b = T.roc_auc(df.withColumn("probability", df.probability * df.probability * 3 + 1)).first()["roc_auc"]
    if a is None:
        assert b is None and len({y for _, y in data}) == 1
    else:
        pos = [s for s, y in data if y == 1]
        neg = [s for s, y in data if y == 0]
        brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        assert math.isclose(a, brute) and math.isclose(a, b)


@SETTINGS
@given(scores=st.lists(st.floats(0, 1, allow_nan=False), min_size=2, max_size=40))
def test_rescale_within_bounds(spark, scores):
    df = spark.createDataFrame([(s,) for s in scores], "raw_score double")
    out = [r["prospectivity_score"] for r in C.rescale_scores(df).collect()]
    if max(scores) == min(scores):
        assert all(v is None for v in out)
    else:
        assert all(0.7 - 1e-12 <= v <= 0.95 + 1e-12 for v in out)
