"""Literal-row edge cases of cleaning and features."""

import math

from pyspark.sql import functions as F

from terrascore.config import GEOLOGY, TESTDATA
from terrascore.operators import clean as C
from terrascore.operators import features as FE


def test_bands_right_closed(spark):
    vals = [0.0, 0.0001, 500.0, 500.1, 1000.0, 2000.0, 3000.0, 3000.1, None]
    df = spark.createDataFrame([(v,) for v in vals], "fault_dist double")
    got = [r[0] for r in df.select(FE.distance_band("fault_dist")).collect()]
    assert got == [None, "very_close", "very_close", "close", "close", "moderate", "far", "very_far", None]
    oh = df.select(*[e.alias(n) for n, e in FE.band_one_hot("fault_dist")]).collect()
    assert all(sum(r) == 0 for r in (oh[0], oh[-1]))
    assert all(sum(r) == 1 for r in oh[1:-1])


def test_ratios_zero_and_null_denominators(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, None), (0.0, 2.0), (-1.0, -0.001)],
                               "a double, b double")
    got = [r[0] for r in df.select(FE.finite_or_zero(FE.safe_div("a", "b"))).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 1000.0]
    # ratio with eps: b + 0.001 = 0 -> 0
    got = [r[0] for r in df.select(FE.finite_or_zero(FE.element_ratio("a", "b"))).collect()]
    assert got[-1] == 0.0 and math.isclose(got[0], 1000.0)


def test_anomaly_tiers_strictly_above(spark):
    vals = [1.0] * 10 + [2.0] * 5 + [3.0] * 3 + [4.0, 5.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    t = FE.anomaly_tiers(df, ["x"])
    got = sorted((r["x"], r["x_anomaly"]) for r in t.collect() if r["x"] is not None)
    # P75 = 2.25, P90 = 3.1, P95 = 4.05 (linear interpolation)
    g = dict(got)
    assert (g[1.0], g[2.0], g[3.0], g[4.0], g[5.0]) == (0, 0, 1, 2, 3)
    assert [r["x_anomaly"] for r in t.collect() if r["x"] is None] == [0]


def test_eu_anomaly_negative_radicand_is_zero(spark):
    df = spark.createDataFrame([(1.0, -5.0, 1.0)], "Eu_ppm double, Sm_ppm double, Gd_ppm double")
    p = GEOLOGY.available(df.columns)
    assert df.select(FE.finite_or_zero(FE.eu_anomaly(p))).first()[0] == 0.0


def test_engineer_features_29_for_full_geology():
    assert len(FE.created_features(GEOLOGY)) == 29
    assert len(FE.created_features(TESTDATA)) == 29


def test_clean_data_dedup_then_median(spark):
    rows = [(1, 1.0, "a", 1.0), (1, 1.0, "a", 1.0), (2, None, None, 0.0), (3, 5.0, "b", 1.0),
            (4, float("nan"), "c", 0.0)]
    df = spark.createDataFrame(rows, "sample_id long, q double, lithology string, likely double")
    from terrascore.functions.expr import nan_to_null_all
    d = C.clean_data(nan_to_null_all(df)).orderBy("sample_id").collect()
    assert len(d) == 4  # duplicate removed before the median
    assert [r["q"] for r in d] == [1.0, 3.0, 5.0, 3.0]  # median of 1, 5 (after de-dup)
    assert d[1]["lithology"] == "Unknown"
    assert isinstance(d[0]["likely"], int)


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "sample_id long, e double")
    assert [r["e"] for r in C.median_impute(df).collect()] == [None, None]


def test_feature_override_and_columns(spark):
    assert C.feature_override(["a", "b", "c"], ["d", "a"], ["b", "zz"]) == ["a", "c", "d"]
    df = spark.createDataFrame([(1, 1.0, True, "x", 2, 3.0, 0)],
                               "sample_id long, q double, flag boolean, s string, n int, xcoord double, likely int")
    assert C.feature_columns(df) == ["q", "n"]


def test_group_density_missing_key(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "sample_id long, lineament long")
    got = {r["sample_id"]: r["lineament_density"] for r in FE.group_density(df, "lineament").collect()}
    assert got == {1: 2, 2: 2, 3: None}


def test_engineer_features_on_samples(spark):
    from terrascore.plans.queries_prep import clean_samples
    e = FE.engineer_features(clean_samples(spark, "/root/testdata/sf0.001"), TESTDATA)
    created = FE.created_features(TESTDATA)
    assert set(created) <= set(e.columns)
    # no missing or non-finite values in numeric outputs
    nums = [f.name for f in e.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    bad = e.select(*[F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")).alias(c)
                     for c in nums]).first()
    assert all(v == 0 for v in bad)


def test_frozen_medians_cover_columns_complete_in_training(spark):
    from terrascore.operators import clean

    train = spark.createDataFrame([(1.0, 5.0, 0), (3.0, 7.0, 1), (None, 9.0, 1)], "a double, b double, target int")
    _, medians = clean.clean_data_fit(train, exclude=(), target="target")
    assert medians["a"] == 2.0 and medians["b"] == 7.0
    later = spark.createDataFrame([(None, None)], "a double, b double")
    assert tuple(clean.apply_median_impute(later, medians).first()) == (2.0, 7.0)
