"""Queries over the cleaning and feature operators (2.2, 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascore.config import TESTDATA
from terrascore.operators import clean as C
from terrascore.operators import features as FE
from terrascore.plans.registry import query
from terrascore.plans.sqltext import S, SC
from terrascore.sources.fixtures import samples

ELEMENTS = ["q1", "q2", "q3", "q4", "q5"]


def clean_samples(spark, sf):
    """samples -> clean_data, written once to the checkpoint folder (the
    de-duplicated input is written inside clean_data): the feature
    statistics passes and the final projection read it instead of
    re-deriving the sample view."""
    from terrascore.session import materialize

    return materialize(C.clean_data(samples(spark, sf)), "clean")


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


# ---------------------------------------------------------------- minimum slice

_TIER_SQL = ",\n".join(
    f"q AS (SELECT " + ", ".join(
        f"quantile_cont({e}, 0.75) AS {e}_p75, quantile_cont({e}, 0.9) AS {e}_p90, "
        f"quantile_cont({e}, 0.95) AS {e}_p95" for e in ELEMENTS) + " FROM clean)"
    for _ in [0])
_TIER_EXPR = ", ".join(
    f"CASE WHEN {e} > {e}_p95 THEN 3 WHEN {e} > {e}_p90 THEN 2 WHEN {e} > {e}_p75 THEN 1 ELSE 0 END"
    f" AS {e}_anomaly" for e in ELEMENTS)
TIERS_CTE = SC.rstrip() + ",\n" + _TIER_SQL + f""",
tiers AS (SELECT sample_id, {_TIER_EXPR} FROM clean, q)
"""


def tiers_frame(spark, sf):
    d = clean_samples(spark, sf)
    t = FE.anomaly_tiers(d, ELEMENTS)
    names = [f"{e}_anomaly" for e in ELEMENTS]
    return t.select("sample_id", *names, FE.composite_anomaly(names).alias("composite_anomaly_score"))


@query("anomaly_tiers", TIERS_CTE + f"""
SELECT sample_id, {", ".join(e + "_anomaly" for e in ELEMENTS)},
       CAST({" + ".join(e + "_anomaly" for e in ELEMENTS)} AS BIGINT) AS composite_anomaly_score
FROM tiers""")
def q_anomaly_tiers(spark, sf):
    return tiers_frame(spark, sf)


@query("anomaly_tier_counts", TIERS_CTE + """
SELECT feature, tier, COUNT(*) AS n FROM (
""" + "\nUNION ALL\n".join(f"  SELECT '{e}_anomaly' AS feature, {e}_anomaly AS tier FROM tiers"
                           for e in ELEMENTS) + """
) GROUP BY feature, tier""")
def q_anomaly_tier_counts(spark, sf):
    t = tiers_frame(spark, sf)
    return FE.anomaly_tier_counts(t, [f"{e}_anomaly" for e in ELEMENTS])


@query("composite_anomaly", TIERS_CTE + f"""
SELECT CAST({" + ".join(e + "_anomaly" for e in ELEMENTS)} AS BIGINT) AS composite_anomaly_score,
       COUNT(*) AS n
FROM tiers GROUP BY 1""")
def q_composite_anomaly(spark, sf):
    t = tiers_frame(spark, sf)
    return t.groupBy("composite_anomaly_score").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- 2.1 / 2.2

from terrascore.plans import sqltext as Q  # noqa: E402
from terrascore.sources.tables import load_table  # noqa: E402
from terrascore.functions.expr import finite_or_zero  # noqa: E402
from terrascore.operators import encode as EN  # noqa: E402

SAMPLE_COLS = ["sample_id", "xcoord", "ycoord", "q1", "q2", "q3", "q4", "q5", "lineament",
               "fault_dist", "lithology", "formation", "likely"]


@query("load_table", "SELECT * FROM orders")
def q_load_table(spark, sf):
    return load_table(spark, f"{sf}/orders.parquet")


def doubled(spark, sf):
    s = samples(spark, sf)
    return s.unionByName(s)


@query("drop_duplicates", Q.with_(Q.SAMPLES, Q.DOUBLED) + "SELECT DISTINCT * FROM doubled")
def q_drop_duplicates(spark, sf):
    return C.drop_duplicates(doubled(spark, sf))


@query("median_impute", Q.S + """
SELECT sample_id, xcoord, ycoord, COALESCE(q1, (SELECT median(q1) FROM samples)) AS q1,
       q2, q3, q4, q5, lineament, fault_dist, lithology, formation, likely
FROM samples""")
def q_median_impute(spark, sf):
    return C.median_impute(samples(spark, sf))


@query("fill_unknown", Q.S + """
SELECT sample_id, COALESCE(lithology, 'Unknown') AS lithology,
       COALESCE(formation, 'Unknown') AS formation FROM samples""")
def q_fill_unknown(spark, sf):
    return C.fill_unknown(samples(spark, sf)).select("sample_id", "lithology", "formation")


@query("clean_data", Q.SDC + "SELECT * FROM clean")
def q_clean_data(spark, sf):
    return C.clean_data(doubled(spark, sf))


@query("prepare_features", Q.SC + """
SELECT sample_id, """ + ", ".join(f"CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}" for c in
                                  ["q1", "q2", "q3", "q4", "q5", "lineament", "fault_dist"]) + """
FROM clean""")
def q_prepare_features(spark, sf):
    d = clean_samples(spark, sf)
    cols = C.feature_columns(d)
    return C.prepare_features(d, cols, keep=["sample_id"])


@query("null_profile", Q.S + "SELECT feature, n_missing FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM samples"
    for c in SAMPLE_COLS) + ") WHERE n_missing > 0")
def q_null_profile(spark, sf):
    return C.null_profile(samples(spark, sf))


#: many small sites, so that some have no positive sample; NULL where the category is
SITE_SQL = "CASE WHEN lithology IS NOT NULL THEN CAST(sample_id % 5000 AS VARCHAR) END"


def with_site(df):
    return df.withColumn("site", F.when(F.col("lithology").isNotNull(), (F.col("sample_id") % 5000).cast("string")))


@query("filter_membership", Q.S.rstrip() + f""",
sited AS (SELECT *, {SITE_SQL} AS site FROM samples)
SELECT * FROM sited WHERE site IN (SELECT site FROM sited WHERE site IS NOT NULL GROUP BY site HAVING SUM(likely) > 0)""")
def q_filter_membership(spark, sf):
    s = with_site(samples(spark, sf))
    known = EN.learn_weights(s, "site", "likely").select("site")
    return C.filter_membership(s, "site", known)


@query("filter_distance", Q.S + "SELECT * FROM samples WHERE fault_dist <= 2300")
def q_filter_distance(spark, sf):
    return C.filter_range(samples(spark, sf), "fault_dist", max_value=2300.0)


@query("target_distribution", Q.SC + """
SELECT likely, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share
FROM clean GROUP BY likely""")
def q_target_distribution(spark, sf):
    return C.target_distribution(clean_samples(spark, sf))


@query("column_profile", Q.S + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(MIN({c}), 6) AS min, ROUND(MAX({c}), 6) AS max, "
    f"ROUND(AVG({c}), 6) AS mean, ROUND(median({c}), 6) AS median FROM samples" for c in ELEMENTS) + ")")
def q_column_profile(spark, sf):
    p = C.column_profile(samples(spark, sf), ELEMENTS)
    return p.select("feature", *[_r(c) for c in ("min", "max", "mean", "median")])


# ---------------------------------------------------------------- 2.3 features

P = TESTDATA


def _feature_query(name, spark_expr_fn, sql_expr, ctes=()):
    sql = Q.SC.rstrip() + "".join(",\n" + c for c in ctes) + (
        f"\nSELECT sample_id, ROUND(COALESCE({sql_expr}, 0), 6) AS {name} FROM clean"
        + "".join(", " + c.split(" AS ")[0].strip() for c in ctes))

    @query(name, sql)
    def fn(spark, sf):
        d = clean_samples(spark, sf)
        return d.select("sample_id", F.round(finite_or_zero(spark_expr_fn(d)), 6).alias(name))
    return fn


_feature_query("alteration_index", lambda d: FE.alteration_index(P), Q.FEATURE_SQL["alteration_index"])
_feature_query("ccpi_index", lambda d: FE.ccpi_index(P), Q.FEATURE_SQL["ccpi_index"])
_feature_query("sericite_index", lambda d: FE.sericite_index(P), Q.FEATURE_SQL["sericite_index"])
_feature_query("mean_normalize",
               lambda d: FE.mean_normalize("q2", FE.stats.means(d, ["q2"])["q2"]),
               Q.FEATURE_SQL["silicification_index"], ctes=[Q.MEAN_CTE])
_feature_query("mafic_index", lambda d: FE.mafic_index(P), Q.FEATURE_SQL["mafic_index"])
_feature_query("alkalinity_ratio", lambda d: FE.alkalinity_ratio(P), Q.FEATURE_SQL["alkalinity_ratio"])
_feature_query("mag_gradient", lambda d: FE.mag_gradient(P), Q.FEATURE_SQL["mag_gradient"])
_feature_query("eu_anomaly", lambda d: FE.eu_anomaly(P), Q.FEATURE_SQL["Eu_anomaly"])


@query("element_ratios", Q.SC + "SELECT sample_id, " + ", ".join(
    f"ROUND(COALESCE({Q.FEATURE_SQL[n]}, 0), 6) AS {n}"
    for n in ["Au_As_ratio", "Au_Sb_ratio", "Cu_Pb_ratio", "Zn_Pb_ratio"]) + " FROM clean")
def q_element_ratios(spark, sf):
    d = clean_samples(spark, sf)
    return d.select("sample_id", *[F.round(finite_or_zero(FE.element_ratio(P.c(a), P.c(b))), 6).alias(n)
                                   for n, a, b in FE.ELEMENT_RATIOS])


@query("ree_patterns", Q.SC + "SELECT sample_id, " + ", ".join(
    f"ROUND(COALESCE({Q.FEATURE_SQL[n]}, 0), 6) AS {n}"
    for n in ["LREE_sum", "HREE_sum", "LREE_HREE_ratio"]) + " FROM clean")
def q_ree_patterns(spark, sf):
    d = clean_samples(spark, sf)
    lree, hree = FE.lree_sum(P), FE.hree_sum(P)
    return d.select("sample_id", F.round(finite_or_zero(lree), 6).alias("LREE_sum"),
                    F.round(finite_or_zero(hree), 6).alias("HREE_sum"),
                    F.round(finite_or_zero(FE.safe_div(lree, hree + F.lit(0.001))), 6)
                    .alias("LREE_HREE_ratio"))


@query("distance_bands", Q.S + f"""
SELECT fault_dist_category, COUNT(*) AS n FROM (SELECT {Q.BAND_SQL} AS fault_dist_category FROM samples)
GROUP BY fault_dist_category""")
def q_distance_bands(spark, sf):
    s = samples(spark, sf)
    return (s.select(FE.distance_band("fault_dist").alias("fault_dist_category"))
             .groupBy("fault_dist_category").agg(F.count(F.lit(1)).alias("n")))


@query("band_one_hot", Q.S + "SELECT sample_id, " + ", ".join(
    f"COALESCE(({Q.BAND_SQL}) = '{b}', false) AS fault_cat_{b}" for b in Q.BAND_LABELS) + " FROM samples")
def q_band_one_hot(spark, sf):
    s = samples(spark, sf)
    return s.select("sample_id", *[e.alias(n) for n, e in FE.band_one_hot("fault_dist")])


@query("group_density", Q.SC + ",\n" + Q.DENS_CTE + """
SELECT c.sample_id, c.lineament, d.lineament_density
FROM clean c LEFT JOIN dens d ON c.lineament = d.lineament""")
def q_group_density(spark, sf):
    d = clean_samples(spark, sf)
    return FE.group_density(d, "lineament").select("sample_id", "lineament", "lineament_density")


def _engineer_sql():
    feats = []
    for n in ["alteration_index", "ccpi_index", "sericite_index", "silicification_index",
              "Au_As_ratio", "Au_Sb_ratio", "Cu_Pb_ratio", "Zn_Pb_ratio", "mafic_index",
              "alkalinity_ratio"]:
        feats.append(f"ROUND(COALESCE({Q.FEATURE_SQL[n]}, 0), 6) AS {n}")
    feats += [f"COALESCE(({Q.BAND_SQL}) = '{b}', false) AS fault_cat_{b}" for b in Q.BAND_LABELS]
    feats.append("COALESCE(d.lineament_density, 0) AS lineament_density")
    feats.append(f"ROUND(COALESCE({Q.FEATURE_SQL['mag_gradient']}, 0), 6) AS mag_gradient")
    feats += [f"{Q.tier_sql(c)} AS {e}_anomaly" for e, c in Q.PATHFINDERS]
    feats.append("CAST(" + " + ".join(f"({Q.tier_sql(c)})" for _, c in Q.PATHFINDERS)
                 + " AS BIGINT) AS composite_anomaly_score")
    for n in ["LREE_sum", "HREE_sum", "LREE_HREE_ratio", "Eu_anomaly"]:
        feats.append(f"ROUND(COALESCE({Q.FEATURE_SQL[n]}, 0), 6) AS {n}")
    base = ("c.sample_id, ROUND(c.xcoord, 6) AS xcoord, ROUND(c.ycoord, 6) AS ycoord, "
            + ", ".join(f"ROUND(c.{x}, 6) AS {x}" for x in ELEMENTS)
            + ", c.lineament, ROUND(c.fault_dist, 6) AS fault_dist, c.lithology, c.formation, c.likely")
    return (Q.SC.rstrip() + ",\n" + Q.QUANT_CTE + ",\n" + Q.MEAN_CTE + ",\n" + Q.DENS_CTE
            + f"\nSELECT {base}, " + ", ".join(feats)
            + "\nFROM clean c LEFT JOIN dens d ON c.lineament = d.lineament, q, mn")


def round_doubles(df, n=6):
    from pyspark.sql import types as T
    return df.select(*[F.round(F.col(f.name), n).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


@query("engineer_features", _engineer_sql())
def q_engineer_features(spark, sf):
    return round_doubles(FE.engineer_features(clean_samples(spark, sf), TESTDATA))


# ---------------------------------------------------------------- 2.4 encodings, split, scaling

from terrascore.operators import sample as SA  # noqa: E402
from terrascore.operators import scale as SC_  # noqa: E402

LITHOLOGY_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Unknown"]
FORMATION_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LEARNED_W = ("w AS (SELECT lithology AS category, CAST(SUM(likely) AS BIGINT) AS count FROM clean "
             "WHERE lithology IS NOT NULL GROUP BY lithology HAVING SUM(likely) > 0)")


@query("learn_weights", Q.SC.rstrip() + ",\n" + LEARNED_W + "\nSELECT category AS lithology, count FROM w")
def q_learn_weights(spark, sf):
    return EN.learn_weights(clean_samples(spark, sf), "lithology", "likely")


@query("weight_encode", Q.SC.rstrip() + f""",
sited AS (SELECT sample_id, likely, CAST(sample_id % 5000 AS VARCHAR) AS site FROM clean),
w AS (SELECT site, SUM(likely) AS n FROM sited GROUP BY site HAVING SUM(likely) > 0)
SELECT c.sample_id, c.site, ROUND(COALESCE(CAST(w.n AS DOUBLE), 0.5) / (SELECT MAX(n) FROM w), 6) AS site_prospectivity
FROM sited c LEFT JOIN w USING (site)""")
def q_weight_encode(spark, sf):
    """E1 with learned weights; sites without a positive sample are unknown."""
    d = clean_samples(spark, sf).select("sample_id", "likely", (F.col("sample_id") % 5000).cast("string").alias("site"))
    e = EN.weight_encode(d, "site", EN.learn_weights(d, "site", "likely"))
    return e.select("sample_id", "site", _r("site_prospectivity"))


@query("one_hot", Q.SC + "SELECT sample_id, " + ", ".join(
    f"CAST(COALESCE(lithology = '{lv}', false) AS INTEGER) AS \"lithology_{lv}\"" for lv in LITHOLOGY_LEVELS)
    + " FROM clean")
def q_one_hot(spark, sf):
    d = clean_samples(spark, sf).select("sample_id", "lithology")
    return EN.one_hot(d, "lithology")


@query("one_hot_drop_first", Q.SC + "SELECT sample_id, " + ", ".join(
    f"COALESCE(formation = '{lv}', false) AS \"formation_{lv}\"" for lv in FORMATION_LEVELS[1:])
    + " FROM clean")
def q_one_hot_drop_first(spark, sf):
    d = clean_samples(spark, sf).select("sample_id", "formation")
    return EN.one_hot(d, "formation", drop_first=True, as_bool=True)


@query("category_profile", Q.SC.rstrip() + ",\n" + LEARNED_W + """
SELECT c.lithology, COUNT(*) AS n,
       MIN(ROUND(COALESCE(CAST(w.count AS DOUBLE), 0.5) / (SELECT MAX(count) FROM w), 6)) AS lithology_prospectivity
FROM clean c LEFT JOIN w ON c.lithology = w.category GROUP BY c.lithology""")
def q_category_profile(spark, sf):
    d = clean_samples(spark, sf)
    e = EN.weight_encode(d, "lithology", EN.learn_weights(d, "lithology", "likely"))
    return EN.category_profile(e.withColumn("lithology_prospectivity", _r("lithology_prospectivity")),
                               "lithology", "lithology_prospectivity")


_HASH = "md5(CAST(sample_id AS VARCHAR) || ':42')"


@query("stratified_split", Q.SC + f"""
SELECT sample_id, likely,
       row_number() OVER (PARTITION BY likely ORDER BY {_HASH}, sample_id)
         <= CEIL(0.2 * COUNT(*) OVER (PARTITION BY likely)) AS is_test
FROM clean""")
def q_stratified_split(spark, sf):
    d = clean_samples(spark, sf).select("sample_id", "likely")
    return SA.stratified_split(d)


@query("hash_split", Q.SC + f"""
SELECT sample_id, likely, substr({_HASH}, 1, 8) < '{SA.hash_threshold_hex(0.2)}' AS is_test FROM clean""")
def q_hash_split(spark, sf):
    return SA.hash_split(clean_samples(spark, sf).select("sample_id", "likely"))


@query("stratified_folds", Q.SC + f"""
SELECT sample_id, likely,
       CAST((row_number() OVER (PARTITION BY likely ORDER BY {_HASH}, sample_id) - 1) % 5 AS INTEGER) AS fold
FROM clean""")
def q_stratified_folds(spark, sf):
    return SA.stratified_folds(clean_samples(spark, sf).select("sample_id", "likely"))


_RS_Q = ("rq AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_b"
    for c in ELEMENTS) + " FROM clean)")


@query("robust_scale", Q.SC.rstrip() + ",\n" + _RS_Q + "\nSELECT sample_id, " + ", ".join(
    f"ROUND(({c} - {c}_m) / CASE WHEN {c}_b - {c}_a = 0 THEN 1 ELSE {c}_b - {c}_a END, 6) AS {c}"
    for c in ELEMENTS) + " FROM clean, rq")
def q_robust_scale(spark, sf):
    d = clean_samples(spark, sf).select("sample_id", *ELEMENTS)
    return round_doubles(SC_.robust_scale(d, ELEMENTS))


from terrascore.config import LITHOLOGY_GOLD_COUNTS  # noqa: E402

_FIXED_W = ("CASE " + " ".join(f"WHEN lithology = '{k}' THEN {float(v)}" for k, v in LITHOLOGY_GOLD_COUNTS.items())
            + f" ELSE 0.5 END / {float(max(LITHOLOGY_GOLD_COUNTS.values()))}")


#: levels of the fixed map where the table has others; the rest is unknown
_FIXED_LEVELS = {"BUILDING": "META-BASALT", "AUTOMOBILE": "ARGILLITE", "MACHINERY": "PINK GRANITE"}


@query("weight_encode_fixed", Q.SC.rstrip() + """,
named AS (SELECT sample_id, CASE lithology """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FIXED_LEVELS.items()) + f""" ELSE lithology END AS lithology FROM clean)
SELECT sample_id, lithology, ROUND({_FIXED_W}, 6) AS lithology_prospectivity FROM named""")
def q_weight_encode_fixed(spark, sf):
    """E1 with the fixed occurrence-count map (a literal map expression, no join)."""
    level = F.col("lithology")
    for k, v in _FIXED_LEVELS.items():
        level = F.when(F.col("lithology") == k, F.lit(v)).otherwise(level)
    d = clean_samples(spark, sf).select("sample_id", level.alias("lithology"))
    e = EN.weight_encode(d, "lithology", LITHOLOGY_GOLD_COUNTS)
    return e.select("sample_id", "lithology", _r("lithology_prospectivity"))


@query("one_hot_vector", Q.SC.rstrip() + """,
lv AS (SELECT list(l ORDER BY l) AS levels FROM (SELECT DISTINCT lithology AS l FROM clean))
SELECT sample_id, array_to_string(list_transform(levels, lambda x: CASE WHEN x = lithology THEN 1 ELSE 0 END), '') || '0'
         AS lithology_bits
FROM clean, lv""")
def q_one_hot_vector(spark, sf):
    """E3 for open vocabularies; the vector's last place is for unseen levels."""
    from pyspark.ml.functions import vector_to_array

    _, e = EN.one_hot_vector(clean_samples(spark, sf).select("sample_id", "lithology"), "lithology")
    bits = F.transform(vector_to_array("lithology_vec"), lambda v: v.cast("int").cast("string"))
    return e.select("sample_id", F.array_join(bits, "").alias("lithology_bits"))
