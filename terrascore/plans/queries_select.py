"""Queries over feature selection (2.5) on the engineered sample features."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascore.config import TESTDATA
from terrascore.operators import clean as C
from terrascore.operators import features as FE
from terrascore.operators import select as L
from terrascore.plans import sqltext as Q
from terrascore.plans.queries_prep import clean_samples
from terrascore.plans.registry import query

RAW = ["q1", "q2", "q3", "q4", "q5", "lineament", "fault_dist"]
CREATED = [n for n in FE.created_features(TESTDATA) if not n.startswith("fault_cat_")]
FEATS = RAW + CREATED
MI_K = 30


def features_frame(spark, sf):
    """Prepared feature matrix X (+ sample_id, likely) of the engineered samples."""
    eng = FE.engineer_features(clean_samples(spark, sf), TESTDATA)
    cols = C.feature_columns(eng)
    assert cols == FEATS, cols
    from terrascore.session import materialize
    return materialize(C.prepare_features(eng, cols, keep=["sample_id", "likely"]), "features")


# ---------------------------------------------------------------- SQL text

def _eng_cte() -> str:
    feats = [f"COALESCE({Q.FEATURE_SQL[n]}, 0) AS {n}" for n in
             ["alteration_index", "ccpi_index", "sericite_index", "silicification_index",
              "Au_As_ratio", "Au_Sb_ratio", "Cu_Pb_ratio", "Zn_Pb_ratio", "mafic_index", "alkalinity_ratio"]]
    feats.append("COALESCE(d.lineament_density, 0) AS lineament_density")
    feats.append(f"COALESCE({Q.FEATURE_SQL['mag_gradient']}, 0) AS mag_gradient")
    feats += [f"{Q.tier_sql(c)} AS {e}_anomaly" for e, c in Q.PATHFINDERS]
    feats.append("CAST(" + " + ".join(f"({Q.tier_sql(c)})" for _, c in Q.PATHFINDERS)
                 + " AS BIGINT) AS composite_anomaly_score")
    feats += [f"COALESCE({Q.FEATURE_SQL[n]}, 0) AS {n}" for n in
              ["LREE_sum", "HREE_sum", "LREE_HREE_ratio", "Eu_anomaly"]]
    return ("eng AS (SELECT c.*, " + ", ".join(feats)
            + " FROM clean c LEFT JOIN dens d ON c.lineament = d.lineament, q, mn)")


X_CTE = ("X AS (SELECT sample_id, likely, "
         + ", ".join(f"CAST(COALESCE({f}, 0) AS DOUBLE) AS {f}" for f in FEATS) + " FROM eng)")
SX = (Q.SC.rstrip() + ",\n" + Q.QUANT_CTE + ",\n" + Q.MEAN_CTE + ",\n" + Q.DENS_CTE + ",\n"
      + _eng_cte() + ",\n" + X_CTE)
POS = "fp AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATS)) + ") t(pos, feature))"

VAR_SEL = ("vsel AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, COALESCE(var_pop({f}) > 0.01, false) AS selected FROM X" for f in FEATS) + ")")
PAIRS = [(FEATS[i], FEATS[j]) for j in range(len(FEATS)) for i in range(j)]
CORR = ("cp AS (SELECT feature_a, feature_b, CASE WHEN isnan(r) THEN NULL ELSE r END AS r FROM ("
        + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM X"
                             for a, b in PAIRS) + "))")
CORR_SEL = ("csel AS (SELECT fp.feature, d.feature IS NULL AS selected FROM fp LEFT JOIN "
            "(SELECT DISTINCT feature_b AS feature FROM cp WHERE abs(r) > 0.95) d ON fp.feature = d.feature)")
EDGES = ("ed AS (SELECT " + ", ".join(f"quantile_cont({f}, {k / 10}) AS {f}_e{k}"
                                      for f in FEATS for k in range(1, 10)) + " FROM X)")
BINNED = ("bl AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, " + " + ".join(f"(CASE WHEN {f} > {f}_e{k} THEN 1 ELSE 0 END)" for k in range(1, 10))
    + " AS bin, likely AS y FROM X, ed" for f in FEATS) + ")")
MI = (BINNED + """,
cn AS (SELECT feature, bin, y, COUNT(*) AS n FROM bl GROUP BY feature, bin, y),
ct AS (SELECT feature, n, SUM(n) OVER (PARTITION BY feature) AS n_all,
              SUM(n) OVER (PARTITION BY feature, bin) AS nx, SUM(n) OVER (PARTITION BY feature, y) AS ny FROM cn),
mi AS (SELECT feature, ROUND(SUM((CAST(n AS DOUBLE) / n_all) * ln((CAST(n AS DOUBLE) * n_all) / (CAST(nx AS DOUBLE) * ny))), 12) AS score
       FROM ct GROUP BY feature),
mrank AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM mi),
usel AS (SELECT fp.feature, COALESCE(mrank.rank <= """ + str(MI_K) + """, false) AS selected
         FROM fp LEFT JOIN mrank ON fp.feature = mrank.feature)""")
ALL_SEL = (SX + ",\n" + POS + ",\n" + VAR_SEL + ",\n" + CORR + ",\n" + CORR_SEL + ",\n" + EDGES + ",\n" + MI
           + """,
choices AS (SELECT 'variance' AS method, feature FROM vsel WHERE selected
            UNION ALL SELECT 'correlation', feature FROM csel WHERE selected
            UNION ALL SELECT 'univariate', feature FROM usel WHERE selected)""")


# ---------------------------------------------------------------- Spark side

def _stat_choices(spark, sf, x=None):
    x = x if x is not None else features_frame(spark, sf)
    pairs = L.correlation_pairs(x, FEATS)
    scores = L.mi_scores(x, FEATS, "likely")
    ch = (L.method_table(spark, "variance", L.select_variance(x, FEATS))
          .unionByName(L.method_table(spark, "correlation", L.select_correlation(x, FEATS, pairs=pairs)))
          .unionByName(L.method_table(spark, "univariate", L.select_univariate(x, FEATS, "likely", MI_K, scores))))
    return ch, scores


@query("select_variance", SX + ",\n" + VAR_SEL + "\nSELECT * FROM vsel")
def q_select_variance(spark, sf):
    return L.select_variance(features_frame(spark, sf), FEATS)


@query("correlation_pairs", SX + ",\n" + CORR + "\nSELECT feature_a, feature_b, ROUND(r, 6) AS r FROM cp")
def q_correlation_pairs(spark, sf):
    return L.correlation_pairs(features_frame(spark, sf), FEATS).withColumn("r", F.round("r", 6))


@query("select_correlation", SX + ",\n" + POS + ",\n" + CORR + ",\n" + CORR_SEL + "\nSELECT * FROM csel")
def q_select_correlation(spark, sf):
    return L.select_correlation(features_frame(spark, sf), FEATS)


@query("mutual_information", SX + ",\n" + POS + ",\n" + EDGES + ",\n" + MI
       + "\nSELECT feature, ROUND(score, 6) AS score FROM mi")
def q_mutual_information(spark, sf):
    return L.mi_scores(features_frame(spark, sf), FEATS, "likely").withColumn("score", F.round("score", 6))


@query("select_univariate", SX + ",\n" + POS + ",\n" + EDGES + ",\n" + MI + "\nSELECT * FROM usel")
def q_select_univariate(spark, sf):
    return L.select_univariate(features_frame(spark, sf), FEATS, "likely", MI_K)


@query("feature_scores", SX + ",\n" + POS + ",\n" + EDGES + ",\n" + MI
       + "\nSELECT 'mutual_info' AS method, feature, ROUND(score, 6) AS score, rank FROM mrank")
def q_feature_scores(spark, sf):
    s = L.mi_scores(features_frame(spark, sf), FEATS, "likely")
    return L.feature_scores(s, "mutual_info").withColumn("score", F.round("score", 6)) \
        .withColumn("rank", F.col("rank").cast("long"))


@query("selection_votes", ALL_SEL + """
SELECT fp.pos, fp.feature, COALESCE(v.votes, 0) AS votes, COALESCE(v.votes, 0) >= 2 AS selected
FROM fp LEFT JOIN (SELECT feature, COUNT(DISTINCT method) AS votes FROM choices GROUP BY feature) v
  ON fp.feature = v.feature""")
def q_selection_votes(spark, sf):
    ch, _ = _stat_choices(spark, sf)
    return L.selection_votes(ch, FEATS, min_votes=2)


@query("selection_summary", ALL_SEL + "\nSELECT method, COUNT(*) AS n_features FROM choices GROUP BY method")
def q_selection_summary(spark, sf):
    ch, _ = _stat_choices(spark, sf)
    return L.selection_summary(ch)


@query("selection_report", ALL_SEL + """
SELECT method, COUNT(*) AS n_features,
       string_agg(CASE WHEN rn <= 10 THEN feature END, ',' ORDER BY pos) AS first_features
FROM (SELECT c.method, c.feature, fp.pos, row_number() OVER (PARTITION BY c.method ORDER BY fp.pos) AS rn
      FROM choices c JOIN fp ON c.feature = fp.feature) GROUP BY method""")
def q_selection_report(spark, sf):
    ch, _ = _stat_choices(spark, sf)
    pos = spark.createDataFrame(list(enumerate(FEATS)), "pos int, feature string")
    rep = L.selection_report(ch.join(pos, "feature"))
    return rep.select("method", "n_features", F.array_join("first_features", ",").alias("first_features"))


@query("selection_score_tops", ALL_SEL + """,
votes AS (SELECT feature, CAST(COUNT(DISTINCT method) AS DOUBLE) AS score FROM choices GROUP BY feature),
tops AS (SELECT 'mutual_info' AS method, rank, feature, score FROM mrank
         UNION ALL SELECT 'ensemble_votes', row_number() OVER (ORDER BY score DESC, feature), feature, score FROM votes)
SELECT method, CAST(rank AS INTEGER) AS rank, feature, ROUND(score, 6) AS score FROM tops WHERE rank <= 20""")
def q_selection_score_tops(spark, sf):
    """L9/L10 the first rows (10 in the report, 20 in the summary) of each score table."""
    ch, scores = _stat_choices(spark, sf)
    votes = ch.groupBy("feature").agg(F.count_distinct("method").alias("score"))
    return L.score_tops({"mutual_info": scores, "ensemble_votes": votes}, 20).withColumn("score", F.round("score", 6))


_COLS = """
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS pos, feature
FROM (UNPIVOT (SELECT typeof(COLUMNS(*)) FROM (SELECT eng.*, """ + ", ".join(
    f"({Q.BAND_SQL}) = '{b}' AS fault_cat_{b}" for b in Q.BAND_LABELS) + """ FROM eng) LIMIT 1)
      ON COLUMNS(*) INTO NAME feature VALUE kind)
WHERE kind IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER') AND feature NOT IN ('sample_id', 'xcoord', 'ycoord', 'likely')"""
_WALK = Q.SC.rstrip() + ",\n" + Q.QUANT_CTE + ",\n" + Q.MEAN_CTE + ",\n" + Q.DENS_CTE + ",\n" + _eng_cte()


@query("feature_columns", _WALK + ",\nwalk AS (" + _COLS + ")\nSELECT feature FROM walk")
def q_feature_columns(spark, sf):
    """P6 the columns that are features, by type: band dummies, strings, key,
    target and coordinates are none."""
    cols = C.feature_columns(FE.engineer_features(clean_samples(spark, sf), TESTDATA))
    return spark.createDataFrame([(c,) for c in cols], "feature string")


@query("feature_categories", _WALK + ",\nwalk AS (" + _COLS + """)
SELECT feature, CASE WHEN feature = 'fault_dist' THEN 'structural' WHEN feature = 'lineament' THEN 'structural'
                     WHEN contains(feature, 'index') OR contains(feature, 'ratio') OR contains(feature, 'anomaly') THEN 'engineered'
                     ELSE 'other' END AS category FROM walk""")
def q_feature_categories(spark, sf):
    """F23 the category of each feature of the engineered table."""
    cols = C.feature_columns(FE.engineer_features(clean_samples(spark, sf), TESTDATA))
    return spark.createDataFrame(FE.feature_categories(cols), "feature string, category string")


@query("feature_groups", _WALK + ",\nwalk AS (" + _COLS + """),
made AS (SELECT feature FROM walk WHERE feature NOT IN ('q1', 'q2', 'q3', 'q4', 'q5', 'lineament', 'fault_dist')
         UNION ALL SELECT 'fault_cat_' || unnest(['very_close', 'close', 'moderate', 'far', 'very_far']))
SELECT 'engineered_alteration' AS grp, feature FROM made WHERE contains(feature, 'index') OR contains(feature, 'ratio')
UNION ALL SELECT 'engineered_anomaly', feature FROM made WHERE contains(feature, 'anomaly')
UNION ALL SELECT 'engineered_spatial', feature FROM made WHERE contains(feature, 'fault') OR contains(feature, 'lineament') OR contains(feature, 'mag')
UNION ALL SELECT 'engineered_ree', feature FROM made WHERE contains(feature, 'REE') OR contains(feature, 'Eu_anomaly')""")
def q_feature_groups(spark, sf):
    """F23 the groups of created features of the engineered table."""
    base = clean_samples(spark, sf)
    made = [c for c in FE.engineer_features(base, TESTDATA).columns if c not in base.columns]
    return spark.createDataFrame(FE.feature_groups(made, {"none": []}), "grp string, feature string")


_GROUPED = """
SELECT 'mutual_info' AS model, feature, ROUND(score, 6) AS importance, rank,
       CASE WHEN feature IN ('fault_dist', 'lineament') THEN 'structural'
            WHEN contains(feature, 'index') OR contains(feature, 'ratio') OR contains(feature, 'anomaly') THEN 'engineered'
            ELSE 'other' END AS category
FROM mrank WHERE rank <= 20"""


@query("scores_by_group", SX + ",\n" + POS + ",\n" + EDGES + ",\n" + MI + _GROUPED)
def q_scores_by_group(spark, sf):
    """V5 mutual information as importance, with feature groups."""
    from terrascore.operators import spatial as V

    s = L.mi_scores(features_frame(spark, sf), FEATS, "likely").select(F.lit("mutual_info").alias("model"), "feature", F.col("score").alias("importance"))
    return V.importance_by_group(s).withColumn("importance", F.round("importance", 6)).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- model-based selectors (rows only)

@query("select_rfe")
def q_select_rfe(spark, sf):
    return L.method_table(spark, "rfe", L.select_rfe(features_frame(spark, sf), FEATS, "likely"))


@query("select_tree")
def q_select_tree(spark, sf):
    return L.method_table(spark, "tree_based", L.select_tree(features_frame(spark, sf), FEATS, "likely"))


@query("select_lasso")
def q_select_lasso(spark, sf):
    return L.method_table(spark, "lasso", L.select_lasso(features_frame(spark, sf), FEATS, "likely"))


@query("ensemble_selection")
def q_ensemble_selection(spark, sf):
    """All six selectors, kept at >= 3 votes (the reference's rule)."""
    return L.selection_votes(L.ensemble_choices(features_frame(spark, sf), FEATS, "likely", MI_K), FEATS)


@query("feature_override", SX + ",\n" + POS + ",\n" + VAR_SEL + """,
kept AS (SELECT fp.pos, fp.feature FROM fp JOIN vsel v ON fp.feature = v.feature
         WHERE v.selected OR fp.feature IN ('fault_dist', 'lineament'))
SELECT row_number() OVER (ORDER BY feature IN ('fault_dist', 'lineament') AND NOT feature IN
           (SELECT feature FROM vsel WHERE selected), pos) - 1 AS pos, feature
FROM kept WHERE feature <> 'q1'""")
def q_feature_override(spark, sf):
    """P12 on the variance selector's choice: two columns in, one out."""
    v = L.select_variance(features_frame(spark, sf), FEATS).where("selected").collect()  # one row per feature
    chosen = {r["feature"] for r in v}
    kept = C.feature_override([f for f in FEATS if f in chosen], ["lineament", "fault_dist"], ["q1"])
    return spark.createDataFrame(list(enumerate(kept)), "pos long, feature string")


