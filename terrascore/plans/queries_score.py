"""Queries over scoring (2.9) and spatial/descriptive tables (2.10).

The SQL-checked ones score samples with the deterministic pseudo-model
``m_a`` of the predictions view (``raw_score``); ``score_samples`` and
the surface queries use a fitted model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascore.operators import score as C
from terrascore.operators import select as L
from terrascore.operators import spatial as V
from terrascore.config import TESTDATA
from terrascore.operators import features as FE
from terrascore.operators.clean import clean_data
from terrascore.plans import queries_eval as EV
from terrascore.plans import queries_select as QS
from terrascore.plans import sqltext as Q
from terrascore.plans.queries_eval import rnd
from terrascore.plans.registry import query
from terrascore.session import materialize
from terrascore.sources.fixtures import samples

RAW_SQL = "CAST((CASE WHEN likely = 1 THEN 70 ELSE 20 END) + (sample_id * 7) % 100 AS DOUBLE) / 200"
SCORED = Q.S.rstrip() + f""",
scored AS (SELECT sample_id, xcoord, ycoord, fault_dist, q2, likely, {RAW_SQL} AS raw_score FROM samples)
"""


def scored_samples(spark, sf):
    s = samples(spark, sf)
    raw = ((F.when(F.col("likely") == 1, F.lit(70)).otherwise(F.lit(20)) + (F.col("sample_id") * 7) % 100)
           .cast("double") / F.lit(200.0))
    return s.select("sample_id", "xcoord", "ycoord", "fault_dist", "q2", "likely", raw.alias("raw_score"))


_RESCALE = ("ROUND((raw_score - (SELECT MIN(raw_score) FROM scored)) / "
            "((SELECT MAX(raw_score) FROM scored) - (SELECT MIN(raw_score) FROM scored)) * 0.25 + 0.7, 6)")


@query("rescale_scores", SCORED + f"""
SELECT sample_id, ROUND(raw_score, 6) AS raw_score, {_RESCALE} AS prospectivity_score,
       CAST({_RESCALE} > 0.7 AS INTEGER) AS prospectivity_class, xcoord, ycoord, fault_dist FROM scored""")
def q_rescale_scores(spark, sf):
    s = C.rescale_scores(scored_samples(spark, sf))
    s = s.withColumn("prospectivity_score", F.round("prospectivity_score", 6))
    return s.select("sample_id", F.round("raw_score", 6).alias("raw_score"), "prospectivity_score",
                    C.score_class("prospectivity_score").alias("prospectivity_class"),
                    "xcoord", "ycoord", "fault_dist")


@query("score_class", SCORED + f"""
SELECT CAST((raw_score - (SELECT MIN(raw_score) FROM scored)) /
            ((SELECT MAX(raw_score) FROM scored) - (SELECT MIN(raw_score) FROM scored)) * 0.25 + 0.7 > 0.7
            AS INTEGER) AS prospectivity_class, COUNT(*) AS n
FROM scored GROUP BY 1""")
def q_score_class(spark, sf):
    s = C.rescale_scores(scored_samples(spark, sf))
    return (s.select(C.score_class("prospectivity_score").alias("prospectivity_class"))
             .groupBy("prospectivity_class").agg(F.count(F.lit(1)).alias("n")))


@query("area_tiers", SCORED + """
SELECT COUNT(*) FILTER (WHERE raw_score >= 0.7) AS high,
       COUNT(*) FILTER (WHERE raw_score >= 0.5 AND raw_score < 0.7) AS moderate,
       COUNT(*) FILTER (WHERE raw_score < 0.5) AS low FROM scored""")
def q_area_tiers(spark, sf):
    return C.area_tiers(scored_samples(spark, sf))


@query("map_tiers", SCORED + """
SELECT COUNT(*) FILTER (WHERE c > 0.7) AS high, COUNT(*) FILTER (WHERE c >= 0.5 AND c <= 0.7) AS moderate,
       COUNT(*) FILTER (WHERE c < 0.5) AS low
FROM (SELECT greatest(0.0, least(1.0, raw_score)) AS c FROM scored)""")
def q_map_tiers(spark, sf):
    return C.map_tiers(scored_samples(spark, sf))


PRIORITY_SQL = ("CASE WHEN raw_score > 0 AND raw_score <= 0.3 THEN 'Very Low' "
                "WHEN raw_score > 0.3 AND raw_score <= 0.5 THEN 'Low' "
                "WHEN raw_score > 0.5 AND raw_score <= 0.7 THEN 'Moderate' "
                "WHEN raw_score > 0.7 AND raw_score <= 0.9 THEN 'High' "
                "WHEN raw_score > 0.9 AND raw_score <= 1.0 THEN 'Very High' END")


@query("priority_bands", SCORED + f"""
SELECT priority, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
FROM (SELECT {PRIORITY_SQL} AS priority FROM (SELECT CASE sample_id % 50 WHEN 0 THEN 0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.9 WHEN 3 THEN 1 ELSE raw_score END AS raw_score
                                               FROM scored)) GROUP BY priority""")
def q_priority_bands(spark, sf):
    """C7 over scores that also lie on the bands' edges."""
    k, s = F.col("sample_id") % 50, F.col("raw_score")
    edge = F.when(k == 0, F.lit(0.0)).when(k == 1, F.lit(0.3)).when(k == 2, F.lit(0.9)).when(k == 3, F.lit(1.0)).otherwise(s)
    return rnd(C.priority_bands(scored_samples(spark, sf).withColumn("raw_score", edge)))


def _box_sql(src: str, group: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT b.{group}, '{c}' AS feature, ROUND(q.a, 6) AS q1, ROUND(q.m, 6) AS median,
            ROUND(q.b, 6) AS q3,
            ROUND(MIN(CASE WHEN b.{c} >= q.a - 1.5 * (q.b - q.a) THEN b.{c} END), 6) AS whisker_low,
            ROUND(MAX(CASE WHEN b.{c} <= q.b + 1.5 * (q.b - q.a) THEN b.{c} END), 6) AS whisker_high,
            COUNT(*) AS n
          FROM {src} b JOIN (SELECT {group}, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS m,
                                    quantile_cont({c}, 0.75) AS b FROM {src} WHERE {c} IS NOT NULL GROUP BY {group}) q
            ON b.{group} = q.{group}
          WHERE b.{c} IS NOT NULL GROUP BY b.{group}, q.a, q.m, q.b""")
    return " UNION ALL ".join(parts)


@query("band_boxstats", SCORED.rstrip() + f""",
banded AS (SELECT {PRIORITY_SQL} AS priority, q2 FROM scored)
""" + _box_sql("(SELECT * FROM banded WHERE priority IS NOT NULL)", "priority", ["q2"]))
def q_band_boxstats(spark, sf):
    return rnd(C.band_boxstats(scored_samples(spark, sf), "q2"))


@query("class_histogram", Q.S.rstrip() + """,
r AS (SELECT likely, MIN(q2) AS mn, MAX(q2) AS mx, COUNT(*) AS n_all FROM samples WHERE q2 IS NOT NULL GROUP BY likely),
r2 AS (SELECT likely, CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo,
              CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi, n_all FROM r),
h AS (SELECT s.likely, CAST(least(floor((s.q2 - r2.lo) / ((r2.hi - r2.lo) / 30)), 29) AS INTEGER) AS bin,
             r2.lo, r2.hi, r2.n_all
      FROM samples s JOIN r2 ON s.likely = r2.likely WHERE s.q2 IS NOT NULL)
SELECT likely, bin, ROUND(lo + bin * ((hi - lo) / 30), 6) AS bin_start,
       ROUND(lo + (bin + 1) * ((hi - lo) / 30), 6) AS bin_end, COUNT(*) AS n,
       ROUND(COUNT(*) / (n_all * ((hi - lo) / 30)), 6) AS density
FROM h GROUP BY likely, bin, lo, hi, n_all""")
def q_class_histogram(spark, sf):
    return rnd(V.class_histogram(samples(spark, sf), "q2", "likely"))


EL = ["q1", "q2", "q3", "q4", "q5"]


@query("association_matrix", Q.S + " UNION ALL ".join(
    f"SELECT '{EL[i]}' AS feature_a, '{EL[j]}' AS feature_b, ROUND(corr({EL[i]}, {EL[j]}), 6) AS r FROM samples "
    f"WHERE {' AND '.join(x + ' IS NOT NULL' for x in EL)}"
    for j in range(len(EL)) for i in range(j)))
def q_association_matrix(spark, sf):
    s = samples(spark, sf).dropna(subset=EL)
    return L.correlation_pairs(s, EL).withColumn("r", F.round("r", 6))


_IDX = [n for n in FE.created_features(TESTDATA) if "index" in n or "ratio" in n]
_IDX_CTE = (Q.SC.rstrip() + ",\n" + Q.MEAN_CTE + """,
idx AS (SELECT lithology, """ + ", ".join(f"COALESCE({Q.FEATURE_SQL[n]}, 0) AS {n}" for n in _IDX) + """ FROM clean, mn)""")


@query("boxstats_by_top_category", _IDX_CTE + """,
top AS (SELECT lithology FROM idx GROUP BY lithology ORDER BY COUNT(*) DESC, lithology LIMIT 6),
sub AS (SELECT * FROM idx WHERE lithology IN (SELECT lithology FROM top))
""" + _box_sql("sub", "lithology", _IDX))
def q_boxstats_by_top_category(spark, sf):
    """V3 every index and ratio by the six most frequent categories."""
    d = FE.engineer_features(clean_data(samples(spark, sf)), TESTDATA)
    return rnd(V.boxstats_by_top_category(d, "lithology", V.index_ratio_columns(d.columns), k=6))


@query("index_histograms", _IDX_CTE + " " + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, bin, ROUND(lo + bin * ((hi - lo) / 30), 6) AS bin_start, ROUND(lo + (bin + 1) * ((hi - lo) / 30), 6) AS bin_end, COUNT(*) AS n
FROM (SELECT lo, hi, CAST(least(floor(({c} - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin
      FROM idx, (SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM idx)) GROUP BY bin, lo, hi""" for c in _IDX))
def q_index_histograms(spark, sf):
    """V3 where there is no category: 30 bins of every index and ratio."""
    d = FE.engineer_features(clean_data(samples(spark, sf)), TESTDATA)
    return rnd(V.histogram(d, V.index_ratio_columns(d.columns)))


@query("spatial_layers", Q.S + " UNION ALL ".join(
    f"SELECT sample_id, xcoord AS x, ycoord AS y, '{n}' AS layer, CAST({e} AS DOUBLE) AS value FROM samples"
    for n, e in [("likely", "likely"), ("fault_dist", "fault_dist"), ("q2", "q2"),
                 ("log1p_q2", "ROUND(ln(1 + q2), 6)")]) + """
UNION ALL SELECT sample_id, xcoord, ycoord, 'category', CAST(r AS DOUBLE)
FROM samples LEFT JOIN (SELECT lithology, row_number() OVER (ORDER BY COUNT(*) DESC, lithology) - 1 AS r FROM samples
                        WHERE lithology IS NOT NULL GROUP BY lithology) t USING (lithology)""")
def q_spatial_layers(spark, sf):
    """V4 label, distance, element, log1p(element) (F24) and category layers."""
    s = V.category_layer(samples(spark, sf), "lithology")
    return V.spatial_layers(s, {"likely": F.col("likely"), "fault_dist": F.col("fault_dist"), "q2": F.col("q2"),
                                "log1p_q2": F.round(FE.log1p("q2"), 6), "category": F.col("category_rank")})


G = 200


def _grid_sql(src: str, z: str) -> str:
    return f"""ext AS (SELECT MIN(xcoord) AS x0, MAX(xcoord) AS x1, MIN(ycoord) AS y0, MAX(ycoord) AS y1 FROM {src}
        WHERE {z} IS NOT NULL),
gx AS (SELECT i AS ix, CASE WHEN i = {G - 1} THEN x1 ELSE i * ((x1 - x0) / {G - 1}) + x0 END AS gx
       FROM range({G}) t(i), ext),
gy AS (SELECT i AS iy, CASE WHEN i = {G - 1} THEN y1 ELSE i * ((y1 - y0) / {G - 1}) + y0 END AS gy
       FROM range({G}) t(i), ext),
pts AS (SELECT xcoord AS x, ycoord AS y, {z} AS z FROM {src} WHERE {z} IS NOT NULL),
pw AS (SELECT ix, iy, gx, gy, z,
              1.0 / pow(CASE WHEN sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y)) = 0 THEN 1e-10
                             ELSE sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y)) END, 2) AS w
       FROM gx, gy, pts),
grid AS (SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, ROUND(gx, 6) AS gx, ROUND(gy, 6) AS gy,
       ROUND(SUM(w * z) / SUM(w), 6) AS z
FROM pw GROUP BY ix, iy, gx, gy)"""


@query("idw_grid", Q.S.rstrip() + ",\n" + _grid_sql("samples", "q2") + "\nSELECT * FROM grid")
def q_idw_grid(spark, sf):
    return rnd(V.idw_grid(samples(spark, sf), "xcoord", "ycoord", "q2", G, G))


_SURFACE = SCORED.rstrip() + ",\n" + _grid_sql("(SELECT xcoord, ycoord, greatest(0.0, least(1.0, raw_score)) AS raw_score FROM scored)", "raw_score")


@query("prospectivity_surface", _SURFACE + "\nSELECT * FROM grid")
def q_prospectivity_surface(spark, sf):
    """V7 the surface of the scores."""
    return rnd(V.prospectivity_surface(scored_samples(spark, sf), n=G))


@query("surface_classes", _SURFACE + """
SELECT CAST((z >= 0.3) AS INTEGER) + CAST((z >= 0.5) AS INTEGER) + CAST((z >= 0.7) AS INTEGER) + CAST((z >= 0.9) AS INTEGER) AS level_class,
       COUNT(*) AS cells FROM grid GROUP BY 1""")
def q_surface_classes(spark, sf):
    """V8 cells of the surface by contour class."""
    return V.surface_classes(rnd(V.prospectivity_surface(scored_samples(spark, sf), n=G)))


@query("predictions_csv", SCORED + f"""
SELECT sample_id, {_RESCALE} AS prospectivity_score, xcoord, ycoord, fault_dist, CAST({_RESCALE} > 0.7 AS INTEGER) AS prospectivity_class,
       ROUND(raw_score, 6) AS raw_score FROM scored""")
def q_predictions_csv(spark, sf):
    """S3 the predictions written as CSV with a header and read back."""
    import uuid

    from terrascore.session import checkpoint_root
    from terrascore.sources.sinks import write_predictions

    path = f"{checkpoint_root(spark).rstrip('/')}/predictions-{uuid.uuid4().hex}"
    write_predictions(q_rescale_scores(spark, sf), path)
    return spark.read.option("header", True).schema(
        "sample_id long, prospectivity_score double, xcoord double, ycoord double, fault_dist double, prospectivity_class int, raw_score double").csv(path)


@query("surface_tiled")
def q_surface_tiled(spark, sf):
    """V7 by tiles: each cell within 0.001 of ``prospectivity_surface``."""
    return V.prospectivity_surface(scored_samples(spark, sf), n=G, tolerance=1e-3)


_SUMMARY = (EV.SP + ",\n" + Q.CLEAN.format(src="samples").rstrip() + ",\n" + Q.QUANT_CTE + ",\n" + Q.MEAN_CTE + ",\n" + Q.DENS_CTE + ",\n"
            + QS._eng_cte() + ",\n" + QS.X_CTE + ",\n" + QS.VAR_SEL + ",\n" + EV._ALL_EVAL + ",\nam AS (" + EV._ALL_METRICS + "),\n" + EV._FIRST + f""",
scored AS (SELECT {RAW_SQL} AS raw_score FROM samples),
summary AS (SELECT {len(QS.FEATS)} AS candidate_features, CAST((SELECT COUNT(*) FROM vsel WHERE selected) AS INTEGER) AS selected_features,
       {len(FE.created_features(TESTDATA))} AS engineered_features, CAST((SELECT COUNT(*) FROM am) AS INTEGER) AS models_trained,
       (SELECT model FROM first_) AS best_model, (SELECT roc_auc FROM first_) AS best_model_auc, COUNT(*) AS samples_scored,
       COUNT(*) FILTER (WHERE raw_score >= 0.7) AS high_potential_areas,
       COUNT(*) FILTER (WHERE raw_score >= 0.5 AND raw_score < 0.7) AS moderate_potential_areas,
       COUNT(*) FILTER (WHERE raw_score < 0.5) AS low_potential_areas FROM scored)""")


def _pseudo_summary(spark, sf):
    """The summary of a run whose models are the pseudo-models and whose
    selector is the variance threshold."""
    chosen = L.select_variance(QS.features_frame(spark, sf), QS.FEATS).where("selected").count()
    metrics = materialize(EV.all_metrics(spark, sf), "metrics")
    best = metrics.orderBy(F.desc_nulls_last("roc_auc"), F.desc("type"), F.asc("model")).first()
    return C.summary_table(scored_samples(spark, sf), len(QS.FEATS), chosen, len(FE.created_features(TESTDATA)), metrics.count(), best["model"], best["roc_auc"])


@query("run_summary", _SUMMARY + "\nSELECT * FROM summary")
def q_run_summary(spark, sf):
    """C9 the run's counts."""
    return _pseudo_summary(spark, sf)


@query("run_texts", _SUMMARY + """
SELECT 'finding' AS part, 'best_model' AS item, printf('%s scored best, ROC-AUC %.4f', best_model, best_model_auc) AS text FROM summary
UNION ALL SELECT 'finding', 'features', printf('%d features were engineered, %d of %d candidates selected', engineered_features, selected_features, candidate_features) FROM summary
UNION ALL SELECT 'finding', 'targets', printf('%d of %d areas have high potential', high_potential_areas, samples_scored) FROM summary
UNION ALL SELECT 'advice', 'explore', printf('explore the %d areas of high potential first', high_potential_areas) FROM summary
UNION ALL SELECT 'advice', 'sample', printf('take more samples in the %d areas of moderate potential', moderate_potential_areas) FROM summary
UNION ALL SELECT 'advice', 'update', 'score again when new samples come in'""")
def q_run_texts(spark, sf):
    """C9 its findings and advice."""
    return C.summary_texts(_pseudo_summary(spark, sf))
