"""Shared SQL text for the DuckDB oracles: the sample views as CTEs.

The driver registers only the base tables, so every oracle repeats the
views it needs in a ``WITH`` clause.
"""

SAMPLES = """samples AS (
  SELECT o.o_orderkey AS sample_id,
         CAST(o.o_orderkey % 211 AS DOUBLE) AS xcoord,
         CAST(o.o_custkey % 197 AS DOUBLE) AS ycoord,
         CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE a.qty_sum END AS q1,
         a.price_max AS q2, a.price_min AS q3, a.disc_sum AS q4, a.tax_sum AS q5,
         a.n_lines AS lineament,
         CAST((o.o_orderkey * 37) % 3501 AS DOUBLE) AS fault_dist,
         CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE c.c_mktsegment END AS lithology,
         o.o_orderpriority AS formation,
         CASE WHEN a.price_max > 80000 AND a.qty_sum > 60 THEN 1 ELSE 0 END AS likely
  FROM orders o
  JOIN (SELECT l_orderkey, SUM(l_quantity) qty_sum, MAX(l_extendedprice) price_max,
               MIN(l_extendedprice) price_min, ROUND(SUM(l_discount), 2) disc_sum,
               ROUND(SUM(l_tax), 2) tax_sum, COUNT(*) n_lines
        FROM lineitem GROUP BY l_orderkey) a ON a.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
)"""

PREDICTIONS = """predictions AS (
  SELECT sample_id, model, y, probability,
         CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM (
    SELECT sample_id, 'm_a' AS model, likely AS y,
           CAST((CASE WHEN likely = 1 THEN 70 ELSE 20 END) + (sample_id * 7) % 100 AS DOUBLE) / 200 AS probability
    FROM samples
    UNION ALL
    SELECT sample_id, 'm_b', likely,
           CAST((CASE WHEN likely = 1 THEN 60 ELSE 30 END) + (sample_id * 13) % 100 AS DOUBLE) / 200
    FROM samples
    UNION ALL
    SELECT sample_id, 'm_c', likely,
           CAST((CASE WHEN likely = 1 THEN 55 ELSE 45 END) + (sample_id * 29) % 100 AS DOUBLE) / 200
    FROM samples
  ) z
)"""

# clean_data over samples: de-duplicate, impute the one numeric column
# with missing values (q1) by its median, fill the missing category.
CLEAN = """dedup AS (SELECT DISTINCT * FROM {src}),
med AS (SELECT median(q1) AS m1 FROM dedup),
clean AS (
  SELECT sample_id, xcoord, ycoord, COALESCE(q1, med.m1) AS q1, q2, q3, q4, q5, lineament,
         fault_dist, COALESCE(lithology, 'Unknown') AS lithology,
         COALESCE(formation, 'Unknown') AS formation, CAST(likely AS INTEGER) AS likely
  FROM dedup, med
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


S = with_(SAMPLES)
SP = with_(SAMPLES, PREDICTIONS)
SC = with_(SAMPLES, CLEAN.format(src="samples"))
# clean_data on a table holding every sample twice (exercises de-duplication)
DOUBLED = "doubled AS (SELECT * FROM samples UNION ALL SELECT * FROM samples)"
SDC = with_(SAMPLES, DOUBLED, CLEAN.format(src="doubled"))


# Feature formulas of the TESTDATA preset as SQL over ``clean`` (raw values;
# wrap in COALESCE(..., 0) for the reference's final clean-up).
FEATURE_SQL = {
    "alteration_index": "(q4 + q1) / NULLIF(q4 + q1 + q5 + q3, 0) * 100",
    "ccpi_index": "(q1 + q3) / NULLIF(q1 + q3 + q5 + q4, 0) * 100",
    "sericite_index": "q4 / NULLIF(q4 + q5 + 0.001, 0) * 100",
    "silicification_index": "q2 / NULLIF(mn.m_q2, 0)",
    "Au_As_ratio": "q1 / NULLIF(q2 + 0.001, 0)",
    "Au_Sb_ratio": "q1 / NULLIF(q3 + 0.001, 0)",
    "Cu_Pb_ratio": "q5 / NULLIF(q4 + 0.001, 0)",
    "Zn_Pb_ratio": "q2 / NULLIF(q4 + 0.001, 0)",
    "mafic_index": "(q1 + q3) / NULLIF(q2, 0)",
    "alkalinity_ratio": "(q5 + q4) / NULLIF(q2, 0)",
    "mag_gradient": "q3 / NULLIF(q5 + 1, 0)",
    "LREE_sum": "(COALESCE(q1,0) + COALESCE(q2,0) + COALESCE(q3,0) + COALESCE(q4,0) + COALESCE(q5,0))",
    "HREE_sum": "(COALESCE(q3,0) + COALESCE(q4,0) + COALESCE(q5,0) + COALESCE(q1,0) + COALESCE(q2,0)"
                " + COALESCE(q3,0) + COALESCE(q4,0))",
    "Eu_anomaly": "q1 / NULLIF(sqrt(q5 * q3 + 0.001), 0)",
}
FEATURE_SQL["LREE_HREE_ratio"] = f"{FEATURE_SQL['LREE_sum']} / NULLIF({FEATURE_SQL['HREE_sum']} + 0.001, 0)"

BAND_SQL = ("CASE WHEN fault_dist > 0 AND fault_dist <= 500 THEN 'very_close' "
            "WHEN fault_dist > 500 AND fault_dist <= 1000 THEN 'close' "
            "WHEN fault_dist > 1000 AND fault_dist <= 2000 THEN 'moderate' "
            "WHEN fault_dist > 2000 AND fault_dist <= 3000 THEN 'far' "
            "WHEN fault_dist > 3000 THEN 'very_far' END")
BAND_LABELS = ["very_close", "close", "moderate", "far", "very_far"]

# Seven pathfinder tiers of the TESTDATA preset: element -> column
PATHFINDERS = [("Au_ppb", "q1"), ("As_ppm", "q2"), ("Sb_ppm", "q3"), ("Bi_ppm", "q4"),
               ("Cu_ppm", "q5"), ("Pb_ppm", "q4"), ("Zn_ppm", "q2")]
QUANT_CTE = ("q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.75) AS {c}_p75, quantile_cont({c}, 0.9) AS {c}_p90, "
    f"quantile_cont({c}, 0.95) AS {c}_p95" for c in ["q1", "q2", "q3", "q4", "q5"]) + " FROM clean)")
MEAN_CTE = "mn AS (SELECT avg(q2) AS m_q2 FROM clean)"
DENS_CTE = ("dens AS (SELECT lineament, COUNT(*) AS lineament_density FROM clean "
            "WHERE lineament IS NOT NULL GROUP BY lineament)")


def tier_sql(c: str) -> str:
    return (f"CASE WHEN {c} > {c}_p95 THEN 3 WHEN {c} > {c}_p90 THEN 2 "
            f"WHEN {c} > {c}_p75 THEN 1 ELSE 0 END")
