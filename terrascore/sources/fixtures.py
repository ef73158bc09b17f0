"""Sample-point views derived from the TPC-H-like base tables.

``samples``: one row per order -- coordinates, five element-like
measurements (one with planted NULLs), a small-domain grouping column,
a distance, two categories (one with planted NULLs) and a learnable 0/1
target.  ``predictions``: a long table of three pseudo-models' scores
over ``samples``.  Both grow linearly with the base tables.

The lineitem aggregate is partitioned by order key and joined with
``orders`` on the same key, so the first join reuses that partitioning;
``customer`` is joined on its key (AQE turns it into a broadcast only
when its measured size is under the threshold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.sources.tables import read_base

# The three pseudo-models of the predictions view,
# (model, score offset for positives, score offset for negatives, multiplier).
PSEUDO_MODELS = [("m_a", 70, 20, 7), ("m_b", 60, 30, 13), ("m_c", 55, 45, 29)]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_base(spark, sf_dir, "lineitem")
    agg = (li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty_sum"),
        F.max("l_extendedprice").alias("price_max"),
        F.min("l_extendedprice").alias("price_min"),
        F.round(F.sum("l_discount"), 2).alias("disc_sum"),
        F.round(F.sum("l_tax"), 2).alias("tax_sum"),
        F.count(F.lit(1)).alias("n_lines")))
    o = read_base(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read_base(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = (o.join(agg, o.o_orderkey == agg.l_orderkey)
          .join(c, o.o_custkey == c.c_custkey))
    k = F.col("o_orderkey")
    return j.select(
        k.alias("sample_id"),
        (k % 211).cast("double").alias("xcoord"),
        (F.col("o_custkey") % 197).cast("double").alias("ycoord"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("qty_sum")).alias("q1"),
        F.col("price_max").alias("q2"),
        F.col("price_min").alias("q3"),
        F.col("disc_sum").alias("q4"),
        F.col("tax_sum").alias("q5"),
        F.col("n_lines").alias("lineament"),
        ((k * 37) % 3501).cast("double").alias("fault_dist"),
        F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("lithology"),
        F.col("o_orderpriority").alias("formation"),
        F.when((F.col("price_max") > 80000) & (F.col("qty_sum") > 60), F.lit(1)).otherwise(F.lit(0))
         .alias("likely"),
    )


def predictions_from(s: DataFrame) -> DataFrame:
    """Long (sample_id, model, y, probability, prediction) from a samples frame.

    The three models are a generator (``inline`` of a literal array), not
    a join, so each input row simply yields three output rows.
    """
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(hi).alias("hi"),
                                F.lit(lo).alias("lo"), F.lit(k).alias("k"))
                       for m, hi, lo, k in PSEUDO_MODELS])
    z = s.select("sample_id", F.col("likely").alias("y"), F.inline(models))
    prob = ((F.when(F.col("y") == 1, F.col("hi")).otherwise(F.col("lo"))
             + (F.col("sample_id") * F.col("k")) % 100).cast("double") / F.lit(200.0))
    z = z.select("sample_id", "model", "y", prob.alias("probability"))
    return z.withColumn("prediction", F.when(F.col("probability") >= 0.5, F.lit(1)).otherwise(F.lit(0)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_from(samples(spark, sf_dir))
