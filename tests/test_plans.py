"""Physical-plan properties the operators rely on at scale."""

from pyspark.sql import functions as F

from tests.conftest import SF0001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sample_view_prunes_and_preaggregates(spark):
    from terrascore.sources.fixtures import samples

    p = _plan(samples(spark, SF0001))
    li = [ln for ln in p.splitlines() if "lineitem.parquet" in ln][0]
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double," \
           "l_discount:double,l_tax:double>" in li
    assert "partial_sum(l_quantity" in p  # map-side combine before the shuffle
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_reach_the_scan(spark):
    from terrascore.operators.clean import filter_range
    from terrascore.sources.tables import load_table

    o = load_table(spark, f"{SF0001}/orders.parquet", where=F.col("o_totalprice") <= 1000.0)
    p = _plan(o.select("o_orderkey"))
    assert "LessThanOrEqual(o_totalprice,1000.0)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_group_density_is_aggregate_join_not_window(spark):
    from terrascore.operators.features import group_density
    from terrascore.sources.fixtures import samples

    p = _plan(group_density(samples(spark, SF0001), "lineament"))
    assert "Window" not in p and "partial_count" in p


def test_idw_has_no_pairs(spark):
    from terrascore.operators.spatial import idw_grid
    from terrascore.sources.fixtures import samples

    p = _plan(idw_grid(samples(spark, SF0001), "xcoord", "ycoord", "q2", 10, 10))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert "MapInPandas" in p and "partial_sum" in p


def test_ensembles_group_by_sample(spark):
    from terrascore.operators.ensemble import vote_soft
    from terrascore.sources.fixtures import predictions

    p = _plan(vote_soft(predictions(spark, SF0001)))
    assert "partial_avg" in p and "Window" not in p


def test_raw_scan_filter_equals_filter_after_nan_conversion(spark):
    import tempfile

    from terrascore.operators.clean import filter_range
    from terrascore.sources.tables import load_table

    rows = [(1, 10.0), (2, float("nan")), (3, None), (4, 2300.0), (5, 2300.5)]
    path = tempfile.mkdtemp(prefix="nanpush-") + "/t"
    spark.createDataFrame(rows, "id long, d double").write.parquet(path)
    pushed = load_table(spark, path, where=F.col("d") <= 2300.0)
    after = filter_range(load_table(spark, path), "d", max_value=2300.0)
    assert sorted(r["id"] for r in pushed.collect()) == sorted(r["id"] for r in after.collect()) == [1, 4]
