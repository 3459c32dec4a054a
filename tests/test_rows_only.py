"""Checks for the queries without a DuckDB oracle, and scan pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsense.operators import clusters as C
from shelfsense.operators import pricing as P
from shelfsense.operators import properties as PR
from shelfsense.operators import recommend as R
from shelfsense.operators import sales as S
from shelfsense.plans import catalog as K
from shelfsense.sources import read_table, write_table

D = "/root/testdata/sf0.001"


def test_price_curve_is_least_squares_cubic(spark):
    cur = P.price_curve(K.points_of(spark, D)).toPandas()
    for _, g in cur.groupby("description"):
        if len(g) < 4:
            assert g.fit_units.isna().all()
            continue
        coef = np.polyfit(g.unit_price - g.unit_price.mean(), g.number_sold, 3)
        fit = np.polyval(coef, g.unit_price - g.unit_price.mean())
        assert np.allclose(fit, g.fit_units, atol=1e-5)
        assert np.allclose(((g.number_sold - fit) ** 2).sum(), g.ssr_units.iloc[0], atol=1e-3)


def test_price_curve_is_null_beyond_the_smoothing_factor(spark):
    rows = [("p", float(i), float((-1) ** i * 2000), 0.0) for i in range(8)] + [("q", 1.0, 1.0, 1.0)]
    pts = spark.createDataFrame(rows, "description string, unit_price double, number_sold double, revenue double")
    got = P.price_curve(pts).where("description = 'p'").collect()
    assert all(r.fit_units is None and r.ssr_units > P.SMOOTHING and r.fit_revenue == 0 for r in got)


@pytest.mark.parametrize("n", [100, 10_000])
def test_clusters_take_one_path_at_every_size(spark, n):
    attrs = spark.range(n).selectExpr(
        "id AS property_id", "cast(id AS string) AS property_code", "concat('K', id % 3) AS kind",
        "concat('G', id % 4) AS guest_profile", "if(id % 11 = 0, null, concat('L', id % 5)) AS location_type",
        "if(id % 5 = 1, 'CAD', 'USD') AS currency", "concat('F', id % 20) AS flag_name", "cast(id % 10 AS string) AS zip",
        "cast(id % 6 + 1 AS long) * 10 AS props_under_mgmt", "cast(20 + (id * 37) % 400 AS int) AS rooms")
    feats = PR.property_features(attrs)
    got = C.property_clusters(attrs, feats, 4)
    rows = got.select("property_id", "cluster", "rooms").collect()
    assert len(rows) == n and {r.cluster for r in rows} == set(range(4))
    firsts = [min(r.property_id for r in rows if r.cluster == c) for c in range(4)]
    assert firsts == sorted(firsts)
    # rooms, the widest feature, separates the clusters
    spans = sorted((min(r.rooms for r in rows if r.cluster == c), max(r.rooms for r in rows if r.cluster == c)) for c in range(4))
    assert sum(hi - lo for lo, hi in spans) < 1.2 * 400
    assert {r.cluster for r in C.cut_clusters(attrs, feats, 2).select("cluster").distinct().collect()} == {0, 1}


def test_labels_are_written_and_read_by_the_recommender(spark, tmp_path):
    path = str(tmp_path / "labels")
    write_table(K.clusters_of(spark, D, 3).select("property_code", "cluster"), path)
    twice = read_table(spark, path).unionByName(read_table(spark, path).withColumn("cluster", F.lit(-1)))
    labels = C.cluster_labels_by_code(twice)  # the largest label of a code
    sales = S.clustered_sales(K.sales_of(spark, D), labels)
    got = {(r.property_code, r.cluster) for r in S.property_cluster(S.sales_base(sales)).collect()}
    want = {r.property_code: r.cluster for r in read_table(spark, path).collect()}
    assert got == {(c, want.get(c)) for c, _ in got} and len({x for _, x in got if x is not None}) > 1
    adds = R.stocking_suggestions(S.sales_base(sales), 5)
    assert adds.count() > 0 and adds.where("cluster is null").count() == 0


def test_clustered_sales_use_labels(spark):
    cs = K.clustered_sales_of(spark, D)
    labels = K.fixed_clusters_of(spark, D).select("property_code", F.col("cluster").alias("label"))
    j = cs.join(labels, "property_code")
    assert j.count() > 0 and j.where(~F.col("cluster").eqNullSafe(F.col("label"))).count() == 0


def test_store_side_is_not_shuffled_on_heavy_keys_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        base = S.sales_base(K.sales_of(spark, D))
        df = R.stocking_suggestions(base, 5)
        assert df.collect()  # runs the frame's own execution, whose plan is final then
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "cluster" in line]
    assert joins and all("_salt" in line for line in joins)


def test_shared_frames_are_released(spark):
    from shelfsense.plans.materialize import Shared
    with Shared() as shared:
        kept = shared.keep(K.base_of(spark, D))
        assert kept.is_cached
    assert not kept.is_cached


def test_month_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "sales")
    write_table(K.sales_of(spark, D, "month"), path, partition_by=["transaction_month"])
    df = S.sales_by_month(read_table(spark, path), "1998-06")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(transaction_month" in plan
    assert df.count() == S.sales_by_month(K.sales_of(spark, D, "month"), "1998-06").count()
