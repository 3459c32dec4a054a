"""Edge fixtures (FIXTURES.md section 4)."""

import math

from pyspark.sql import functions as F

from shelfsense.functions import half_even, zip_zone
from shelfsense.operators import lookups as L
from shelfsense.operators import pricing as P
from shelfsense.operators import properties as PR
from shelfsense.operators import recommend as R
from shelfsense.operators import sales as S
from shelfsense.schemas import SALES
from shelfsense.sources import read_pipe_text, write_pipe_text


def test_ties_order(make_sales):
    rows = [("S", 0, "C", d, "M", u) for d, u in [("b", 5), ("a", 5), ("d", 7), ("c", 5)]]
    base = S.sales_base(make_sales(rows))
    got = [r.description for r in S.store_ranking(base).orderBy("rank").collect()]
    assert got == ["d", "a", "b", "c"]
    got = [r.description for r in S.cluster_top(base, 4).orderBy("rank").collect()]
    assert got == ["d", "a", "b", "c"]


def test_nonpositive_units_excluded(make_sales):
    rows = [("S", 0, "C", "x", "M", 0), ("S", 0, "C", "y", "M", -3), ("S", 0, "C", "z", "M", None),
            ("S", 0, "C", "w", "M", 4)]
    base = S.sales_base(make_sales(rows))
    r = S.store_ranking(base).collect()
    assert [(x.description, x.number_sold) for x in r] == [("w", 4)]
    assert [x.description for x in S.national_top(base, 5).collect()] == ["w"]


def test_null_cluster_only_national(make_sales):
    rows = [("S", None, "C", "x", "M", 3), ("T", 0, "C", "y", "M", 2)]
    base = S.sales_base(make_sales(rows))
    assert {r.description for r in S.store_product_sales(base).collect()} == {"y"}
    assert {r.description for r in S.cluster_product_sales(base).collect()} == {"y"}
    assert {r.description for r in S.national_product_sales(base).collect()} == {"x", "y"}
    gs = S.sales_grouping_sets(make_sales(rows)).collect()
    assert {(r.level, r.description) for r in gs} == {
        ("store", "y"), ("cluster", "y"), ("national", "x"), ("national", "y")}


def test_no_sales_category(make_sales):
    rows = [("S", 0, "Soda", "a", "M", 3), ("S", 0, "Soda", "b", "M", 2),
            ("T", 0, "Soda", "a", "M", 5), ("T", 0, "Chips", "c", "M", 4)]
    base = S.sales_base(make_sales(rows))
    ns = R.no_sales_categories(base).collect()
    assert [(r.property_code, r.categories) for r in ns] == [("S", ["Chips"])]
    adds = R.stocking_suggestions(base, 5).where("property_code = 'S'").collect()
    assert all(r.category_name == "Soda" for r in adds)
    asked = base.sparkSession.createDataFrame(
        [("S", "Chips", "M"), ("S", "Chips", "M"), ("T", "Nothing", "M"), (None, "Chips", "M")],
        "property_code string, category_name string, transaction_month string")
    rep = R.recommendation_report(base, S.described_properties(make_sales(rows)), 5, requests=asked).orderBy("section", "seq").collect()
    assert {(r.property_code, r.category_name) for r in rep} == {("S", "Chips")}
    assert [r.text for r in rep][1:] == [
        "No products sold in Chips", "Cluster (0) top products:", "1. c: 100.0%",
        "National top products in Chips:", "1. c: 100.0%"]


def test_already_stocking(make_sales):
    rows = [("S", 0, "C", d, "M", u) for d, u in [("a", 5), ("b", 3)]]
    base = S.sales_base(make_sales(rows))
    assert R.stocking_suggestions(base, 5).count() == 0
    assert [r.property_code for r in R.already_stocking_top(base, 5).collect()] == ["S"]


def test_exact_90_is_not_in_tail(make_sales):
    rows = [("S", 0, "C", "a", "M", 9), ("S", 0, "C", "b", "M", 1), ("T", 0, "C", "z", "M", 100)]
    base = S.sales_base(make_sales(rows))
    rm = R.discontinue_suggestions(base, 1, 0.10).where("property_code = 'S'").collect()
    assert [r.description for r in rm] == ["b"]  # a: cum 0.9 (not > 0.9); b: 1.0


def test_cluster_zero_filter(make_sales):
    rows = [("S", 0, "C", "p", "M", 2, 4.0), ("T", 1, "C", "p", "M", 2, 6.0)]
    pts = P.price_points(make_sales(rows), description="p", cluster=0).collect()
    assert [r.unit_price for r in pts] == [2.0]


def _points(spark, prices, units=None):
    units = units or [1.0] * len(prices)
    rows = [("p", float(x), float(u), float(x) * float(u)) for x, u in zip(prices, units)]
    return spark.createDataFrame(rows, "description string, unit_price double, number_sold double, revenue double")


def test_one_price_gives_nulls(spark):
    o = P.price_optimum(_points(spark, [2.0])).collect()[0]
    assert o.best_price is None and o.best_revenue is None and o.best_sales is None


def test_gap_bins(spark):
    pts = _points(spark, [1.99, 2.49, 2.50, 3.10])
    bins = [r.bin for r in P.price_bins(pts).orderBy("unit_price").collect()]
    assert bins == [0, 2, 2, 5]
    o = P.price_optimum(pts).collect()[0]
    assert o.best_price == 2.5 and o.best_price_literal == 3.25


def test_low_edge(spark):
    pts = _points(spark, [0.9, 1.0, 1.01, 1.25, 1.26, 2.0])
    b = P.price_bins(pts).orderBy("unit_price").collect()
    assert b[0].price_low == 1.0
    assert [r.bin for r in b] == [0, 0, 1, 1, 2, 4]


def test_zero_units_dropped(make_sales):
    rows = [("S", 0, "C", "p", "M", 0, 5.0), ("S", 0, "C", "p", "M", 2, 4.0)]
    pts = P.price_points(make_sales(rows)).collect()
    assert [(r.unit_price, r.number_sold) for r in pts] == [(2.0, 2.0)]


def test_round_half_even(spark):
    df = spark.createDataFrame([(2.25,), (0.25,), (0.35,)], "x double")
    assert [r.y for r in df.select(half_even("x", 1).alias("y")).collect()] == [2.2, 0.2, 0.4]


def test_zip_zones(spark):
    df = spark.createDataFrame([("80202",), ("80202-1234",), ("K1A 0B1",), ("",), (None,)], "zip string")
    assert [r.z for r in df.select(zip_zone("zip").alias("z")).collect()] == [
        "8", "can", "can", "can", "can"]


def test_dummies_drop_first_and_null(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "property_id long, kind string")
    d = PR.property_dummies(df, columns=("kind",)).orderBy("property_id").collect()
    assert [(r.property_id, r.feature, r.value) for r in d] == [(1, "kind_b", 1), (4, "kind_c", 1)]


def test_null_management_company(spark):
    src = spark.createDataFrame([(1, 1, 1, "80202"), (2, 1, 2, "1"), (3, None, 1, "2")],
                                "property_id long, management_company_id long, currency_id int, zip string")
    a = PR.property_attributes(src, src).orderBy("property_id").collect()
    assert [(r.property_id, r.props_under_mgmt) for r in a] == [(1, 2), (2, 2)]
    assert [r.currency for r in a] == ["USD", "CAD"]


def test_pipe_text_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a|b", ""), (None, "x")], "s string, t string")
    path = str(tmp_path / "pipe")
    write_pipe_text(df, path)
    back = read_pipe_text(spark, path, df.schema).orderBy(F.col("t").asc_nulls_first()).collect()
    assert [(r.s, r.t) for r in back] == [("a|b", None), (None, "x")]


def test_write_table_overwrites(spark, tmp_path, make_sales):
    from shelfsense.sources import read_table, write_table
    path = str(tmp_path / "t")
    write_table(make_sales([("S", 0, "C", "a", "M", 1)]), path, partition_by=["transaction_month"])
    write_table(make_sales([("T", 0, "C", "b", "N", 2)]), path, partition_by=["transaction_month"])
    back = read_table(spark, path).collect()
    assert [(r.property_code, r.transaction_month) for r in back] == [("T", "N")]


def test_price_fit_density_matches_normal(spark):
    pts = _points(spark, [1.99, 2.49, 2.50, 3.10])
    f = P.price_fit(pts).collect()[0]
    assert f.mean_bin == 2.25 and math.isclose(f.std_bin, math.sqrt(((0 - 2.25) ** 2 + 2 * (2 - 2.25) ** 2 + (5 - 2.25) ** 2) / 4), abs_tol=1e-6)
    assert f.occupied_bins == "0,2,5" and f.n_edges == 9


def test_schema_of_sales_is_explicit():
    assert [f.name for f in SALES.fields][:5] == ["property_code", "cluster", "category_name",
                                                 "description", "transaction_month"]


def test_choice_lists_are_sorted_at_size(spark):
    n = 520_000
    sales = spark.range(n).selectExpr(
        "concat('S', lpad(pmod(id * 7919, 520000), 7, '0')) AS property_code", "cast(id % 30 AS string) AS transaction_month",
        "concat('c', id % 50) AS category_name", "if(id % 7 = 0, null, concat('f', id % 7)) AS flag_name",
        "concat('city', lpad(id % 400000, 6, '0')) AS city", "'st' AS state")
    lists = {}
    for r in L.dimension_values(sales).toLocalIterator():
        lists.setdefault(r.dimension, []).append((r.is_any, r.value))
    assert lists["property_code"] == [(False, f"S{i:07d}") for i in range(n)]
    assert lists["city"] == [(False, f"city{i:06d}") for i in range(400_000)]
    assert lists["transaction_month"] == [(False, str(i)) for i in sorted(map(str, range(30)), reverse=True)]
    assert lists["flag_name"] == [(True, None), *[(False, f"f{i}") for i in range(1, 7)], (False, None)]
    assert lists["state"] == [(True, None), (False, "st")]


def test_salted_join_splits_a_heavy_key(spark):
    from shelfsense.functions.salting import salted_join
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = spark.range(1000).selectExpr("id", "cast(null AS string) AS empty", "if(id % 10 = 0, 'b', 'a') AS k")
        small = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int")
        out = salted_join(large, small, ["k"], ["id"], "left")
        assert "_salt" in out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 1000 and all(r.v == (None if r.k == "b" else 1) for r in rows)


def test_fallback_median_of_the_best_bin(spark):
    # every ten-bin median is 0, so the median of the best quarter bin counts
    rows = [("p", 1.0 + i / 10, 0.0, 0.0) for i in range(10) for _ in range(2)] + [("p", 1.47, 4.0, 5.88)]
    rows = [(d, round(x + j / 100, 2), u, r) for j, (d, x, u, r) in enumerate(rows)]
    pts = spark.createDataFrame(rows, "description string, unit_price double, number_sold double, revenue double")
    got = P.price_optimum(pts).first()
    bins = P.price_bins(pts).where(F.col("bin") == got.best_bin).collect()
    import statistics
    assert got.best_sales == statistics.median(r.number_sold for r in bins)
    assert got.best_revenue == statistics.median(r.revenue for r in bins)


def test_period_range_rollover():
    from shelfsense.sources.synthetic import _period_range
    assert _period_range("month", "1998-12") == ("1998-12-01 00:00:00", "1999-01-01 00:00:00")
    assert _period_range("month", "1998-06") == ("1998-06-01 00:00:00", "1998-07-01 00:00:00")
    assert _period_range("year", "1998") == ("1998-01-01 00:00:00", "1999-01-01 00:00:00")
