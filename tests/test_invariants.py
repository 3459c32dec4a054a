
import pytest
from pyspark.sql import functions as F

from shelfsense.operators import pricing as P
from shelfsense.operators import recommend as R
from shelfsense.operators import sales as S
from shelfsense.plans import catalog as K

D = "/root/testdata/sf0.001"
STORE = ["property_code", "category_name", "transaction_month"]


@pytest.fixture(scope="module")
def base(spark):
    return S.sales_base(K.sales_of(spark, D)).cache()


def test_shares_sum_to_one_and_cum_monotone(base):
    r = S.store_ranking(base)
    agg = r.groupBy(*STORE).agg(F.sum("pct_of_sold").alias("s"), F.max("cum_pct").alias("m"))
    assert agg.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    assert agg.where(F.col("m") != 1.0).count() == 0
    from pyspark.sql import Window
    w = Window.partitionBy(*STORE).orderBy("rank")
    bad = r.withColumn("prev", F.lag("cum_pct").over(w)).where(F.col("cum_pct") < F.col("prev"))
    assert bad.count() == 0


def test_suggestion_sets(base):
    add = R.stocking_suggestions(base, 5)
    sold = S.store_product_sales(base).select(*STORE, "description")
    assert add.join(sold, STORE + ["description"]).count() == 0           # R4 ∩ store = ∅
    ct = S.cluster_top(base, 5).select("cluster", "category_name", "transaction_month", "description")
    assert add.join(ct, ["cluster", "category_name", "transaction_month", "description"],
                    "left_anti").count() == 0                               # R4 ⊆ cluster top
    rm = R.discontinue_suggestions(base, 5)
    assert rm.join(ct, ["cluster", "category_name", "transaction_month", "description"]).count() == 0
    stores = sold.select(*STORE).distinct()
    a_keys = add.select(*STORE).distinct()
    already = R.already_stocking_top(base, 5).select(*STORE)
    # exactly one of "already" or suggestions per store-category-period
    assert a_keys.join(already, STORE).count() == 0
    assert a_keys.count() + already.count() == stores.count()


def test_best_price_within_range(spark):
    pts = K.points_of(spark, D)
    o = P.price_optimum(pts).join(P.price_fit(pts), "description")
    bad = o.where(F.col("best_price").isNotNull() & (
        (F.col("best_price") < F.col("price_low")) | (F.col("best_price") > F.col("price_high"))))
    assert bad.count() == 0


def test_single_key_equals_batch(spark):
    sales = K.sales_of(spark, D)
    base = S.sales_base(sales)
    key = S.store_product_sales(base).select(*STORE).orderBy(*STORE).first()
    one = R.recommendation_report_for(sales, S.described_properties(sales), key.property_code, key.category_name,
                                      key.transaction_month).collect()
    batch = (R.recommendation_report(base, S.described_properties(sales)).where(
        (F.col("property_code") == key.property_code) & (F.col("category_name") == key.category_name)
        & (F.col("transaction_month") == key.transaction_month)).orderBy("section", "seq").collect())
    assert [r.text for r in one] == [r.text for r in batch]


def test_report_leaves_store_products_where_they_are(make_sales):
    rows = [(f"S{s}", s % 2, c, d, "M", 1 + (7 * s + len(c) + 3 * ord(d)) % 11)
            for s in range(6) for c in ("Soda", "Chips") for d in "abcdefgh" if (s + ord(d)) % 5]
    rows += [("S0", None, "Soda", "z", "M", 4), ("S7", 1, "Soda", "a", "M", 0), ("S8", 1, "Soda", "a", "M", None)]
    sales = make_sales(rows)
    asked = sales.sparkSession.createDataFrame([("S0", "Soda", "M"), ("S7", "Chips", "M"), ("S1", "Tea", "M"), ("S9", "Soda", "M")],
                                               "property_code string, category_name string, transaction_month string")
    descriptions = S.described_properties(sales)
    spread = R.by_store_period(S.sales_base(sales))
    for requests in (None, asked):
        of = lambda base: R.recommendation_report(base, descriptions, 3, 0.2, requests)
        assert sorted(of(spread).collect()) == sorted(of(S.sales_base(sales)).collect())
    # the lists come to the store products
    report = R.recommendation_report(spread, descriptions, 3, 0.2).where("section = 5")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_salt" in line]
