"""The worked example of the reference's README, rebuilt as data (GOLDEN_SODA)."""

from pyspark.sql import functions as F

from shelfsense.operators import recommend as R
from shelfsense.operators import sales as S

# The worked example's products, unit counts and expected output.
CAT = "Beverage: Soda"
MONTH = "2019-09"
DIET = "Coca-Cola, Diet Soda, 20 Oz, Bottle"
CLASSIC = "Coca-Cola, Classic Soda, 20 Oz, Bottle"
ZERO = "Coca-Cola, Zero, 20 Oz, Bottle"
CHERRY = "Coca-Cola, Cherry Coca-Cola, 20 Oz, Bottle"
SPRITE = "Sprite, Lemon Lime, 20 Oz, Bottle"
PEPPER = "Dr. Pepper, 20 Oz, Bottle"
GINGER = "Diet Coke, Ginger Lime, 12 Oz, Can"
MANGO = "Diet Coke, Twisted Mango, 12 Oz, Can"
F_ORANGE = "Fanta, Orange, 20 Oz, Bottle"
F_PINE = "Fanta, Pineapple, 20 Oz, Bottle"
ZESTY = "Diet Coke, Zesty Blood Orange, 12 Oz, Can"
STORE_UNITS = {DIET: 277, CLASSIC: 165, ZERO: 150, CHERRY: 65, SPRITE: 58,
               "Filler A": 45, "Filler B": 45, "Filler C": 44, "Filler D": 43,
               GINGER: 31, MANGO: 27, F_ORANGE: 23, F_PINE: 15, ZESTY: 12}
CLUSTER_TOTALS = {CLASSIC: 44_500, DIET: 23_500, SPRITE: 14_400, ZERO: 9_500, PEPPER: 8_100}
NATIONAL_TOTALS = {CLASSIC: 3_976_000, DIET: 2_918_000, SPRITE: 1_518_000, ZERO: 827_000,
                   PEPPER: 761_000}
EXPECT_STORE = [27.7, 16.5, 15.0, 6.5, 5.8]
EXPECT_CLUSTER = [(CLASSIC, 44.5), (DIET, 23.5), (SPRITE, 14.4), (ZERO, 9.5), (PEPPER, 8.1)]
EXPECT_NATIONAL = [39.8, 29.2, 15.2, 8.3, 7.6]
EXPECT_DROP = [(GINGER, 3.1), (MANGO, 2.7), (F_ORANGE, 2.3), (F_PINE, 1.5), (ZESTY, 1.2)]


def golden_rows():
    rows = [("S", 0, CAT, d, MONTH, u) for d, u in STORE_UNITS.items()]
    for d, tot in CLUSTER_TOTALS.items():
        rows.append(("C", 0, CAT, d, MONTH, tot - STORE_UNITS.get(d, 0)))
    for d, tot in NATIONAL_TOTALS.items():
        rows.append(("N", 1, CAT, d, MONTH, tot - CLUSTER_TOTALS[d]))
    return rows


def test_golden_store_cluster_national(make_sales):
    base = S.sales_base(make_sales(golden_rows()))
    st = S.store_top(base, 5).where("property_code = 'S'").orderBy("rank").collect()
    assert [r.pct for r in st] == EXPECT_STORE
    ct = S.cluster_top(base, 5).where("cluster = 0").orderBy("rank").collect()
    assert [(r.description, r.pct) for r in ct] == EXPECT_CLUSTER
    nt = S.national_top(base, 5).orderBy("rank").collect()
    assert [r.pct for r in nt] == EXPECT_NATIONAL


def test_golden_suggestions(make_sales):
    base = S.sales_base(make_sales(golden_rows()))
    add = R.stocking_suggestions(base, 5).where("property_code = 'S'").collect()
    assert [r.description for r in add] == [PEPPER]
    rm = (R.discontinue_suggestions(base, 5, 0.10).where("property_code = 'S'")
          .orderBy("rank").collect())
    assert [(r.description, r.pct) for r in rm] == EXPECT_DROP
    # Ginger Lime crosses the line: cumulative 0.892 -> 0.923
    g = (S.store_ranking(base).where(F.col("description") == GINGER).collect()[0])
    assert abs(g.cum_pct - 0.923) < 1e-12


def test_golden_report_lines(make_sales):
    sales = make_sales(golden_rows())
    rep = (R.recommendation_report(S.sales_base(sales), S.described_properties(sales), 5, 0.10).where("property_code = 'S'")
           .orderBy("section", "seq").collect())
    text = [r.text for r in rep]
    assert text[0] == f"For store #S, F-S, City-S, ST-S, for {MONTH}, part of Cluster (0)"
    assert text[1] == f"Your top products in {CAT}:"
    assert text[2] == f"1. {DIET}: 277 units, 27.7%"
    assert f"Cluster (0) top products:" in text
    assert f"5. {PEPPER}: 8.1%" in text
    assert "National top product:" in text
    assert f"1. {CLASSIC}: 39.8%" in text
    assert "Stocking suggestions:" in text and f"1. {PEPPER}" in text
    i = text.index("Consider discontinue stocking:")
    assert text[i + 1:] == [f"{k + 1}. {d}: {STORE_UNITS[d]} units, {p}%"
                            for k, (d, p) in enumerate(EXPECT_DROP)]
    headers = [r.text for r in rep if r.is_header == 1]
    assert len(headers) == 6
