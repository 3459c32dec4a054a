"""An independent pandas restatement of R1-R5 on small random frames."""

import numpy as np
import pandas as pd
import pytest

from shelfsense.operators import recommend as R
from shelfsense.operators import sales as S


def pandas_rankings(df, n, tail):
    pos = df[df.number_sold > 0].dropna(subset=["cluster"])
    store = (pos.groupby(["cluster", "property_code", "category_name", "description", "transaction_month"],
                         as_index=False)["number_sold"].sum())
    out = {}
    for (p, c, m), g in store.groupby(["property_code", "category_name", "transaction_month"]):
        g = g.sort_values(["number_sold", "cluster", "description"], ascending=[False, True, True])
        tot = g.number_sold.sum()
        g = g.assign(cum=g.number_sold.cumsum() / tot)
        out[(p, c, m)] = g
    clus = (pos.groupby(["cluster", "category_name", "description", "transaction_month"], as_index=False)
            ["number_sold"].sum())
    ctop = {}
    for (cl, c, m), g in clus.groupby(["cluster", "category_name", "transaction_month"]):
        g = g.sort_values(["number_sold", "description"], ascending=[False, True]).head(n)
        ctop[(cl, c, m)] = list(g.description)
    pcl = df.groupby(["property_code", "transaction_month"]).cluster.max()
    adds, drops = set(), set()
    for (p, c, m), g in out.items():
        cl = pcl[(p, m)]
        top = ctop.get((cl, c, m), [])
        for d in top:
            if d not in set(g.description):
                adds.add((p, c, m, d))
        for d, cum in zip(g.description, g.cum):
            if d not in top and cum > 1 - tail:
                drops.add((p, c, m, d))
    return adds, drops


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_frames_match_pandas(make_sales, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(300):
        p = f"P{rng.integers(0, 8)}"
        cl = int(rng.integers(0, 3)) if p != "P7" else None
        rows.append((p, cl, f"C{rng.integers(0, 2)}", f"d{rng.integers(0, 9)}",
                     f"M{rng.integers(0, 2)}", int(rng.integers(-2, 12))))
    # property cluster must not depend on the row: fix it per property
    fixed = {}
    rows = [(p, fixed.setdefault(p, cl), c, d, m, u) for p, cl, c, d, m, u in rows]
    sales = make_sales(rows)
    base = S.sales_base(sales)
    pdf = pd.DataFrame(rows, columns=["property_code", "cluster", "category_name", "description",
                                      "transaction_month", "number_sold"])
    adds, drops = pandas_rankings(pdf, 3, 0.2)
    got_adds = {tuple(r) for r in R.stocking_suggestions(base, 3).select(
        "property_code", "category_name", "transaction_month", "description").collect()}
    got_drops = {tuple(r) for r in R.discontinue_suggestions(base, 3, 0.2).select(
        "property_code", "category_name", "transaction_month", "description").collect()}
    assert got_adds == adds
    assert got_drops == drops
