"""The price optimum against a literal NumPy restatement of its algorithm on
random products (prices on a cent grid, no price exactly on a ten-bin edge
issue: ten-bin edges are checked in integer cents on both sides)."""

import math

import numpy as np
import pytest

from shelfsense.operators import pricing as P


def numpy_optimum(x, units):
    x = np.asarray(x, float)
    y0 = np.asarray(units, float)
    y1 = x * y0
    mn = float(np.round(x.min()))
    mx = float(np.ceil(x.max()))
    edges = np.linspace(mn, mx, int((mx - mn) * 4) + 1)
    bins = np.digitize(x, edges, right=True)
    mean, std = bins.mean(), bins.std()
    dens = np.exp(-((bins - mean) ** 2) / (2 * std ** 2)) if std > 0 else np.full(len(x), np.nan)
    best = bins[int(np.argmax(dens))]
    cents = np.round(x * 100).astype(int)
    lo, hi = cents.min(), cents.max()
    ten = np.minimum((cents - lo) * 10 // (hi - lo), 9)
    med1 = max(np.median(y1[ten == b]) for b in np.unique(ten))
    med0 = max(np.median(y0[ten == b]) for b in np.unique(ten))
    rev = med1 if med1 != 0 else np.median(y1[bins == best])
    sales = med0 if med0 != 0 else np.median(y0[bins == best])
    return bins, edges[best], rev, sales


@pytest.mark.parametrize("seed", range(8))
def test_optimum_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 40))
    cents = np.sort(rng.choice(np.arange(95, 1390), size=n, replace=False))
    x = cents / 100.0
    units = rng.integers(0, 30, size=n).astype(float)
    rows = [("p", float(a), float(u), float(a) * float(u)) for a, u in zip(x, units)]
    pts = spark.createDataFrame(rows, "description string, unit_price double, number_sold double, revenue double")
    bins, best_price, rev, sales = numpy_optimum(x, units)
    got_bins = [r.bin for r in P.price_bins(pts).orderBy("unit_price").collect()]
    assert got_bins == list(bins)
    o = P.price_optimum(pts).collect()[0]
    assert o.best_price == best_price
    assert math.isclose(o.best_revenue, rev, abs_tol=1e-6)
    assert math.isclose(o.best_sales, sales, abs_tol=1e-6)
