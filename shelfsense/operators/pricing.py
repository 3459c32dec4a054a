"""Price analytics.

``price_points`` is the one aggregate over raw sales rows: mean units per
(product, unit price), with partial aggregation before the shuffle so a hot
product costs one row per price and map task.  After it the data is one row
per product and distinct price, so every later step partitions by the
product key only (``keys``, default ``description``): windows and grouped
aggregates on the same key reuse one exchange.

``keys`` generalises the reference's optional cluster and month arguments:
``keys=('description', 'cluster')`` answers every product in every cluster in
one job; ``cluster=`` / ``month=`` filter to one value as the reference does
(cluster 0 is a real filter here).

Bins use integer cents, so a price that sits exactly on an edge falls on the
side the arithmetic says, independent of float noise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions.spline import smoothing_spline
from shelfsense.functions import (cents, equal_width_bin, fixed_decimals, half_even, norm_pdf,
                                  quarter_bin, unit_price)

PRODUCT = ("description",)
MEASURES = ("unit_price", "number_sold", "revenue")
TEN_BINS = 10
HIST_BINS = 15
KDE_GRID = 100
KDE_CUT = 3.0
SMOOTHING = 1_000_000.0


def _keys(keys: Sequence[str]) -> list[str]:
    return list(keys)


def price_points(sales: DataFrame, description: str | None = None, cluster: int | None = None,
                 month: str | None = None, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """G1: mean units per distinct unit price, and revenue = price x mean units.

    Unit price is ``round(dollars / units, 2)`` half-even; a row with zero
    units has no price and is dropped.  Unlike the store rankings, units are
    not filtered to positive values here.
    """
    k = _keys(keys)
    s = sales
    if description is not None:
        s = s.where(F.col("description") == F.lit(description))
    if cluster is not None:
        s = s.where(F.col("cluster") == F.lit(cluster))
    if month is not None:
        s = s.where(F.col("transaction_month") == F.lit(month))
    s = s.select(*k, unit_price("dollars_sold", "number_sold").alias("unit_price"), "number_sold")
    cond = F.col("unit_price").isNotNull()
    for c in k:
        cond = cond & F.col(c).isNotNull()
    return (s.where(cond).groupBy(*k, "unit_price")
            .agg(F.avg("number_sold").alias("number_sold"))
            .withColumn("revenue", F.col("unit_price") * F.col("number_sold")))


def price_bins(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """G2 (A13, F-e, F-h, F-i): quarter-dollar bins per product.

    ``price_low = round(min price)`` (half-even), ``price_high = ceil(max)``,
    edges ``price_low + 0.25*i``; ``bin`` is the index of the first edge at or
    above the price, 0 at or below the first edge; ``bin_edge`` is that edge.
    """
    k = _keys(keys)
    w = Window.partitionBy(*k)
    b = (points.withColumn("price_low", F.rint(F.min("unit_price").over(w)))
         .withColumn("price_high", F.ceil(F.max("unit_price").over(w)).cast("double"))
         .withColumn("price_cents", cents("unit_price")))
    b = b.withColumn("bin", quarter_bin("price_cents", "price_low"))
    return b.withColumn("bin_edge", F.col("price_low") + F.lit(0.25) * F.col("bin"))


def price_fit(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Per product the bin grid and the normal fit over the bins
    of its distinct prices (mean and population std, unweighted)."""
    k = _keys(keys)
    b = price_bins(points, k)
    a = b.groupBy(*k).agg(
        F.count("*").alias("n_prices"),
        F.min("unit_price").alias("min_price"),
        F.max("unit_price").alias("max_price"),
        F.min("price_low").alias("price_low"),
        F.max("price_high").alias("price_high"),
        F.avg("bin").alias("mean_bin"),
        F.stddev_pop("bin").alias("std_bin"),
        F.count_distinct("bin").alias("n_occupied_bins"),
        F.concat_ws(",", F.array_sort(F.collect_set("bin")).cast("array<string>")).alias("occupied_bins"),
    )
    return a.select(*k, "n_prices", "min_price", "max_price", "price_low", "price_high",
                    ((F.col("price_high") - F.col("price_low")) * 4 + 1).cast("int").alias("n_edges"),
                    "mean_bin", half_even("std_bin", 6).alias("std_bin"),
                    F.col("n_occupied_bins").cast("int").alias("n_occupied_bins"), "occupied_bins")


def _optimum_rows(points: DataFrame, k: list[str]) -> DataFrame:
    """Price bins plus, per product, the best bin (W7) and the ten-bin index."""
    b = price_bins(points, k)
    w = Window.partitionBy(*k)
    b = (b.withColumn("n_prices", F.count("*").over(w))
          .withColumn("sum_bin", F.sum("bin").over(w))
          .withColumn("min_cents", F.min("price_cents").over(w))
          .withColumn("max_cents", F.max("price_cents").over(w)))
    # Density of a normal is highest at the bin nearest the mean bin; with
    # integers, |k*bin - sum(bin)| is exact.  Ties go to the lowest price.
    nearest = F.struct(F.abs(F.col("n_prices") * F.col("bin") - F.col("sum_bin")).alias("off"), "unit_price", "bin")
    b = b.withColumn("best_bin", F.min(nearest).over(w)["bin"])
    ten = F.when(F.col("max_cents") > F.col("min_cents"),
                 equal_width_bin("price_cents", "min_cents", "max_cents", TEN_BINS))
    return b.withColumn("ten_bin", ten)


def price_optimum(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Best price, revenue and sales per product; nulls below two prices.

    * ``best_price`` = upper edge of the bin nearest the fitted mean bin.
    * ``best_price_literal`` indexes the sorted *occupied* edges with that bin
      number, as the reference's expression does (null where it would fail).
    * ``best_revenue`` / ``best_sales`` = largest median over the occupied
      ones of ten equal-width price bins; if that is 0, the median inside the
      best quarter bin.  ``n_median_bins`` < 10 marks where the reference's
      max over all ten bins would have been NaN.
    """
    k = _keys(keys)
    b = _optimum_rows(points, k)
    # On the windows' partitioning, so without a further exchange: medians per
    # ten-bin, then the product.  Medians of the best quarter bin (of at most 25
    # prices) come with the rows.
    w = Window.partitionBy(*k)
    at_best = F.col("bin") == F.col("best_bin")
    b = (b.withColumn("edge_no", F.dense_rank().over(w.orderBy("bin")))
          .withColumn("fb_rev", F.median(F.when(at_best, F.col("revenue"))).over(w))
          .withColumn("fb_sales", F.median(F.when(at_best, F.col("number_sold"))).over(w)))
    per = b.groupBy(*k, "ten_bin").agg(
        F.count("*").alias("n"), F.max("best_bin").alias("best_bin"), F.min("price_low").alias("price_low"),
        F.max(F.when(F.col("edge_no") == F.col("best_bin") + 1, F.col("bin_edge"))).alias("literal"),
        F.max("fb_rev").alias("fb_rev"), F.max("fb_sales").alias("fb_sales"),
        F.median("revenue").alias("rev"), F.median("number_sold").alias("sales"))
    ten = F.col("ten_bin").isNotNull()
    a = per.groupBy(*k).agg(
        F.sum("n").alias("n_prices"),
        F.max("best_bin").alias("best_bin"),
        F.min("price_low").alias("price_low"),
        F.max("literal").alias("literal"),
        F.count(F.when(ten, 1)).alias("n_median_bins"),
        F.max(F.when(ten, F.col("rev"))).alias("max_rev"),
        F.max(F.when(ten, F.col("sales"))).alias("max_sales"),
        F.max("fb_rev").alias("fb_rev"),
        F.max("fb_sales").alias("fb_sales"),
    )
    ok = F.col("n_prices") >= 2

    def pick(mx, fb):
        return F.when(ok, half_even(F.when(F.col(mx) != 0, F.col(mx)).otherwise(F.col(fb)), 6))

    return a.select(
        *k, F.col("n_prices").cast("bigint").alias("n_prices"),
        F.when(ok, F.col("best_bin")).alias("best_bin"),
        F.when(ok, F.col("price_low") + F.lit(0.25) * F.col("best_bin")).alias("best_price"),
        F.when(ok, F.col("literal")).alias("best_price_literal"),
        pick("max_rev", "fb_rev").alias("best_revenue"),
        pick("max_sales", "fb_sales").alias("best_sales"),
        F.when(ok, F.col("n_median_bins")).cast("int").alias("n_median_bins"),
    )


def price_binned_median(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Median units and revenue in each occupied one of ten equal-width
    price bins (products with at least two prices)."""
    k = _keys(keys)
    b = _optimum_rows(points, k).where(F.col("ten_bin").isNotNull())
    a = b.groupBy(*k, "ten_bin").agg(
        F.count("*").alias("n"),
        F.min("min_cents").alias("min_cents"), F.max("max_cents").alias("max_cents"),
        F.median("number_sold").alias("median_units"),
        F.median("revenue").alias("median_revenue"),
    )
    width = (F.col("max_cents") - F.col("min_cents")) / F.lit(TEN_BINS)
    return a.select(
        *k, "ten_bin", F.col("n").cast("bigint").alias("n"),
        half_even((F.col("min_cents") + width * F.col("ten_bin")) / 100, 6).alias("bin_low"),
        half_even((F.col("min_cents") + width * (F.col("ten_bin") + 1)) / 100, 6).alias("bin_high"),
        half_even("median_units", 6).alias("median_units"),
        half_even("median_revenue", 6).alias("median_revenue"),
    )


def price_box_stats(points: DataFrame, measure: str = "number_sold",
                    keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Box statistics of ``measure`` per product and quarter-dollar bin:
    count, linear quartiles, 1.5 IQR whiskers (clamped to the box) and the
    number of points outside them."""
    k = _keys(keys)
    b = price_bins(points, k).select(*k, "bin", "bin_edge", F.col(measure).alias("y"))
    w = Window.partitionBy(*k, "bin")
    q = F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    b = b.withColumn("_q", q.over(w))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    lo_f = q1 - F.lit(1.5) * (q3 - q1)
    hi_f = q3 + F.lit(1.5) * (q3 - q1)
    a = b.groupBy(*k, "bin").agg(
        F.min("bin_edge").alias("bin_edge"),
        F.count("*").alias("n"),
        F.first("_q").alias("_q"),
        F.min(F.when(F.col("y") >= lo_f, F.col("y"))).alias("_wlo"),
        F.max(F.when(F.col("y") <= hi_f, F.col("y"))).alias("_whi"),
        F.count(F.when((F.col("y") < lo_f) | (F.col("y") > hi_f), 1)).alias("n_outliers"),
    )
    q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    wlo = F.when(F.col("_wlo").isNull() | (F.col("_wlo") > q1), q1).otherwise(F.col("_wlo"))
    whi = F.when(F.col("_whi").isNull() | (F.col("_whi") < q3), q3).otherwise(F.col("_whi"))
    return a.select(
        *k, F.lit(measure).alias("measure"), "bin", "bin_edge", F.col("n").cast("bigint").alias("n"),
        half_even(q1, 6).alias("q1"), half_even(med, 6).alias("median"), half_even(q3, 6).alias("q3"),
        half_even(wlo, 6).alias("whisker_low"), half_even(whi, 6).alias("whisker_high"),
        F.col("n_outliers").cast("bigint").alias("n_outliers"),
    )


def price_strip_points(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Every price point with its bin and whether it lies outside the box
    whiskers of its bin, for units and for revenue."""
    k = _keys(keys)
    b = price_bins(points, k)
    w = Window.partitionBy(*k, "bin")
    out = b
    for m, tag in (("number_sold", "units"), ("revenue", "revenue")):
        q = F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).over(w)
        out = out.withColumn(f"_q_{tag}", q)
        q1, q3 = F.col(f"_q_{tag}")[0], F.col(f"_q_{tag}")[1]
        out = out.withColumn(f"outlier_{tag}",
                             (F.col(m) < q1 - 1.5 * (q3 - q1)) | (F.col(m) > q3 + 1.5 * (q3 - q1)))
    return out.select(*k, "unit_price", "number_sold", "revenue", "bin", "bin_edge",
                      "outlier_units", "outlier_revenue")


def price_fit_curve(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Normal density of each point's bin (G3) and the curve scaled to the
    best sales and best revenue: ``density / max(density) * best``."""
    k = _keys(keys)
    b = price_bins(points, k)
    w = Window.partitionBy(*k)
    b = (b.withColumn("mean_bin", F.avg("bin").over(w))
          .withColumn("std_bin", F.stddev_pop("bin").over(w)))
    b = b.withColumn("density", norm_pdf("bin", "mean_bin", "std_bin"))
    b = b.withColumn("max_density", F.max("density").over(w))
    best = price_optimum(points, k).select(*k, "best_sales", "best_revenue")
    b = b.join(best, k, "left")
    scale = F.col("density") / F.col("max_density")
    return b.select(*k, "unit_price", "bin",
                    half_even("density", 6).alias("density"),
                    half_even(scale * F.col("best_sales"), 6).alias("fit_units"),
                    half_even(scale * F.col("best_revenue"), 6).alias("fit_revenue"))


def _long(points: DataFrame, k: list[str], columns: Sequence[str]) -> DataFrame:
    """Unpivot the chosen measure columns to (keys, variable, value)."""
    unknown = set(columns) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown price columns: {sorted(unknown)}")
    return points.unpivot(k, list(columns), "variable", "value")


def price_histogram(points: DataFrame, columns: Sequence[str] = ("unit_price",),
                    keys: Sequence[str] = PRODUCT, bins: int = HIST_BINS) -> DataFrame:
    """Density histogram, ``bins`` equal-width bins over [min, max] (last
    bin closed; a constant column uses [v-0.5, v+0.5]), empty bins included,
    for products with at least two price points.  Prices are binned in cents."""
    k = _keys(keys)
    g = k + ["variable"]
    long = _long(points, k, columns)
    w = Window.partitionBy(*g)
    is_price = F.col("variable") == "unit_price"
    v = F.when(is_price, cents("value").cast("double")).otherwise(F.col("value"))
    long = (long.withColumn("v", v)
                .withColumn("n", F.count("*").over(w))
                .withColumn("vmin", F.min("v").over(w))
                .withColumn("vmax", F.max("v").over(w))
                .where(F.col("n") >= 2))
    lo = F.when(F.col("vmax") > F.col("vmin"), F.col("vmin")).otherwise(F.col("vmin") - 0.5)
    hi = F.when(F.col("vmax") > F.col("vmin"), F.col("vmax")).otherwise(F.col("vmax") + 0.5)
    long = long.withColumn("lo", lo).withColumn("hi", hi)
    # price: exact integer-cents bin; others: floor((x - lo) * (bins / (hi - lo)))
    pbin = F.floor((F.col("v") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo")))
    obin = F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo"))))
    long = long.withColumn("bin", F.least(F.when(is_price, pbin).otherwise(obin), F.lit(bins - 1))
                           .cast("int"))
    # One aggregate on the window's partitioning (no new exchange): all bin
    # counts of a group at once, empty bins included, then one row per bin.
    counts = [F.count(F.when(F.col("bin") == i, 1)) for i in range(bins)]
    agg = long.groupBy(*g).agg(F.first("n").alias("n"), F.first("lo").alias("lo"),
                               F.first("hi").alias("hi"), F.array(*counts).alias("cnts"))
    out = agg.select(*g, "n", "lo", "hi", F.posexplode("cnts").alias("bin", "cnt"))
    scale = F.when(F.col("variable") == "unit_price", F.lit(0.01)).otherwise(F.lit(1.0))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return out.select(
        *g, F.col("bin").cast("int").alias("bin"),
        half_even((F.col("lo") + width * F.col("bin")) * scale, 6).alias("bin_low"),
        half_even((F.col("lo") + width * (F.col("bin") + 1)) * scale, 6).alias("bin_high"),
        F.col("cnt").cast("bigint").alias("count"),
        half_even(F.col("cnt") / (F.col("n") * width * scale), 6).alias("density"),
    )


def price_kde(points: DataFrame, columns: Sequence[str] = ("unit_price",),
              keys: Sequence[str] = PRODUCT, method: str = "exact") -> DataFrame:
    """Kernel density curve of the chosen columns, 100 grid points per
    product (products with two or more points and a non-zero spread).

    Gaussian kernel with sd n^(-1/5) * sample sd (Scott's rule); the grid spans
    [min - 3 bw, max + 3 bw] with bw = n^(-1/5) * population sd.

    ``method``: ``exact`` sums every price point's kernel at every grid point,
    map-side by (product, grid point), so no product has to fit in one task.
    ``binned`` first shares every point between the two nearest of 397 finer grid
    points (four to a step) and then adds up the kernels of those, which costs
    one pass over the points and a fixed sum per product.  A share's error is at
    most the kernel's curvature times an eighth of the squared fine step: with a
    bandwidth of five steps or more, which a product of up to about 1,000 evenly
    spread prices has, under 4e-4 of the kernel's peak (1e-3 is tested).
    """
    if method not in ("exact", "binned"):
        raise ValueError(f"unknown method: {method}")
    k = [*_keys(keys), "variable"]
    long = _long(points, _keys(keys), columns)
    stats = long.groupBy(*k).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.stddev_pop("value").alias("sp"), F.stddev_samp("value").alias("ss")).where("n >= 2 and ss > 0")
    factor = F.pow("n", F.lit(-0.2))
    stats = stats.select(*k, "n", (F.col("lo") - KDE_CUT * factor * F.col("sp")).alias("lo"),
                         (F.col("hi") + KDE_CUT * factor * F.col("sp")).alias("hi"), (factor * F.col("ss")).alias("h"))
    place = lambda i: F.when(i == KDE_GRID - 1, F.col("hi")).otherwise(
        i * ((F.col("hi") - F.col("lo")) / (KDE_GRID - 1)) + F.col("lo"))
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    if method == "exact":
        grid = stats.select(*k, "n", "h", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(KDE_GRID - 1))).alias("i"))
        grid = grid.select(*k, "n", "h", "i", place(F.col("i")).alias("x"))
        z = (F.col("x") - F.col("value")) / F.col("h")
        out = long.join(grid, k).groupBy(*k, "i", "x", "n", "h").agg(F.sum(F.exp(-0.5 * z * z)).alias("s"))
    else:
        out = _binned_kernels(long, stats, k).select(*k, "n", "h", "i", place(F.col("i")).alias("x"), "s")
    return out.select(*k, F.col("i").cast("int").alias("i"), half_even("x", 6).alias("x"),
                      half_even(F.col("s") / norm, 6).alias("density"))


#: Finer grid points to a step of the grid, for the binned kernel sums.
KDE_FINE = 4


def _binned_kernels(long: DataFrame, stats: DataFrame, k: list[str]) -> DataFrame:
    """Sums of kernels at the grid points from shares at the finer grid's."""
    cells = KDE_FINE * (KDE_GRID - 1)
    step = (F.col("hi") - F.col("lo")) / cells
    at = F.least(F.greatest((F.col("value") - F.col("lo")) / step, F.lit(0.0)), F.lit(float(cells)))
    near = long.join(stats, k).withColumn("at", at).withColumn("j", F.least(F.floor("at"), F.lit(cells - 1)))
    share = F.col("at") - F.col("j")
    shares = near.select(*k, F.inline(F.array(F.struct(F.col("j"), (1 - share).alias("w")), F.struct((F.col("j") + 1).alias("j"), share.alias("w")))))
    counts = shares.groupBy(*k, "j").agg(F.sum("w").alias("w"))
    # at most one entry per fine grid point
    own = counts.groupBy(*k).agg(F.collect_list(F.struct("j", "w")).alias("c")).join(stats, k)
    kernel = F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda d: F.exp(-0.5 * F.pow(d * step / F.col("h"), F.lit(2.0))))
    own = own.withColumn("kernel", kernel).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(KDE_GRID - 1))))
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x["w"] * F.col("kernel")[F.abs(x["j"] - F.col("i") * KDE_FINE).cast("int")])
    return own.withColumn("s", total)


def price_curve(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Smoothing curve of units and revenue against price per product
    with four or more distinct prices: the least-squares cubic, which a cubic
    smoothing spline with this smoothing factor equals while the cubic's
    residual sum of squares (``ssr_*``) is within it; beyond it, and with fewer
    prices, the fit is null.

    The cubic is the sum of the first four polynomials orthogonal over the
    product's prices, built by their three-term recurrence from centred and
    scaled prices; all sums are windows on one partitioning.
    """
    k = _keys(keys)
    b = _cubic(points, k)
    keep = lambda fit, ssr: half_even(F.when(F.col(ssr) <= SMOOTHING, F.col(fit)), 6) + 0.0  # noqa: E731  no -0.0
    return b.select(*k, "unit_price", "number_sold", "revenue",
                    keep("fu", "su").alias("fit_units"), half_even("su", 4).alias("ssr_units"),
                    keep("fr", "sr").alias("fit_revenue"), half_even("sr", 4).alias("ssr_revenue"))


def _cubic(points: DataFrame, k: list[str]) -> DataFrame:
    """Points with the least-squares cubic of units and revenue (``fu``, ``fr``),
    its residual sums of squares (``su``, ``sr``) and the number of prices."""
    w = Window.partitionBy(*k)
    total = lambda c: F.sum(c).over(w)
    b = points.select(*k, "unit_price", "number_sold", "revenue").withColumn("n", F.count("*").over(w))
    b = b.withColumn("c", F.col("unit_price") - F.avg("unit_price").over(w))
    b = b.withColumn("z", F.col("c") / F.max(F.abs("c")).over(w)).withColumn("p0", F.lit(1.0)).where("n >= 1")
    for i in range(4):
        p = F.col(f"p{i}")
        b = b.withColumn(f"s{i}", total(p * p))
        b = b.withColumns({f"cu{i}": total(F.col("number_sold") * p), f"cr{i}": total(F.col("revenue") * p),
                           f"a{i}": total(F.col("z") * p * p)})
        if i < 3:
            step = (F.col("z") - F.try_divide(f"a{i}", f"s{i}")) * p
            if i:
                step = step - F.try_divide(f"s{i}", f"s{i - 1}") * F.col(f"p{i - 1}")
            b = b.withColumn(f"p{i + 1}", step)
    enough = F.col("n") >= 4

    def fitted(tag):
        parts = [F.try_divide(f"c{tag}{i}", f"s{i}") * F.col(f"p{i}") for i in range(4)]
        return F.when(enough, parts[0] + parts[1] + parts[2] + parts[3])

    b = b.withColumns({"fu": fitted("u"), "fr": fitted("r")})
    b = b.withColumns({"su": total(F.pow(F.col("number_sold") - F.col("fu"), F.lit(2.0))),
                       "sr": total(F.pow(F.col("revenue") - F.col("fr"), F.lit(2.0)))})
    return b


def price_smooth_curve(points: DataFrame, keys: Sequence[str] = PRODUCT, smoothing: float = SMOOTHING) -> DataFrame:
    """G11 without gaps: the cubic of ``price_curve`` where its residual sum of
    squares is within ``smoothing``; beyond it, for products with four or more
    prices, the natural cubic smoothing spline whose residual is exactly
    ``smoothing``.  The reference adds knots until the residual is within it; this
    is the smoothest curve that reaches it, so values between can differ.
    ``*_by`` tells which it is.

    A product's points (one per distinct price) are one array, folded in the JVM.
    """
    k = _keys(keys)
    c = _cubic(points, k)
    c = c.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("unit_price", "number_sold", "revenue", "n", "fu", "fr", "su", "sr"))).alias("pts"))
    names = (("units", "number_sold", "fu", "su"), ("revenue", "revenue", "fr", "sr"))
    for tag, y, fit, ssr in names:
        beyond = F.col("pts")[0][ssr] > smoothing
        curve = smoothing_spline(F.transform("pts", lambda p: F.struct(p["unit_price"].alias("x"), p[y].alias("y"))), smoothing)  # noqa: B023
        c = c.withColumn(f"fit_{tag}", F.when(beyond, curve).otherwise(F.transform("pts", lambda p: p[fit])))  # noqa: B023
        c = c.withColumn(f"{tag}_by", F.when(beyond, "spline").when(F.col("pts")[0]["n"] >= 4, "cubic"))
    out = c.select(*k, "units_by", "revenue_by", F.inline(F.arrays_zip("pts", "fit_units", "fit_revenue")))
    return out.select(*k, "pts.unit_price", "pts.number_sold", "pts.revenue",
                      (half_even("fit_units", 6) + 0.0).alias("fit_units"), "units_by",
                      (half_even("fit_revenue", 6) + 0.0).alias("fit_revenue"), "revenue_by")


def price_summary(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """The optimum as display text: price with 2 decimals, sales and
    revenue with none (half-even, as Python formats)."""
    k = _keys(keys)
    o = price_optimum(points, k)
    return o.select(*k, fixed_decimals("best_price", 2).alias("best_price"),
                    fixed_decimals("best_sales", 0).alias("best_sales"),
                    fixed_decimals("best_revenue", 0).alias("best_revenue"))
