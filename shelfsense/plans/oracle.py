"""DuckDB SQL for every SQL-expressible query of the catalog.

These are independent restatements of each operator's semantics over the
same parquet tables (pre-registered views), used as the correctness oracle.
Doubles whose value depends on summation order are rounded in both engines;
counts and unit sums are bigint on both sides.
"""

from __future__ import annotations

N = 5
TAIL = 0.10
SALES_MONTH = "1998-06"
SALES_PRODUCT = "red widget"
REQUEST = ("Supplier#000000001", "STANDARD")
CITY, STATE = "NATION_8", "EUROPE"
K = 6


def sales_cte(period: str = "year", cluster: str = "n.n_regionkey") -> str:
    fmt = "%Y" if period == "year" else "%Y-%m"
    return f"""sales AS (
  SELECT s.s_name AS property_code, {cluster} AS cluster, p.p_type AS category_name,
         p.p_name AS description, strftime(l.l_shipdate, '{fmt}') AS transaction_month,
         CAST(l.l_quantity AS BIGINT) AS number_sold,
         round_even(l.l_quantity * p.p_retailprice * (1 - l.l_discount), 0) / 100 AS dollars_sold,
         r.r_name AS flag_name, n.n_name AS city, r.r_name AS state
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


# Levels of the recommender, each a CTE over ``sales``.
LEVELS = f"""
store_lvl AS (
  SELECT cluster, property_code, category_name, description, transaction_month,
         CAST(sum(number_sold) AS BIGINT) AS number_sold
  FROM sales
  WHERE number_sold > 0 AND cluster IS NOT NULL AND property_code IS NOT NULL
    AND category_name IS NOT NULL AND description IS NOT NULL AND transaction_month IS NOT NULL
  GROUP BY cluster, property_code, category_name, description, transaction_month
),
cluster_lvl AS (
  SELECT cluster, category_name, description, transaction_month,
         CAST(sum(number_sold) AS BIGINT) AS number_sold
  FROM sales
  WHERE number_sold > 0 AND cluster IS NOT NULL
    AND category_name IS NOT NULL AND description IS NOT NULL AND transaction_month IS NOT NULL
  GROUP BY cluster, category_name, description, transaction_month
),
national_lvl AS (
  SELECT category_name, description, transaction_month,
         CAST(sum(number_sold) AS BIGINT) AS number_sold
  FROM sales
  WHERE number_sold > 0
    AND category_name IS NOT NULL AND description IS NOT NULL AND transaction_month IS NOT NULL
  GROUP BY category_name, description, transaction_month
),
prop_cluster AS (
  SELECT property_code, transaction_month, max(cluster) AS cluster
  FROM sales WHERE property_code IS NOT NULL AND transaction_month IS NOT NULL
  GROUP BY property_code, transaction_month
),
store_rank AS (
  SELECT cluster, property_code, category_name, transaction_month,
         CAST(row_number() OVER w AS INTEGER) AS rank, description, number_sold,
         CAST(sum(number_sold) OVER (PARTITION BY property_code, category_name, transaction_month) AS BIGINT) AS total_sold,
         number_sold / sum(number_sold) OVER (PARTITION BY property_code, category_name, transaction_month) AS pct_of_sold,
         sum(number_sold) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           / sum(number_sold) OVER (PARTITION BY property_code, category_name, transaction_month) AS cum_pct
  FROM store_lvl
  WINDOW w AS (PARTITION BY property_code, category_name, transaction_month
               ORDER BY number_sold DESC, cluster, description)
),
store_rank_p AS (
  SELECT *, round_even(100 * pct_of_sold * 10, 0) / 10 AS pct FROM store_rank
),
cluster_rank AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY cluster, category_name, transaction_month
                                    ORDER BY number_sold DESC, description) AS INTEGER) AS rank
  FROM cluster_lvl
),
cluster_top AS (
  SELECT cluster, category_name, transaction_month, rank, description, number_sold,
         CAST(sum(number_sold) OVER (PARTITION BY cluster, category_name, transaction_month) AS BIGINT) AS total_top_sold,
         round_even(100 * number_sold / sum(number_sold) OVER (PARTITION BY cluster, category_name, transaction_month) * 10, 0) / 10 AS pct
  FROM cluster_rank WHERE rank <= {N}
),
national_rank AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY category_name, transaction_month
                                    ORDER BY number_sold DESC, description) AS INTEGER) AS rank
  FROM national_lvl
),
national_top AS (
  SELECT category_name, transaction_month, rank, description, number_sold,
         CAST(sum(number_sold) OVER (PARTITION BY category_name, transaction_month) AS BIGINT) AS total_top_sold,
         round_even(100 * number_sold / sum(number_sold) OVER (PARTITION BY category_name, transaction_month) * 10, 0) / 10 AS pct
  FROM national_rank WHERE rank <= {N}
),
stores AS (
  SELECT k.property_code, k.category_name, k.transaction_month, pc.cluster
  FROM (SELECT DISTINCT property_code, category_name, transaction_month FROM store_lvl) k
  JOIN prop_cluster pc USING (property_code, transaction_month)
),
stocking AS (
  SELECT s.property_code, s.category_name, s.transaction_month, s.cluster,
         ct.rank AS cluster_rank, ct.description
  FROM stores s JOIN cluster_top ct
    ON s.cluster = ct.cluster AND s.category_name = ct.category_name
   AND s.transaction_month = ct.transaction_month
  WHERE NOT EXISTS (SELECT 1 FROM store_lvl x
                    WHERE x.property_code = s.property_code AND x.category_name = s.category_name
                      AND x.transaction_month = s.transaction_month AND x.description = ct.description)
),
discontinue AS (
  SELECT r.property_code, r.category_name, r.transaction_month, pc.cluster, r.rank,
         r.description, r.number_sold, r.pct, r.cum_pct
  FROM store_rank_p r JOIN prop_cluster pc USING (property_code, transaction_month)
  WHERE r.cum_pct > {1.0 - TAIL}
    AND NOT EXISTS (SELECT 1 FROM cluster_top ct
                    WHERE ct.cluster = pc.cluster AND ct.category_name = r.category_name
                      AND ct.transaction_month = r.transaction_month
                      AND ct.description = r.description)
),
no_sales AS (
  SELECT pc.property_code, c.category_name, pc.transaction_month, pc.cluster
  FROM prop_cluster pc
  JOIN (SELECT DISTINCT category_name, transaction_month FROM national_lvl) c USING (transaction_month)
  WHERE NOT EXISTS (SELECT 1 FROM store_lvl x WHERE x.property_code = pc.property_code
                      AND x.category_name = c.category_name
                      AND x.transaction_month = pc.transaction_month)
)"""


def with_sales(body: str, period: str = "year", levels: bool = False, cluster: str = "n.n_regionkey") -> str:
    ctes = [sales_cte(period, cluster)]
    if levels:
        ctes.append(LEVELS.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body


SQL: dict[str, str] = {}

SQL["store_product_sales"] = with_sales("SELECT * FROM store_lvl", levels=True)
SQL["cluster_product_sales"] = with_sales("SELECT * FROM cluster_lvl", levels=True)
SQL["national_product_sales"] = with_sales("SELECT * FROM national_lvl", levels=True)
SQL["sales_grouping_sets"] = with_sales("""
SELECT 'store' AS level, cluster, property_code, category_name, description, transaction_month, number_sold FROM store_lvl
UNION ALL
SELECT 'cluster', cluster, NULL, category_name, description, transaction_month, number_sold FROM cluster_lvl
UNION ALL
SELECT 'national', NULL, NULL, category_name, description, transaction_month, number_sold FROM national_lvl
""", levels=True)
SQL["sales_levels_incremental"] = SQL["sales_grouping_sets"]
SQL["sales_quartiles"] = with_sales("""
SELECT category_name, count(*) AS n, round_even(quantile_cont(dollars_sold, 0.25) * 1000000.0, 0) / 1000000.0 AS q1,
       round_even(quantile_cont(dollars_sold, 0.5) * 1000000.0, 0) / 1000000.0 AS median,
       round_even(quantile_cont(dollars_sold, 0.75) * 1000000.0, 0) / 1000000.0 AS q3
FROM sales GROUP BY category_name""")
SQL["property_cluster"] = with_sales("""
SELECT property_code, transaction_month, cluster, flag_name, city, state FROM (
  SELECT property_code, transaction_month,
         max(cluster) OVER (PARTITION BY property_code, transaction_month) AS cluster,
         flag_name, city, state,
         row_number() OVER (PARTITION BY property_code, transaction_month
                            ORDER BY flag_name, city, state) AS rn
  FROM sales WHERE property_code IS NOT NULL AND transaction_month IS NOT NULL
) WHERE rn = 1""")
SQL["store_ranking"] = with_sales("SELECT * FROM store_rank_p", levels=True)
SQL["store_ranking_bucketed"] = SQL["store_ranking"]
SQL["store_top"] = with_sales(f"SELECT * FROM store_rank_p WHERE rank <= {N}", levels=True)
SQL["cluster_top"] = with_sales("SELECT * FROM cluster_top", levels=True)
SQL["national_top"] = with_sales("SELECT * FROM national_top", levels=True)
SQL["stocking_suggestions"] = with_sales(
    "SELECT property_code, category_name, transaction_month, cluster, cluster_rank, description FROM stocking",
    levels=True)
SQL["discontinue_suggestions"] = with_sales("SELECT * FROM discontinue", levels=True)
SQL["already_stocking_top"] = with_sales("""
SELECT s.property_code, s.category_name, s.transaction_month, s.cluster FROM stores s
WHERE NOT EXISTS (SELECT 1 FROM stocking a WHERE a.property_code = s.property_code
                  AND a.category_name = s.category_name AND a.transaction_month = s.transaction_month)
""", levels=True)
SQL["no_sales_categories"] = with_sales("""
SELECT property_code, transaction_month, cluster, CAST(count(*) AS INTEGER) AS n_categories,
       string_agg(category_name, '|' ORDER BY category_name) AS categories
FROM no_sales GROUP BY property_code, transaction_month, cluster""", period="month", levels=True)


# ---------------------------------------------------------------- pricing
def q_sql(rank: str, val: str, p: float, n: str = "n") -> str:
    """Linear-interpolation quantile ``p`` of ``val`` in a group, as an
    aggregate over rows ranked by ``val`` (``rank`` 1..``n``).  Written with
    the interpolation ``(hi - pos) * lo_v + (pos - lo) * hi_v`` and no
    interpolation when the position is whole or both values are equal."""
    pos = f"((CAST({n} AS DOUBLE) - 1) * {p})"
    lo_v = f"max(CASE WHEN {rank} = floor({pos}) + 1 THEN {val} END)"
    hi_v = f"max(CASE WHEN {rank} = ceil({pos}) + 1 THEN {val} END)"
    return (f"(CASE WHEN floor({pos}) = ceil({pos}) OR {lo_v} = {hi_v} THEN {lo_v} "
            f"ELSE (ceil({pos}) - {pos}) * {lo_v} + ({pos} - floor({pos})) * {hi_v} END)")


PRICE = """
pts AS (
  SELECT description, unit_price, avg(number_sold) AS number_sold,
         unit_price * avg(number_sold) AS revenue
  FROM (SELECT description, number_sold,
               CASE WHEN number_sold <> 0
                    THEN round_even(dollars_sold / number_sold * 100.0, 0) / 100.0 END AS unit_price
        FROM sales)
  WHERE unit_price IS NOT NULL AND description IS NOT NULL
  GROUP BY description, unit_price
),
bins0 AS (
  SELECT *, round_even(min(unit_price) OVER w, 0) AS price_low,
         CAST(ceil(max(unit_price) OVER w) AS DOUBLE) AS price_high,
         CAST(round_even(unit_price * 100.0, 0) AS BIGINT) AS price_cents
  FROM pts WINDOW w AS (PARTITION BY description)
),
bins AS (
  SELECT *, price_low + 0.25 * bin AS bin_edge FROM (
    SELECT *, CAST(greatest(ceil((price_cents - CAST(price_low AS BIGINT) * 100) / 25), 0) AS INTEGER) AS bin
    FROM bins0)
),
orows AS (
  SELECT *, CAST(max(CASE WHEN rk = 1 THEN bin END) OVER (PARTITION BY description) AS INTEGER) AS best_bin FROM (
    SELECT *, row_number() OVER (PARTITION BY description
                                 ORDER BY abs(n_prices * bin - sum_bin), unit_price) AS rk,
           CASE WHEN max_cents > min_cents THEN
             CAST(least(floor((price_cents - min_cents) * 10 / (max_cents - min_cents)), 9) AS INTEGER) END AS ten_bin
    FROM (SELECT *, count(*) OVER w AS n_prices, sum(bin) OVER w AS sum_bin,
                 min(price_cents) OVER w AS min_cents, max(price_cents) OVER w AS max_cents
          FROM bins WINDOW w AS (PARTITION BY description)))
),
tb_r AS (
  SELECT description, ten_bin, number_sold, revenue, min_cents, max_cents,
         row_number() OVER (PARTITION BY description, ten_bin ORDER BY number_sold) AS ru,
         row_number() OVER (PARTITION BY description, ten_bin ORDER BY revenue) AS rr,
         count(*) OVER (PARTITION BY description, ten_bin) AS n
  FROM orows WHERE ten_bin IS NOT NULL
),
tenbin AS (
  SELECT description, ten_bin, n, min(min_cents) AS min_cents, max(max_cents) AS max_cents,
         """ + q_sql("ru", "number_sold", 0.5) + """ AS median_units,
         """ + q_sql("rr", "revenue", 0.5) + """ AS median_revenue
  FROM tb_r GROUP BY description, ten_bin, n
),
fb_r AS (
  SELECT description, number_sold, revenue,
         row_number() OVER (PARTITION BY description ORDER BY number_sold) AS ru,
         row_number() OVER (PARTITION BY description ORDER BY revenue) AS rr,
         count(*) OVER (PARTITION BY description) AS n
  FROM orows WHERE bin = best_bin
),
fb AS (
  SELECT description, """ + q_sql("ru", "number_sold", 0.5) + """ AS fb_sales,
         """ + q_sql("rr", "revenue", 0.5) + """ AS fb_rev
  FROM fb_r GROUP BY description, n
),
optimum AS (
  SELECT p.description, CAST(p.n_prices AS BIGINT) AS n_prices,
         CASE WHEN p.n_prices >= 2 THEN p.best_bin END AS best_bin,
         CASE WHEN p.n_prices >= 2 THEN p.price_low + 0.25 * p.best_bin END AS best_price,
         CASE WHEN p.n_prices >= 2 THEN p.edges[p.best_bin + 1] END AS best_price_literal,
         CASE WHEN p.n_prices >= 2 THEN round_even((CASE WHEN t.max_rev <> 0 THEN t.max_rev ELSE fb.fb_rev END) * 1000000.0, 0) / 1000000.0 END AS best_revenue,
         CASE WHEN p.n_prices >= 2 THEN round_even((CASE WHEN t.max_sales <> 0 THEN t.max_sales ELSE fb.fb_sales END) * 1000000.0, 0) / 1000000.0 END AS best_sales,
         CASE WHEN p.n_prices >= 2 THEN CAST(coalesce(t.n_median_bins, 0) AS INTEGER) END AS n_median_bins
  FROM (SELECT description, count(*) AS n_prices, max(best_bin) AS best_bin, min(price_low) AS price_low,
               list_sort(list(DISTINCT bin_edge)) AS edges
        FROM orows GROUP BY description) p
  LEFT JOIN fb USING (description)
  LEFT JOIN (SELECT description, max(median_revenue) AS max_rev, max(median_units) AS max_sales,
                    count(*) AS n_median_bins
             FROM tenbin GROUP BY description) t USING (description)
)"""


def with_price(body: str) -> str:
    return "WITH " + sales_cte("year") + "," + PRICE + "\n" + body


def r6(x: str) -> str:
    return f"round_even(({x}) * 1000000.0, 0) / 1000000.0"


SQL["price_points"] = with_price("SELECT * FROM pts")
SQL["price_bins"] = with_price("SELECT * FROM bins")
SQL["price_fit"] = with_price(f"""
SELECT description, CAST(count(*) AS BIGINT) AS n_prices, min(unit_price) AS min_price,
       max(unit_price) AS max_price, min(price_low) AS price_low, max(price_high) AS price_high,
       CAST((max(price_high) - min(price_low)) * 4 + 1 AS INTEGER) AS n_edges,
       avg(bin) AS mean_bin, {r6('stddev_pop(bin)')} AS std_bin,
       CAST(count(DISTINCT bin) AS INTEGER) AS n_occupied_bins,
       array_to_string(list_sort(list(DISTINCT bin)), ',') AS occupied_bins
FROM bins GROUP BY description""")
SQL["price_optimum"] = with_price("SELECT * FROM optimum")
SQL["price_binned_median"] = with_price(f"""
SELECT description, ten_bin, CAST(n AS BIGINT) AS n,
       {r6('(min_cents + (max_cents - min_cents) / 10 * ten_bin) / 100')} AS bin_low,
       {r6('(min_cents + (max_cents - min_cents) / 10 * (ten_bin + 1)) / 100')} AS bin_high,
       {r6('median_units')} AS median_units, {r6('median_revenue')} AS median_revenue
FROM tenbin""")


def _box_sql(measure: str) -> str:
    return with_price(f"""
, br AS (SELECT description, bin, {measure} AS y,
                row_number() OVER (PARTITION BY description, bin ORDER BY {measure}) AS r,
                count(*) OVER (PARTITION BY description, bin) AS n FROM bins),
bq AS (SELECT description, bin, [{q_sql('r', 'y', 0.25)}, {q_sql('r', 'y', 0.5)}, {q_sql('r', 'y', 0.75)}] AS qs
       FROM br GROUP BY description, bin, n),
bj AS (SELECT b.description, b.bin, b.bin_edge, b.{measure} AS y, q.qs,
              q.qs[1] - 1.5 * (q.qs[3] - q.qs[1]) AS lo_f, q.qs[3] + 1.5 * (q.qs[3] - q.qs[1]) AS hi_f
       FROM bins b JOIN bq q USING (description, bin)),
ba AS (SELECT description, bin, min(bin_edge) AS bin_edge, count(*) AS n, any_value(qs) AS qs,
              min(CASE WHEN y >= lo_f THEN y END) AS wlo, max(CASE WHEN y <= hi_f THEN y END) AS whi,
              count(CASE WHEN y < lo_f OR y > hi_f THEN 1 END) AS n_outliers
       FROM bj GROUP BY description, bin)
SELECT description, '{measure}' AS measure, bin, bin_edge, CAST(n AS BIGINT) AS n,
       {r6('qs[1]')} AS q1, {r6('qs[2]')} AS median, {r6('qs[3]')} AS q3,
       {r6('CASE WHEN wlo IS NULL OR wlo > qs[1] THEN qs[1] ELSE wlo END')} AS whisker_low,
       {r6('CASE WHEN whi IS NULL OR whi < qs[3] THEN qs[3] ELSE whi END')} AS whisker_high,
       CAST(n_outliers AS BIGINT) AS n_outliers
FROM ba""").replace(")\n, br", "),\nbr", 1)


SQL["price_box_stats"] = _box_sql("number_sold")
SQL["price_box_stats_revenue"] = _box_sql("revenue")
SQL["price_strip_points"] = with_price(f"""
, sr AS (SELECT description, bin, number_sold, revenue,
                row_number() OVER (PARTITION BY description, bin ORDER BY number_sold) AS ru,
                row_number() OVER (PARTITION BY description, bin ORDER BY revenue) AS rr,
                count(*) OVER (PARTITION BY description, bin) AS n FROM bins),
sq AS (SELECT description, bin,
              [{q_sql('ru', 'number_sold', 0.25)}, {q_sql('ru', 'number_sold', 0.75)}] AS u,
              [{q_sql('rr', 'revenue', 0.25)}, {q_sql('rr', 'revenue', 0.75)}] AS r
       FROM sr GROUP BY description, bin, n)
SELECT b.description, b.unit_price, b.number_sold, b.revenue, b.bin, b.bin_edge,
       (b.number_sold < q.u[1] - 1.5 * (q.u[2] - q.u[1]) OR b.number_sold > q.u[2] + 1.5 * (q.u[2] - q.u[1])) AS outlier_units,
       (b.revenue < q.r[1] - 1.5 * (q.r[2] - q.r[1]) OR b.revenue > q.r[2] + 1.5 * (q.r[2] - q.r[1])) AS outlier_revenue
FROM bins b JOIN sq q USING (description, bin)""").replace(")\n, sr", "),\nsr", 1)
SQL["price_fit_curve"] = with_price(f"""
, fc AS (
  SELECT *, max(density) OVER (PARTITION BY description) AS max_density FROM (
    SELECT *, CASE WHEN std_bin > 0 THEN
                exp(-(((bin - mean_bin) / std_bin) * ((bin - mean_bin) / std_bin)) / 2) / (std_bin * sqrt(2 * pi())) END AS density
    FROM (SELECT *, avg(bin) OVER w AS mean_bin, stddev_pop(bin) OVER w AS std_bin
          FROM bins WINDOW w AS (PARTITION BY description))))
SELECT f.description, f.unit_price, f.bin, {r6('f.density')} AS density,
       {r6('f.density / f.max_density * o.best_sales')} AS fit_units,
       {r6('f.density / f.max_density * o.best_revenue')} AS fit_revenue
FROM fc f LEFT JOIN optimum o USING (description)""").replace(")\n, fc", "),\nfc", 1)
SQL["price_summary"] = with_price("""
SELECT description, printf('%.2f', round_even(best_price * 100.0, 0) / 100.0) AS best_price,
       printf('%.0f', round_even(best_sales, 0)) AS best_sales,
       printf('%.0f', round_even(best_revenue, 0)) AS best_revenue
FROM optimum""")


def _hist_sql(variables: list[str]) -> str:
    unions = "\n  UNION ALL ".join(
        f"SELECT description, '{v}' AS variable, "
        + ("CAST(round_even(unit_price * 100.0, 0) AS DOUBLE)" if v == "unit_price" else v)
        + f" AS v FROM pts" for v in variables)
    return with_price(f"""
, hl AS ({unions}),
hs AS (SELECT description, variable, count(*) AS n, min(v) AS vmin, max(v) AS vmax
       FROM hl GROUP BY description, variable HAVING count(*) >= 2),
hs2 AS (SELECT *, CASE WHEN vmax > vmin THEN vmin ELSE vmin - 0.5 END AS lo,
               CASE WHEN vmax > vmin THEN vmax ELSE vmax + 0.5 END AS hi FROM hs),
hb AS (SELECT h.description, h.variable,
              CAST(least(CASE WHEN h.variable = 'unit_price'
                              THEN floor((h.v - s.lo) * 15 / (s.hi - s.lo))
                              ELSE floor((h.v - s.lo) * (15.0 / (s.hi - s.lo))) END, 14) AS INTEGER) AS bin
       FROM hl h JOIN hs2 s USING (description, variable)),
hc AS (SELECT description, variable, bin, count(*) AS cnt FROM hb GROUP BY ALL),
hg AS (SELECT s.*, CAST(g.bin AS INTEGER) AS bin, CASE WHEN s.variable = 'unit_price' THEN 0.01 ELSE 1.0 END AS scale
       FROM hs2 s CROSS JOIN range(15) g(bin))
SELECT g.description, g.variable, g.bin,
       {r6('(g.lo + (g.hi - g.lo) / 15 * g.bin) * g.scale')} AS bin_low,
       {r6('(g.lo + (g.hi - g.lo) / 15 * (g.bin + 1)) * g.scale')} AS bin_high,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
       {r6('coalesce(c.cnt, 0) / (g.n * ((g.hi - g.lo) / 15) * g.scale)')} AS density
FROM hg g LEFT JOIN hc c USING (description, variable, bin)""").replace(")\n, hl", "),\nhl", 1)


SQL["price_histogram"] = _hist_sql(["unit_price"])
SQL["price_histogram_all"] = _hist_sql(["unit_price", "number_sold", "revenue"])


def _kde_sql(variables: list[str]) -> str:
    unions = "\n  UNION ALL ".join(
        f"SELECT description, '{v}' AS variable, CAST({v} AS DOUBLE) AS v FROM pts" for v in variables)
    return with_price(f"""
, kl AS ({unions}),
ks AS (SELECT description, variable, count(*) AS n, min(v) AS vmin, max(v) AS vmax,
              stddev_pop(v) AS sp, stddev_samp(v) AS ss
       FROM kl GROUP BY description, variable HAVING count(*) >= 2 AND stddev_samp(v) > 0),
ks2 AS (SELECT *, pow(n, -0.2) AS f, vmin - 3 * pow(n, -0.2) * sp AS lo, vmax + 3 * pow(n, -0.2) * sp AS hi FROM ks),
kg AS (SELECT s.description, s.variable, s.n, s.f * s.ss AS h, CAST(g.i AS INTEGER) AS i,
              CASE WHEN g.i = 99 THEN s.hi ELSE g.i * ((s.hi - s.lo) / 99) + s.lo END AS x
       FROM ks2 s CROSS JOIN range(100) g(i))
SELECT g.description, g.variable, g.i, {r6('g.x')} AS x,
       {r6('sum(exp(-0.5 * ((g.x - l.v) / g.h) * ((g.x - l.v) / g.h))) / (g.n * g.h * sqrt(2 * pi()))')} AS density
FROM kg g JOIN kl l USING (description, variable)
GROUP BY g.description, g.variable, g.i, g.x, g.n, g.h""").replace(")\n, kl", "),\nkl", 1)


SQL["price_kde"] = _kde_sql(["unit_price"])
# Linear binning: each price is shared between the two nearest of 397 grid points.
SQL["price_kde_binned"] = with_price(f"""
, ks AS (SELECT description, count(*) AS n, min(unit_price) AS vmin, max(unit_price) AS vmax,
              stddev_pop(unit_price) AS sp, stddev_samp(unit_price) AS ss
       FROM pts GROUP BY description HAVING count(*) >= 2 AND stddev_samp(unit_price) > 0),
kt AS (SELECT description, n, pow(n, -0.2) * ss AS h, vmin - 3 * pow(n, -0.2) * sp AS lo, vmax + 3 * pow(n, -0.2) * sp AS hi FROM ks),
ka AS (SELECT description, least(greatest((unit_price - lo) / ((hi - lo) / 396), 0.0), 396.0) AS pos FROM pts JOIN kt USING (description)),
kj AS (SELECT description, pos, least(floor(pos), 395) AS j FROM ka),
kw AS (SELECT description, j, 1 - (pos - j) AS w FROM kj UNION ALL SELECT description, j + 1, pos - j FROM kj),
kc AS (SELECT description, j, sum(w) AS w FROM kw GROUP BY description, j),
kg AS (SELECT t.*, CAST(g.i AS INTEGER) AS i, CASE WHEN g.i = 99 THEN hi ELSE g.i * ((hi - lo) / 99) + lo END AS x FROM kt t CROSS JOIN range(100) g(i))
SELECT description, 'unit_price' AS variable, i, {r6('x')} AS x,
       {r6('sum(w * exp(-0.5 * pow(abs(j - 4 * i) * ((hi - lo) / 396) / h, 2))) / (n * h * sqrt(2 * pi()))')} AS density
FROM kg JOIN kc USING (description) GROUP BY description, i, x, n, h""").replace(")\n, ks", "),\nks", 1)
SQL["price_kde_all"] = _kde_sql(["unit_price", "number_sold", "revenue"])
SQL["sales_by_product"] = with_sales(f"SELECT * FROM sales WHERE description = '{SALES_PRODUCT}'")
SQL["sales_by_month"] = with_sales(f"SELECT * FROM sales WHERE transaction_month = '{SALES_MONTH}'",
                                   period="month")


# ------------------------------------------------------------- properties
PROPS = """
props_raw AS (
  SELECT CAST(s.s_suppkey AS BIGINT) AS id, s.s_name AS property_code, s.s_name AS name,
         'Street ' || CAST(s.s_suppkey AS VARCHAR) AS address, n.n_name AS city, r.r_name AS state,
         CASE WHEN s.s_suppkey % 10 = 9 THEN 'K1A 0B1' WHEN s.s_suppkey % 10 = 8 THEN '80202-1234'
              ELSE lpad(CAST(s.s_suppkey * 7919 % 100000 AS VARCHAR), 5, '0') END AS zip,
         CAST(CASE WHEN s.s_suppkey % 4 = 0 THEN 0.07 END AS DOUBLE) AS sales_tax_rate,
         CAST(CASE WHEN s.s_suppkey % 6 = 0 THEN 0.1 END AS DOUBLE) AS alcohol_tax_rate,
         CAST(NULL AS DOUBLE) AS tobacco_tax_rate,
         CAST(CASE WHEN s.s_suppkey % 7 <> 0 THEN s.s_suppkey % 7 END AS BIGINT) AS management_company_id,
         CAST(CASE WHEN s.s_nationkey <> 0 THEN s.s_nationkey END AS BIGINT) AS flag_id,
         CAST(s.s_nationkey % 5 AS BIGINT) AS brand_id,
         'K' || CAST(s.s_suppkey % 3 AS VARCHAR) AS kind,
         'G' || CAST(s.s_suppkey % 4 AS VARCHAR) AS guest_profile,
         CAST(CASE WHEN s.s_nationkey % 5 = 1 THEN 2 ELSE 1 END AS INTEGER) AS currency_id,
         CASE WHEN s.s_suppkey % 11 = 0 THEN NULL ELSE 'L' || CAST(s.s_suppkey % 5 AS VARCHAR) END AS location_type,
         CAST(20 + s.s_suppkey * 37 % 400 AS INTEGER) AS rooms
  FROM supplier s
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
brands AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region),
flags AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS brand_id FROM nation),
src AS (
  SELECT p.id AS property_id, p.property_code, p.name AS property_name, p.address, p.city, p.state, p.zip,
         p.sales_tax_rate, p.alcohol_tax_rate, p.tobacco_tax_rate, p.management_company_id, p.flag_id,
         f.name AS flag_name, f.brand_id, b.name AS brand_name, p.kind, p.guest_profile, p.currency_id,
         p.location_type, p.rooms
  FROM props_raw p LEFT JOIN brands b ON p.brand_id = b.id LEFT JOIN flags f ON p.flag_id = f.id
),
attrs0 AS (
  SELECT * REPLACE (CASE WHEN regexp_matches(zip, '^[0-9]+$') THEN substr(zip, 1, 1) ELSE 'can' END AS zip),
         CASE WHEN currency_id = 1 THEN 'USD' ELSE 'CAD' END AS currency
  FROM src
),
attrs AS (
  SELECT a.*, CAST(c.props_under_mgmt AS BIGINT) AS props_under_mgmt
  FROM attrs0 a JOIN (SELECT management_company_id, count(*) AS props_under_mgmt FROM attrs0
                      WHERE management_company_id IS NOT NULL GROUP BY management_company_id) c
    USING (management_company_id)
),
lv AS (
  SELECT col, lvl, row_number() OVER (PARTITION BY col ORDER BY lvl) AS rn FROM (
    SELECT DISTINCT 'kind' AS col, kind AS lvl FROM attrs WHERE kind IS NOT NULL
    UNION SELECT DISTINCT 'guest_profile', guest_profile FROM attrs WHERE guest_profile IS NOT NULL
    UNION SELECT DISTINCT 'location_type', location_type FROM attrs WHERE location_type IS NOT NULL
    UNION SELECT DISTINCT 'currency', currency FROM attrs WHERE currency IS NOT NULL
    UNION SELECT DISTINCT 'flag_name', flag_name FROM attrs WHERE flag_name IS NOT NULL
    UNION SELECT DISTINCT 'zip', zip FROM attrs WHERE zip IS NOT NULL)
),
dummies AS (
  SELECT a.property_id, l.col || '_' || l.lvl AS feature,
         CAST(CASE WHEN (CASE l.col WHEN 'kind' THEN a.kind WHEN 'guest_profile' THEN a.guest_profile
                                    WHEN 'location_type' THEN a.location_type WHEN 'currency' THEN a.currency
                                    WHEN 'flag_name' THEN a.flag_name ELSE a.zip END) = l.lvl
                   THEN 1 ELSE 0 END AS INTEGER) AS value
  FROM attrs a CROSS JOIN lv l WHERE l.rn > 1
)"""


def with_props(body: str) -> str:
    return "WITH " + PROPS.strip() + "\n" + body


SQL["property_source"] = with_props("SELECT * FROM src")
SQL["props_under_mgmt"] = with_props("SELECT * FROM attrs")
SQL["property_dummies"] = with_props("SELECT * FROM dummies WHERE value = 1")
SQL["property_features"] = with_props("""
SELECT property_id, 'props_under_mgmt' AS feature, CAST(props_under_mgmt AS DOUBLE) AS value FROM attrs
UNION ALL SELECT property_id, 'rooms', CAST(rooms AS DOUBLE) FROM attrs
UNION ALL SELECT property_id, feature, CAST(value AS DOUBLE) FROM dummies WHERE value = 1""")
SQL["cluster_profile"] = with_props(f"""
, feats AS (
  SELECT property_id, 'props_under_mgmt' AS feature, CAST(props_under_mgmt AS DOUBLE) AS value FROM attrs
  UNION ALL SELECT property_id, 'rooms', CAST(rooms AS DOUBLE) FROM attrs
  UNION ALL SELECT property_id, feature, CAST(value AS DOUBLE) FROM dummies),
lab AS (SELECT property_id, CAST(property_id % {K} AS INTEGER) AS cluster FROM attrs),
ov AS (SELECT feature, avg(value) AS overall_mean, stddev_pop(value) AS overall_std FROM feats GROUP BY feature),
cm AS (SELECT cluster, feature, avg(value) AS cluster_mean, count(*) AS n_properties
       FROM feats JOIN lab USING (property_id) GROUP BY cluster, feature),
zz AS (SELECT cluster, feature, cluster_mean, overall_mean, overall_std, n_properties,
              CASE WHEN overall_std > 0 THEN round((cluster_mean - overall_mean) / overall_std, 6) END AS z
       FROM cm JOIN ov USING (feature))
SELECT cluster, feature, round(cluster_mean, 6) AS cluster_mean, round(overall_mean, 6) AS overall_mean,
       round(overall_std, 6) AS overall_std, z, CAST(n_properties AS BIGINT) AS n_properties
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC NULLS LAST, feature) AS rn FROM zz)
WHERE rn = 1""").replace(")\n\n, feats", "),\nfeats", 1)
# Only properties with a management company have attributes, hence labels
LABEL = f"CASE WHEN s.s_suppkey % 7 <> 0 THEN CAST(s.s_suppkey % {K} AS INTEGER) END"
SQL["clustered_sales"] = with_sales("SELECT * FROM sales", cluster=LABEL)
SQL["clustered_stocking_suggestions"] = with_sales(
    "SELECT property_code, category_name, transaction_month, cluster, cluster_rank, description FROM stocking",
    levels=True, cluster=LABEL)

# ---------------------------------------------------------------- lookups
SQL["property_lookup"] = with_sales("SELECT DISTINCT property_code, flag_name, city, state FROM sales")
SQL["property_lookup_filtered"] = with_sales(f"""
SELECT DISTINCT property_code, flag_name, city, state FROM sales
WHERE city = '{CITY}' AND state = '{STATE}' AND flag_name = '{STATE}'""")
SQL["product_lookup_filtered"] = with_sales(
    f"SELECT DISTINCT category_name, description FROM sales WHERE category_name = '{REQUEST[1]}'")
SQL["product_lookup"] = with_sales("SELECT DISTINCT category_name, description FROM sales")
SQL["dimension_values"] = with_sales("""
SELECT 'property_code' AS dimension, false AS is_any, v AS value FROM (SELECT DISTINCT property_code AS v FROM sales) UNION ALL
SELECT 'transaction_month' AS dimension, false AS is_any, v AS value FROM (SELECT DISTINCT transaction_month AS v FROM sales) UNION ALL
SELECT 'category_name' AS dimension, false AS is_any, v AS value FROM (SELECT DISTINCT category_name AS v FROM sales) UNION ALL
SELECT 'flag_name' AS dimension, false AS is_any, v AS value FROM (SELECT DISTINCT flag_name AS v FROM sales) UNION ALL
SELECT 'city' AS dimension, false AS is_any, v AS value FROM (SELECT DISTINCT city AS v FROM sales) UNION ALL
SELECT 'state' AS dimension, false AS is_any, v AS value FROM (SELECT DISTINCT state AS v FROM sales) UNION ALL
SELECT 'flag_name', true, NULL WHERE EXISTS (SELECT 1 FROM sales) UNION ALL
SELECT 'state', true, NULL WHERE EXISTS (SELECT 1 FROM sales)""", period="month")

# ----------------------------------------------------------------- report
ALL_KEYS = """
keys AS (SELECT property_code, category_name, transaction_month, cluster, true AS has_sales FROM stores)"""
REQUESTED_KEYS = """
asked AS (
  SELECT pc.property_code, p.p_type AS category_name, pc.transaction_month
  FROM prop_cluster pc JOIN supplier s ON s.s_name = pc.property_code JOIN part p ON p.p_partkey = s.s_suppkey
),
keys AS (
  SELECT property_code, category_name, transaction_month, cluster, true AS has_sales
  FROM stores JOIN asked USING (property_code, category_name, transaction_month)
  UNION ALL
  SELECT property_code, category_name, transaction_month, cluster, false
  FROM no_sales JOIN asked USING (property_code, category_name, transaction_month)
)"""
ONE_KEY = f"""
asked AS (SELECT '{REQUEST[0]}' AS property_code, '{REQUEST[1]}' AS category_name, '{SALES_MONTH}' AS transaction_month),
""" + REQUESTED_KEYS[REQUESTED_KEYS.index("keys AS"):]


CITY_KEYS = f"""
asked AS (SELECT min(s_name) AS property_code, '{REQUEST[1]}' AS category_name, '{SALES_MONTH}' AS transaction_month
          FROM supplier GROUP BY s_nationkey),
""" + REQUESTED_KEYS[REQUESTED_KEYS.index("keys AS"):]


def report_sql(keys: str, period: str) -> str:
    return with_sales(f"""
, pdesc AS (
  SELECT s.s_name AS property_code, min(r.r_name) AS flag_name, min(n.n_name) AS city, min(r.r_name) AS state
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY s.s_name
),
{keys.strip()},
here AS (SELECT property_code, category_name, transaction_month, cluster FROM keys WHERE has_sales),
already AS (
  SELECT s.property_code, s.category_name, s.transaction_month FROM here s
  WHERE NOT EXISTS (SELECT 1 FROM stocking a WHERE a.property_code = s.property_code
                    AND a.category_name = s.category_name AND a.transaction_month = s.transaction_month)
),
adds AS (
  SELECT t.*, CAST(row_number() OVER (PARTITION BY property_code, category_name, transaction_month
                                      ORDER BY cluster_rank) AS INTEGER) AS seq
  FROM stocking t SEMI JOIN here USING (property_code, category_name, transaction_month)
),
rms AS (
  SELECT t.*, CAST(row_number() OVER (PARTITION BY property_code, category_name, transaction_month
                                      ORDER BY rank) AS INTEGER) AS seq
  FROM discontinue t SEMI JOIN here USING (property_code, category_name, transaction_month)
),
lines AS (
  SELECT k.property_code, k.category_name, k.transaction_month, 0 AS section, 0 AS seq, 1 AS is_header,
         'For store #' || k.property_code || ', ' || coalesce(d.flag_name, 'None') || ', '
           || coalesce(d.city, 'None') || ', ' || coalesce(d.state, 'None') || ', for '
           || k.transaction_month || ', part of Cluster (' || coalesce(CAST(k.cluster AS VARCHAR), 'nan') || ')' AS text
  FROM keys k JOIN pdesc d USING (property_code)
  UNION ALL
  SELECT property_code, category_name, transaction_month, 1, 0, 1, 'Your top products in ' || category_name || ':' FROM here
  UNION ALL
  SELECT property_code, category_name, transaction_month, 1, rank, 0,
         CAST(rank AS VARCHAR) || '. ' || description || ': ' || CAST(number_sold AS VARCHAR) || ' units, '
           || CAST(pct AS VARCHAR) || '%'
  FROM store_rank_p SEMI JOIN here USING (property_code, category_name, transaction_month) WHERE rank <= {N}
  UNION ALL
  SELECT property_code, category_name, transaction_month, 1, 0, 1, 'No products sold in ' || category_name
  FROM keys WHERE NOT has_sales
  UNION ALL
  SELECT property_code, category_name, transaction_month, 2, 0, 1,
         'Cluster (' || coalesce(CAST(cluster AS VARCHAR), 'nan') || ') top products:' FROM keys
  UNION ALL
  SELECT k.property_code, k.category_name, k.transaction_month, 2, ct.rank, 0,
         CAST(ct.rank AS VARCHAR) || '. ' || ct.description || ': ' || CAST(ct.pct AS VARCHAR) || '%'
  FROM keys k JOIN cluster_top ct ON k.cluster = ct.cluster AND k.category_name = ct.category_name
   AND k.transaction_month = ct.transaction_month
  UNION ALL
  SELECT property_code, category_name, transaction_month, 3, 0, 1,
         CASE WHEN has_sales THEN 'National top product:' ELSE 'National top products in ' || category_name || ':' END
  FROM keys
  UNION ALL
  SELECT k.property_code, k.category_name, k.transaction_month, 3, nt.rank, 0,
         CAST(nt.rank AS VARCHAR) || '. ' || nt.description || ': ' || CAST(nt.pct AS VARCHAR) || '%'
  FROM keys k JOIN national_top nt ON k.category_name = nt.category_name AND k.transaction_month = nt.transaction_month
  UNION ALL
  SELECT property_code, category_name, transaction_month, 4, 0, 1, 'You are selling the top products already!' FROM already
  UNION ALL
  SELECT property_code, category_name, transaction_month, 4, 0, 1, 'Stocking suggestions:' FROM adds WHERE seq = 1
  UNION ALL
  SELECT property_code, category_name, transaction_month, 4, seq, 0, CAST(seq AS VARCHAR) || '. ' || description FROM adds
  UNION ALL
  SELECT property_code, category_name, transaction_month, 5, 0, 1, 'Consider discontinue stocking:' FROM rms WHERE seq = 1
  UNION ALL
  SELECT property_code, category_name, transaction_month, 5, seq, 0,
         CAST(seq AS VARCHAR) || '. ' || description || ': ' || CAST(number_sold AS VARCHAR) || ' units, '
           || CAST(pct AS VARCHAR) || '%'
  FROM rms
)
SELECT property_code, category_name, transaction_month, CAST(section AS INTEGER) AS section,
       CAST(seq AS INTEGER) AS seq, CAST(is_header AS INTEGER) AS is_header, text FROM lines""",
        period=period, levels=True).replace(")\n, pdesc", "),\npdesc", 1)


SQL["recommendation_report"] = report_sql(ALL_KEYS, "year")
SQL["recommendation_report_requests"] = report_sql(REQUESTED_KEYS, "month")
SQL["recommendation_report_one"] = report_sql(ONE_KEY, "month")
SQL["recommendation_report_cities"] = report_sql(CITY_KEYS, "month")
SQL["price_points_filtered"] = with_sales(f"""
SELECT description, unit_price, avg(number_sold) AS number_sold, unit_price * avg(number_sold) AS revenue
FROM (SELECT description, number_sold,
             CASE WHEN number_sold <> 0
                  THEN round_even(dollars_sold / number_sold * 100.0, 0) / 100.0 END AS unit_price
      FROM sales WHERE description = '{SALES_PRODUCT}' AND cluster = 0 AND transaction_month = '1998')
WHERE unit_price IS NOT NULL GROUP BY description, unit_price""")


def _curve_sql() -> str:
    """The least-squares cubic by orthogonal polynomials of the prices."""
    ctes, last = [], "cz"
    for i in range(4):
        step = ""
        if i < 3:
            step = f"(z - a{i} / s{i}) * p{i}" + (f" - s{i} / s{i - 1} * p{i - 1}" if i else "")
            step = f", CASE WHEN n >= 4 THEN {step} END AS p{i + 1}"
        ctes.append(f"""c{i} AS (SELECT *{step} FROM (
  SELECT *, sum(p{i} * p{i}) OVER w AS s{i}, sum(number_sold * p{i}) OVER w AS cu{i},
         sum(revenue * p{i}) OVER w AS cr{i}, sum(z * p{i} * p{i}) OVER w AS a{i}
  FROM {last} WINDOW w AS (PARTITION BY description)))""")
        last = f"c{i}"
    fit = lambda t: " + ".join(f"c{t}{i} / s{i} * p{i}" for i in range(4))
    return with_price(f"""
, cz AS (SELECT description, unit_price, number_sold, revenue, n, CASE WHEN n >= 4 THEN c / m END AS z, 1.0::DOUBLE AS p0 FROM (
  SELECT *, max(abs(c)) OVER w AS m FROM (
    SELECT *, count(*) OVER w AS n, unit_price - avg(unit_price) OVER w AS c FROM pts WINDOW w AS (PARTITION BY description))
  WINDOW w AS (PARTITION BY description))),
{", ".join(ctes)},
cf AS (SELECT *, CASE WHEN n >= 4 THEN {fit("u")} END AS fu, CASE WHEN n >= 4 THEN {fit("r")} END AS fr FROM c3),
cs AS (SELECT *, sum(pow(number_sold - fu, 2)) OVER w AS su, sum(pow(revenue - fr, 2)) OVER w AS sr
       FROM cf WINDOW w AS (PARTITION BY description))
SELECT description, unit_price, number_sold, revenue,
       CASE WHEN su <= 1000000 THEN {r6('fu')} + 0.0 END AS fit_units, round_even(su * 10000.0, 0) / 10000.0 AS ssr_units,
       CASE WHEN sr <= 1000000 THEN {r6('fr')} + 0.0 END AS fit_revenue, round_even(sr * 10000.0, 0) / 10000.0 AS ssr_revenue
FROM cs""").replace(")\n, cz", "),\ncz", 1)


SQL["price_curve"] = _curve_sql()

SQL["price_points_by_cluster"] = with_sales("""
SELECT description, cluster, unit_price, avg(number_sold) AS number_sold,
       unit_price * avg(number_sold) AS revenue
FROM (SELECT description, cluster, number_sold,
             CASE WHEN number_sold <> 0
                  THEN round_even(dollars_sold / number_sold * 100.0, 0) / 100.0 END AS unit_price
      FROM sales)
WHERE unit_price IS NOT NULL AND description IS NOT NULL AND cluster IS NOT NULL
GROUP BY description, cluster, unit_price""")
