"""The headline queries as plain single-statement Spark SQL over the same
tables, for ``bench.py`` to time beside the library's own versions.  They leave
out the library's null-key and literal-variant rules."""

_SALES = """
sales AS (
  SELECT s_name AS property, n_regionkey AS cluster, p_type AS category, p_name AS product,
         date_format(l_shipdate, 'yyyy') AS period, CAST(l_quantity AS BIGINT) AS units,
         rint(l_quantity * p_retailprice * (1 - l_discount)) / 100 AS dollars
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_TOP = """,
cl AS (SELECT cluster, category, product, period, sum(units) AS units FROM sales WHERE units > 0 GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY cluster, category, period ORDER BY units DESC, product) AS rank FROM cl),
top AS (SELECT *, sum(units) OVER (PARTITION BY cluster, category, period) AS total FROM cr WHERE rank <= 5)"""

_STORES = """,
st AS (SELECT cluster, property, category, product, period, sum(units) AS units FROM sales WHERE units > 0 GROUP BY ALL),
own AS (SELECT property, period, max(cluster) AS cluster FROM sales GROUP BY ALL)"""

_POINTS = """,
pts AS (SELECT product, price, avg(units) AS units, price * avg(units) AS revenue
        FROM (SELECT product, units, rint(dollars / units * 100) / 100 AS price FROM sales WHERE units <> 0)
        GROUP BY product, price),
b0 AS (SELECT *, rint(min(price) OVER (PARTITION BY product)) AS low, CAST(rint(price * 100) AS BIGINT) AS cents FROM pts),
bins AS (SELECT *, greatest(ceil((cents - CAST(low AS BIGINT) * 100) / 25), 0) AS bin FROM b0)"""

PLAIN = {
    "cluster_top": f"WITH {_SALES}{_TOP} SELECT *, rint(1000 * units / total) / 10 AS pct FROM top",
    "stocking_suggestions": f"""WITH {_SALES}{_TOP}{_STORES},
keys AS (SELECT DISTINCT s.property, s.category, s.period, o.cluster FROM st s JOIN own o USING (property, period))
SELECT k.*, t.rank, t.product FROM keys k JOIN top t USING (cluster, category, period)
LEFT ANTI JOIN st x ON x.property = k.property AND x.category = k.category AND x.period = k.period AND x.product = t.product""",
    "discontinue_suggestions": f"""WITH {_SALES}{_TOP}{_STORES},
r AS (SELECT property, category, period, product, units,
             sum(units) OVER (PARTITION BY property, category, period ORDER BY units DESC, product ROWS UNBOUNDED PRECEDING)
             / sum(units) OVER (PARTITION BY property, category, period) AS cum FROM st)
SELECT r.*, o.cluster FROM r JOIN own o USING (property, period)
LEFT ANTI JOIN top t ON t.cluster = o.cluster AND t.category = r.category AND t.period = r.period AND t.product = r.product
WHERE cum > 0.9""",
    "price_optimum": f"""WITH {_SALES}{_POINTS},
w AS (SELECT *, count(*) OVER p AS n, sum(bin) OVER p AS total, min(cents) OVER p AS lo, max(cents) OVER p AS hi
      FROM bins WINDOW p AS (PARTITION BY product)),
t AS (SELECT *, least(floor((cents - lo) * 10 / (hi - lo)), 9) AS ten FROM w WHERE hi > lo),
m AS (SELECT product, ten, median(revenue) AS rev, median(units) AS units FROM t GROUP BY product, ten),
best AS (SELECT product, min_by(low + 0.25 * bin, struct(abs(n * bin - total), price)) AS best_price FROM w GROUP BY product)
SELECT product, best_price, max(rev) AS best_revenue, max(units) AS best_sales FROM m JOIN best USING (product) GROUP BY ALL""",
    "price_box_stats": f"""WITH {_SALES}{_POINTS},
q AS (SELECT product, bin, percentile(units, array(0.25, 0.5, 0.75)) AS q FROM bins GROUP BY product, bin)
SELECT product, bin, q, count(*) AS n, min(CASE WHEN units >= q[0] - 1.5 * (q[2] - q[0]) THEN units END) AS lo,
       max(CASE WHEN units <= q[2] + 1.5 * (q[2] - q[0]) THEN units END) AS hi
FROM bins JOIN q USING (product, bin) GROUP BY product, bin, q""",
    "price_histogram": f"""WITH {_SALES}{_POINTS},
e AS (SELECT product, min(cents) AS lo, max(cents) AS hi, count(*) AS n FROM bins GROUP BY product HAVING count(*) >= 2),
h AS (SELECT product, least(floor((cents - lo) * 15 / (hi - lo)), 14) AS i, count(*) AS c
      FROM bins JOIN e USING (product) WHERE hi > lo GROUP BY ALL),
g AS (SELECT *, explode(sequence(0, 14)) AS i FROM e)
SELECT g.product, g.i, lo + (hi - lo) / 15 * g.i AS bin_low, coalesce(c, 0) AS c, coalesce(c, 0) / (n * (hi - lo) / 15) AS density
FROM g LEFT JOIN h ON g.product = h.product AND g.i = h.i""",
    "price_kde": f"""WITH {_SALES}{_POINTS},
s AS (SELECT product, count(*) AS n, min(price) AS lo, max(price) AS hi, stddev_pop(price) AS sp, stddev_samp(price) AS ss
      FROM pts GROUP BY product HAVING count(*) >= 2),
g AS (SELECT product, n, pow(n, -0.2) * ss AS h, lo - 3 * pow(n, -0.2) * sp AS a, hi + 3 * pow(n, -0.2) * sp AS b,
             explode(sequence(0, 99)) AS i FROM s)
SELECT product, i, a + i * (b - a) / 99 AS x,
       sum(exp(-0.5 * pow((a + i * (b - a) / 99 - price) / h, 2))) / (n * h * 2.5066282746310002) AS density
FROM g JOIN pts USING (product) GROUP BY product, i, a, b, n, h""",
}
