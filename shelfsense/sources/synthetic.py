"""Stand-in inputs built from the synthetic TPC-H-like tables.

The real sales and property data are not public, so the operators run on a
mapping of the driver's tables (see FIXTURES.md section 2):

* a store (property) is a ``supplier``, its flag/city/state are its region
  name, nation name and region name, and its stand-in cluster is the region;
* a product is a ``p_name`` inside category ``p_type``;
* one ``lineitem`` is one sale; the period is the ship year (``'yyyy'``) for
  the dense recommender queries or the ship month (``'yyyy-MM'``).

Dimension joins are plain equi-joins: Spark broadcasts a side whose file
size is below ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks the
real size at runtime, so small dimensions go out by broadcast and large ones
(``part`` and ``supplier`` at large scale) fall back to a shuffle join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIOD_FORMATS = {"year": "yyyy", "month": "yyyy-MM"}


def period_of(ts: str, period: str) -> F.Column:
    """``'yyyy'`` or ``'yyyy-MM'`` text of a (timezone-free) timestamp; years of
    four digits by arithmetic, which is much cheaper than the formatter."""
    year = F.year(ts)
    text = F.lpad(year.cast("string"), 4, "0")
    if period == "month":
        text = F.concat(text, F.lit("-"), F.lpad(F.month(ts).cast("string"), 2, "0"))
    return F.when(year.between(0, 9999), text).otherwise(F.date_format(ts, PERIOD_FORMATS[period]))


def _period_range(period: str, value: str) -> tuple[str, str]:
    """[start, end) timestamps of one ``'yyyy'`` or ``'yyyy-MM'`` period."""
    if period == "year":
        y = int(value)
        return f"{y:04d}-01-01 00:00:00", f"{y + 1:04d}-01-01 00:00:00"
    y, m = (int(x) for x in value.split("-"))
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"{y:04d}-{m:02d}-01 00:00:00", f"{ny:04d}-{nm:02d}-01 00:00:00"


def synthetic_sales(t: Mapping[str, DataFrame], period: str = "year",
                    period_value: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Wide sales fact, one row per lineitem (columns as in ``schemas.SALES``).

    A star join: every dimension joins the fact directly, so each join's
    build side is one base table whose size Spark checks against the
    broadcast threshold (joining the dimensions to each other first would
    make Spark estimate their join as a product and shuffle the fact).

    ``labels`` (property_code, cluster) replaces the stand-in cluster: it joins
    the store dimension before the star join (J8); a store without a label has
    a null cluster.
    """
    if period not in PERIOD_FORMATS:
        raise ValueError(f"period must be one of {sorted(PERIOD_FORMATS)}")
    li = t["lineitem"].select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    if period_value is not None:
        # one period only: a ship-date range the Parquet reader can use to
        # skip row groups (the period text itself is a derived column)
        lo, hi = _period_range(period, period_value)
        ts = F.col("l_shipdate")
        li = li.where((ts >= F.lit(lo).cast("timestamp_ntz")) & (ts < F.lit(hi).cast("timestamp_ntz")))
    part = t["part"].select("p_partkey", "p_type", "p_name", "p_retailprice")
    sup = t["supplier"].select("s_suppkey", "s_name", "s_nationkey")
    cluster = F.col("n_regionkey")
    if labels is not None:
        own = labels.select(F.col("property_code").alias("s_name"), F.col("cluster").alias("s_cluster"))
        sup, cluster = sup.join(own, "s_name", "left"), F.col("s_cluster")
    nation = t["nation"].select("n_nationkey", "n_name", "n_regionkey")
    region = t["region"].select("r_regionkey", "r_name")
    joined = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
                .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
                .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    return joined.select(
        F.col("s_name").alias("property_code"),
        cluster.alias("cluster"),
        F.col("p_type").alias("category_name"),
        F.col("p_name").alias("description"),
        period_of("l_shipdate", period).alias("transaction_month"),
        F.col("l_quantity").cast("bigint").alias("number_sold"),
        (F.rint(F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount"))) / 100)
        .alias("dollars_sold"),
        F.col("r_name").alias("flag_name"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
    )


def synthetic_brands(t: Mapping[str, DataFrame]) -> DataFrame:
    """``table2`` (brands): one per region."""
    return t["region"].select(F.col("r_regionkey").cast("long").alias("id"),
                              F.col("r_name").alias("name"))


def synthetic_flags(t: Mapping[str, DataFrame]) -> DataFrame:
    """``table3`` (flags): one per nation, its brand is the nation's region."""
    return t["nation"].select(F.col("n_nationkey").cast("long").alias("id"),
                              F.col("n_name").alias("name"),
                              F.col("n_regionkey").cast("long").alias("brand_id"))


def synthetic_properties(t: Mapping[str, DataFrame]) -> DataFrame:
    """``table1`` (properties): one per supplier, attribute rules of FIXTURES.md."""
    k = F.col("s_suppkey")
    nk = F.col("s_nationkey")
    nation = t["nation"].select("n_nationkey", "n_name", "n_regionkey")
    region = t["region"].select("r_regionkey", "r_name")
    s = (t["supplier"].select("s_suppkey", "s_name", "s_nationkey")
         .join(nation, nk == F.col("n_nationkey"), "left")
         .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    zip_code = (F.when(k % 10 == 9, F.lit("K1A 0B1"))
                 .when(k % 10 == 8, F.lit("80202-1234"))
                 .otherwise(F.lpad((k * 7919 % 100000).cast("string"), 5, "0")))
    return s.select(
        k.cast("long").alias("id"),
        F.col("s_name").alias("property_code"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Street "), k.cast("string")).alias("address"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        zip_code.alias("zip"),
        F.when(k % 4 == 0, F.lit(0.07)).cast("double").alias("sales_tax_rate"),
        F.when(k % 6 == 0, F.lit(0.1)).cast("double").alias("alcohol_tax_rate"),
        F.lit(None).cast("double").alias("tobacco_tax_rate"),
        F.when(k % 7 != 0, k % 7).cast("long").alias("management_company_id"),
        F.when(nk != 0, nk).cast("long").alias("flag_id"),
        (nk % 5).cast("long").alias("brand_id"),
        F.concat(F.lit("K"), (k % 3).cast("string")).alias("kind"),
        F.concat(F.lit("G"), (k % 4).cast("string")).alias("guest_profile"),
        F.when(nk % 5 == 1, 2).otherwise(1).cast("int").alias("currency_id"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("L"), (k % 5).cast("string"))).alias("location_type"),
        (F.lit(20) + k * 37 % 400).cast("int").alias("rooms"),
    )
