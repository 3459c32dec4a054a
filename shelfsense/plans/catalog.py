"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's parquet tables under ``sf_dir`` through the
stand-in mapping and runs one operator over all keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.functions import half_even
from shelfsense.functions.selection import exact_quantiles
from shelfsense.operators import clusters as C
from shelfsense.operators import lookups as L
from shelfsense.operators import pricing as P
from shelfsense.operators import properties as PR
from shelfsense.operators import recommend as R
from shelfsense.operators import sales as S
from shelfsense.plans.bucketed import write_bucketed
from shelfsense.plans.materialize import owned
from shelfsense.plans.rollups import Rollups
from shelfsense.schemas import STORE_KEYS
from shelfsense.sources import (load_tables, synthetic_brands, synthetic_flags,
                                synthetic_properties, synthetic_sales)
from shelfsense.sources.workspace import shared_folder

SALES_TABLES = ("lineitem", "part", "supplier", "nation", "region")
PROPERTY_TABLES = ("supplier", "nation", "region")
N = 5
TAIL = 0.10
# One month and one product for the single-key source filters.
SALES_MONTH = "1998-06"
SALES_PRODUCT = "red widget"
# One request of the report, and one city and state (flag) of the lookups.
REQUEST = ("Supplier#000000001", "STANDARD")
CITY, STATE = "NATION_8", "EUROPE"


def sales_of(spark: SparkSession, sf_dir: str, period: str = "year",
             period_value: str | None = None) -> DataFrame:
    return synthetic_sales(load_tables(spark, sf_dir, SALES_TABLES), period, period_value)


def base_of(spark: SparkSession, sf_dir: str, period: str = "year") -> DataFrame:
    return S.sales_base(sales_of(spark, sf_dir, period))


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.price_points(sales_of(spark, sf_dir))


def _on_points(fn, *args, **kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: fn(points_of(spark, d), *args, **kw)


def properties_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_properties(load_tables(spark, sf_dir, PROPERTY_TABLES))


def source_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir, PROPERTY_TABLES)
    return PR.property_source(synthetic_properties(t), synthetic_brands(t), synthetic_flags(t))


def attrs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.property_attributes(source_of(spark, sf_dir), properties_of(spark, sf_dir))


def tree_of(spark: SparkSession, sf_dir: str, max_k: int = C.MAX_K) -> C.Tree:
    return C.divisive_tree(PR.property_features(attrs_of(spark, sf_dir)), max_k)


def clusters_of(spark: SparkSession, sf_dir: str, k: int = C.DEFAULT_K) -> DataFrame:
    attrs = attrs_of(spark, sf_dir)
    return C.property_clusters(attrs, PR.property_features(attrs), k)


def fixed_clusters_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with a cluster label that is a column of the data, so what is
    built on labels can be compared with SQL."""
    return attrs_of(spark, sf_dir).withColumn("cluster", (F.col("property_id") % C.DEFAULT_K).cast("int"))


def clustered_sales_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = C.cluster_labels_by_code(fixed_clusters_of(spark, sf_dir))
    return synthetic_sales(load_tables(spark, sf_dir, SALES_TABLES), labels=labels)


def descriptions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(property_code, flag_name, city, state) of the stand-in properties."""
    t = load_tables(spark, sf_dir, PROPERTY_TABLES)
    nation = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    own = t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return S.described_properties(own.select(F.col("s_name").alias("property_code"), F.col("r_name").alias("flag_name"),
                                             F.col("n_name").alias("city"), F.col("r_name").alias("state")))


def requests_of(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    """One requested category per property, in every period it is present: the
    category of the part with the supplier's number."""
    t = load_tables(spark, sf_dir, ("supplier", "part"))
    asked = t["supplier"].join(t["part"], F.col("s_suppkey") == F.col("p_partkey")).select(
        F.col("s_name").alias("property_code"), F.col("p_type").alias("category_name"))
    return S.property_cluster(base).join(asked, "property_code").select(*S.STORE)


def _on_base(fn, *args) -> Callable[[SparkSession, str], DataFrame]:
    """Single-level query: aggregates straight from the raw sales."""
    return lambda spark, d: fn(sales_of(spark, d), *args)


def _on_shared_base(fn, *args, period: str = "year") -> Callable[[SparkSession, str], DataFrame]:
    """Composite query: the store-level base is computed once and every branch
    reads it."""
    return owned(lambda spark, d, keep: fn(keep(base_of(spark, d, period)), *args))


def _report(spark, d, keep):
    return R.recommendation_report(keep(R.by_store_period(base_of(spark, d))), descriptions_of(spark, d), N, TAIL, keep=keep)


def _requested_report(spark, d, keep):
    base = keep(R.by_store_period(base_of(spark, d, "month")))
    return R.recommendation_report(base, descriptions_of(spark, d), N, TAIL, requests_of(spark, d, base), keep)


def sales_quartiles(sales: DataFrame) -> DataFrame:
    """G6's quartiles over raw sales: dollars of a sale per category (groups of
    any size)."""
    found = exact_quantiles(sales, ["category_name"], "dollars_sold", (0.25, 0.5, 0.75))
    return found.select("category_name", "n", *[half_even(F.col("quantiles")[i], 6).alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def levels_by_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3 as stored levels after three increments, in the long form of
    ``sales_grouping_sets``.  A sale's increment is a hash of its values."""
    rollups = Rollups(spark, f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}")
    sales = sales_of(spark, sf_dir)
    for i in range(3):
        rollups.update(sales.where(F.pmod(F.xxhash64(*sales.columns), F.lit(3)) == i), f"part-{i}")
    whole = [S.store_product_sales(rollups.read("base")), rollups.read("cluster"), rollups.read("national")]
    none = {c: F.lit(None).cast(t) for c, t in (("cluster", "int"), ("property_code", "string"))}
    out = None
    for level, df in zip(("store", "cluster", "national"), whole):
        df = df.select(F.lit(level).alias("level"), *[F.col(c) if c in df.columns else none[c].alias(c) for c in STORE_KEYS], "number_sold")
        out = df if out is None else out.unionByName(df)
    return out


def ranking_from_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 over a base stored in buckets of properties: no exchange."""
    name = f"sales_base_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return S.store_ranking(write_bucketed(base_of(spark, sf_dir), name, f"{shared_folder(spark)}/{name}", buckets))


def _city_report(spark, d, keep):
    """The first store of every city asks for one category and month: a few
    requests, for which only their rows are aggregated."""
    t = load_tables(spark, d, ("supplier",))
    asked = t["supplier"].groupBy("s_nationkey").agg(F.min("s_name").alias("property_code")).select(
        "property_code", F.lit(REQUEST[1]).alias("category_name"), F.lit(SALES_MONTH).alias("transaction_month"))
    base = keep(R.needed_rows(base_of(spark, d, "month"), asked))
    return R.recommendation_report(base, descriptions_of(spark, d), N, TAIL, asked, keep)


def _no_sales(base: DataFrame) -> DataFrame:
    found = R.no_sales_categories(base)
    return found.withColumn("n_categories", F.size("categories")).withColumn("categories", F.array_join("categories", "|"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "store_product_sales": _on_base(S.store_product_sales),
    "cluster_product_sales": _on_base(S.cluster_product_sales),
    "national_product_sales": _on_base(S.national_product_sales),
    "sales_grouping_sets": lambda spark, d: S.sales_grouping_sets(sales_of(spark, d)),
    "property_cluster": lambda spark, d: S.property_cluster_description(sales_of(spark, d)),
    "store_ranking": _on_base(S.store_ranking),
    "store_ranking_bucketed": ranking_from_buckets,
    "sales_levels_incremental": levels_by_increments,
    "store_top": _on_base(S.store_top, N),
    "cluster_top": _on_base(S.cluster_top, N),
    "national_top": _on_base(S.national_top, N),
    "stocking_suggestions": _on_shared_base(R.stocking_suggestions, N),
    "discontinue_suggestions": _on_shared_base(R.discontinue_suggestions, N, TAIL),
    "already_stocking_top": _on_shared_base(R.already_stocking_top, N),
    "no_sales_categories": _on_shared_base(_no_sales, period="month"),
    "recommendation_report": owned(_report),
    "recommendation_report_requests": owned(_requested_report),
    "recommendation_report_cities": owned(_city_report),
    "recommendation_report_one": lambda spark, d: R.recommendation_report_for(
        sales_of(spark, d, "month", SALES_MONTH), descriptions_of(spark, d), *REQUEST, SALES_MONTH, N, TAIL),
    "sales_by_month": lambda spark, d: S.sales_by_month(
        sales_of(spark, d, "month", period_value=SALES_MONTH), SALES_MONTH),
    "sales_by_product": lambda spark, d: S.sales_by_product(sales_of(spark, d), SALES_PRODUCT),
    "price_points": lambda spark, d: points_of(spark, d),
    "price_points_by_cluster": lambda spark, d: P.price_points(
        sales_of(spark, d), keys=("description", "cluster")),
    "price_points_filtered": lambda spark, d: P.price_points(
        sales_of(spark, d), description=SALES_PRODUCT, cluster=0, month="1998"),
    "price_bins": _on_points(P.price_bins),
    "price_fit": _on_points(P.price_fit),
    "price_optimum": _on_points(P.price_optimum),
    "price_binned_median": _on_points(P.price_binned_median),
    "price_box_stats": _on_points(P.price_box_stats, "number_sold"),
    "price_box_stats_revenue": _on_points(P.price_box_stats, "revenue"),
    "price_strip_points": _on_points(P.price_strip_points),
    "price_fit_curve": owned(lambda spark, d, keep: P.price_fit_curve(keep(points_of(spark, d)))),
    "price_histogram": _on_points(P.price_histogram, ("unit_price",)),
    "price_histogram_all": _on_points(P.price_histogram, ("unit_price", "number_sold", "revenue")),
    "price_kde": _on_points(P.price_kde, ("unit_price",)),
    "price_kde_all": _on_points(P.price_kde, ("unit_price", "number_sold", "revenue")),
    "price_kde_binned": _on_points(P.price_kde, ("unit_price",), method="binned"),
    "price_curve": _on_points(P.price_curve),
    "price_smooth_curve": _on_points(P.price_smooth_curve),
    "sales_quartiles": lambda spark, d: sales_quartiles(sales_of(spark, d)),
    "price_summary": _on_points(P.price_summary),
    "property_source": lambda spark, d: source_of(spark, d),
    "props_under_mgmt": lambda spark, d: attrs_of(spark, d),
    "property_dummies": lambda spark, d: PR.property_dummies(attrs_of(spark, d)),
    "property_features": lambda spark, d: PR.property_features(attrs_of(spark, d)),
    "property_clusters": lambda spark, d: clusters_of(spark, d),
    "cut_clusters": lambda spark, d: clusters_of(spark, d, 5),
    "cluster_merge_history": lambda spark, d: C.merge_history(tree_of(spark, d)),
    "cluster_cuts": lambda spark, d: C.cut(tree_of(spark, d), list(range(1, C.MAX_K + 1))),
    "cluster_profile": lambda spark, d: C.cluster_profile(
        fixed_clusters_of(spark, d), PR.property_features(attrs_of(spark, d))),
    "clustered_sales": clustered_sales_of,
    "clustered_stocking_suggestions": owned(lambda spark, d, keep: R.stocking_suggestions(
        keep(S.sales_base(clustered_sales_of(spark, d))), N)),
    "property_lookup": lambda spark, d: L.property_lookup(sales_of(spark, d)),
    "property_lookup_filtered": lambda spark, d: L.property_lookup(sales_of(spark, d), city=CITY, state=STATE, flag_name=STATE),
    "product_lookup": lambda spark, d: L.product_lookup(sales_of(spark, d)),
    "product_lookup_filtered": lambda spark, d: L.product_lookup(sales_of(spark, d), REQUEST[1]),
    "dimension_values": lambda spark, d: L.dimension_values(sales_of(spark, d, "month")),
}
