"""Sales aggregates and rankings.

Plan shape.  ``sales_base`` is the only aggregate over raw sales rows: one
row per (cluster, property, category, product, period) with the sum of the
*positive* unit counts.  It keeps null keys and groups whose units are all
non-positive, so every other level is a roll-up of it (sums compose) and the
property attributes (J7, A14) come from it too.  Composites keep the base as
a shared intermediate (``plans.materialize``); partial aggregation before its
exchange means a hot store or product never sends more than one row per group
and map task.

Null keys vanish per level (as a pandas ``groupby`` drops them): a sale with
a null cluster is out of the store and cluster levels but counts nationally.

Ties.  Rank order is units descending, then the remaining group keys
ascending (cluster, then description), which is the order a stable sort of
the key-sorted groups gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions import half_even
from shelfsense.schemas import STORE_KEYS

STORE = ["property_code", "category_name", "transaction_month"]
CLUSTER_KEYS = ["cluster", "category_name", "description", "transaction_month"]
NATIONAL_KEYS = ["category_name", "description", "transaction_month"]


def sales_base(sales: DataFrame) -> DataFrame:
    """Finest grain; ``units`` is null when no row of the group sold > 0.

    Only fixed-width aggregate buffers, so Spark plans a hash aggregate with
    a map-side partial step (a string or struct min would force a sort).
    """
    pos = F.when(F.col("number_sold") > 0, F.col("number_sold"))
    return sales.groupBy(*STORE_KEYS).agg(F.sum(pos).alias("units"))


def _units(df: DataFrame) -> F.Column:
    """Positive units of a row: ``units`` of a base row, or ``number_sold``
    of a raw sales row when it is > 0 (null otherwise)."""
    if "units" in df.columns:
        return F.col("units")
    return F.when(F.col("number_sold") > 0, F.col("number_sold"))


def _positive(src: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with positive units and no null key, with the units as ``units``.

    On raw sales the test is ``number_sold > 0`` itself, a predicate the
    Parquet reader evaluates while scanning.
    """
    if "units" in src.columns:
        cond = F.col("units").isNotNull()
    else:
        cond = F.col("number_sold") > 0
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return src.where(cond).withColumn("units", _units(src))


def store_product_sales(src: DataFrame) -> DataFrame:
    """A1: units by (cluster, property, category, product, period), from raw
    sales or from a base."""
    if "units" in src.columns:
        return _positive(src, STORE_KEYS).select(*STORE_KEYS, F.col("units").alias("number_sold"))
    return (_positive(src, STORE_KEYS).groupBy(*STORE_KEYS)
            .agg(F.sum("units").alias("number_sold")))


def cluster_product_sales(base: DataFrame) -> DataFrame:
    """A2: units by (cluster, category, product, period), from raw sales
    (partial aggregation shrinks the rows before the shuffle) or rolled up
    from a base."""
    return (_positive(base, CLUSTER_KEYS).groupBy(*CLUSTER_KEYS)
            .agg(F.sum("units").alias("number_sold")))


def national_product_sales(base: DataFrame) -> DataFrame:
    """A3: units by (category, product, period), from raw sales or a base."""
    return (_positive(base, NATIONAL_KEYS).groupBy(*NATIONAL_KEYS)
            .agg(F.sum("units").alias("number_sold")))


def sales_grouping_sets(sales: DataFrame) -> DataFrame:
    """A1-A3 in one pass with GROUPING SETS over the store-level aggregate (so
    its rows, not the raw sales, are tripled); ``level`` is
    store/cluster/national.

    A key that is really null is told apart from a rolled-up one with
    ``grouping()``, and rows with a real null key are dropped per level.
    """
    pos = sales_base(sales.where(F.col("number_sold") > 0))
    g = pos.groupingSets(
        [STORE_KEYS, CLUSTER_KEYS, NATIONAL_KEYS], *STORE_KEYS,
    ).agg(F.sum("units").alias("number_sold"),
          F.grouping("cluster").alias("g_cluster"),
          F.grouping("property_code").alias("g_property"))
    level = (F.when(F.col("g_cluster") == 1, F.lit("national"))
              .when(F.col("g_property") == 1, F.lit("cluster"))
              .otherwise(F.lit("store")))
    g = g.withColumn("level", level)
    keep = (F.col("category_name").isNotNull() & F.col("description").isNotNull()
            & F.col("transaction_month").isNotNull()
            & ((F.col("level") == "national") | F.col("cluster").isNotNull())
            & ((F.col("level") != "store") | F.col("property_code").isNotNull()))
    return g.where(keep).select("level", *STORE_KEYS, "number_sold")


def property_cluster(base: DataFrame) -> DataFrame:
    """Per (property, period) its cluster: the max over all its rows
    (any category, any units), nulls ignored."""
    return (base.where(F.col("property_code").isNotNull() & F.col("transaction_month").isNotNull())
            .groupBy("property_code", "transaction_month")
            .agg(F.max("cluster").alias("cluster")))


def property_descriptions(sales: DataFrame) -> DataFrame:
    """Per (property, period) one deterministic description, the
    smallest (flag_name, city, state) among its rows.

    Distinct triples first (hash aggregate, partial before the shuffle), then
    the smallest per property over that small set.
    """
    d = (sales.where(F.col("property_code").isNotNull() & F.col("transaction_month").isNotNull())
         .select("property_code", "transaction_month", "flag_name", "city", "state").distinct())
    w = Window.partitionBy("property_code", "transaction_month").orderBy("flag_name", "city", "state")
    return (d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r"))


def described_properties(properties: DataFrame) -> DataFrame:
    """A14 from a property dimension: (property_code, flag_name, city, state),
    the smallest triple of each code."""
    triple = F.struct("flag_name", "city", "state")
    return (properties.where(F.col("property_code").isNotNull()).groupBy("property_code")
            .agg(F.min(triple).alias("d")).select("property_code", "d.*"))


def property_cluster_description(sales: DataFrame) -> DataFrame:
    """J7 + A14 in one pass over sales: (property, period, cluster, flag_name,
    city, state).  Distinct attribute triples per property-period carry the
    max cluster of their rows; the property's cluster is the max over them and
    its description the smallest triple."""
    d = (sales.where(F.col("property_code").isNotNull() & F.col("transaction_month").isNotNull())
         .groupBy("property_code", "transaction_month", "flag_name", "city", "state")
         .agg(F.max("cluster").alias("_c")))
    w = Window.partitionBy("property_code", "transaction_month")
    d = (d.withColumn("cluster", F.max("_c").over(w))
          .withColumn("_r", F.row_number().over(w.orderBy("flag_name", "city", "state"))))
    return d.where(F.col("_r") == 1).select("property_code", "transaction_month", "cluster",
                                            "flag_name", "city", "state")


def store_ranking(base: DataFrame) -> DataFrame:
    """R1 (W1-W3): every product of every store-category-period with its share
    of the store's category total, cumulative share and rank.

    Share and cumulative share are integer sums divided once, so they do not
    depend on summation order.
    """
    s = store_product_sales(base)
    # sorted by store and period first: a join on these needs no other order
    w = Window.partitionBy("property_code", "transaction_month", "category_name").orderBy(F.desc("number_sold"), "cluster", "description")
    running = F.sum("number_sold").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("number_sold").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = (s.withColumn("rank", F.row_number().over(w))
          .withColumn("total_sold", total)
          .withColumn("running_sold", running))
    return r.select(
        "cluster", *STORE, "rank", "description", "number_sold", "total_sold",
        (F.col("number_sold") / F.col("total_sold")).alias("pct_of_sold"),
        (F.col("running_sold") / F.col("total_sold")).alias("cum_pct"),
        half_even(F.lit(100) * (F.col("number_sold") / F.col("total_sold")), 1).alias("pct"),
    )


def store_top(base: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` rows of ``store_ranking`` per store-category-period."""
    return store_ranking(base).where(F.col("rank") <= n)


def _top_n(level: DataFrame, part: list[str], n: int) -> DataFrame:
    """W4 + W5: top ``n`` by units (ties by description), share of the top-n total.

    ``row_number() <= n`` lets Spark insert a partial ``WindowGroupLimit``
    before the exchange, so each map task ships at most n rows per group.
    """
    w = Window.partitionBy(*part).orderBy(F.desc("number_sold"), "description")
    top = level.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    tot = F.sum("number_sold").over(Window.partitionBy(*part))
    top = top.withColumn("total_top_sold", tot)
    return top.select(
        *part, "rank", "description", "number_sold", "total_top_sold",
        half_even(F.lit(100) * F.col("number_sold") / F.col("total_top_sold"), 1).alias("pct"),
    )


def cluster_top(base: DataFrame, n: int = 5) -> DataFrame:
    """R2: top ``n`` products per (cluster, category, period)."""
    return _top_n(cluster_product_sales(base), ["cluster", "category_name", "transaction_month"], n)


def national_top(base: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` products per (category, period)."""
    return _top_n(national_product_sales(base), ["category_name", "transaction_month"], n)


def clustered_sales(sales: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace the sales' cluster with a property's cluster label.

    ``labels`` has (property_code, cluster), one row per property; a property
    without a label gets a null cluster (left join).  Where sales come from a
    star join, label its property dimension instead (``synthetic_sales``): the
    fact is then not shuffled once more.
    """
    lab = labels.select("property_code", F.col("cluster").alias("_label"))
    return (sales.join(lab, "property_code", "left")
            .withColumn("cluster", F.col("_label")).drop("_label")
            .select(*sales.columns))


def sales_by_month(sales: DataFrame, month: str) -> DataFrame:
    """S3: the sales of one period; a pushed-down filter (and partition
    pruning when the table is written ``partitionBy('transaction_month')``)."""
    return sales.where(F.col("transaction_month") == F.lit(month))


def sales_by_product(sales: DataFrame, description: str) -> DataFrame:
    """The sales of one product (a column predicate, not spliced SQL text)."""
    return sales.where(F.col("description") == F.lit(description))
