"""Recommender composites.

All of them answer every store-category-period at once.  The cluster's top-n
list numbers its products (bit ``rank - 1``), and what a store sells of it is a
bitmap: store products meet the list by product, and a ``bit_or`` per store,
which is combined map-side, gives the bitmap.  Products to add are the list's
bits that the store's bitmap lacks; no store row carries a list of names.

The joins that attach a cluster's or the nation's list to each store have few
and heavy keys (cluster, category, period).  A list has at most ``n`` entries a
key, and the number of keys does not grow with stores or sales.  Where store
products meet the lists, and in the report, the lists are therefore broadcast, so
store products stay where they are; elsewhere the list side is repeated over
salts and the store side is split by a hash of the store (``functions.salting``):
if Spark shuffles it, no task gets a whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions import pct_text
from shelfsense.functions.bloom import bloom_filter, might_hold
from shelfsense.functions.salting import salted_join
from shelfsense.operators.sales import (STORE, cluster_top, national_product_sales,
                                        national_top, property_cluster, sales_base,
                                        store_product_sales, store_ranking)

TOP_KEYS = ["cluster", "category_name", "transaction_month"]
NATION_KEYS = ["category_name", "transaction_month"]
PERIOD_KEYS = ["property_code", "transaction_month"]
ENTRIES = "array<struct<rank:int,description:string,pct:double>>"
LINES_TYPE = "array<struct<section:int,seq:int,is_header:int,text:string>>"


def _top_lists(top: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key its top-n products as an array in rank order (at most n entries)."""
    entry = F.struct("rank", "description", "pct")
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(name))


#: Bits of a bitmap's words (the sign bit is left alone).
WORD = 63


def _masks(rank: str, n: int) -> F.Column:
    """Aggregate: the bitmap of the ranks of a group, as an array of words."""
    place = F.col(rank) - 1
    word = lambda w: F.bit_or(F.when(F.floor(place / WORD) == w, F.call_function(
        "shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int"))))
    return F.array(*[F.coalesce(word(w), F.lit(0).cast("long")) for w in range(-(-n // WORD))])


def _lacks(masks: str, rank: F.Column) -> F.Column:
    """Whether a bitmap lacks a rank."""
    place = rank - 1
    return F.getbit(F.col(masks)[F.floor(place / WORD).cast("int")], (place % WORD).cast("int")) == 0


def _with_top_rank(store_products: DataFrame, top: DataFrame) -> DataFrame:
    """Store products (STORE, cluster, description) with their rank in the
    cluster's list as ``ct_rank``, null outside it."""
    listed = top.select(*TOP_KEYS, "description", F.col("rank").alias("ct_rank"))
    return store_products.join(F.broadcast(listed), [*TOP_KEYS, "description"], "left")


def _store_products(base: DataFrame) -> DataFrame:
    """Products sold per store-category-period, with the store's cluster of the
    period."""
    return (store_product_sales(base).select(*STORE, "description")
            .join(property_cluster(base), PERIOD_KEYS))


def _store_masks(base: DataFrame, top: DataFrame, n: int) -> DataFrame:
    """(STORE, cluster, masks): what every store-category-period sells of its
    cluster's list."""
    met = _with_top_rank(_store_products(base), top)
    return met.groupBy(*STORE, "cluster").agg(_masks("ct_rank", n).alias("masks"))


def stocking_suggestions(base: DataFrame, n: int = 5) -> DataFrame:
    """R4 (J6): products in the store's cluster top ``n`` that the store did not
    sell (no positive units) in that category and period, in cluster-rank order."""
    top = cluster_top(base, n)
    met = salted_join(_store_masks(base, top, n), top.select(*TOP_KEYS, "rank", "description"), TOP_KEYS, ["property_code"])
    return met.where(_lacks("masks", F.col("rank"))).select(
        *STORE, "cluster", F.col("rank").alias("cluster_rank"), "description")


def discontinue_suggestions(base: DataFrame, n: int = 5, tail: float = 0.10) -> DataFrame:
    """R5 (J5, W6): store products outside the cluster top ``n`` whose cumulative
    share (units descending, current row included) is above ``1 - tail``.  The
    product that crosses the line is included."""
    ranked = (store_ranking(base).where(F.col("cum_pct") > F.lit(1.0 - tail)).drop("cluster")
              .join(property_cluster(base), PERIOD_KEYS))
    out = salted_join(ranked, cluster_top(base, n).select(*TOP_KEYS, "description"), [*TOP_KEYS, "description"],
                      ["property_code"], "left_anti")
    return out.select(*STORE, "cluster", "rank", "description", "number_sold", "pct", "cum_pct")


def already_stocking_top(base: DataFrame, n: int = 5) -> DataFrame:
    """Store-category-periods that sell every product of their cluster top ``n``."""
    top = cluster_top(base, n)
    lists = top.groupBy(*TOP_KEYS).agg(_masks("rank", n).alias("list_masks"))
    met = salted_join(_store_masks(base, top, n), lists, TOP_KEYS, ["property_code"], "left")
    held = F.zip_with("masks", F.coalesce("list_masks", "masks"), lambda own, listed: own.bitwiseAND(listed) == listed)
    return met.where(F.forall(held, lambda x: x)).select(*STORE, "cluster")


def no_sales_categories(base: DataFrame) -> DataFrame:
    """R7 (J9): per property present in a period (any sale row), the categories
    sold nationally in that period of which the property sold nothing (> 0):
    (property_code, transaction_month, cluster, categories in order).

    One row per property and period; both category sets are bounded by the
    number of categories, and a period's list is repeated over salts.
    """
    nation = (national_product_sales(base).groupBy("transaction_month")
              .agg(F.collect_set("category_name").alias("all")))
    own = (store_product_sales(base).groupBy(*PERIOD_KEYS)
           .agg(F.collect_set("category_name").alias("own")))
    present = property_cluster(base).join(own, PERIOD_KEYS, "left")
    met = salted_join(present, nation, ["transaction_month"], ["property_code"])
    left = F.array_sort(F.array_except("all", F.coalesce("own", F.array().cast("array<string>"))))
    return (met.select(*PERIOD_KEYS, "cluster", left.alias("categories"))
            .where(F.size("categories") > 0))


def _line(section, seq, is_header, text) -> F.Column:
    return F.struct(F.lit(section).cast("int").alias("section"), seq.cast("int").alias("seq"),
                    F.lit(is_header).cast("int").alias("is_header"), text.alias("text"))


def _num(c) -> F.Column:
    return c.cast("string")


def _top_items(entries: str, section: int) -> F.Column:
    """The lines of a list of top products."""
    return F.transform(entries, lambda x: _line(section, x["rank"], 0, F.concat(
        _num(x["rank"]), F.lit(". "), x["description"], F.lit(": "), pct_text(x["pct"]), F.lit("%"))))


def by_store_period(base: DataFrame) -> DataFrame:
    """A store-level base whose rows of a store and period stand together, for a
    report of all keys or of very many requests (``recommendation_report``)."""
    return base.repartition(*PERIOD_KEYS)


def needed_rows(base: DataFrame, requests: DataFrame) -> DataFrame:
    """What a report of ``requests`` reads of a store-level base: the rows of a
    requested category and period (all lists) and of a requested store and period
    (its cluster).  Both tests are Bloom filters of fixed size over the requests;
    as they look at keys only, they are applied below the base's aggregate where
    the base is not cached yet.  Some other rows pass too; the report does not
    show them."""
    lists, stores = (bloom_filter(requests, keys).scalar() for keys in (NATION_KEYS, PERIOD_KEYS))
    return base.where(might_hold(lists, NATION_KEYS) | might_hold(stores, PERIOD_KEYS))


def recommendation_report(base: DataFrame, descriptions: DataFrame, n: int = 5, tail: float = 0.10,
                          requests: DataFrame | None = None, keep=None) -> DataFrame:
    """The recommendation, one row per line: (property_code, category_name,
    transaction_month, section, seq, is_header, text).  ``seq`` 0 is a
    section's header line; items count from 1.

    Sections: 0 store header; 1 store top n (or "No products sold"); 2 cluster
    top n; 3 national top n; 4 "already" line or stocking suggestions;
    5 discontinue suggestions (only when there are any).

    Without ``requests`` every store-category-period with sales is reported;
    ``requests`` (property_code, category_name, transaction_month) restricts
    the report to its keys and adds those without sales, whose category sold
    nationally.  ``descriptions``: (property_code, flag_name, city, state).
    ``keep`` (``Shared.keep``) marks what both branches read.

    A base that is spread by store and period (``by_store_period``) is not
    shuffled again per store product: ranking, cluster of the store, requests and
    what the store sells of a list are all found where its rows are.

    * Branch A, per store product: the store's top-n lines and the discontinue
      lines, numbered by a running count over these products.
    * Branch B, per store-category-period: headers, the lines of the lists of at
      most ``n`` entries (made once per list), and the stocking suggestions.
    """
    keep = keep or (lambda df: df)
    pc = property_cluster(base)
    reported = base
    if requests is not None:
        pc = keep(pc)
        # a store and period has at most one entry a category here
        asked = keep(requests.groupBy(*PERIOD_KEYS).agg(F.collect_set("category_name").alias("asked")))
        reported = base.join(asked, PERIOD_KEYS).where(F.array_contains("asked", F.col("category_name"))).drop("asked")
    top = cluster_top(base, n)
    ct_lists = _top_lists(top, TOP_KEYS, "ct_list")
    ct_lists = keep(ct_lists.withColumn("ct_lines", _top_items("ct_list", 2)))
    nt_lists = _top_lists(national_top(base, n), NATION_KEYS, "nt_list")
    nt_lists = keep(nt_lists.select(*NATION_KEYS, _top_items("nt_list", 3).alias("nt_lines")))
    # both branches read the store products with their rank in the cluster's list
    ranking = _with_top_rank(store_ranking(reported).drop("cluster").join(pc, PERIOD_KEYS), top)
    ranking = keep(ranking.select(
        *STORE, "cluster", "rank", "description", "number_sold", "pct", "ct_rank",
        ((F.col("cum_pct") > F.lit(1.0 - tail)) & F.col("ct_rank").isNull()).alias("cand")))

    # -- branch A: lines per store product
    cand = F.col("cand")
    a = ranking.where(cand | (F.col("rank") <= n))
    w = Window.partitionBy(*STORE).orderBy("rank").rowsBetween(Window.unboundedPreceding,
                                                               Window.currentRow)
    a = a.withColumn("rm_seq", F.sum(cand.cast("int")).over(w))
    units_pct = F.concat(F.col("description"), F.lit(": "), _num(F.col("number_sold")),
                         F.lit(" units, "), pct_text("pct"), F.lit("%"))
    lines_a = F.array(
        F.when(F.col("rank") <= n, _line(1, F.col("rank"), 0,
                                         F.concat(_num(F.col("rank")), F.lit(". "), units_pct))),
        F.when(cand & (F.col("rm_seq") == 1),
               _line(5, F.lit(0), 1, F.lit("Consider discontinue stocking:"))),
        F.when(cand, _line(5, F.col("rm_seq"), 0,
                           F.concat(_num(F.col("rm_seq")), F.lit(". "), units_pct))),
    )
    part_a = a.select(*STORE, F.explode(lines_a).alias("l")).where("l is not null")

    # -- branch B: lines per store-category-period
    sold = ranking.groupBy(*STORE, "cluster").agg(_masks("ct_rank", n).alias("masks"))
    keys = sold.withColumn("has_sales", F.lit(True))
    if requests is not None:
        own = sold.groupBy(*PERIOD_KEYS).agg(F.collect_set("category_name").alias("own"))
        bare = asked.join(own, PERIOD_KEYS, "left").select(*PERIOD_KEYS, F.explode(F.array_except(
            "asked", F.coalesce("own", F.array().cast("array<string>")))).alias("category_name"))
        keys = keys.unionByName(bare.join(pc, PERIOD_KEYS).select(
            *STORE, "cluster", F.array().cast("array<bigint>").alias("masks"), F.lit(False).alias("has_sales")))
    kb = (keys.join(descriptions, "property_code").join(F.broadcast(ct_lists), TOP_KEYS, "left")
          .join(F.broadcast(nt_lists), NATION_KEYS, "left"))
    # without sales: only a category that sold nationally
    kb = kb.where(F.col("has_sales") | F.col("nt_lines").isNotNull())
    kb = kb.withColumn("adds", F.when(F.col("has_sales"), F.filter(
        F.coalesce("ct_list", F.array().cast(ENTRIES)), lambda x: _lacks("masks", x["rank"]))))
    has = F.col("has_sales")
    cat = F.col("category_name")
    cl_txt = F.coalesce(F.col("cluster").cast("string"), F.lit("nan"))

    adds = F.col("adds")
    add_items = F.transform(adds, lambda x, i: _line(4, i + 1, 0, F.concat(
        _num(i + 1), F.lit(". "), x["description"])))
    header = F.concat(F.lit("For store #"), F.col("property_code"), F.lit(", "),
                      F.coalesce("flag_name", F.lit("None")), F.lit(", "),
                      F.coalesce("city", F.lit("None")), F.lit(", "),
                      F.coalesce("state", F.lit("None")), F.lit(", for "),
                      F.col("transaction_month"), F.lit(", part of Cluster ("), cl_txt, F.lit(")"))
    heads = F.array(
        _line(0, F.lit(0), 1, header),
        _line(1, F.lit(0), 1, F.when(has, F.concat(F.lit("Your top products in "), cat, F.lit(":")))
              .otherwise(F.concat(F.lit("No products sold in "), cat))),
        _line(2, F.lit(0), 1, F.concat(F.lit("Cluster ("), cl_txt, F.lit(") top products:"))),
        _line(3, F.lit(0), 1, F.when(has, F.lit("National top product:"))
              .otherwise(F.concat(F.lit("National top products in "), cat, F.lit(":")))),
    )
    stock = F.when(has, F.concat(
        F.array(_line(4, F.lit(0), 1, F.when(F.size(adds) == 0,
                                              F.lit("You are selling the top products already!"))
                      .otherwise(F.lit("Stocking suggestions:")))),
        add_items))
    no_lines = F.array().cast(LINES_TYPE)
    all_b = F.concat(heads, *[F.coalesce(c, no_lines) for c in (F.col("ct_lines"), F.col("nt_lines"), stock)])
    part_b = kb.select(*STORE, F.explode(all_b).alias("l"))

    out = part_a.unionByName(part_b)
    return out.select(*STORE, "l.section", "l.seq", "l.is_header", "l.text")


def recommendation_report_for(sales, descriptions, property_code: str, category: str, month: str,
                              n: int = 5, tail: float = 0.10) -> DataFrame:
    """The reference's single-request form: the report of one store, category
    and period, computed on the sales of that period (the app's scope)."""
    read = (F.col("category_name") == category) | (F.col("property_code") == property_code)
    base = sales_base(sales.where((F.col("transaction_month") == month) & read))
    one = base.sparkSession.createDataFrame(
        [(property_code, category, month)], "property_code string, category_name string, transaction_month string")
    return recommendation_report(base, descriptions, n, tail, one).orderBy("section", "seq")
