"""Lookups and choice lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def property_lookup(sales: DataFrame, city: str | None = None, state: str | None = None,
                    flag_name: str | None = None) -> DataFrame:
    """L1: property code, flag, city and state, optionally filtered,
    in the order of these columns."""
    d = sales.select("property_code", "flag_name", "city", "state")
    for c, v in (("city", city), ("state", state), ("flag_name", flag_name)):
        if v is not None:
            d = d.where(F.col(c) == F.lit(v))
    return d.distinct().orderBy("property_code", "flag_name", "city", "state")


def product_lookup(sales: DataFrame, category: str | None = None) -> DataFrame:
    """L2: category and product pairs, optionally one category, in their order."""
    d = sales.select("category_name", "description")
    if category is not None:
        d = d.where(F.col("category_name") == F.lit(category))
    return d.distinct().orderBy("category_name", "description")


# (dimension, column, descending, prepend an "any" choice)
DIMENSIONS = (
    ("property_code", "property_code", False, False),
    ("transaction_month", "transaction_month", True, False),
    ("category_name", "category_name", False, False),
    ("flag_name", "flag_name", False, True),
    ("city", "city", False, False),
    ("state", "state", False, True),
)


def dimension_values(sales: DataFrame) -> DataFrame:
    """L3: the ordered choice lists as (dimension, is_any, value), in order:
    distinct values ascending with nulls last, months descending with nulls
    first, and a leading "any" (null) for flags and states.

    One distributed distinct and one global sort: no dimension's list has to
    fit in one task.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), F.lit(False).alias("is_any"),
                               F.col(col).cast("string").alias("value")) for name, col, _, _ in DIMENSIONS])
    # one scan: every sale gives its (dimension, value) pairs; partial distinct
    found = sales.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    lead = [n for n, _, _, a in DIMENSIONS if a]
    # a list without values has no "any"
    some = found.where(F.col("dimension").isin(lead)).select("dimension").distinct().select(
        "dimension", F.lit(True).alias("is_any"), F.lit(None).cast("string").alias("value"))
    falling = F.col("dimension").isin([n for n, _, d, _ in DIMENSIONS if d])
    value = F.col("value")
    return found.unionByName(some).orderBy(
        "dimension", F.desc("is_any"),
        F.when(falling, value.isNotNull()).otherwise(value.isNull()),
        F.when(falling, value).desc(), F.when(~falling, value).asc())
