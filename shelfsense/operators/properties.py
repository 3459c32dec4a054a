"""Property source and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.functions import currency_code, zip_zone
from shelfsense.functions.salting import salted_join

DUMMY_COLS = ("kind", "guest_profile", "location_type", "currency", "flag_name", "zip")
NUMERIC_COLS = ("props_under_mgmt", "rooms")


def property_source(properties: DataFrame, brands: DataFrame, flags: DataFrame) -> DataFrame:
    """The 20-column property projection with its brand and flag
    (left joins, so a property without a match keeps null names).  Note the
    projected ``brand_id`` is the flag's brand, ``brand_name`` the property's."""
    p, b, f = properties.alias("p"), brands.alias("b"), flags.alias("f")
    j = (p.join(b, F.col("p.brand_id") == F.col("b.id"), "left")
          .join(f, F.col("p.flag_id") == F.col("f.id"), "left"))
    return j.select(
        F.col("p.id").alias("property_id"), "p.property_code", F.col("p.name").alias("property_name"),
        "p.address", "p.city", "p.state", "p.zip", "p.sales_tax_rate", "p.alcohol_tax_rate",
        "p.tobacco_tax_rate", "p.management_company_id", "p.flag_id",
        F.col("f.name").alias("flag_name"), F.col("f.brand_id").alias("brand_id"),
        F.col("b.name").alias("brand_name"), "p.kind", "p.guest_profile", "p.currency_id",
        "p.location_type", "p.rooms",
    )


def property_attributes(source: DataFrame, properties: DataFrame) -> DataFrame:
    """Currency code, zip zone, and the number of properties
    of the property's management company.  The count joins back with an inner
    join, so a property without a company is dropped.

    The count is a partial aggregate of the bare ``properties`` table (one row
    per company); the join splits a company's properties by their id, so one
    that holds a third of them does not land in one task.
    """
    props = (source.withColumn("currency", currency_code("currency_id"))
             .withColumn("zip", zip_zone("zip")))
    counts = (properties.where(F.col("management_company_id").isNotNull())
              .groupBy("management_company_id")
              .agg(F.count("*").alias("props_under_mgmt")))
    return salted_join(props, counts, ["management_company_id"], ["property_id"])


def property_dummies(attrs: DataFrame, columns: Sequence[str] = DUMMY_COLS) -> DataFrame:
    """one-hot features (property_id, feature ``{col}_{level}``, value 1);
    a column's first sorted level is dropped and a null value gives no row.
    Only the ones are emitted: a property has at most one per column."""
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]),
                     lambda x: x["level"].isNotNull())
    long = attrs.select("property_id", F.inline(cells))
    # one row per column
    first = long.groupBy("column").agg(F.min("level").alias("first"))
    return (long.join(F.broadcast(first), "column").where("level <> first")
            .select("property_id", F.concat_ws("_", "column", "level").alias("feature"), F.lit(1).alias("value")))


def property_features(attrs: DataFrame, columns: Sequence[str] = DUMMY_COLS) -> DataFrame:
    """Id, the unscaled numeric columns and the dummies, long
    (property_id, feature, value); an absent feature is 0."""
    numbers = attrs.select("property_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC_COLS]).unpivot(
        ["property_id"], list(NUMERIC_COLS), "feature", "value")
    return numbers.unionByName(property_dummies(attrs, columns).withColumn("value", F.col("value").cast("double")))
