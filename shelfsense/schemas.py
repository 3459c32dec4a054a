"""Explicit schemas of the logical tables (see FIXTURES.md)."""

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

SALES = StructType([
    StructField("property_code", StringType()),
    StructField("cluster", IntegerType()),
    StructField("category_name", StringType()),
    StructField("description", StringType()),
    StructField("transaction_month", StringType()),
    StructField("number_sold", LongType()),
    StructField("dollars_sold", DoubleType()),
    StructField("flag_name", StringType()),
    StructField("city", StringType()),
    StructField("state", StringType()),
])

PROPERTIES = StructType([
    StructField("id", LongType()),
    StructField("property_code", StringType()),
    StructField("name", StringType()),
    StructField("address", StringType()),
    StructField("city", StringType()),
    StructField("state", StringType()),
    StructField("zip", StringType()),
    StructField("sales_tax_rate", DoubleType()),
    StructField("alcohol_tax_rate", DoubleType()),
    StructField("tobacco_tax_rate", DoubleType()),
    StructField("management_company_id", LongType()),
    StructField("flag_id", LongType()),
    StructField("brand_id", LongType()),
    StructField("kind", StringType()),
    StructField("guest_profile", StringType()),
    StructField("currency_id", IntegerType()),
    StructField("location_type", StringType()),
    StructField("rooms", IntegerType()),
])

BRANDS = StructType([StructField("id", LongType()), StructField("name", StringType())])

FLAGS = StructType([StructField("id", LongType()), StructField("name", StringType()),
                    StructField("brand_id", LongType())])

# Keys of the finest sales grain used by the recommender.
STORE_KEYS = ["cluster", "property_code", "category_name", "description", "transaction_month"]
