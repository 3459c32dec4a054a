"""A stored store-level base for single-key reads and rankings.

The base is bucketed by property and sorted by period and product inside a
bucket, one file per bucket.  Everything that a store is ranked or asked for
needs only its own bucket: rankings run without an exchange, a property read
opens one file, and a period or product read skips the row groups whose range
does not hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "property_code"
ORDER = ["transaction_month", "description"]


def write_bucketed(base: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write ``base`` to ``path`` as the catalog table ``name`` and read it."""
    (base.repartition(buckets, KEY).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(*ORDER)
         .option("path", path).format("parquet").saveAsTable(name))
    return base.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, buckets: int) -> DataFrame:
    """Register a base that was written before (another session's catalog may not
    know it) and read it; ``schema`` in DDL."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({KEY}) "
              f"SORTED BY ({', '.join(ORDER)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
