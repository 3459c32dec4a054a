"""Stored sales levels (A1-A3) that are kept up to date by increments.

``base`` holds the store-level sums of ``sales_base``, ``cluster`` and
``national`` their roll-ups; each is a parquet folder partitioned by period.  An
increment is aggregated once; its partial sums are added to the stored ones, and
only partitions of periods it has rows for are rewritten.  All levels add the
increment's own roll-up, so no level is rolled up again from the one below.

An update is all or nothing and happens once per batch name: the new partitions
of all levels are written aside first, then a commit mark, then they are moved
into place.  An update that was cut off before its mark leaves no trace; one cut
off after it is finished by the next call.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.operators.sales import (CLUSTER_KEYS, NATIONAL_KEYS, cluster_product_sales,
                                        national_product_sales, sales_base)
from shelfsense.schemas import STORE_KEYS

PERIOD = "transaction_month"
LEVELS = {"base": (STORE_KEYS, "units"), "cluster": (CLUSTER_KEYS, "number_sold"), "national": (NATIONAL_KEYS, "number_sold")}


class Rollups:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ reading
    def read(self, level: str) -> DataFrame:
        """One level; periods are pruned as partitions."""
        keys, value = LEVELS[level]
        types = {k: "string" for k in keys} | {"cluster": "int", value: "long"}
        columns = [*keys, value]
        schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
        where = f"{self.folder}/{level}"
        if not self._fs.exists(self._path(where)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(where).select(*columns)

    def applied(self) -> list[str]:
        """Names of the batches that the levels hold, in name order."""
        return sorted(self._names("_applied"))

    # ----------------------------------------------------------- updating
    def update(self, sales: DataFrame, batch: str) -> bool:
        """Add the sales of a batch; false if they were added before."""
        self.recover()
        if batch in self._names("_applied"):
            return False
        staged = f"{self.folder}/_staged/{batch}"
        sales_base(sales).write.parquet(f"{staged}/increment")
        base = self.spark.read.parquet(f"{staged}/increment")
        increments = {"base": base, "cluster": cluster_product_sales(base), "national": national_product_sales(base)}
        periods = base.select(F.col(PERIOD).alias("_period")).distinct()
        for level, (keys, value) in LEVELS.items():
            stored = self.read(level)
            touched = stored.join(periods, F.col(PERIOD).eqNullSafe(F.col("_period")), "left_semi")
            added = increments[level].select(*[F.col(c).cast(stored.schema[c].dataType) for c in stored.columns])
            merged = touched.unionByName(added).groupBy(*keys).agg(F.sum(value).alias(value))
            merged.write.partitionBy(PERIOD).parquet(f"{staged}/{level}")
        self._mark("_commits", batch)
        self._finish(batch)
        return True

    def recover(self) -> None:
        """Finish committed updates and drop what uncommitted ones wrote."""
        for batch in self._names("_commits"):
            self._finish(batch)
        self._fs.delete(self._path(f"{self.folder}/_staged"), True)

    def _finish(self, batch: str) -> None:
        """Move a committed batch's partitions into place; may be run again."""
        for level in LEVELS:
            for status in self._fs.globStatus(self._path(f"{self.folder}/_staged/{batch}/{level}/{PERIOD}=*")) or []:
                new = status.getPath()
                old = self._path(f"{self.folder}/{level}/{new.getName()}")
                self._fs.mkdirs(old.getParent())
                self._fs.delete(old, True)
                if not self._fs.rename(new, old):
                    raise OSError(f"cannot move {new} into place")
        self._mark("_applied", batch)
        self._fs.delete(self._path(f"{self.folder}/_staged/{batch}"), True)
        self._fs.delete(self._path(f"{self.folder}/_commits/{batch}"), True)
        for level in LEVELS:
            self.spark.catalog.refreshByPath(f"{self.folder}/{level}")

    def _names(self, kind: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.globStatus(self._path(f"{self.folder}/{kind}/*")) or []]

    def _mark(self, kind: str, batch: str) -> None:
        self._fs.mkdirs(self._path(f"{self.folder}/{kind}"))
        self._fs.create(self._path(f"{self.folder}/{kind}/{batch}"), True).close()
