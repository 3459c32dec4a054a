"""Exact quantiles of groups of any size, by counting.

A percentile aggregate holds a group's distinct values in one buffer.  Here a
group is narrowed instead: its range is cut into equal buckets, the buckets are
counted (partial counts per map task, so a group that holds half of all rows is
spread over the tasks), and only the bucket that holds a wanted rank is cut
again.  After ``PASSES`` passes what is left of a rank's bucket is sorted, unless
it is a single value by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions.salting import salted_join

BUCKETS = 2048
PASSES = 2


def _bucket(lo: str, hi: str) -> F.Column:
    """Bucket of ``v`` in [lo, hi]; never falls as ``v`` rises."""
    share = F.col("v") / 2 - F.col(lo) / 2  # halves, so that the difference of extremes is finite
    width = F.col(hi) / 2 - F.col(lo) / 2
    return F.when(width > 0, F.least(F.floor(F.least(share / width, F.lit(1.0)) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    passes: int = PASSES) -> DataFrame:
    """(keys, n, quantiles): per group the number of non-null values and their
    exact quantiles with linear interpolation, as ``percentile`` gives them.

    Null values do not count, a group without any is left out; null keys are a
    group.  NaN and infinite values have no place in a range and are refused by
    an error.  ``df`` is read ``passes + 2`` times.
    """
    keys = list(keys)
    k = [f"_k{i}" for i in range(len(keys))]
    # null keys as a struct field, so that joins on keys meet
    rows = df.where(F.col(value).isNotNull()).select(
        *[F.struct(F.col(c).isNull().alias("null"), F.col(c).alias("key")).alias(n) for n, c in zip(k, keys)],
        F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("v", F.when(F.isnan("v") | (F.abs("v") == float("inf")), F.raise_error(F.lit(f"{value} is not finite"))).otherwise(F.col("v")))
    stats = rows.groupBy(*k).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * F.lit(float(p))), F.ceil((F.col("n") - 1) * F.lit(float(p))))
                                                  for p in probs])))
    # a target is a rank still to be found: rank within what is left of its group, in [lo, hi]
    targets = stats.select(*k, F.explode(wanted).alias("rank"), "lo", "hi").withColumn("left", F.col("rank"))
    path: list[str] = []
    narrowed = rows
    for i in range(passes):
        b = f"_b{i}"
        # the targets of one bucket share its range
        ranges = targets.groupBy(*k, *path).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        narrowed = _joined(narrowed, ranges, [*k, *path]).withColumn(b, _bucket("lo", "hi")).drop("lo", "hi")
        counts = narrowed.groupBy(*k, *path, b).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy(*k, *path).orderBy(b)
        counts = counts.withColumn("to", F.sum("c").over(w)).withColumn("from", F.col("to") - F.col("c"))
        t = targets.drop("lo", "hi")
        targets = t.join(counts, [*k, *path]).where("left >= from and left < to").withColumn(
            "left", F.col("left") - F.col("from")).drop("c", "from", "to")
        path.append(b)
    done = targets.where("lo = hi").select(*k, "rank", F.col("lo").alias("v"))
    rest = targets.where("lo < hi")
    left = _joined(narrowed, rest.select(*k, *path).distinct().withColumn("_", F.lit(1)), [*k, *path])
    left = left.withColumn("left", (F.row_number().over(Window.partitionBy(*k, *path).orderBy("v")) - 1).cast("long"))
    found = done.unionByName(rest.join(left.select(*k, *path, "left", "v"), [*k, *path, "left"]).select(*k, "rank", "v"))
    by_rank = found.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))
    out = stats.select(*k, "n").join(by_rank, k)

    def quantile(p):
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col("of")[F.floor(at)], F.col("of")[F.ceil(at)]
        return F.when((F.floor(at) == F.ceil(at)) | (lo == hi), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return out.select(*[F.col(f"{n}.key").alias(c) for n, c in zip(k, keys)], "n", F.array(*[quantile(p) for p in probs]).alias("quantiles"))


def _joined(rows: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their group's range: one row a group on the right, so a heavy
    group is split by value."""
    return salted_join(rows, ranges, on, ["v"])
