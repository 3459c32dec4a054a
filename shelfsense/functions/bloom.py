"""Bloom filters over key columns, built and asked with built-in functions.

A filter has a fixed number of bits, so the one row it is sent around as has a
known size whatever it was built from; more keys only make it let more pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a filter (32 KiB).
WORDS = 4096
_SEEDS = (11, 23, 47)


def _places(keys: Sequence[str | Column], words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(words * 64)) for seed in _SEEDS]


def bloom_filter(df: DataFrame, keys: Sequence[str], words: int = WORDS) -> DataFrame:
    """One row, one column ``words``: the filter of the keys of ``df``.  Words are
    combined map-side with ``bit_or``."""
    bits = df.select(F.explode(F.array(*_places(keys, words))).alias("at")).select(
        F.expr("at div 64").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
    empty = df.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = bits.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def might_hold(words: Column, keys: Sequence[str | Column], size: int = WORDS) -> Column:
    """False only for keys that are surely not in the filter."""
    tests = [F.getbit(words[(F.floor(at / 64)).cast("int")], (at % 64).cast("int")) == 1 for at in _places(keys, size)]
    return tests[0] & tests[1] & tests[2]
