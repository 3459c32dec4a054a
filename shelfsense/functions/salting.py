"""Joins of a large side with a small one on a few heavy keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts a heavy key is split into; the small side is repeated so often.
SALTS = 32


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join on ``keys`` whose shuffle, if Spark plans one, also splits the
    rows of a key by a hash of the large side's ``spread`` columns; ``small``
    (a few rows a key) is repeated ``salts`` times."""
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
