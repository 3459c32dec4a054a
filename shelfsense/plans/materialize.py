"""Shared intermediates of a composite, with an owner that releases them.

Spark reuses an exchange only when two sub-plans are identical, and the
filters Catalyst pushes below a shared aggregate make the branches of a
composite differ, so each would scan the fact table again.  ``Shared.keep``
marks an intermediate to be cached when the first branch computes it; nothing
runs or is written while a plan is built.  A block lost with an executor is
recomputed from its lineage (one scan and one aggregate).

Spark caches by plan, so two owners of one base share one entry; it is counted
how many owners an entry has, and the last one to close releases it.

The frames stay cached until the owner is closed: at the end of a ``with``
block, by ``Assortment.close()``, or, for a registered query, when the
DataFrame that it returned is garbage collected.  Frames derived from it still
work afterwards; they are computed from the source again.
"""

from __future__ import annotations

import threading
import weakref
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


_lock = threading.RLock()  # a finalizer may run inside keep()
#: Entries that are cached now: [frame, number of owners], by hash of the plan.
_entries: dict[int, list[list]] = {}


def _entry(df: DataFrame) -> list | None:
    for entry in _entries.get(df.semanticHash(), []):
        if entry[0].sparkSession is df.sparkSession and entry[0].sameSemantics(df):
            return entry
    return None


class Shared:
    def __init__(self):
        self._kept: list[tuple[list, DataFrame]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        with _lock:
            entry = _entry(df)
            if entry is None:
                entry = [df, 0]
                _entries.setdefault(df.semanticHash(), []).append(entry)
            entry[1] += 1
            self._kept.append((entry, df.persist(StorageLevel.MEMORY_AND_DISK)))
        return df

    def close(self) -> None:
        with _lock:
            while self._kept:
                entry, df = self._kept.pop()
                entry[1] -= 1
                if entry[1]:
                    df.is_cached = False  # for this owner
                    continue
                key = df.semanticHash()
                _entries[key] = [e for e in _entries[key] if e is not entry]
                if not _entries[key]:
                    del _entries[key]
                df.unpersist()

    def __enter__(self) -> Shared:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def owned(build: Callable[[SparkSession, str, Callable[[DataFrame], DataFrame]], DataFrame]):
    """Query ``(spark, sf_dir) -> DataFrame`` from ``build(spark, sf_dir, keep)``;
    what it keeps is released with the returned DataFrame."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared = Shared()
        df = build(spark, sf_dir, shared.keep)
        weakref.finalize(df, shared.close)
        return df

    return query
