"""Helpers shared by the operators: tables, scratch tables, text hashing and
connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fold of a row, as the contracts define it: crc32 of the id's decimal text.
def crc_fold(col, modulus: int):
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where none is set
    (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="shelfsense-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator call, in the shared folder.

    ``save`` writes a frame and reads it back, which cuts the lineage: a lost
    executor costs at most the stage that was running.  ``drop`` deletes a
    table that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


# ---------------------------------------------------------------- hashing

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over uint64 (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """64-bit hashes of byte spans: prefix sums of byte * B^i mod 2^64 with an
    odd (hence invertible) B give the hash of any span in O(1)."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)
        self.inverse = pow(_MULTIPLIER, -1, 1 << 64)

    def _grow(self, n: int) -> None:
        size = len(self.up)
        while size < n + 1:
            step_up = np.uint64(pow(_MULTIPLIER, size, 1 << 64))
            step_down = np.uint64(pow(self.inverse, size, 1 << 64))
            self.up = np.concatenate([self.up, self.up * step_up])
            self.down = np.concatenate([self.down, self.down * step_down])
            size *= 2

    def __call__(self, data: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        np.cumsum(values * self.up[:n], out=sums[1:])
        raw = (sums[ends] - sums[begins]) * self.down[begins]
        return mix64(raw ^ ((ends - begins).astype(np.uint64) << np.uint64(40)))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(spans: Spans, text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer
    than k words has its whole word sequence as its only shingle, a text
    without words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    if len(words) > k:
        begins, ends = begins[: len(words) - k + 1], ends[k - 1:]
    else:
        begins, ends = begins[:1], ends[-1:]
    return np.unique(spans(data, begins, ends))


def give_back() -> None:
    """Returns memory that is free again to the system.  A Python worker serves
    later tasks, of other stages too, and would hold the most it ever used beside
    what they need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def slices(batches, rows: int = 256):
    """The batches in parts of at most ``rows`` rows: Python objects are made
    for one part at a time, whatever size Spark gives its batches."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()


# ----------------------------------------------------- connected components

def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b longs); component is
    the smallest node that can be reached.

    Alternates the large-star and small-star steps until the edges no longer
    change, which takes a number of rounds in the order of the logarithm of the
    longest chain; every step is one aggregate and one join on the node, so a node
    with very many links is pre-aggregated map-side and its join partition can
    be split.  Nothing is brought to the driver but two totals per round.
    """
    current = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0")
    before = None
    for i in count(1):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        following = scratch.save(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        current = following
        after = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
