"""Near-duplicate classes by b-bit MinHash (operator 8).

1. Every text gets the minima of 160 hash functions over its distinct k-word
   shingles: 32 band keys of 5 minima each, and a signature that keeps two
   bits of each minimum.  Equal shingle sets are reduced to one
   representative before anything else.
2. Representatives that share a band key are candidates.  Within a small
   bucket, pairs whose signatures estimate enough similarity (bit counts,
   corrected for chance agreement) are candidate links; a large bucket links
   every member to its first one instead, unfiltered, so no pair is lost and
   no pairs of a large group are emitted.
3. Connected candidates form candidate classes, which contain every true link
   between texts that share a band.  A class is cut into blocks of bounded size,
   and every block is compared inside and with the class's first text: signatures
   first, in falling order of the estimate, then the full shingle sets; a pair
   that is already connected is skipped.  Only confirmed spanning links leave a
   task.  A group of near copies is connected by then, through its first text.
4. What is not yet connected to the first text of a class of several blocks is
   compared with all of its class, block by block; texts that are connected are
   not compared again.  So N near copies send their texts once, and only the rest
   of a class is sent once for each block of it.
5. Connected confirmed links are the near-duplicate classes.

A pair at the threshold of 0.8 shares no band with probability 3e-6, and its
estimate falls below the filter with probability below 1e-4.

Defined cases: a null or blank text has an empty set and is linked with
nothing; rows without an id are linked with nothing and kept; rows that repeat
an id and its text share its class (ids are expected to name one text); ties go
to the smallest id; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions.bloom import bloom_filter, might_hold
from shelfsense.llm._common import Scratch, Spans, connected_components, mix64, shingle_hashes, slices

BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
LANES = 64 // BITS
LONGS = HASHES // LANES
#: Estimates are compared from here on; four standard errors below 0.8.
ESTIMATE = 0.64
MOST_DIFFERENT = int(HASHES * (1 - (ESTIMATE * (1 - 2.0 ** -BITS) + 2.0 ** -BITS)))
#: Buckets up to this size compare all their members' signatures at once.
SMALL = 24
#: Shingles (plus 200 a text) of a block that one task compares.
BLOCK = 2_000_000
#: Pairs of signatures compared at a time (some 30 MB of work arrays).
PAIRS = 250_000

_random = np.random.default_rng(20240607)
_A = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
_R = _random.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD_BITS = np.uint64(0x5555555555555555)


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        values = hashes[None, at:at + 1024] * _A[:, None] + _B[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of (n, HASHES) minima."""
    rows = (least.reshape(-1, BANDS, ROWS) * _R).sum(axis=2, dtype=np.uint64)
    return mix64(rows + mix64(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def signatures(least: np.ndarray) -> np.ndarray:
    """(n, LONGS) packed low bits of (n, HASHES) minima."""
    low = (mix64(least) & np.uint64(3)).reshape(-1, LONGS, LANES)
    return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing lanes of packed signatures (..., LONGS)."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & _ODD_BITS).sum(axis=-1, dtype=np.int32)


def estimate(different) -> float:
    """Similarity from differing lanes, corrected for chance agreement."""
    chance = 2.0 ** -BITS
    return ((HASHES - different) / HASHES - chance) / (1 - chance)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64).tolist())


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, hi, lo (digest of the set), bands, s0.. of every row."""
    names = [f"s{i}" for i in range(LONGS)]
    schema = "doc_id long, n_shingles long, hi long, lo long, bands array<long>, " + ", ".join(f"{n} long" for n in names)

    def run(batches):
        spans = Spans()
        for batch in slices(batches):
            sets = [shingle_hashes(spans, t, k) for t in batch.column(1).to_pylist()]
            if not sets:
                continue
            least = np.stack([minima(s) for s in sets])
            keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
            packed = signatures(least).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()),
                                             pa.array(band_keys(least).ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]),
                 pa.array(keys[:, 1]), bands, *[pa.array(packed[:, i].copy()) for i in range(LONGS)]],
                ["doc_id", "n_shingles", "hi", "lo", "bands", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class _Block:
    """Compares the texts of one block (or of two) and finds spanning links."""

    def __init__(self, ids, sets, packed, sides, share, groups=None):
        """``groups``: what is connected already, by equal numbers."""
        self.ids, self.sets, self.packed, self.sides = ids, sets, packed, sides
        self.sizes = np.array([len(s) for s in sets])
        self.num, self.den = share
        self.label = np.arange(len(ids)) if groups is None else np.unique(np.array(groups), return_inverse=True)[1]

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        if self.den * len(a) < self.num * len(b):
            return False
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int(np.count_nonzero(b[at] == a))
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def links(self):
        n = len(self.ids)
        edges = [0, 8, 16, 24, 32, 38, MOST_DIFFERENT + 1]
        step = max(1, PAIRS // max(n, 1))
        for lo, hi in zip(edges, edges[1:]):
            for top in range(0, n, step):
                rows = slice(top, min(top + step, n))
                d = differing(self.packed[rows, None, :], self.packed[None, :, :])
                near = (d >= lo) & (d < hi) & (self.label[rows, None] != self.label[None, :])
                near &= np.arange(rows.start, rows.stop)[:, None] < np.arange(n)[None, :]
                if self.sides is not None:
                    near &= self.sides[rows, None] != self.sides[None, :]
                for i, j in zip(*np.nonzero(near)):
                    i = int(i) + top
                    if self.label[i] != self.label[j] and self.linked(i, int(j)):
                        yield self.ids[i], self.ids[int(j)]
                        self.label[self.label == self.label[j]] = self.label[i]


def confirm(members: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Confirmed spanning links (a, b) of blocks; members: class_id, x, y (the
    comparison), side (only different sides are compared; null: all), known
    (equal where connected already), doc_id, hi, lo, text."""

    def run(batches):
        spans = Spans()
        now, rows = None, []

        def compared():
            ids, sets, sides, groups, seen = [], [], [], [], set()
            for side, known, i, hi, lo, text in rows:
                s = shingle_hashes(spans, text, k)
                # an id may stand for several texts: only the one that was sketched counts
                if (i, side) not in seen and set_key(s) == (hi, lo):
                    seen.add((i, side))
                    ids.append(i)
                    sets.append(s)
                    sides.append(side)
                    groups.append(known)
            if len(ids) < 2:
                return None
            packed = signatures(np.stack([minima(s) for s in sets]))
            cross = np.array(sides) if sides[0] is not None else None
            found = list(_Block(ids, sets, packed, cross, share, groups).links())
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                               pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in slices(batches):
            for c, x, y, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if (c, x, y) != now:
                    if rows and (made := compared()) is not None:
                        yield made
                    now, rows = (c, x, y), []
                rows.append(row)
        if rows and (made := compared()) is not None:
            yield made

    return (members.select("class_id", "x", "y", "side", "known", "doc_id", "hi", "lo", "text")
            .repartition(F.col("class_id"), F.col("x"), F.col("y")).sortWithinPartitions("class_id", "x", "y", "doc_id")
            .mapInArrow(run, "a long, b long"))


def _blocks(members: DataFrame) -> DataFrame:
    """(class_id, blocks): how many blocks a class has."""
    return members.groupBy("class_id").agg(F.ceil(F.sum(F.col("n_shingles") + 200) / BLOCK).cast("int").alias("blocks"))


#: 64-bit words of the filter over the ids whose texts are compared (1 MiB).
FILTER_WORDS = 1 << 17


def compared_texts(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``placed``, and a few others that a Bloom
    filter lets pass: only these are shuffled to the comparisons."""
    ids = bloom_filter(placed, ["doc_id"], FILTER_WORDS).scalar()
    return docs.where(might_hold(ids, ["doc_id"], FILTER_WORDS))


def class_links(sized: DataFrame, docs: DataFrame, scratch: Scratch, k: int, share: tuple[int, int]) -> DataFrame:
    """Confirmed spanning links of candidate classes; ``sized``: class_id (the
    class's smallest id), doc_id, hi, lo, n_shingles."""
    none = F.lit(None).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    placed = scratch.save(sized.join(_blocks(sized), "class_id").withColumn("own", own), "placed")
    docs = compared_texts(placed, docs)
    # inside the blocks; the first text of a class visits all of them
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = placed.where("doc_id = class_id").withColumn("x", every).where("x <> own")
    inside = placed.withColumn("x", F.col("own")).unionByName(first).select(
        "class_id", "x", F.lit(0).alias("y"), none.alias("side"), F.col("doc_id").alias("known"), "doc_id", "hi", "lo")
    links = scratch.save(confirm(inside.join(docs, "doc_id"), k, share), "links-inside")
    # across the blocks: the rest of a class against all of it
    several = placed.where("blocks > 1")
    if several.isEmpty():
        return links
    joined = connected_components(links.join(several.select(F.col("doc_id").alias("a")), "a", "left_semi"), scratch, "inside")
    known = several.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "known", F.coalesce("component", "doc_id")).drop("component", "blocks")
    known = scratch.save(known, "known")
    rest = known.where("known <> class_id")
    rest = rest.join(_blocks(rest).withColumnRenamed("blocks", "parts"), "class_id").withColumn(
        "x", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int"))
    parts = rest.groupBy("class_id").agg(F.max("parts").alias("parts"))
    blocks = known.groupBy("class_id").agg(F.max("own").alias("last"))
    columns = ["class_id", "x", "y", "side", "known", "doc_id", "hi", "lo"]
    one = rest.join(blocks, "class_id").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("side", F.lit(0))
    other = known.join(parts, "class_id").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
        "y", F.col("own")).withColumn("side", F.lit(1))
    across = one.select(*columns).unionByName(other.select(*columns))
    return links.unionByName(confirm(across.join(docs, "doc_id"), k, share))


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest reachable id) of every row of
    ``docs`` (doc_id, text); links have den * shared >= num * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = scratch.save(sketch(docs, k), "sketches")
    own = sketches.where("doc_id is not null and n_shingles > 0")
    first = Window.partitionBy("hi", "lo").orderBy("doc_id")
    names = [f"s{i}" for i in range(LONGS)]
    sets = scratch.save(own.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place"), "sets")

    rows = sets.select("doc_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).where("n > 1")
    members = scratch.save(rows.join(shared, "key").select("key", "n", "lead", "doc_id"), "members")
    star = members.where((F.col("n") > SMALL) & (F.col("doc_id") != F.col("lead"))).select(
        F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    near = (members.where(F.col("n") <= SMALL).select("key", "doc_id")
            .join(sets.select("doc_id", "n_shingles", *names), "doc_id"))
    a, b = near.alias("a"), near.alias("b")
    lanes = [f"a.{n} ^ b.{n}" for n in names]
    different = " + ".join(f"bit_count((({x}) | shiftrightunsigned({x}, 1)) & {int(_ODD_BITS)}L)" for x in lanes)
    pairs = a.join(b, F.expr(
        f"a.key = b.key and a.doc_id < b.doc_id and {share[1]} * least(a.n_shingles, b.n_shingles) >= "
        f"{share[0]} * greatest(a.n_shingles, b.n_shingles) and {different} <= {MOST_DIFFERENT}")).select(
        F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))
    classes = connected_components(star.unionByName(pairs), scratch, "candidates")
    classes = scratch.save(classes, "classes")
    scratch.drop("members")

    sized = classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")).join(
        sets.select("doc_id", "hi", "lo", "n_shingles"), "doc_id")
    links = class_links(sized, docs, scratch, k, share)
    found = connected_components(scratch.save(links, "links"), scratch, "components")
    found = scratch.save(found, "result").withColumnRenamed("node", "rep")
    scratch.drop("classes")

    reps = sets.select("hi", "lo", F.col("doc_id").alias("rep")).join(found, "rep", "left").select(
        "hi", "lo", F.coalesce("component", "rep").alias("component"))
    by_row = own.select("doc_id", "n_shingles", "hi", "lo").join(reps, ["hi", "lo"])
    rest = sketches.where("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return by_row.select("doc_id", "n_shingles", "component").unionByName(rest).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
