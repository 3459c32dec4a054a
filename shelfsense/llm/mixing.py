"""Mixing sources to target weights by Pfair scheduling (operator 7).

Every source's documents, in a hash order, form blocks of ``block`` documents.
With weight w, the source's j-th block is released at slot floor(j / w) and
due by slot ceil((j + 1) / w); each slot takes the released block with the
earliest deadline.  For weights that sum to one this meets every deadline, so
after any number of slots each source is less than one block from its share.

Weights are exact: as integers W_s of a common denominator, block j is released
at j * T // W_s with T = sum(W_s).  The schedule is sequential by definition; it
has one row per block of ``block`` documents, streams through one task that
holds one entry per source, and is joined to the blocks.  It runs for the slots
of the mix; blocks of sources that are due later than its end (fewer documents
than a block by their share) are appended in the order of their deadlines.
With ``period``, weights are rounded to n_s / period instead.  The driver holds
one count per source, whose number has no limit.

Within a source, documents are numbered without gathering it in one task:
they are dealt over hash buckets, counted, and numbered inside their bucket
after the counts of the buckets before it.

``whole`` sources: nothing is dropped.  The mix is as long as the source that
is most abundant for its weight needs; the others start over (``epoch`` > 0)
until the weights hold over the whole mix.

Defined cases: a null source is a source of its own; null ids, repeated rows
and null or empty texts are documents like any other (ties by id, then text);
sources without a weight, or with weight zero, are refused; an empty table
gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.llm._common import buckets_for

NONE = "\0none"


def round_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Largest-remainder rounding to positive integers that sum to ``period``."""
    total = sum(weights.values())
    if any(w <= 0 or not math.isfinite(w) for w in weights.values()) or len(weights) > period:
        raise ValueError("weights must be positive and at most one per slot of the period")
    free = period - len(weights)  # one slot each, the rest by weight
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(e)) for s, e in exact.items()}
    over = sum(slots.values()) - period
    if over > 0:
        slots = {s: 1 + int(w / total * free) for s, w in weights.items()}
    rest = period - sum(slots.values())
    for s in sorted(weights, key=lambda s: (slots[s] - exact[s], s))[:rest]:
        slots[s] += 1
    return slots


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of ``weights``."""
    if any(w <= 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(f.denominator for f in exact.values()))
    return {s: int(f * scale) for s, f in exact.items()}


def pfair(slots: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block) of every slot, without end: earliest deadline first
    among the released blocks, ties to the smaller source name."""
    total = sum(slots.values())
    waiting = [(0, s, 0) for s in sorted(slots)]  # (release, source, block)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    heapq.heapify(waiting)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // slots[s]), s, j))
        deadline, s, j = heapq.heappop(ready)
        if slot >= deadline:
            raise RuntimeError("a deadline was missed")
        yield s, j
        heapq.heappush(waiting, ((j + 1) * total // slots[s], s, j + 1))
        slot += 1


def pfair_period(slots: dict[str, int]) -> list[str]:
    """Source of every slot of one period."""
    return [s for s, _ in islice(pfair(slots), sum(slots.values()))]


def schedule(slots: dict[str, int], blocks: dict[str, int], end: int | None) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of the first ``blocks`` of every source; those not
    placed before slot ``end`` follow it, by deadline."""
    left, done = sum(blocks.values()), dict.fromkeys(blocks, 0)
    for slot, (s, j) in enumerate(islice(pfair(slots), end)):
        if not left:
            return
        if j < blocks[s]:
            yield s, j, slot
            done[s] = j + 1
            left -= 1
    total = sum(slots.values())
    late = sorted((-(-(j + 1) * total // slots[s]), s, j) for s in blocks for j in range(done[s], blocks[s]))
    for slot, (_, s, j) in enumerate(late, end or 0):
        yield s, j, slot


def tempered(counts: dict[str, int], power: float) -> dict[str, float]:
    """Weights in proportion to count ** power: below 1, small sources gain."""
    raised = {s: c ** power for s, c in counts.items()}
    total = sum(raised.values())
    return {s: r / total for s, r in raised.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.9, block: int = 64,
        period: int | None = None, per_bucket: int = 4_000) -> DataFrame:
    """Every row of ``docs`` (source, doc_id, text, ...) with position (from 0,
    in the mix), slot and epoch; rows of sources that start over repeat.

    ``weights``: target of every source; by default tempered counts.
    ``period``: rounds the weights to so many slots; the number of sources
    must then be at most ``period``.
    """
    spark = docs.sparkSession
    docs = docs.drop("position", "slot", "epoch", "__s", "__b", "__n")
    by_text = [F.coalesce(F.col("text"), F.lit(""))] if "text" in docs.columns else []
    named = docs.withColumn("__s", F.coalesce(F.col("source"), F.lit(NONE)))
    counts = {r["__s"]: r["n"] for r in named.groupBy("__s").agg(F.count("*").alias("n")).collect()}
    if not counts:
        zero = F.lit(0).cast("long")
        return docs.select("*", zero.alias("position"), zero.alias("slot"), zero.alias("epoch"))
    weights = {NONE if s is None else s: w for s, w in (weights or tempered(counts, power)).items()}
    if missing := set(counts) - set(weights):
        raise ValueError(f"no weight for {sorted(missing)}")
    weights = {s: weights[s] for s in counts}
    slots = round_weights(weights, period) if period else whole_weights(weights)
    total = sum(slots.values())
    # documents a source gives: as many as the source that is most abundant
    # for its weight needs, and every source fills its own blocks
    most = max(Fraction(counts[s], slots[s]) for s in counts)
    wanted = {s: max(counts[s], round(most * slots[s])) for s in counts}
    blocks = {s: -(-n // block) for s, n in wanted.items()}
    end = None if period else math.ceil(most * total / block)

    needs = spark.createDataFrame([(s, counts[s], wanted[s]) for s in counts], "__s string, __had long, __wanted long")
    # numbering inside a source: bucket offsets are one row per bucket
    buckets = buckets_for(max(counts.values()), per_bucket)
    place = F.xxhash64("doc_id", *by_text)
    dealt = named.withColumn("__b", F.pmod(place, F.lit(buckets)))
    before = (dealt.groupBy("__s", "__b").agg(F.count("*").alias("n"))
              .withColumn("offset", F.sum("n").over(Window.partitionBy("__s").orderBy("__b")) - F.col("n"))
              .join(needs, "__s").select("__s", "__b", "offset", "__had", "__wanted"))
    inside = Window.partitionBy("__s", "__b").orderBy(place, "doc_id", *by_text)
    numbered = (dealt.withColumn("__r", F.row_number().over(inside) - 1).join(before, ["__s", "__b"])
                .withColumn("__n", F.col("offset") + F.col("__r")))
    def planned(batches):
        for _ in batches:
            rows = schedule(slots, blocks, end)
            while part := list(islice(rows, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), (pa.string(), pa.int64(), pa.int64()))],
                                                 ["__of", "__turn", "__at"])

    plan = spark.range(0, 1, 1, 1).mapInArrow(planned, "__of string, __turn long, __at long")
    placed = (numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"),
                                                               F.floor((F.col("__wanted") - 1 - F.col("__n")) / F.col("__had")))))
              .withColumn("__k", F.col("__n") + F.col("epoch") * F.col("__had"))
              .withColumn("__j", F.floor(F.col("__k") / block)))
    out = placed.join(plan, (F.col("__s") == F.col("__of")) & (F.col("__j") == F.col("__turn")))
    return out.select(*[placed[f"`{c}`"] for c in docs.columns],
                      (F.col("__at") * block + F.pmod("__k", F.lit(block))).alias("position"),
                      F.col("__at").alias("slot"), "epoch")
