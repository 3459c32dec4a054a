"""Shard placement by a permutation-filled lookup table (operator 3).

Every shard has its own permutation of the slots of a prime-sized table
(offset and skip from two hashes of its name).  Shards take turns; in its turn
a shard claims the next slot of its permutation that is still free, until the
table is full.  Shards then hold almost equal numbers of slots, and when one is
lost nearly all slots of the others stay where they were.  A row's shard is
the entry at the hash of its key modulo the table's size: one lookup in a
table of fixed, small size that is broadcast.

Weighted shards take that many turns in each round.

Defined cases: a null key is a key like any other (the string "null" is a
different one); empty tables give empty results; equal keys share a shard;
extra columns stay, and clashing output names are replaced; no shards, equal
names or a table smaller than the shards are refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime; entries differ from the mean by about shards / SIZE.
SIZE = 65_537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def lookup_table(shards: dict[str, int] | list[str], size: int = SIZE) -> np.ndarray:
    """Index (into the sorted names) of the shard that owns each slot."""
    weights = dict(shards) if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    names = sorted(weights)
    if not names or len(names) != len(shards) or size < len(names) or min(weights.values()) < 1:
        raise ValueError("shards must be distinct, with turns of at least 1, and at most one per slot")
    if any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at = [_number(n, "offset") % size for n in names]
    skip = [_number(n, "skip") % (size - 1) + 1 for n in names]
    table = np.full(size, -1, np.int32)
    taken = 0
    while True:
        for i, name in enumerate(names):
            for _ in range(weights[name]):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % size
                table[at[i]] = i
                taken += 1
                if taken == size:
                    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: a 60-bit digest of its text, modulo the table's size."""
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards, size: int = SIZE, name: str = "shard") -> DataFrame:
    """(slot, shard) of the whole table, ``size`` rows."""
    names = sorted(shards)
    return spark.createDataFrame([(i, names[s]) for i, s in enumerate(lookup_table(shards, size).tolist())],
                                 f"slot int, {name} string")


def place(df: DataFrame, key: str, shards, size: int = SIZE, shard: str = "shard") -> DataFrame:
    """Every row of ``df`` with its slot and shard."""
    keep = [c for c in df.columns if c not in ("slot", shard) or c == key]
    rows = df.select(*[F.col(f"`{c}`") for c in keep]).withColumn("slot", slot_of(F.col(f"`{key}`"), size))
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, size, shard)), "slot").select(*keep, "slot", shard)
