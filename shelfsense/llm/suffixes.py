"""Removal of byte strings that repeat anywhere in a corpus (suffix arrays).

Every byte covered by a string of ``length`` bytes that also starts anywhere
else, in the same document or another one, is removed.  Strings never cross
documents and are judged on the input.

1. *Shards.*  Whole texts are laid into shards of at most 2 MiB (longer texts
   in pieces that overlap by ``length - 1`` bytes, so every string lies in
   exactly one piece).  A shard's suffix array is built by Larsson-Sadakane
   refinement (:func:`suffix_array`): suffixes ordered by their first h bytes
   are ordered by 2h through the ranks h further on, and only groups that are
   still unordered are touched again.  Kasai's common prefixes
   (:func:`common_prefixes`) of neighbours give the strings that repeat inside
   the shard; of equal strings only the first place matters to other shards.
2. *Candidates for other shards.*  Every string has one anchor, the 96 bytes in
   it with the smallest hash (the leftmost), so equal strings have equal anchors
   at equal places.  Only anchors that two shards hold go on, each standing for
   the bytes of its strings (its context), which are known by a digest.  Equal
   contexts collapse first: all their strings repeat, and one of them stands for
   the rest.
3. *Merging.*  Where an anchor still has several contexts, their bytes meet in
   one bucket.  Every shard's strings are a sorted run there, and runs are merged
   two by two by binary search (:func:`merge_runs`): a key found in the other run
   repeats.  Anchors with more than ``SPLIT`` contexts are split: tasks cut their
   runs by key ranges, and every range is merged on its own.

Keys of strings are 128 bits (64 to search, 64 to confirm), those of contexts 160
with their anchor's.  Texts are shuffled compressed, and once; no rows reach the
driver, and what is not written to the shared folder Spark can compute again.

Null texts count as empty, repeated rows and null ids are rows like others
(equal rows remove each other's strings), an empty table gives an empty
result.  Only ``doc_id`` and ``text`` are read, other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm._common import Scratch, Spans, mix64, slices

LENGTH = 400
#: Bytes of an anchor; every string of LENGTH bytes holds LENGTH - GRAM + 1 candidates.
GRAM = 96
SHARD_BITS = 21
#: Bytes of the longest piece of a text; a shard holds at least one.
PIECE = 1 << 20
#: Contexts of one anchor that a task merges at once; more are split by key ranges.
SPLIT = 2000
#: Bytes of contexts merged at a time.
MERGE_BYTES = 2 << 20

END = b"\xff"  # never part of UTF-8 text
U = np.uint64


# ------------------------------------------------------------ suffix arrays

def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, open): the suffixes of ``data`` (uint8, fewer than 2^21) in order,
    and the places in that order whose suffix shares ``depth / 2`` bytes or more
    with a neighbour (the others need no common prefix).

    Starts from the first five bytes and doubles: group, rank h further on and
    position are packed into one 64-bit number, so one plain sort refines all
    groups that are still open.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(5, np.uint8)])
    key = np.zeros(n, U)
    for j in range(5):
        key = (key << U(8)) | padded[j:j + n]
    key = (key << U(SHARD_BITS)) | np.arange(n, dtype=U)
    low = U((1 << SHARD_BITS) - 1)
    rank = np.zeros(2 * n + 8, np.int32)  # from 1; 0 past the end
    order = np.empty(n, np.int32)
    slots, h, shared = np.arange(n, dtype=np.int32), 5, None
    while True:
        key.sort()
        order[slots] = (key & low).astype(np.int32)
        key >>= U(SHARD_BITS)
        first = np.ones(len(slots), bool)
        np.not_equal(key[1:], key[:-1], out=first[1:])
        group = np.maximum.accumulate(np.where(first, slots, 0))
        rank[order[slots]] = group + 1
        single = first.copy()
        single[:-1] &= first[1:]
        slots, group = slots[~single], group[~single]
        if shared is None and 2 * h >= depth:
            shared = slots
        if not len(slots):
            return order, slots if shared is None else shared
        at = order[slots]
        key = ((group.astype(U) << U(2 * SHARD_BITS)) | (rank[at + h].astype(U) << U(SHARD_BITS)) | at.astype(U))
        h *= 2


_STEPS = np.array([1] + [1 << (8 * k) for k in range(1, 8)], U)


def common_prefixes(data: np.ndarray, order: np.ndarray, places: np.ndarray, depth: int,
                    lane: int = 512) -> np.ndarray:
    """Per position of ``data`` its common prefix with the suffix before it in
    ``order``, at most ``depth``; 0 for positions not at ``places`` of the order.

    Kasai: from one position to the next the prefix shrinks by one at most.
    Runs of positions are walked side by side in lanes, eight bytes a step.
    """
    n = len(data)
    found = np.zeros(n, np.int32)
    wanted = np.sort(order[places])
    if not len(wanted):
        return found
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]  # the first suffix has none: the padding
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    words = np.zeros(n + depth + 8, U)
    for j in range(8):
        words = (words << U(8)) | padded[j:j + len(words)]
    new = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1] + 1]))
    begins, lengths = wanted[new], np.diff(np.concatenate([new, [len(wanted)]]))
    parts = -(-lengths // lane)
    offset = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * lane
    i = np.repeat(begins, parts) + offset
    end = np.minimum(i + lane, np.repeat(begins + lengths, parts))
    h = np.zeros(len(i), np.int64)
    while len(i):
        same = 8 - np.searchsorted(_STEPS, words[i + h] ^ words[before[i] + h], side="right")
        h = np.minimum(h + same, depth)
        done = (same < 8) | (h == depth)
        found[i[done]] = h[done]
        i = i + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        left = i < end
        if not left.all():
            i, end, h = i[left], end[left], h[left]
    return found


def repeats_inside(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, spare): whether the string at each position also starts
    elsewhere in ``data``, and whether it also starts further left."""
    order, places = suffix_array(data, length)
    prefix = common_prefixes(data, order, places, length)
    joined = prefix[order] >= length  # with the place before
    repeated, spare = np.zeros(len(data), bool), np.zeros(len(data), bool)
    hit = np.flatnonzero(joined)
    if len(hit):
        member = np.unique(np.concatenate([hit - 1, hit]))
        repeated[order[member]] = True
        heads = np.flatnonzero(~joined[member])
        least = np.minimum.reduceat(order[member], heads)
        spare[order[member]] = True
        spare[least] = False
    return repeated, spare


# ------------------------------------------------------------------ anchors

def anchors(hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Per string start the position of its anchor: the smallest gram hash among
    its ``length - gram + 1``, the leftmost of equal ones."""
    window = length - gram + 1
    bits = U(SHARD_BITS + 1)
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=U)
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[:span - window], least[window - span:])
    return (least & U((1 << int(bits)) - 1)).astype(np.int64)


class Shard:
    """Pieces of texts laid end to end: strings that repeat, and anchors."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int, gram: int, spans: Spans):
        data = b"".join(x + END for _, _, x in pieces)
        sizes = np.array([len(x) for _, _, x in pieces])
        begins = np.cumsum(sizes + 1) - sizes - 1
        self.pieces, self.begins = pieces, begins
        self.of = np.repeat(np.arange(len(pieces)), sizes + 1)
        whole = np.repeat(begins + sizes, sizes + 1) - np.arange(len(data)) >= length
        array = np.frombuffer(data, np.uint8)
        repeated, spare = repeats_inside(array, length)
        self.repeated = repeated & whole
        at = np.arange(max(len(data) - gram + 1, 0))
        hashes = spans(data, at, at + gram)
        starts = np.flatnonzero(whole)
        if len(starts):
            anchor = anchors(hashes, length, gram)[starts]
            new = np.flatnonzero(np.concatenate(
                [[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            some = np.logical_or.reduceat(~spare[starts], new)
            last = np.concatenate([new[1:], [len(starts)]]) - 1
            self.first, self.last = starts[new][some], starts[last][some]
            self.hashes = hashes[anchor[new]][some].view(np.int64)
        else:
            self.first = self.last = self.hashes = np.empty(0, np.int64)
        # what a context holds, by two digests
        end = self.last + length if len(self.last) else self.last
        self.digests = spans(data, self.first, end).view(np.int64)
        self.checks = (spans(data.translate(_OTHER), self.first, end) >> U(32)).astype(np.int64)

    def marks(self) -> Iterator[tuple]:
        """(document, runs of repeated strings, anchors with their context's
        digests and first and last string), by piece."""
        edge = np.diff(np.concatenate([[0], self.repeated.view(np.int8), [0]]))
        up, down = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        ups, anchors_at = self.of[up], self.of[self.first]
        for k, (document, at, _) in enumerate(self.pieces):
            shift = at - self.begins[k]
            a, b = np.searchsorted(ups, [k, k + 1])
            c, d = np.searchsorted(anchors_at, [k, k + 1])
            yield (document, up[a:b] + shift, down[a:b] + shift, self.hashes[c:d], self.digests[c:d], self.checks[c:d],
                   self.first[c:d] + shift, self.last[c:d] + shift)


#: Rows of the written table of texts and marks.
_LISTS = ["begins", "ends", "hashes", "digests", "checks", "firsts", "lasts", "shards"]


def _shards(batches, length: int, gram: int):
    """Documents with their marks; a shard is what a task reads until it is full."""
    spans, room = Spans(), (1 << SHARD_BITS) - 1
    part, made = TaskContext.get().partitionId(), 0
    pieces: list[tuple[int, int, bytes]] = []
    pending: list[list] = []  # id, text, and lists of arrays
    size = waiting = 0

    def close():
        nonlocal pieces, size, made
        if pieces:
            for document, *arrays in Shard(pieces, length, gram, spans).marks():
                for held, array in zip(pending[document][2:], [*arrays, np.full(len(arrays[2]), (part << 32) + made)]):
                    held.append(array)
            pieces, size, made = [], 0, made + 1

    def rows(documents, id_type):
        whole = lambda arrays: np.concatenate(arrays).astype(np.int64) if arrays else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([d[0] for d in documents], id_type), pa.array([len(d[1]) for d in documents], pa.int64()),
            pa.array([pa.compress(d[1], codec="zstd", asbytes=True) if d[1] else b"" for d in documents], pa.binary()),
            *[pa.array([whole(d[2 + i]) for d in documents], pa.list_(pa.int64())) for i in range(len(_LISTS))]],
            ["doc_id", "n_bytes", "packed", *_LISTS])

    for batch in slices(batches):
        id_type = batch.schema.field(0).type
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or b""
            pending.append([doc_id, text, *[[] for _ in _LISTS]])
            waiting += len(text)
            for at in range(0, len(text) - length + 1, PIECE):
                piece = text[at:at + PIECE + length - 1]
                if size + len(piece) + 1 > room:
                    close()
                    if len(pending) > 1:
                        yield rows(pending[:-1], id_type)
                    pending, waiting = pending[-1:], len(text)
                pieces.append((len(pending) - 1, at, piece))
                size += len(piece) + 1
            if waiting > 4 * room or len(pending) >= 4096:
                close()
                yield rows(pending, id_type)
                pending, waiting = [], 0
    if pending:
        close()
        yield rows(pending, id_type)


# ------------------------------------------------------------------ merging

def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Places whose key another place also has.  ``runs``: (sorted keys, second
    keys, places).  Runs are merged two by two; the keys of the shorter one are
    looked up in the longer one by binary search."""
    hits = []

    def single(run):
        keys, second, places = run
        same = (keys[1:] == keys[:-1]) & (second[1:] == second[:-1])
        if same.any():
            hits.extend((places[1:][same], places[:-1][same]))
            keep = np.concatenate([[True], ~same])
            return keys[keep], second[keep], places[keep]
        return run

    def merge(long, short):
        if len(long[0]) < len(short[0]):
            long, short = short, long
        at = np.searchsorted(long[0], short[0])
        there = np.minimum(at, len(long[0]) - 1)
        same = (long[0][there] == short[0]) & (long[1][there] == short[1])
        hits.extend((long[2][there[same]], short[2][same]))
        return tuple(np.insert(x, at[~same], y[~same]) for x, y in zip(long, short))

    runs = [single(run) for run in runs if len(run[0])]
    while len(runs) > 1:
        merged = [merge(a, b) for a, b in zip(runs[::2], runs[1::2])]
        runs = merged + runs[2 * len(merged):]
    return np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)


class Contexts:
    """Contexts (hash, shard, row, first, text) laid end to end, and the keys of
    all their strings."""

    def __init__(self, rows: list[tuple], length: int, spans: Spans):
        sizes = np.array([len(x[4]) for x in rows])
        counts = sizes - length + 1
        of = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
        data = b"".join(x[4] for x in rows)
        anchor, self.shard, self.row, first = (np.array([x[i] for x in rows], np.int64)[of] for i in range(4))
        self.start = first + offset
        self.keys = mix64(spans(data, at, at + length) + anchor.view(U) * U(0x9E3779B97F4A7C15))
        # the second key comes from the bytes read through another table
        self.second = spans(data.translate(_OTHER), at, at + length)

    def runs_by_shard(self) -> list[np.ndarray]:
        """The strings of every shard, sorted by key."""
        order = np.lexsort((self.keys, self.shard))
        return np.split(order, np.flatnonzero(np.diff(self.shard[order])) + 1)

    def runs(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [(self.keys[p], self.second[p], p) for p in self.runs_by_shard()]


#: A fixed permutation of the byte values, for an independent second key.
_OTHER = bytes(np.random.default_rng(11).permutation(256).astype(np.uint8))


def _groups(batches, key_columns: int, limit: int):
    """Rows of a partition sorted by its first columns, in lists that end between
    keys and hold about ``limit`` bytes of the last column."""
    held, size, last = [], 0, None
    for batch in slices(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            key = row[:key_columns]
            if held and key != last and size >= limit:
                yield held
                held, size = [], 0
            held.append(row)
            size += 64 + len(row[-1] or b"")
            last = key
    if held:
        yield held


def _runs(row: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, begin, end) of runs of string starts."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    if not len(row):
        return []
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(row)]]) - 1
    return list(zip(row[new].tolist(), start[new].tolist(), start[last].tolist()))


#: Rows between the two steps: a found run of starts, or (where keys are given)
#: the strings of one shard and key range of a split anchor.
_STEP = "group long, part int, row long, begin long, end long, keys binary, second binary, rows binary, starts binary"


def _step(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      [c.split()[0] for c in _STEP.split(", ")])


def _merge_or_cut(length: int):
    """Contexts (hash, salt, ranges, shard, row, first, text), sorted: merged where
    an anchor is whole here, cut by key ranges where it is split."""
    def run(batches):
        spans = Spans()
        for rows in _groups(batches, 2, MERGE_BYTES):
            whole = [(r[0], *r[3:]) for r in rows if r[2] == 1]
            if whole:
                c = Contexts(whole, length, spans)
                hits = merge_runs(c.runs())
                yield _step([(row, -1, row, a, b, None, None, None, None) for row, a, b in _runs(c.row[hits], c.start[hits])])
            split: dict[int, list] = {}
            for r in rows:
                if r[2] > 1:
                    split.setdefault(r[0], []).append(r)
            for anchor, members in split.items():
                ranges = members[0][2]
                c = Contexts([(r[0], *r[3:]) for r in members], length, spans)
                width = (1 << 64) // ranges
                for places in c.runs_by_shard():
                    borders = np.searchsorted(c.keys[places], np.array([k * width for k in range(1, ranges)], U))
                    yield _step([(anchor, k, None, None, None, *[x[p].tobytes() for x in (c.keys, c.second, c.row, c.start)])
                                 for k, p in enumerate(np.split(places, borders)) if len(p)])
    return run


def _merge_ranges(batches):
    """The second step: key ranges of split anchors are merged, runs pass."""
    for rows in _groups(batches, 2, MERGE_BYTES):
        out = [(r[2], r[3], r[4]) for r in rows if r[2] is not None]
        cuts = [[np.frombuffer(r[5 + i], t) for i, t in enumerate((U, U, np.int64, np.int64))] for r in rows if r[5] is not None]
        if cuts:
            base = np.cumsum([0] + [len(c[0]) for c in cuts])
            hits = merge_runs([(c[0], c[1], np.arange(b, b + len(c[0]))) for c, b in zip(cuts, base)])
            out += _runs(*[np.concatenate([c[i] for c in cuts])[hits] for i in (2, 3)])
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["row", "begin", "end"])


# ------------------------------------------------------------------ removal

def _text(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _contexts_of(length: int):
    def run(batches):
        for batch in slices(batches):
            out = []
            for row, _, size, packed, marks in zip(*[c.to_pylist() for c in batch.columns]):
                text = _text(packed, size)
                out.extend((m["hash"], m["ranges"], m["shard"], row, m["first"], text[m["first"]:m["last"] + length]) for m in marks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.int32()] + [pa.int64()] * 3 + [pa.binary()])],
                ["hash", "ranges", "shard", "row", "first", "text"])
    return run


def _removed(length: int):
    def run(batches):
        for batch in slices(batches):
            out = []
            for _, doc_id, size, packed, marks in zip(*[c.to_pylist() for c in batch.columns]):
                text, begins, ends = _text(packed, size), np.empty(0, np.int64), np.empty(0, np.int64)
                if marks:
                    begin = np.array([m["begin"] for m in marks], np.int64)
                    order = np.argsort(begin, kind="stable")
                    begin = begin[order]
                    reach = np.maximum.accumulate(np.array([m["end"] for m in marks], np.int64)[order] + length)
                    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
                    begins, ends = begin[new], reach[np.concatenate([new[1:], [len(begin)]]) - 1]
                kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), size]))
                out.append((doc_id, size, size - len(kept), len(begins),
                            [{"begin": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist())], kept))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in out], batch.schema.field(1).type), *[pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3)],
                pa.array([x[4] for x in out], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                pa.array([x[5] for x in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
    return run


def _zipped(**lists: str):
    """Rows of lists that lie side by side."""
    return F.inline(F.arrays_zip(*[F.col(c).alias(name) for name, c in lists.items()]))


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM,
                   split: int = SPLIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, ``spans`` (maximal
    removed runs, byte offsets) and ``kept`` (the remaining bytes)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        lambda b: _shards(b, length, gram), ", ".join([f"doc_id {id_type}", "n_bytes long", "packed binary", *[f"{c} array<long>" for c in _LISTS]]))
    rows = scratch.save(marked.withColumn("row", F.monotonically_increasing_id()), "rows")

    # contexts of anchors that several shards hold, judged by their digests
    held = rows.select("row", _zipped(hash="hashes", digest="digests", check="checks", first="firsts", last="lasts", shard="shards"))
    shared = held.groupBy("hash").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b").select("hash")
    held = scratch.save(held.join(shared, "hash"), "held")
    equal = held.groupBy("hash", "digest", "check").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    several = equal.groupBy("hash").agg(F.count("*").alias("different")).where("different > 1")
    # all strings of equal contexts repeat; the one of the smallest row stands for them
    again = held.join(equal.where("n > 1"), ["hash", "digest", "check"]).select("row", F.col("first").alias("begin"), F.col("last").alias("end"))
    ranges = F.ceil(F.col("different") / F.lit(split)).cast("int")
    open_ = held.join(equal, ["hash", "digest", "check"]).where("row = least").join(several, "hash").groupBy("row").agg(
        F.collect_list(F.struct("hash", ranges.alias("ranges"), "shard", "first", "last")).alias("marks"))

    texts = rows.select("row", "doc_id", "n_bytes", "packed")
    contexts = texts.join(open_, "row").select("row", "doc_id", "n_bytes", "packed", "marks").mapInArrow(
        _contexts_of(length), "hash long, ranges int, shard long, row long, first long, text binary")
    salt = F.pmod(F.xxhash64("row", "first"), F.col("ranges")).cast("int")
    met = contexts.select("hash", salt.alias("salt"), "ranges", "shard", "row", "first", "text")
    met = met.repartition("hash", "salt").sortWithinPartitions("hash", "salt").mapInArrow(_merge_or_cut(length), _STEP)
    across = met.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(
        _merge_ranges, "row long, begin long, end long")

    inside = rows.select("row", _zipped(begin="begins", end="ends"))
    runs = inside.unionByName(again).unionByName(across).groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    return texts.join(runs, "row", "left").select("row", "doc_id", "n_bytes", "packed", "marks").mapInArrow(
        _removed(length), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, "
                          "spans array<struct<begin:long,end:long>>, kept binary")
