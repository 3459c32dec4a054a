"""Substring deduplication by winnowed anchors and compared strings (operator 6).

A gear hash rolls over the bytes of a text (each byte's random 32-bit gear,
shifted left as it ages, so 32 bytes decide).  Of every ``REACH`` successive
grams of ``GRAM`` bytes the one with the smallest hash is an anchor, so every
string of ``GRAM + REACH - 1`` = 95 bytes holds an anchor, and equal strings hold
equal ones at equal places.  A byte of a document is cut if it stands in a string
of ``least_run`` bytes that one earlier document (smaller id) holds as well, or
that stands at least ``least_run`` bytes before in the same document; strings
that only several earlier documents together hold are left.  The first document
keeps its copy.

Whole chunks between content-defined boundaries were tried as what is compared:
with the least size that keeps the number of chunks bearable (8 bytes, 20 on
average) the first common boundary of a passage comes some 50 bytes in, and 15 %
of shared passages of 51 words of three letters hold no common chunk at all.
Anchors at the smallest gear hashes keep what chunks promise (they depend on
nearby bytes alone, so insertions shift nothing) without that loss.

1. Every anchor gives a digest of its gram and one of its surroundings (all
   strings of ``least_run`` bytes that hold the gram).  Surroundings that an
   earlier document holds too are cut whole.
2. Where a gram has several surroundings, one text of each meets the others in
   one bucket, and the first document of every string in them is found by sorting
   its 128-bit key.  Grams with more than ``SPLIT`` occurrences are split: their
   surroundings by salts, the distinct strings of each salt by key ranges, so no
   task holds all surroundings of a common gram, or all places of a string.

Defined cases: null and empty texts have no anchors and stay as they are;
rows that share an id count as one document; rows without an id take no part;
a cut never splits a UTF-8 character; extra columns stay; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.llm._common import Scratch, Spans, mix64, slices

#: Content-defined chunks have 8 + about 20 bytes on average and at most 512;
#: cut_repeats does not use them.
LEAST, AVERAGE, MOST = 8, 20, 512
LEAST_RUN = 96
#: Occurrences of one gram that a task compares at once.
SPLIT = 4000
#: Bytes of surroundings compared at a time.
COMPARED_BYTES = 1 << 20
#: Anchors: grams of GRAM bytes, the least of every REACH.  GRAM + REACH <= least_run.
GRAM, REACH = 32, 64
_GEAR = np.random.default_rng(20240608).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: h = (h << 1) + gear, mod 2^32.  A hash of w
    bytes is made from two of w / 2, so five steps cover the 32-byte window."""
    h = _GEAR[data]
    width = 1
    while width < 32:
        if width >= len(h):
            break
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def boundaries(data: bytes) -> np.ndarray:
    """Chunk ends (the last is len(data)); never inside a UTF-8 character."""
    size = len(data)
    if not size:
        return np.empty(0, np.int64)
    values = np.frombuffer(data, np.uint8)
    starts = np.ones(size, bool)  # ends[i] = i + 1 is allowed before a character's first byte
    starts[:-1] = (values[1:] & 0xC0) != 0x80
    found = np.flatnonzero((gear_hashes(values) < np.uint32(2**32 // AVERAGE)) & starts) + 1
    ends: list[int] = []
    last = 0
    for end in [*found.tolist(), size]:
        while end - last > MOST:  # no boundary for long: cut at a character
            last += MOST
            while not starts[last - 1]:
                last += 1
            ends.append(last)
        if end - last >= LEAST:
            ends.append(end)
            last = end
    if last < size:
        ends.append(size)
    return np.array(ends, np.int64)


def chunks(spans: Spans, text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, ends, digests) of a text's chunks."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ends = boundaries(data)
    begins = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
    return data, begins, ends, spans(data, begins, ends).view(np.int64)


def anchors(spans: Spans, data: bytes, least_run: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, digests of the grams, digests of the grams with surroundings)
    of a text's anchors; ties of the hash go to the last gram."""
    size = len(data)
    if size < GRAM + REACH - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = gear_hashes(np.frombuffer(data, np.uint8))[GRAM - 1:].astype(np.uint64)
    last = np.uint64(2**32 - 1)
    ranked = (hashes << np.uint64(32)) | (last - np.arange(len(hashes), dtype=np.uint64))
    width = 1
    while width < REACH:
        ranked = np.minimum(ranked[:-width], ranked[width:])
        width *= 2
    at = np.unique(last - (ranked & last)).astype(np.int64)
    begins, ends = np.maximum(at + GRAM - least_run, 0), np.minimum(at + least_run, size)
    around = spans(data, begins, ends) ^ mix64((at - begins).astype(np.uint64))
    return at, spans(data, at, at + GRAM).view(np.int64), around.view(np.int64)


def digests(docs: DataFrame, least_run: int) -> DataFrame:
    """(key, around, doc_id) of every anchor of every row with distinct
    surroundings."""

    def run(batches):
        spans = Spans()
        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = []
            for i, text in zip(ids, batch.column(1).to_pylist()):
                _, keys, around = anchors(spans, _bytes(text), least_run)
                around, at = np.unique(around, return_index=True)
                found.append((keys[at], around, np.full(len(at), i, np.int64)))
            if not found:
                continue
            columns = [np.concatenate(c) for c in zip(*found)]
            for at in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 200_000], pa.int64()) for c in columns],
                                                 ["key", "around", "doc_id"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "key long, around long, doc_id long")


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def surroundings(docs: DataFrame, wanted: DataFrame, least_run: int) -> DataFrame:
    """(key, salt, ranges, doc_id, around, lead, text) of the ``wanted`` (around,
    doc_id, ranges); ``lead`` bytes of the text stand before the gram."""
    lists = wanted.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("around", "ranges")).alias("wanted"))
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        lists, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "wanted")

    def run(batches):
        spans = Spans()
        for batch in slices(batches, 64):
            rows = []
            for i, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                data, left = _bytes(text), {w["around"]: w["ranges"] for w in wanted}
                for at, key, around in zip(*(a.tolist() for a in anchors(spans, data, least_run))):
                    if (ranges := left.pop(around, None)) is not None:
                        begin = max(at + GRAM - least_run, 0)
                        rows.append((key, around % ranges, ranges, i, around, at - begin, data[begin:at + least_run]))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["key", "salt", "ranges", "doc_id", "around", "lead", "text"])

    return met.mapInArrow(run, "key long, salt int, ranges int, doc_id long, around long, lead int, text binary")


class Strings:
    """All strings of ``least_run`` bytes of some surroundings (key, doc_id,
    around, lead, text): their keys, documents, and places after the gram's."""

    def __init__(self, rows: list[tuple], spans: Spans, least_run: int):
        sizes = np.array([len(r[4]) for r in rows], np.int64)  # also of no rows: all may belong to split grams
        counts = np.maximum(sizes - least_run + 1, 0)
        of = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
        data = b"".join(r[4] for r in rows)
        gram, self.doc, self.around, lead = (np.array([r[i] for r in rows], np.int64)[of] for i in range(4))
        self.place = offset - lead
        self.keys = mix64(spans(data, at, at + least_run) + gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # the second key comes from the bytes read through another table
        self.second = spans(data.translate(_OTHER), at, at + least_run)


#: A fixed permutation of the byte values, for an independent second key.
_OTHER = bytes(np.random.default_rng(13).permutation(256).astype(np.uint8))


def _firsts(keys, second, doc) -> np.ndarray:
    """The earliest document of every string."""
    order = np.lexsort((doc, second, keys))
    first = np.empty(len(order), np.int64)
    if len(order):
        new = np.flatnonzero(_changes(keys[order], second[order]))
        first[order] = np.repeat(doc[order][new], np.diff(np.append(new, len(order))))
    return first


def _changes(*columns) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _repeated(s: Strings, known=None) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, around, first place, last place, earliest document) of the runs of
    strings that an earlier document holds too; ``known``: keys, second keys and
    documents of strings found elsewhere."""
    parts = [(s.keys, s.second, s.doc), *([known] if known else [])]
    first = _firsts(*map(np.concatenate, zip(*parts)))[:len(s.doc)]
    hit = np.flatnonzero(first < s.doc)
    hit = hit[np.lexsort((s.place[hit], s.around[hit], s.doc[hit]))]
    if not len(hit):
        return []
    d, a, p, f = s.doc[hit], s.around[hit], s.place[hit], first[hit]
    starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (p[1:] > p[:-1] + 1)]))
    last = np.concatenate([starts[1:], [len(hit)]]) - 1
    return list(zip(d[starts].tolist(), a[starts].tolist(), p[starts].tolist(), p[last].tolist(), np.minimum.reduceat(f, starts).tolist()))


#: Rows between the steps: a run that was found (its gram is the document, its part
#: -1; gathered by document in ``found`` later), a surrounding of a split gram (its
#: part is the salt, ``lo`` the lead), or the distinct strings of a key range that the
#: surroundings of one salt hold, with the earliest document of each.
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("around", "lo", "hi", "of")]))
_KINDS = {"gram": pa.int64(), "part": pa.int32(), "salt": pa.int32(), **dict.fromkeys(["doc_id", "around", "lo", "hi", "of"], pa.int64()),
          **dict.fromkeys(["keys", "second", "docs", "text"], pa.binary()), "found": _RUNS}
_STEP = ", ".join(f"{c} {({pa.int64(): 'long', pa.int32(): 'int', pa.binary(): 'binary'}).get(k, 'array<struct<around: long, lo: long, hi: long, of: long>>')}"
                  for c, k in _KINDS.items())


def _step(names: str, rows) -> pa.RecordBatch:
    """Rows of the columns ``names``; the others are null."""
    columns = dict(zip(names.split(), zip(*rows)))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(len(rows), k) for c, k in _KINDS.items()], list(_KINDS))


def _gathered(runs: list[tuple]) -> tuple[pa.Array, pa.Array]:
    """The runs of each document: its id and a list."""
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.argsort(table[:, 0], kind="stable")]
    starts = np.flatnonzero(_changes(table[:, 0]))
    found = pa.StructArray.from_arrays([pa.array(table[:, i].copy()) for i in range(1, 5)], fields=list(_RUNS.value_type))
    return pa.array(table[starts, 0]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(table)), pa.int32()), found, type=_RUNS)


def _groups(batches, limit: int):
    """Rows sorted by their first two columns, in lists that end between keys; rows
    that have ``found`` are left out, an empty list stands for them."""
    held, size, last = [], 0, None
    for batch in slices(batches):
        if "found" in batch.schema.names and batch.column("found").null_count < batch.num_rows:
            yield []
            batch = batch.filter(batch.column("found").is_null())
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:2] != last and size >= limit:
                yield held
                held, size = [], 0
            held.append(row)
            size += 64 + sum(len(x) for x in row if type(x) is bytes)
            last = row[:2]
    if held:
        yield held


def nearest(found: DataFrame, least_run: int) -> DataFrame:
    """doc_id and found: (around, lo, hi, of) of the runs of strings in a gram's
    surroundings (by their places after the gram's) that an earlier document holds,
    and the first of these documents; a task gathers what it finds of a document.

    The surroundings of a split gram are compared salt by salt.  What a salt's
    strings meet elsewhere is asked by key ranges: each salt sends a string once,
    however many of its surroundings hold it, and gets an answer where another has
    an earlier document.  So no task holds all places of a common string."""

    def compare_or_cut(batches):
        spans = Spans()
        for rows in _groups(batches, COMPARED_BYTES):
            yield _step("gram part doc_id around lo hi of", [(run[0], -1, *run) for run in _repeated(
                Strings([(r[0], *r[3:]) for r in rows if r[2] == 1], spans, least_run))])
            split: dict[tuple, list] = {}
            for r in rows:
                if r[2] > 1:
                    split.setdefault(r[:2], []).append(r)
            for (gram, salt), members in split.items():
                yield _step("gram part doc_id around lo text", [(gram, salt, *r[3:]) for r in members])
                s = Strings([(r[0], *r[3:]) for r in members], spans, least_run)
                order = np.lexsort((s.doc, s.second, s.keys))
                order = order[_changes(s.keys[order], s.second[order])]
                keys, second, doc = s.keys[order], s.second[order], s.doc[order]
                part = keys // np.uint64((1 << 64) // members[0][2] + 1)
                edges = [*np.flatnonzero(_changes(part)).tolist(), len(part)]
                yield _step("gram part salt keys second docs", [
                    (gram, int(part[i]), salt, *[x[i:j].tobytes() for x in (keys, second, doc)]) for i, j in zip(edges, edges[1:])])

    def strings(rows):
        return [np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((8, np.uint64), (9, np.uint64), (10, np.int64))]

    def compare_ranges(batches):
        for rows in _groups(batches, COMPARED_BYTES):
            ids, runs = _gathered([r[3:8] for r in rows if r[1] < 0])
            yield pa.RecordBatch.from_arrays([ids if c == "gram" else pa.array([-1] * len(ids), k) if c == "part" else runs if c == "found"
                                              else pa.nulls(len(ids), k) for c, k in _KINDS.items()], list(_KINDS))
            yield _step("gram part doc_id around lo text", [(*r[:2], *r[3:6], r[11]) for r in rows if r[11] is not None])
            asked = [r for r in rows if r[8] is not None]
            if asked:
                keys, second, doc = strings(asked)
                first = _firsts(keys, second, doc)
                ends = np.cumsum([len(r[8]) // 8 for r in asked]).tolist()
                answers = []
                for r, i, j in zip(asked, [0, *ends], ends):
                    met = np.flatnonzero(first[i:j] < doc[i:j]) + i
                    if len(met):
                        answers.append((r[0], r[2], *[x[met].tobytes() for x in (keys, second, first)]))
                yield _step("gram part keys second docs", answers)

    def finish(batches):
        spans, gathered = Spans(), []

        def read():
            for batch in batches:
                of = batch.filter(batch.column("found").is_valid())
                gathered.append(of.select(["gram", "found"]).rename_columns(["doc_id", "found"]))
                yield batch

        for rows in _groups(read(), COMPARED_BYTES):
            while gathered:
                yield gathered.pop()
            answers = [r for r in rows if r[8] is not None]
            s = Strings([(r[0], *r[3:6], r[11]) for r in rows if r[11] is not None], spans, least_run)
            yield pa.RecordBatch.from_arrays([*_gathered(_repeated(s, strings(answers) if answers else None))], ["doc_id", "found"])
        yield from gathered

    met = found.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(compare_or_cut, _STEP)
    met = met.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(compare_ranges, _STEP)
    return met.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(
        finish, "doc_id long, found array<struct<around: long, lo: long, hi: long, of: long>>")


def repeats(docs: DataFrame, scratch: Scratch, least_run: int) -> DataFrame:
    """doc_id and found: (around, lo, hi, of) of the anchors of a document whose
    strings an earlier one also holds."""
    gram, kind = Window.partitionBy("key"), Window.partitionBy("key", "around")
    # one shuffle, by gram; grams of one document are of no use
    own = (digests(docs, least_run).repartition("key").withColumn("first", F.min("doc_id").over(kind))
           .withColumn("low", F.min("doc_id").over(gram)).withColumn("high", F.max("doc_id").over(gram))
           .withColumn("kinds", F.min("around").over(gram) != F.max("around").over(gram))
           .withColumn("ranges", F.ceil(F.count("*").over(gram) / F.lit(SPLIT)).cast("int"))
           .where("low < high and (doc_id > first or kinds)").select("around", "doc_id", "first", "ranges").distinct())
    shared = scratch.save(own, "shared")
    wanted = shared.where("doc_id = first").select("around", "doc_id", "ranges")
    compared = scratch.save(nearest(surroundings(docs, wanted, least_run), least_run), "compared")
    whole = shared.where("doc_id > first").select("doc_id", F.array(F.struct(
        "around", F.lit(GRAM - least_run).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.col("first").alias("of"))).alias("found"))
    return whole.unionByName(compared).groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("found"))


def _inside(spans: Spans, data: bytes, places: np.ndarray, keys: np.ndarray, least_run: int):
    """(begin, end) of the strings around anchors that stand at least their own
    length before in the same text."""
    _, group, times = np.unique(keys, return_inverse=True, return_counts=True)
    at = places[times[group] > 1] if len(places) else places
    if not len(at):
        return []
    starts = np.unique((at[:, None] + np.arange(GRAM - least_run, 1)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts + least_run <= len(data))]
    digest = spans(data, starts, starts + least_run)
    order = np.lexsort((starts, digest))
    new = np.concatenate([[True], digest[order][1:] != digest[order][:-1]])
    first = np.empty(len(order), np.int64)
    first[order] = starts[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    again = starts[starts - first >= least_run]
    if not len(again):
        return []
    edge = np.flatnonzero(np.concatenate([[True], again[1:] > again[:-1] + 1]))
    return list(zip(again[edge].tolist(), (again[np.concatenate([edge[1:], [len(again)]]) - 1] + least_run).tolist()))


def repeat_spans(spans: Spans, text: str | None, found, own_id, least_run: int):
    """(bytes, [(begin, end, first document)]) of the runs to cut."""
    data = _bytes(text)
    places, keys, around = anchors(spans, data, least_run)
    known: dict[int, list] = {}
    for f in found or ():
        known.setdefault(f["around"], []).append(f)
    matches = [(b, e, own_id) for b, e in _inside(spans, data, places, keys, least_run)]
    for at, place in zip(places.tolist(), around.tolist()):
        for f in known.get(place, ()):
            begin, end = max(at + f["lo"], 0), min(at + f["hi"] + least_run, len(data))
            if end - begin >= least_run:
                matches.append((begin, end, f["of"]))
    runs: list[list] = []
    for begin, end, first in sorted(matches):
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
            runs[-1][2] = min(runs[-1][2], first)
        else:
            runs.append([begin, end, first])
    cut: list[tuple] = []
    for begin, end, first in runs:
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            cut.append((begin, end, first))
    return data, cut


def cut_repeats(docs: DataFrame, least_run: int = LEAST_RUN, scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs`` with the repeats cut from ``text``; adds
    has_repeat, removed_chars, spans (byte begin, end) and repeats_of (first
    document of each span)."""
    if least_run < GRAM + REACH:
        raise ValueError(f"least_run must be at least {GRAM + REACH}")
    new = T.StructType([
        T.StructField("has_repeat", T.BooleanType()), T.StructField("removed_chars", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("repeats_of", T.ArrayType(T.LongType()))])
    keep = [c for c in docs.columns if c not in (*new.names, "found")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    met = docs.join(repeats(docs, scratch or Scratch(docs.sparkSession, "substring"), least_run).withColumnRenamed("doc_id", "__id"),
                    F.col("doc_id").cast("long") == F.col("__id"), "left").select(*[docs[f"`{c}`"] for c in keep], "found")
    at = keep.index("text")

    def run(batches):
        spans = Spans()
        for batch in slices(batches):
            ids = batch.column(keep.index("doc_id")).to_pylist()
            texts, flags, removed, cut, firsts = [], [], [], [], []
            for i, text, found in zip(ids, batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist()):
                gone = []
                if i is not None:
                    data, gone = repeat_spans(spans, text, found, int(i), least_run)
                if gone:
                    edges = [0, *[e for b, e, _ in gone for e in (b, e)], len(data)]
                    kept = b"".join(data[b:e] for b, e in zip(edges[::2], edges[1::2])).decode("utf-8", "surrogatepass")
                    removed.append(len(text) - len(kept))
                    text = kept
                else:
                    removed.append(0)
                texts.append(text)
                flags.append(bool(gone))
                cut.append([[b, e] for b, e, _ in gone])
                firsts.append([f for _, _, f in gone])
            columns = [pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(flags, pa.bool_()), pa.array(removed, pa.int64()),
                 pa.array(cut, pa.list_(pa.list_(pa.int64()))), pa.array(firsts, pa.list_(pa.int64()))],
                [*keep, *new.names])

    return met.mapInArrow(run, T.StructType([*docs.schema.fields, *new.fields]))
