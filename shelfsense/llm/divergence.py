"""Source divergence audit: how the word use of each source of a language
differs from its other sources and from the language as a whole.

Terms are runs of letters A-Z (lower-cased) and non-ASCII characters.  A language
keeps the terms found in at least ``least`` of its documents; a group (language
and source) gives each kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)).

1. Document frequencies are grouped counts.  Kept terms are range sorted, which
   numbers them per language in byte order.
2. The vocabulary of a language is a minimal acyclic transducer
   (:class:`Transducer`), built from its sorted terms: equal suffix automata are
   one state, and the weights on a path add up to the term's ordinal.
   Vocabularies of more than ``BLOCK`` terms are several transducers, one per
   range of ordinals.
3. Texts stream through the transducers of their language for the counts: all
   words of a batch take their next byte together.  Texts and transducers of a
   language meet in as many partitions as the language's bytes need, so a
   language with most of the rows is split.
4. Pairs of sources are compared over blocks of ordinals; a block is a matrix of
   bounded size (terms by sources), and block sums add up.  Terms are ranked by
   value with ordinals as tie-break.  All arithmetic is on integers (decimals of
   38 digits before the division).

Null text, lang and source count as the empty string.  Repeated rows and null
ids are rows like others, an empty table gives an empty result; only text, lang
and source are read, other columns are ignored.  A text of any length is one
row; a word of any length is followed only as far as the transducer goes.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.llm._common import Scratch, slices

LEAST = 30
TOP = 50
SCALE, ADDED = 1_000_000_000, 5
#: Terms of one transducer.
BLOCK = 1 << 18
#: Cells (terms by sources) of one comparison matrix.
CELLS = 1 << 16
#: Bytes of text that meet one copy of their language's transducers.
PART_BYTES = 32 << 20
#: Bytes of text that are streamed together.
STREAM_BYTES = 2 << 20

U = np.uint64


# -------------------------------------------------------------- transducer

class Transducer:
    """Minimal acyclic transducer of sorted distinct byte strings: maps each to
    its place in the order.

    A state is a set of byte labels (256 bits) whose edges lie side by side;
    the edge of a byte is found by counting the labels below it.  The weight of
    an edge is the number of strings that come before those behind it.
    """

    FIELDS = ("labels", "below", "base", "final", "target", "weight")

    def __init__(self, labels, below, base, final, target, weight):
        self.labels, self.below, self.base = labels, below, base
        self.final, self.target, self.weight = final, target, weight

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """Incremental construction: of the path of the last term, what the next
        one leaves is closed, and a closed state that equals an earlier one (same
        finality, labels and targets) is replaced by it."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((label, state), ...))
        path: list[list] = [[False, []]]  # open states of the last term

        def close(down_to: int) -> None:
            while len(path) - 1 > down_to:
                final, edges = path.pop()
                state = (final, tuple(edges))
                number = known.setdefault(state, len(states))
                if number == len(states):
                    states.append(state)
                path[-1][1][-1] = (path[-1][1][-1][0], number)

        last = b""
        for term in terms:
            common = 0
            while common < len(last) and last[common] == term[common]:
                common += 1
            close(common)
            for byte in term[common:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            last = term
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        # states are closed before those that lead to them; the root becomes number 0
        n, total = len(states), sum(len(s[1]) for s in states)
        labels, final = np.zeros((n, 4), U), np.zeros(n, bool)
        base, target, weight = np.zeros(n, np.int64), np.zeros(total, np.int32), np.zeros(total, np.int64)
        size = [0] * n
        at = 0
        for number, (is_final, edges) in enumerate(states):
            final[number], base[number] = is_final, at
            before = int(is_final)
            for label, to in edges:
                labels[number, label >> 6] |= U(1 << (label & 63))
                target[at], weight[at] = n - 1 - to, before
                before += size[to]
                at += 1
            size[number] = before
        counts = np.bitwise_count(labels).astype(np.int16)
        below = np.cumsum(counts, axis=1, dtype=np.int16) - counts
        return cls(labels[::-1].copy(), below[::-1].copy(), base[::-1].copy(), final[::-1].copy(), target, weight)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Transducer:
        with np.load(io.BytesIO(data), allow_pickle=False) as found:
            return cls(*[found[f] for f in cls.FIELDS])

    def ordinals(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinal of each span of ``data``, -1 where it is no term."""
        out = np.full(len(begins), -1, np.int64)
        live, at, end = np.arange(len(begins)), begins, ends
        state, total = np.zeros(len(begins), np.int32), np.zeros(len(begins), np.int64)
        while len(live):
            done = at == end
            if done.any():
                hit = done & self.final[state]
                out[live[hit]] = total[hit]
                go = ~done
                live, at, end, state, total = live[go], at[go], end[go], state[go], total[go]
                if not len(live):
                    break
            byte = data[at]
            word, bit = byte >> 6, U(1) << (byte & 63).astype(U)
            there = self.labels[state, word]
            go = (there & bit) != 0
            if not go.all():
                live, at, end, state, total = live[go], at[go], end[go], state[go], total[go]
                word, bit, there = word[go], bit[go], there[go]
            edge = self.base[state] + self.below[state, word] + np.bitwise_count(there & (bit - U(1)))
            state, total, at = self.target[edge], total + self.weight[edge], at + 1
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[97:123] = True
_IN_TERM[128:] = True


def spans_of_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes lower-cased, begins, ends, text number) of all terms of ``texts``."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.diff(_IN_TERM[data].view(np.int8), prepend=np.int8(0))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
    return data, begins, ends, np.searchsorted(starts, begins, side="right") - 1


def _build(batches):
    """One transducer per (lang, block) from terms that come sorted."""
    key, terms = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()),
                                           pa.array([Transducer.build(terms).dumps()], pa.binary())], ["lang", "block", "built"])

    for batch in slices(batches, 4096):
        for lang, block, term in zip(*[c.to_pylist() for c in batch.columns]):
            if (lang, block) != key:
                if terms:
                    yield row()
                key, terms = (lang, block), []
            terms.append(term.encode("utf-8"))
    if terms:
        yield row()


def _counted(block_terms: int):
    """Rows (lang, part, block, built, source, text), a part's transducers before
    its texts: (lang, source, ordinals, counts)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinals", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def stream(lang, held, machines):
        names = sorted({source for source, _ in held})
        number = {name: k for k, name in enumerate(names)}
        data, begins, ends, of = spans_of_terms([text for _, text in held])
        source = np.array([number[s] for s, _ in held])[of]
        out = [[] for _ in names]
        for block, machine in machines:
            found = machine.ordinals(data, begins, ends)
            hit = found >= 0
            keys, counts = np.unique(source[hit] * (1 << 40) + found[hit], return_counts=True)
            cuts = np.searchsorted(keys >> 40, np.arange(len(names) + 1))
            for k in range(len(names)):
                a, b = cuts[k], cuts[k + 1]
                out[k].append(((keys[a:b] & ((1 << 40) - 1)) + block * block_terms, counts[a:b]))
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(names)), pa.array(names),
            pa.array([np.concatenate([x for x, _ in o]) for o in out], pa.list_(pa.int64())),
            pa.array([np.concatenate([x for _, x in o]) for o in out], pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        key, machines, held, size = None, [], [], 0
        for batch in slices(batches):
            for lang, part, block, built, source, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (lang, part) != key:
                    if held and machines:
                        yield stream(key[0], held, machines)
                    key, machines, held, size = (lang, part), [], [], 0
                if built is not None:
                    machines.append((block, Transducer.loads(built)))
                    continue
                held.append((source, text))
                size += len(text)
                if size >= STREAM_BYTES:
                    if machines:
                        yield stream(lang, held, machines)
                    held, size = [], 0
        if held and machines:
            yield stream(key[0], held, machines)
    return run


# -------------------------------------------------------------------- pairs

def _compare():
    """Rows (lang, block, width, source, ordinal, p) sorted by lang and block; a
    source's row without an ordinal gives its p of absent terms.  Sums of
    |p - q| over the block's terms for every ordered pair of sources."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def sums(lang, width, rows):
        absent = sorted((source, p) for source, ordinal, p in rows if ordinal is None)
        names = [s for s, _ in absent]
        number = {name: k for k, name in enumerate(names)}
        matrix = np.tile(np.array([p for _, p in absent], np.int64)[:, None], (1, width))
        seen = [(number[s], o % width, p) for s, o, p in rows if o is not None]
        if seen:
            a, b, c = map(np.array, zip(*seen))
            matrix[a, b] = c
        return names, matrix

    def run(batches):
        key, width, used, rows = None, 0, 0, []

        def flush():
            names, matrix = sums(key[0], width, rows)
            matrix = matrix[:, :used]
            for k, name in enumerate(names):
                value = np.abs(matrix - matrix[k]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key[0]] * (len(names) - 1)), pa.array([name] * (len(names) - 1)),
                    pa.array(names[:k] + names[k + 1:]), pa.array(np.delete(value, k))], schema=schema)

        for batch in slices(batches, 4096):
            for lang, block, wide, terms, source, ordinal, p in zip(*[c.to_pylist() for c in batch.columns]):
                if (lang, block) != key:
                    if rows:
                        yield from flush()
                    key, width, used, rows = (lang, block), wide, min(wide, terms - block * wide), []
                rows.append((source, ordinal, p))
        if rows:
            yield from flush()
    return run


def _share(count, total, terms):
    """p of a count, exact."""
    return F.expr(f"1 + ({SCALE}BD * (cast({count} as decimal(20,0)) + {ADDED})) div "
                  f"(cast({total} as decimal(20,0)) + {ADDED} * cast({terms} as decimal(20,0)))")


def vocabulary(texts: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """(lang, term, ordinal): the kept terms of each language, numbered from 0 in
    byte order."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.split(lowered, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", -1))
    kept = (texts.select("lang", F.explode(words).alias("term")).where("term <> ''")
            .groupBy("lang", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("lang", "term"))
    kept = scratch.save(kept, "kept")
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    place = F.monotonically_increasing_id()  # the partition, then the place in it
    ordered = scratch.save(ordered.withColumn("place", place), "ordered")
    part = F.shiftright("place", 33)
    # one row per language and partition: how many terms come before
    first = ordered.groupBy("lang", part.alias("part")).agg(F.min("place").alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = first.select("lang", "part", "least", F.coalesce(before, F.lit(0)).alias("before"))
    return ordered.withColumn("part", part).join(first, ["lang", "part"]).select(
        "lang", "term", (F.col("before") + F.col("place") - F.col("least")).alias("ordinal"))


def divergence(docs: DataFrame, scratch: Scratch, least: int = LEAST, top: int = TOP, block: int = BLOCK,
               cells: int = CELLS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the summed
    difference to each other source of the language, part ``term`` the first
    ``top`` terms that the source uses more than its language."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    words = scratch.save(vocabulary(texts, scratch, least), "words")

    # texts and transducers of a language, in as many parts as its bytes need
    bare = texts.select("lang", F.octet_length("text").cast("long").alias("bytes"))
    # a small written table, so Spark knows its size when it chooses the join
    parts = scratch.save(bare.groupBy("lang").agg(F.ceil(F.sum("bytes") / F.lit(part_bytes) + 1).cast("int").alias("parts")), "parts")
    machines = (words.select("lang", F.expr(f"ordinal div {block}").alias("block"), "term")
                .repartition("lang", "block").sortWithinPartitions("lang", "block", "term")
                .mapInArrow(_build, "lang string, block long, built binary"))
    machines = machines.join(parts, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "built",
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("binary").alias("text"))
    dealt = texts.join(parts, "lang").select("lang", F.pmod(F.xxhash64("text", "source"), F.col("parts")).cast("int").alias("part"),
                         F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("built"),
                         "source", F.col("text").cast("binary").alias("text"))
    met = machines.unionByName(dealt).repartition("lang", "part").sortWithinPartitions("lang", "part", F.col("block").asc_nulls_last())
    counted = met.mapInArrow(_counted(block), "lang string, source string, ordinals array<long>, counts array<long>")
    counts = scratch.save(
        counted.select("lang", "source", F.inline(F.arrays_zip(F.col("ordinals").alias("ordinal"), F.col("counts").alias("count"))))
        .groupBy("lang", "source", "ordinal").agg(F.sum("count").alias("count")), "counts")

    # totals: one row per language, one per group
    sizes = words.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = (texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .fillna(0, ["total", "terms"]))
    sources = Window.partitionBy("lang")
    groups = scratch.save(groups.withColumn("sources", F.count("*").over(sources))
                          .withColumn("lang_total", F.sum("total").over(sources)), "groups")
    shared = counts.join(groups, ["lang", "source"]).withColumn("p", _share("count", "total", "terms"))

    # pairs, over blocks of ordinals
    # a block gives a row per pair of sources, so it has as many terms as sources at least (up to 1,024)
    width = F.greatest(F.lit(1), F.least(F.col("terms"), F.greatest(F.expr(f"{cells} div sources"), F.least(F.col("sources"), F.lit(1024))))).cast("long")
    wide = groups.withColumn("width", width)
    absent = wide.where("terms > 0").withColumn("count", F.lit(0)).withColumn("p", _share("count", "total", "terms")).select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(terms - 1) div width"))).alias("block"), "width", "terms",
        "source", F.lit(None).cast("long").alias("ordinal"), "p")
    present = shared.withColumn("width", width).select(
        "lang", F.expr("ordinal div width").alias("block"), "width", "terms", "source", "ordinal", "p")
    cells_ = absent.unionByName(present).repartition("lang", "block").sortWithinPartitions("lang", "block")
    sums = cells_.mapInArrow(_compare(), "lang string, source string, item string, value long")
    none = wide.where("terms = 0").select("lang", "source")
    none = none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_group = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "item")))

    # terms
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("count").alias("lang_count"))
    terms = shared.join(whole, ["lang", "ordinal"]).withColumn("q", _share("lang_count", "lang_total", "terms"))
    terms = terms.where("p > q").withColumn("value", F.col("p") - F.col("q"))
    terms = (terms.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
             .join(words, ["lang", "ordinal"]).withColumnRenamed("term", "item"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
n AS (SELECT row_number() OVER () AS k, lang, source, ws FROM d),
t AS (SELECT k, lang, source, unnest(ws) AS term FROM n),
v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
vs AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN v ON t.lang = v.lang AND t.term = v.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT x.lang, x.source, coalesce(vs.v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN vs ON vs.lang = x.lang LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) s
  ON s.lang = x.lang AND s.source = x.source),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v) AS p
  FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
l AS (SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.c + 5)) // (y.n + 5 * vs.v) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term) x JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY lang) y ON y.lang = x.lang
  JOIN vs ON vs.lang = x.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y
    ON x.lang = y.lang AND x.term = y.term GROUP BY x.lang, x.source, y.source) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - l.q AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.c > 0 AND p.p > l.q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
