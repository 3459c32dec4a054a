"""Fill-in-the-middle transformation with a wavelet matrix.

A text is cut at two boundaries into prefix, middle and suffix and written in
one of three forms: ``plain`` (the text itself), ``psm`` (prefix, suffix,
middle) or ``spm`` (suffix, prefix, middle), with the marks ``<P>``, ``<S>``
and ``<M>``.  The cuts and the form come from a digest of the document's id, so
they do not depend on partitioning.

Whole texts of a batch are laid end to end as bytes, and every byte gets a
class: continuation byte, first byte of a word's first character, of another
character of a word, of a blank, of a line break.  A :class:`WaveletMatrix` over
these classes answers rank queries (how many bytes of a class stand before a
place); ranks of several classes add up to boundary counts (characters: all
classes but continuation; words: first characters of words; lines: line breaks),
and bisection on them finds the place of a boundary for all texts at once.

Null texts count as empty; empty texts, and texts that hold a mark, stay plain.
A null id counts as the empty string.  Rows are independent: repeated rows give
repeated results, an empty table an empty one.  Only ``doc_id`` and ``text``
are read, other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.llm._common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of those in spm form.
TRANSFORMED, SPM = 90, 20
#: Bytes of texts that share one matrix; a longer text has its own.
BATCH_BYTES = 4 << 20

CONTINUATION, WORD_START, WORD, BLANK, BREAK = range(5)
#: Classes whose ranks add up to the number of units that start before a place.
UNITS = {"char": (WORD_START, WORD, BLANK, BREAK), "word": (WORD_START,), "line": (BREAK,)}
_BITS = 3


class WaveletMatrix:
    """Ranks over an array of small numbers: one bit vector a level, the highest
    bit first; after a level the zeros stand before the ones, in their order."""

    def __init__(self, values: np.ndarray, bits: int = _BITS):
        self.n, self.bits = len(values), bits
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(bits)):
            bit = (values >> level) & 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            ones = bit.view(bool)
            zeros = values[~ones]
            self.zeros.append(len(zeros))
            values = np.concatenate([zeros, values[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << inside) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(below)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each place of ``at``."""
        begin, at = np.zeros(1, np.int64), at.astype(np.int64)
        for level in range(self.bits):
            if (value >> (self.bits - 1 - level)) & 1:
                begin = self.zeros[level] + self._ones(level, begin)
                at = self.zeros[level] + self._ones(level, at)
            else:
                begin = begin - self._ones(level, begin)
                at = at - self._ones(level, at)
        return at - begin


def byte_classes(data: bytes, begins: np.ndarray) -> np.ndarray:
    """Class of every byte of texts that start at ``begins``."""
    array = np.frombuffer(data, np.uint8)
    classes = _CLASS[array]
    after = np.empty(len(array), bool)  # the byte before is a blank or break, or there is none
    after[1:] = classes[:-1] >= BLANK
    after[begins[begins < len(array)]] = True
    classes[after & (classes == WORD)] = WORD_START
    return classes


_CLASS = np.full(256, WORD, np.uint8)
_CLASS[0x80:0xC0] = CONTINUATION
_CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
_CLASS[0x0A] = BREAK


class Texts:
    """A batch of texts under one matrix."""

    def __init__(self, texts: list[bytes], unit: str):
        self.data = b"".join(texts)
        sizes = np.array([len(x) for x in texts], np.int64)
        self.begins, self.ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        self.classes = UNITS[unit]
        self.matrix = WaveletMatrix(byte_classes(self.data, self.begins))

    def boundaries(self, at: np.ndarray) -> np.ndarray:
        """Units that start before each place (over the whole batch)."""
        return sum(self.matrix.rank(c, at) for c in self.classes)

    def units(self) -> np.ndarray:
        return self.boundaries(self.ends) - self.boundaries(self.begins)

    def place(self, unit: np.ndarray) -> np.ndarray:
        """Per text the first byte that has ``unit`` units before it and starts
        one itself, or the text's end: bisection on the ranks."""
        base = self.boundaries(self.begins) + unit
        low, high = self.begins.copy(), self.ends.copy()  # the most places with at most ``unit`` units before them
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            fits = self.boundaries(middle) <= base
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)


def _transformed(unit: str):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(rows):
        texts = Texts([r[1] for r in rows], unit)
        n = texts.units()
        a, b = (np.array([r[k] for r in rows], np.int64) % (n + 1) for k in (2, 3))
        first, second = np.minimum(a, b), np.maximum(a, b)
        x, y = texts.place(first) - texts.begins, texts.place(second) - texts.begins
        out = []
        for (doc_id, text, _, _, form), units, p, m, i, j in zip(
                rows, n.tolist(), first.tolist(), (second - first).tolist(), x.tolist(), y.tolist()):
            if not text or any(mark in text for mark in marks):
                form = "plain"
            if form == "plain":
                out.append((doc_id, units, form, None, None, text))
                continue
            prefix, middle, suffix = text[:i], text[i:j], text[j:]
            parts = (prefix, marks[1], suffix) if form == "psm" else (suffix, marks[0], prefix)
            opening = marks[0] if form == "psm" else marks[1]
            out.append((doc_id, units, form, p, m, b"".join([opening, *parts, marks[2], middle])))
        return out

    def run(batches):
        for batch in slices(batches):
            held, size = [], 0
            columns = [c.to_pylist() for c in batch.columns]
            id_type = batch.schema.field(0).type

            def flush(rows):
                out = cut(rows)
                return pa.RecordBatch.from_arrays([
                    pa.array([x[i] for x in out], t)
                    for i, t in enumerate([id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()])],
                    ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

            for row in zip(*columns):
                if held and size + len(row[1]) > BATCH_BYTES:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
            if held:
                yield flush(held)
    return run


def drawn(seed: str = "1") -> list[Column]:
    """The four numbers of a document: the first 8-digit groups of the hex
    sha256 of the seed, a colon and the id, unsigned."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: str = "1", unit: str = "char", transformed: int = TRANSFORMED,
              spm: int = SPM) -> DataFrame:
    """Per document: doc_id, n (its units), form, prefix_units and middle_units
    (null if plain) and ``output``.  ``unit``: char (code points), word or line."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    h1, h2, h3, h4 = drawn(seed)
    form = F.when(h3 % 100 >= transformed, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), h1, h2, form)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(_transformed(unit), f"doc_id {id_type}, n long, form string, prefix_units long, "
                                               "middle_units long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from.  Texts with marks stay plain, so
    an output in another form holds exactly three."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return (F.when(F.col(form) == "psm", F.concat(piece(1), piece(3), piece(2)))
            .when(F.col(form) == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(F.col(output)))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
  CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, x) AS pre, substring(t, x + 1, y - x) AS mid, substring(t, y + 1, n - y) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
