"""SentencePiece encoding and decoding with source offsets (operator 9).

The model file is read directly: pieces and scores, the normaliser's flags and
its compiled character map (a double-array trie over UTF-8 bytes).  A text is
normalised by longest-prefix lookups in that map, and every normalised byte
keeps the source byte it came from; the merges then run on the normalised text
and every piece is projected back to a byte span of the source.

No piece of a usual vocabulary holds a space mark after another character, so
merges never cross from one word into the next; words are then encoded one by
one and remembered per task (``remember`` entries at most).  A vocabulary with
such pieces is encoded as one run of symbols.

Defined cases: a null text is empty; an empty text has only the end id; text
that is not in the vocabulary falls back to byte pieces; rows are never
dropped, repeated rows give repeated results; extra columns pass through the
DataFrame operator untouched unless they clash with its output names, which
then win.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.llm._common import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        elif kind == 5:
            value, at = struct.unpack("<f", data[at:at + 4])[0], at + 4
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


class CharacterMap:
    """The compiled character map: longest prefix -> replacement bytes."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, source bytes taken) of the longest key at ``at``."""
        if not self.units:
            return None
        units = self.units
        node = self._offset(units[0])
        found = None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if not found:
            return None
        begin, taken = found
        return self.strings[begin:self.strings.index(b"\0", begin)], taken

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Encoding(NamedTuple):
    ids: list[int]
    pieces: list[str]
    spans: np.ndarray  # (n, 2) source byte offsets; the end id has an empty span


#: ids (int32), source bytes of each piece (int32; a mark is one byte), decoded
#: text of one word; a plain tuple, which the garbage collector need not follow.
_Word = tuple[bytes, bytes, str]


class PieceCodec:
    """Encoder and decoder of one model file (BPE models)."""

    def __init__(self, model: bytes, remember: int = 150_000):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in self.pieces) or trainer.get(24, 0):
            raise ValueError("user-defined or unused pieces and suffix marks are not supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.map = CharacterMap(normalizer.get(2, b""))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        self.vocabulary = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        # pieces of equal score share a rank
        places = {score: r for r, score in enumerate(sorted({self.pieces[i][1] for i in self.vocabulary.values()}, reverse=True))}
        self.rank = {p: places[self.pieces[i][1]] for p, i in self.vocabulary.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.end = next(i for i, (p, _, kind) in enumerate(self.pieces) if kind == CONTROL and p == "</s>")
        self.word_by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.vocabulary)
        #: Texts without a literal mark then need no character-by-character pass.
        self.plain = not self.map.units and not self.squeeze and self.escape and self.dummy_prefix and self.word_by_word
        self.of_point = np.full(0x110000, -1, np.int32)
        pairs: dict[int, int] = {}
        for piece, i in self.vocabulary.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = i
            for cut in range(1, len(piece)):
                left, right = self.vocabulary.get(piece[:cut]), self.vocabulary.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * len(self.pieces) + right] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.pair_ranks = np.array([self.rank[self.pieces[i][0]] for i in self.pair_ids.tolist()], np.int32)
        self.source_bytes = np.array([len(p.replace(MARK, " ").encode()) for p, _, _ in self.pieces], np.int32)
        # a line end that is in no piece never merges with its neighbours
        line = "" if any("\n" in p for p in self.vocabulary) else "\n"
        self.runs = re.compile(rf" +[^ {line}]*|[^ {line}]+" + (r"|\n" if line else ""))
        self.words = _Words(self, remember)
        self.names = [str(i) for i in range(len(self.pieces))]

    # -- normalisation

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and, for each of its bytes and its end, the source
        byte offset."""
        source = text.encode("utf-8", "surrogatepass")
        out, origin = bytearray(), []
        mark = MARK.encode() if self.escape else b" "

        def emit(piece: bytes, at: int) -> None:
            out.extend(piece)
            origin.extend([at] * len(piece))

        at, size = 0, len(source)

        def chunk(at: int) -> tuple[bytes, int]:
            if found := self.map.longest(source, at):
                return found
            first = source[at]
            n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            return source[at:at + n], n

        if self.squeeze:  # spaces at the start go
            while at < size:
                piece, taken = chunk(at)
                if piece.strip(b" "):
                    break
                at += taken
        if at >= size:
            return b"", np.array([size], np.int64)
        if self.dummy_prefix:
            emit(mark, at)
        after_space = self.squeeze
        while at < size:
            piece, taken = chunk(at)
            if self.squeeze and after_space:
                piece = piece.lstrip(b" ")
            for i in range(len(piece)):
                emit(mark if piece[i:i + 1] == b" " else piece[i:i + 1], at)
            if piece:
                after_space = piece.endswith(b" ")
            at += taken
            if not self.squeeze:
                after_space = False
        end = size
        if self.squeeze:
            while out.endswith(mark):
                end = origin[-len(mark)]
                del out[-len(mark):], origin[-len(mark):]
        return bytes(out), np.array([*origin, end], np.int64)

    # -- merges

    def merge(self, text: str) -> list[str]:
        """Pieces of normalised text: the best-scored adjacent pair is merged,
        the leftmost first among equals, until none is in the vocabulary."""
        if len(text) > 128:
            return self._merge_long(text)
        rank, none = self.rank.get, len(self.pieces)
        parts = list(text)
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same with a heap of pairs and linked symbols."""
        symbols = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, str]] = []
        rank = self.rank

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                joined = symbols[left] + symbols[right]
                if (r := rank.get(joined)) is not None:
                    heapq.heappush(agenda, (r, left, joined))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, joined = heapq.heappop(agenda)
            right = after[left]
            if not symbols[left] or right >= n or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [s for s in symbols if s]

    def merge_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of many short words at once, the ids in one
        array; a word with characters outside the vocabulary has none.  All
        words take their next merge together, as rows of a matrix."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        points = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(words)), sizes)
        symbols = np.full((len(words), width), -1, np.int32)
        symbols[row, np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = self.of_point[points]
        counts = sizes.copy()
        counts[np.unique(row[self.of_point[points] < 0])] = 0
        none = np.iinfo(np.int32).max

        def look(left, right):
            key = left.astype(np.int64) * len(self.pieces) + right
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
            return np.where(hit, self.pair_ranks[at], none), self.pair_ids[at]

        live = np.flatnonzero(counts > 1)
        now = symbols[live]
        ranks, joined = look(now[:, :-1], now[:, 1:])
        columns = np.arange(width)
        while len(live):
            best = ranks.argmin(axis=1)
            each = np.arange(len(live))
            going = ranks[each, best] < none
            if not going.all():
                stop = ~going
                symbols[live[stop]] = now[stop]
                live, now, ranks, joined, best = live[going], now[going], ranks[going], joined[going], best[going]
                each = np.arange(len(live))
                if not len(live):
                    break
            made = joined[each, best]
            # the merged symbol takes its pair's place; what follows moves up
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            now = np.take_along_axis(now, source, 1)
            now[:, -1] = -1
            now[each, best] = made
            source = source[:, :-1] if width > 1 else source
            wide = np.concatenate([ranks, np.full((len(live), 1), none, ranks.dtype)], 1)
            ranks = np.take_along_axis(wide, source, 1)
            joined = np.take_along_axis(np.concatenate([joined, joined[:, -1:]], 1), source, 1)
            counts[live] -= 1
            for left in (best - 1, best):
                ok = (left >= 0) & (left < width - 1)
                r, j = look(now[each[ok], left[ok]], now[each[ok], left[ok] + 1])
                ranks[each[ok], left[ok]], joined[each[ok], left[ok]] = r, j
        return symbols[columns < counts[:, None]], counts

    def read(self, texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[str | None, list[str] | None]]:
        """Every text with its words, which are remembered by then (None where it
        is not encoded word by word); ``most`` characters are held as words at once."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
                size += len(texts[end] or "")
                end += 1
            yield from zip(texts[at:end], self.learn(texts[at:end]))
            at = end

    def learn(self, texts: list[str | None]) -> list[list[str] | None]:
        """Encodes the words of many texts that are not remembered yet; the words
        of each text.  Words of these texts stay when the others are forgotten."""
        if not self.plain:
            return [None] * len(texts)
        known = self.words
        runs = [self.runs.findall(" " + t) if t and MARK not in t else None for t in texts]
        here = set().union(*[r for r in runs if r])
        fresh = sorted([w for w in here if w not in known and len(w) <= 32], key=len)
        if len(known) + len(fresh) > known.remember:
            stay = {w: known[w] for w in here if w in known}
            known.clear()
            known.update(stay)
        at = 0
        while at < len(fresh):
            part = fresh[at:at + 8_000]
            at += len(part)
            ids, counts = self.merge_many(part)
            lengths = self.source_bytes[ids].tobytes()
            ids = ids.tobytes()
            ends = (np.cumsum(counts) * 4).tolist()
            begin = 0
            for word, end in zip(part, ends):
                if end > begin:
                    known[word] = ids[begin:end], lengths[begin:end], word
                begin = end
        return runs

    def _ids(self, piece: str) -> list[int]:
        if (i := self.vocabulary.get(piece)) is not None:
            return [i]
        if self.byte_fallback:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    # -- the public pair

    def encode(self, text: str | None) -> Encoding:
        """Ids, pieces and source byte spans, with the end id."""
        text = text or ""
        normalized, origin = self.normalize(text)
        shown = normalized.decode("utf-8", "surrogatepass")
        runs = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", shown) if self.word_by_word else [shown]
        ids, pieces, cuts, at = [], [], [], 0
        for run in runs:
            last_unknown = False
            for piece in self.merge(run):
                size = len(piece.encode("utf-8", "surrogatepass"))
                own = self._ids(piece)
                if len(own) > 1 or own[0] in self.byte_of:
                    # the bytes of one character share its source span: all but
                    # the last are empty at its begin
                    for k, i in enumerate(own):
                        ids.append(i)
                        pieces.append(self.pieces[i][0])
                        cuts.append((at, at if k < len(own) - 1 else at + size))
                elif own[0] == self.unknown and last_unknown:
                    pieces[-1] += piece
                    cuts[-1] = cuts[-1][0], at + size
                else:
                    ids.append(own[0])
                    pieces.append(piece)
                    cuts.append((at, at + size))
                last_unknown = own[0] == self.unknown
                at += size
        spans = origin[np.array(cuts, np.int64).reshape(-1, 2)]
        last = len(text.encode("utf-8", "surrogatepass"))
        return Encoding([*ids, self.end], [*pieces, self.pieces[self.end][0]], np.vstack([spans, [[last, last]]]))

    def decode(self, ids) -> str:
        out: list[str] = []
        pending = bytearray()
        started = False

        def flush() -> None:
            while pending:
                try:
                    out.append(pending.decode())
                    pending.clear()
                except UnicodeDecodeError as error:
                    out.append(pending[:error.start].decode() + "�")
                    del pending[:error.start + 1]

        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                pending.append(self.byte_of[i])
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_text)
                continue
            if not started and not any(out) and (self.dummy_prefix or self.squeeze) and piece.startswith(MARK):
                piece = piece[1:]
                started = not self.squeeze
            out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)

    def arrays(self, text: str | None, runs: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """(ids, span begins, span ends, decoded text) of one whole text, word
        by word where the model and the text allow it (``runs``: its words, if
        they are known)."""
        text = text or ""
        if self.plain and text and MARK not in text:
            words = list(map(self.words.__getitem__, runs or self.runs.findall(" " + text)))
            ids = np.frombuffer(b"".join([w[0] for w in words]) + np.int32(self.end).tobytes(), np.int32)
            # the space put before the text has no source byte
            edges = np.cumsum(np.frombuffer(b"".join([w[1] for w in words]), np.int32), dtype=np.int32) - 1
            ends = np.append(edges, edges[-1])
            begins = np.concatenate([np.zeros(1, np.int32), edges])
            return ids, begins, ends, "".join([w[2] for w in words])[1:]
        made = self.encode(text)
        spans = made.spans.astype(np.int32)
        return np.array(made.ids, np.int32), spans[:, 0], spans[:, 1], self.decode(made.ids)

    def digest(self, text: str | None, runs: list[str] | None = None) -> tuple[int, str, str, str]:
        """(number of ids, digest of the ids, digest of the decoded text,
        digest of the span begins as int32) of one whole text."""
        ids, begins, _, decoded = self.arrays(text, runs)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return (len(ids), sha(" ".join(map(self.names.__getitem__, ids.tolist())).encode()),
                sha(decoded.encode("utf-8", "surrogatepass")), sha(begins.tobytes()))


class _Words(dict):
    """Encoded words (leading spaces included), at most ``remember`` of them."""

    def __init__(self, codec: PieceCodec, remember: int):
        super().__init__()
        self.codec, self.remember = codec, remember

    def __missing__(self, word: str) -> _Word:
        codec = self.codec
        parts = codec.merge(word.replace(" ", MARK))
        try:
            ids = [codec.vocabulary[p] for p in parts]
            lengths = map(len, parts) if word.isascii() else [
                len(p.replace(MARK, " ").encode("utf-8", "surrogatepass")) for p in parts]
            decoded = word
        except KeyError:  # characters outside the vocabulary
            ids, lengths = [], []
            for piece in parts:
                own = codec._ids(piece)
                ids += own
                lengths += [0] * (len(own) - 1) + [len(piece.replace(MARK, " ").encode("utf-8", "surrogatepass"))]
            # decode() drops the mark at the start of a text; one more keeps it here
            decoded = codec.decode([codec.vocabulary[MARK], *ids])
        made = array("i", ids).tobytes(), array("i", lengths).tobytes(), decoded
        if len(word) <= 64:
            if len(self) >= self.remember:
                self.clear()
            self[word] = made
        return made


def encode_documents(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Adds ids, span_begins and span_ends (source byte offsets of every id)
    and the decoded text to every row; all other columns pass through."""
    ints = T.ArrayType(T.IntegerType())
    new = T.StructType([T.StructField("ids", ints), T.StructField("span_begins", ints),
                        T.StructField("span_ends", ints), T.StructField("decoded", T.StringType())])
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c not in new.names])

    def lists(arrays):
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*arrays, []]), pa.int32()))

    def run(batches):
        codec = PieceCodec(model)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            rows = [codec.arrays(t, r) for t, r in codec.read(texts)]
            made = [lists([r[i] for r in rows]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array([r[3] for r in rows], pa.string())],
                                             [*batch.schema.names, *new.names])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *new.fields]))


def digest_documents(docs: DataFrame, model: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of every
    row; encodes and decodes as :func:`encode_documents` does and keeps only
    the digests, so whole token lists never leave the task."""

    def run(batches):
        codec = PieceCodec(model)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            n, ids, decoded, spans = zip(*[codec.digest(t, r) for t, r in codec.read(texts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def read_model(path: str) -> bytes:
    """The model file's bytes, read once on the driver and shipped with the
    tasks (a vocabulary file, bounded by its own size)."""
    with open(path, "rb") as file:
        return file.read()
