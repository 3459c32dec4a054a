"""Toxicity by nearest labelled examples (operator 1).

A text's vector holds the TF-IDF weights of all its words, and of the word stems
(first 4, 5 and 6 letters, recurring ones apart) that mark toxic examples.  Terms
that mark toxic examples get a share of ``MARKED`` of the vector's squared length,
all other words the rest; a text without marking terms has its words alone, so
every example is indexed on all its terms, clean ones like toxic ones.

Its nearest examples by exact cosine come from an inverted index whose columns
are cut into blocks of similar examples.  Scores of rare terms are added up from
their postings; for common terms the largest weight in a block bounds every score
in that block.  Blocks are visited in the order of their bounds, and the search
ends when no block can still change the result.  The examples found vote with
weights that fall with their distance; votes are calibrated on the examples
themselves, each scored without itself.

The index is fitted on a documented, bounded sample (``max_examples`` of the
labelled training rows and ``max_bytes`` of their texts, chosen by a hash of the
id); everything else reads whole texts of every row.

Defined cases: a null text is empty; a text without known terms gets the
calibrated rate of such examples; without any labelled example the score is 0;
several labels of one id count as the largest; equal texts among the examples
count once; neighbours tie to the smaller id; repeated rows and extra columns
stay (clashing output names are replaced).
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.llm._common import Scratch, crc_fold, give_back, slices

STEMS = (4, 5, 6)
#: A stem found at least so often in a text is a term of its own.
LEVELS = (1, 2, 3, 5)
#: Share of a vector's squared length that its marking terms have.
MARKED = 0.9
#: Terms of more than one in so many examples are common.
COMMON = 10
#: Postings of a term, from which on they are copied as a run and not picked one by one.
RUN = 256
#: Examples laid out at a time.
ROWS = 512
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None, stems: frozenset[str] | None = None, heads: frozenset[str] | None = None) -> dict[str, int]:
    """Term -> count; terms are words, and ``stem*n`` for a stem found at least
    n times.  ``stems`` limits the stems that are counted; ``heads`` are their
    first letters."""
    out: dict[str, int] = dict(Counter(_WORD.findall((text or "").lower())))
    if stems is None or stems:
        out.update(stem_terms(out.items(), stems, heads))
    return out


def stem_terms(words: Iterable[tuple[str, int]], stems: frozenset[str] | None = None, heads: frozenset[str] | None = None) -> dict[str, int]:
    """The terms that are stems of counted words, as ``terms_of`` has them."""
    found: dict[str, int] = {}
    for word, n in words:
        if heads is not None and word[:STEMS[0]] not in heads:
            continue
        for size in STEMS:
            if len(word) > size:
                stem = word[:size]
                if stems is None or stem in stems:
                    found[stem] = found.get(stem, 0) + n
    return {f"{stem}*{level}": n for stem, n in found.items() for level in LEVELS if n >= level}


class Vectors:
    """Sparse vectors, row after row: ``starts``, ``terms`` (ascending in a row)
    and ``weights``."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.starts, self.terms, self.weights = starts, terms, weights

    @classmethod
    def of(cls, rows: list[dict[int, float]]) -> Vectors:
        starts = np.cumsum([0] + [len(r) for r in rows])
        flat = [x for r in rows for x in sorted(r.items())]
        return cls(starts, np.array([t for t, _ in flat], np.int64), np.array([w for _, w in flat], float))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.terms[a:b], self.weights[a:b]


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, run after run."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class BlockMaxIndex:
    """Columns of unit vectors, cut into blocks of ``block`` examples.

    Terms of at most one in COMMON examples are kept as postings, the others as a
    dense matrix a block with the largest weight of each.
    """

    def __init__(self, vectors: Vectors | list[dict[int, float]], n_terms: int, block: int = 64):
        v = vectors if isinstance(vectors, Vectors) else Vectors.of(vectors)
        n = self.n = len(v)
        self.block, self.n_terms = block, n_terms
        frequency = np.zeros(n_terms, np.int64)
        for a in range(0, n, ROWS):
            frequency += np.bincount(v.terms[v.starts[a]:v.starts[min(a + ROWS, n)]], minlength=n_terms)
        common = np.flatnonzero(frequency > max(n // COMMON, 8))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = np.zeros((n, len(common)))
        for a in range(0, n, ROWS):
            row, at = self._entries(v, np.arange(a, min(a + ROWS, n)))
            often = self.column[v.terms[at]] >= 0
            dense[row[often] + a, self.column[v.terms[at[often]]]] = v.weights[at[often]]
        # similar examples stand together: tighter bounds
        light = np.einsum("ij,ij->i", dense, dense) < 0.5
        near = np.zeros(n, np.int64)
        if n and len(common):
            near = (dense @ dense[np.linspace(0, n - 1, min(16, n)).astype(int)].T).argmax(axis=1)
        self.order = np.lexsort((np.arange(n), near, light))
        self.blocks = -(-n // block)
        self.dense = np.zeros((self.blocks, len(common), block))
        for b in range(self.blocks):
            rows = self.order[b * block:(b + 1) * block]
            self.dense[b, :, :len(rows)] = dense[rows].T
        del dense
        self.most = self.dense.max(axis=2).T.copy()
        # postings by term, then place: some places at a time are put behind those before
        frequency[common] = 0
        self.starts = np.concatenate([[0], np.cumsum(frequency)])
        self.places, self.weights = np.empty(self.starts[-1], np.int32), np.empty(self.starts[-1])
        filled = self.starts[:-1].copy()
        for a in range(0, n, ROWS):
            row, at = self._entries(v, self.order[a:a + ROWS])
            rare = self.column[v.terms[at]] < 0
            row, at = row[rare], at[rare]
            by_term = np.argsort(v.terms[at], kind="stable")
            row, at = row[by_term], at[by_term]
            terms = v.terms[at]
            first = np.flatnonzero(np.diff(terms, prepend=-1))
            sizes = np.diff(first, append=len(terms))
            to = _within(filled[terms[first]], sizes)
            self.places[to], self.weights[to] = row + a, v.weights[at]
            filled[terms[first]] += sizes

    @staticmethod
    def _entries(v: Vectors, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of ``rows`` are in ``v``, after whose of them each is."""
        sizes = v.starts[rows + 1] - v.starts[rows]
        return np.repeat(np.arange(len(rows), dtype=np.int32), sizes), _within(v.starts[rows], sizes)

    def search(self, query, k: int, tie: np.ndarray, skip: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, example) with cosine > 0, ties to the smaller
        ``tie`` value; ``skip`` leaves one example out.  ``query``: term -> weight
        or (ascending terms, weights)."""
        if isinstance(query, dict):
            terms = np.array(sorted(query), np.int64)
            query = terms, np.array([query[t] for t in terms.tolist()], float)
        return self.search_many([query], k, tie, [skip])[0]

    def search_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, tie: np.ndarray,
                    skips: list[int] | None = None, seen: list | None = None) -> list[list[tuple[float, int]]]:
        """``search`` for several queries, whose blocks are visited together.
        ``seen`` is told how many pairs of query and block were visited."""
        m, block = len(queries), self.block
        if not m or not self.n:
            return [[] for _ in queries]
        scores = np.zeros((m, self.blocks * block))
        common = np.zeros((m, self.dense.shape[1]))
        for row, (terms, values) in enumerate(queries):
            column = self.column[terms]
            often = column >= 0
            common[row, column[often]] = values[often]
            terms, values = terms[~often], values[~often]
            lo, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
            if not size.any():
                continue
            long = size >= RUN
            runs = [slice(a, a + n) for a, n in zip(lo[long].tolist(), size[long].tolist())]
            lo, short = lo[~long], size[~long]
            at = _within(lo, short)
            added = np.concatenate([*[self.weights[r] for r in runs], self.weights[at]])
            added *= np.repeat(np.concatenate([values[long], values[~long]]), np.concatenate([size[long], short]))
            places = np.concatenate([*[self.places[r] for r in runs], self.places[at]])
            scores[row] = np.bincount(places, weights=added, minlength=scores.shape[1])
        parts = scores.reshape(m, self.blocks, block)
        bounds = parts.max(axis=2) + common @ self.most
        bounds[bounds <= 0] = -1.0
        order = np.argsort(-bounds, axis=1, kind="stable")
        visited = np.zeros((m, self.blocks), bool)
        least = np.zeros(m)
        want = k + (skips is not None)  # the example to skip may be among the best

        def visit(chosen: np.ndarray) -> None:
            """Exact scores of the chosen blocks of each query, and what they leave to beat."""
            chosen = chosen & ~visited
            for b in np.flatnonzero(chosen.any(axis=0)):
                rows = np.flatnonzero(chosen[:, b])
                parts[rows, b] += common[rows] @ self.dense[b]
            visited[chosen] = True
            for row in np.flatnonzero(chosen.any(axis=1)):
                held = parts[row, visited[row]].ravel()
                if len(held) >= want:
                    least[row] = max(least[row], np.partition(held, len(held) - want)[len(held) - want])

        reach = 2  # best bounds first, then four times as many, as long as any bound beats what was found
        while True:
            near = np.zeros((m, self.blocks), bool)
            np.put_along_axis(near, order[:, :reach], True, axis=1)
            left = (bounds > 0) & (bounds + 1e-9 >= least[:, None]) & ~visited
            if not left.any():
                break
            visit(left & near)
            reach = min(4 * reach, self.blocks)
        if seen is not None:
            seen.append(int(visited.sum()))
        out = []
        for row in range(m):
            blocks = np.flatnonzero(visited[row])
            held = parts[row, blocks]
            b, e = np.nonzero((held > 0) & (held >= least[row] - 1e-9))
            best = [(round(float(held[i, j]), 12), int(self.order[blocks[i] * block + j])) for i, j in zip(b.tolist(), e.tolist())]
            best = sorted((x for x in best if skips is None or x[1] != skips[row]), key=lambda x: (-x[0], tie[x[1]]))
            out.append(best[:k])
        return out


def _packed(a: np.ndarray) -> tuple[str, int, bytes]:
    return a.dtype.str, a.nbytes, pa.compress(np.ascontiguousarray(a).tobytes() or b"\0", codec="zstd", asbytes=True)


def _unpacked(packed: tuple[str, int, bytes]) -> np.ndarray:
    kind, size, data = packed
    return np.frombuffer(pa.decompress(data, decompressed_size=max(size, 1), codec="zstd", asbytes=True)[:size], kind)


def _lines(packed: tuple[str, int, bytes]) -> pa.Array:
    joined = _unpacked(packed).tobytes().decode()
    return pc.split_pattern(pa.array([joined] if joined else [], pa.string()), "\n").flatten()


class Numbers:
    """Numbers of names, which are held as one Arrow array and found by their
    hashes: a few bytes a name, where a dict has well over a hundred."""

    def __init__(self, names: pa.Array):
        self.names = names
        hashes = np.concatenate([np.empty(0, np.int64), *[
            self._hashes(names.slice(a, 1 << 16).to_numpy(zero_copy_only=False)) for a in range(0, len(names), 1 << 16)]])
        self.at = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.at]

    @staticmethod
    def _hashes(words: list[str] | np.ndarray) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words))

    def of(self, words: list[str]) -> np.ndarray:
        """The number of every word, -1 if it has none."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.names) or not words:
            return out
        own = self._hashes(words)
        place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        held = np.flatnonzero(self.hashes[place] == own)
        out[held] = self.at[place[held]]
        # the hash of another name: looked up in full
        same = pc.equal(self.names.take(pa.array(out[held])), pa.array([words[i] for i in held.tolist()], pa.string()))
        other = held[~same.to_numpy(zero_copy_only=False).astype(bool)]
        if len(other):
            found = pc.index_in(pa.array([words[i] for i in other.tolist()], pa.string()), value_set=self.names)
            out[other] = found.fill_null(-1).to_numpy()
        return out


def packed_examples(ids: np.ndarray, toxic: np.ndarray, found: list[list[tuple[int, int]]]) -> bytes:
    """Ids, labels and (term, count) of some examples; terms ascend in each."""
    sizes = np.array([len(f) for f in found], np.int64)
    terms, counts = (np.array([x[i] for f in found for x in f], np.int32) for i in (0, 1))
    terms = np.diff(terms, prepend=terms.dtype.type(0))
    return pickle.dumps([_packed(x) for x in (ids.astype(np.int64), toxic.astype(np.int64), sizes, terms, counts)])


@dataclass
class ToxicityModel:
    """The examples' term counts and what follows from them.  The driver holds them
    compressed only, as they go to tasks (some 10 MB for 12,000 examples); they are
    laid out where a text is scored."""

    words: tuple[str, int, bytes]  # all words of the examples and the marking stems, by line
    frequency: tuple[str, int, bytes]  # examples of each
    parts: list[bytes]  # examples, as ``packed_examples`` makes them
    chosen: list[str]  # terms that mark toxic examples
    total: int  # examples
    k: int
    bare: float  # calibrated rate of examples without known terms
    knots: tuple[np.ndarray, np.ndarray]

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @cached_property
    def numbers(self) -> Numbers:
        return Numbers(_lines(self.words))

    @property
    def names(self) -> list[str]:
        return self.numbers.names.to_pylist()

    @property
    def terms(self) -> dict[str, int]:
        return {t: j for j, t in enumerate(self.names)}

    @cached_property
    def idf(self) -> np.ndarray:
        return 1 + np.log((self.total + 1) / (_unpacked(self.frequency).astype(float) + 1))

    @cached_property
    def marked(self) -> np.ndarray:
        """Whether a term marks toxic examples."""
        out = np.zeros(len(self.numbers.names), bool)
        out[self.numbers.of(self.chosen)] = True
        return out

    @cached_property
    def stems(self) -> frozenset[str]:
        return frozenset(t.partition("*")[0] for t in self.chosen if "*" in t)

    @cached_property
    def heads(self) -> frozenset[str]:
        return frozenset(t[:STEMS[0]] for t in self.stems)

    @cached_property
    def stemmed(self) -> np.ndarray:
        """Whether a term begins as a marking stem does; the last entry, of unknown
        words, is true."""
        begins = pc.utf8_slice_codeunits(self.numbers.names, 0, STEMS[0])
        found = pc.is_in(begins, value_set=pa.array(sorted(self.heads), pa.string()))
        return np.append(found.to_numpy(zero_copy_only=False).astype(bool), True)

    @cached_property
    def _laid(self) -> tuple[np.ndarray, np.ndarray, BlockMaxIndex]:
        read = [[_unpacked(x) for x in pickle.loads(p)] for p in self.parts]
        none = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)]
        for part in read:
            part[3] = np.cumsum(part[3], dtype=np.int32)
        ids, toxic, sizes, of, counts = (np.concatenate(x) for x in zip(none, *read))
        del read
        order = np.argsort(ids, kind="stable")
        from_, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        terms, weights = np.empty_like(of), np.empty(len(of))
        for a in range(0, len(ids), ROWS):
            own = sizes[a:a + ROWS]
            at, to = _within(from_[a:a + ROWS], own), slice(starts[a], starts[a + len(own)])
            terms[to] = of[at]
            weights[to] = weights_of(of[at], counts[at], self.idf, self.marked, np.repeat(np.arange(len(own)), own), len(own))
        del of, counts
        ids, toxic = ids[order], toxic[order]
        index = BlockMaxIndex(Vectors(starts, terms, weights), len(self.numbers.names))
        del terms, weights
        give_back()
        return ids, toxic, index

    @property
    def ids(self) -> np.ndarray:  # ascending
        return self._laid[0]

    @property
    def toxic(self) -> np.ndarray:
        return self._laid[1]

    @property
    def index(self) -> BlockMaxIndex:
        return self._laid[2]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors([text])[0]

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ascending terms, weights) of every text."""
        words: list[str] = []
        times: list[int] = []
        ends = [0]
        for text in texts:
            counts = Counter(_WORD.findall((text or "").lower()))
            words += counts
            times += counts.values()
            ends.append(len(words))
        terms = self.numbers.of(words)
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        if self.stems:
            # few words can have a stem: unknown ones, and those that begin as one
            may = np.flatnonzero(self.stemmed[terms])
            cuts = np.searchsorted(may, ends).tolist()
            more: list[str] = []
            sizes = []
            for a, b in zip(cuts, cuts[1:]):
                own = stem_terms([(words[i], times[i]) for i in may[a:b].tolist()], self.stems, self.heads)
                more += own
                times += own.values()
                sizes.append(len(own))
            terms = np.concatenate([terms, self.numbers.of(more)])
            row = np.concatenate([row, np.repeat(np.arange(len(texts)), sizes)])
        n = np.array(times, float)
        order = np.argsort((row << 32) + terms)
        order = order[terms[order] >= 0]
        terms, n, row = terms[order], n[order], row[order]
        weights = weights_of(terms, n, self.idf, self.marked, row, len(texts))
        ends = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        return [(terms[a:b], weights[a:b]) for a, b in zip(ends, ends[1:])]

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        if not near:
            return None
        weights = [1 / (1.02 - c) for c, _ in near]
        return sum(w * self.toxic[i] for w, (_, i) in zip(weights, near)) / sum(weights)

    def calibrated(self, vote: float | None) -> float:
        return self.bare if vote is None else float(np.interp(vote, *self.knots))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        """(score, ids that voted, heaviest terms) of every text."""
        vectors = self.vectors(texts)
        out = []
        for (terms, weights), near in zip(vectors, self.index.search_many(vectors, self.k, self.ids)):
            heavy = terms[np.lexsort((terms, -weights))[:5]]
            out.append((self.calibrated(self.vote(near)), [int(self.ids[i]) for _, i in near], self.numbers.names.take(pa.array(heavy)).to_pylist()))
        return out


def weigh(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    """Unit TF-IDF vector of term counts."""
    terms = np.array(sorted(counts), np.int64)
    weights = weights_of(terms, np.array([counts[t] for t in terms.tolist()]), idf, np.zeros(len(idf), bool))
    return dict(zip(terms.tolist(), weights.tolist()))


def weights_of(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, marked: np.ndarray,
               row: np.ndarray | None = None, rows: int = 1) -> np.ndarray:
    """Unit TF-IDF weights of one text, or of ``rows`` of them (``row``: whose a
    term is); where a text has marking terms and others, the marking ones have the
    share MARKED of the squared length."""
    out = (1 + np.log(counts)) * idf[terms]
    special = marked[terms]
    row = np.zeros(len(terms), np.int32) if row is None else row
    square = out * out
    norms = [np.sqrt(np.bincount(row[p], weights=square[p], minlength=rows)) for p in (special, ~special)]
    both = (norms[0] > 0) & (norms[1] > 0)
    for part, norm, share in zip((special, ~special), norms, (MARKED, 1 - MARKED)):
        scale = np.divide(np.where(both, math.sqrt(share), 1.0), norm, out=np.zeros(rows), where=norm > 0)
        out[part] *= scale[row[part]]
    return out


def choose_terms(rows: list[dict[str, int]], clean: dict[str, int], n_clean: int, most: int,
                 least_gain: float = 10.0) -> list[str]:
    """Terms that mark toxic examples, best first.

    A term's gain is the weight of the toxic examples it covers times the log
    of how much more often than clean ones it does so.  Examples a chosen term
    covers count a quarter from then on, so words that merely stand beside a
    telling term (in copies of one toxic text, say) gain little.
    """
    cover: dict[str, list[int]] = {}
    for i, counts in enumerate(rows):
        for term in counts:
            cover.setdefault(term, []).append(i)
    names = sorted(cover)
    held = [np.array(cover[t], np.int64) for t in names]
    by_row: list[list[int]] = [[] for _ in rows]
    for j, own in enumerate(held):
        for i in own:
            by_row[i].append(j)
    weight = np.ones(len(rows))
    mass = np.array([float(len(own)) for own in held])
    rate = np.array([(clean.get(t, 0) + 0.5) / (n_clean + 1) for t in names])
    open_ = np.ones(len(names), bool)
    chosen: list[str] = []
    while names and len(chosen) < most:
        gain = np.where(open_, mass * np.log(np.maximum((mass + 0.5) / (len(rows) + 1) / rate, 1e-9)), -np.inf)
        j = int(np.argmax(gain))
        if gain[j] < least_gain:
            break
        chosen.append(names[j])
        open_[j] = False
        for i in held[j]:
            lost = weight[i] * 0.75
            weight[i] -= lost
            mass[by_row[i]] -= lost
    return chosen


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit (pool adjacent violators) as knots of (x, y)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, n
    for i in order:
        pools.append([float(x[i]), float(y[i]), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    # one toxic and one clean example more in every pool keep scores off 0 and 1
    return (np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools]))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_examples: int = 12_000, max_bytes: int = 64 << 20,
        most_marked: int = 512, least_rows: int = 4, k: int = 15) -> ToxicityModel:
    """Fits on labelled rows outside the held-out fold (crc32 of the id mod 5
    is 0).  ``most_marked`` terms, found in ``least_rows`` toxic examples or more,
    may mark; all other words of the examples are terms as well."""
    marked = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("toxic")).where(crc_fold(F.col("doc_id"), 5) != 0))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, size = marked.join(texts.select("doc_id", F.octet_length("text").alias("b")), "doc_id").agg(
        F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    share = min(1.0, max_examples / max(n, 1), max_bytes / max(size, 1))
    marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = (texts.join(marked, "doc_id").groupBy(F.sha2("text", 256).alias("h"))
              .agg(F.min(F.struct("doc_id", "text")).alias("d"), F.max("toxic").alias("toxic"))
              .select("d.doc_id", "d.text", "toxic"))
    sample = scratch.save(sample, "examples")

    def count(batches):
        seen: tuple[dict[str, int], dict[str, int]] = {}, {}

        def counts():
            for y in (0, 1):
                names, ns = pa.array(list(seen[y]), pa.string()), pa.array(list(seen[y].values()), pa.int64())
                none = pa.array(np.zeros(len(ns), np.int64))
                seen[y].clear()
                yield pa.RecordBatch.from_arrays([names, *((none, ns) if y else (ns, none))], ["term", "clean", "marked"])

        for batch in slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = seen[1 if y else 0]
                own[""] = own.get("", 0) + 1  # rows
                for term in terms_of(text):
                    own[term] = own.get(term, 0) + 1
            if len(seen[0]) + len(seen[1]) > 100_000:
                yield from counts()
        yield from counts()

    counted = (sample.select("text", "toxic").mapInArrow(count, "term string, clean long, marked long")
               .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("marked").alias("marked")))
    counted = scratch.save(counted, "terms")
    total = counted.where("term = ''").first()
    n_clean, n_toxic = (total.clean, total.marked) if total else (0, 0)
    # may mark: at least thrice as frequent among toxic examples
    told = counted.where(F.expr(f"term <> '' and marked >= {least_rows} and "
                                f"marked * {n_clean + 1} >= 3 * clean * {n_toxic + 1}"))
    clean = {r.term: r.clean for r in told.collect()}
    wanted = frozenset(clean)

    def gather(batches):
        for batch in slices(batches):
            found = [[t for t in terms_of(text) if t in wanted] for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["terms"])

    rows = sorted(tuple(sorted(r.terms)) for r in sample.where("toxic = 1").select("text").mapInArrow(
        gather, "terms array<string>").where("size(terms) > 0").collect())
    chosen = choose_terms([dict.fromkeys(r, 1) for r in rows], clean, n_clean, most_marked)

    # the words of the sample are bounded by its bytes
    kept = counted.where(F.expr("term <> '' and instr(term, '*') = 0") | F.col("term").isin([t for t in chosen if "*" in t]))
    kept = kept.select("term", (F.col("clean") + F.col("marked")).cast("int").alias("n")).toArrow().sort_by("term")
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), _whole(kept.column("term"))), "\n")[0]
    words = _packed(np.frombuffer(lines.as_buffer() if len(kept) else b"", np.uint8))
    frequency = _packed(kept.column("n").to_numpy())
    del kept, lines
    pa.default_memory_pool().release_unused()
    stems = frozenset(t.partition("*")[0] for t in chosen if "*" in t)

    def pack(batches):
        numbers = Numbers(_lines(words))
        for batch in slices(batches):
            toxic = batch.column(1).to_numpy()
            counts = [terms_of(text, stems) for text in batch.column(2).to_pylist()]
            found = [sorted((j, c) for j, c in zip(numbers.of(list(own)).tolist(), own.values()) if j >= 0) for own in counts]
            del counts
            empty = np.array([not f for f in found], bool)
            yield pa.RecordBatch.from_pydict({"empty": [int(empty.sum())], "toxic": [int(toxic[empty].sum())],
                                              "part": [packed_examples(batch.column(0).to_numpy(), toxic, found)]})

    parts = sample.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(
        pack, "empty long, toxic long, part binary").collect()
    total, n_empty = n_clean + n_toxic, sum(p.empty for p in parts)
    bare = (float(sum(p.toxic for p in parts)) + 0.5) / (n_empty + 1) if n_toxic else 0.0
    if n_toxic and not n_empty:
        bare = (n_toxic + 0.5) / (total + 1)  # none to learn from: the rate of all examples
    model = ToxicityModel(words, frequency, [bytes(p.part) for p in parts], chosen, total, k, bare, (np.array([0.0]), np.array([0.0])))
    del parts
    calibrate(model, sample)
    scratch.drop()
    return model


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([*column.chunks, pa.array([], column.type)])


def calibrate(model: ToxicityModel, sample: DataFrame) -> None:
    """Knots from the examples (doc_id, text), each scored without itself in a task."""

    def votes(batches):
        for batch in slices(batches):
            at = np.searchsorted(model.ids, batch.column(0).to_numpy())
            near = model.index.search_many(model.vectors(batch.column(1).to_pylist()), model.k, model.ids, at.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([model.vote(n) for n in near], pa.float64()),
                                              pa.array(model.toxic[at], pa.int64())], ["id", "vote", "toxic"])

    found = sorted((r.id, r.vote, r.toxic) for r in sample.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        votes, "id long, vote double, toxic long").where("vote is not null").collect()) if model.parts else []
    if found:
        model.knots = isotonic(np.array([v for _, v, _ in found]), np.array([y for _, _, y in found], float))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds score, predicted, neighbours (ids of the examples that voted) and
    evidence (the heaviest known terms) to every row."""
    new = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                        T.StructField("neighbours", T.ArrayType(T.LongType())),
                        T.StructField("evidence", T.ArrayType(T.StringType()))])
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new.names])

    def run(batches):
        for batch in slices(batches):
            made = model.score(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made], pa.float64()),
                 pa.array([int(m[0] >= 0.5) for m in made], pa.int32()),
                 pa.array([m[1] for m in made], pa.list_(pa.int64())),
                 pa.array([m[2] for m in made], pa.list_(pa.string()))], [*batch.schema.names, *new.names])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, *new.fields]))
