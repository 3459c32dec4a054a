"""Language identification by a byte convolutional network (operator 2).

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes that cover all of
it.  Each byte is embedded; filters two, three and four bytes wide slide over
a window, the largest response of each filter is kept, and a linear layer with
softmax gives the languages' probabilities.  A text's log-probabilities are
the mean over its windows, weighted by their bytes.

The network is trained in NumPy (Adam, cross entropy) on a bounded sample of
the labelled rows: ``per_language`` texts a language, chosen by a hash of the
id, and ``windows_each`` evenly spread windows of each.  Prediction reads whole
texts of every row.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without labelled rows every text is; a null language is not learned; ties go to
the first language by name; repeated rows and extra columns stay (clashing
output names are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.llm._common import crc_fold, slices

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 6
_WIDEST = max(WIDTHS)


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L is in the text."""
    return any(map(str.isalpha, text))


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray    # (256, EMBED); byte 0 pads and is zero
    filters: np.ndarray  # (_WIDEST * EMBED, len(WIDTHS) * FILTERS), zero beyond a filter's width
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest response of each filter, unrolled bytes) of (n, WINDOW)."""
        x = self.embed[windows]
        n, size, _ = x.shape
        steps = size - _WIDEST + 1
        rows = np.concatenate([x[:, k:k + steps] for k in range(_WIDEST)], axis=2)
        return (rows.reshape(n * steps, -1) @ self.filters).reshape(n, steps, -1), rows

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), 64):
            response, _ = self.pooled(windows[at:at + 64])
            hidden = np.maximum(response.max(axis=1) + self.shift, 0)
            scores = hidden @ self.out + self.bias
            scores -= scores.max(axis=1, keepdims=True)
            out.append(scores - np.log(np.exp(scores).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)), np.float32)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """((n, WINDOW) bytes, number of bytes in each) of a whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = data
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), sizes


def train(windows: np.ndarray, targets: np.ndarray, languages: list[str], epochs: int = 8, batch: int = 64,
          rate: float = 0.004, seed: int = 7) -> ByteNet:
    rng = np.random.default_rng(seed)
    count = len(WIDTHS) * FILTERS
    mask = np.zeros((_WIDEST * EMBED, count), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width * EMBED, i * FILTERS:(i + 1) * FILTERS] = 1
    normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    net = ByteNet(languages, normal(256, EMBED, by=0.5), normal(_WIDEST * EMBED, count, by=0.3) * mask,
                  np.zeros(count, np.float32), normal(count, len(languages), by=0.3), np.zeros(len(languages), np.float32))
    net.embed[0] = 0
    names = ("embed", "filters", "shift", "out", "bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x = windows[pick].copy()
            # short texts occur too: a third of the windows lose their end
            short = rng.random(len(x)) < 0.33
            keep = np.where(short, rng.integers(8, WINDOW, len(x)), WINDOW)
            x[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
            y = targets[pick]
            n = len(x)
            response, rows = net.pooled(x)
            best = response.argmax(axis=1)  # (n, filters)
            top = np.take_along_axis(response, best[:, None], 1)[:, 0] + net.shift
            hidden = np.maximum(top, 0)
            scores = hidden @ net.out + net.bias
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            back = (p @ net.out.T) * (top > 0)
            seen = rows[np.arange(n)[:, None], best]  # (n, filters, _WIDEST * EMBED)
            gradient = {"out": hidden.T @ p, "bias": p.sum(axis=0), "shift": back.sum(axis=0),
                        "filters": np.einsum("nf,nfw->wf", back, seen) * mask, "embed": np.zeros_like(net.embed)}
            spread = (back[:, :, None] * net.filters.T[None]).reshape(n, count, _WIDEST, EMBED)
            for k in range(_WIDEST):
                np.add.at(gradient["embed"], x[np.arange(n)[:, None], best + k], spread[:, :, k])
            gradient["embed"][0] = 0
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k in names:
                g = gradient[k].astype(np.float32)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                change = (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - pace * change).astype(np.float32))
    return net


def fit(docs: DataFrame, per_language: int = 500, windows_each: int = 4) -> ByteNet | None:
    """Trains on rows with a language outside the held-out fold (crc32 of the
    id mod 4 is 2)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                      & (crc_fold(F.col("doc_id"), 4) != 2))
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, per_language / n) * 1_000_000))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text")

    def run(batches):
        for batch in slices(batches):
            langs, pieces = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    windows, _ = windows_of(text)
                    for i in np.unique(np.linspace(0, len(windows) - 1, windows_each).astype(int)):
                        langs.append(lang)
                        pieces.append(windows[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], ["lang", "window"])

    sample = sorted((r.lang, bytes(r.window)) for r in chosen.mapInArrow(run, "lang string, window binary").collect())
    if not sample:
        return None
    windows = np.frombuffer(b"".join(w for _, w in sample), np.uint8).reshape(-1, WINDOW)
    targets = np.array([languages.index(lang) for lang, _ in sample])
    return train(windows, targets, languages)


def predict(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(language, score) of every text; windows of many texts share a batch."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    told = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
    at = 0
    while at < len(told):
        held, windows, sizes, total = [], [], [], 0
        while at < len(told) and total < 2048:
            w, s = windows_of(texts[told[at]])
            held.append(told[at])
            windows.append(w)
            sizes.append(s)
            total += len(w)
            at += 1
        logs = net.log_probabilities(np.concatenate(windows)).astype(np.float64)
        weight = np.concatenate(sizes).astype(np.float64)
        starts = np.cumsum([0, *[len(w) for w in windows[:-1]]])
        mean = np.add.reduceat(logs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, j, row in zip(held, p.argmax(axis=1), p):
            names[i], scores[i] = net.languages[j], float(row[j])
    return names, scores


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Adds lang_pred and score to every row."""
    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new.names])

    def run(batches):
        for batch in slices(batches):
            names, scores = predict(net, batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names, *new.names])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, *new.fields]))
