"""Repeated bytes, fill-in-the-middle and source divergence: brute force, the
data structures by definition, and defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from shelfsense.llm import divergence, middle, registry, suffixes
from shelfsense.llm._common import Scratch, Spans

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long, form string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, None, None), (None, "some words here and there", "en", None), (0, "", "en", "a"), (0, "", "en", "a"),
            (3, "  \t\n", "en", "a"), (5, "word " * 30_000, None, "a"), (7, "x" * 1_200_000, "en", None), (8, "文字é " * 300, "zh", "b"),
            (9, "文字é " * 300, "zh", "b"), (10, "has <S> inside", "en", "b"), (11, "a\0b" * 200, "en", "c"), (12, "a\0b" * 200, "en", "")]
    return spark.createDataFrame([(i, t, lang, source, 1, "x", 2, "y", 3) for i, t, lang, source in rows], ODD)


# ------------------------------------------------------------------ suffixes

def _shuffled_texts(rng, alphabet, n=120):
    base = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < .5:
                b, at = rng.choice(base), rng.randint(0, 40)
                parts.append(b[at:at + rng.randint(5, 40)])
            else:
                parts.append("".join(rng.choice(alphabet + "é") for _ in range(rng.randint(0, 30))))
        texts.append("".join(parts))
    return texts


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for alphabet in ("a", "ab", "abcdefgh"):
        text = "".join(rng.choice(alphabet) for _ in range(700)).encode() + b"abab" * 30 + suffixes.END
        data = np.frombuffer(text, np.uint8)
        order, _ = suffixes.suffix_array(data, 64)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for lane in (7, 512):
            prefix = suffixes.common_prefixes(data, order, np.arange(len(text)), 64, lane)
            for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
                common = 0
                while common < 64 and max(a, b) + common < len(text) and text[a + common] == text[b + common]:
                    common += 1
                assert prefix[b] == common


def test_anchors_are_leftmost_minima():
    hashes = np.random.default_rng(2).integers(0, 6, 300).astype(np.uint64) << np.uint64(40)
    found = suffixes.anchors(hashes, 30, 12)
    for s, at in enumerate(found.tolist()):
        window = hashes[s:s + 19]
        assert at == s + int(np.argmin(window))


def test_runs_merge_by_binary_search():
    rng = np.random.default_rng(4)
    runs, place = [], 0
    for size in (0, 1, 50, 7, 200, 33):
        keys = np.sort(rng.integers(0, 150, size).astype(np.uint64))
        runs.append((keys, keys % np.uint64(7), np.arange(place, place + size)))
        place += size
    keys = np.concatenate([r[0] for r in runs])
    counts = Counter(keys.tolist())
    hits = suffixes.merge_runs(runs)
    # of equal keys one place may stand for the others it was merged with, but none that repeats is missed
    assert set(keys[hits].tolist()) == {k for k, n in counts.items() if n > 1}
    assert sorted(hits.tolist()) == [i for i, k in enumerate(keys.tolist()) if counts[k] > 1]


def _removed(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(t, gone) if not x)
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, kept))
    return out


@pytest.mark.parametrize("alphabet,length,gram,split", [("ab", 12, 5, 3), ("abc", 20, 6, 2000), ("abcdefgh", 8, 3, 2)])
def test_repeats_by_brute_force(spark, monkeypatch, alphabet, length, gram, split):
    """Small pieces, so that long texts are cut and shards meet; a small split, so
    that common anchors go through key ranges."""
    monkeypatch.setattr(suffixes, "PIECE", 64)
    monkeypatch.setattr(suffixes, "SHARD_BITS", 9)
    texts = _shuffled_texts(random.Random(length), alphabet)
    texts += [texts[0], "", None, "aaaa" * 20, "".join(texts[:8])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in
           suffixes.remove_repeats(df, Scratch(spark, "t"), length, gram, split).collect()}
    assert got == dict(enumerate(_removed([(t or "").encode() for t in texts], length)))


def test_repeats_of_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = _removed([(r.text or "").encode() for r in rows], 400)
    got = {r.doc_id: r for r in registry.op11_suffixes(spark, SF).collect()}
    assert len(got) == len(rows)
    for row, (size, removed, spans, kept) in zip(rows, want):
        r = got[row.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, removed, spans, hashlib.sha256(kept).hexdigest())


def test_repeats_of_odd_rows(spark, odd):
    rows = suffixes.remove_repeats(odd, Scratch(spark, "t")).collect()
    assert len(rows) == odd.count()
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans))
    assert of[7] == [(1_200_000, 1_200_000, 1)] and of[5] == [(150_000, 150_000, 1)]
    assert of[8] == of[9] == [(2700, 2700, 1)] and of[11] == of[12] == [(600, 600, 1)]
    assert of[0] == [(0, 0, 0)] * 2 and sorted(of[None]) == [(0, 0, 0), (25, 0, 0)]
    assert suffixes.remove_repeats(odd.limit(0), Scratch(spark, "t")).count() == 0
    spans = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in rows}
    assert spans[8] == [(0, 2700)] and spans[10] == []


def test_context_keys_depend_on_the_bytes_alone():
    spans = Spans()
    rows = [(5, 1, 0, 0, b"abcdefgh"), (5, 2, 1, 9, b"xbcdefgy"), (6, 2, 2, 0, b"abcdefgh")]
    c = suffixes.Contexts(rows, 6, spans)
    assert c.keys[1] == c.keys[4] and c.second[1] == c.second[4]  # bcdefg behind the same anchor
    assert c.keys[0] != c.keys[6] and len(set(c.keys.tolist())) == 8


# -------------------------------------------------------------------- middle

def test_wavelet_ranks():
    values = np.random.default_rng(1).integers(0, 5, 1000).astype(np.uint8)
    for part in (values, values[:1], values[:64], values[:0]):
        matrix = middle.WaveletMatrix(part)
        at = np.arange(len(part) + 1)
        for v in range(8):
            assert matrix.rank(v, at).tolist() == [int((part[:i] == v).sum()) for i in at]


@pytest.mark.parametrize("unit,starts", [("char", r"(?s)."), ("word", r"[^ \t\r\x0b\x0c\n]+"), ("line", "\n")])
def test_boundaries_by_definition(unit, starts):
    texts = ["", "one two\nthré e", "文字 x", "\n\n a", "y" * 130 + " z"]
    found = middle.Texts([t.encode() for t in texts], unit)
    want = [[len(t[:m.start()].encode()) for m in re.finditer(starts, t)] for t in texts]
    assert found.units().tolist() == [len(w) for w in want]
    for k in range(0, 140):
        places = found.place(np.minimum(k, found.units())) - found.begins
        for t, w, p in zip(texts, want, places.tolist()):
            assert p == (w[k] if k < len(w) else len(t.encode()))


def _formed(doc_id, text):
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:x], text[x:y], text[y:]
    if h4 % 100 < 20:
        return n, "spm", x, y - x, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", x, y - x, f"<P>{p}<S>{s}<M>{m}"


def test_forms_by_definition(spark):
    rng = random.Random(3)
    texts = [t.replace("a", rng.choice(["<", "S", ">", "M<", "字"])) for t in _shuffled_texts(rng, "ab>S<", 400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, output int")
    rows = middle.transform(df).withColumn("back", middle.restored()).collect()
    assert len({r.form for r in rows}) == 3
    for r in rows:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == _formed(r.doc_id, texts[r.doc_id])
        assert r.back == texts[r.doc_id]


def test_other_units_restore_too(spark):
    df = spark.createDataFrame([(i, f"line {i}\nand  more é\n\nlast" * (i % 4)) for i in range(60)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in df.collect()}
    for unit in ("word", "line"):
        for r in middle.transform(df, unit=unit).withColumn("back", middle.restored()).collect():
            assert r.back == texts[r.doc_id]
            if r.form == "psm":
                before, rest = r.output[3:].split("<S>")
                assert texts[r.doc_id].startswith(before) and (unit == "word" or before.count("\n") == r.prefix_units)
    with pytest.raises(ValueError):
        middle.transform(df, unit="page")


def test_middle_of_odd_rows(spark, odd):
    rows = middle.transform(odd).withColumn("back", middle.restored()).collect()
    assert len(rows) == odd.count() and middle.transform(odd.limit(0)).count() == 0
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text or "")
    for r in rows:
        assert r.back in texts[r.doc_id] and r.n == len(r.back)
        if r.doc_id is not None:
            assert r.output == _formed(r.doc_id, r.back)[4]
    assert {r.doc_id: r.form for r in rows}[10] == "plain"


# ---------------------------------------------------------------- divergence

def test_transducer_numbers_terms_in_order():
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abcé文") for _ in range(rng.randint(1, 9))) + rng.choice(["", "ing", "s"]) for _ in range(3000)})
    coded = sorted(t.encode() for t in terms)
    built = divergence.Transducer.loads(divergence.Transducer.build(coded).dumps())
    others = [t + "x" for t in terms[:200]] + [t[:-1] for t in terms[:200] if len(t) > 1]
    data, begins, ends, of = divergence.spans_of_terms([t.encode() for t in terms + others])
    assert of.tolist() == list(range(len(terms) + len(others)))
    place = {t: i for i, t in enumerate(coded)}
    assert built.ordinals(data, begins, ends).tolist() == [place.get(t.encode(), -1) for t in terms + others]
    # minimal: no two states accept the same endings
    endings = defaultdict(set)
    for t in coded:
        for i in range(len(t) + 1):
            endings[t[:i]].add(t[i:])
    assert len(built.final) == len({frozenset(v) for v in endings.values()})
    empty = divergence.Transducer.build([])
    assert empty.ordinals(data, begins[:3], ends[:3]).tolist() == [-1] * 3


def test_terms_are_runs_of_letters():
    texts = ["One two-THREE4five", "", "é文 x_y", "Z" * 300]
    data, begins, ends, of = divergence.spans_of_terms([t.encode() for t in texts])
    got = defaultdict(list)
    for b, e, k in zip(begins.tolist(), ends.tolist(), of.tolist()):
        got[k].append(bytes(data[b:e]).decode())
    for k, t in enumerate(texts):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        assert got[k] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def _audit(rows, least, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        groups = {s: Counter() for _, s, _ in own}
        for _, s, ws in own:
            groups[s].update(w for w in ws if df[w] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms, 1)}
    return out


def test_divergence_by_brute_force(spark):
    """Small blocks, matrices and parts, so that every one of them is split."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None]),
             " ".join(rng.choice(words[:rng.randint(5, 120)]) for _ in range(rng.randint(0, 40)))) for _ in range(500)]
    rows += [("xx", "a", "rare words only"), ("xx", "b", None), ("xx", "", "12 34"), ("yy", "alone", "one")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, value int, rank int")
    found = divergence.divergence(df, Scratch(spark, "t"), 10, block=16, cells=30, part_bytes=2000)
    got = found.collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _audit(rows, 10)


def test_divergence_of_odd_rows(spark, odd):
    got = {tuple(r) for r in divergence.divergence(odd, Scratch(spark, "t"), 2).collect()}
    assert got == _audit([(r.lang, r.source, r.text) for r in odd.collect()], 2)
    assert divergence.divergence(odd.limit(0), Scratch(spark, "t")).count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name in ("op12_middle", "op13_divergence"):
        df = registry.QUERIES[name](spark, SF)
        rel = con.execute(registry.SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
