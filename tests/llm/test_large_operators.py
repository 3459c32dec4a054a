"""Toxicity, language, neighbours, substrings, near-duplicates: brute force,
held-out accuracy and defined cases."""

import math
import random
import tracemalloc
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfsense.llm import ann, langid, minhash, registry, substring, toxicity
from shelfsense.llm._common import _LOWER, Scratch, Spans, connected_components, crc_fold, shingle_hashes

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, keys string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, None, None, None, "x", "y"), (None, "some words here and there", "en", None, 4, None, None),
            (0, "", "en", "a", 0, None, None), (0, "", "en", "a", 0, None, None), (2, "12 !? 345", "en", "a", 9, None, None),
            (3, "  \t\n", "en", "a", 4, None, None), (5, "word " * 30_000, None, "a", 150_000, None, None),
            (7, "x" * 100_000, "en", None, 100_000, None, None), (9, "文字" * 300, "zh", "b", 600, None, None),
            (11, "one two", "en", "b", 7, None, None), (12, "ONE  two", "en", "b", 8, None, None)]
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------ toxicity

def test_index_is_exact():
    rng = random.Random(1)
    vectors = [toxicity.weigh({t: rng.randint(1, 4) for t in rng.sample(range(30), rng.randint(1, 6))}, np.ones(30)) for _ in range(500)]
    vectors += vectors[:50]  # ties
    ids = np.array(rng.sample(range(10_000), len(vectors)))
    index = toxicity.BlockMaxIndex(vectors, 30, block=16)
    for _ in range(60):
        query = toxicity.weigh({t: rng.randint(1, 3) for t in rng.sample(range(30), rng.randint(1, 8))}, np.ones(30))
        every = sorted(((round(sum(w * v.get(t, 0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors)),
                       key=lambda x: (-x[0], ids[x[1]]))
        want = [x for x in every if x[0] > 0][:10]
        got = index.search(query, 10, ids)
        assert [i for _, i in got] == [i for _, i in want]
        assert all(math.isclose(a, b, abs_tol=1e-9) for (a, _), (b, _) in zip(got, want))


def test_long_postings_are_added_as_runs(monkeypatch):
    """Rare terms on both sides of the length from which postings are copied as runs."""
    rng = random.Random(3)
    vectors = [toxicity.weigh({t: rng.randint(1, 4) for t in rng.sample(range(60), rng.randint(1, 6))}, np.ones(60)) for _ in range(300)]
    ids = np.arange(300)
    for run in (1, 25, 10**6):
        monkeypatch.setattr(toxicity, "RUN", run)
        monkeypatch.setattr(toxicity, "COMMON", 8)
        index = toxicity.BlockMaxIndex(vectors, 61, block=16)
        queries = [toxicity.weigh({t: 1 for t in rng.sample(range(61), n)}, np.ones(61)) for n in (1, 2, 9, 30)]
        for query in [*queries, {60: 1.0}, {}]:
            every = sorted(((-round(sum(w * v.get(t, 0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors)))
            assert [(c, i) for c, i in index.search(query, 10, ids)] == [(-c, i) for c, i in every if c < 0][:10]


def test_postings_stand_by_term_and_place(monkeypatch):
    """Laid out some examples at a time, as one sort would put them."""
    rng = random.Random(4)
    vectors = [{t: rng.random() for t in rng.sample(range(80), rng.randint(0, 9))} for _ in range(150)]
    for rows in (1, 7, 1000):
        monkeypatch.setattr(toxicity, "ROWS", rows)
        index = toxicity.BlockMaxIndex(vectors, 80, block=16)
        place = {e: p for p, e in enumerate(index.order.tolist())}
        for t in range(80):
            run = slice(index.starts[t], index.starts[t + 1])
            want = sorted((place[e], v[t]) for e, v in enumerate(vectors) if t in v) if index.column[t] < 0 else []
            assert list(zip(index.places[run].tolist(), index.weights[run].tolist())) == want


def test_names_are_told_apart_when_their_hashes_are_equal(monkeypatch):
    names = pa.array(["", "a", "b", "straße", "word", "words"])
    words = ["word", "b", "unknown", "", "straße", "words", "a", "word"]
    want = [4, 2, -1, 0, 3, 5, 1, 4]
    assert toxicity.Numbers(names).of(words).tolist() == want
    monkeypatch.setattr(toxicity.Numbers, "_hashes", staticmethod(lambda words: np.array([len(w) // 5 for w in words], np.int64)))
    assert toxicity.Numbers(names).of(words).tolist() == want
    assert toxicity.Numbers(names.slice(0, 0)).of(words).tolist() == [-1] * 8 and toxicity.Numbers(names).of([]).tolist() == []


def test_toxicity_model_is_laid_out_in_little_memory():
    """Next to what a task keeps: no Python object for each word, no second copy of all postings."""
    rng = np.random.default_rng(8)
    names = sorted(f"word{i}" for i in range(100_000))
    found = [[(t, 1 + t % 3) for t in np.unique(rng.integers(0, len(names), 100)).tolist()] for _ in range(4000)]
    parts = [toxicity.packed_examples(np.arange(a, a + 500), np.arange(500) % 2, found[a:a + 500]) for a in range(3500, -1, -500)]
    pack = lambda a: toxicity._packed(a)
    frequency = np.bincount([t for f in found for t, _ in f], minlength=len(names))
    model = toxicity.ToxicityModel(pack(np.frombuffer("\n".join(names).encode(), np.uint8)), pack(frequency), parts,
                                   names[:9], 4000, 15, 0.5, (np.array([0.0]), np.array([0.0])))
    del names, found
    pa.array(["a"]).to_numpy(zero_copy_only=False)  # imports on first use
    tracemalloc.start()
    try:
        assert model.ids.tolist() == list(range(4000))
        model.vectors(["word1 word2 nothing"])
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 13e6 and most < 27e6


def test_block_compares_signatures_in_bounded_memory():
    n = 1500
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.choice(2**40, 6, replace=False)).astype(np.uint64) for _ in range(n // 2)] * 2
    packed = minhash.signatures(np.stack([minhash.minima(s) for s in sets]))
    tracemalloc.start()
    found = list(minhash._Block(list(range(n)), sets, packed, None, (80, 100)).links())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [(i, i + n // 2) for i in range(n // 2)] and peak < 60e6


def test_split_grams_give_a_row_a_document(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    said = say(400)
    docs = spark.createDataFrame([(i, say(120) + said[:400 - 2 * i] + say(120)) for i in range(60)], "doc_id long, text string")
    cut = lambda: sorted(tuple(r) for r in substring.cut_repeats(docs).select("doc_id", "text", "spans", "repeats_of").collect())
    whole, made, nearest = cut(), [], substring.nearest
    monkeypatch.setattr(substring, "SPLIT", 10)
    monkeypatch.setattr(substring, "nearest", lambda found, least_run: made.append(nearest(found, least_run)) or made[-1])
    assert cut() == whole and sum(len(r[1]) < 400 for r in whole) == 59
    rows = made[0].collect()
    # from each of the session's four shuffle partitions at most one
    assert 59 <= len(rows) <= 4 * 59 < sum(len(r.found) for r in rows)


def test_isotonic_fit_is_monotone():
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0])
    knots = toxicity.isotonic(x, y)
    assert (np.diff(knots[1]) >= 0).all() and (np.diff(knots[0]) > 0).all()


def test_held_out_toxicity(spark):
    rows = registry.op1_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= 0.95 * len(held)


def test_fitted_index_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, Scratch(spark, "t"))
    # every labelled training text is indexed, clean ones too, on all its words
    train = {r.doc_id: r.toxic for r in labels.where(crc_fold(F.col("doc_id"), 5) != 0).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    distinct = {texts[i]: max(y for j, y in train.items() if texts[j] == texts[i]) for i in train}
    assert len(model.ids) == len(distinct) and int(model.toxic.sum()) == sum(distinct.values())
    for j in (0, 17, len(model.ids) - 1):
        words = {w for w in toxicity.terms_of(texts[model.ids[j]], frozenset())}
        assert words <= {model.names[t] for t in model.vector(texts[model.ids[j]])[0].tolist()}
    matrix = np.zeros((len(model.ids), len(model.terms)))
    for j, i in enumerate(model.ids.tolist()):
        terms, weights = model.vector(texts[i])
        matrix[j, terms] = weights
        assert not len(terms) or math.isclose(float(weights @ weights), 1)
    for text in [texts[i] for i in sorted(texts)[:150]]:
        terms, weights = model.vector(text)
        cosine = matrix[:, terms] @ weights
        want = sorted(((-round(float(c), 12), int(model.ids[j]), j) for j, c in enumerate(cosine) if c > 0))[:model.k]
        got = model.index.search((terms, weights), model.k, model.ids)
        assert all(math.isclose(a, -b, abs_tol=1e-9) for (a, _), (b, _, _) in zip(got, want)) and len(got) == len(want)
        assert {j for _, j in got[:5]} <= {j for _, _, j in want} | {j for j, c in enumerate(cosine) if c >= -want[-1][0] - 1e-9}


def test_copies_of_a_rare_kind_are_found(spark):
    """Three toxic examples of a kind that no marking term can tell."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    odd_kind = [f"{say(20)} {'zyx'[i] * 5} {say(20)}" for i in range(3)]
    rows = [(i, say(40), 0) for i in range(300)] + [(300 + i, f"{say(20)} vile {say(20)}", 1) for i in range(60)]
    rows += [(400 + i, t, 1) for i, t in enumerate(odd_kind)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, labels, Scratch(spark, "t"))
    trained = {int(i): j for j, i in enumerate(model.ids)}
    assert sum(300 <= i for i in trained) == int(model.toxic.sum()) and len(trained) > 250
    for i in [400 + i for i in range(3) if 400 + i in trained]:
        terms, weights = model.vector(odd_kind[i - 400])
        (best, j), *_ = model.index.search((terms, weights), model.k, model.ids)
        assert math.isclose(best, 1.0, abs_tol=1e-9) and model.ids[j] == i
        ((score, near, _),) = model.score([odd_kind[i - 400]])
        assert score >= 0.5 and near[0] == i
    assert model.score([say(40)])[0][0] < 0.5 and model.score([f"{say(30)} vile"])[0][0] >= 0.5


def test_driver_holds_the_toxicity_model_compressed(spark):
    docs = spark.createDataFrame([(i, f"word{i} vile vileness other" if i % 3 else f"fine {i} day day") for i in range(90, 0, -1)],
                                 "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("toxic"))
    model = toxicity.fit(docs, labels, Scratch(spark, "t"))
    toxicity.score_documents(docs, model).count()
    laid = {"index", "of", "counts", "terms", "names", "_laid"}
    assert not laid & set(vars(model))  # fitted, sent to tasks and calibrated, never laid out here
    assert (np.diff(model.ids) > 0).all() and set(model.ids.tolist()) <= set(range(1, 91))
    assert "_laid" in vars(model) and not laid & set(model.__getstate__())


def test_vectors_of_many_texts(spark):
    """As counted text by text, whatever words a text has."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), Scratch(spark, "t"), least_rows=1)
    some = [r.text for r in docs.limit(40).collect()]
    stems = [f"{s}xyz {s}xyz {s}" for s in sorted(model.stems)]
    texts = [None, "", "0 !?", "qqqq zzzz", *some, *stems, " ".join(stems), some[0]]
    for text, (terms, weights) in zip(texts, model.vectors(texts)):
        counts = {model.terms[t]: n for t, n in toxicity.terms_of(text, model.stems).items() if t in model.terms}
        assert terms.tolist() == sorted(counts)
        want = toxicity.weights_of(terms, np.array([counts[t] for t in terms.tolist()], float), model.idf, model.marked)
        assert np.allclose(weights, want, rtol=0, atol=1e-12)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (None, 1), (5, None), (11, 0), (11, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        model = toxicity.fit(odd, marks, Scratch(spark, "t"))
        rows = toxicity.score_documents(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert rows[0]["keys"] in ("y", None)
    assert toxicity.score_documents(odd.limit(0), model).count() == 0


# ------------------------------------------------------------------ language

def test_held_out_languages(spark):
    rows = registry.op2_langid(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pooled_responses_by_definition():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    net = langid.train(windows.repeat(4, 0), np.array([0, 1, 0] * 4), ["a", "b"], epochs=1)
    response, _ = net.pooled(windows)
    for n in range(3):
        for f in (0, 13, 30):
            width = langid.WIDTHS[f // langid.FILTERS]
            w = net.filters[:width * langid.EMBED, f].reshape(width, langid.EMBED)
            slow = [float((net.embed[windows[n, p:p + width]] * w).sum()) for p in range(response.shape[1])]
            assert np.allclose(response[n, :, f], slow, atol=1e-4)


def test_numbers_and_marks_are_no_letters():
    for text in ("½ ² ①", "१२३ ४", "_ - !", "☃ ́"):
        assert not langid.has_letter(text)
    for text in ("½ a", "文", "ʰ", "ǅ"):
        assert langid.has_letter(text)


def test_whole_predictions_by_definition():
    """Every window of every text, one at a time, weighted by its bytes."""
    rng = np.random.default_rng(5)
    net = langid.train(rng.integers(32, 120, (64, langid.WINDOW)).astype(np.uint8), np.arange(64) % 3, ["a", "b", "c"], epochs=1)
    texts = ["x", "word " * 300, "é" * 500, None, "12", "y" * langid.WINDOW, "z" * (langid.WINDOW + 1)]
    names, scores = langid.predict(net, texts)
    for text, name, score in zip(texts, names, scores):
        if not text or not langid.has_letter(text):
            assert (name, score) == ("und", 0.0)
            continue
        data = text.encode()
        total = np.zeros(3)
        for at in range(0, len(data), langid.WINDOW):
            piece = data[at:at + langid.WINDOW]
            window = np.zeros((1, langid.WINDOW), np.uint8)
            window[0, :len(piece)] = np.frombuffer(piece, np.uint8)
            total += net.log_probabilities(window)[0].astype(float) * len(piece)
        p = np.exp(total / len(data) - (total / len(data)).max())
        assert name == "abc"[int(np.argmax(p))] and math.isclose(score, float((p / p.sum()).max()), abs_tol=1e-5)


def test_languages_of_odd_rows(spark, odd):
    net = langid.fit(odd)
    rows = langid.identify(odd, net).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not any(unicodedata.category(c).startswith("L") for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(odd.limit(0))).collect()} == {"und"}
    assert langid.identify(odd.limit(0), net).count() == 0


# ---------------------------------------------------------------- neighbours

def _recall(rows, found, k=5, every=50):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    hits = []
    for q in ids[ids % every == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -9
        order = np.lexsort((ids, -s))[:min(k, len(ids) - 1)]
        mine = found.get(q, [])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(order)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += [r.score >= s[order[-1]] - 1e-9 for r in mine]
    return sum(hits) / max(len(hits), 1)


def _by_query(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r)
    return out


def test_neighbours(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert _recall(rows, _by_query(registry.op5_ann(spark, "/root/testdata/sf0.1"))) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(1, 40)]
    same = rng.standard_normal(6).tolist()
    rows += [(100 + i, same) for i in range(60)]  # equal vectors, two of them queries
    rows += [(0, None), (50, [0.0] * 6), (None, same), (41, [1.0, None] * 3), (42, [float("nan")] * 6), (43, [float("inf")] * 6), (44, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    found = _by_query(ann.nearest(df, Scratch(spark, "t")))
    assert set(found) == {100, 150}
    assert [r.vec_id for r in found[150]] == [100, 101, 102, 103, 104] and [r.vec_id for r in found[100]] == [101, 102, 103, 104, 105]
    assert not _by_query(ann.nearest(df.limit(0), Scratch(spark, "t")))
    assert len(_by_query(ann.nearest(df.where("vec_id in (100, 3, 4)"), Scratch(spark, "t")))[100]) == 2


# ---------------------------------------------------------------- substrings

def test_gear_hash_rolls():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    rolling, out = 0, []
    for b in data:
        rolling = ((rolling << 1) + int(substring._GEAR[b])) & 0xFFFFFFFF
        out.append(rolling)
    assert substring.gear_hashes(data).tolist() == out
    for size in (1, 2, 3, 31):
        assert substring.gear_hashes(data[:size]).tolist() == out[:size]


def test_chunks_cover_texts_and_resist_insertions():
    rng = random.Random(2)
    text = " ".join(rng.choice(WORDS) + rng.choice("é文x") for _ in range(3000))
    for t in (text, "x" * 5000, "é" * 3000, "a", ""):
        data, begins, ends, _ = substring.chunks(Spans(), t)
        pieces = [data[b:e] for b, e in zip(begins, ends)]
        assert b"".join(pieces) == t.encode() and all(p.decode() for p in pieces)
        assert all(len(p) <= substring.MOST + 3 for p in pieces)
    a = set(substring.chunks(Spans(), text)[3].tolist())
    b = set(substring.chunks(Spans(), text[:5000] + "inserted here " + text[5000:])[3].tolist())
    assert len(a & b) > 0.98 * len(a)


def test_repeated_passages(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    passages = [say(60) for _ in range(4)]
    rows, planted = [], {}
    for i in range(120):
        text = say(rng.randint(5, 200))
        if i % 4 == 0:
            planted[i] = i // 4 % 4
            text = f"{text} {passages[planted[i]]} {say(30)}"
        rows.append((i, text))
    got = {r.doc_id: r for r in substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {p: min(i for i, q in planted.items() if q == p) for p in set(planted.values())}
    texts = dict(rows)
    for i, r in got.items():
        later = i in planted and first[planted[i]] != i
        assert r.has_repeat == later, i
        if later:
            assert passages[planted[i]] not in r.text and r.removed_chars >= 0.6 * len(passages[planted[i]])
            assert set(r.repeats_of) == {first[planted[i]]}
            data = texts[i].encode()
            assert r.text.encode() == b"".join(
                data[b:e] for b, e in zip([0, *[s[1] for s in r.spans]], [*[s[0] for s in r.spans], len(data)]))
        else:
            assert r.text == texts[i] and r.removed_chars == 0


def test_short_passages_are_cut_whole(spark):
    """Passages of 51 short words, cut to the byte at both ends."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    say = lambda n, letters: " ".join(word(letters) for _ in range(n))
    rows, want = [], {}
    for p in range(150):
        passage = say(51, 1 + p % 4)
        rows.append((2 * p, f"{say(40, 6)}#{passage}#{say(40, 6)}"))
        ends = f"{say(40, 6)}[", f"]{say(40, 6)}"
        rows.append((2 * p + 1, passage.join(ends)))
        want[2 * p + 1] = (ends[0] + ends[1], 2 * p)
    # an earlier document holds the passage's head as a common phrase
    phrase, rest = say(8, 4), say(60, 4)
    rows += [(1000, f"{say(40, 6)} {phrase} {say(40, 6)}"), (1001, f"{say(40, 6)}#{phrase} {rest}#"), (1002, f"{say(40, 6)}[{phrase} {rest}]")]
    want[1002] = (rows[-1][1].split("[")[0] + "[]", 1000)
    texts = dict(rows)
    for r in substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        kept, first = want.get(r.doc_id, (texts[r.doc_id], None))
        assert r.text == kept and (first is None) == (not r.has_repeat), r.doc_id
        if first is not None:
            assert len(r.spans) == 1 and r.repeats_of[0] in (first, r.doc_id - 1)


def _cut_by_definition(texts, least=96):
    """Text without the bytes of strings that an earlier document holds, or that
    stand ``least`` bytes before in the same one; cuts keep whole characters."""
    first, out = {}, {}
    for doc in sorted(texts):
        data = texts[doc].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            d, p = first.setdefault(data[i:i + least], (doc, i))
            if d < doc or i - p >= least:
                gone[i:i + least] = b"\1" * least
        i = 0
        kept = bytearray()
        while i < len(data):
            j = i
            while j < len(data) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                b, e = i, j
                while b < e and data[b] & 0xC0 == 0x80:
                    b += 1
                while e > b and e < len(data) and data[e] & 0xC0 == 0x80:
                    e -= 1
                kept += data[i:b] + data[e:j]
            else:
                kept += data[i:j]
            i = j
        out[doc] = kept.decode()
    return out


@pytest.mark.parametrize("split", [4000, 2])
def test_cuts_by_brute_force(spark, monkeypatch, split):
    """Small splits send the strings of common grams through key ranges."""
    monkeypatch.setattr(substring, "SPLIT", split)
    docs = spark.read.parquet(f"{SMALL if split == 2 else SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = _cut_by_definition(texts)
    rows = substring.cut_repeats(docs.repartition(5)).collect()
    assert {r.doc_id: r.text or "" for r in rows} == want
    assert all(r.has_repeat == (want[r.doc_id] != texts[r.doc_id]) and r.removed_chars == len(texts[r.doc_id]) - len(want[r.doc_id]) for r in rows)
    assert sum(r.removed_chars for r in rows) > 0


def test_strings_of_several_documents_are_left(spark):
    """A and B hold 76 bytes each of a passage of 120 bytes in C: no string of 96."""
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for i in range(0, 180, 3):
        passage = say(120)
        rows += [(i, say(150) + passage[:76] + say(150)), (i + 1, say(150) + passage[44:] + say(150)), (i + 2, say(150) + passage + say(150))]
    got = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(r.has_repeat for r in got) and {r.doc_id: r.text for r in got} == dict(rows)


@pytest.mark.parametrize("split", [3, 1000])
def test_lists_of_split_grams_alone(spark, monkeypatch, split):
    """Every list that a task compares is one key: many hold split grams alone."""
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = say(70)
    rows = [(i, say(90) + line + say(90) + "on and " * (20 + i % 5) + say(60) + "over " * (25 + i % 3)) for i in range(80)]
    monkeypatch.setattr(substring, "SPLIT", split)
    monkeypatch.setattr(substring, "COMPARED_BYTES", 1)
    got = {r.doc_id: r for r in substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == _cut_by_definition(dict(rows))
    assert all(set(got[i].repeats_of) <= set(range(5)) for i in range(5, 80))
    assert not len(substring.Strings([], Spans(), 96).keys)


def test_substrings_of_odd_rows(spark, odd):
    rows = substring.cut_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert substring.cut_repeats(odd.limit(0)).count() == 0
    whole = substring.cut_repeats(spark.createDataFrame([(2, "same text " * 40), (1, "same text " * 40)], "doc_id long, text string"))
    assert {r.doc_id: r.repeats_of for r in whole.collect() if r.has_repeat}.get(2) is not None


# ----------------------------------------------------------- near-duplicates

def _classes(rows, k, share=(80, 100)):
    sets = {}
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().translate(_LOWER).split()]
        sets[i] = frozenset(tuple(words[j:j + k]) for j in range(max(len(words) - k + 1, 1))) if words else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * share[1] >= max(len(a), len(b)) * share[0]:
                both = len(a & b)
                if share[1] * both >= share[0] * (len(a) + len(b) - both):
                    p, q = sorted((find(i), find(j)))
                    parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(150)]
    for i in range(160):  # a drifting group larger than a small bucket
        words = list(base)
        for _ in range(rng.randint(1, 12)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((10_000 + i, " ".join(words)))
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, hi int")
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, Scratch(spark, "t"), k=k).collect()}
        assert got == _classes(rows, k)


def test_near_duplicates_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4000)
    rng = random.Random(6)
    base = [rng.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, Scratch(spark, "t"), k=4).collect()}
    assert got == _classes(rows, 4)


def test_near_copies_send_their_texts_once(spark, monkeypatch):
    """Rows that reach the comparison grow in proportion to a group of near copies."""
    monkeypatch.setattr(minhash, "BLOCK", 8000)
    sent, confirm = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda members, *rest: (sent.append(members.count()), confirm(members, *rest))[1])
    rng = random.Random(7)
    base = [rng.choice(WORDS) for _ in range(100)]
    for n in (100, 200, 400):
        rows = []
        for i in range(n):
            words = list(base)
            words[rng.randrange(len(words))] = f"x{i}"
            rows.append((i, " ".join(words)))
        sent.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.component_id for r in minhash.near_duplicates(df, Scratch(spark, "t"), k=4).collect()} == {0}
        assert n <= sum(sent) <= 1.3 * n


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = minhash.near_duplicates(odd, Scratch(spark, "t"), k=4).collect()
    assert len(rows) == odd.count()
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert of[12].component_id == 11 and not of[12].kept and of[11].kept
    assert of[0].n_shingles == 0 and of[0].kept and of[3].component_id == 3
    assert all(r.kept for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(odd.limit(0), Scratch(spark, "t")).count() == 0


def test_signature_estimates():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            n = 400
            both = int(2 * n * share / (1 + share))
            x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            a, b = x[:n], x[n - both:]
            packed = minhash.signatures(np.stack([minhash.minima(a), minhash.minima(b)]))
            errors.append(minhash.estimate(minhash.differing(packed[0], packed[1])) - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_shingles():
    spans = Spans()
    assert len(shingle_hashes(spans, "a b c d e", 4)) == 2 and len(shingle_hashes(spans, "A  b\tc", 4)) == 1
    assert shingle_hashes(spans, "A  b\tc", 4).tolist() == shingle_hashes(spans, "a b c", 4).tolist()
    assert len(shingle_hashes(spans, None, 4)) == 0 and len(shingle_hashes(spans, " \n", 4)) == 0


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 180)] + [(7, 7), (300, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)} | {200: 200, 300: 200}
    assert got == want


def test_only_texts_of_candidates_are_sent_to_comparisons(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text").unionByName(
        spark.sql("SELECT CAST(null AS bigint) AS doc_id, 'no id' AS text"))
    placed = spark.range(0, 20_000, 100).selectExpr("id AS doc_id")
    sent = minhash.compared_texts(placed, docs)
    assert sent.join(placed, "doc_id", "left_semi").count() == 200
    assert sent.where("doc_id is not null").count() < 220
