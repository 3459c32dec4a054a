"""Stages of the corpus pipeline: effects, kept columns, defined cases."""

import hashlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as C  # noqa: E402
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, position long, `a.b` string"


def _classes(rows, k=5):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(max(len(w) - k + 1, 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {find(i) for i in sets}


def test_stages_over_the_table(spark):
    assert [f for f, _ in C.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(C.STAGES)
    clean = stage["toxicity"](spark, docs, SF).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == docs.columns
    wrong = [i for i, y in labels.items() if (i in kept) == bool(y)]
    assert len(wrong) <= 0.1 * len(labels)

    one = stage["near_duplicates"](spark, clean, SF).cache()
    rows = [(r.doc_id, r.text or "") for r in clean.collect()]
    assert {r.doc_id for r in one.select("doc_id").collect()} == _classes(rows)
    assert one.columns == docs.columns

    cut = stage["substrings"](spark, one, SF).cache()
    before = {r.doc_id: r.text or "" for r in one.collect()}
    seen: dict[tuple, int] = {}
    for i in sorted(before):  # 50-word passages of earlier documents are gone
        words = before[i].split()
        for j in range(len(words) - 49):
            seen.setdefault(tuple(words[j:j + 50]), i)
    left = total = 0
    for r in cut.collect():
        assert r.n_chars == len(r.text or "") or r.text == before[r.doc_id]
        a, b = before[r.doc_id].split(), (r.text or "").split()
        total += sum(seen[tuple(a[j:j + 50])] < r.doc_id for j in range(len(a) - 49))
        left += sum(seen.get(tuple(b[j:j + 50]), r.doc_id) < r.doc_id for j in range(len(b) - 49))
    assert left <= 0.05 * total
    assert cut.columns == docs.columns and cut.count() == len(before)

    mixed = stage["mixing"](spark, cut, SF).cache()
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == set(before)

    made = stage["pieces"](spark, mixed, SF).collect()
    texts = {r.doc_id: r.text or "" for r in cut.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(r.doc_id for r in made) == Counter(r.doc_id for r in mixed.collect())
    for r in made:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) == len(r.span_begins)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_run_keeps_the_order_of_the_mix(spark):
    made = C.run(spark, SF).orderBy("position").collect()
    assert [r.position for r in made] == list(range(len(made)))
    counts = Counter(r.source for r in made)
    total, block = len(made), 64
    # in every beginning of the result each source is near its share: less than
    # one block from it by slots, and a block more within a slot
    seen: Counter = Counter()
    for n, r in enumerate(made, 1):
        seen[r.source] += 1
        if n % block == 0:
            assert all(abs(seen[s] - n * counts[s] / total) <= 2 * block for s in counts)
    assert not C._open


def test_several_texts_of_an_id_stay(spark):
    say = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(1, say("a")), (1, say("b")), (0, say("b")), (1, say("a")), (2, say("c")), (7, say("c")), (7, say("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text[0]) for r in C.keep_one_of_each_class(spark, docs, SF).collect())
    assert got == Counter([(1, "a"), (0, "b"), (2, "c"), (7, "d")])


def test_substrings_where_all_grams_of_a_list_are_split(spark, monkeypatch):
    """A common line in texts that differ: its gram is split, and lists hold nothing else."""
    monkeypatch.setattr(C.substring, "SPLIT", 4)
    monkeypatch.setattr(C.substring, "COMPARED_BYTES", 1)
    line, other = "a line of some words that very many of the texts hold", [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)]
    rows = [(i, f"{x[:150]} {line} and more of it, the same in all of them but the first {line if i else 'end'} {x[150:]}", "en", "s", 1, i)
            for i, x in enumerate(other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long")
    got = {r.doc_id: r for r in C.cut_repeated_passages(spark, docs, SF).collect()}
    assert sorted(got) == list(range(60)) and got[0].text == rows[0][1] and got[0].n_chars == 1
    for i in range(1, 60):
        assert len(got[i].text) == got[i].n_chars < len(rows[i][1]) - 96 and got[i].text.startswith(other[i][:140]) and got[i].row == i


def test_stages_on_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, None, None, None, None, "s", 1, "p"), (None, text, "en", None, 9, None, None, None),
            (1, text, "en", "a", len(text), "x", 2, "q"), (1, text, "en", "a", len(text), "x", 2, "q"),
            (2, text + " more", "en", "a", None, None, None, None), (3, "", "en", "b", 0, None, None, None),
            (4, "Other. " + text + " " + " ".join(f"another{i}" for i in range(40)), "en", "b", 1, None, None, None),
            (5, "x" * 50_000, None, "b", 50_000, None, None, "z")]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns, name
        if name == "toxicity":
            assert len(got) == len(rows)
        if name == "near_duplicates":
            assert Counter(r.doc_id for r in got) == Counter([None, None, 1, 3, 4, 5])
        if name == "substrings":
            assert len(got) == len(rows)
            four = next(r for r in got if r.doc_id == 4)
            assert four.n_chars == len(four.text) < 500
        if name == "mixing":
            assert {r.doc_id for r in got} == {r[0] for r in rows}
        one = next(r for r in got if r.doc_id == 1)
        assert (one.score, one.position, one["a.b"]) == ("x", 2, "q")
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = C.STAGES[-1][1]
    assert last(spark, docs, SF).count() == len(rows) and last(spark, docs.limit(0), SF).count() == 0
