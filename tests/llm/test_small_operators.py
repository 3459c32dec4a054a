"""Sharding, mixing, chat, syncmers: brute force and defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfsense.llm import chat, mixing, registry, sharding, syncmers

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, epoch string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    rows = [(None, None, None, None, None, "x", "y"), (0, "", "en", "a", 0, None, None), (0, "", "en", "a", 0, None, None),
            (1, "one two three", "en", "a", 13, "s", None), (5, "word " * 30_000, None, "a", 150_000, None, "e"),
            (7, "x" * 100_000, "en", None, 100_000, None, None), (9, "中文字符 测试 文本 一二三四五六", "zh", "b", 17, None, None),
            (-4, "one two three four five six seven", "en", "b", 33, None, None)]
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------ sharding

def _claims(names, size):
    """The table by its definition: one preference list per shard."""
    lists = {}
    for n in names:
        at, skip = sharding._number(n, "offset") % size, sharding._number(n, "skip") % (size - 1) + 1
        lists[n] = [(at + i * skip) % size for i in range(size)]
    owner = {}
    while len(owner) < size:
        for n in sorted(names):
            free = next((s for s in lists[n] if s not in owner), None)
            if free is not None and len(owner) < size:
                owner[free] = n
    return [owner[i] for i in range(size)]


def test_lookup_table_by_definition():
    names = [f"n{i}" for i in range(5)]
    table = sharding.lookup_table(names, 101)
    assert [sorted(names)[i] for i in table] == _claims(names, 101)


def test_lookup_table_balance_and_stability():
    names = [f"n{i}" for i in range(20)]
    before = sharding.lookup_table(names)
    assert max(Counter(before.tolist()).values()) - min(Counter(before.tolist()).values()) <= 1
    after = sharding.lookup_table(names[:-1])
    a = [sorted(names)[i] for i in before]
    b = [sorted(names[:-1])[i] for i in after]
    moved = sum(x != y for x, y in zip(a, b) if x != sorted(names)[-1] and x != names[-1])
    assert moved < 0.1 * sharding.SIZE
    weighted = Counter(sharding.lookup_table({"a": 1, "b": 3}, 997).tolist())
    assert abs(weighted[1] - 3 * weighted[0]) <= 4
    for bad in ([], ["a", "a"], {"a": 0}):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 11)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 12)


def test_placement(spark, odd):
    names = ["a", "b", "c"]
    rows = sharding.place(odd, "doc_id", names, 101).collect()
    table = sharding.lookup_table(names, 101)
    assert len(rows) == odd.count()
    for r in rows:
        key = "-" if r.doc_id is None else f"={r.doc_id}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.place(odd.limit(0), "doc_id", names, 101).count() == 0
    assert registry.op3_sharding(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# -------------------------------------------------------------------- mixing

@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.01, 10), min_size=1))
def test_period_stays_within_one_block(weights):
    slots = mixing.round_weights(weights, 64)
    assert sum(slots.values()) == 64 and min(slots.values()) >= 1
    order = mixing.pfair_period(slots)
    done = Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        for name, n in slots.items():
            assert abs(done[name] * 64 - n * t) < 64
    assert done == slots


def test_mix_against_a_plain_simulation(spark):
    rows = [(i, f"t{i}", "abc"[0 if i % 3 else 1 + i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, block=4, period=20, per_bucket=50).collect()
    counts = Counter(s for _, _, s in rows)
    slots = mixing.round_weights({"a": 0.5, "b": 0.3, "c": 0.2}, 20)
    order = mixing.pfair_period(slots)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    for s, own in by_source.items():
        own.sort(key=lambda r: r.position)
        assert sorted({r.doc_id for r in own}) == sorted(i for i, _, x in rows if x == s)
        # the source's blocks fill its own slots in order, every pass in the same order
        places = [t * 20 + p for t in range(100) for p, x in enumerate(order) if x == s]
        assert [r.position for r in own] == [places[k // 4] * 4 + k % 4 for k in range(len(own))]
        ids = [r.doc_id for r in own]
        assert ids == [ids[k % counts[s]] for k in range(len(ids))]
        assert [r.epoch for r in own] == [k // counts[s] for k in range(len(own))]
        assert all(r.slot == r.position // 4 for r in own)
    total = len(got)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(len(by_source[s]) - w * total) <= 2 * 4 * 20
    assert len({r.position for r in got}) == total


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd, period=16, block=2).collect()
    first = [r for r in rows if r.epoch == 0]
    assert len(first) == odd.count() and len({r.position for r in rows}) == len(rows)
    assert mixing.mix(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": 1.0})


def test_mix_of_very_many_and_of_tiny_sources(spark):
    many = spark.range(9000).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('s', id % 4500) AS source")
    got = mixing.mix(many, block=4).collect()
    assert len(got) == 9000 and len({r.position for r in got}) == 9000 and {r.epoch for r in got} == {0}
    rare = spark.range(60_001).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id = 60000, 'rare', concat('s', id % 3)) AS source")
    got = mixing.mix(rare).collect()
    weight = mixing.tempered({"rare": 1, "s0": 20_000, "s1": 20_000, "s2": 20_000}, 0.9)["rare"]
    assert abs(sum(r.source == "rare" for r in got) - weight * len(got)) < 1
    assert len({r.position for r in got}) == len(got) and {r.doc_id for r in got} == set(range(60_001))
    # every source is less than a block from its exact share after any slot of the mix
    weights = {"a": 0.7123, "b": 0.2876, "c": 0.0001}
    total, done = sum(weights.values()), Counter()
    for t, (s, _) in zip(range(1, 30_000), mixing.pfair(mixing.whole_weights(weights))):
        done[s] += 1
        assert all(abs(done[name] - w / total * t) < 1.000001 for name, w in weights.items())


# ---------------------------------------------------------------------- chat

MESSAGES = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb%0A", "<|im_start|>"]),
                              st.text(alphabet="ab<|\\\n >im_startend%0A", max_size=30)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(MESSAGES)
def test_template_round_trip(messages):
    whole = chat.render(messages)
    assert chat.read_back(whole) == messages
    spans = list(chat.locate(chat.render, messages))
    assert "".join(added for added, *_ in spans) == whole
    assert [chat.unescape(added[b:e]) for added, b, e, _ in spans] == [t for _, t in messages]
    assert not any(changed for *_, changed in spans)


def test_rewritten_history_is_detected():
    def last_only(messages):  # marks the last turn, so every turn changes the one before
        return "".join(f"[{r}]{t}{'!' if i == len(messages) - 1 else '.'}" for i, (r, t) in enumerate(messages))

    flags = [changed for *_, changed in chat.locate(last_only, [("u", "a"), ("v", "b"), ("u", "c")])]
    assert flags == [False, True, True]


def _digests(rows):
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t if t is not None else -10**9, r or "", x or ""))
    out = {}
    for c, own in groups.items():
        own = [(r, x) for _, r, x in sorted(own)]
        loss = "".join(x for r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest(), len(chat.render(own)))
    return out


def _got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect()}


def test_conversations(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert _got(registry.op10_chat(spark, SF)) == _digests(rows)


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (3, None, None, None), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (3, 1, "assistant", "é<|"),
            *[(8, i, "assistant" if i % 2 else "user", f"turn {i} " + "<|" * (i % 3)) for i in range(700)]]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "z") for r in rows], schema + ", chunk string")
    formatted = chat.format_conversations(df)
    assert formatted.where("conv_id = 8").count() == 3  # 700 turns in chunks of 256
    assert _got(chat.digest_conversations(formatted)) == _digests(rows)
    assert chat.digest_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_turns_are_numbered_over_ranges(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice("ab"), str(i)) for i, (c, t) in enumerate(
        [(1, rng.randint(-9000, 9000)) for _ in range(3000)] + [(None, rng.choice([None, 5, 5, 70_000])) for _ in range(50)])]
    schema = "conv_id long, turn long, role string, text string"
    found = chat._numbered(spark.createDataFrame(rows, schema)).collect()
    for c in (1, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        assert [(r.turn, r.role, r.text) for r in sorted((f for f in found if f.conv_id == c), key=lambda f: f.place)] == [r[1:] for r in own]
        assert sorted(f.place for f in found if f.conv_id == c) == list(range(len(own)))


def test_both_paths_agree_on_long_conversations(spark):
    """The library's template in chunks and as a black box."""
    rng = random.Random(6)
    said = [(rng.choice(["user", "assistant"]), "".join(rng.choice("ab<|\\\n >é") for _ in range(rng.randint(0, 20)))) for _ in range(600)]
    df = spark.createDataFrame([(1, i, *m) for i, m in enumerate(said)], "conv_id long, turn long, role string, text string")
    columns = ["chunk", "formatted", "turn_begins", "loss_begins", "loss_ends", "rewrites"]
    whole = chat.format_conversations(df, lambda messages: chat.render(messages))
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, chat.format_conversations(df).select(*columns).collect()))


def test_black_box_templates_see_the_whole_conversation(spark):
    def numbered(messages):  # the first turn counts, every turn has its number
        return "".join(f"{messages[0][1]}/{i}:{t};" for i, (_, t) in enumerate(messages))

    def late(messages):  # turn 300 rewrites the first one
        return "".join(f"{'!' if i == 0 and len(messages) > 300 else '.'}{t};" for i, (_, t) in enumerate(messages))

    said = [("assistant" if i % 2 else "user", f"turn {i}") for i in range(600)]
    df = spark.createDataFrame([(1, i, *m) for i, m in enumerate(said)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_conversations(df, numbered).collect(), key=lambda r: r.chunk)
    assert [r.chunk for r in rows] == [0, 1, 2] and [len(r.turn_begins) for r in rows] == [256, 256, 88]
    assert "".join(r.formatted for r in rows) == numbered(said)
    assert [r.formatted[b:e] for r in rows for b, e in zip(r.loss_begins, r.loss_ends)] == [t for r, t in said if r == "assistant"]
    again = chat.format_conversations(df, late)
    (row,) = again.collect()  # spans of a rewritten conversation would not hold
    assert (row.formatted, row.turn_begins, row.loss_begins, row.loss_ends, row.rewrites) == (late(said), None, None, None, 1)
    (row,) = chat.digest_conversations(again).collect()
    assert (row.n_turns, row.loss_sha256, row.formatted_chars, row.rewrites) == (None, None, len(late(said)), 1)
    for context in (0, 32, chat.CHUNK):  # a local template, as its caller states
        own = chat.format_conversations(df, lambda m: "".join(f"{t};" for _, t in m), context=context).collect()
        assert "".join(r.formatted for r in sorted(own, key=lambda r: r.chunk)) == "".join(f"{t};" for _, t in said)


# ------------------------------------------------------------------ syncmers

def _edited(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    out = Counter()
    for j, (i, x) in enumerate(order):
        y = order[(j + 1) % len(order)][1]
        q = len(x) // 4
        out[i, len(x), hashlib.sha256((x[:len(x) - q] + y[:q]).encode()).hexdigest()] += 1
    return out


def test_fingerprints(spark):
    rows = registry.op4_syncmers(spark, SF).collect()
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == _edited(docs)
    texts = dict(docs)
    prints = defaultdict(set)
    for r in rows:
        prints[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in rows if r.n_chars > 500]
    assert sum(r.near_edited > 0.5 for r in long) > 0.95 * len(long)


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{(i * i) % 61} the" for i in range(120))
    df = spark.createDataFrame([(text,), ("w1 the",), ("",)], "t string")
    hashed = spark.createDataFrame([(t,) for t in text.split()], "t string").selectExpr("t", "xxhash64(t) h").distinct()
    h = {r.t: r.h for r in hashed.collect()}
    units = [h[w] for w in text.split()]
    pair = {(r.a, r.b): r.p for r in spark.createDataFrame(
        sorted(set(zip(units, units[1:]))), "a long, b long").selectExpr("a", "b", "xxhash64(a, b) p").collect()}
    inner = [pair[x] for x in zip(units, units[1:])]
    at = [i for i in range(len(units) - 5) if min(inner[i:i + 5]) in (inner[i], inner[i + 4])]
    windows = spark.createDataFrame([tuple(units[i:i + 6]) + (i,) for i in at], "a long, b long, c long, d long, e long, f long, p int")
    want = {}
    for r in windows.selectExpr(f"xxhash64(a, b, c, d, e, f) & {syncmers._MASK}L h", "p").collect():
        want[r.h] = min(want.get(r.h, r.p), r.p)
    got = [[(a.h, a.p) for a in r.k] for r in syncmers.with_anchors(df, "t", "k").collect()]
    assert got[0] == sorted(want.items())[:syncmers.KEPT]
    assert len(got[1]) == 1 and got[2] == []


def test_likeness_counts_every_anchor(spark):
    own, other = [[f"{a}{i}" for i in range(4000)] for a in "ab"]
    texts = [" ".join(own + own[:400]), " ".join(other + own[1000:1060])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    edited = [x[:len(x) - len(x) // 4] + y[:len(x) // 4] for x, y in zip(texts, texts[::-1])]
    every = [{a.h: a.p for a in r.k} for r in syncmers.with_anchors(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts + edited)], "i long, t string"), "t", "k", None).orderBy("i").collect()]
    assert all(len(e) > 20 * syncmers.KEPT for e in every)
    share = lambda a, b: 2 * len(set(a) & set(b)) / (len(a) + len(b))
    for i in (0, 1):
        shifts = sorted(every[2 + i][h] - p for h, p in every[i].items() if h in every[2 + i])
        assert rows[i].near_next == share(every[0], every[1]) > 0
        assert rows[i].near_edited == share(every[i], every[2 + i])
        assert rows[i].aligned_edited == shifts.count(shifts[len(shifts) // 2]) / len(shifts)
        assert rows[i].fingerprint.count(",") == syncmers.KEPT - 1


def test_every_anchor_is_printed(spark):
    texts = [" ".join(f"{a}{i}" for i in range(n)) for a, n in (("a", 900), ("b", 300), ("c", 20), ("d", 3))] + [""]
    rows = syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    edited = [x[:len(x) - len(x) // 4] + y[:len(x) // 4] for x, y in zip(texts, texts[1:] + texts[:1])]
    every = [",".join(f"{a.h:010x}.{a.p}" for a in r.k) for r in syncmers.with_anchors(spark.createDataFrame(
        list(enumerate(texts + edited)), "i long, t string"), "t", "k", None).orderBy("i").collect()]
    assert every[0].count(",") > 3 * syncmers.KEPT and every[1].count(",") > syncmers.KEPT
    for r in rows:
        assert (r.anchors, r.edited_anchors) == (every[r.doc_id], every[len(texts) + r.doc_id])
        assert r.fingerprint == ",".join(r.anchors.split(",")[:syncmers.KEPT])
        assert r.edited_fingerprint == ",".join(r.edited_anchors.split(",")[:syncmers.KEPT])


def test_units_of_a_text_are_found_once(spark):
    df = spark.createDataFrame([(1, "some words of a text"), (2, "and of another")], "doc_id long, text string")
    plan = syncmers.fingerprints(df)._jdf.queryExecution().optimizedPlan().toString()
    read = re.findall(r"regexp_extract_all\((.*?), \[", re.sub(r"#\d+L?", "", plan))
    # the text in two parts, and what the edited text does not share with it
    end = str(2**31 - 1)
    assert sorted(read) == sorted(["substring(text, 1, cut)", f"substring(text, (cut + 1), {end})", f"substring(edited, (cut + 1), {end})"])


def test_edited_anchors_equal_those_of_the_whole_edited_text(spark):
    rng = random.Random(4)
    parts = ["a", "bb", "the", "of", " ", " ", " ", "  ", "\t", "\n", ".", "中", "é", "e\u0301", "\U0001d518", "x" * 30, "ไท"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 6, 8, 11, 16, 30, 80]))) for _ in range(300)]
    rows = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    edited = [x[:len(x) - len(x) // 4] + y[:len(x) // 4] for x, y in zip(texts, texts[1:] + texts[:1])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + edited)], "i long, t string")
    whole = syncmers.with_anchors(df, "t", "k", None).withColumn("print", syncmers.as_text("k"))
    every = {r.i: ({a.h: a.p for a in r.k}, r.print) for r in whole.collect()}
    n = len(texts)
    share = lambda a, b: 2 * len(set(a) & set(b)) / (len(a) + len(b)) if a or b else 1
    for i, r in rows.items():
        own, changed, after = every[i][0], every[n + i][0], every[(i + 1) % n][0]
        shifts = sorted(changed[h] - p for h, p in own.items() if h in changed)
        assert (r.fingerprint, r.edited_fingerprint) == (every[i][1], every[n + i][1])
        assert (r.near_edited, r.near_next) == (share(own, changed), share(own, after))
        assert r.aligned_edited == (shifts.count(shifts[len(shifts) // 2]) / len(shifts) if shifts else 0)


def test_fingerprints_of_odd_rows(spark, odd):
    rows = syncmers.fingerprints(odd).collect()
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == _edited(docs)
    empty = [r for r in rows if r.n_chars == 0]
    assert all(r.fingerprint == "" and r.near_edited == 1 for r in empty)
    assert syncmers.fingerprints(odd.limit(0)).count() == 0
    alone = syncmers.fingerprints(odd.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    # ids far apart: every bucket has one row
    apart = spark.createDataFrame([(i * 10**15, f"text number {i} of a few") for i in range(40)], "doc_id long, text string")
    plain = [(r.doc_id, r.text) for r in apart.collect()]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in syncmers.fingerprints(apart).collect()) == _edited(plain)
    many = syncmers.with_next(apart, ["text"], lambda df: df, per_bucket=1).collect()
    texts = dict(plain)
    ids = sorted(texts)
    assert {r.doc_id: r.next.text for r in many} == {i: texts[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
