import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmetry.llm import overlap
from quillmetry.llm.overlap import COUNTERS, HashedWords, common_words, dot_product, in_reach, linked_classes, list_entries, overlap_report, overlapping_pairs, placed, vector_sketch, words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.lists(st.integers(0, 6), min_size=1, max_size=40))
def test_common_words_and_bounds(a, b):
    exact = lcs(a, b)
    assert common_words(a, b) == exact
    x, y, most = np.array(a), np.array(b), max(len(a), len(b))
    if exact >= 0.8 * most:
        assert dot_product(x, y) >= 0.8 - 1e-9
        assert in_reach(x, placed(y), int(most - 0.8 * most + 1e-9)) >= 0.8 * most - 1e-9


def test_words():
    assert words_of("Ａ Héllo, wоrld!  א-ב") == ["a", "héllo", "world", "אב"]
    assert words_of("你好，ab 猫") == ["你", "好", "ab", "猫"]
    assert words_of(None) == [] == words_of(" ... ")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(st.sampled_from("aB é.\u05d0\u4f60\u0e01\u0e31 \n-\U0001f600\u0301"), max_size=40)), max_size=5))
def test_hashed_words(texts):
    words, n, letters = HashedWords()(texts)
    want = [words_of(t) for t in texts]
    assert n.tolist() == [*map(len, want)]
    assert letters.tolist() == [sum(any(map(str.isalnum, w)) for w in ws) for ws in want]
    flat = [w for ws in want for w in ws]
    assert len({*zip(flat, words.tolist())}) == len(set(flat)) == len(set(words.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.lists(st.integers(0, 9), min_size=1, max_size=60))
def test_sketch_bounds_what_is_lacking(a, b):
    def sketch(words):
        order, number = overlap._in_order(np.array(words, np.int32), np.zeros(COUNTERS, np.int32))
        return vector_sketch(np.array(words, np.int32)[order], number, 512)

    x, y = sketch(a), sketch(b)
    lacking = sum(max(0, a.count(w) - b.count(w)) for w in set(a))
    assert np.bitwise_count(x & ~y).sum() <= lacking
    half = lambda s: s[:4] | s[4:]
    assert np.bitwise_count(half(x) & ~half(y)).sum() <= lacking


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 120))]
        rows.append((10 * i, " ".join(words), True))
        for k, rate in enumerate((0.0, 0.05, 0.12, 0.3)):
            changed = [rng.choice(vocabulary) if rng.random() < rate else w for w in words]
            rows.append((10 * i + k + 1, (" ".join(changed)).upper() + " !!", k % 2 == 0 and None if k == 3 else False))
    rows += [(9001, None, True), (9002, "", False), (9003, "too short a text", True), (9004, "too short a text", False)]
    df = spark.createDataFrame(rows, "id long, text string, first boolean")
    got = {tuple(r) for r in overlapping_pairs(df, "id", "text", "first").collect()}
    words = {i: words_of(t) for i, t, f in rows}
    first = [i for i, _, f in rows if f is True and len(words[i]) >= 10]
    second = [i for i, _, f in rows if f is False and len(words[i]) >= 10]
    want = {(min(a, b), max(a, b)) for a in first for b in second if lcs(words[a], words[b]) >= 0.8 * max(len(words[a]), len(words[b]))}
    assert want and got == want


def test_copies_and_edges(spark):
    text = " ".join(f"word{i}" for i in range(12))
    rows = [(i, text, i % 2 == 0) for i in range(6)] + [(7, text, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, first boolean, words int")
    pairs = overlapping_pairs(df, "id", "text", "first")
    assert {tuple(r) for r in pairs.collect()} == {(min(a, b), max(a, b)) for a in (0, 2, 4) for b in (1, 3, 5)}
    members, links = linked_classes(df, "id", "text", "first")
    report = overlap_report(df.withColumnRenamed("words", "source").withColumn("split", df["first"]), members, links, "id", "split", "source")
    assert {(r.split, r.records, r.overlapping, r.links) for r in report.collect()} == {(True, 3, 3, 9), (False, 3, 3, 9), (None, 1, 0, 0)}
    assert overlapping_pairs(df.limit(0), "id", "text", "first").count() == 0


def test_entries_need_ten_words():
    words = np.arange(10, dtype=np.int64)
    assert len(list_entries(words, np.zeros(COUNTERS, np.int32), 0.8)) > 0


def test_changed_words_that_are_unique(spark):
    """The differing words are the rarest ones and stand between frequent words."""
    rng = random.Random(5)
    frequent = [f"w{int(1.3 ** (rng.random() * 20))}" for _ in range(4000)]
    rows = []
    for i in range(15):
        words = [rng.choice(frequent) for _ in range(rng.randrange(60, 160))]
        rows.append((10 * i, " ".join(words), True))
        for k, step in enumerate((12, 6, 5)):
            changed = [f"u{i}x{k}x{p}" if p % step == step - 1 else w for p, w in enumerate(words)]
            rows.append((10 * i + k + 1, " ".join(changed), False))
        dropped = [w for p, w in enumerate(words) if p % 6 != 5]
        rows.append((10 * i + 4, " ".join(dropped), False))
    df = spark.createDataFrame(rows, "id long, text string, first boolean")
    got = {tuple(r) for r in overlapping_pairs(df, "id", "text", "first").collect()}
    words = {i: t.split() for i, t, _ in rows}
    first, second = ([i for i, _, f in rows if f is side] for side in (True, False))
    want = {(min(a, b), max(a, b)) for a in first for b in second if lcs(words[a], words[b]) >= 0.8 * max(len(words[a]), len(words[b]))}
    assert len(want) >= 60 and got == want


def test_revisions_of_many_lengths(spark, monkeypatch):
    """Recall 1 for rare words in place of 8 to 19 % of the words, at random and evenly, in texts of 30 to 300 words."""
    monkeypatch.setattr(overlap, "HOT", 20)
    monkeypatch.setattr(overlap, "SALTED", 40)
    rng = random.Random(7)
    frequent = [f"w{int(1.25 ** (rng.random() * 30))}" for _ in range(6000)]
    rows, item = [], 0
    for length in (30, 60, 120, 300):
        for _ in range(6):
            words = [rng.choice(frequent) for _ in range(length)]
            first, item = item, item + 1
            rows.append((first, " ".join(words), True))
            for share in (0.08, 0.12, 0.16, 0.19):
                count = int(share * length)
                for places in (set(rng.sample(range(length), count)), {int((k + 0.5) * length / count) for k in range(count)}):
                    rows.append((item, " ".join(f"rare{item}x{p}" if p in places else w for p, w in enumerate(words)), False))
                    item += 1
    df = spark.createDataFrame(rows, "id long, text string, first boolean")
    got = {tuple(r) for r in overlapping_pairs(df, "id", "text", "first").collect()}
    words = {i: t.split() for i, t, _ in rows}
    first, second = ([i for i, _, f in rows if f is side] for side in (True, False))
    want = {(a, b) for a in first for b in second if lcs(words[a], words[b]) >= 0.8 * max(len(words[a]), len(words[b]))}
    assert len(want) >= 4 * 6 * 8 and {(min(p), max(p)) for p in want} == got


def test_few_pairs_are_held_against_each_other():
    """Texts of one small vocabulary share words, but few hold a whole group of another; all true pairs are among them."""
    rng = np.random.default_rng(11)
    share = 1 / np.arange(10, 1010)
    texts = [rng.choice(1000, size, p=share / share.sum()).astype(np.int32) for size in rng.integers(100, 200, 800)]
    changed = []
    for k, x in enumerate(texts[:200]):
        at = rng.random(len(x)) < 0.17
        changed.append(np.where(at, 2000 + k, x).astype(np.int32))

    def part(texts):
        texts = sorted(texts, key=len)
        return overlap._Texts(np.arange(len(texts)), np.concatenate(texts), np.array([*map(len, texts)]))

    a, b = part(texts), part(changed + texts[400:700])
    i, j = overlap._Block(b, overlap.HOT).near(a, 0.8)
    bags = lambda held: [np.bincount(held[k], minlength=2200) for k in range(len(held.n))]
    bags_a, bags_b = bags(a), np.array(bags(b))
    want = {(k, m) for k, x in enumerate(bags_a) for m in np.flatnonzero(np.minimum(x, bags_b).sum(1) >= 0.8 * np.maximum(a.n[k], b.n)).tolist()}
    near = {*zip(i.tolist(), j.tolist())}
    assert len(want) > 300 and want <= near and len(near) < 0.05 * len(a.n) * len(b.n)
    left = {*zip(*(x.tolist() for x in overlap._alike(a, b, i, j, 0.8)))}
    assert {(k, m) for k, m in want if lcs(a[k].tolist(), b[m].tolist()) >= 0.8 * max(a.n[k], b.n[m])} <= left


def test_many_at_once_as_one_by_one():
    """Texts of few different words pass all sketches: their subsequences are worked out together."""
    rng = np.random.default_rng(12)
    for _ in range(60):
        y = rng.integers(0, 8, rng.integers(1, 300)).astype(np.int32)
        xs = [rng.integers(0, 9, size).astype(np.int32) for size in rng.integers(1, 300, 10)]
        xs += [np.where(rng.random(len(y)) < 0.15, 9, y).astype(np.int32) for _ in range(10)]
        exact = np.array([common_words(x.tolist(), y.tolist()) for x in xs])
        least = exact + rng.integers(-2, 3, len(xs))
        assert (overlap.reaching_words(y, xs, least) == (exact >= least)).all()


def test_long_texts_of_few_words_and_many_blocks(spark, monkeypatch):
    """The same pairs as brute force where a block holds a few texts and many texts are compared at once."""
    monkeypatch.setattr(overlap, "SALTED", 3000)
    rng = random.Random(13)
    rows, item = [], 0
    for side in (True, False):
        for _ in range(40):
            rows.append((item, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(280, 330))), side))
            item += 1
    for k in range(0, 40, 4):
        changed = [w if rng.random() > 0.15 else "z" for w in rows[k][1].split()]
        rows.append((item, " ".join(changed), False))
        item += 1
    df = spark.createDataFrame(rows, "id long, text string, first boolean")
    got = {tuple(r) for r in overlapping_pairs(df, "id", "text", "first").collect()}
    words = {i: t.split() for i, t, _ in rows}
    first, second = ([i for i, _, f in rows if f is side] for side in (True, False))
    want = {(a, b) for a in first for b in second if common_words(words[a], words[b]) >= 0.8 * max(len(words[a]), len(words[b]))}
    assert len(want) >= 10 and got == want
