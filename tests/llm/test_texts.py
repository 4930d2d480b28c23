import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmetry.llm import bpe, level, packing, pieces, quality, quantiles, topics
from quillmetry.llm.segment import Model

PROSE = "The council met on Monday. They talked about the new road for a long time, and nobody agreed. In the end it was late."


def kinds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r.id: r.quality.kind for r in quality.with_quality(df).collect()}


def test_kinds(spark):
    got = kinds(
        spark,
        [
            PROSE,
            PROSE + "\n- one thing\n- another thing\n- a third",
            "\n".join(PROSE.split(". ")) + ".",
            "- bread\n- milk 2\n- eggs\n- salt",
            "1) bread\n2) milk\n3) eggs",
            "chapter one ........ 3\nchapter two ........ 18\nchapter three ........ 40",
            "a | b | c\n1 | 2.5 | 3\n4 | 5 | 6",
            "name,x,y\nab,1,2.5\ncd,3,4\nef,5,6",
            "~#$%^&*|=+<>@~#$%^&*|=+<>\n%^&*|=+<>@~#$%^&*|=",
            "aaaaaaaaaaaaaaaaaaaaaaaaa\nbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb~~~~",
            "b+DmBl5+gjmhicH75m6nEn7binHML2hEdhn2F5PLIdgdD0bj\n6d3BJLdNb8emCi7bhijF4DPOa2CIbHHCHe/Ad32cIeGGBm5A",
            None,
            "",
            " \n ",
        ],
    )
    assert [got[i] for i in range(14)] == [None, None, None, "list", "list", "list", "table", "table", "junk", "junk", "junk", None, None, None]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat sat.\n- on mats", "x"), (2, None, "y")], "id int, text string, quality string")
    rows = {r.id: r.quality for r in quality.with_quality(df).collect()}
    q = rows[1]
    assert (q.word_count, q.n_lines, q.bullet_line_share, q.end_line_share) == (6, 2, 0.5, 0.5)
    assert q.mean_word_length == pytest.approx(q.n_chars / 6) and q.common_word_share == pytest.approx(2 / 6)
    assert rows[2].word_count == 0 and rows[2].mean_word_length is None
    assert quality.with_quality(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(1, 60), st.integers(0, 80), st.lists(st.integers(1, 400), max_size=20), st.lists(st.integers(1, 400), max_size=40))
def test_cut(length, limit, overlap, units, words):
    units, words = sorted({u for u in units if u <= length}), sorted({w for w in words if w <= length})
    got = pieces.cut(length, limit, overlap, units, words)
    assert got[0][0] == 0 and got[-1][1] == length
    shared = min(overlap, limit - 1)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert c == b - shared and d > b
    assert all(b - a <= limit for a, b, _ in got)


def test_pieces(spark):
    rows = [(1, "One two three. Four five six. Seven eight.", 20, 4), (2, "short", 20, 0), (3, None, 5, 0), (4, "any length " * 9, None, 0), (5, "x" * 50 + ". End.", 20, 0)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id int, text string, most int, back int, what string")
    out = pieces.oversized_pieces(df, "id", "text", "most", "back", Model()).collect()
    assert {(r.id, r.no) for r in out if r.what == "unit"} == {(5, 0)}
    first = sorted((r.no, r.char_start, r.char_end, r.cut) for r in out if r.id == 1)
    assert first[0] == (0, 0, 14, "unit") and first[1][1] == 10
    assert {r.id: r.pieces for r in out if r.id in (2, 4)} == {2: 1, 4: 1} and not [r for r in out if r.id == 3]


def test_percentiles(spark):
    rng = np.random.default_rng(5)
    values = rng.lognormal(size=40_000)
    rows = [("f", int(i % 4), float(v)) for i, v in enumerate(values)] + [("f", 0, None), ("f", 1, float("nan")), ("none", 0, None), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "feature string, day int, value double")
    days = quantiles.sketch(df, ["feature", "day"])
    whole = quantiles.percentiles(quantiles.merge(days, ["feature"]))
    got = {r.feature: r for r in whole.collect()}
    assert set(got) == {"f", None} and got["f"].n == 40_000 and got[None].p50 == 1.0 and got[None].rank_error == 0
    ordered = np.sort(values)
    for name, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
        assert abs(np.searchsorted(ordered, got["f"][name]) / len(ordered) - q) <= 2 * quantiles.rank_error()
    assert quantiles.percentiles(quantiles.sketch(df.limit(0), ["feature"])).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


TEXTS = ["Hello world, it's 2024!", "שלום עולם", "", None, "  a\n\n b", "a" * 700, "你好 😀", "naïve café", "<|endoftext|> x"]


def test_ids(spark, vocabulary):
    encoder = tiktoken.Encoding("check", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    df = spark.createDataFrame([(i % 8, t, 1) for i, t in enumerate(TEXTS)], "id int, text string, ids int")
    want = sorted((i % 8, encoder.encode_ordinary(t) if t else []) for i, t in enumerate(TEXTS))
    for held in (bpe.HELD_IDS, 0):
        got = bpe.encode(df, "id", "text", vocabulary, held)
        assert sorted((r.id, r.ids) for r in got.collect()) == want
    back = bpe.decode(got, "ids", "again", vocabulary).collect()
    assert sorted(r.again for r in back) == sorted(t or "" for t in TEXTS)
    assert bpe.encode(df.limit(0), "id", "text", vocabulary).count() == 0
    counts = bpe.token_counts(df, "id", "text").collect()
    assert sorted(r.n_tokens for r in counts) == sorted(len(ids) for _, ids in want)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_best_fit(counts):
    rows, n = packing.best_fit(counts, 50)
    load, placed = [0] * n, dict.fromkeys(counts, 0)
    for size, low, high, start, each in rows:
        for r in range(low, high):
            load[start + (r - low) // each] += size
            placed[size] += 1
    assert placed == counts and all(0 < x <= 50 for x in load)
    total = sum(s * c for s, c in counts.items())
    assert n <= 2 * total / 50 + 1


def test_containers(spark):
    rng = random.Random(1)
    rows = [(i % 90, rng.choice([0, 1, 7, 7, 7, 20, 31, 64, 130])) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, n int, container int")
    out = packing.fill_containers(df, "id", "n", 32).collect()
    load = {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.units
    assert max(load.values()) <= 32 and sum(load.values()) == sum(n or 0 for _, n in rows)
    assert len([r for r in out if r.piece_no == 0]) == len(rows)
    assert packing.fill_containers(df.limit(0), "id", "n", 32).count() == 0


def test_levels(spark):
    easy, hard = "I have a cat. It is red. We ran home. ", "Notwithstanding considerable institutional reservations, the methodological foundations of contemporary interpretation necessitate comprehensive reassessment of categorical distinctions. "
    rows = [(i, (easy if i % 2 else hard) * (3 + i % 5), f"s{i % 6}") for i in range(80)] + [(900, None, "s"), (901, "", "s"), (902, "- a\n- b\n- c", "s"), (903, "x" * 1200 + ".", "s"), (904, "Это русский текст. Он короткий.", "s")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, text string, source string, features int")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 4) for i in range(60)] + [(0, None), (1, 9)], "item int, level int")
    got = {r.id: r.reading_level for r in level.reading_levels(df, "id", "text", "source", labels).collect()}
    assert got == {i: 1 if i % 2 else 4 for i in range(80)}
    assert level.reading_levels(df, "id", "text", "source", labels.limit(0)).count() == 0
    check = level.cross_validation(df, "id", "text", "source", labels).collect()
    assert sum(r.graded for r in check) == 60 == sum(r.right for r in check)


def test_subjects(spark):
    words = {"sport": "coach goal stadium league striker medal".split(), "law": "court judge lawsuit statute verdict clause".split()}
    plain = "street window morning friend letter idea".split()
    rng = random.Random(2)

    def text(*subjects):
        return " ".join(f"We saw the {rng.choice(words[rng.choice(subjects)] if subjects else plain)} near the {rng.choice(plain)} of number{rng.randrange(900)}." for _ in range(8))

    truth = {i: (["sport"], ["law"], [], ["law", "sport"])[i % 4] for i in range(160)}
    rows = [(i, text(*truth[i])) for i in truth] + [(900, None), (901, "- goal\n- coach\n- league")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, subject string")
    labels = spark.createDataFrame([(i, s) for i in range(100) for s in truth[i]] + [(2, None)], "item long, subject string")
    areas = spark.createDataFrame([("sport", "coach, goal"), ("law", "court, judge")], "subject string, description string")
    found = {}
    for r in topics.document_subjects(df, "doc_id", "text", areas, labels).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(found.get(i, set()) == set(truth[i]) for i in truth)
    assert right >= 0.9 * len(truth) and 900 not in found and 901 not in found
    assert topics.document_subjects(df.limit(0), "doc_id", "text", areas, labels).count() == 0


def test_items_and_rows_with_end_marks(spark):
    got = kinds(
        spark,
        [
            "- Buy milk and bread.\n" * 30,
            "\n".join(f"{i}. Ask the neighbours about it." for i in range(1, 9)),
            "\n".join(f"street {i} | {i * 7} | It was sold." for i in range(9)),
            PROSE + "\n- Buy milk.\n- Buy some bread.\n- Go home now.",
            "1. " + PROSE,
            "\n".join(PROSE.split(". ")) + ".",
            "\u00a0\u2003 \u00a0",
        ],
    )
    assert [got[i] for i in range(7)] == ["list", "list", "table", None, None, None, None]


def test_failures(spark):
    df = spark.createDataFrame([(0, PROSE), (1, "- a\n- b\n- c\n- d"), (2, None), (3, "xyzxyzxyzxyz " * 60)], "id int, text string")
    got = {r.id: set(r.quality.failures) for r in quality.with_quality(df).collect()}
    assert got[0] == {"word count"} and {"bullets", "end marks", "common words", "short lines"} <= got[1]
    assert got[2] == set() and got[3] == {"mean word length", "end marks", "common words"}
