import re

import pytest
from pyspark.sql import functions as F

from quillmetry.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(s):
    return F.lit(s)


def test_tokens(spark):
    got = value(spark, T.tokens(lit("שלום, world_2024! it's (ok) — a b")))
    assert got == ["שלום", "world", "2024", "it", "s", "ok", "a", "b"]


def test_affixes(spark):
    cases = {"הבית": ("ה", None), "ספרנו": (None, "נו"), "הם": ("ה", None), "ספרי": (None, "י"), "ב": (None, None), "book": (None, None), "aהם": (None, "ם"), "וילדיהם": ("ו", "הם")}
    for token, (prefix, suffix) in cases.items():
        assert value(spark, T.prefix(lit(token))) == prefix, token
        assert value(spark, T.suffix(lit(token))) == suffix, token


def test_sentences(spark):
    assert value(spark, T.sentences(lit("One. Two!  Three?\nFour"))) == ["One.", "Two!", "Three?", "Four"]
    assert value(spark, T.sentences(lit(""))) == []
    text = "One two. Three!\nfour five  \n\nsix"
    assert value(spark, T.parser_sentences(lit(text))) == ["One two.", "four five"]
    assert value(spark, T.parser_sentences(lit(text), False)) == [p.strip() for p in re.split(r"(?<=[.!?׃])\s+|(?<=\n)\n*|(?<!\S)\n+", text.strip()) if p.strip()]


def test_offsets(spark):
    text = "Ab. Cd. Ab. 😀 x"
    parts = value(spark, T.sentences(lit(text)))
    found = value(spark, T.offsets(lit(text), T.sentences(lit(text))))
    assert [text[x.start : x.stop] for x in found] == parts and [x.start for x in found] == sorted(x.start for x in found)


def test_feature_map(spark):
    assert value(spark, T.feature_map(lit("gen=M|num=S|x|key=a=b"))) == {"gen": "M", "num": "S", "key": "a=b"}
    assert value(spark, T.feature_map(lit("_"))) == {} == value(spark, T.feature_map(lit("")))


def test_share_code(spark):
    text = "שלום + a/b?" * 20
    assert value(spark, T.share_text(T.share_code(lit(text)))) == text
    assert value(spark, T.share_text(lit("%%%"))) is None


@pytest.mark.parametrize("text,cut", [("short.", "short."), ("A" * 60 + ". " + "b" * 60, "A" * 60 + ". …"), ("c" * 130, "c" * 100 + "…")])
def test_truncated(spark, text, cut):
    got = value(spark, T.truncated(lit(text), 100))
    assert got == cut.replace(". …", ". …") or got == cut


def test_ratios(spark):
    assert value(spark, T.repetition_ratio(lit("a. b. a. a"))) == 0.5
    assert value(spark, T.repetition_ratio(lit("a"))) == 0.0
    assert value(spark, T.script_ratio(lit("אב cd"))) == 0.5
    assert value(spark, T.script_ratio(lit("  "))) == 0.0
    assert value(spark, T.link_ratio(lit("see www.a.example or x@y.example now"))) == pytest.approx(2 / 5)
    assert value(spark, T.punctuation_mapped(lit("“a” — b…"))) == '"a" - b...'
    assert value(spark, T.parser_input(lit(" a\t b   c "))) == "a b c"
