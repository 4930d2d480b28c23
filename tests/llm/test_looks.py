import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmetry.llm.looks import look_alike_pairs, one_form, with_one_form


def test_same_look():
    same = [
        ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"), ("abc", "ａｂｃ"), ("5%", "５％"), ("é", "é"),
        ("paco", "раcо"), ("fin", "ﬁn"), ("אבד", "ﬡבﬢ"), ("יי", "ײ"), ("ガ", "ｶﾞ"), ("لا", "ﻻ"), ("أ", "أ"), ("ạ̀", "ạ̀"),
    ]
    for a, b in same:
        assert one_form(a) == one_form(b), (a, b)


def test_different_look():
    for a, b in [("a", "A"), ("e", "é"), ("שלום", "שָׁלום"), ("1", "7"), ("a.", "a,"), ("a b", "a  b"), ("👩‍💻", "👩💻"), ("x²", "x2"), ("a", "b")]:
        assert one_form(a) != one_form(b), (a, b)


def test_null_and_empty():
    assert one_form(None) is None
    assert one_form("") == ""


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_idempotent(text):
    form = one_form(text)
    assert one_form(form) == form
    assert unicodedata.is_normalized("NFC", form)


def test_pairs(spark):
    rows = [(1, "abc"), (2, "ａｂｃ"), (3, "abc"), (4, "ab​c"), (5, "Abc"), (6, None), (None, "abc"), (7, ""), (8, "​"), (2, "ａｂｃ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "item long, text string, form string")
    got = {tuple(r) for r in look_alike_pairs(df, "item", "text").collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)}
    assert look_alike_pairs(df.limit(0), "item", "text").count() == 0


def test_column(spark):
    df = spark.createDataFrame([(1, "ａ", "kept"), (2, None, None)], "id int, text string, __x string")
    assert [tuple(r) for r in with_one_form(df).orderBy("id").collect()] == [(1, "ａ", "kept", "a"), (2, None, None, None)]
    assert with_one_form(df, out="text").columns == df.columns


def test_every_code_point_is_mapped_to_a_fixed_point():
    wrong = []
    for cp in range(0x110000):
        if not 0xD800 <= cp <= 0xDFFF and unicodedata.category(chr(cp)) not in ("Cn", "Co"):
            form = one_form(chr(cp))
            if form != chr(cp) and (one_form(form) != form or not unicodedata.is_normalized("NFC", form)):
                wrong.append(hex(cp))
    assert wrong == []


def test_look_alikes_of_other_scripts():
    assert one_form("\u0585\u0578 \u13aa \ua4d0 \u0261\u0251 \u04cf \u0475 \u03f2 a\u2010b a\u2011b") == "on A B ga l v c a-b a-b"
