import pandas as pd
from pyspark.sql import functions as F

from quillmetry.operators import assembly


def frames(spark):
    nodes = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "c")], "doc int, sent_idx int, node_idx int, form string")
    analyses = spark.createDataFrame([(1, 0, "a", "NOUN"), (1, 1, "b", "VERB"), (2, 0, "x", "NOUN"), (2, 1, "y", "NOUN")], "doc int, k int, surface string, pos string")
    texts = spark.createDataFrame([(1, "a b, c d"), (2, "x"), (3, " ,"), (4, None)], "doc int, text string")
    return nodes, analyses, assembly.placed_tokens(texts, "doc", "text")


def test_tokens(spark):
    toks = frames(spark)[2]
    assert sorted((r.doc, r.k, r.surface, r.start, r.stop) for r in toks.collect()) == [(1, 0, "a", 0, 1), (1, 1, "b", 2, 3), (1, 2, "c", 5, 6), (1, 3, "d", 7, 8), (2, 0, "x", 0, 1)]


def test_alignment(spark):
    nodes, analyses, toks = frames(spark)
    both = {r.k: r for r in assembly.by_syntax(nodes, analyses, toks, "doc").collect()}
    assert [both[k].form for k in range(3)] == ["a", "b", "c"] and both[2].morph is None and both[2].start == 5 and both[1].morph.pos == "VERB"
    alone = sorted((r.doc, r.k, r.surface, r.morph and r.morph.pos, r.stop) for r in assembly.by_morphology(analyses, toks, "doc").collect())
    assert alone == [(1, 0, "a", "NOUN", 1), (1, 1, "b", "VERB", 3), (1, 2, "c", None, 6), (1, 3, "d", None, 8), (2, 0, "x", "NOUN", 1), (2, 1, "y", "NOUN", 0)]
    counts = spark.createDataFrame([(1, 1, 4)], "doc int, token_id int, ambiguity long")
    graded = {r.k: r.ambiguity for r in assembly.with_ambiguity(assembly.by_syntax(nodes, analyses, toks, "doc"), counts, "doc").collect()}
    assert graded == {0: 4, 1: 1, 2: None}


def test_layers_words_and_spans(spark):
    flags = spark.createDataFrame([(1, True, None), (2, True, True)], "doc int, m boolean, s boolean")
    assert {r.doc: r.missing for r in assembly.missing_layers(flags, "m", "s").collect()} == {1: ["syntax"], 2: []}
    words = spark.createDataFrame([(1, 0, "ו", False), (1, 1, "ב", False), (1, 2, "בית", True), (1, 3, "נו", False)], "token_id int, word_idx int, text string, is_core boolean")
    r = assembly.word_parts(words).first()
    assert (r.prefixes, r.suffix) == (["ו", "ב"], "נו")
    toks = frames(spark)[2]
    sents = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 8)], "doc int, index int, char_start int, char_end int")
    assert sorted((r["index"], r.first_token, r.last_token) for r in assembly.token_spans(sents, toks, "doc").collect()) == [(0, 0, 1), (1, 2, 3)]
    assert assembly.token_spans(sents, toks, "doc", 2).count() == 1


def test_hook_and_normalise(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "bad")], "doc int, text string").repartition(2, "doc")

    def model(texts: pd.Series) -> pd.Series:
        if (texts == "bad").any():
            raise ValueError("no")
        return texts.map(lambda t: [{"w": x} for x in t.split()])

    got = {r.doc: r for r in assembly.annotated(df.coalesce(2), model, "doc", "text", "array<struct<w:string>>").collect()}
    assert got[2].parsed is None and "ValueError" in got[2].error
    rows = spark.createDataFrame([("ﬁ“x”…",), ("ascii",), (None,)], "text string")
    assert [r.normalized_text for r in assembly.normalised(rows).collect()] == ['fi"x"...', "ascii", None]
    assert assembly.normalised(rows, out="text").select(F.col("text")).count() == 3
