import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillmetry import constants as C
from quillmetry.operators import baseline, diagnoses, features, frames, issues, scoring

FIELDS = [f.split(":")[0] for f in frames.TOKEN_TYPE[7:-1].split(",")]


def token(i, surface="w", lemma=None, pos="NOUN", gender=None, number=None, binyan=None, deprel="obj", head=0, ambiguity=1):
    return (i, surface, lemma, pos, gender, number, binyan, deprel, head, ambiguity)


def documents(spark, *docs):
    rows = [(i, [[dict(zip(FIELDS, t)) for t in s] for s in d] if d is not None else None) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, f"doc_id int, parsed array<array<{frames.TOKEN_TYPE}>>")


def tree(*heads):
    return [token(i + 1, head=h, deprel="root" if h == 0 else "obj") for i, h in enumerate(heads)]


def depth(heads, from_root=False):
    best = 0
    for i in range(len(heads)):
        seen, at, d = set(), i + 1, 0
        while at > 0 and at not in seen and at <= len(heads):
            seen.add(at)
            d, at = d + 1, heads[at - 1]
        best = max(best, d if at == 0 else 0)
    return max(best - 1, 0) if from_root else best


def test_depth(spark):
    rng = random.Random(4)
    trees = [[0, 1, 2, 3], [0, 1, 1, 1], [2, 3, 1], [0, 0, 2], [], [2, 1, 0, 3], [1], [0] + [i for i in range(1, 40)], *([rng.randrange(0, 13) for _ in range(12)] for _ in range(20))]
    df = documents(spark, *([tree(*t)] for t in trees)).select("doc_id", F.explode("parsed").alias("toks"))
    got = {r.doc_id: (r.a, r.b) for r in df.select("doc_id", frames.tree_depth(F.col("toks")).alias("a"), frames.tree_depth(F.col("toks"), True).alias("b")).collect()}
    assert got == {i: (depth(t), depth(t, True)) for i, t in enumerate(trees)}


def test_formulas(spark):
    one = [token(1, "a", "x", "VERB", "M", "S", "PAAL", "root", 0, 2), token(2, "b", "y", "NOUN", "F", "S", None, "nsubj", 1, 4), token(3, "a", "x", "NOUN", "M", None, None, "ccomp", 1, 3)]
    two = [token(1, "a", "x", "PRON", None, None, None, "root", 0, 1), token(2, ".", ".", "PUNCT", None, None, None, "obj", 1, 1)]
    f = features.document_features(documents(spark, [one, two]), "doc_id").first()
    assert f.verb_ratio == pytest.approx(1 / 5) and f.construct_ratio == pytest.approx(1 / 5) and f.agreement_error_rate == 1.0
    assert f.avg_sentence_length == 2.5 and f.max_tree_depth == 2 and f.avg_tree_depth == 2
    assert f.avg_dependency_distance == pytest.approx((1 + 1 + 2 + 1 + 1) / 5) and f.subordinate_clause_ratio == pytest.approx(1 / 3)
    assert f.right_branching_ratio == 1 and f.dependency_distance_variance == pytest.approx(1 / 3)
    assert f.type_token_ratio == pytest.approx(3 / 5) and f.hapax_ratio == pytest.approx(2 / 5) and f.morphological_ambiguity == pytest.approx(11 / 5)
    assert f.sentence_length_variance == 0.5 and f.sentence_length_trend == -1 and f.sentence_overlap == pytest.approx(1 / 3)
    assert f.missing_terminal_punctuation_ratio == 0.5 and f.short_sentence_ratio == 0.5 and f.binyan_entropy == 0
    assert f.clause_type_entropy == pytest.approx(-(0.4 * math.log(0.4) + 3 * 0.2 * math.log(0.2)))
    shares = {"VERB": (1 / 3, 0), "NOUN": (2 / 3, 0), "PRON": (0, 1 / 2), "PUNCT": (0, 1 / 2)}
    assert f.pos_distribution_variance == pytest.approx(sum((a - b) ** 2 / 2 for a, b in shares.values()) / 4)
    assert f.rare_word_ratio is None


def test_nothing_and_missing_layers(spark):
    df = documents(spark, [], None, [[]]).withColumn("here", F.lit(False))
    rows = features.document_features(df, "doc_id").collect()
    assert all(r[n] == 0.0 for r in rows for n in C.FEATURES if n not in ("rare_word_ratio", "short_sentence_ratio", "missing_terminal_punctuation_ratio"))
    gated = features.document_features(df, "doc_id", has_morphology="here", has_syntax="here").first()
    assert all(gated[n] is None for n in C.FEATURE_GROUPS["morphology"] + C.FEATURE_GROUPS["syntax"]) and gated.type_token_ratio == 0.0


def test_rare_words(spark):
    df = documents(spark, [[token(1, "a"), token(2, "b"), token(3, "b"), token(4, "c")]], [])
    words = spark.createDataFrame([("a", 9), ("b", 2)], "token string, cnt long")
    got = {r.doc_id: r.rare_word_ratio for r in features.document_features(features.rare_words(df, "doc_id", words), "doc_id").collect()}
    assert got == {0: 0.75, 1: 0.0}


def test_table_annotation(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    toks = spark.createDataFrame([(1, 0, k, *token(k + 1, s)) for k, s in enumerate("abc")] + [(1, 1, 0, *token(1, "d"))], "doc_id int, sent_idx int, tok_idx int, " + ", ".join(f.replace(":", " ") for f in frames.TOKEN_TYPE[7:-1].split(",")))
    got = {r.doc_id: r.parsed and [[t.surface for t in s] for s in r.parsed] for r in frames.from_table(docs, toks, "doc_id").collect()}
    assert got == {1: [["a", "b", "c"], ["d"]], 2: None}


def test_scores(spark):
    names = [*C.RANGES, *C.PASS_THROUGH]
    full = {n: 0.5 for n in names} | {"avg_sentence_length": 25.0, "sentence_length_trend": -1.5}
    none = dict.fromkeys(names)
    part = none | {"hapax_ratio": 0.55, "avg_sentence_length": 10.0}
    df = spark.createDataFrame([tuple(d[n] for n in names) for d in (full, none, part)], ", ".join(f"{n} double" for n in names))
    rows = scoring.with_scores(df).collect()
    assert all(0 <= rows[0][k] <= 1 for k in ("difficulty", "fluency", "cohesion", "complexity"))
    assert all(rows[1][k] is None for k in C.SCORE_KEYS)
    assert rows[2].difficulty == pytest.approx(0.25 / 0.55) and rows[2].style == pytest.approx(-0.25) and rows[2].fluency is None


def test_baseline(spark):
    values = [float(i) for i in range(40)] + [1e6, None, float("nan")]
    long = spark.createDataFrame([("a", v) for v in values] + [("c", 2.0)] * 3 + [("n", None)], "feature string, value double")
    got = {r.feature: r for r in baseline.feature_stats(long).collect()}
    assert set(got) == {"a", "c"} and got["a"].valid_count == 41 and got["a"].max == 1e6 and got["a"].mean < 21 and not got["a"].unstable
    assert got["c"].degenerate and got["c"].unstable and got["c"].std == 0
    rough = {r.feature: r for r in baseline.feature_stats(long, approximate=True).collect()}
    assert abs(rough["a"].p50 - got["a"].p50) <= 1
    soft = lambda v, m, s: spark.range(1).select(baseline.soft_score(F.lit(v), F.lit(m), F.lit(s))).first()[0]
    assert (soft(1.0, 1.0, 2.0), soft(5.0, 1.0, 0.0), soft(1e9, 0.0, 1.0), soft(-1e9, 0.0, 1.0)) == (0.5, 0.5, 1.0, 0.0)


def _issues(spark):
    docs = spark.createDataFrame([(1, "One two three. One two. Four five six seven!"), (2, None), (3, "Word")], "doc_id int, text string")
    wide = features.document_features(frames.analysed(docs), "doc_id", ("m",))
    stats = baseline.feature_stats(baseline.long_features(wide.drop("m"), "doc_id"))
    return issues.detect(wide, stats, "doc_id")


def test_issues(spark):
    found = _issues(spark)
    rows = issues.issue_rows(found, "doc_id").collect()
    mine = [r for r in rows if r.doc_id == 1]
    assert [r.emit_order for r in mine] == list(range(len(mine)))
    assert [r.span for r in mine if r.type == "sentence_complexity"] == [[0], [1], [2]] and [r.span for r in mine if r.type == "weak_cohesion"] == [[0, 1], [1, 2]]
    assert not [r for r in rows if r.type == "rare_word_overuse"] and all(0 <= r.severity <= 1 and 0 <= r.confidence <= 1 for r in rows)
    top = issues.ranked(found, "doc_id", 4).collect()
    assert all(len([r for r in top if r.doc_id == d]) == 4 for d in (1, 2, 3))
    scores = [r.rank_score for r in sorted(top, key=lambda r: r.rank) if r.doc_id == 1]
    assert scores == sorted(scores, reverse=True)
    vector = issues.severity_vector(issues.issue_rows(found, "doc_id"), "doc_id").columns
    assert vector == ["doc_id", *C.ISSUE_KEYS]


def test_diagnoses(spark):
    rows = [("weak_cohesion", 0.9, 0.5, [0, 1]), ("weak_cohesion", 0.2, 0.1, [1, 2]), ("missing_connectives", 0.5, 0.4, [0, 3]), ("fragmentation", 0.7, 0.3, [0, 3]), ("fragmentation", 0.9, 0.8, [0, 3]), ("pronoun_ambiguity", 0.7, 0.6, [0, 3])]
    kind = "issues array<struct<type:string,severity:double,confidence:double,span:array<int>>>"
    table = spark.createDataFrame([(1, rows, None, None, None, 1.0, None), (2, [], 1.0, 1.0, 1.0, 1.0, 1.0)], f"doc_id int, {kind}, " + ", ".join(f"{k} double" for k in C.SCORE_KEYS))
    found = diagnoses.diagnose(table, "doc_id")
    all_found = {r.type: r for r in found.collect()}
    got = {k: (round(r.severity, 6), r.confidence) for k, r in all_found.items()}
    assert got == {"low_cohesion": (0.74, 0.1), "fragmented_writing": (0.9, 0.8), "pronoun_overuse": (0.76, 0.6)}
    low = all_found["low_cohesion"]
    assert low.supporting_issues == ["weak_cohesion", "missing_connectives"] and low.supporting_spans == [[0, 1], [1, 2], [0, 3]]
    assert low.evidence == {"max_weak_cohesion_severity": 0.9, "max_missing_connectives_severity": 0.5} and all_found["pronoun_overuse"].evidence["cohesion_score"] == 1.0
    mapped = {r.diagnosis: (r.intervention, len(r.actions), len(r.exercises)) for r in diagnoses.interventions(found, "doc_id").collect()}
    assert mapped == {k: (C.INTERVENTIONS[k][0], 3, 3) for k in got}
    text = json.loads(diagnoses.interpretation_json(found, "doc_id").first().json)
    assert [d["type"] for d in text["diagnoses"]] == ["fragmented_writing", "pronoun_overuse", "low_cohesion"] and [i["target_diagnosis"] for i in text["interventions"]] == [d["type"] for d in text["diagnoses"]]


def test_a_missing_score_is_noted(spark):
    table = spark.createDataFrame([(1, [("pronoun_ambiguity", 0.9, 0.6, [0, 1])], *[None] * 5)], "doc_id int, issues array<struct<type:string,severity:double,confidence:double,span:array<int>>>, " + ", ".join(f"{k} double" for k in C.SCORE_KEYS))
    (row,) = diagnoses.diagnose(table, "doc_id").collect()
    assert row.evidence == {"max_pronoun_ambiguity_severity": 0.9, "cohesion_score": 0.0, "cohesion_missing": 1.0}


def test_issues_carry_evidence(spark):
    found = _issues(spark)
    by_type = {}
    for r in issues.issue_rows(found, "doc_id").collect():
        by_type.setdefault(r.type, set()).update(r.evidence)
    assert by_type["sentence_complexity"] == {"token_count", "tree_depth"} and by_type["weak_cohesion"] == {"jaccard"}
    assert by_type["low_lexical_diversity"] == {"lemma_diversity", "type_token_ratio"}
    assert all({"rank_score", "group_score"} <= set(r.evidence) for r in issues.ranked(found, "doc_id").collect())
    texts = {r.doc_id: json.loads(r.json)["issues"] for r in issues.issues_json(found, "doc_id").collect()}
    assert all(set(i) == {"type", "group", "severity", "confidence", "span", "evidence"} for i in texts[1])


def test_derived_interventions(spark):
    df = spark.createDataFrame([(1, {"low_cohesion": 0.6, "pronoun_overuse": 0.5, "unknown": 0.9}), (2, None)], "id int, diagnoses map<string,double>")
    assert [(r.id, r.diagnosis, r.priority) for r in diagnoses.derived_interventions(df, "id").collect()] == [(1, "low_cohesion", 0.6)]
