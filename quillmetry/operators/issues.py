"""Writing issues of documents against a baseline, and their ranking (inside the row, without a shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry import constants as C
from quillmetry.operators import baseline as B

GROUPS = ("morphology", "syntax", "lexicon", "structure", "discourse", "style")


EVIDENCE = "array<struct<name:string,value:double>>"
NO_ISSUES = f"array<struct<emission:int,span:array<int>,type:string,issue_group:string,severity:double,confidence:double,evidence:{EVIDENCE}>>"


def _values(named: dict[str, Column]) -> Column:
    """Named values that are there. (A map can't be sorted with the issue that holds it; ``issue_rows`` makes one of it.)"""
    return F.filter(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in named.items())), lambda e: e["value"].isNotNull())


def _issue(kind: str, group: str, severity: Column, share: Column, stats: list[Column], span: Column, evidence: Column) -> Column:
    confidence = F.least(F.lit(1.0), severity * share * B.stability(stats))
    return F.struct(
        F.lit(C.EMISSION[kind]).alias("emission"),
        span.alias("span"),
        F.lit(kind).alias("type"),
        F.lit(group).alias("issue_group"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        evidence.alias("evidence"),
    )


def _stat(feature: str) -> Column:
    return F.col(f"__{feature}")


def _of_document(kind: str, group: str, parts: list[tuple[str, float, bool]], n: Column) -> Column:
    """One issue of the whole document, null unless one of its features is there (a missing one counts 0.5)."""
    terms, here, known = [], [], []
    for feature, weight, inverted in parts:
        st = _stat(feature)
        value = F.col(feature)
        score = B.soft_score(value, st["mean"], st["std"])
        if kind == "sentence_progression_drift":
            score = 2 * F.abs(score - 0.5)
        terms.append(weight * F.when(value.isNotNull(), 1 - score if inverted else score).otherwise(0.5))
        here.append(value.isNotNull().cast("int"))
        known.append(st)
    present = sum(here, F.lit(0))
    issue = _issue(kind, group, sum(terms, F.lit(0.0)), present / len(parts), known, F.array(F.lit(0), n), _values({f: F.col(f) for f, _, _ in parts}))
    return F.when(present > 0, issue)


def detect(features: DataFrame, stats: DataFrame, item: str, metrics: str = "m", keep: tuple[str, ...] = ()) -> DataFrame:
    """``item``, ``keep`` and ``issues``, an array in order of emission, each issue with the values it is told from as ``evidence``.

    ``features`` holds the 32 features and ``metrics``, an array of sentences with ``n`` (tokens),
    ``depth`` (from the virtual root) and ``lemmas``. Spans are sentence indexes: the whole text
    ``[0, N]``, one sentence ``[i]``, or a pair ``[i, i + 1]``. A document without sentences keeps
    its document-level issues.
    """
    rows = features.withColumn("one", F.lit(1)).join(B.stats_map(stats), "one")
    # Looked up once a row, not in every sentence.
    rows = rows.select("*", *(B.stat(F.col("stats"), f).alias(f"__{f}") for f in C.FEATURES))
    m = F.coalesce(F.col(metrics), F.array().cast(features.schema[metrics].dataType))
    n = F.size(m)
    whole = F.array(*(_of_document(kind, group, parts, n) for kind, group, parts in C.ISSUES))
    length, depth, overlap = _stat("avg_sentence_length"), _stat("avg_tree_depth"), _stat("sentence_overlap")
    tokens = lambda x: B.soft_score(x["n"].cast("double"), length["mean"], length["std"])
    deep = lambda x: B.soft_score(F.greatest(x["depth"] - 1, F.lit(0)).cast("double"), depth["mean"], depth["std"])
    each = F.transform(m, lambda x, i: _issue("sentence_complexity", "syntax", 0.6 * tokens(x) + 0.4 * deep(x), F.lit(1.0), [length, depth], F.array(i), _values({"token_count": x["n"], "tree_depth": F.greatest(x["depth"] - 1, F.lit(0))})))

    def pair(i: Column) -> Column:
        a, b = F.get(m, i - 1)["lemmas"], F.get(m, i)["lemmas"]
        alike = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))
        return _issue("weak_cohesion", "discourse", 1 - B.soft_score(alike, overlap["mean"], overlap["std"]), F.lit(1.0), [overlap], F.array(i - 1, i), _values({"jaccard": alike}))

    none = F.array().cast(NO_ISSUES)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), pair)).otherwise(none)
    issues = F.array_sort(F.filter(F.concat(whole, each, pairs), lambda x: x.isNotNull()))
    return rows.select(item, *keep, issues.alias("issues"))


def issue_rows(issues: DataFrame, item: str) -> DataFrame:
    """The issue table: a row per issue with its place ``emit_order`` in the document and the map ``evidence``."""
    return issues.select(item, F.posexplode("issues").alias("emit_order", "x")).select(item, "emit_order", "x.type", "x.issue_group", "x.severity", "x.confidence", "x.span", F.map_from_entries("x.evidence").alias("evidence"))


def ranked(issues: DataFrame, item: str, k: int = 5) -> DataFrame:
    """The top ``k`` issues of each document by 0.7 severity + 0.3 mean severity of the group; ties keep the order of emission."""
    x = F.col("issues")

    def mean_of(group: str) -> Column:
        mine = F.filter(x, lambda i: i["issue_group"] == group)
        return F.try_divide(F.aggregate(mine, F.lit(0.0), lambda a, i: a + i["severity"]), F.size(mine))

    scored = issues.withColumn("means", F.create_map(*(c for g in GROUPS for c in (F.lit(g), mean_of(g)))))
    rank = lambda i: F.round(0.7 * i["severity"] + 0.3 * F.try_element_at(F.col("means"), i["issue_group"]), 9)
    listed = F.transform(x, lambda i, at: F.struct((-rank(i)).alias("order"), at.alias("emit_order"), i.alias("x"), F.try_element_at(F.col("means"), i["issue_group"]).alias("group_score")))
    top = scored.select(item, F.posexplode(F.slice(F.array_sort(listed), 1, k)).alias("place", "t"))
    found = F.map_concat(F.map_from_entries("t.x.evidence"), F.create_map(F.lit("rank_score"), -F.col("t.order"), F.lit("group_score"), F.col("t.group_score")))
    return top.select(
        item, (F.col("place") + 1).alias("rank"), "t.x.type", "t.x.issue_group", "t.x.severity", "t.x.confidence", "t.x.span", (-F.col("t.order")).alias("rank_score"), F.col("t.group_score").alias("group_score"), found.alias("evidence")
    )


def issues_json(issues: DataFrame, item: str) -> DataFrame:
    """``item`` and ``json``: one object with the array ``issues``, each with type, group, severity, confidence, span and evidence."""
    each = F.transform("issues", lambda i: F.struct(i["type"].alias("type"), i["issue_group"].alias("group"), i["severity"].alias("severity"), i["confidence"].alias("confidence"), i["span"].alias("span"), F.map_from_entries(i["evidence"]).alias("evidence")))
    return issues.select(item, F.to_json(F.struct(each.alias("issues"))).alias("json"))


def group_scores(rows: DataFrame, item: str) -> DataFrame:
    return rows.groupBy(item, "issue_group").agg(F.avg("severity").alias("group_score"), F.count(F.lit(1)).alias("issues"))


def severity_vector(rows: DataFrame, item: str, keys: list[str] = C.ISSUE_KEYS, kind: str = "type") -> DataFrame:
    """The largest severity of each type as columns in canonical order, 0 where there is none."""
    return rows.groupBy(item).pivot(kind, keys).agg(F.max("severity")).fillna(0.0, keys)


def span_text(span: Column, sentences: Column) -> Column:
    """The sentence of a span of one, two neighbours joined by `` / ``, else null."""
    first, second = F.get(span, F.lit(0)), F.get(span, F.lit(1))
    both = F.concat_ws(" / ", F.get(sentences, first), F.get(sentences, second))
    return F.when(F.size(span) == 1, F.get(sentences, first)).when(second == first + 1, both)
