"""Diagnoses from issues and scores, and the interventions mapped to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry import constants as C


def _rule(parts: list[tuple[float, str, str]]) -> tuple[Column, ...]:
    """Severity, confidence, supporting issues, their types and evidence of a rule, from the issues and scores of a row."""
    of = lambda key: F.filter("issues", lambda i: i["type"] == key)
    mine = {key: of(key) for _, how, key in parts if how != "score"}
    worst = lambda xs: F.array_max(F.transform(xs, lambda i: F.struct(i["severity"], i["confidence"])))
    mean = lambda xs: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, i: a + i["severity"]), F.size(xs))
    values, evidence = [], {}
    for _, how, key in parts:
        found = F.col(key) if how == "score" else worst(mine[key])["severity"] if how == "max" else mean(mine[key])
        values.append(F.coalesce(found, F.lit(0.0)))
        evidence[f"{key}_score" if how == "score" else f"{how}_{key}_severity"] = values[-1]
        if how == "score":
            evidence[f"{key}_missing"] = F.when(F.col(key).isNull(), 1.0)
    severity = sum((w * v for (w, _, _), v in zip(parts, values)), F.lit(0.0)) / sum(w for w, _, _ in parts)
    supporting = F.concat(*mine.values())
    only = next(iter(mine.values()))
    confidence = worst(only)["confidence"] if len(parts) == 1 else F.array_min(F.transform(supporting, lambda i: i["confidence"]))
    named = F.filter(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in evidence.items())), lambda e: e["value"].isNotNull())
    return severity, F.coalesce(confidence, F.lit(0.0)), F.array_distinct(F.transform(supporting, lambda i: i["type"])), F.transform(supporting, lambda i: i["span"]), F.map_from_entries(named)


def diagnose(issues: DataFrame, item: str) -> DataFrame:
    """Active diagnoses: ``item``, ``type``, ``severity``, ``confidence``, ``supporting_issues``, ``supporting_spans``, ``evidence``, ``rule_order``.

    ``issues`` has the array ``issues`` of ``issues.detect`` and the score columns. A null score counts
    0 and is noted as missing in the evidence. All rules are told inside the row, without a shuffle.
    """
    names = "severity confidence supporting_issues supporting_spans evidence".split()
    rules = []
    for order, (kind, threshold, parts) in enumerate(C.DIAGNOSES):
        found = _rule(parts)
        rules.append(F.when(found[0] > threshold, F.struct(F.lit(kind).alias("type"), *(c.alias(n) for c, n in zip(found, names)), F.lit(order).alias("rule_order"))))
    rows = issues.select(item, F.explode(F.filter(F.array(*rules), lambda d: d.isNotNull())).alias("d"))
    return rows.select(item, "d.*")


def intervention_table(spark) -> DataFrame:
    """The fixed mapping from diagnosis to intervention (8 rows)."""
    rows = [(d, kind, focus.split(), list(C.ACTIONS[d]), list(C.EXERCISES[d])) for d, (kind, focus) in C.INTERVENTIONS.items()]
    return spark.createDataFrame(rows, "type string, intervention string, focus_features array<string>, actions array<string>, exercises array<string>")


def interventions(diagnoses: DataFrame, item: str) -> DataFrame:
    """One intervention per diagnosis (``type``, ``severity``), its priority the severity; unknown diagnoses have none."""
    table = intervention_table(diagnoses.sparkSession)
    joined = diagnoses.join(F.broadcast(table), "type")  # 8 rows
    return joined.select(item, F.col("type").alias("diagnosis"), "intervention", F.col("severity").alias("priority"), "focus_features", "actions", "exercises", "rule_order")


def derived_interventions(records: DataFrame, item: str, threshold: float = 0.5) -> DataFrame:
    """Interventions of the predicted diagnoses (a map) above the threshold. Null maps and values give none."""
    rows = records.select(item, F.explode("diagnoses").alias("type", "severity")).where(F.col("severity") > threshold)
    return interventions(rows.withColumn("rule_order", F.array_position(F.array(*(F.lit(k) for k in C.DIAGNOSIS_KEYS)), F.col("type")) - 1), item)


def interpretation_json(diagnoses: DataFrame, item: str) -> DataFrame:
    """``item`` and ``json``: one object with the arrays ``diagnoses`` and ``interventions``, most severe first (at most eight a document)."""
    both = diagnoses.join(interventions(diagnoses, item).drop("rule_order").withColumnRenamed("diagnosis", "type"), [item, "type"])
    order = [(-F.round("severity", 9)).alias("first"), F.col("rule_order").alias("second")]
    diagnosis = F.struct("type", "confidence", "severity", "supporting_issues", "supporting_spans", "evidence")
    intervention = F.struct(F.col("intervention").alias("type"), "priority", F.col("type").alias("target_diagnosis"), "actions", "exercises", "focus_features")
    entry = F.struct(*order, F.to_json(diagnosis).alias("d"), F.to_json(intervention).alias("i"))
    rows = both.groupBy(item).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return rows.select(item, F.concat(F.lit('{"diagnoses":['), F.array_join("x.d", ","), F.lit('],"interventions":['), F.array_join("x.i", ","), F.lit("]}")).alias("json"))
