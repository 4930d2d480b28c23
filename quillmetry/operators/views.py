"""What an application shows of analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetry import constants as C
from quillmetry.functions import text as T


def shown_diagnoses(diagnoses: DataFrame, item: str, threshold: float = 0.45, most: int = 3) -> DataFrame:
    """Diagnoses above the threshold, the most severe ``most`` of each item (there are at most eight)."""
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.round("severity", 9).desc(), "rule_order"))
    return diagnoses.where(F.col("severity") > threshold).withColumn("place", place).where(F.col("place") <= most)


def shown_interventions(interventions: DataFrame, shown: DataFrame, item: str, most: int = 3) -> DataFrame:
    """Interventions of shown diagnoses only."""
    kept = interventions.join(shown.select(item, F.col("type").alias("diagnosis")), [item, "diagnosis"], "left_semi")
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.round("priority", 9).desc(), "rule_order"))
    return kept.withColumn("place", place).where(F.col("place") <= most)


def highlight(severity: Column) -> Column:
    return F.when(severity > 0.7, "red").when(severity >= 0.4, "yellow").otherwise("none")


def band(severity: Column) -> Column:
    return F.when(severity > 0.7, "high").when(severity > 0.4, "medium").otherwise("low")


def annotated_sentences(records: DataFrame, item: str, text: str, severities: str, least: float = 0.3) -> DataFrame:
    """One row per sentence with its place in the text, its complexity (0 unless above ``least``) and highlight."""
    rows = records.withColumn("__parts", T.sentences(F.col(text))).withColumn("__at", T.offsets(F.col(text), F.col("__parts")))
    rows = rows.select(item, F.col(severities).alias("__s"), F.posexplode(F.arrays_zip(F.col("__parts").alias("part"), F.col("__at").alias("at"))).alias("index", "x"))
    s = F.coalesce(F.get("__s", F.col("index")), F.lit(0.0))
    complexity = F.when(s > least, s).otherwise(0.0)
    return rows.select(item, "index", F.col("x.part").alias("sentence"), F.col("x.at.start").alias("char_start"), F.col("x.at.stop").alias("char_end"), complexity.alias("complexity"), highlight(complexity).alias("highlight"))


def cohesion_gaps(records: DataFrame, item: str, text: str, pairs: str, threshold: float = 0.45) -> DataFrame:
    """Neighbouring sentences with a severity of at least the threshold, and the gap between them."""
    rows = records.withColumn("__at", T.offsets(F.col(text), T.sentences(F.col(text))))
    rows = rows.select(item, "__at", F.posexplode(pairs).alias("index", "severity")).where((F.col("severity") >= threshold) & (F.col("index") + 1 < F.size("__at")))
    return rows.select(item, "index", "severity", F.get("__at", F.col("index"))["stop"].alias("char_start"), F.get("__at", F.col("index") + 1)["start"].alias("char_end"))


def score_changes(scores: DataFrame, item: str, *order: str, shown: float = 0.005) -> DataFrame:
    """Differences of each scoring of an item to the one before it; ``moved`` tells which scores changed visibly."""
    w = Window.partitionBy(item).orderBy(*order)
    rows = scores.withColumn("revision", F.row_number().over(w))
    deltas = [(F.col(k) - F.lag(k).over(w)).alias(f"d_{k}") for k in C.SCORE_KEYS]
    out = rows.select(item, "revision", *deltas).where("revision > 1")
    moved = F.array_join(F.filter(F.array(*(F.when(F.abs(f"d_{k}") > shown, F.lit(k)) for k in C.SCORE_KEYS)), lambda x: x.isNotNull()), ",")
    return out.withColumn("moved", moved)


def active(diagnoses: Column, threshold: float = 0.45) -> Column:
    """Names of the diagnoses above the threshold, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(diagnoses, lambda _, v: v > threshold)))


def diagnosis_changes(before: Column, after: Column) -> Column:
    """Struct of resolved and new diagnoses between two maps."""
    a, b = active(before), active(after)
    return F.struct(F.array_sort(F.array_except(a, b)).alias("resolved"), F.array_sort(F.array_except(b, a)).alias("new"))


def localised(df: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the local name of ``key`` from a table (key, name), and the rows whose key the table lacks."""
    return df.join(names, key), df.join(names, key, "left_anti")


def rewritten(text: Column, start: Column, end: Column, new: Column) -> Column:
    """The text with characters ``start`` to ``end`` replaced."""
    return F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, end + 1, F.length(text)))


def updated_config(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Settings where a non-null new value wins."""
    names = [c for c in old.columns if c != key]
    return old.alias("o").join(new.alias("n"), key, "left").select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in names))


def prompt(text: Column, actions: Column, intro: str = "Rewrite the text. Apply these steps:") -> Column:
    listed = F.array_join(F.transform(actions, lambda a: F.concat(F.lit("- "), a)), "\n")
    return F.concat_ws("\n", F.lit(intro), listed, F.lit("Text:"), text)
