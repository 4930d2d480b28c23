"""Weighted document scores from features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry import constants as C


def norm(x: Column, low: float, high: float) -> Column:
    """x scaled to 0..1 within a range and clamped; 0 for an empty range; null stays null."""
    if low == high:
        return F.when(x.isNotNull(), 0.0)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def weighted_mean(parts: list[tuple[float, Column]]) -> Column:
    """Mean of the parts that are there, by weight; null if none is."""
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    total = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def normalized(name: str) -> Column:
    return norm(F.col(name), *C.RANGES[name]) if name in C.RANGES else F.col(name)


def difficulty() -> Column:
    return clamp(weighted_mean([(w, normalized(f)) for f, w in C.DIFFICULTY_WEIGHTS.items()]))


def style() -> Column:
    """Signed sum of the parts that are there, neither re-weighted nor clamped; null if none is."""
    value = lambda f: norm(F.abs(F.col(f)), 0.0, C.RANGES[f][1]) if f == "sentence_length_trend" else normalized(f)
    parts = [(w, value(f)) for f, w in C.STYLE_WEIGHTS.items()]
    total = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(F.coalesce(*(v for _, v in parts)).isNotNull(), total)


def fluency() -> Column:
    return clamp(weighted_mean([(1.0, F.col("punctuation_ratio")), (1.0, 1 - normalized("sentence_length_variance")), (1.0, 1 - normalized("pos_distribution_variance"))]))


def cohesion() -> Column:
    return clamp(weighted_mean([(0.4, normalized("connective_ratio")), (0.3, normalized("sentence_overlap")), (0.3, 1 - normalized("pronoun_to_noun_ratio"))]))


def complexity() -> Column:
    plain = ("binyan_entropy", "agreement_error_rate", "pos_distribution_variance", "clause_type_entropy")
    return clamp(weighted_mean([*((1.0, normalized(f)) for f in plain), (1.0, F.col("construct_ratio") * 0.5)]))


def with_scores(features: DataFrame) -> DataFrame:
    """``features`` with the five score columns. Missing features are left out of the means."""
    return features.select("*", difficulty().alias("difficulty"), style().alias("style"), fluency().alias("fluency"), cohesion().alias("cohesion"), complexity().alias("complexity"))


def normalized_features(features: DataFrame, *keep: str) -> DataFrame:
    """The features of a known range scaled to it, the others as they are."""
    return features.select(*keep, *(normalized(f).alias(f) for f in [*C.RANGES, *C.PASS_THROUGH]))
