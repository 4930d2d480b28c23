"""Corpus quality reports over long tables of values and wide tables of scores."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry import constants as C
from quillmetry.operators.ordering import ranked_within


def _values(long: DataFrame) -> DataFrame:
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def summary_stats(long: DataFrame) -> DataFrame:
    """n, extremes, mean, median, sample deviation, quartiles picked by index, and fences at 1.5 of their distance.

    Quartiles are the sorted values at places n // 4 and 3 n // 4 (first and last below four
    values). Null and NaN are no values.
    """
    rows = _values(long).select("feature", "value")
    ranks = ranked_within(rows, "feature", "value")
    n, at = F.col("group_size"), F.col("rank")
    q1, q3 = F.when(n >= 4, F.floor(n / 4)).otherwise(0), F.when(n >= 4, F.floor(3 * n / 4)).otherwise(n - 1)
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    stats = ranks.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        ((F.max(F.when(at == low, F.col("value"))) + F.max(F.when(at == high, F.col("value")))) / 2).alias("median"),
        F.coalesce(F.try_divide(F.stddev_samp("value"), F.lit(1)), F.lit(0.0)).alias("stdev"),
        F.max(F.when(at == q1, F.col("value"))).alias("q1"),
        F.max(F.when(at == q3, F.col("value"))).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    return stats.select("*", iqr.alias("iqr"), (F.col("q1") - 1.5 * iqr).alias("lower"), (F.col("q3") + 1.5 * iqr).alias("upper"))


def outliers(long: DataFrame) -> DataFrame:
    """Values beyond the fences, with ``side`` LOW or HIGH."""
    fences = summary_stats(long).select("feature", "lower", "upper")
    rows = _values(long).join(fences, "feature")
    side = F.when(F.col("value") < F.col("lower"), "LOW").when(F.col("value") > F.col("upper"), "HIGH")
    return rows.withColumn("side", side).where("side is not null").drop("lower", "upper")


def range_fitness(long: DataFrame) -> DataFrame:
    """How the values of each ranged feature lie to its range, with a suggestion where it fits badly."""
    spark = long.sparkSession
    ranges = spark.createDataFrame([(f, lo, hi) for f, (lo, hi) in C.RANGES.items()], "feature string, low double, high double")
    rows = _values(long).join(F.broadcast(ranges), "feature")  # 16 rows
    counts = rows.groupBy("feature", "low", "high").agg(F.count_if(F.col("value") < F.col("low")).alias("below"), F.count_if(F.col("value") > F.col("high")).alias("above"), F.count(F.lit(1)).alias("n"))
    full = counts.join(summary_stats(long).select("feature", "q1", "q3", "iqr", "min", "max"), "feature")
    share = lambda c: 100.0 * F.col(c) / F.col("n")
    clamped = (share("below") > 20) | (share("above") > 20)
    narrow = (F.col("below") + F.col("above") == 0) & (F.col("max") - F.col("min") < 0.3 * (F.col("high") - F.col("low")))
    return full.select(
        "feature",
        "below",
        (F.col("n") - F.col("below") - F.col("above")).alias("inside"),
        "above",
        share("below").alias("pct_below"),
        share("above").alias("pct_above"),
        F.when(clamped, "widen").when(narrow, "tighten").otherwise("fits").alias("verdict"),
        F.when(clamped, F.greatest(F.lit(0.0), F.col("q1") - 0.5 * F.col("iqr"))).alias("suggested_low"),
        F.when(clamped, F.col("q3") + 0.5 * F.col("iqr")).alias("suggested_high"),
    )


def pearson(a: Column, b: Column, least: int = 3) -> Column:
    """Correlation of the pairs where both are there; null below ``least`` pairs or without variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    fine = (F.count(x) >= least) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    return F.when(fine, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlations(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a``, ``b`` and ``r`` of pairs of columns, all from one aggregation."""
    row = wide.agg(*(pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def score_correlations(scores: DataFrame) -> DataFrame:
    """Correlations of the scores with each other; ``redundant`` above 0.7."""
    found = correlations(scores, list(combinations(sorted(C.SCORE_KEYS), 2)))
    return found.select("*", (F.abs("r") > 0.7).alias("redundant"))


def feature_drivers(wide: DataFrame, scores: list[str], features: list[str], least: float = 0.3, top: int = 8) -> DataFrame:
    """Per score, the features that go with it most (|r| above ``least``), at most ``top``."""
    from pyspark.sql import Window

    found = correlations(wide, [(s, f) for s in scores for f in features]).select(F.col("a").alias("score"), F.col("b").alias("feature"), "r").where(F.abs("r") > least)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.round(F.abs("r"), 9).desc(), "feature"))
    return found.withColumn("place", place).where(F.col("place") <= top)


def null_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Counts in equal buckets of 0..1; values outside fall into the first or last one, null and NaN into none."""
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(column))
    bucket = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(F.greatest(F.least(F.col(column), F.lit(1e6)), F.lit(-1e6)) * buckets)))
    return rows.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def layer_health(wide: DataFrame, item: str) -> DataFrame:
    """Documents with each layer, with both, their share, and the first item without both."""
    morphology, syntax = F.col("verb_ratio").isNotNull(), F.col("avg_sentence_length").isNotNull()
    both = morphology & syntax
    return wide.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(morphology).alias("morphology_ok"),
        F.count_if(syntax).alias("syntax_ok"),
        F.count_if(both).alias("both_ok"),
        F.coalesce(F.try_divide(100.0 * F.count_if(both), F.count(F.lit(1))), F.lit(0.0)).alias("pct"),
        F.min(F.when(~both, F.col(item))).alias("first_failing"),
    )


def latency_report(df: DataFrame, column: str, ok: str) -> DataFrame:
    """Mean, p50 and p95 by index, largest, and the share that went well."""
    rows = ranked_within(df.where(F.col(column).isNotNull()).withColumn("__all", F.lit(0)), "__all", column)
    n = F.col("group_size")
    pick = lambda at: F.max(F.when(F.col("rank") == at, F.col(column)))
    return rows.agg(F.avg(column).alias("mean"), pick(F.floor(n / 2)).alias("p50"), pick(F.floor(n * 0.95)).alias("p95"), F.max(column).alias("max"), F.avg(F.col(ok).cast("double")).alias("success"))
