"""Corpus baseline of features, and scores against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry import constants as C

STATS = "mean std min max p10 p25 p50 p75 p90".split()
_PERCENTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def long_features(features: DataFrame, item: str, names: list[str] = C.FEATURES) -> DataFrame:
    """One row per document and feature."""
    return features.unpivot([item], names, "feature", "value")


def feature_stats(long: DataFrame, least: int = 30, approximate: bool = False) -> DataFrame:
    """Per feature: clipped mean and population deviation, plain extremes and percentiles, flags.

    Null and NaN are no values; a feature without values gives no row. Mean and deviation are of
    values clipped to the 5th and 95th percentile. Percentiles are exact with linear
    interpolation; ``approximate`` takes them from mergeable sketches instead, for corpora
    whose distinct values don't fit into a task's memory.
    """
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value")).select("feature", "value")
    if approximate:
        at = lambda q: F.kll_sketch_get_quantile_double("s", F.lit(q))
        cuts = rows.groupBy("feature").agg(F.kll_sketch_agg_double("value", 2000).alias("s")).select("feature", F.array(*(at(q) for q in _PERCENTILES)).alias("p"))
    else:
        cuts = rows.groupBy("feature").agg(F.percentile("value", F.array(*(F.lit(q) for q in _PERCENTILES))).alias("p"))
    clipped = F.least(F.greatest("value", F.col("p")[0]), F.col("p")[6])
    stats = (
        rows.join(F.broadcast(cuts), "feature")  # a row a feature
        .groupBy("feature")
        .agg(
            F.avg(clipped).alias("mean"),
            F.stddev_pop(clipped).alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.first("p").alias("p"),
            F.count(F.lit(1)).alias("valid_count"),
        )
    )
    picked = [F.col("p")[i].alias(n) for i, n in enumerate("p10 p25 p50 p75 p90".split(), 1)]
    # A deviation of rounding errors is none.
    std = F.when(F.col("std") < 1e-12, 0.0).otherwise(F.col("std"))
    return stats.select("feature", "mean", std.alias("std"), "min", "max", *picked, "valid_count", (F.col("valid_count") < least).alias("unstable"), (std == 0).alias("degenerate"))


def similarity_stats(vectors: DataFrame, item: str, place: str, vector: str) -> DataFrame:
    """Dot products of neighbouring vectors of each item, as long rows of ``sentence_cosine_similarity``."""
    from pyspark.sql import Window

    before = F.lag(vector).over(Window.partitionBy(item).orderBy(place))
    pairs = vectors.select(item, F.col(vector).alias("b"), before.alias("a")).where("a is not null")
    return pairs.select(item, F.lit("sentence_cosine_similarity").alias("feature"), dot(F.col("a"), F.col("b")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def soft_score(value: Column, mean: Column, std: Column) -> Column:
    """Sigmoid of the standardised value; 0.5 without deviation."""
    z = (value - mean) / std
    return F.when(std == 0, 0.5).when(z >= 709, 1.0).when(z <= -709, 0.0).otherwise(1 / (1 + F.exp(-z)))


def stability(stats: list[Column]) -> Column:
    """0 if any feature is degenerate, 0.5 if any is unstable, else 1."""
    worst = lambda name: F.greatest(*(s[name].cast("int") for s in stats), F.lit(0))
    return F.when(worst("degenerate") == 1, 0.0).when(worst("unstable") == 1, 0.5).otherwise(1.0)


def stats_map(stats: DataFrame) -> DataFrame:
    """The baseline as one row: ``one`` (always 1) and a map from feature to its stats. It has a row per feature."""
    entry = F.struct("feature", F.struct("mean", "std", "unstable", "degenerate"))
    return stats.agg(F.map_from_entries(F.collect_list(entry)).alias("stats")).withColumn("one", F.lit(1))


def stat(stats: Column, feature: str) -> Column:
    """Stats of a feature; a missing one counts as mean 0.5, deviation 1, unstable."""
    missing = F.struct(F.lit(0.5).alias("mean"), F.lit(1.0).alias("std"), F.lit(True).alias("unstable"), F.lit(False).alias("degenerate"))
    return F.coalesce(F.try_element_at(stats, F.lit(feature)), missing)
