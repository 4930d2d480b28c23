"""Percentiles of very large numeric columns from mergeable sketches (problem 5).

The sketches are KLL: hierarchies of compactors that sort a full buffer and keep every second
value at random, merged level by level. Spark's own implementation runs in the JVM with
partial aggregation before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch. The rank error of KLL falls nearly as 1 / k.
DEFAULT_K = 400
PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def rank_error(k: int = DEFAULT_K) -> float:
    """Normalised rank error that a single percentile keeps with about 99 % probability (the library's published fit)."""
    return 2.296 / math.pow(k, 0.9021)


def valid(value: str | Column) -> Column:
    """Null and NaN are no values; infinities are."""
    col = F.col(value) if isinstance(value, str) else value
    return col.isNotNull() & ~F.isnan(col)


def sketch(df: DataFrame, keys: list[str], value: str = "value", k: int = DEFAULT_K) -> DataFrame:
    """One sketch per group of ``keys`` (a null key is a group of its own).

    Rows whose value is null or NaN are dropped, so a group without any value gives no row and
    an empty table an empty result. Every other row counts, repeated ones as often as they
    stand. Columns: the keys, ``n`` and ``sketch``; all other columns are ignored.
    """
    rows = df.where(valid(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("__value"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("__value", k).alias("sketch"))


def merge(sketches: DataFrame, keys: list[str], k: int = DEFAULT_K) -> DataFrame:
    """Sketches of finer groups (days, loads, partitions) combined into those of ``keys``."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def percentiles(sketches: DataFrame, wanted: tuple[float, ...] = PERCENTILES, k: int = DEFAULT_K) -> DataFrame:
    """The percentiles of each sketch as ``p10``, ``p50`` ..., and ``rank_error``.

    A group of at most ``k`` values is kept whole, so its answers are exact (error 0).
    """
    cols = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{q * 100:g}") for q in wanted]
    keep = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keep, *cols, F.when(F.col("n") <= k, 0.0).otherwise(rank_error(k)).alias("rank_error"))
