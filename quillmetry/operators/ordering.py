"""Numbering and ranking of rows without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmetry.session import staged


def numbered(df: DataFrame, *order: str, out: str = "row_no") -> DataFrame:
    """``df`` with a number from 0 in the total order of ``order``.

    Rows are range-partitioned and sorted, each partition numbers its own, and the counts of the
    partitions before (a row per partition) are added. Ties are numbered in no stated order; a
    hash of the row divides them, so that one value in a third of all rows fills no single task.
    """
    kinds = dict(df.dtypes)
    spread = F.xxhash64(*(c for c in df.columns if "map<" not in kinds[c])) if len(set(df.columns) - set(order)) else F.rand(17)
    parts = df.withColumn("__tie", spread).repartitionByRange(*order, "__tie").sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).drop("__tie")
    parts = staged(parts, "numbered")
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__row", within).join(before, "__part").withColumn(out, F.col("__before") + F.col("__row") - 1).drop("__part", "__before", "__row")


def ranked_within(df: DataFrame, key: str, *order: str, out: str = "rank") -> DataFrame:
    """``df`` with a rank from 0 within ``key`` and the size ``group_size`` of the group; a large group is spread over many tasks."""
    rows = numbered(df, key, *order, out="__no")
    first = rows.groupBy(key).agg(F.min("__no").alias("__first"), F.count(F.lit(1)).alias("group_size"))
    same = rows[key].eqNullSafe(first[key])
    return rows.join(first, same).drop(first[key]).withColumn(out, F.col("__no") - F.col("__first")).drop("__no", "__first")
