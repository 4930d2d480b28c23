"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as JSON lines; null fields are written, characters aren't escaped."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def json_documents(df: DataFrame, path: str, item: str, mode: str = "overwrite") -> None:
    """Each document's JSON under its own folder ``item=...``."""
    df.select(item, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).partitionBy(item).text(path)


def feature_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A baseline as one JSON object from feature to its stats (a row per feature)."""
    names = [c for c in stats.columns if c != "feature"]
    one = stats.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.struct(*names))))).alias("m"))
    one.select(F.to_json("m", {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode(mode).text(path)


def table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def error_summary(results: DataFrame, error: str = "error") -> DataFrame:
    """Counts of rows per error type, and of those without one."""
    return results.groupBy(F.coalesce(error, F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
