"""Filling containers of a fixed capacity (problem 9).

Bulk-synchronous best fit. Sizes and gaps are integers up to the capacity, so documents of one
size are interchangeable, and so are containers with one gap: documents and gaps are sorted by
their class, and what is matched are classes with counts, of which there are at most as many
as the capacity, whatever the size of the corpus. Each round takes the next smaller size class,
finds its successors among the gaps (the smallest gap that fits), resolves who gets which gap
by rank, and updates the gaps. Only then do the documents, ranked within their class by a
distributed count, look up their container.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmetry.session import staged

#: Rows of a bucket, on the average; each size class is split into as many buckets as its count needs, since one class may hold a large part of all rows.
BUCKET_ROWS = 50_000


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Match size classes (size to count) to containers.

    Returns rows (size, first rank, end rank, first container, items per container): the items
    of ranks ``first`` to ``end`` go to consecutive containers, so many each; and the number of
    containers.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened = 0
    out = []

    def put(gap: int, start: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((start, count))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        rank, n = 0, counts[size]
        while rank < n:
            at = bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                need = -(-(n - rank) // each)
                put(capacity, opened, need)
                opened += need
                continue
            gap = order[at]
            start, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // size
            taken = min(n - rank, count * each)
            full, rest = divmod(taken, each)
            out.append((size, rank, rank + taken, start, each))
            put(gap - each * size, start, full)
            put(gap - rest * size, start + full, 1 if rest else 0)
            put(gap, start + full + (1 if rest else 0), count - full - (1 if rest else 0))
            rank += taken
    return out, opened


def fill_containers(df: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """One row per piece of every item: ``item``, ``piece_no``, ``first_unit``, ``units``, ``container``.

    An item larger than ``capacity`` is divided into pieces that fill a container each, and a
    rest; no other item is divided. Items of size 0, null or below are put into container 0.
    Items may repeat; each row is placed. An empty table gives an empty result.
    """
    if capacity <= 0:
        raise ValueError("the capacity must be positive")
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(n / capacity).cast("long") - 1, F.lit(0))
    pieces = df.select(F.col(item).alias("item"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
    pieces = pieces.select("item", "piece_no", (F.col("piece_no") * capacity).alias("first_unit"), F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).cast("int").alias("units"))
    pieces = staged(pieces, "pieces")
    classes = {r.units: r["count"] for r in pieces.groupBy("units").count().collect()}  # at most ``capacity`` rows
    split = df.sparkSession.createDataFrame([(u, -(-n // BUCKET_ROWS)) for u, n in classes.items()], "units int, buckets long")
    pieces = pieces.join(F.broadcast(split), "units").withColumn("bucket", F.pmod(F.xxhash64("item", "piece_no"), F.col("buckets"))).drop("buckets")
    per = pieces.groupBy("units", "bucket").agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    rows, _ = best_fit(classes, capacity)
    slots = df.sparkSession.createDataFrame(rows, "units int, low long, high long, start long, each long")
    within = Window.partitionBy("units", "bucket").orderBy("item", "piece_no")
    ranked = pieces.withColumn("place", F.row_number().over(within)).join(per.select("units", "bucket", "offset"), ["units", "bucket"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("place") - 1)
    fits = (ranked["units"] == slots["units"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(slots, fits, "left").select("item", "piece_no", "first_unit", ranked["units"], "rank", "low", "start", "each")
    container = F.coalesce(F.col("start") + F.floor((F.col("rank") - F.col("low")) / F.col("each")), F.lit(0))
    return placed.select(F.col("item").alias(item), "piece_no", "first_unit", "units", container.cast("long").alias("container"))
