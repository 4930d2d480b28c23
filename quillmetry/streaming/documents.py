"""Documents as a stream: features per document, issues against a fixed baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillmetry.operators import features, frames, issues


def document_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def analyse_stream(docs: DataFrame, stats: DataFrame, item: str, out: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Ranked issues of each arriving document, written batch by batch; a batch that runs again replaces its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        analysed = frames.analysed(rows)
        found = issues.detect(features.document_features(analysed, item, ("m",)), stats, item)
        issues.ranked(found, item, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
