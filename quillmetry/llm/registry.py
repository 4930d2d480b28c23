"""The queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.llm import bpe, level, looks, overlap, packing, pieces, quality, quantiles, segment, topics
from quillmetry.session import spread, staged


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _texts_of(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table with texts, over all cores."""
    return spread(_read(spark, sf_dir, table).select(*columns))


def _by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with ``train``: true in the train split, false in val and test, null elsewhere."""
    records = _texts_of(spark, sf_dir, "training_records", "record_id", "text", "split")
    return records.withColumn("train", F.when(F.col("split") == "train", True).when(F.col("split").isin("val", "test"), False))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlapping_pairs(_by_split(spark, sf_dir), "record_id", "text", "train")
    return pairs.select(F.col("lo").alias("record_lo"), F.col("hi").alias("record_hi"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = overlap.linked_classes(_by_split(spark, sf_dir), "record_id", "text", "train")
    return overlap.overlap_report(_read(spark, sf_dir, "training_records"), members, staged(links, "overlap-links"), "record_id", "split", "source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentence_units(_texts_of(spark, sf_dir, "training_records", "record_id", "text"), "record_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = looks.look_alike_pairs(_read(spark, sf_dir, "normalization_results"), "result_id", "normalized_text")
    return pairs.select(F.col("lo").alias("result_lo"), F.col("hi").alias("result_hi"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every text of the three tables."""
    lines = _read(spark, sf_dir, "normalization_results").select(F.lit("normalization_results").alias("table_name"), F.col("result_id").cast("string").alias("item_key"), F.col("normalized_text").alias("text"))
    rows = looks.with_one_form(_texts(spark, sf_dir).unionByName(lines), "text", "form")
    return rows.select("table_name", "item_key", "form", (~F.col("form").eqNullSafe(F.col("text"))).alias("changed"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "level_labels").select(F.col("record_id").alias("item"), F.col("reading_level").alias("level"))
    records = _texts_of(spark, sf_dir, "training_records", "record_id", "text", "source")
    return level.reading_levels(records, "record_id", "text", "source", labels)


def p4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "level_labels").select(F.col("record_id").alias("item"), F.col("reading_level").alias("level"))
    records = _texts_of(spark, sf_dir, "training_records", "record_id", "text", "source")
    return level.cross_validation(records, "record_id", "text", "source", labels)


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature, source and day; days merged per source; sources merged per feature."""
    flat = _read(spark, sf_dir, "flat_features").select("feature", "source", F.to_date("measured_at").alias("day"), "value")
    inputs = _read(spark, sf_dir, "analysis_inputs").select(F.explode("raw_features").alias("feature", "value"), F.to_date("analysed_at").alias("day"))
    rows = flat.withColumn("origin", F.lit("flat_features")).unionByName(inputs.withColumn("source", F.lit(None).cast("string")).withColumn("origin", F.lit("analysis_inputs")))
    keys = ["origin", "feature", "source", "day"]
    days = quantiles.sketch(rows, keys)
    whole = quantiles.merge(days, ["origin", "feature", "source"])
    features = quantiles.merge(whole, ["origin", "feature"])
    levels = [
        days.withColumn("level", F.lit("day")),
        whole.withColumn("level", F.lit("source")).withColumn("day", F.lit(None).cast("date")),
        features.withColumn("level", F.lit("feature")).withColumn("source", F.lit(None).cast("string")).withColumn("day", F.lit(None).cast("date")),
    ]
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level)
    return quantiles.percentiles(union)


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _texts_of(spark, sf_dir, "training_records", "record_id", "config_id", "text")
    configs = _read(spark, sf_dir, "train_configs").select("config_id", "char_budget", "overlap_chars")
    return records.join(configs, "config_id", "left")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_pieces(_budgets(spark, sf_dir), "record_id", "text", "char_budget", "overlap_chars")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p6_pieces(spark, sf_dir).where("pieces > 1 and (what = 'unit' or no = 0)")
    return found.select("record_id", F.when(F.col("what") == "unit", F.col("no")).otherwise(-1).cast("int").alias("unit_no"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"documents": "doc_id", "training_records": "record_id", "example_texts": "id"}
    out = None
    for table, key in keys.items():
        rows = _texts_of(spark, sf_dir, table, key, "text").select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("item_key"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def p7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_quality(_texts(spark, sf_dir)).select("table_name", "item_key", "quality.*")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_quality(spark, sf_dir).where(F.col("kind").isNotNull()).select("table_name", "item_key", "kind")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_texts_of(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str, config_id: int = 1) -> DataFrame:
    """Documents in containers of one configuration's max_seq_length tokens."""
    capacity = _read(spark, sf_dir, "train_configs").where(F.col("config_id") == config_id).first()["max_seq_length"]
    sizes = bpe.token_counts(_texts_of(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return packing.fill_containers(sizes, "doc_id", "n_tokens", capacity)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "subject_labels").select(F.col("doc_id").alias("item"), "subject")
    return topics.document_subjects(_texts_of(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", _read(spark, sf_dir, "subject_areas"), labels)


def p10_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top terms by which topics were mapped to subjects."""
    labels = _read(spark, sf_dir, "subject_labels").select(F.col("doc_id").alias("item"), "subject")
    return topics.topic_terms(_texts_of(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", _read(spark, sf_dir, "subject_areas"), labels)


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source, language of the text and subject."""
    docs = _read(spark, sf_dir, "documents")
    langs = topics.languages(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
    found = langs.join(p10_found(spark, sf_dir), "doc_id")
    return found.groupBy("source", "language", "subject").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p3_forms, p4_found, p4_validation, p5_percentiles, p6_pieces, p6_found, p7_quality, p7_found, p8_ids, p9_containers, p10_found, p10_topics, p10_composition)}


def oracle_sql() -> dict[str, str]:
    return {}
