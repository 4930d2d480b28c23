"""Readers. What can't be read goes to an error column or frame, never away silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.functions import text as T


def text_directory(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per file: ``doc_id`` (its stem), ``path``, ``text``, ``error`` (``EncodingError`` where the bytes aren't UTF-8)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(stem.alias("doc_id"), "path", text.alias("text"), F.when(text.isNull(), "EncodingError").alias("error"))


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def line_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank stripped lines with ``line_no``, rising in file order (numbers aren't dense)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), T.stripped(F.col("value")).alias("line"))
    return lines.where("line <> ''")


def json_directory(spark: SparkSession, path: str, schema: str, exclude: str = "feature_stats.json") -> tuple[DataFrame, DataFrame]:
    """Records of ``*.json`` files, and the files that don't parse."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    rows = files.select("value", F.col("_metadata.file_name").alias("file_name")).where(F.col("file_name") != exclude)
    fine = F.try_parse_json("value").isNotNull()
    good = rows.where(fine).select(F.from_json("value", schema).alias("r"), "file_name").select("r.*", "file_name")
    return good, rows.where(~fine).select("file_name", F.col("value").alias("content"))


def validated(rows: DataFrame, required: tuple[str, ...] = ("text", "features", "scores")) -> tuple[DataFrame, DataFrame]:
    """Rows that have every required column, and the others."""
    there = F.lit(True)
    for name in required:
        there = there & F.col(name).isNotNull()
    return rows.where(there), rows.where(~there)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of a JSON-lines file with ``line_no``. Blank lines are skipped; malformed ones too, or fail the job where ``strict``."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value").where("trim(value) <> ''")
    parsed = lines.select("line_no", F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("fine"))
    return parsed.where("fine").select("line_no", "r.*") if not strict else parsed.select("line_no", "r.*")


def frequency_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``token`` and ``cnt`` of a JSON object; anything but an object raises an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"), "value")
    checked = raw.select(F.when(F.col("value").rlike(r"^\s*\{") & F.col("m").isNotNull(), F.col("m")).otherwise(F.raise_error(F.lit("the dictionary isn't a JSON object")).cast("map<string,bigint>")).alias("m"))
    return checked.select(F.explode("m").alias("token", "cnt"))


def feature_stats(spark: SparkSession, path: str) -> DataFrame:
    """A baseline written by ``sinks.feature_stats``: one object from feature to its stats."""
    fields = "struct<mean:double,std:double,min:double,max:double,p10:double,p25:double,p50:double,p75:double,p90:double,valid_count:bigint,unstable:boolean,degenerate:boolean>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{fields}>")).alias("feature", "s"))
    return raw.select("feature", "s.*")


def several(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def conll(lines: DataFrame, item: str, line: str = "line_no", raw: str = "raw") -> DataFrame:
    """Nodes of tab-separated dependency lines (8 columns at least), with ``sent_idx``: a blank line ends a sentence, empty ones don't count."""
    from pyspark.sql import Window

    w = Window.partitionBy(item).orderBy(line)
    blank = F.trim(raw) == ""
    starts = ~blank & (F.coalesce(F.lag(blank).over(w), F.lit(True)))
    rows = lines.withColumn("__blank", blank).withColumn("sent_idx", F.sum(starts.cast("int")).over(w) - 1)
    cells = F.split(raw, "\t")
    rows = rows.where(~F.col("__blank") & (F.size(cells) >= 8))
    return rows.select(
        item, line, "sent_idx", cells[0].try_cast("int").alias("id"), cells[1].alias("form"), cells[2].alias("lemma"), cells[3].alias("cpostag"), cells[4].alias("postag"), T.feature_map(cells[5]).alias("features"), cells[6].try_cast("int").alias("head"), cells[7].alias("deprel")
    )


def lattice(lines: DataFrame, item: str, raw: str = "raw") -> DataFrame:
    """Edges of tab-separated lattice lines; short lines are dropped."""
    cells = F.split(raw, "\t")
    names = "from_id to_id form lemma cpostag postag feats token_id".split()
    rows = lines.where(F.size(cells) >= 8)
    return rows.select(item, *(cells[i].try_cast("int").alias(n) if n.endswith("_id") else cells[i].alias(n) for i, n in enumerate(names)))


def ambiguity(edges: DataFrame, item: str) -> DataFrame:
    """Number of edges of each token, from 1 to the largest token id; missing ids count 1."""
    counts = edges.groupBy(item, "token_id").agg(F.count(F.lit(1)).alias("n"))
    last = counts.groupBy(item).agg(F.max("token_id").alias("last"))
    every = last.where(F.col("last") >= 1).select(item, F.explode(F.sequence(F.lit(1), F.col("last"))).alias("token_id"))
    return every.join(counts, [item, "token_id"], "left").select(item, "token_id", F.coalesce("n", F.lit(1)).alias("ambiguity"))
