"""Corpus preparation: quality gate, frequency dictionary, grouping of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.functions import text as T
from quillmetry.operators.ordering import numbered


def quality_gate(
    df: DataFrame,
    text: str = "text",
    min_length: int = 200,
    max_length: int = 50_000,
    min_sentences: int = 3,
    min_hebrew: float = 0.5,
    max_repetition: float = 0.3,
    max_links: float | None = 0.2,
) -> DataFrame:
    """``df`` with ``reason``, the first test a text fails (null for one that passes). A null text is too short."""
    t = F.coalesce(F.col(text), F.lit(""))
    length = F.length(F.regexp_replace(t, rf"^{T.SPACE}+|{T.SPACE}+$", ""))
    reason = (
        F.when(length < min_length, "too_short")
        .when(length > max_length, "too_long")
        .when(T.sentence_marks(t) < min_sentences, "few_sentences")
        .when(T.script_ratio(t) < min_hebrew, "low_hebrew")
        .when(T.repetition_ratio(t) > max_repetition, "repetitive")
    )
    if max_links is not None:
        reason = reason.when(T.link_ratio(t) > max_links, "url_heavy")
    return df.withColumn("reason", reason)


def rejections(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def frequency_dictionary(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of the words between white space: ``token``, ``cnt``."""
    return df.select(F.explode(T.words(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def fixed_size_groups(lines: DataFrame, size: int, *order: str, text: str = "line", max_groups: int | None = None) -> DataFrame:
    """Non-blank lines in order, ``size`` to a document: ``doc`` (doc_0000001 ...), ``n_lines``, ``text``. The last one may be shorter."""
    kept = lines.withColumn(text, F.regexp_replace(text, rf"^{T.SPACE}+|{T.SPACE}+$", "")).where(F.col(text) != "")
    rows = numbered(kept, *order).withColumn("group", F.floor(F.col("row_no") / size))
    if max_groups is not None:
        rows = rows.where(F.col("group") < max_groups)
    grouped = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("row_no", F.col(text).alias("t")))).alias("parts"))
    return grouped.select(F.format_string("doc_%07d", F.col("group") + 1).alias("doc"), "n_lines", F.array_join(F.col("parts.t"), "\n").alias("text"))


def skip_take(df: DataFrame, *order: str, skip: int = 0, take: int | None = None, prefix: str = "doc_") -> DataFrame:
    """Rows of an order without the first ``skip``, at most ``take``, named from 1 on."""
    rows = numbered(df, *order).where(F.col("row_no") >= skip)
    if take is not None:
        rows = rows.where(F.col("row_no") < skip + take)
    return rows.withColumn("name", F.format_string(prefix + "%07d", F.col("row_no") - skip + 1)).drop("row_no")


def seeded_order(item: str, seed: int):
    """A column that orders rows at random, the same way for one seed in any engine."""
    return F.md5(F.concat(F.col(item).cast("string"), F.lit(f"|{seed}")))


def unfinished(df: DataFrame, done: DataFrame, item: str) -> DataFrame:
    """Rows whose item has no result yet."""
    return df.join(done.select(item).distinct(), item, "left_anti")
