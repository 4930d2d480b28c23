"""Putting parser layers and tokens together by their place in the document.

Frames: ``nodes`` (item, sent_idx, node_idx, form, ...) of a dependency parser, ``analyses``
(item, k, ...) of a morphological model and ``tokens`` (item, k, surface, start, stop, prefixes,
suffix) of the tokenizer, ``k`` counting from 0 over the whole document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmetry.functions import text as T


def placed_tokens(df: DataFrame, item: str, text: str) -> DataFrame:
    """The tokens of each text with offsets and affixes; a text without tokens has no row."""
    rows = df.select(item, F.col(text).alias("__t"), T.tokens(F.col(text)).alias("__w"))
    rows = rows.select(item, F.posexplode(F.arrays_zip(F.col("__w").alias("w"), T.offsets(F.col("__t"), F.col("__w")).alias("o"))).alias("k", "x"))
    return rows.select(item, "k", F.col("x.w").alias("surface"), F.col("x.o.start").alias("start"), F.col("x.o.stop").alias("stop"), F.array_compact(F.array(T.prefix(F.col("x.w")))).alias("prefixes"), T.suffix(F.col("x.w")).alias("suffix"))


def with_place(nodes: DataFrame, item: str) -> DataFrame:
    """``nodes`` with ``k``, their number over all sentences of the document."""
    w = Window.partitionBy(item).orderBy("sent_idx", "node_idx")
    return nodes.withColumn("k", F.row_number().over(w) - 1)


def _completed(df: DataFrame) -> DataFrame:
    """A token that is missing has offsets 0, 0 and no prefixes."""
    return df.withColumn("start", F.coalesce("start", F.lit(0))).withColumn("stop", F.coalesce("stop", F.lit(0))).withColumn("prefixes", F.coalesce("prefixes", F.array().cast("array<string>")))


def by_syntax(nodes: DataFrame, analyses: DataFrame, tokens: DataFrame, item: str) -> DataFrame:
    """Parser nodes lead: the k-th node gets the k-th analysis and the k-th token, where there are any."""
    morph = analyses.select(item, "k", F.struct(*(c for c in analyses.columns if c not in (item, "k"))).alias("morph"))
    toks = tokens.select(item, "k", "start", "stop", "prefixes", "suffix")
    return _completed(with_place(nodes, item).join(morph, [item, "k"], "left").join(toks, [item, "k"], "left"))


def by_morphology(analyses: DataFrame, tokens: DataFrame, item: str, surface: str = "surface") -> DataFrame:
    """One sentence of as many tokens as the longer of both; the surface is the token's, else the analysis'."""
    morph = analyses.select(item, "k", F.struct(*(c for c in analyses.columns if c not in (item, "k"))).alias("morph"))
    rows = tokens.withColumnRenamed("surface", "__surface").join(morph, [item, "k"], "full")
    named = F.coalesce(F.when(F.col("__surface") != "", F.col("__surface")), F.col(f"morph.{surface}"), F.lit(""))
    return _completed(rows.withColumn("surface", named).withColumn("sent_idx", F.lit(0)).drop("__surface"))


def with_ambiguity(rows: DataFrame, counts: DataFrame, item: str) -> DataFrame:
    """``rows`` with ``ambiguity``: the parser's count (item, token_id from 1, ambiguity) where the token has an analysis, else null."""
    found = counts.select(item, (F.col("token_id") - 1).alias("k"), F.col("ambiguity").alias("__n"))
    joined = rows.join(found, [item, "k"], "left")
    return joined.withColumn("ambiguity", F.when(F.col("morph").isNotNull(), F.coalesce("__n", F.lit(1)))).drop("__n")


def missing_layers(flags: DataFrame, morphology: str, syntax: str) -> DataFrame:
    """``flags`` with ``missing``, the layers that a document lacks."""
    return flags.withColumn("missing", F.array_compact(F.array(F.when(~F.coalesce(morphology, F.lit(False)), F.lit("morphology")), F.when(~F.coalesce(syntax, F.lit(False)), F.lit("syntax")))))


def word_parts(words: DataFrame, token: str = "token_id", order: str = "word_idx", head: str = "is_core") -> DataFrame:
    """Split words of a token: ``prefixes`` before and ``suffix`` after each, and whether it is the core."""
    before = Window.partitionBy(token).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(token).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    suffix = F.array_join(F.collect_list("text").over(after), "")
    return words.withColumn("prefixes", F.collect_list("text").over(before)).withColumn("suffix", F.when(suffix != "", suffix)).where(head)


def token_spans(sentences: DataFrame, tokens: DataFrame, item: str, limit: int | None = None) -> DataFrame:
    """First and last token of each sentence (item, index, char_start, char_end); sentences beyond ``limit`` tokens have no row.

    A token belongs to the sentence that its characters overlap with. The join is on the item,
    so it stays within one document.
    """
    toks = tokens.select(item, "k", "start", "stop")
    if limit is not None:
        toks = toks.where(F.col("k") < limit)
    overlap = (F.col("start") < F.col("char_end")) & (F.col("stop") > F.col("char_start"))
    return sentences.join(toks, item).where(overlap).groupBy(item, "index").agg(F.min("k").alias("first_token"), F.max("k").alias("last_token"))


def annotated(df: DataFrame, annotator: Callable[[pd.Series], pd.Series], item: str, text: str, schema: str) -> DataFrame:
    """Hook for an external model: a function from a series of texts to a series of lists of dicts.

    The function runs once per Arrow batch in the Python workers, so a model that it loads lazily
    is loaded once a worker. A batch that raises is given again text by text: only the texts that
    raise get a null result and an ``error``.
    """
    kind = df.schema[item].dataType.simpleString()

    def one(text: pd.Series) -> tuple[object, str | None]:
        try:
            return list(annotator(text))[0], None
        except Exception as problem:  # noqa: BLE001 - the row says what went wrong
            return None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield pd.DataFrame({"item": batch["item"], "parsed": annotator(batch["text"]), "error": None})
            except Exception:  # noqa: BLE001 - told apart text by text
                done = [one(batch["text"].iloc[i : i + 1]) for i in range(len(batch))]
                yield pd.DataFrame({"item": batch["item"].tolist(), "parsed": [d[0] for d in done], "error": [d[1] for d in done]})

    rows = df.select(F.col(item).alias("item"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"item {kind}, parsed {schema}, error string").withColumnRenamed("item", item)


def normalised(df: DataFrame, text: str = "text", out: str = "normalized_text") -> DataFrame:
    """``df`` with ``out``: the compatibility form of Unicode, then typographic marks as ASCII. Null stays null.

    Spark has no function for this form, so it is computed over Arrow batches; ASCII texts have it already.
    """
    import unicodedata

    base = df.drop(out) if out != text else df
    at = base.columns.index(text)
    schema = base.withColumn("__n", F.col(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=schema.names)

    rows = base.mapInArrow(run, schema)
    if out == text:
        return rows.withColumn(text, T.punctuation_mapped(F.col("__n"))).drop("__n")
    return rows.withColumn(out, T.punctuation_mapped(F.col("__n"))).drop("__n")
