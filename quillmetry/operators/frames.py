"""Documents as sentences and annotated tokens, kept in arrays inside one row per document.

Nothing here shuffles: sentences, tokens and their annotation are array expressions over the
row's text. An annotator is a function from an array of surfaces (and the sentence) to an
array of token structs; ``synthetic`` stands in where no parser is at hand, and
``from_table`` attaches the output of an external one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry.functions import text as T

TOKEN_TYPE = "struct<id:int,surface:string,lemma:string,pos:string,gender:string,number:string,binyan:string,deprel:string,head:int,ambiguity:int>"
Annotator = Callable[[Column, Column], Column]


def _pick(index: Column, values: str) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values.split())), index)


def synthetic(surfaces: Column, sentence: Column) -> Column:
    """Annotation by rule, the same in any engine: a binary tree of heads, the rest from lengths and places."""

    def token(s: Column, at: Column) -> Column:
        i, n = at + 1, F.length(s)
        mark = s.rlike(r"^[.!?:]$")
        pos = F.when(mark, F.lit("PUNCT")).otherwise(_pick(n % 7, "NOUN VERB NOUN ADJ ADV PRON ADP"))
        return F.struct(
            i.cast("int").alias("id"),
            s.alias("surface"),
            F.lower(F.substring(s, 1, 4)).alias("lemma"),
            pos.alias("pos"),
            F.when(i % 5 != 0, _pick(i % 2, "M F")).alias("gender"),
            F.when(i % 3 == 0, F.lit("P")).otherwise(F.lit("S")).alias("number"),
            F.when(pos == "VERB", _pick(i % 4, "PAAL NIFAL PIEL HIFIL")).alias("binyan"),
            F.when(i == 1, F.lit("root")).otherwise(_pick(i % 6, "nsubj amod ccomp advcl obj rcmod")).alias("deprel"),
            F.floor(i / 2).cast("int").alias("head"),
            (1 + n % 9).cast("int").alias("ambiguity"),
        )

    last = F.substring(sentence, -1, 1)
    closed = F.when(last.rlike(r"^[.!?:]$"), F.concat(surfaces, F.array(last))).otherwise(surfaces)
    return F.transform(closed, token)


def analysed(df: DataFrame, text: str = "text", annotator: Annotator = synthetic) -> DataFrame:
    """``df`` with ``sentences`` (array of strings) and ``parsed`` (array of token arrays).

    Null texts have null arrays. Existing columns of these names are replaced.
    """
    split = df.withColumn("sentences", T.sentences(F.col(text)))
    return split.withColumn("parsed", F.transform("sentences", lambda s: annotator(T.tokens(s), s)))


def from_table(df: DataFrame, tokens: DataFrame, item: str) -> DataFrame:
    """``df`` with ``parsed`` from a long table (item, sent_idx, tok_idx, token fields); null where a document has none."""
    fields = [f.split(":")[0] for f in TOKEN_TYPE[7:-1].split(",")]
    per = tokens.groupBy(item, "sent_idx").agg(F.array_sort(F.collect_list(F.struct("tok_idx", F.struct(*fields).alias("t")))).alias("t"))
    docs = per.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("sent_idx", F.col("t.t").alias("s")))).alias("s"))
    return df.join(docs.select(item, F.col("s.s").alias("parsed")), item, "left")


def token_rows(df: DataFrame, item: str) -> DataFrame:
    """The long table of tokens of an analysed frame."""
    sents = df.select(item, F.posexplode("parsed").alias("sent_idx", "toks"))
    return sents.select(item, "sent_idx", F.posexplode("toks").alias("tok_idx", "t")).select(item, "sent_idx", "tok_idx", "t.*")


def tree_depth(toks: Column, from_root: bool = False) -> Column:
    """Depth of a dependency tree: longest way from the virtual root 0 (a root has depth 1).

    Heads are followed by pointer doubling, so it takes log2(n) passes over the arrays; nodes
    in cycles or under an unknown head are ignored, and a sentence without a tree has depth 0.
    ``from_root`` counts from the root node instead (a root has depth 0).
    """
    n = F.size(toks)
    heads = F.transform(toks, lambda t: F.when((t["head"] >= 0) & (t["head"] <= n) & (t["head"] != t["id"]), t["head"]).otherwise(F.lit(-1)))
    start = F.struct(heads.alias("up"), F.transform(toks, lambda t: F.lit(1)).alias("far"))

    def double(state: Column, _: Column) -> Column:
        far = F.transform(state["up"], lambda u, i: F.get(state["far"], i) + F.when(u > 0, F.get(state["far"], u - 1)).otherwise(0))
        up = F.transform(state["up"], lambda u: F.when(u > 0, F.get(state["up"], u - 1)).otherwise(u))
        return F.struct(up.alias("up"), far.alias("far"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int"))
    reached = lambda s: F.array_max(F.zip_with(s["up"], s["far"], lambda u, f: F.when(u == 0, f).otherwise(0)))
    depth = F.coalesce(F.aggregate(rounds, start, double, reached), F.lit(0))
    return F.greatest(depth - 1, F.lit(0)) if from_root else depth


def synthetic_metrics(df: DataFrame, text: str, depth: str) -> DataFrame:
    """``df`` with ``m`` for texts without a parse: per sentence its words as tokens and as lemmas, and ``depth`` (0 where null) for all.

    Null texts have no sentences. ``depth`` counts from the root, ``m`` from the virtual root, so it is one more there.
    """
    deep = F.coalesce(F.col(depth), F.lit(0.0)) + 1
    each = lambda s: F.struct(F.size(T.words(s)).alias("n"), deep.alias("depth"), F.array_distinct(T.words(s)).alias("lemmas"))
    return df.withColumn("m", F.transform(F.coalesce(T.sentences(F.col(text)), F.array().cast("array<string>")), each))
