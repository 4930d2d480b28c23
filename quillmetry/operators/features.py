"""The 32 document features, as expressions over the arrays of an analysed document (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry import constants as C
from quillmetry.functions import text as T
from quillmetry.operators.frames import tree_depth


def _count(toks: Column, test) -> Column:
    return F.size(F.filter(toks, test))


def _total(values: Column, field: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x[field].cast("double"), F.lit(0.0)))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _sample_variance(n: Column, total: Column, squares: Column) -> Column:
    return F.when(n >= 2, F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))).otherwise(0.0)


def _entropy(labels: Column) -> Column:
    """Entropy (natural logarithm) of the labels' distribution; 0 if there are none."""
    n = F.size(labels)
    part = lambda v: F.size(F.filter(labels, lambda x: x == v)) / n
    return F.when(n > 0, -F.aggregate(F.transform(F.array_distinct(labels), part), F.lit(0.0), lambda a, p: a + p * F.log(p))).otherwise(0.0)


def per_sentence(parsed: Column) -> Column:
    """Counts of each sentence."""

    def metrics(toks: Column) -> Column:
        n = F.size(toks)
        head = lambda t: F.get(toks, t["head"] - 1)
        pairs = F.filter(toks, lambda t: t["deprel"].isin(C.AGREEMENT_RELATIONS) & (t["head"] > 0) & F.get(toks, t["head"] - 1).isNotNull())
        unlike = lambda t: F.coalesce(t["gender"] != head(t)["gender"], F.lit(False)) | F.coalesce(t["number"] != head(t)["number"], F.lit(False))
        far = F.transform(F.filter(toks, lambda t: t["head"] > 0), lambda t: F.abs(t["id"] - t["head"]).cast("double"))
        return F.struct(
            n.alias("n"),
            _count(toks, lambda t: t["pos"] == "VERB").alias("verbs"),
            _count(toks, lambda t: t["pos"] == "NOUN").alias("nouns"),
            _count(toks, lambda t: t["pos"] == "PRON").alias("pronouns"),
            _count(toks, lambda t: t["pos"] == "PUNCT").alias("marks"),
            _count(toks, lambda t: t["pos"].isin(C.CONTENT_POS)).alias("content"),
            _count(toks, lambda t: T.prefix(t["surface"]).isNotNull()).alias("prefixes"),
            _count(toks, lambda t: T.suffix(t["surface"]).isNotNull()).alias("suffixes"),
            _count(toks, lambda t: t["ambiguity"].isNotNull()).alias("graded"),
            F.aggregate(toks, F.lit(0.0), lambda a, t: a + F.coalesce(t["ambiguity"].cast("double"), F.lit(0.0))).alias("ambiguity"),
            F.size(pairs).alias("pairs"),
            F.size(F.filter(pairs, unlike)).alias("unlike"),
            F.size(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (F.get(toks, i)["pos"] == "NOUN") & (F.get(toks, i + 1)["pos"] == "NOUN"))).alias("construct"),
            tree_depth(toks).alias("depth"),
            F.aggregate(toks, F.lit(0.0), lambda a, t: a + F.abs(t["id"] - t["head"])).alias("distance"),
            F.size(far).alias("arcs"),
            F.aggregate(far, F.lit(0.0), lambda a, x: a + x).alias("far"),
            F.aggregate(far, F.lit(0.0), lambda a, x: a + x * x).alias("far2"),
            _count(toks, lambda t: (t["head"] > 0) & (t["id"] > t["head"])).alias("right"),
            _count(toks, lambda t: t["deprel"].isin(C.CLAUSE_RELATIONS)).alias("clauses"),
            _count(toks, lambda t: t["deprel"].isin(C.SUBORDINATE_RELATIONS)).alias("subordinate"),
            _count(toks, lambda t: t["deprel"] == "root").alias("roots"),
            F.exists(toks, lambda t: t["surface"].isin(C.TERMINAL_MARKS)).alias("closed"),
            _count(toks, lambda t: t["surface"].isin(C.CONNECTIVES)).alias("connectives"),
            F.aggregate(toks, F.lit(0.0), lambda a, t: a + F.length(t["surface"])).alias("letters"),
            F.array_distinct(F.transform(toks, lambda t: F.coalesce(t["lemma"], t["surface"]))).alias("lemmas"),
            F.transform(toks, lambda t: F.coalesce(t["pos"], F.lit(""))).alias("pos"),
        )

    return F.transform(parsed, metrics)


def document_features(df: DataFrame, item: str, keep: tuple[str, ...] = (), has_morphology: str | None = None, has_syntax: str | None = None) -> DataFrame:
    """``item``, ``keep`` and the 32 features, from a frame with ``parsed`` (and ``rare``, an array of rare surfaces, if a dictionary is used).

    Missing layers (boolean columns named by ``has_...``) make their features null; lexicon,
    structure, discourse and style are always there. Ratios over nothing are 0. A null
    ``parsed`` counts as a document without sentences. ``rare_word_ratio`` is null without
    a column ``rare``.
    """
    base = df.withColumn("parsed", F.coalesce("parsed", F.array().cast(df.schema["parsed"].dataType))).withColumn("m", per_sentence(F.col("parsed")))
    base = base.withColumn("toks", F.flatten("parsed"))
    base = base.withColumn("surfaces", F.transform("toks", lambda t: t["surface"])).withColumn("ordered", F.array_sort("surfaces"))
    m, toks, surfaces, ordered = F.col("m"), F.col("toks"), F.col("surfaces"), F.col("ordered")
    s, n = F.size(m).cast("double"), F.size(toks).cast("double")
    t = lambda field: _total(m, field)
    lengths2 = F.aggregate(m, F.lit(0.0), lambda a, x: a + x["n"].cast("double") * x["n"])
    places = F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0)))
    once = lambda i: F.get(ordered, i).isNotNull() & ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)) & ~F.get(ordered, i).eqNullSafe(F.get(ordered, i + 1))
    hapax = F.size(F.filter(F.transform(places, lambda i: F.when(i == 0, ~F.get(ordered, i).eqNullSafe(F.get(ordered, i + 1)) & F.get(ordered, i).isNotNull()).otherwise(once(i))), lambda x: x))
    lemmas = F.array_distinct(F.transform(toks, lambda x: F.coalesce(x["lemma"], x["surface"])))
    pairs = F.sequence(F.lit(1), F.greatest(F.size(m) - 1, F.lit(1)))
    shared = lambda i: F.size(F.array_intersect(F.get(m, i - 1)["lemmas"], F.get(m, i)["lemmas"])) / F.greatest(F.size(F.array_union(F.get(m, i - 1)["lemmas"], F.get(m, i)["lemmas"])), F.lit(1))
    overlap = F.when(s >= 2, F.aggregate(F.transform(pairs, shared), F.lit(0.0), lambda a, x: a + x) / (s - 1)).otherwise(0.0)
    sum_i, sum_i2 = s * (s - 1) / 2, (s - 1) * s * (2 * s - 1) / 6
    cross = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + i * F.coalesce(F.get(m, i)["n"], F.lit(0)))
    trend = F.when(s >= 2, (s * cross - sum_i * t("n")) / (s * sum_i2 - sum_i * sum_i)).otherwise(0.0)
    tags = F.array_distinct(F.flatten(F.transform(m, lambda x: x["pos"])))

    def spread(tag: Column) -> Column:
        parts = F.transform(m, lambda x: F.when(x["n"] > 0, F.size(F.filter(x["pos"], lambda p: p == tag)) / x["n"]).otherwise(0.0))
        total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x * x) - total * total / s

    variances = F.when((s >= 2) & (F.size(tags) > 0), F.aggregate(F.transform(tags, spread), F.lit(0.0), lambda a, x: a + x) / (s - 1) / F.size(tags)).otherwise(0.0)
    morphology = {
        "verb_ratio": _ratio(t("verbs"), n),
        "prefix_density": _ratio(t("prefixes"), n),
        "suffix_pronoun_ratio": _ratio(t("suffixes"), n),
        "morphological_ambiguity": _ratio(t("ambiguity"), t("graded")),
        "agreement_error_rate": _ratio(t("unlike"), t("pairs")),
        "binyan_entropy": _entropy(F.filter(F.transform(toks, lambda x: x["binyan"]), lambda b: b.isNotNull())),
        "construct_ratio": _ratio(t("construct"), n),
    }
    syntax = {
        "avg_sentence_length": _ratio(n, s),
        "avg_tree_depth": _ratio(t("depth"), s),
        "max_tree_depth": F.coalesce(F.array_max(F.transform(m, lambda x: x["depth"])).cast("double"), F.lit(0.0)),
        "avg_dependency_distance": _ratio(t("distance"), n),
        "clauses_per_sentence": _ratio(t("clauses"), s),
        "subordinate_clause_ratio": _ratio(t("subordinate"), t("subordinate") + t("roots")),
        "right_branching_ratio": _ratio(t("right"), t("arcs")),
        "dependency_distance_variance": _sample_variance(t("arcs"), t("far"), t("far2")),
        "clause_type_entropy": _entropy(F.transform(toks, lambda x: F.coalesce(x["deprel"], F.lit("")))),
    }
    rest = {
        "type_token_ratio": _ratio(F.size(F.array_distinct(surfaces)), n),
        "hapax_ratio": _ratio(hapax, n),
        "avg_token_length": _ratio(t("letters"), n),
        "lemma_diversity": _ratio(F.size(lemmas), n),
        "rare_word_ratio": _ratio(F.size("rare"), n) if "rare" in df.columns else F.lit(None).cast("double"),
        "content_word_ratio": _ratio(t("content"), n),
        "sentence_length_variance": _sample_variance(s, n, lengths2),
        "long_sentence_ratio": _ratio(_count(m, lambda x: x["n"] > C.LONG_SENTENCE), s),
        "punctuation_ratio": _ratio(t("marks"), n),
        "short_sentence_ratio": _ratio(_count(m, lambda x: x["n"] < C.SHORT_SENTENCE), s),
        "missing_terminal_punctuation_ratio": _ratio(_count(m, lambda x: ~x["closed"]), s),
        "connective_ratio": _ratio(t("connectives"), s),
        "sentence_overlap": overlap,
        "pronoun_to_noun_ratio": F.when(n > 0, _ratio(t("pronouns"), n) / (_ratio(t("nouns"), n) + C.EPSILON)).otherwise(0.0),
        "sentence_length_trend": trend,
        "pos_distribution_variance": variances,
    }
    gated = {k: F.when(F.col(has_morphology), v) if has_morphology else v for k, v in morphology.items()} | {k: F.when(F.col(has_syntax), v) if has_syntax else v for k, v in syntax.items()} | rest
    return base.select(item, *keep, *(gated[name].cast("double").alias(name) for name in C.FEATURES))


def binyan_distribution(df: DataFrame, item: str) -> DataFrame:
    """Histogram of the verb patterns of each document: ``item``, ``binyan``, ``n``."""
    found = df.select(item, F.explode(F.transform(F.flatten("parsed"), lambda t: t["binyan"])).alias("binyan")).where("binyan is not null")
    return found.groupBy(item, "binyan").agg(F.count(F.lit(1)).alias("n"))


def rare_words(df: DataFrame, item: str, dictionary: DataFrame, least: int = C.RARE_COUNT) -> DataFrame:
    """``df`` with ``rare``: its tokens that the dictionary (token, cnt) holds fewer than ``least`` times or not at all.

    The dictionary grows with the corpus, so tokens are joined to it rather than it being sent around.
    """
    toks = df.select(item, F.explode(F.transform(F.flatten("parsed"), lambda t: F.coalesce(t["lemma"], t["surface"]))).alias("token")).groupBy(item, "token").agg(F.count(F.lit(1)).alias("n"))
    rare = toks.join(dictionary, "token", "left").where(F.coalesce("cnt", F.lit(0)) < least)
    found = rare.groupBy(item).agg(F.flatten(F.collect_list(F.array_repeat("token", F.col("n").cast("int")))).alias("rare"))
    return df.join(found, item, "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
