"""Training records, their labels, and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry import constants as C
from quillmetry.operators.ordering import numbered, ranked_within

KINDS = {"scores": C.SCORE_KEYS, "issues": C.ISSUE_KEYS, "diagnoses": C.DIAGNOSIS_KEYS}


def value(map_name: str, key: str) -> Column:
    """A map's value, 0 where it is missing or null."""
    return F.coalesce(F.try_element_at(F.col(map_name), F.lit(key)), F.lit(0.0))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def long_labels(records: DataFrame, item: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record and key (30 keys): ``kind``, ``key``, ``value``."""
    cells = [F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("key"), value(kind, k).alias("value")) for kind, keys in KINDS.items() for k in keys]
    return records.select(item, *keep, F.explode(F.array(*cells)).alias("c")).select(item, *keep, "c.*")


def label_stats(records: DataFrame, item: str) -> DataFrame:
    """Mean and population deviation per key, and the share above 0."""
    return long_labels(records, item).groupBy("kind", "key").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg((F.col("value") > 0).cast("double")).alias("active"))


def sentence_labels(issues: DataFrame, counts: DataFrame, item: str) -> DataFrame:
    """``sentence_complexities`` (one per sentence) and ``cohesion_pairs`` (one per neighbouring pair) from the issue table; 0 where there is no issue.

    ``counts`` has the number ``n`` of sentences of each item.
    """
    mine = lambda kind, size: (F.col("type") == kind) & (F.size("span") == size)
    entry = F.struct(F.col("span")[0], F.col("severity"))
    per = issues.groupBy(item).agg(
        F.map_from_entries(F.collect_list(F.when(mine("sentence_complexity", 1), entry))).alias("single"),
        F.map_from_entries(F.collect_list(F.when(mine("weak_cohesion", 2), entry))).alias("paired"),
    )
    rows = counts.join(per, item, "left")
    fill = lambda size, m: F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    return rows.select(item, fill(F.col("n"), "single").alias("sentence_complexities"), fill(F.col("n") - 1, "paired").alias("cohesion_pairs"))


def trained_labels(records: DataFrame, n_sentences: Column) -> DataFrame:
    """``records`` with labels clamped to 0..1 and sentence lists cut or filled with 0 to the number of sentences."""

    def fitted(name: str, size: Column) -> Column:
        values = F.coalesce(F.col(name), F.array().cast("array<double>"))
        room = F.greatest(size, F.lit(0))
        return F.slice(F.concat(F.transform(values, lambda v: clamped(F.coalesce(v, F.lit(0.0)))), F.array_repeat(F.lit(0.0), room.cast("int"))), F.lit(1), room)

    out = records
    for kind in ("issues", "diagnoses"):
        out = out.withColumn(kind, F.transform_values(kind, lambda _, v: clamped(F.coalesce(v, F.lit(0.0)))))
    return out.withColumn("sentence_complexities", fitted("sentence_complexities", n_sentences)).withColumn("cohesion_pairs", fitted("cohesion_pairs", n_sentences - 1))


def by_line(predictions: DataFrame, labels: DataFrame, line: str) -> DataFrame:
    """Two numbered frames side by side; lines that only one of them has are left out."""
    return predictions.select(line, F.struct("*").alias("prediction")).join(labels.select(line, F.struct("*").alias("label")), line)


def disagreements(pairs: DataFrame, item: str, threshold: float = 0.3) -> DataFrame:
    """Absolute differences per key of long pairs (item, kind, key, predicted, label): each row ``differs`` if above the threshold."""
    return pairs.withColumn("difference", F.abs(F.col("predicted") - F.col("label"))).withColumn("differs", F.col("difference") > threshold)


def disagreement_cases(compared: DataFrame, item: str) -> DataFrame:
    """``item`` and ``keys``, how many of its keys differ, of the items with any."""
    return compared.groupBy(item).agg(F.count_if("differs").alias("keys")).where(F.col("keys") > 0)


def evaluation(pairs: DataFrame, item: str) -> DataFrame:
    """``metric`` (rmse, f1, spearman), ``kind``, ``key``, ``value`` of long pairs, in one table."""
    others = pairs.where("kind <> 'scores'")
    parts = {"rmse": rmse(pairs.where("kind = 'scores'")).withColumnRenamed("rmse", "value"), "f1": f1_per_type(others).withColumnRenamed("f1", "value"), "spearman": spearman(others, item).withColumnRenamed("rho", "value")}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("metric"), "kind", "key", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def training_records(found: DataFrame, diagnoses: DataFrame, item: str) -> DataFrame:
    """The record of each item: maps of scores (null as 0), issues and diagnoses (largest severity, 0 where there is none), sentence labels.

    ``found`` has the array ``issues``, the score columns and ``sentences``. Only the diagnoses, at most
    eight an item, are joined; the rest is told inside the row.
    """
    found = found.withColumnRenamed("issues", "__found")
    mine = lambda kind: F.filter("__found", lambda i: i["type"] == kind)
    largest = lambda kind: F.coalesce(F.array_max(F.transform(mine(kind), lambda i: i["severity"])), F.lit(0.0))
    scores = F.create_map(*(c for k in C.SCORE_KEYS for c in (F.lit(k), F.coalesce(F.col(k), F.lit(0.0)))))
    issues = F.create_map(*(c for k in C.ISSUE_KEYS for c in (F.lit(k), largest(k))))
    by_place = lambda kind: F.map_from_entries(F.transform(mine(kind), lambda i: F.struct(i["span"][0], i["severity"])))
    filled = lambda size, kind: F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(by_place(kind), i), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    n = F.coalesce(F.size("sentences"), F.lit(0))
    rows = found.select(item, scores.alias("scores"), issues.alias("issues"), filled(n, "sentence_complexity").alias("sentence_complexities"), filled(n - 1, "weak_cohesion").alias("cohesion_pairs"))
    per = diagnoses.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("type", "severity"))).alias("__d"))
    kept = F.create_map(*(c for k in C.DIAGNOSIS_KEYS for c in (F.lit(k), F.coalesce(F.try_element_at("__d", F.lit(k)), F.lit(0.0)))))
    return rows.join(per, item, "left").withColumn("diagnoses", kept).drop("__d")


def merged_last_wins(base: DataFrame, newer: DataFrame, text: str, line: str) -> DataFrame:
    """One row per text, the last one in reading order (base first); ``added`` marks texts that base lacks.

    Rows with a null text count as the empty text.
    """
    both = base.withColumn("__newer", F.lit(0)).unionByName(newer.withColumn("__newer", F.lit(1)))
    key = F.coalesce(F.col(text), F.lit(""))
    others = [c for c in base.columns if c != text]
    last = both.groupBy(key.alias(text)).agg(F.max_by(F.struct(*others), F.struct("__newer", line)).alias("r"), (F.min("__newer") == 1).alias("added"))
    return last.select(text, "r.*", "added")


def split_exact(df: DataFrame, item: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``part``: the first max(1, share of all) rows of a seeded order are ``val``, the others ``train``."""
    from quillmetry.operators.prep import seeded_order

    rows = numbered(df.withColumn("__order", seeded_order(item, seed)), "__order", item)
    total = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("__val")).withColumn("__one", F.lit(1))
    rows = rows.withColumn("__one", F.lit(1)).join(total, "__one")
    return rows.withColumn("part", F.when(F.col("row_no") < F.col("__val"), "val").otherwise("train")).drop("__order", "__one", "__val", "row_no")


def f1_per_type(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """F1 per kind and key of long pairs (kind, key, predicted, label); 0 where nothing is found."""
    p, t = F.col("predicted") >= threshold, F.col("label") >= threshold
    counts = pairs.groupBy("kind", "key").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.select("*", f1.alias("f1"))


def rmse(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("kind", "key").agg(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("label"), F.lit(2.0)))).alias("rmse"))


def spearman(pairs: DataFrame, item: str) -> DataFrame:
    """Rank correlation per key from ordinal ranks (ties by item); 0 below two rows."""
    keyed = pairs.withColumn("__key", F.concat_ws("/", "kind", "key"))
    first = ranked_within(keyed, "__key", "predicted", item, out="__a")
    both = ranked_within(first.drop("group_size"), "__key", "label", item, out="__b")
    n = F.first("group_size").cast("double")
    d2 = F.sum(F.pow((F.col("__a") - F.col("__b")).cast("double"), F.lit(2.0)))
    return both.groupBy("kind", "key").agg(F.when(n >= 2, 1 - 6 * d2 / (n * (n * n - 1))).otherwise(0.0).alias("rho"))


def losses(pairs: DataFrame, weights: tuple[float, ...] = (1.0, 1.5, 2.0)) -> DataFrame:
    """Mean squared error of the scores, cross entropy of issues and diagnoses, and their weighted sum ``total``."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("predicted")))
    y = clamped(F.col("label"))
    entropy = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    mine = lambda kind, x: F.avg(F.when(F.col("kind") == kind, x))
    parts = pairs.agg(mine("scores", F.pow(F.col("predicted") - F.col("label"), F.lit(2.0))).alias("scores"), mine("issues", entropy).alias("issues"), mine("diagnoses", entropy).alias("diagnoses"))
    return parts.select("*", sum((w * F.col(k) for w, k in zip(weights, KINDS)), F.lit(0.0)).alias("total"))


def routed(predictions: DataFrame, fallback: DataFrame, item: str, threshold: float = 0.7) -> DataFrame:
    """Predictions whose mean diagnosis is above the threshold, for the others the fallback's row; ``origin`` tells which."""
    sure = sum((value("diagnoses", k) for k in C.DIAGNOSIS_KEYS), F.lit(0.0)) / len(C.DIAGNOSIS_KEYS)
    tagged = predictions.withColumn("confidence", sure)
    model = tagged.where(F.col("confidence") > threshold).select(item, "diagnoses", "confidence", F.lit("model").alias("origin"))
    rest = tagged.where(F.col("confidence") <= threshold).select(item, "confidence")
    return model.unionByName(rest.join(fallback.select(item, "diagnoses"), item).select(item, "diagnoses", "confidence", F.lit("pipeline").alias("origin")))


def named_predictions(predictions: DataFrame, least: float = 0.3) -> DataFrame:
    """Sentence and pair predictions above ``least``; the two document issues replaced by their maxima where there are any."""
    listed = lambda name: F.filter(F.transform(name, lambda v, i: F.struct(i.alias("index"), v.alias("severity"))), lambda x: x["severity"] > least)
    top = lambda name, key: F.when(F.size(name) > 0, F.create_map(F.lit(key), F.array_max(name))).otherwise(F.create_map().cast("map<string,double>"))
    kept = F.map_filter("issues", lambda k, _: ~((k == "sentence_complexity") & (F.size("sentence_complexities") > 0)) & ~((k == "weak_cohesion") & (F.size("cohesion_pairs") > 0)))
    return predictions.select(
        "*", listed("sentence_complexities").alias("sentence_list"), listed("cohesion_pairs").alias("pair_list"), F.map_concat(kept, top("sentence_complexities", "sentence_complexity"), top("cohesion_pairs", "weak_cohesion")).alias("named_issues")
    )
