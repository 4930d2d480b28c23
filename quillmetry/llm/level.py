"""Reading level of documents (problem 4).

Features of length, vocabulary, syntax and cohesion, as distributions over sentence units, feed
gradient-boosted regression trees. The trees are fitted on a bounded sample of graded texts;
cross-validation by source gives held-out predictions, from which the cuts between levels
are calibrated. Every text is then graded.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.llm.langs import COMMON_WORDS, language
from quillmetry.llm.quality import not_prose
from quillmetry.llm.segment import Model, Splitter, learn
from quillmetry.session import staged

LANGUAGES = ("he", "en")
#: Texts with a longer unit (in characters) get no level.
MAX_UNIT = 1000
#: Graded texts used for fitting; the first by hash of the id where there are more.
MAX_GRADED = 20_000
TREES, DEPTH, RATE, LEAF, BINS, FOLDS = 60, 3, 0.15, 8, 32, 5

_WORD = re.compile(r"[^\W\d_]+(?:[\"'’״׳-][^\W\d_]+)*")
_DIGIT = re.compile(r"\d")
_COMMON = {lang: frozenset(COMMON_WORDS[lang].split()) for lang in LANGUAGES}
NAMES = (
    "units words_mean words_sd words_p10 words_p50 words_p90 long_units short_units chars_mean chars_p50 word_length word_length_p90 long_words "
    "very_long_words commas quotes_digits common distinct distinct_long overlap starts_same is_english"
).split()


def features_of(units: list[str], lang: str) -> list[float]:
    """The features of a text given as its units (at least one of them has a word)."""
    words = [w for w in (_WORD.findall(u.lower()) for u in units) if w]
    counts = sorted(map(len, words))
    chars = sorted(map(len, units))
    every = [x for w in words for x in w]
    n, lines = len(every), len(words)
    lengths = sorted(map(len, every))
    at_least = [n - bisect_left(lengths, k) for k in (8, 11)]
    sets = [*map(set, words)]
    shared = [len(a & b) for a, b in zip(sets, sets[1:])]
    overlap = sum(k / (len(a) + len(b) - k) for k, a, b in zip(shared, sets, sets[1:]))
    first = Counter(w[0] for w in words)
    windows = [len(set(every[i : i + 50])) / min(50, n - i) for i in range(0, n, 50)]
    mean = n / lines
    pick = lambda values, q: values[int(q * (len(values) - 1) + 0.5)]
    text = " ".join(units)
    return [
        math.log1p(len(units)),
        mean,
        math.sqrt(sum((c - mean) ** 2 for c in counts) / lines),
        pick(counts, 0.1),
        pick(counts, 0.5),
        pick(counts, 0.9),
        1 - bisect_left(counts, 21) / lines,
        bisect_left(counts, 7) / lines,
        sum(chars) / len(chars),
        pick(chars, 0.5),
        sum(lengths) / n,
        pick(lengths, 0.9),
        at_least[0] / n,
        at_least[1] / n,
        text.count(",") / len(units),
        (text.count('"') + len(_DIGIT.findall(text))) / n,
        sum(map(_COMMON[lang].__contains__, every)) / n,
        sum(windows) / len(windows),
        sum(1 for x in set().union(*sets) if len(x) >= 8) / n,
        overlap / len(shared) if shared else 0.0,
        max(first.values()) / lines,
        float(lang == "en"),
    ]


def text_features(df: DataFrame, item: str, text: str, keep: list[str], model: Model | None = None) -> DataFrame:
    """``item``, the columns ``keep`` and ``features`` of every prose text in one of LANGUAGES.

    No row for null and empty texts, other languages, lists, tables, junk, texts without a
    word, and texts with a unit of more than MAX_UNIT characters.
    """
    splitter = Splitter(learn(df, text, LANGUAGES) if model is None else model)
    base = df.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"), *keep)
    schema = base.drop("text").withColumn("features", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            texts = batch.column(1).to_pylist()
            langs = [language(t) for t in texts]
            mine = [i for i, lang in enumerate(langs) if lang in LANGUAGES]
            for i, kind in zip(mine, not_prose(batch.column(1).take(pa.array(mine, pa.int32())))):
                if kind:
                    continue
                t, lang = texts[i], langs[i]
                spans = splitter.units(t, lang)
                if not spans or max(b - a for a, b in spans) > MAX_UNIT:
                    continue
                units = [t[a:b] for a, b in spans]
                if any(_WORD.search(u) for u in units):
                    at.append(i)
                    rows.append([float(x) for x in features_of(units, lang)])
            taken = batch.take(pa.array(at, pa.int32()))
            columns = [taken.column(0), *(taken.column(k) for k in range(2, taken.num_columns)), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(run, schema)


@dataclass
class Trees:
    """Boosted regression trees on binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  # complete trees: (feature, bin) or leaf values
    cuts: list[float] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = np.array([(f, b) for f, b, _ in tree])[at]
                at = 2 * at + 1 + (binned[np.arange(len(x)), node[:, 0]] > node[:, 1])
            out += np.array([v for _, _, v in tree])[at]
        return out

    def levels(self, x: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(np.array(self.cuts), self.predict(x), side="right")


def _grown(binned: np.ndarray, left: np.ndarray) -> list[tuple[int, int, float]]:
    """One complete tree of DEPTH levels fitted to what is left of the target."""
    size = 2 ** (DEPTH + 1) - 1
    tree, rows = [(0, BINS + 1, 0.0)] * size, {0: np.arange(len(left))}
    for node in range(size):
        mine = rows.pop(node, np.empty(0, np.int64))
        value = RATE * left[mine].mean() if len(mine) else 0.0
        if node >= 2**DEPTH - 1:
            tree[node] = (0, 0, value)
            continue
        best, split = 1e-12, None
        if len(mine) >= 2 * LEAF:
            total, n = left[mine].sum(), len(mine)
            for j in range(binned.shape[1]):
                counts = np.cumsum(np.bincount(binned[mine, j], minlength=BINS + 1))[:-1]
                sums = np.cumsum(np.bincount(binned[mine, j], left[mine], BINS + 1))[:-1]
                fits = (counts >= LEAF) & (n - counts >= LEAF)
                gain = np.where(fits, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0.0)
                if gain.max() > best:
                    best, split = gain.max(), (j, int(gain.argmax()))
        j, b = split or (0, BINS + 1)
        tree[node] = (j, b, value)
        right = binned[mine, j] > b
        rows[2 * node + 1], rows[2 * node + 2] = mine[~right], mine[right]
    return tree


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Trees(edges, float(y.mean()))
    binned, fit = model._binned(x), np.full(len(y), model.start)
    for _ in range(TREES):
        tree = _grown(binned, y - fit)
        model.trees.append(tree)
        one = Trees(edges, 0.0, [tree])
        fit += one.predict(x)
    return model


def _calibrated(predicted: np.ndarray, y: np.ndarray) -> list[float]:
    """Cuts between neighbouring levels with the fewest wrong grades among held-out predictions."""
    cuts = []
    for level in (1, 2, 3):
        tries = np.linspace(level + 0.2, level + 0.8, 25)
        wrong = [((predicted >= c) != (y > level)).sum() + 0.01 * abs(c - level - 0.5) for c in tries]
        cuts.append(float(tries[int(np.argmin(wrong))]))
    return cuts


def fit(x: np.ndarray, y: np.ndarray, source: list[str]) -> tuple[Trees, list[tuple[str, int, int]]]:
    """The trees with calibrated cuts, and (source, graded, right) of cross-validation with whole sources held out."""
    folds = {s: i % FOLDS for i, s in enumerate(sorted(set(source)))}
    fold = np.array([folds[s] for s in source])
    held_out = np.full(len(y), y.mean())
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            held_out[fold == k] = boosted(x[fold != k], y[fold != k]).predict(x[fold == k])
    model = boosted(x, y)
    model.cuts = _calibrated(held_out, y)
    right = (1 + np.searchsorted(np.array(model.cuts), held_out, side="right")) == np.rint(y)
    report: dict[str, list[int]] = {}
    for s, ok in zip(source, right):
        got = report.setdefault(s, [0, 0])
        got[0] += 1
        got[1] += int(ok)
    return model, [(s, n, k) for s, (n, k) in sorted(report.items())]


def graded(features: DataFrame, labels: DataFrame, limit: int = MAX_GRADED) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The graded sample: features, mean level and source of at most ``limit`` texts."""
    grades = labels.where(F.col("level").between(1, 4)).groupBy("item").agg(F.avg("level").alias("level"))
    rows = features.join(grades, "item").orderBy(F.xxhash64("item"), "item").limit(limit).select("features", "level", F.coalesce("source", F.lit("")).alias("source")).collect()
    return np.array([r.features for r in rows]), np.array([r.level for r in rows]), [r.source for r in rows]


def reading_levels(df: DataFrame, item: str, text: str, source: str, labels: DataFrame) -> DataFrame:
    """``item`` and ``reading_level`` (1 to 4) of every prose text in Hebrew or English.

    ``labels`` has columns item and level; repeated grades of a text are averaged, grades that are
    null or outside 1 to 4 are ignored. Without any grades the result is empty. See
    ``text_features`` for the texts that get no row.
    """
    features = staged(text_features(df.withColumn("source", F.col(source)), item, text, ["source"]), "level-features")
    x, y, sources = graded(features, labels)
    kind = features.schema["item"].dataType.simpleString()
    if not len(y):
        return features.select(F.col("item").alias(item), F.lit(None).cast("int").alias("reading_level")).where(F.lit(False))
    model, _ = fit(x, y, sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.levels(values).astype(np.int32))], names=["item", "reading_level"])

    return features.select("item", "features").mapInArrow(run, f"item {kind}, reading_level int").withColumnRenamed("item", item)


def cross_validation(df: DataFrame, item: str, text: str, source: str, labels: DataFrame) -> DataFrame:
    """Per source: graded texts and those graded right with the source held out."""
    features = staged(text_features(df.withColumn("source", F.col(source)), item, text, ["source"]), "level-features")
    x, y, sources = graded(features, labels)
    rows = fit(x, y, sources)[1] if len(y) else []
    return df.sparkSession.createDataFrame(rows, "source string, graded long, right long")
