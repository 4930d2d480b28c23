"""Subject areas of documents (problem 10).

A latent Dirichlet model, fitted over all documents by distributed variational expectation-
maximisation. There is a topic per subject and one for everything else. In the expectation step
workers infer the proportions of the topics in each of their documents, under a Dirichlet
prior, together with the topic of each term, and send up expected counts of terms per topic; in
the maximisation step the driver, which holds topics by terms of a bounded vocabulary, adds the
Dirichlet prior of the terms. Steps are repeated until the likelihood settles.

The prior of the terms is sparse: a topic can hold a term only while the documents the term
occurs in are for the larger part about it, by a log-likelihood ratio. Without this,
topics of a corpus of ten languages take over the common words of the rarer ones. Topics start
from the described terms of the subjects and a bounded labelled sample, whose documents have known
proportions. After the fit each topic is mapped to the subject most of whose described terms
are among its top terms; a topic that has none is left without a subject. Documents get the
subjects from their proportions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.llm.langs import language
from quillmetry.llm.looks import one_form
from quillmetry.llm.quality import not_prose
from quillmetry.session import staged

#: First characters of scripts; usual proportions of topics are kept by script.
_SCRIPTS = ("", "Ѐ", "֐", "؀", "ऀ", "฀", "゠", "㐀")
#: Labelled documents used; the first by hash of the id where there are more.
MAX_LABELLED = 20_000
#: Documents a term must occur in, and their share of all, which bounds the vocabulary at (mean terms of a document) / MIN_SHARE.
MIN_DOCS, MIN_SHARE = 4, 5e-5
#: Most steps of the fit; it ends before when the log-likelihood rises by less than such a part.
ITERATIONS, SETTLED = 6, 5e-4
#: Rounds of inference in a document; Dirichlet priors of its proportions, for a subject and for the rest.
ROUNDS, ALPHA, ALPHA_REST = 6, 0.1, 2.0
#: Occurrences that the Dirichlet prior of a term in a topic is worth.
ETA = 1.0
#: Documents that the usual proportions are worth in a term's; part of a term's documents that a topic must hold.
PRIOR, GATE = 4.0, 0.45
#: How far above the usual proportion, towards 1, a topic's part must be; its log-likelihood ratio (p = 0.0002); documents the even spread is worth.
LIFT, LLR, EVEN = 0.25, 14.0, 20.0
#: Documents after which a described term must pass the gate like any other.
SEED_DOCS = 20
#: Terms of subjects a document must have before its proportions teach the model.
SURE_TERMS = 2.0
#: A document is about a subject with at least so many expected terms of it, such a share of all subjects' terms, and so many a sentence.
MIN_TERMS, MIN_PART, MIN_DENSITY = 0.5, 0.28, 0.12

_EDGE = ".,;:!?…\"'’”“»«()[]{}„-–—*/#،؛؟।״׳"
_HEBREW = re.compile("^[ובלכהמש]+(?=[א-ת]{3})")
_ARABIC = re.compile("^(?:[وفبكل]?ال|لل)(?=.{3})")
_EAST = re.compile("[゠-ヿ]{2,}|[㐀-鿿]{2,}")
_THAI = re.compile("[฀-๿]{5,}")
_END = r"[.!?…؟।]+(?:\s|$)|[。！？]+|[฀-๿] [฀-๿]|[^.!?…؟।。！？\s]\s*\n"
_LETTERS = re.compile(r"[^\W\d_]{2}")


def _terms_of_token(token: str) -> list[str]:
    """Terms of what stands between two blanks."""
    token = one_form(token).casefold().strip(_EDGE)
    if len(token) < 2:
        return []
    lead = token[0]
    if "א" <= lead <= "ת":
        return [_HEBREW.sub("", token)]
    if "؀" <= lead <= "ۿ":
        return [_ARABIC.sub("", token.replace("ـ", ""))]
    if lead >= "฀":
        out = []
        for run in _EAST.findall(token):
            out += [run] if run[0] < "㐀" else [run[i : i + 2] for i in range(len(run) - 1)]
        for run in _THAI.findall(token):
            out += [run[i : i + 5] for i in range(len(run) - 4)]
        return out
    return [token] if _LETTERS.search(token) else []


def terms_of(text: str | None) -> list[str]:
    """Terms of a text: words without common prefixes; pairs of Han characters, katakana runs, runs of five in Thai."""
    return [term for token in (text or "").split() for term in _terms_of_token(token)]


def id_of(term: str) -> int:
    """Number of a term: its script and 60 bits of its hash."""
    return (sum(term[0] >= first for first in _SCRIPTS) - 1) << 60 | xxhash.xxh3_64_intdigest(term) >> 4


def _bags(df: DataFrame, item: str, text: str) -> DataFrame:
    """item, ids of the terms and their counts of each prose text (others have none), and its sentences, roughly."""
    kind = df.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            units = np.maximum(pc.count_substring_regex(texts, _END).to_numpy(zero_copy_only=False), 1)
            units[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
            prose = pa.array([k is None for k in not_prose(texts)])
            tokens = pc.utf8_split_whitespace(pc.if_else(prose, texts, ""))
            doc = np.repeat(np.arange(len(texts)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
            coded = pc.dictionary_encode(tokens.flatten())
            if len(known) > 300_000:
                known.clear()
            lists = []
            # Only the different tokens of a batch are looked at one by one.
            for token in coded.dictionary.to_pylist():
                ids = known.get(token)
                if ids is None:
                    ids = known[token] = [id_of(t) for t in _terms_of_token(token)]
                lists.append(ids)
            size = np.array([*map(len, lists)], np.int64)
            first, flat = np.cumsum(size) - size, np.array([x for ids in lists for x in ids], np.int64)
            which = coded.indices.to_numpy()
            n = size[which] if len(which) else np.empty(0, np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which] if len(which) else n, n)
            terms, term = np.unique(flat[at], return_inverse=True)
            code, count = np.unique(np.repeat(doc, n) * max(1, len(terms)) + term, return_counts=True)
            own, term = np.divmod(code, max(1, len(terms)))
            ends = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(terms[term]), pa.array(count.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(units.astype(np.int32))], names=["item", "terms", "counts", "units"])

    rows = df.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item {kind}, terms array<bigint>, counts array<int>, units int")


def _vocabulary(bags: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the terms that enter the model, sorted, and their exact counts of documents; at most (mean terms of a document) / MIN_SHARE terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], names=["term", "n"])

    counted = bags.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    least = max(MIN_DOCS, MIN_SHARE * bags.where(F.size("terms") > 0).count())
    kept = counted.where(F.col("n") >= least).toArrow().sort_by("term")
    return kept.column("term").to_numpy(), kept.column("n").to_numpy()


def _entries(batch: pa.RecordBatch, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in the vocabulary and count of each entry of a batch with columns item, terms, counts."""
    lists = batch.column(1)
    doc, terms = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    if not len(vocabulary):
        return doc[:0], terms[:0], doc[:0].astype(float)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    there = vocabulary[at] == terms
    return doc[there], at[there], batch.column(2).flatten().to_numpy()[there].astype(np.float64)


def _summed(rows: DataFrame, width: int, size: int) -> np.ndarray:
    """Rows (slot, values) added up into an array of width x size. At most ``size`` rows come to the driver."""
    total = rows.groupBy("slot").agg(*(F.sum(F.get("values", F.lit(k))).alias(f"v{k}") for k in range(width))).toArrow()
    out = np.zeros((width, size))
    at = total.column("slot").to_numpy()
    for k in range(width):
        out[k, at] = total.column(f"v{k}").to_numpy()
    return out


def _sent_up(values: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(values.any(axis=0))
    flat = pa.array(np.ascontiguousarray(values[:, used].T).ravel())
    ends = pa.array(np.arange(0, len(used) * len(values) + 1, len(values), dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(ends, flat)], names=["slot", "values"])


def digamma(x: np.ndarray) -> np.ndarray:
    """By the recurrence up to 6 and the asymptotic series."""
    x, shift = x.astype(float), np.zeros(x.shape)
    while (low := x < 6).any():
        shift[low] -= 1 / x[low]
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def infer(doc: np.ndarray, term: np.ndarray, count: np.ndarray, n_docs: int, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Variational inference of the documents of a batch.

    ``beta``: chances of the terms in each topic, the last one the rest. Returns the expected number of
    terms of each topic in each document, the entries that some subject can hold, the chances of the
    topics in these entries, and the log-likelihood.
    """
    free = np.flatnonzero(beta[:-1].any(axis=0)[term])
    d, n, chances = doc[free], count[free], beta[:, term[free]]
    alpha = np.full((len(beta), 1), ALPHA)
    alpha[-1] = ALPHA_REST
    fixed = np.bincount(doc, count, n_docs) - np.bincount(d, n, n_docs)
    expected = np.zeros((len(beta), n_docs))
    expected[-1] = fixed
    topic = chances / np.maximum(chances.sum(axis=0), 1e-300)
    for step in range(ROUNDS):
        if step:
            topic = chances * np.exp(digamma(expected + alpha))[:, d]
            topic /= np.maximum(topic.sum(axis=0), 1e-300)
        expected = np.stack([np.bincount(d, row * n, n_docs) for row in topic])
        expected[-1] += fixed
    theta = expected + alpha
    theta /= theta.sum(axis=0)
    held = np.ones(len(term), bool)
    held[free] = False
    likelihood = (n * np.log(np.maximum((chances * theta[:, d]).sum(axis=0), 1e-300))).sum()
    likelihood += (count[held] * np.log(np.maximum(beta[-1, term[held]] * theta[-1, doc[held]], 1e-300))).sum()
    return expected, free, topic, float(likelihood)


def _gated(weight: np.ndarray, total: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Part of each term's documents that a topic holds, 0 where the topic can't hold the term.

    The usual proportions of the term's script (``base``) are worth PRIOR documents. A topic can hold
    a term only with the larger part of its documents, by a significant log-likelihood ratio.
    """
    part = (weight + PRIOR * base) / (total + PRIOR)
    k, n = np.minimum(weight, total), np.maximum(total, 1e-9)
    rate = np.clip(k / n, 1e-9, 1 - 1e-9)
    ratio = 2 * n * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
    return np.where((part >= GATE) & (part >= base + LIFT * (1 - base)) & (total >= MIN_DOCS) & (ratio >= LLR), part, 0.0)


@dataclass
class Topics:
    """The fitted model: subjects in order, the sorted ids of the terms, and the chances of terms in each topic, the rest last."""

    subjects: list[str]
    vocabulary: np.ndarray
    beta: np.ndarray
    likelihoods: list[float]


def _normalised(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)


def fit(bags: DataFrame, labels: DataFrame, seeds: dict[str, list[str]]) -> Topics:
    """The topics of staged ``bags``; ``labels`` has columns item and subject."""
    subjects, (vocabulary, documents) = sorted(seeds), _vocabulary(bags)
    width, size, scripts = len(subjects), len(vocabulary), len(_SCRIPTS)
    if not width or not size:
        return Topics(subjects, vocabulary, np.zeros((width + 1, size)), [])
    context = bags.sparkSession.sparkContext
    script = (vocabulary >> 60).astype(np.int64)
    held_words = context.broadcast(vocabulary)
    one_hot = [F.max(F.when(F.col("subject") == s, 1.0).otherwise(0.0)).alias(f"s{i}") for i, s in enumerate(subjects)]
    sample = labels.where(F.col("subject").isin(subjects)).groupBy("item").agg(*one_hot).orderBy(F.xxhash64("item"), "item").limit(MAX_LABELLED)
    labelled = bags.join(sample, "item").select("item", "terms", "counts", F.array(*(f"s{i}" for i in range(width))).alias("has"))

    def added(total: np.ndarray, doc: np.ndarray, term: np.ndarray, theta: np.ndarray) -> None:
        """Add documents of proportions ``theta`` (topics x documents): per term, and behind the terms per script."""
        n_docs, docs = theta.shape[1], np.unique(doc)
        main = np.bincount(doc * scripts + script[term], minlength=n_docs * scripts).reshape(n_docs, scripts).argmax(axis=1)
        where, docs = np.concatenate([term, size + main[docs]]), np.concatenate([doc, docs])
        for k in range(width):
            total[k] += np.bincount(where, theta[k][docs], size + scripts)
        total[width] += np.bincount(where, minlength=size + scripts)

    def by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, size + scripts))
        for batch in batches:
            doc, term, _ = _entries(batch, held_words.value)
            has = batch.column(3).flatten().to_numpy().reshape(-1, width)
            added(total, doc, term, (has / np.maximum(has.sum(axis=1, keepdims=True), 1)).T)
        yield _sent_up(total)

    def possible(counts: np.ndarray, keep_seeds: np.ndarray) -> np.ndarray:
        usual = np.clip((counts[:width, size:] + EVEN / width) / (counts[width, size:] + EVEN), 1e-3, 0.99)
        return np.where(keep_seeds, 1.0, _gated(counts[:width, :size], counts[width, :size], usual[:, script]))

    seen = _summed(labelled.mapInArrow(by_label, "slot int, values array<double>"), width + 1, size + scripts)
    seeded = np.zeros((width, size), bool)
    for k, subject in enumerate(subjects):
        ids = np.array([id_of(part) for term in seeds[subject] for part in terms_of(term)], np.int64)
        seeded[k, np.flatnonzero(np.isin(vocabulary, ids))] = True
    part = possible(seen, seeded)
    likelihoods: list[float] = []
    # Until a step has counted, a term's documents are divided as its parts say.
    share = part / np.maximum(part.sum(axis=0), 1)
    beta = _normalised(np.vstack([share, np.maximum(1 - share.sum(axis=0), 0.05)]) * documents)
    for _ in range(ITERATIONS):
        held = context.broadcast(beta.astype(np.float32))

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            topics = held.value.astype(np.float64)
            # Documents per term and script as in ``added``, then expected counts of terms per topic, then the likelihood.
            total = np.zeros((2 * width + 3, size + scripts))
            for batch in batches:
                doc, term, count = _entries(batch, held_words.value)
                n, free, topic, likelihood = infer(doc, term, count, batch.num_rows, topics)
                own = n[:-1].sum(axis=0)
                use = (own >= SURE_TERMS)[doc]
                added(total[: width + 1], doc[use], term[use], n[:-1] / np.maximum(own, 1e-9))
                for k in range(width):
                    total[width + 1 + k, :size] += np.bincount(term[free], topic[k] * count[free], size)
                total[2 * width + 1, :size] += np.bincount(term, count, size)
                total[2 * width + 2, 0] += likelihood
            yield _sent_up(total)

        counts = _summed(bags.select("item", "terms", "counts").mapInArrow(expect, "slot int, values array<double>"), 2 * width + 3, size + scripts)
        likelihoods.append(counts[2 * width + 2, 0])
        # Labels count as documents of known proportions beside the inferred ones.
        docs = counts[: width + 1] + seen
        part = possible(docs, seeded & (docs[width, :size] < SEED_DOCS))
        # Maximisation: expected counts where a topic can hold the term, with the Dirichlet prior; the rest holds what is left.
        held_counts = np.where(part > 0, counts[width + 1 : 2 * width + 1, :size] + ETA * part, 0.0)
        fresh = (part > 0) & (counts[width + 1 : 2 * width + 1, :size] == 0)
        held_counts = np.where(fresh, part * counts[2 * width + 1, :size], held_counts)
        rest = np.maximum(counts[2 * width + 1, :size] - held_counts.sum(axis=0), ETA * np.maximum(1 - part.sum(axis=0), 0.05))
        beta = _normalised(np.vstack([held_counts, rest]))
        if len(likelihoods) > 1 and abs(likelihoods[-1] - likelihoods[-2]) < SETTLED * abs(likelihoods[-2]):
            break
    return Topics(subjects, vocabulary, beta, likelihoods)


def topic_subjects(model: Topics, seeds: dict[str, list[str]], top: int = 400) -> list[str | None]:
    """The subject of each topic: that with the most described terms among its ``top`` terms. None where it has none, or where another topic has more."""
    hits = np.zeros((len(model.subjects), len(model.subjects)), np.int64)
    for k in range(len(model.subjects)):
        order = np.argsort(-model.beta[k], kind="stable")[:top]
        best = set(model.vocabulary[order[model.beta[k, order] > 0]].tolist())
        for j, subject in enumerate(model.subjects):
            hits[k, j] = len(best & {id_of(p) for t in seeds[subject] for p in terms_of(t)})
    out: list[str | None] = [None] * len(model.subjects)
    for k in np.argsort(-hits.max(axis=1), kind="stable") if hits.size else ():
        j = int(hits[k].argmax())
        if hits[k, j] and model.subjects[j] not in out:
            out[k] = model.subjects[j]
    return out


def topic_terms(df: DataFrame, item: str, text: str, subjects_table: DataFrame, labels: DataFrame, top: int = 20) -> DataFrame:
    """The top terms of each topic, for inspection: ``topic``, the ``subject`` it was mapped to (or null), ``rank``, ``term``, ``documents``."""
    seeds = seeds_of(subjects_table)
    model = fit(staged(_bags(df, item, text), "topic-bags"), labels, seeds)
    names = topic_subjects(model, seeds)
    wanted = {int(model.vocabulary[s]): (k, names[k], r + 1) for k in range(len(names)) for r, s in enumerate(np.argsort(-model.beta[k], kind="stable")[:top]) if model.beta[k, s] > 0}
    schema = "topic int, subject string, rank int, term string, n long"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: Counter = Counter()
            for t in batch.column(0).to_pylist():
                counted.update({x for x in terms_of(t) if id_of(x) in wanted})
            rows = [(*wanted[id_of(x)], x, n) for x, n in counted.items()]
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["topic", "subject", "rank", "term", "n"])

    found = df.select(F.col(text).cast("string")).mapInArrow(find, schema)
    return found.groupBy("topic", "subject", "rank", "term").agg(F.sum("n").alias("documents"))


def seeds_of(subjects_table: DataFrame) -> dict[str, list[str]]:
    """Described terms of each subject (the table is a short list of areas)."""
    rows = subjects_table.where("subject is not null").select("subject", "description").collect()
    return {r.subject: [t.strip() for t in (r.description or "").split(",") if t.strip()] for r in rows}


def document_topics(df: DataFrame, item: str, text: str, subjects_table: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected terms of each subject in each document: ``item``, ``units`` (sentences, roughly), ``subjects`` map.

    ``labels`` has columns item and subject. Null and empty texts, lists, tables and junk have
    empty maps. Every row gives a row; texts are taken whole.
    """
    seeds = seeds_of(subjects_table)
    bags = staged(_bags(df, item, text), "topic-bags")
    model = fit(bags, labels, seeds)
    names = topic_subjects(model, seeds)
    held = bags.sparkSession.sparkContext.broadcast((model.vocabulary, model.beta.astype(np.float32)))
    kind = bags.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, beta = held.value
        beta = beta.astype(np.float64)
        for batch in batches:
            n = infer(*_entries(batch, vocabulary), batch.num_rows, beta)[0]
            maps = [[(name, float(x)) for name, x in zip(names, column) if name and x >= 0.05] for column in n[:-1].T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=["item", "units", "subjects"])

    return bags.mapInArrow(run, f"item {kind}, units int, subjects map<string,double>").withColumnRenamed("item", item)


def document_subjects(df: DataFrame, item: str, text: str, subjects_table: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document and subject it is about (``item``, ``subject``); see ``document_topics``."""
    shares = document_topics(df, item, text, subjects_table, labels)
    rows = shares.select(F.col(item), "units", F.explode("subjects").alias("subject", "n"), F.aggregate(F.map_values("subjects"), F.lit(0.0), lambda a, x: a + x).alias("all"))
    about = (F.col("n") >= MIN_TERMS) & (F.col("n") >= MIN_PART * F.col("all")) & (F.col("n") >= MIN_DENSITY * F.col("units"))
    return rows.where(about).select(item, "subject")


def languages(df: DataFrame, item: str, text: str) -> DataFrame:
    """``item`` and the language of its text, for composition reports."""
    kind = df.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([language(t) for t in batch.column(1).to_pylist()])], names=[item, "language"])

    return df.select(item, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{item} {kind}, language string")
