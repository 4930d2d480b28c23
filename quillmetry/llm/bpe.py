"""Encoding a corpus with a public byte-pair tokenizer (problem 8).

Texts are cut into words by the tokenizer's pattern; the distinct words of the whole corpus
are merged once, by Spark higher-order functions that fold the ranked merges over the bytes of
each word, with the ranks as a literal. The words' ids then go back into the texts: from
the workers' memory while the dictionary is of a checked size, by a join beyond it.
"""

from __future__ import annotations

import base64
import json
import random
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry.session import staged

TOKENIZERS = "/opt/tokenizers"
#: The published pattern that cuts texts into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes are merged by the tokenizer's own library: folding is quadratic in them.
LONG_WORD = 256
#: Ids of the dictionary that a worker may hold (about 100 MB); beyond it, ids come by a join.
HELD_IDS = 24_000_000
NO_MERGE = 1 << 20
_SLOTS = 1 << 17


class Vocabulary:
    """Merges, byte ids and pieces of a byte-level tokenizer, read from its two public files."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> None:
        self.ranks = {}
        for line in Path(folder, f"{name}.tiktoken").read_bytes().splitlines():
            piece, rank = line.split()
            self.ranks[base64.b64decode(piece)] = int(rank)
        shown = self._shown_bytes()
        merges = json.loads(Path(folder, f"{name}.json").read_text())["model"]["merges"]
        unshow = lambda s: bytes(shown[c] for c in s)
        self.merges = {}
        for a, b in merges:
            a, b = unshow(a), unshow(b)
            self.merges[self.ranks[a], self.ranks[b]] = self.ranks[a + b]
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]

    @staticmethod
    def _shown_bytes() -> dict[str, int]:
        """The published rule that shows each byte as a printable character."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def pieces(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            out[rank] = piece
        return out

    def slots(self) -> tuple[list[int], tuple[int, int, int, int]]:
        """The merges in a table of two-choice hashing: each pair is in one of two slots."""
        for seed in range(100):
            rng = random.Random(seed)
            mult = tuple(rng.randrange(1, 1 << 20) | 1 for _ in range(4))
            table = [-1] * _SLOTS
            if all(self._place(table, mult, a << 16 | b, m) for (a, b), m in self.merges.items()):
                return table, mult
        raise ValueError("the merges can't be placed")

    @staticmethod
    def _place(table: list[int], mult, key: int, value: int) -> bool:
        entry, way = key << 16 | value, 0
        for _ in range(500):
            a, b = entry >> 32, entry >> 16 & 0xFFFF
            for w in (way, 1 - way):
                slot = (a * mult[2 * w] + b * mult[2 * w + 1]) % _SLOTS
                if table[slot] < 0:
                    table[slot] = entry
                    return True
            slot = (a * mult[2 * way] + b * mult[2 * way + 1]) % _SLOTS
            table[slot], entry = entry, table[slot]
            # The displaced pair tries its other slot first.
            a, b = entry >> 32, entry >> 16 & 0xFFFF
            way = 1 if slot == (a * mult[0] + b * mult[1]) % _SLOTS else 0
        return False


def _literal(values: list[int], kind: str) -> Column:
    """A long array as one literal (folded from text, not built from an expression per value)."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


def fold_merges(byte_array: str, vocabulary: Vocabulary) -> Column:
    """Ids of a word given as an array of its bytes (0 to 255).

    A fold over as many steps as there are pairs. The state holds the ids so far and the rank of
    each neighbouring pair; a step joins the pair of the lowest rank, the first one of equal rank,
    and looks up only the two pairs that change.
    """
    table, mult = vocabulary.slots()
    slots, firsts = _literal(table, "bigint"), _literal(vocabulary.byte_ids, "int")

    def rank(a: Column, b: Column) -> Column:
        key = a.cast("long") * 65536 + b
        hit = [F.get(slots, F.pmod(a.cast("long") * mult[2 * w] + b.cast("long") * mult[2 * w + 1], F.lit(_SLOTS)).cast("int")) for w in (0, 1)]
        found = F.filter(F.array(*hit), lambda entry: F.shiftright(entry, 16) == key)
        return F.coalesce(F.get(found, F.lit(0)).bitwiseAND(F.lit(65535)), F.lit(NO_MERGE)).cast("int")

    ids = F.transform(F.col(byte_array), lambda b: F.get(firsts, b))

    def start(ids: Column) -> Column:
        n = F.size(ids)
        ranks = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: rank(F.get(ids, i), F.get(ids, i + 1)))).otherwise(F.array().cast("array<int>"))
        return F.struct(ids.alias("ids"), ranks.alias("ranks"))

    def step(state: Column, best: Column, at: Column) -> Column:
        ids, ranks = state["ids"], state["ranks"]
        n = F.size(ids)
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        beside = F.array(F.when(at > 1, pair(F.get(ids, at - 2), best)), F.when(at + 1 < n, pair(best, F.get(ids, at + 1))))
        changed = F.transform(F.filter(beside, lambda p: p.isNotNull()), lambda p: rank(p["a"], p["b"]))
        return F.struct(
            F.concat(F.slice(ids, F.lit(1), at - 1), F.array(best), F.slice(ids, at + 2, n)).alias("ids"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), changed, F.slice(ranks, at + 2, n)).alias("ranks"),
        )

    def merge(state: Column, _: Column) -> Column:
        best = F.coalesce(F.array_min(state["ranks"]), F.lit(NO_MERGE))
        found = F.array(F.struct(best.alias("best"), F.array_position(state["ranks"], best).cast("int").alias("at")))
        return F.when(best >= NO_MERGE, state).otherwise(F.get(F.transform(found, lambda x: step(state, x["best"], x["at"])), F.lit(0)))

    begun = F.get(F.transform(F.array(ids), start), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(F.col(byte_array)), F.lit(1))), begun, merge, lambda state: state["ids"])


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def _hashed(df: DataFrame, item: str, text: str) -> DataFrame:
    """item and the hashes of its words; and, with a null item, each new word a worker meets."""
    kind = df.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in = regex.compile(PATTERN).findall
        known: dict[str, int] = {}
        for batch in batches:
            fresh, values, ends = [], [], [0]
            for t in batch.column(1).to_pylist():
                words = words_in(t) if t else []
                for w in set(words).difference(known):
                    known[w] = _word_hash(w)
                    fresh.append(w)
                values += map(known.__getitem__, words)
                ends.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([True] * batch.num_rows), lists, none.cast(pa.int64()), none.cast(pa.binary())], names=names)
            if fresh:
                rows = len(fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(rows, batch.column(0).type), pa.array([False] * rows), pa.nulls(rows, lists.type), pa.array([known[w] for w in fresh]), pa.array([w.encode("utf-8", "surrogatepass") for w in fresh], pa.binary())], names=names
                )
            if len(known) > 1_000_000:
                known.clear()

    names = ["item", "is_text", "words", "hash", "word"]
    rows = df.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item {kind}, is_text boolean, words array<bigint>, hash bigint, word binary")


def word_ids(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """hash and ids of each distinct word (columns ``hash``, ``word``)."""
    distinct = words.groupBy("hash").agg(F.min("word").alias("word"), F.max("word").alias("other"))
    checked = distinct.where(F.col("word").eqNullSafe(F.col("other")) | F.raise_error(F.lit("two words share a hash")).isNotNull())
    short = checked.where(F.length("word") <= LONG_WORD).select("hash", "word")
    ranks = vocabulary.ranks

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).cast(pa.large_binary())
            flat = np.frombuffer(words.buffers()[2], np.uint8)
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
            values = pa.array(flat[ends[0] : ends[-1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), values)], names=["hash", "bytes"])

    folded = short.mapInArrow(to_bytes, "hash bigint, bytes array<int>").select("hash", fold_merges("bytes", vocabulary).alias("ids"))

    def merge_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("long", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            ids = [encoder._encode_single_piece(w) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["hash", "ids"])

    long = checked.where(F.length("word") > LONG_WORD).select("hash", "word").mapInArrow(merge_long, "hash bigint, ids array<int>")
    return folded.unionByName(long)


def encode(df: DataFrame, item: str, text: str, vocabulary: Vocabulary | None = None, held_ids: int = HELD_IDS) -> DataFrame:
    """``item`` and ``ids``, the token ids of its text without special tokens.

    Null and empty texts have the empty list. Strings of special tokens in a text are ordinary
    text. Every row of ``df`` gives a row, repeated ones too; texts are taken whole.
    """
    vocabulary = vocabulary or Vocabulary()
    rows = staged(_hashed(df, item, text), "bpe-words")
    texts = rows.where("is_text").select("item", "words")
    ids = staged(word_ids(rows.where("not is_text").select("hash", "word"), vocabulary), "bpe-ids")
    size = ids.agg(F.coalesce(F.sum(F.size("ids") + 2), F.lit(0))).first()[0]
    done = _from_memory(texts, ids) if size <= held_ids else _by_join(texts, ids)
    return done.withColumnRenamed("item", item)


def _from_memory(texts: DataFrame, ids: DataFrame) -> DataFrame:
    table = ids.toArrow().combine_chunks()
    hashes = table.column("hash").to_numpy()
    order = np.argsort(hashes, kind="stable")
    lists = table.column("ids").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())[order] if len(lists) else np.empty(0, np.int64)
    starts = lists.offsets.to_numpy()[:-1][order] if len(lists) else np.empty(0, np.int64)
    held = texts.sparkSession.sparkContext.broadcast((hashes[order], starts.astype(np.int64), lengths.astype(np.int64), lists.values.to_numpy().astype(np.int32)))
    kind = texts.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, length, values = held.value
        for batch in batches:
            words = batch.column(1)
            flat = words.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(np.diff(words.offsets.to_numpy()))])
            at = np.searchsorted(known, flat)
            n = length[at] if len(flat) else np.empty(0, np.int64)
            stop = np.concatenate([[0], np.cumsum(n)])
            take = np.repeat(first[at] - stop[:-1], n) + np.arange(stop[-1]) if len(flat) else np.empty(0, np.int64)
            out = pa.ListArray.from_arrays(pa.array(stop[ends].astype(np.int32)), pa.array(values[take]))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["item", "ids"])

    return texts.mapInArrow(run, f"item {kind}, ids array<int>")


def _by_join(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The same for a dictionary of any size. Rows get a number, since items may repeat."""
    numbered = staged(texts.withColumn("row", F.monotonically_increasing_id()), "bpe-rows")
    words = numbered.select("row", F.posexplode("words").alias("pos", "hash"))
    found = words.join(ids, "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    joined = numbered.select("row", "item").join(found, "row", "left")
    return joined.select("item", F.coalesce(F.flatten(F.col("parts.ids")), F.array().cast("array<int>")).alias("ids"))


def decode(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """``df`` with the text of a list of ids: the pieces' bytes, joined, as UTF-8.

    A null list gives null, the empty one the empty text; an unknown id raises an error.
    """
    pieces = (vocabulary or Vocabulary()).pieces()
    table = F.from_json(F.lit(json.dumps([p.hex() for p in pieces])), "array<string>")
    joined = F.array_join(F.transform(F.col(ids), lambda i: F.coalesce(F.get(table, i), F.raise_error(F.lit("unknown id")).cast("string"))), "")
    return df.withColumn(out, F.decode(F.unhex(joined), "UTF-8"))


def token_counts(df: DataFrame, item: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, out: str = "n_tokens") -> DataFrame:
    """``item`` and the number of its text's tokens (0 for null and empty), by the tokenizer's library."""
    kind = df.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, f"{name}.tiktoken").read_bytes().splitlines())}
        encoder = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["item", "n"])

    rows = df.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item {kind}, n int").toDF(item, out)
