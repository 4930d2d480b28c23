"""Cutting oversized texts at natural boundaries (problem 6).

Offsets of sentence units and of words are sorted arrays of prefix sums of characters. For
each piece the last boundary under the limit is found by binary search, a unit end before a
word end, and a hard cut where there is neither; the next piece begins the overlap before.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.llm.segment import Model, Splitter, learn

_WORD = re.compile(r"\S+")


def cut(length: int, limit: int, overlap: int, units: list[int], words: list[int]) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of cut) of a text of ``length`` characters.

    No piece is longer than ``limit``; neighbours share exactly ``overlap`` characters (at most
    ``limit - 1``, so that every piece adds something). ``units`` and ``words`` are the sorted
    ends of units and words.
    """
    if limit <= 0 or length <= limit:
        return [(0, length, "end")]
    overlap = max(0, min(overlap, limit - 1))
    out, start, done = [], 0, 0
    while start + limit < length:
        most = start + limit
        for ends, kind in ((units, "unit"), (words, "word"), ((), "hard")):
            i = bisect_right(ends, most) - 1
            if i >= 0 and ends[i] > done and ends[i] > start + overlap:
                end = ends[i]
                break
        else:
            end, kind = most, "hard"
        out.append((start, end, kind))
        done, start = end, end - overlap
    out.append((start, length, "end"))
    return out


def oversized_pieces(df: DataFrame, item: str, text: str, limit: str, overlap: str, model: Model | None = None) -> DataFrame:
    """One row per piece, and per oversized unit, of every text.

    ``limit`` and ``overlap`` name columns, in characters. Rows have ``what`` ``piece`` (with
    ``no`` from 0, ``char_start``, ``char_end``, ``cut`` for what its end is: unit, word, hard
    or end, and ``pieces``, their number in the text) or ``unit`` (``no`` is the unit's number
    in its text, for units that alone exceed the limit). Null texts give no row; a null or
    non-positive limit leaves the text whole; a null overlap is none. Texts are taken whole.
    """
    splitter = Splitter(learn(df, text) if model is None else model)
    kind = df.schema[item].dataType
    cols = [F.col(item).alias("item"), F.col(text).cast("string").alias("text"), F.col(limit).cast("long").alias("limit"), F.col(overlap).cast("long").alias("overlap")]
    names = ["item", "what", "no", "char_start", "char_end", "cut", "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, (t, most, back) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                if t is None:
                    continue
                if most is None or most <= 0 or len(t) <= most:
                    at.append(i)
                    rows.append(("piece", 0, 0, len(t), "end", 1))
                    continue
                units = splitter.units(t)
                words = [m.end() for m in _WORD.finditer(t)]
                found = cut(len(t), most, back or 0, [b for _, b in units], words)
                rows += [("piece", k, a, b, how, len(found)) for k, (a, b, how) in enumerate(found)]
                big = [("unit", k, a, b, "unit", len(found)) for k, (a, b) in enumerate(units) if b - a > most]
                rows += big
                at += [i] * (len(found) + len(big))
            cols_out = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols_out, types))], names=names)

    done = df.select(*cols).mapInArrow(run, f"item {kind.simpleString()}, what string, no int, char_start int, char_end int, cut string, pieces int")
    return done.withColumnRenamed("item", item)
