"""Quality statistics of texts, and the texts that are not prose (problem 7).

Statistics come from vectorised kernels over Arrow batches: over texts, their lines and their
words. Published rules with fixed thresholds are then applied to the statistics, and every rule
a text fails is recorded. A text is not prose as a whole if both rules that ask for running
text fail, that on ends of lines and that on common words; lines that are items of a list or
rows of fields are no running text where they are the larger part. Only then the shape of the
lines tells lists and tables from junk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.llm.langs import COMMON_WORDS, UNSPACED

# Published thresholds for web text, as (rule, statistic, least, most); None is no limit.
RULES = (
    ("word count", "word_count", 50, 100_000),
    ("mean word length", "mean_word_length", 3, 10),
    ("symbols to words", "symbol_word_ratio", None, 0.1),
    ("bullets", "bullet_line_share", None, 0.9),
    ("ellipses", "ellipsis_line_share", None, 0.3),
    ("letters", "letter_word_share", 0.8, None),
    ("short lines", "short_line_share", None, 0.67),
    ("end marks", "running_end_share", 0.12, None),
    ("common words", "running_common_words", 2, None),
)
#: The rules that ask for running text: a text that fails both is not prose.
RUNNING = ("end marks", "common words")
#: Characters of a short line; share of a script without blanks from which the mean word length tells nothing.
SHORT_LINE, UNSPACED_SHARE = 30, 0.3
#: Thresholds of our own that tell the kind of a text that is not prose, and garbled text from any.
SHAPE = {
    "garbled": 0.15,  # characters left by a wrong decoding
    "urls": 0.5,
    "rows": 0.5,  # lines made of separated fields with numbers
    "symbols": 0.5,
    "runs": 0.5,  # characters in runs of one character, or in one word again and again
    "blobs": 0.5,  # characters in long strings of letters and digits
    "mixed": 0.3,  # words that mix scripts or hold symbols inside
    "items": 0.5,  # lines that begin with a bullet or number, or end in a page number
    "item words": 8.0,  # mean words of a line in a list without bullets
}
COUNTS = ("n_chars", "word_count", "n_lines", "running_common_words")
SHARES = ("mean_word_length", "symbol_ratio", "symbol_word_ratio", "end_line_share", "bullet_line_share", "ellipsis_line_share", "short_line_share", "letter_word_share", "common_word_share", "running_end_share")
KINDS = {"rows": "table", "garbled": "junk", "symbols": "junk", "repeats": "junk", "blob": "junk", "urls": "junk", "mixed": "junk", "items": "list", "short lines": "list"}

_UNSPACED_CLASS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー"
_WORD = rf"[{_UNSPACED_CLASS}]|[^\s\p{{Z}}{_UNSPACED_CLASS}]+"
_END = r"[.!?…。！？｡؟।॥۔][\"'”’»“」』)）\]\s️‍♥✨❤☀-➿\x{1F000}-\x{1FAFF}]*(?:#\S+\s*)?$"
_INVISIBLE = r"[\x{AD}\x{34F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
_BULLET = r"^(?:[-–—*•·▪◦‣+]|\(?\p{Nd}{1,3}[.)]|\(?[\p{L}][.)])\s+\S"
_MARKED_LINE = r"^(?:[-–—*•·▪◦‣+]|\(?\p{Nd}{1,3}[.)]|\(?\p{L}\))[\s\p{Z}]+\S"
_NUMBER_FIELD = r"(?:^|[\t|;,=]|\s{2,})\s*-?\p{Nd}[\p{Nd}.,]*\s*(?:[\t|;,]|\s{2,}|$)"
_THREE_FIELDS = r"[\t|;][^\t|;]*[\t|;]"
_EDGE_MARKS = "\"'.,;:!?()«»“”„"
_COMMON = pa.array(sorted({w for lang, ws in COMMON_WORDS.items() if lang not in UNSPACED for w in ws.split()}), pa.large_string())
_COMMON_RUNS = "|".join(w for lang in UNSPACED for w in COMMON_WORDS[lang].split())

_LINE = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
_ROW = re.compile(r"(?:^|[\t|;,=]|\s{2,})\s*-?\d[\d.,]*\s*(?:[\t|;,]|\s{2,}|$)")
_SEPARATED = re.compile(r"[\t|;,=]|\s{2,}")
_ITEM = re.compile(r"\s*(?:[-–—*•·▪◦‣+]|\(?\d{1,3}[.)]|\(?[^\W\d_][.)])\s+\S|.*\S\s*\.{4,}\s*\d+\s*$")
_RUN = re.compile(r"(\S)\1{7,}")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{30,}")
_URL = re.compile(r"https?://\S+|www\.\S+")
_MIXED = re.compile("[א-ת][A-Za-z]|[A-Za-z][א-ת]|[А-я][א-ת]|\\w[;<>|^&$%]+\\w")
_GARBLED = r"[\x{80}-\x{BF}\x{C3}\x{D0}\x{D1}\x{D7}Œ-Ÿˆ˜‚„†-‰‹›€™�]"
_SYMBOL = re.compile(r"[^\w\s]|_")


def _matches(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _number(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of an array of lists, and the number of the list of each."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a / np.maximum(b, 1), 1.0)


def cleaned(texts: pa.Array) -> pa.Array:
    """Texts without invisible characters, all blanks and line breaks alike; null as the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring_regex(texts, _INVISIBLE, "")
    texts = pc.replace_substring_regex(texts, r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " ")
    return pc.replace_substring_regex(texts, r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+", "\n")


def statistics(texts: pa.Array, reported: bool = True) -> dict[str, np.ndarray]:
    """The statistics of cleaned texts, and ``garbled``, the share of characters of a wrong decoding.

    Without ``reported`` only those that decide whether a text is prose.
    """
    n = len(texts)
    per = lambda owner, weight=None: np.bincount(owner, weight, n)
    lines, owner = _parts(pc.split_pattern(texts, "\n"))
    lines = pc.utf8_trim_whitespace(lines)
    size = pc.utf8_length(lines).to_numpy()
    lines, owner, size = lines.filter(pa.array(size > 0)), owner[size > 0], size[size > 0]
    n_lines = per(owner)
    end, bullet, marked = _matches(lines, _END), _matches(lines, _BULLET), _matches(lines, _MARKED_LINE)
    row = _matches(lines, _THREE_FIELDS)
    some = np.flatnonzero(row)
    row[some] = _matches(lines.take(pa.array(some)), _NUMBER_FIELD) & ~bullet[some]
    # Items and rows are no running text where they are the larger part; a single item is a paragraph.
    listed = (n_lines >= 3) & (per(owner, marked) >= SHAPE["items"] * n_lines)
    rowed = (n_lines >= 2) & (per(owner, row) >= SHAPE["rows"] * n_lines)
    running = ~(marked & listed[owner]) & ~(row & rowed[owner])
    words, line_of = _parts(pc.utf8_split_whitespace(lines))
    text_of = owner[line_of]
    bare = pc.utf8_lower(pc.utf8_trim(words, _EDGE_MARKS))
    which = pc.fill_null(pc.index_in(bare, _COMMON), -1).to_numpy(zero_copy_only=False)
    hit = which >= 0
    used = hit & running[line_of]
    distinct = np.unique(text_of[used] * len(_COMMON) + which[used]) // len(_COMMON)
    runs = _number(lines, _COMMON_RUNS)
    n_chars = _number(texts, r"[^\s\p{Z}]")
    found = {
        "n_chars": n_chars,
        "n_lines": n_lines,
        "running_end_share": _ratio(per(owner, end & running), n_lines),
        "running_common_words": per(distinct) + per(owner, runs * running).astype(np.int64),
        "garbled": _ratio(_number(texts, _GARBLED), n_chars),
    }
    if not reported:
        return found
    word_count, spaced = _number(texts, _WORD), per(text_of)
    return found | {
        "word_count": word_count,
        "mean_word_length": n_chars / np.maximum(word_count, 1),
        "symbol_ratio": _ratio(_number(texts, r"[^\p{L}\p{M}\p{N}\s\p{Z}]"), n_chars),
        "symbol_word_ratio": _number(texts, r"#|…|\.\.\.") / np.maximum(word_count, 1),
        "end_line_share": _ratio(per(owner, end), n_lines),
        "bullet_line_share": _ratio(per(owner, bullet), n_lines),
        "ellipsis_line_share": _ratio(per(owner, _matches(lines, r"(?:\.\.\.|…)$")), n_lines),
        "short_line_share": _ratio(per(owner, size <= SHORT_LINE), n_lines),
        "letter_word_share": _ratio(per(text_of, _matches(words, r"\p{L}")), spaced),
        "common_word_share": _ratio(per(text_of, hit) + per(owner, runs), word_count),
        "unspaced": _ratio(_number(texts, f"[{_UNSPACED_CLASS}]"), n_chars),
    }


def failures(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Which texts fail each rule. The mean word length isn't tested in scripts without blanks, nothing where there are no characters."""
    out = {}
    for rule, name, least, most in RULES:
        if name not in stats:
            continue
        x = stats[name]
        bad = np.zeros(len(x), bool) if least is None else x < least
        if most is not None:
            bad = bad | (x > most)
        if name == "mean_word_length":
            bad &= stats["unspaced"] < UNSPACED_SHARE
        out[rule] = bad & (stats["n_chars"] > 0)
    return out


def shape_of(text: str) -> str | None:
    """What a text without running sentences looks like; None where nothing tells."""
    lines = [x.strip() for x in _LINE.split(text) if x.strip()]
    n, words = len(lines), text.split()
    dense = sum(map(len, words))
    items = sum(1 for x in lines if _ITEM.match(x))
    few_items = items < SHAPE["items"] * n
    if sum(len(m) for m in _URL.findall(text)) >= SHAPE["urls"] * dense:
        return "urls"
    if n >= 2 and sum(1 for x in lines if _ROW.search(x) and _SEPARATED.search(x) and not _ITEM.match(x)) >= SHAPE["rows"] * n:
        return "rows"
    if few_items and len(_SYMBOL.findall(text)) >= SHAPE["symbols"] * dense:
        return "symbols"
    if few_items and sum(m.end() - m.start() for m in _RUN.finditer(text)) >= SHAPE["runs"] * dense:
        return "repeats"
    if sum(len(a) for a, b in zip(words, words[1:]) if a == b) >= SHAPE["runs"] * dense:
        return "repeats"
    if sum(len(m) for m in _BLOB.findall(text)) >= SHAPE["blobs"] * dense:
        return "blob"
    if sum(1 for w in words if _MIXED.search(w)) >= SHAPE["mixed"] * len(words):
        return "mixed"
    if not few_items:
        return "items"
    return "short lines" if n >= 3 and len(words) <= SHAPE["item words"] * n else None


def reasons_of(texts: pa.Array, stats: dict[str, np.ndarray], failed: dict[str, np.ndarray]) -> list[str | None]:
    """Why each cleaned text is not prose (a key of KINDS), None for prose, null and blank texts."""
    out: list[str | None] = [None] * len(texts)
    garbled = (stats["garbled"] >= SHAPE["garbled"]) & (stats["n_chars"] > 0)
    no_prose = np.logical_and.reduce([failed[rule] for rule in RUNNING])
    for i in np.flatnonzero(garbled | no_prose).tolist():
        out[i] = "garbled" if garbled[i] else shape_of(texts[i].as_py())
    return out


def not_prose(texts: pa.Array) -> list[str | None]:
    """The kind (list, table or junk) of each text that is not prose, None for the others."""
    clean = cleaned(texts)
    stats = statistics(clean, reported=False)
    return [KINDS.get(why) for why in reasons_of(clean, stats, failures(stats))]


def with_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``quality``: the statistics, ``failures`` (all published rules failed), ``reason`` and ``kind``.

    ``kind`` is ``list``, ``table`` or ``junk`` for texts that are not prose as a whole, else
    null; ``reason`` names what told it. Null, empty and blank texts get zero counts, null
    shares, no failures and no kind. Words stand between blanks; in Chinese, Japanese and Thai each
    character is one. Texts are taken whole. A column named ``quality`` is replaced.
    """
    base = df.drop("quality")
    names = [*base.columns, "quality"]
    fields = [*(f"{c}:bigint" for c in COUNTS), *(f"{c}:double" for c in SHARES), "failures:array<string>", "reason:string", "kind:string"]
    schema = base.select("*", F.lit(None).cast(f"struct<{','.join(fields)}>").alias("quality")).schema
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = cleaned(batch.column(at))
            stats = statistics(clean)
            failed = failures(stats)
            why = reasons_of(clean, stats, failed)
            blank = pa.array(stats["n_chars"] == 0)
            table = np.stack(list(failed.values()))
            listed = [[rule for rule, bad in zip(failed, column) if bad] for column in table.T.tolist()]
            columns = {c: pa.array(stats[c].astype(np.int64)) for c in COUNTS}
            columns |= {c: pc.if_else(blank, None, pa.array(stats[c].astype(np.float64))) for c in SHARES}
            columns |= {"failures": pa.array(listed, pa.list_(pa.string())), "reason": pa.array(why, pa.string()), "kind": pa.array([KINDS.get(w) for w in why], pa.string())}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays([*columns.values()], names=[*columns])], names=names)

    return base.mapInArrow(run, schema)
