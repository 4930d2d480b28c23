"""One form for texts that look the same (problem 3).

A transducer over runs of characters that may change, the base before a run of marks included.
The mapping of a run is composed from rules the first time it is met and kept in a table, so
that each different run is worked out once in a worker and then looked up in one pass:

* every kind of blank becomes a plain space, line breaks become ``\\n``;
* invisible characters vanish (a joiner between two pictographs stays: it changes the look);
* full and half width, presentation forms, letter ligatures and letters encoded as one
  character for two become the plain letters;
* base and marks are composed, marks in canonical order;
* look-alike letters of Greek, Cyrillic, Armenian, Cherokee and Lisu become the Latin letter they look like.

Every output is a fixed point: the tests apply the mapping twice to every code point.

Letter case, accents, vowel points, digits and visible punctuation are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that share one shape, listed as look-alike then the Latin letter.
LOOK_ALIKES = (
    "А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  У Y  Х X  Ѕ S  І I  Ј J  Ԛ Q  Ԝ W  Ү Y "
    "а a  е e  о o  р p  с c  у y  х x  ѕ s  і i  ј j  һ h  ԁ d  ԛ q  ԝ w  ү y "
    "Ӏ I  ӏ l  Ѵ V  ѵ v "
    "Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  α a  ν v  ο o  ρ p  ϲ c  Ϲ C  ϳ j "
    "ɡ g  ɑ a  ‐ - "
    "Օ O  Տ S  օ o  ո n  ս u  հ h "
    "Ꭺ A  Ᏼ B  Ꮯ C  Ꭰ D  Ꭼ E  Ꮐ G  Ꮋ H  Ꭻ J  Ꮶ K  Ꮮ L  Ꮇ M  Ꮲ P  Ꭱ R  Ꮪ S  Ꭲ T  Ꮩ V  Ꮃ W  Ꮓ Z "
    "ꓮ A  ꓐ B  ꓚ C  ꓓ D  ꓰ E  ꓝ F  ꓖ G  ꓧ H  ꓲ I  ꓙ J  ꓗ K  ꓡ L  ꓟ M  ꓠ N  ꓳ O  ꓑ P  ꓣ R  ꓢ S  ꓔ T  ꓴ U  ꓦ V  ꓪ W  ꓫ X  ꓬ Y  ꓜ Z"
)
# One character that stands for two letters without a Unicode decomposition.
LETTER_PAIRS = "װ וו  ױ וי  ײ יי"
#: Kinds of compatibility decomposition that leave the look as it is.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Kinds that leave the look of a letter as it is; ``<font>`` holds the wide Hebrew letters.
SAME_LOOK_LETTER = {"<compat>", "<font>"}
LINE_BREAKS = "\n\x0b\x0c\r\x85\u2028\u2029"
#: Fillers that are letters by category but show nothing.
BLANK_LETTERS = "\u115f\u1160\u3164\uffa0\u2800"
JOINER = "\u200d"


def _pairs(text: str) -> dict[str, str]:
    words = text.split()
    return dict(zip(words[::2], words[1::2]))


_LETTERS = _pairs(LOOK_ALIKES) | _pairs(LETTER_PAIRS)


def is_invisible(ch: str) -> bool:
    """Whether a character shows nothing and takes no room."""
    if ch in LINE_BREAKS or ch == "\t":
        return False
    cp = ord(ch)
    return (
        unicodedata.category(ch) in ("Cf", "Cc")
        or cp in (0x34F, 0x17B4, 0x17B5)
        or 0x180B <= cp <= 0x180F
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0000 <= cp <= 0xE0FFF
        or ch in BLANK_LETTERS
    )


def _single(ch: str) -> str:
    """The form of one visible character, marks left decomposed."""
    if ch in LINE_BREAKS:
        return "\n"
    if ch == "\t" or unicodedata.category(ch) == "Zs":
        return " "
    if is_invisible(ch):
        return ""
    if ch in _LETTERS:
        return _LETTERS[ch]
    kind, _, rest = unicodedata.decomposition(ch).rpartition(">")
    if not rest:
        return ch
    kind += ">" if kind else ""
    letter = unicodedata.category(ch)[0] in "L" or 0x2E80 <= ord(ch) <= 0x2FD5 or 0x2160 <= ord(ch) <= 0x217F
    if kind and kind not in SAME_LOOK and not (kind in SAME_LOOK_LETTER and letter):
        return ch
    return "".join(_single(chr(int(x, 16))) for x in rest.split())


def _in_class(pick) -> str:
    """A regular-expression class of the characters up to U+FFFF that ``pick`` accepts."""
    picked = [cp for cp in range(0x10000) if not 0xD800 <= cp <= 0xDFFF and pick(chr(cp))]
    breaks = [i for i, cp in enumerate(picked) if i == 0 or picked[i - 1] != cp - 1]
    spans = [(picked[i], picked[j - 1]) for i, j in zip(breaks, [*breaks[1:], len(picked)])]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


class Transducer:
    """The compiled mapping. Built once in a Python worker, then applied to any number of texts.

    Only the runs of characters that may change are looked up, with the base before them
    where a run begins with a mark; all characters beyond U+FFFF count as such a run.
    """

    def __init__(self) -> None:
        marks = _in_class(lambda c: unicodedata.category(c)[0] == "M" or is_invisible(c))
        mapped = _in_class(lambda c: not c.isascii() and unicodedata.category(c) != "Cn" and _single(c) != c)
        self._run = re.compile(f"[{marks}{mapped}\t\x0b\x0c\r\U00010000-\U0010ffff]+")
        self._mark = re.compile(f"[{marks}]")
        self._cache: dict[str, str] = {}
        self.check()

    def check(self) -> None:
        """Every output must be a fixed point, else two look-alike texts could end in two forms."""
        for a, b in _LETTERS.items():
            if self.apply(b) != b or self.apply(a) != b:
                raise ValueError(f"conflicting mapping of {a!r}")

    def _map(self, run: str) -> str:
        out = []
        for i, c in enumerate(run):
            if c == JOINER and 0 < i < len(run) - 1 and unicodedata.category(run[i + 1]) == "So":
                before = run[:i].rstrip("\ufe0f")[-1:]
                if before and unicodedata.category(before) in ("So", "Sk"):
                    out.append(c)
                    continue
            out.append(_single(c))
        composed = unicodedata.normalize("NFC", "".join(out))
        # A composed letter may itself be a look-alike.
        return unicodedata.normalize("NFC", "".join(c if c == JOINER else _single(c) for c in composed))

    def apply(self, text: str) -> str:
        run = self._run.search(text)
        if run is None:
            return text
        text = text.replace("\r\n", "\n") if "\r" in text else text
        cache, out, done = self._cache, [], 0
        for run in self._run.finditer(text):
            first = run.start()
            if first > done and self._mark.match(text, first):
                first -= 1
            old = text[first : run.end()]
            new = cache.get(old)
            if new is None:
                new = self._map(old)
                if len(cache) < 100_000:
                    cache[old] = new
            out += (text[done:first], new)
            done = run.end()
        out.append(text[done:])
        joined = "".join(out)
        return joined if unicodedata.is_normalized("NFC", joined) else unicodedata.normalize("NFC", joined)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def one_form(text: str | None) -> str | None:
    """``text`` in the form that all texts of its look share; null stays null."""
    return None if text is None else transducer().apply(text)


def with_one_form(df: DataFrame, text: str = "text", out: str = "one_form") -> DataFrame:
    """``df`` with a column ``out`` that holds ``text`` in its one form.

    Null stays null and the empty text stays empty. All other columns pass unchanged; a
    column that already has the name ``out`` is replaced. Texts of any length are taken whole.
    """
    base = df.drop(out) if out in df.columns and out != text else df
    schema = base.select("*", F.col(text).cast("string").alias("__form")).schema
    names = [*base.columns, "__form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            forms = [one_form(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=names)

    done = base.mapInArrow(run, schema)
    if out == text:
        return done.drop(text).withColumnRenamed("__form", out).select(*df.columns)
    return done.withColumnRenamed("__form", out)


def look_alike_pairs(df: DataFrame, item: str, text: str) -> DataFrame:
    """Pairs of items whose texts look the same but are different strings.

    Returns ``lo`` and ``hi`` (``lo < hi``, each pair once). Rows with a null item or text
    take no part; the same string under several items is no pair, and an item that stands
    in several rows with different strings is not paired with itself. Copies are first
    gathered into one row per distinct string, so a string that holds a third of all rows
    costs no comparison of its copies with each other.
    """
    rows = df.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    variants = with_one_form(rows.select("text").distinct(), "text", "form")
    a = variants.select("form", F.col("text").alias("text_a"))
    b = variants.select("form", F.col("text").alias("text_b"))
    unlike = a.join(b, "form").where(F.col("text_a") < F.col("text_b")).select("text_a", "text_b")
    left = rows.select(F.col("item").alias("item_a"), F.col("text").alias("text_a"))
    right = rows.select(F.col("item").alias("item_b"), F.col("text").alias("text_b"))
    both = unlike.join(left, "text_a").join(right, "text_b").where(F.col("item_a") != F.col("item_b"))
    return both.select(F.least("item_a", "item_b").alias("lo"), F.greatest("item_a", "item_b").alias("hi")).distinct()
