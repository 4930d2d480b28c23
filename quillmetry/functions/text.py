"""String functions as column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmetry.constants import PREFIX_LETTERS, SUFFIXES

#: Unicode white space; Java's own class holds only the ASCII part.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Everything that separates tokens: white space, ASCII marks and controls, general and full-width punctuation.
TOKEN = r"[^\s\x{00}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}\x{85}\x{a0}-\x{bf}\x{1680}\x{2000}-\x{206f}\x{2e00}-\x{2e7f}\x{3000}-\x{303f}\x{fe10}-\x{fe6f}\x{ff01}-\x{ff60}]+"
WORD = "[^" + SPACE[1:-1] + "]+"
LINK = r"^(?:https?://\S+|www\.\S+|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+)"


def punctuation_mapped(text: Column) -> Column:
    """Typographic quotes, dashes and the no-break space as ASCII; the ellipsis as three periods."""
    return F.replace(F.translate(text, "“”‘’—– ", "\"\"''-- "), F.lit("…"), F.lit("..."))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` with white space behind; empty ones dropped, not stripped."""
    return F.filter(F.split(text, rf"(?<=[.!?]){SPACE}+"), lambda s: s != "")


def parser_sentences(text: Column, spaced_only: bool = True) -> Column:
    """The split used before parsing: also at line breaks; pieces stripped, by default only those with a blank."""
    pieces = F.split(stripped(text), r"(?<=[.!?׃])\s+|(?<=\n)\n*|(?<!\S)\n+")
    pieces = F.filter(F.transform(pieces, stripped), lambda s: s != "")
    return F.filter(pieces, lambda s: F.contains(s, F.lit(" "))) if spaced_only else pieces


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def prefix(token: Column) -> Column:
    """The prefix letter of a Hebrew token, null if it has none."""
    return F.when(token.rlike(f"^[{PREFIX_LETTERS}][א-ת]"), F.substring(token, 1, 1))


def suffix(token: Column) -> Column:
    """The first suffix of the list that the token ends with, with a Hebrew letter before it; null for a bare suffix."""
    found = F.regexp_extract(token, rf"(?s)[א-ת].*?({'|'.join(SUFFIXES)})$", 1)
    return F.when(~token.isin(SUFFIXES) & (found != ""), found)


def parser_input(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\t", " "), " +", " "))


def feature_map(text: Column) -> Column:
    """``a=b|c=d`` as a map; ``_`` and the empty string give none, pairs without ``=`` are dropped."""
    pairs = F.filter(F.split(text, r"\|"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.split(p, "=", 2))
    none = F.create_map().cast("map<string,string>")
    return F.when((text == "") | (text == "_") | (F.size(pairs) == 0), none).otherwise(F.map_from_entries(F.transform(entries, lambda e: F.struct(e[0], e[1]))))


def sentence_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.!?]"))


def script_ratio(text: Column, script: str = "֐-׿") -> Column:
    """Characters of a script among those that are no white space; 0 if there are none."""
    dense = F.length(F.regexp_replace(text, SPACE, ""))
    return F.when(dense > 0, F.regexp_count(text, F.lit(f"[{script}]")) / dense).otherwise(0.0)


def repetition_ratio(text: Column) -> Column:
    """Share of repeated sentences among the non-empty ones; 0 below two."""
    parts = F.filter(F.transform(F.split(text, "[.!?]"), stripped), lambda s: s != "")
    return F.get(F.transform(F.array(parts), lambda p: F.when(F.size(p) >= 2, (F.size(p) - F.size(F.array_distinct(p))) / F.size(p)).otherwise(0.0)), F.lit(0))


def link_ratio(text: Column) -> Column:
    """Share of words that begin as a link or mail address."""
    w = words(text)
    return F.get(F.transform(F.array(w), lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda t: t.rlike(LINK))) / F.size(x)).otherwise(0.0)), F.lit(0))


def share_code(text: Column) -> Column:
    return F.url_encode(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""))


def share_text(code: Column) -> Column:
    """The text of a share code; null where it can't be decoded."""
    return F.decode(F.try_to_binary(F.try_url_decode(code), F.lit("base64")), "UTF-8")


def truncated(text: Column, limit: int = 512) -> Column:
    """The text cut to ``limit`` characters, at the last sentence mark beyond 40 % of them where there is one."""
    cut = F.substring(text, 1, limit)
    last = F.length(cut) - F.length(F.regexp_extract(cut, r"[^.!?]*$", 0))
    return F.when(F.length(text) <= limit, text).when(last > 0.4 * limit, F.concat(F.substring(cut, F.lit(1), last), F.lit(" …"))).otherwise(F.concat(cut, F.lit("…")))


def offsets(text: Column, parts: Column) -> Column:
    """Start and end of each part, found from the end of the one before."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        start = F.call_function("locate", part, text, state["at"] + 1) - 1
        return F.struct((start + F.length(part)).alias("at"), F.concat(state["found"], F.array(F.struct(start.alias("start"), (start + F.length(part)).alias("stop")))).alias("found"))

    return F.aggregate(parts, zero, step, lambda s: s["found"])
