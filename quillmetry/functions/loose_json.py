"""Reading JSON objects from text that only nearly holds one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LAX = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true", "allowComments": "true"}


def _body(text: Column) -> Column:
    """The part between the outermost braces, without code fences and broken escapes."""
    plain = F.regexp_replace(text, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    plain = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.regexp_replace(plain, r"\\u(?![0-9a-fA-F]{4})", "")


def loose_object(text: Column, fields: list[str]) -> Column:
    """The wanted string fields of the object in ``text`` as a map; null where none is found.

    Tried in order: the object as it is, with lax rules, with typographic quotes made plain, and at last
    each field picked by its name and quotes alone.
    """
    body = _body(text)
    kind = "map<string,string>"
    strict = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, kind))
    lax = F.from_json(body, kind, _LAX)
    repaired = F.from_json(F.translate(body, "“”„״", '""""'), kind, _LAX)
    picked = [F.struct(F.lit(f).alias("k"), F.regexp_extract(text, rf'(?s)["\']?{f}["\']?\s*:\s*["“]((?:[^"\\]|\\.)*)["”]', 1).alias("v")) for f in fields]
    by_name = F.map_from_entries(F.filter(F.array(*picked), lambda e: e["v"] != ""))
    some = lambda m: F.when(F.size(F.map_filter(m, lambda k, _: k.isin(fields))) > 0, F.map_filter(m, lambda k, _: k.isin(fields)))
    return F.coalesce(some(strict), some(lax), some(repaired), some(by_name))
