"""The language a text is written in, told from its characters and frequent words."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

# Frequent function words, by language.
COMMON_WORDS = {
    "he": "של את על לא זה עם הוא היא כי גם או אבל כל אני יש היה",
    "en": "the of and to a in is that was for with on it as be at by",
    "de": "der die das und ist in zu den mit von für auf nicht ein im",
    "fr": "le la les de des et est un une que pour dans en du sur",
    "ru": "и в на не что с по как это из у за но от",
    "ar": "في من على إلى أن هذا التي عن مع لم قد و",
    "zh": "的 了 在 是 和 不 有 这 我 人 也 就",
    "ja": "の は を に が で と た し も",
    "hi": "के में की है और से को का पर ने कि यह",
    "th": "ที่ และ ใน ของ มี ไม่ ว่า เป็น ได้ จาก",
}
#: Languages written without blanks between words.
UNSPACED = ("zh", "ja", "th")
_LATIN = {lang: frozenset(COMMON_WORDS[lang].split()) for lang in ("en", "de", "fr")}
_LATIN_WORD = re.compile(r"[a-zA-ZÀ-ɏ]+")


def _script_counts(text: str) -> dict[str, int]:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    blocks = np.bincount(np.minimum(cps >> 7, 600), minlength=601)
    low = cps[cps < 0x80] | 0x20
    return {
        "latin": int(((low >= 0x61) & (low <= 0x7A)).sum() + blocks[1:5].sum()),
        "ru": int(blocks[8:10].sum()),
        "he": int(blocks[11] + blocks[502]),
        "ar": int(blocks[12:14].sum()),
        "hi": int(blocks[18]),
        "th": int(blocks[28]),
        "kana": int(((cps >= 0x3041) & (cps <= 0x30FF)).sum()),
        "han": int(blocks[156:320].sum()),
    }


def language(text: str | None) -> str:
    """Language code of a text by its script, for Latin script by its function words.

    ``und`` for null, empty and letterless texts. The whole text counts.
    """
    if not text:
        return "und"
    n = _script_counts(text)
    east = n["kana"] + n["han"]
    best = max(("latin", "ru", "he", "ar", "hi", "th"), key=lambda k: n[k])
    if east and 2 * east >= n[best]:
        return "ja" if 4 * n["kana"] >= east else "zh"
    if not n[best]:
        return "und"
    if best != "latin":
        return best
    counted = Counter(_LATIN_WORD.findall(text.lower()))
    hits = {lang: sum(map(counted.__getitem__, words)) for lang, words in _LATIN.items()}
    top = max(hits, key=lambda k: hits[k])
    return top if hits[top] else "en"
