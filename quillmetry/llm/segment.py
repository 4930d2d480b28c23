"""Sentence units of texts in many languages and scripts (problem 2).

First, ``learn`` counts over all texts, per language, which words stand before a period and
which words begin sentences where that is certain (a line start, after ``!`` or ``?``). By
log-likelihood ratios it tells sentence starters from words that never start one,
abbreviations from words that end sentences, and words bound to a number before them.
Then every mark is classified by these statistics, by letter case where the script has it,
and by the quotation or bracket it stands in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.llm.langs import UNSPACED, language
from quillmetry.llm.looks import is_invisible, one_form
from quillmetry.session import staged

#: A word enters the model only with this share of its language's words (or periods), which
#: bounds the model at 1 / MIN_SHARE words a language and kind, however large the corpus.
MIN_SHARE = 2e-5
#: Dunning log-likelihood ratios at p = 0.05, 0.01 and 0.005.
LLR_STARTER, LLR_ABBREVIATION, LLR_NEVER_STARTS = 3.84, 6.63, 7.88
MAX_COUNTED = 400_000

LINE_BREAK = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
_INVISIBLE = re.compile("[" + "".join(f"\\u{c:04x}" for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and c not in (0x200D, *range(0xFE00, 0xFE10)) and is_invisible(chr(c))) + "]")
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "«": "»", "“": "”", "„": "“"}
CLOSE = set(OPEN.values())
BRACKETS = set("([{（【")
PLAIN_QUOTES = '"״＂'
_DOUBLE = set(PLAIN_QUOTES + "“”")  # may close each other: styles get mixed
_BLANKS, _NEXT = re.compile(r"\s*"), re.compile(r"\S+")
_EVENT = re.compile(r"[.!?…。！？｡．؟۔।॥]+|[" + re.escape("".join(sorted(set(OPEN) | CLOSE | set(PLAIN_QUOTES)))) + "]")
_FULL = set("。！？｡")  # needs no blank after it
_PERIODS = set(".．")
_EMOJI = re.compile("[\U0001f000-\U0001faff☀-➿❤⭐⭕][︎️‍\U0001f000-\U0001faff☀-➿❤]*")
_OPENERS = "".join(OPEN) + PLAIN_QUOTES + "'’‘-–—*•¿¡"
_TRAIL = ".,;:!?…\"'’”“»«)]}״،؛।؟。！？"
_DIGIT = re.compile(r"\d")
_EDGE = re.compile(r"(?:^|(?<=[!?؟।!?])\s)\s*(\S+)")
_AFTER_PERIOD = re.compile(r"(\S+)[.．]\s+(?=(\S+))")
_ENDED = re.compile(r"[.!?…।؟][\"'”»)\]״]*\W*$")
_END_RUN = re.compile(r"[.!?…।؟]+(?=\s|$)")
_QUOTED = re.compile(r"""["״“„«][^"״”“»]*["״”“»]|\([^()]*\)""")
_THAI = re.compile("[฀-๿]")
_THAI_RUN = re.compile("[฀-๿]+")
_ROW = re.compile(r"[\t|]|\s{3,}|\.{4,}|=[^;]*;")
_ITEM = re.compile(r"\s*(?:[-–—*•·▪◦‣+]|\(?\d{1,3}[.)]|\(?\w[.)])\s")
_MARKER = re.compile(r"\(?(?:\d{1,3}|[^\W\d_]|[ivxlc]{1,4})$", re.I)
_GARBLED = re.compile("[\u0080-¿Œ-Ÿˆ˜‘-›€™�]")
NUMBER = "##"


def _bare(token: str) -> str:
    """A token without quotes, brackets and punctuation around it, numbers as one type."""
    token = token.lstrip(_OPENERS).rstrip(_TRAIL)
    if _DIGIT.search(token):
        return NUMBER
    return token if token.isascii() else one_form(token)


def _before(token: str) -> str:
    """The type of a token before a period: folded case, a prefix with a hyphen removed."""
    token = token.lstrip(_OPENERS)
    token = token.rpartition("-")[2] if _DIGIT.search(token) else token
    token = _bare(token + ".") if not token.endswith(".") else _bare(token)
    return token if token == NUMBER else token.casefold()


def _hollow(match: re.Match) -> str:
    """A quotation or bracket without the marks inside it."""
    return re.sub(r"[.!?]+(?!\w)", "", match.group())


def _clean(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible characters, and where each kept one stands in it."""
    gone = [m.start() for m in _INVISIBLE.finditer(text)]
    if not gone:
        return text, None
    return _INVISIBLE.sub("", text), np.delete(np.arange(len(text)), gone).tolist()


# ---------------------------------------------------------------- learning


def _count(texts: Iterator[str | None], only: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str, str, int, int]]:
    """Counted types: T word total/starts, P word-next pairs, L totals of a language."""
    tokens: dict[str, Counter] = {}
    starts: dict[str, Counter] = {}
    pairs: dict[str, Counter] = {}
    ends: Counter = Counter()

    def flush():
        for lang, counted in tokens.items():
            merged: dict[str, list[int]] = {}
            for raw, n in counted.items():
                if word := _bare(raw):
                    merged.setdefault(word, [0, 0])[0] += n
            for raw, n in starts.get(lang, Counter()).items():
                if word := _bare(raw):
                    merged.setdefault(word, [0, 0])[1] += n
            for word, (n, k) in merged.items():
                yield lang, "T", word, "", n, k
            both: Counter = Counter()
            for (a, b), n in pairs.get(lang, Counter()).items():
                if (w := _before(a)) and (x := _bare(b)):
                    both[w, x] += n
            for (w, x), n in both.items():
                yield lang, "P", w, x, n, 0
            yield lang, "L", "", "", sum(n for n, _ in merged.values()), ends[lang]
        for d in (tokens, starts, pairs, ends):
            d.clear()

    held = 0
    for text in texts:
        if not text:
            continue
        lang = language(text)
        if lang == "und" or lang in UNSPACED or only and lang not in only:
            continue
        text, _ = _clean(text)
        mine = tokens.setdefault(lang, Counter())
        held -= len(mine)
        mine.update(text.split())
        held += len(mine)
        begun, seen = starts.setdefault(lang, Counter()), pairs.setdefault(lang, Counter())
        for line in LINE_BREAK.split(text):
            if _ENDED.search(line) is None or _ITEM.match(line) or line.count(" ") < 2:
                continue
            begun.update(_EDGE.findall(line))
            seen.update(_AFTER_PERIOD.findall(_QUOTED.sub(_hollow, line)))
            ends[lang] += len(_END_RUN.findall(line))
        if held > MAX_COUNTED:
            yield from flush()
            held = 0
    yield from flush()


def _llr(k, n, p):
    """Dunning's ratio of seeing ``k`` in ``n`` where ``p`` is expected, as a column."""
    p = F.greatest(F.least(p, F.lit(0.999)), F.lit(0.0005))
    a = F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    b = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)
    return 2 * (a + b)


@dataclass
class Model:
    """What was learned; small by MIN_SHARE and sent to the workers as it is."""

    status: dict[tuple[str, str], str] = field(default_factory=dict)  # S starts sentences, N never
    before: dict[tuple[str, str], str] = field(default_factory=dict)  # A abbreviation, a weaker one, E ends sentences
    bound: set[tuple[str, str]] = field(default_factory=set)  # words bound to the number before them


def model_rows(df: DataFrame, text: str = "text", only: tuple[str, ...] = ()) -> DataFrame:
    """The model as a table (lang, kind, word, value), learned from every text of ``df`` (in the languages ``only``, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names = [], ["lang", "kind", "word", "next", "n", "k"]
        for row in _count((t for b in batches for t in b.column(0).to_pylist()), only):
            rows.append(row)
            if len(rows) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    counted = df.select(F.col(text).cast("string")).mapInArrow(run, "lang string, kind string, word string, next string, n long, k long")
    counted = counted.groupBy("lang", "kind", "word", "next").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counted = staged(counted, "segment-counts")
    words = counted.where("kind = 'T'").select("lang", "word", "n", F.least("k", "n").alias("k"))
    langs = counted.where("kind = 'L'").groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("k").alias("ends"))
    langs = langs.join(words.groupBy("lang").agg(F.sum("k").alias("all_k")), "lang")
    langs = langs.withColumn("seen", F.greatest(F.least(F.col("all_k") / F.greatest("ends", F.lit(1)), F.lit(0.9)), F.lit(0.02)))
    words = words.join(F.broadcast(langs), "lang")  # one row a language
    rate = F.col("k") / F.col("n")
    starter = (_llr(F.col("k"), F.col("n"), F.col("all_k") / F.col("all_n")) >= LLR_STARTER) & (rate >= 0.3 * F.col("seen")) & (rate > F.col("all_k") / F.col("all_n")) & (F.col("k") >= 2)
    never = (_llr(F.col("k"), F.col("n"), F.col("seen")) >= LLR_NEVER_STARTS) & (rate < 0.06 * F.col("seen"))
    status = F.when(starter, "S").when(never, "N").otherwise("U")
    words = words.withColumn("status", status)
    pairs = counted.where("kind = 'P'").select("lang", "word", "next", "n")
    known = words.where("status <> 'U'").where(F.col("n") >= MIN_SHARE * F.col("all_n"))
    statuses = known.select("lang", F.lit("status").alias("kind"), "word", F.col("status").alias("value"))
    nexts = words.select("lang", F.col("word").alias("next"), F.col("n").alias("next_n"), "status")
    pairs = pairs.join(nexts, ["lang", "next"], "left")
    low = F.col("next").rlike(r"^\p{Ll}")
    pairs = pairs.withColumn("status", F.when(low, "N").otherwise(F.coalesce("status", F.lit("U"))))
    by_word = pairs.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("status") == "S", F.col("n")).otherwise(0)).alias("s"))
    per_lang = by_word.groupBy("lang").agg((F.sum("s") / F.sum("n")).alias("g"), F.sum("n").alias("all_p"))
    by_word = by_word.join(F.broadcast(per_lang), "lang")
    share = F.col("s") / F.col("n")
    rare = ((F.col("n") >= 8) | (F.col("n") >= 3) & (F.length("word") <= 4)) & (share < 0.25) & (share < F.col("g")) & (_llr(F.col("s"), F.col("n"), F.col("g")) >= LLR_ABBREVIATION)
    kind = F.when(rare & (share < 0.1) & (F.col("n") >= 8), "A").when(rare, "a").when((F.col("n") >= 5) & (share >= 0.4), "E")
    before = by_word.withColumn("value", kind).where(F.col("value").isNotNull() & (F.col("n") >= MIN_SHARE * F.col("all_p"))).select("lang", F.lit("before").alias("kind"), "word", "value")
    bound = pairs.where((F.col("word") == NUMBER) & (F.col("n") >= 2) & (F.col("n") >= 0.6 * F.col("next_n")))
    bound = bound.join(F.broadcast(per_lang), "lang").where(F.col("n") >= MIN_SHARE * F.col("all_p")).select("lang", F.lit("bound").alias("kind"), F.col("next").alias("word"), F.lit("").alias("value"))
    return statuses.unionByName(before).unionByName(bound)


def learn(df: DataFrame, text: str = "text", only: tuple[str, ...] = ()) -> Model:
    """The model, gathered on the driver (its size is bounded by MIN_SHARE)."""
    model = Model()
    for row in model_rows(df, text, only).collect():
        if row.kind == "status":
            model.status[row.lang, row.word] = row.value
        elif row.kind == "before":
            model.before[row.lang, row.word] = row.value
        else:
            model.bound.add((row.lang, row.word))
    return model


# ---------------------------------------------------------------- classifying


class Splitter:
    """Applies a model to texts."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def units(self, text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
        """Start and end of each unit in code points, in text order, blanks at the ends removed.

        ``lang`` is the text's language where it is known already.

        Null, empty and blank texts have none. Lines never share a unit.
        """
        if not text:
            return []
        lang = lang or language(text)
        clean, kept = _clean(text)
        thai_prose = lang == "th" and _thai_prose(clean)
        out, at = [], 0
        for brk in [*LINE_BREAK.finditer(clean), None]:
            end = brk.start() if brk else len(clean)
            if end > at and not clean[at:end].isspace():
                out += self._line(clean, at, end, lang, thai_prose)
            at = brk.end() if brk else end
        if kept is not None:
            out = [(kept[a], kept[b - 1] + 1) for a, b in out]
        return out

    def _status(self, lang: str, token: str, caps: bool) -> str:
        word = _bare(token)
        got = self.model.status.get((lang, word))
        if got or not word.isupper() or len(word) < 2:
            return got or "U"
        got = self.model.status.get((lang, word.capitalize()))
        return got if got == "S" else self.model.status.get((lang, word.lower()), "U")

    def _line(self, s: str, at: int, end: int, lang: str, thai_prose: bool) -> list[tuple[int, int]]:
        while at < end and s[at].isspace():
            at += 1
        while end > at and s[end - 1].isspace():
            end -= 1
        if _whole_line(s, at, end):
            return [(at, end)]
        cuts = self._cuts(s, at, end, lang)
        if thai_prose and not _ITEM.match(s, at, end):
            cuts = sorted(set(cuts) | set(_thai_cuts(s, at, end)))
        out, first = [], at
        for cut in [*cuts, end]:
            a, b = first, cut
            while a < b and s[a].isspace():
                a += 1
            while b > a and s[b - 1].isspace():
                b -= 1
            if b > a:
                out.append((a, b))
            first = cut
        return out

    def _cuts(self, s: str, at: int, end: int, lang: str) -> list[int]:
        cuts: list[int] = []
        first = at  # start of the running unit
        stack: list[tuple[str, bool]] = []  # closer awaited, whether it was opened at the unit's start
        inner = 0  # ends of sentences inside a quotation
        caps = False
        pos = at
        while True:
            m = _EVENT.search(s, pos, end)
            if m is None:
                return cuts
            ch, pos = m.group(), m.end()
            if ch in PLAIN_QUOTES:
                left, right = s[m.start() - 1 : m.start()] if m.start() > at else " ", s[pos : pos + 1] if pos < end else " "
                if left.isalnum() and right.isalnum() and not (_east(left) or _east(right)):
                    continue  # an abbreviation such as the Hebrew ones
                waiting = any(c in _DOUBLE for c, _ in stack)
                opening = (left.isspace() or left in OPEN or left in PLAIN_QUOTES and m.start() - 1 <= at or not waiting and _east(left)) and not right.isspace()
                if waiting and left in PLAIN_QUOTES and right not in PLAIN_QUOTES and m.start() - 1 == first:
                    opening = True
                if opening:
                    stack.append((ch, s[first : m.start()].strip(_OPENERS + " ") == ""))
                elif waiting:
                    while stack.pop()[0] not in _DOUBLE:
                        pass
                continue
            if ch in CLOSE and any(c == ch for c, _ in stack):
                while stack.pop()[0] != ch:
                    pass
                continue
            if ch in _DOUBLE and any(c in _DOUBLE for c, _ in stack) and (pos >= end or not s[pos].isalnum()):
                while stack.pop()[0] not in _DOUBLE:
                    pass
                continue
            if ch in OPEN:
                if len(stack) < 12:
                    stack.append((OPEN[ch], s[first : m.start()].strip(_OPENERS + " ") == ""))
                continue
            if ch in CLOSE:
                continue
            # A run of end marks, with the closers and pictographs that follow it directly.
            e, closed = pos, []
            while e < end:
                c = s[e]
                if stack and (c == stack[-1][0] or c in _DOUBLE and stack[-1][0] in _DOUBLE and (e + 1 >= end or not s[e + 1].isalnum())):
                    closed.append((c, *stack.pop()[1:]))
                    e += 1
                elif stack and s[e].isspace() and e + 1 < end and s[e + 1] == "»" == stack[-1][0]:
                    closed.append(("»", *stack.pop()[1:]))
                    e += 2
                elif closed and c in ".!?…。！？":
                    ch, closed = c, []
                    e += 1
                elif c in PLAIN_QUOTES and any(x in _DOUBLE for x, _ in stack):
                    while stack[-1][0] not in _DOUBLE:
                        stack.pop()
                else:
                    break
            emoji = _EMOJI.match(s, e, end)
            if emoji:
                e = emoji.end()
            pos = e
            if e >= end:
                return cuts
            spaced = s[e].isspace()
            east = ch[-1] in _FULL or ch[-1] in "!?" and m.start() > at and _east(s[m.start() - 1])
            if not (spaced or east or emoji):
                continue
            if stack:
                inner += len(stack) == 1 and self._is_end(s, at, end, first, m.start(), ch, closed, e, lang, 0, east)
                continue
            if self._is_end(s, at, end, first, m.start(), ch, closed, e, lang, inner, east):
                cuts.append(e)
                first = e
                while first < end and s[first].isspace():
                    first += 1
            inner = 0

    def _is_end(self, s, at, end, first, mark, ch, closed, e, lang, inner, east) -> bool:
        at_next = _BLANKS.match(s, e, end).end()
        # Unspaced scripts have no words to look up: the beginning is enough there.
        nxt = _NEXT.match(s, at_next, min(end, at_next + 80) if lang in UNSPACED else end).group()
        bare = nxt.lstrip(_OPENERS)
        lead = bare[:1]
        lower = lead.islower()
        status = "N" if lower else self._status(lang, nxt, False)
        if closed:
            bracket = closed[-1][0] in ")]}）】"
            if not closed[-1][1]:  # opened inside the sentence
                return not bracket and lead.isupper() and status == "S" and not nxt.isupper()
            if lower or nxt[0] in "—–" or status == "N" and nxt[0] not in OPEN and nxt[0] not in PLAIN_QUOTES:
                return False
            if bracket:
                return True
            if inner:  # several sentences in the quotation: who said them follows, unless case tells otherwise
                return status == "S" and lead.isupper()
            return not (east and not s[e].isspace() and closed[-1][0] not in PLAIN_QUOTES)
        if ch[-1] in _FULL or ch[0] in "।॥۔؟":
            return True
        if ch[0] == "…" or len(ch) > 1 and not set(ch) - _PERIODS:
            if len(ch) > 1 and ch[0] == "…" and _east(s[mark - 1 : mark] or " "):
                return False
            return not (s[mark - 1 : mark].isspace() or mark == first or lower or status == "N")
        if ch[-1] in "!?":
            return east or not lower
        # One period.
        if lower:
            return False
        token = s[max(first, mark - 60) : mark].split()
        token = token[-1] if token and not s[mark - 1].isspace() else ""
        if not token.strip(_OPENERS):
            return False
        if mark - len(token) <= first and _MARKER.match(token):
            return False  # the number of a list item
        word = _before(token)
        kind = self.model.before.get((lang, word))
        if word == NUMBER:
            if status == "N" or (lang, _bare(nxt)) in self.model.bound:
                return False
            return kind != "A" or status == "S"
        if kind == "A":
            return False
        if kind == "E":
            return True
        inside = "." in token.strip(_OPENERS).rstrip(_TRAIL) and not token.lower().startswith(("www.", "http"))
        if kind == "a" or kind is None and (len(word) == 1 or inside and len(word) <= 6):
            return status == "S"
        return not (len(word) <= 3 and (status == "N" or lead.isdigit()))


def _east(c: str) -> bool:
    return "々" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "＀" <= c <= "￯" or c in "。、·"


def _whole_line(s: str, at: int, end: int) -> bool:
    """Lines that hold garbled text are one unit."""
    line = s[at:end]
    return len(_GARBLED.findall(line)) * 5 >= len(line)


def _thai_prose(text: str) -> bool:
    """Whether Thai lines are sentences run together rather than items or rows."""
    longest = sorted(max((len(r) for r in _THAI_RUN.findall(line)), default=0) for line in LINE_BREAK.split(text) if line.strip())
    return bool(longest) and longest[len(longest) // 2] >= 18


def _thai_cuts(s: str, at: int, end: int) -> list[int]:
    if _THAI.search(s, at, end) is None or _ROW.search(s, at, end):
        return []
    out, depth = [], 0
    for i in range(at, end):
        c = s[i]
        if c in BRACKETS or c in "“«「":
            depth += s[at:i].strip() != ""
        elif depth and c in ")]}）】”»」":
            depth -= 1
        elif c.isspace() and i + 1 < end and not depth and not s[i - 1].isdigit() and not s[i + 1 :].lstrip()[:1].isdigit():
            out.append(i)
    return out


def sentence_units(df: DataFrame, item: str = "record_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per sentence unit: ``item``, ``unit_no`` from 0, ``char_start``, ``char_end``.

    Offsets count code points of the stored text, half open. Null, empty and blank texts give
    no row; a repeated row gives its units again. Texts are taken whole, of any length. The
    model is learned from ``df`` itself unless one is given.
    """
    splitter = Splitter(learn(df, text) if model is None else model)
    kind = df.schema[item].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, no, first, last = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = splitter.units(t)
                rows += [i] * len(found)
                no += range(len(found))
                first += [a for a, _ in found]
                last += [b for _, b in found]
            ids = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(no, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["item", "unit_no", "char_start", "char_end"])

    out = df.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    done = out.mapInArrow(run, f"item {kind.simpleString()}, unit_no int, char_start int, char_end int")
    return done.withColumnRenamed("item", item)
