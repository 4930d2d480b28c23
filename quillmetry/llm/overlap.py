"""Records of one split that stand, exactly or lightly revised, in another (problem 1).

A text is a vector over its words, so two texts that share a part ``t`` of the longer one's
words, in order, have all but ``n - ceil(t n)`` of the ``n`` words of either in common.

* Texts with the same words form one class; one of them stands for it.
* Classes of the first part are parted by length, as evenly in work as in words. A task goes
  through the classes of the second part that are near in length, in blocks of a fixed number of words.
* A block is an index: which of its texts hold a word for the k-th time, as bits, or as a list
  where few do. Texts without words in common (languages) stand in segments of their own.
* A text's words are dealt to one group more than it may lack words, so a partner holds at least
  one group whole (pigeonhole). Words that no text of a segment holds fill groups that can't be held;
  of the others each group gets a rare word, and more frequent ones in layers. The texts that hold a
  group are an AND of rows of bits, those worth a comparison the OR of the groups: a pair costs a
  few bits where a join of lists makes a row of each word in common.
* Sketches of words and of neighbours drop pairs: a word that is left out breaks two pairs of
  neighbours at most, one that is put in one: of texts of ``n`` and ``m`` words with ``c`` in common
  ``3 c - n - m - 1`` neighbours stay.
* The exact dot product, with weights sqrt(count / n), then the longest common subsequence of words, decide.

No step drops a pair that meets the definition.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.llm.looks import one_form
from quillmetry.session import staged

#: Slots of the counters that ``list_entries`` orders words by.
COUNTERS = 1 << 20
#: Words that at least one in so many texts of a block holds (and 32 texts) have a row of bits there; words of a block.
HOT, SALTED = 256, 5_000_000
#: Words of a task's texts of the first part, and how many of these texts are looked up at once.
TASK_WORDS, AT_ONCE = 16_000_000, 4096
#: Texts of a block (17 bits), repetitions of a word that are told apart (15 bits), layers of a group.
BLOCK_TEXTS, REPEATED, LAYERS = 1 << 17, (1 << 15) - 1, 4
#: Segments of a block, and the texts that are looked at to find them.
SEGMENTS, LOOKED_AT = 12, 2000
#: Texts that are compared with one text at once, if so many are left.
MANY = 16
#: Bits of the sketches, and bits a word of those of the neighbours in texts that are too long for them.
SKETCH, WORD_BITS = 4096, 16
#: Rows that may be broadcast (some 50 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_EAST = re.compile("([々-〇぀-ヿ㐀-鿿豈-﫿฀-๿])")
_SPLIT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Characters that are turned into words at once.
CHUNK = 1_000_000
_UNKNOWN, _DROPPED, _BLANK, _END, _MARK, _LETTER, _EAST_MARK, _EAST_LETTER = range(8)


def _kind_of(ch: str) -> int:
    """What a character does: it is dropped, parts words, or belongs to one."""
    if ch == "\0":
        return _END
    if ch.isspace():
        return _BLANK
    letter = ch.isalnum()
    if not letter and unicodedata.category(ch)[0] != "M":
        return _DROPPED
    if _EAST.match(ch):
        return _EAST_LETTER if letter else _EAST_MARK
    return _LETTER if letter else _MARK


class _Plain(dict):
    """Translation that drops all but letters, digits, marks and blanks."""

    def __missing__(self, cp: int):
        got = self[cp] = None if _kind_of(chr(cp)) in (_DROPPED, _END) else chr(cp)
        return got


_PLAIN = _Plain()


def words_of(text: str | None) -> list[str]:
    """The words that count: case, spacing, punctuation and look-alikes folded.

    Words stand between blanks; in Chinese, Japanese and Thai each character is one.
    """
    if not text:
        return []
    text = one_form(text).casefold().translate(_PLAIN)
    if not text.isascii():
        text = _EAST.sub(r" \1 ", text)
    return text.split()


class HashedWords:
    """``words_of`` many texts at once, as hashes of 64 bits: code points are classified and hashed as arrays."""

    def __init__(self) -> None:
        self._kind = np.zeros(0x110000, np.uint8)  # filled as characters are met
        code = (np.arange(1, 0x110001, dtype=np.uint64) * _SPLIT) & np.uint64(0xFFFFFFFFFFFFFFFF)
        self._code = (code ^ (code >> np.uint64(30))) * _MIX

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, the number of words of each text, and the number of those with a letter or digit."""
        parts, chunk, size = [], [], 0
        for t in texts:
            chunk.append(one_form(t) if t else "")
            size += len(chunk[-1])
            if size > CHUNK:
                parts.append(self._hash(chunk))
                chunk, size = [], 0
        if chunk:
            parts.append(self._hash(chunk))
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(map(np.concatenate, zip(*parts)))

    def _hash(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = "\0".join([*forms, ""]).casefold().encode("utf-32-le", "surrogatepass")
        cps = np.frombuffer(joined, "<u4")
        kind = self._kind[cps]
        if not kind.all():
            for cp in np.unique(cps[kind == _UNKNOWN]):
                self._kind[cp] = _kind_of(chr(cp))
            kind = self._kind[cps]
        kept = kind != _DROPPED
        cps, kind = cps[kept], kind[kept]
        east, solid = kind >= _EAST_MARK, kind >= _MARK
        part = solid & ~east
        begins = part.copy()
        begins[1:] &= ~part[:-1]
        at = np.flatnonzero(begins | east)
        ends = np.flatnonzero(kind == _END)
        if not len(at):
            return np.empty(0, np.uint64), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        length = np.diff(np.append(at, len(cps)))
        place = np.arange(at[0], len(cps)) - np.repeat(at, length)
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(place.max()), _SPLIT)]))
        code = self._code[cps[at[0] :]] * power[place]
        code[~solid[at[0] :]] = 0
        words = np.add.reduceat(code, at - at[0])
        words = (words ^ (words >> np.uint64(31))) * _MIX
        words ^= words >> np.uint64(29)
        text = np.searchsorted(ends, at)
        letters = np.logical_or.reduceat((kind[at[0] :] == _LETTER) | (kind[at[0] :] == _EAST_LETTER), at - at[0])
        return words, np.bincount(text, minlength=len(ends)), np.bincount(text, letters, len(ends)).astype(np.int64)


def prefix_length(n: int, threshold: float) -> int:
    """Words that enter the lists: the residual of the others stays below the threshold."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def _in_order(words: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words, the rarest first, equal words in text order; and the number of each among its equals."""
    key = counters[words & (COUNTERS - 1)].astype(np.int64) << 32 | (words.astype(np.int64) & 0xFFFFFFFF)
    order = np.argsort(key, kind="stable")
    key, at = key[order], np.arange(len(words))
    new = np.ones(len(words), bool)
    new[1:] = key[1:] != key[:-1]
    return order, at - np.maximum.accumulate(np.where(new, at, 0))


def list_entries(words: np.ndarray, counters: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the words that enter the lists, the rarest first, equal words in text order."""
    return _in_order(words, counters)[0][: prefix_length(len(words), threshold)]


def vector_sketch(words: np.ndarray, number: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the words, each occurrence of a word (``number``) being one of its own.

    The bits that another text's sketch lacks are no more than the occurrences it lacks. Half the
    bits are the union of the halves.
    """
    out = np.zeros(bits, np.uint8)
    out[_word_bits(words.astype(np.int64).view(np.uint64), number.astype(np.uint64)) & (bits - 1)] = 1
    return np.packbits(out).view(np.uint64)


def _word_bits(words: np.ndarray, number: np.ndarray) -> np.ndarray:
    return ((words * _SPLIT + number) * _MIX >> np.uint64(40)).astype(np.int64)


def neighbours_left(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of neighbours that texts of ``n`` and ``m`` words share at least if they reach the threshold."""
    return 3 * np.ceil(threshold * np.maximum(n, m) - 1e-9).astype(np.int64) - n - m - 1


def common_words(a: list, b: list, least: float = 0.0) -> int:
    """Length of the longest common subsequence (bit-parallel), or less than ``least`` if it can't be reached."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for k, x in enumerate(b):
        match = row & places.get(x, 0)
        row = ((row + match) | (row - match)) & full
        if k % 16 == 15 and len(a) - row.bit_count() + len(b) - k - 1 < least:
            break
    return len(a) - row.bit_count()


def reaching_words(y: np.ndarray, xs: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """For each of ``xs`` whether its longest common subsequence with ``y`` is ``least`` long (``common_words``, all at once)."""
    known, at = np.unique(y, return_inverse=True)
    size = -(-len(y) // 64) * 64
    places = np.zeros((len(known) + 1, size), np.uint8)
    places[at, np.arange(len(y))] = 1
    places = np.packbits(places, axis=1, bitorder="little").view(np.uint64)
    length = np.array([*map(len, xs)])
    flat = np.concatenate(xs)
    found = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    words = np.full((len(xs), length.max()), len(known), np.int32)
    words[np.arange(words.shape[1]) < length[:, None]] = np.where(known[found] == flat, found, len(known))
    row = np.full((len(xs), size // 64), 0xFFFFFFFFFFFFFFFF, np.uint64)
    left = np.arange(len(xs))
    for k in range(words.shape[1]):
        match = row & places[words[:, k]]
        total = row + match
        carry = total < row
        while carry[:, :-1].any():
            total[:, 1:] += carry[:, :-1]
            carry[:, 1:] = carry[:, :-1] & (total[:, 1:] == 0)
            carry[:, 0] = False
        row = total | row & ~match
        if k % 16 == 15 or k == words.shape[1] - 1:
            can = size - np.bitwise_count(row).sum(1, dtype=np.int64) + np.maximum(0, length[left] - k - 1) >= least[left]
            left, row, words = left[can], row[can], words[can]
            if not len(left):
                break
    out = np.zeros(len(xs), bool)
    out[left] = True
    return out


def placed(words: np.ndarray) -> np.ndarray:
    """Words with their places, sorted; to be searched by ``in_reach``."""
    return np.sort((words.astype(np.int64) & 0x7FFFFFFF) << 24 | np.arange(len(words)))


def in_reach(x: np.ndarray, ys: np.ndarray, reach: int) -> int:
    """How many words of x stand in the other text at most ``reach`` places away: a bound of the subsequence."""
    code, at = (x.astype(np.int64) & 0x7FFFFFFF) << 24, np.arange(len(x))
    near = np.searchsorted(ys, code | np.maximum(at - reach, 0))
    return int((ys[np.minimum(near, len(ys) - 1)] <= (code | np.minimum(at + reach, 0xFFFFFF)))[near < len(ys)].sum())


def dot_product(a: np.ndarray, b: np.ndarray) -> float:
    """Exact dot product of the two word vectors."""
    wa, ca = np.unique(a, return_counts=True)
    wb, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(wa, wb, assume_unique=True, return_indices=True)
    return float(np.sqrt(ca[i].astype(float) * cb[j]).sum() / math.sqrt(len(a) * len(b)))


def _tokens(df: DataFrame, item: str, text: str, side: str, least: int) -> DataFrame:
    """item, side, hashed words (32 bits), their number and a digest, for texts of ``least`` words at least."""
    kind = df.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords()
        for batch in batches:
            words, n, letters = hashed(batch.column(2).to_pylist())
            keep = np.flatnonzero(letters >= least)
            stop = np.cumsum(n)
            digests = [xxhash.xxh3_128_digest(words[stop[i] - n[i] : stop[i]].tobytes()) for i in keep]
            short = words.astype(np.int32)[np.repeat(letters >= least, n)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int32)), pa.array(short))
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists, pa.array(n[keep].astype(np.int32)), pa.array(digests, pa.binary())], names=["item", "side", "words", "n", "digest"])

    rows = df.select(F.col(item).alias("item"), F.col(side).alias("side"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item {kind}, side boolean, words array<int>, n int, digest binary")


class _Texts:
    """Texts of one part, sorted by length: their numbered words and sketches."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, n: np.ndarray) -> None:
        self.ids, self.words, self.n = ids, words, n.astype(np.int64)
        self.stop = np.cumsum(self.n)
        self.start = self.stop - self.n
        self.near = _neighbours(self.words, self.n, SKETCH)
        key = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32) | words.view(np.uint32))
        number = np.minimum(_number(key), REPEATED).astype(np.uint64)
        #: Text, and word with its number among its equals, of each word; by text.
        self.text = (key >> np.uint64(32)).astype(np.int32)
        key &= np.uint64(0xFFFFFFFF)
        self.vector = _packed(_word_bits(key, number), self.text, len(n), SKETCH)
        self.small = np.bitwise_or.reduce(self.vector.reshape(len(n), 8, SKETCH // 512), axis=1)
        self.code = key << np.uint64(15) | number

    def __getitem__(self, i: int) -> np.ndarray:
        return self.words[self.start[i] : self.stop[i]]

    def neighbours(self, which: np.ndarray, size: int) -> np.ndarray:
        """Sketches of ``size`` bits of the neighbours in some of the texts."""
        return _neighbours(np.concatenate([self[i] for i in which]), self.n[which], size)


def _number(key: np.ndarray) -> np.ndarray:
    """The number of each sorted key among its equals."""
    at = np.arange(len(key), dtype=np.int32)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _neighbours(words: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sketches of ``size`` bits of the pairs of neighbours, each occurrence of a pair being one of its own."""
    text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    w, inside = words.view(np.uint32).astype(np.uint64), text[1:] == text[:-1]
    code = (w[:-1] * _SPLIT ^ (w[1:] + (w[:-1] * _MIX >> np.uint64(29)))) * _SPLIT >> np.uint64(20)
    key = np.sort((text[1:] << np.uint64(44) | code)[inside])
    return _packed(_word_bits(key & np.uint64((1 << 44) - 1), _number(key).astype(np.uint64)), (key >> np.uint64(44)).astype(np.int32), len(n), size)


def _packed(bits: np.ndarray, text: np.ndarray, texts: int, size: int) -> np.ndarray:
    """A sketch of ``size`` bits a text of the bits that its words have; ``text`` ascends."""
    out = np.empty((texts, size // 64), np.uint64)
    step, bits = max(1, (1 << 21) // size), bits & (size - 1)
    for begin in range(0, texts, step):
        end = min(texts, begin + step)
        i, j = np.searchsorted(text, (begin, end))
        held = np.zeros((end - begin, size), np.uint8)
        held[text[i:j] - begin, bits[i:j]] = 1
        out[begin:end] = np.packbits(held, axis=1).view(np.uint64)
    return out


def _segments(texts: _Texts) -> np.ndarray:
    """A segment for each text, such that texts with few words in common (languages) mostly stand in different ones.

    Found by the most frequent words among some of the texts. Any segments would do; these save work.
    """
    size = len(texts.n)
    first = (texts.code & np.uint64(REPEATED)) == 0
    word, text = texts.code[first] >> np.uint64(15), texts.text[first]
    looked_at = text % max(1, size // LOOKED_AT) == 0
    known, word_of = np.unique(word[looked_at], return_inverse=True)
    of, left = text[looked_at], np.zeros(size, bool)
    left[of] = True
    here, segment = np.full(size, -1), np.full(size, SEGMENTS)
    for new in range(4 * SEGMENTS):
        count = np.bincount(word_of[left[of]], minlength=len(known))
        if not len(count) or count.max() < 8:
            break
        k = int(count.argmax())
        has = of[word_of == k]
        # A word that is frequent in an earlier segment is one of its language.
        earlier = np.bincount(here[has][here[has] >= 0], minlength=SEGMENTS) / np.maximum(1, np.bincount(here[here >= 0], minlength=SEGMENTS))
        own = int(earlier.argmax()) if earlier.max() >= 0.1 else min(int(here.max()) + 1, SEGMENTS - 1)
        here[has[left[has]]] = own
        left[has] = False
        every = text[word == known[k]]
        segment[every[segment[every] == SEGMENTS]] = own
    return segment


class _Block:
    """Texts of the second part as an index: for each numbered word the texts that hold it."""

    def __init__(self, texts: _Texts, hot: int) -> None:
        self.texts = texts
        segment, size = _segments(texts), len(texts.n)
        #: Texts by segment, then length; where the segments begin and the last ends.
        self.order = np.lexsort((texts.n, segment))
        self.bounds = np.flatnonzero(np.diff(segment[self.order], prepend=-1, append=SEGMENTS + 1))
        self.n = texts.n[self.order]
        place = np.empty(size, np.uint64)
        place[self.order] = np.arange(size, dtype=np.uint64)
        key = np.sort(texts.code << np.uint64(17) | place[texts.text])
        code = key >> np.uint64(17)
        self.held_by = (key & np.uint64(BLOCK_TEXTS - 1)).astype(np.int32)
        del key
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.code, self.begin, self.end = code[begin], begin, np.append(begin[1:], len(code))
        del code
        count, words = self.end - self.begin, len(begin)
        often = np.flatnonzero(count >= max(32, size // hot))
        #: Rows of bits; words without one, and the unknown one behind the last, have the last row, which holds all.
        self.row = np.full(words + 1, len(often))
        self.row[often] = np.arange(len(often))
        self.rows = np.empty((len(often) + 1, -(-size // 64)), np.uint64)
        for k, word in enumerate(often):
            held = np.zeros(self.rows.shape[1] * 64, np.uint8)
            held[self.held_by[self.begin[word] : self.end[word]]] = 1
            self.rows[k] = np.packbits(held, bitorder="little").view(np.uint64)
        self.rows[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)
        #: How many texts of a segment hold each word; none the unknown one.
        of, word = np.searchsorted(self.bounds, self.held_by, side="right") - 1, np.repeat(np.arange(words, dtype=np.int32), count)
        del texts.code, texts.text
        self.often = [np.append(np.bincount(word[of == s], minlength=words), 0).astype(np.int32) for s in range(len(self.bounds) - 1)]

    def near(self, texts: _Texts, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a text of ``texts`` and one of the block such that the latter holds a whole group of the former."""
        known, back = np.unique(texts.code, return_inverse=True)
        at = np.minimum(np.searchsorted(self.code, known), len(self.code) - 1)
        words = np.where(self.code[at] == known, at, len(self.code))[back]
        groups = np.array([prefix_length(n, threshold) for n in texts.n.tolist()])
        low, high = np.ceil(threshold * texts.n - 1e-9), np.floor(texts.n / threshold + 1e-9)
        pairs = [np.empty((2, 0), np.int64)]
        for s, often in enumerate(self.often):
            often, begin, end = often[words], self.bounds[s], self.bounds[s + 1]
            absent = np.add.reduceat((often == 0).astype(np.int32), texts.start)
            lo, hi = begin + np.searchsorted(self.n[begin:end], low), begin + np.searchsorted(self.n[begin:end], high, side="right")
            lists: list[tuple[int, np.ndarray, np.ndarray]] = []
            for i in np.flatnonzero((absent < groups) & (lo < hi)).tolist():
                own = slice(texts.start[i], texts.stop[i])
                dealt = words[own][np.argsort(often[own], kind="stable")[absent[i] :]]
                left = int(groups[i]) - int(absent[i])
                layers = min(LAYERS, len(dealt) // left)
                rows = self.row[dealt[: layers * left]].reshape(layers, left)
                listed = rows[0] == len(self.rows) - 1
                if listed.any():
                    lists.append((i, dealt[:left][listed], rows[1:3, listed]))
                    rows = rows[:, ~listed]
                if not rows.shape[1]:
                    continue
                a, b = lo[i] >> 6, (hi[i] + 63) >> 6
                found = np.zeros(b - a, np.uint64)
                for k in range(0, rows.shape[1], 256):
                    some = self.rows[rows[0, k : k + 256], a:b]
                    for layer in rows[1:, k : k + 256]:
                        some &= self.rows[layer, a:b]
                    found |= np.bitwise_or.reduce(some, axis=0)
                if len(which := np.flatnonzero(found)):
                    word, bit = np.nonzero(np.unpackbits(found[which].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    place = (which[word] + a) * 64 + bit
                    place = place[(place >= lo[i]) & (place < hi[i])]
                    pairs.append(np.stack([np.full(len(place), i), place]))
            for k in range(0, len(lists), 512):
                pairs.append(self._listed(lists[k : k + 512], lo, hi))
        x, y = np.concatenate(pairs, axis=1)
        return x, self.order[y]

    def _listed(self, lists: list[tuple[int, np.ndarray, np.ndarray]], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Pairs for the groups whose first word has a list; the words of the next layers are looked up in their rows."""
        word = np.concatenate([x[1] for x in lists])
        text = np.repeat([x[0] for x in lists], [len(x[1]) for x in lists])
        count = self.end[word] - self.begin[word]
        group = np.repeat(np.arange(len(word)), count)
        place = self.held_by[np.arange(len(group)) + np.repeat(self.begin[word] - np.cumsum(count) + count, count)]
        text = text[group]
        keep = (place >= lo[text]) & (place < hi[text])
        full = np.full(2, len(self.rows) - 1)[:, None]
        more = np.concatenate([np.concatenate([x[2], np.broadcast_to(full, (2, len(x[1])))])[:2] for x in lists], axis=1)
        for layer in more:
            group, place, text = group[keep], place[keep], text[keep]
            keep = (self.rows[layer[group], place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return np.stack([text[keep], place[keep]])


def _lacking(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits of x that y lacks."""
    return np.bitwise_count(x & ~y).sum(1, dtype=np.int64)


def _alike(a: _Texts, b: _Texts, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that the sketches leave."""
    for x, y in ((a.small, b.small), (a.vector, b.vector), (a.near, b.near)):
        n, m = a.n[i], b.n[j]
        kept = neighbours_left(n, m, threshold) + 1 if x is a.near else threshold * np.maximum(n, m) - 1e-9
        p, q = x[i], y[j]
        fits = (_lacking(p, q) <= n - kept) & (_lacking(q, p) <= m - kept)
        i, j = i[fits], j[fits]
    # The longer the texts, the larger the sketches of neighbours that tell them apart.
    size = 1 << np.ceil(np.log2(WORD_BITS * np.maximum(a.n[i], b.n[j]))).astype(np.int64)
    out = [np.stack([i, j])[:, size <= SKETCH]]
    for bits in np.unique(size[size > SKETCH]).tolist():
        step = max(1, (1 << 28) // bits)
        p, q = i[size == bits], j[size == bits]
        for k in range(0, len(p), step):
            (some_a, at_a), (some_b, at_b) = (np.unique(z[k : k + step], return_inverse=True) for z in (p, q))
            x, y = a.neighbours(some_a, bits)[at_a], b.neighbours(some_b, bits)[at_b]
            n, m = a.n[p[k : k + step]], b.n[q[k : k + step]]
            kept = neighbours_left(n, m, threshold) + 1
            fits = (_lacking(x, y) <= n - kept) & (_lacking(y, x) <= m - kept)
            out.append(np.stack([p[k : k + step], q[k : k + step]])[:, fits])
    i, j = np.concatenate(out, axis=1)
    return i, j


def _reaches(x: np.ndarray, y: np.ndarray, ys: np.ndarray, threshold: float) -> bool:
    """Whether the longest common subsequence reaches the threshold; ``ys``: ``placed(y)``."""
    least = threshold * max(len(x), len(y)) - 1e-9
    # Words of the subsequence are shifted by the words left out before them at most.
    if in_reach(x, ys, int(max(len(x), len(y)) - least)) < least:
        return False
    return dot_product(x, y) >= threshold - 1e-9 and common_words(x.tolist(), y.tolist(), least) >= least


def _held(rows: DataFrame) -> DataFrame:
    """``rows`` for a broadcast if they are of a checked size, else as they are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _reaching(a: _Texts, block: _Block, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of classes that reach the threshold, each once."""
    x, y = block.near(a, threshold)
    found: set[tuple[int, int]] = set()
    for k in range(0, len(x), 100_000):
        found.update(zip(*(z.tolist() for z in _alike(a, block.texts, x[k : k + 100_000], y[k : k + 100_000], threshold))))
    partners: dict[int, list[int]] = {}
    for i, j in sorted(found):
        if a.ids[i] != block.texts.ids[j]:
            partners.setdefault(j, []).append(i)
    for j, all_i in partners.items():
        y = block.texts[j]
        if len(all_i) < MANY:
            ys = placed(y)
            reached = [i for i in all_i if _reaches(a[i], y, ys, threshold)]
        else:
            reached = []
            for k in range(0, len(all_i), 2048):
                some = np.array(all_i[k : k + 2048])
                reached += some[reaching_words(y, [a[i] for i in some], threshold * np.maximum(a.n[some], len(y)) - 1e-9)].tolist()
        yield from ((a.ids[i], block.texts.ids[j]) for i in reached)


def _taken(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, words and numbers of words of batches of ``cls``, ``n``, ``words``, sorted by length."""
    ids, n = (np.concatenate([x.column(k).to_numpy() for x in batches]) for k in (0, 1))
    words = np.concatenate([x.column(2).flatten().to_numpy() for x in batches])
    if (n[1:] >= n[:-1]).all():
        return ids, words, n
    order = np.argsort(n, kind="stable")
    start, n = (np.cumsum(n, dtype=np.int64) - n)[order], n[order].astype(np.int64)
    return ids[order], words[np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)], n


def _blocks(files: list[tuple[str, int, int]], low: int, high: int, hot: int, most: int) -> Iterator[_Block]:
    """The texts of ``files`` (path, shortest, longest) of ``low`` to ``high`` words, block by block."""
    held, words, texts = [], 0, 0
    for path, shortest, longest in files:
        if longest < low or shortest > high:
            continue
        place, name = pa.fs.FileSystem.from_uri(path)
        with place.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(4096, columns=["cls", "n", "words"]):
                n = batch.column("n").to_numpy()
                batch = batch.filter(pa.array((n >= low) & (n <= high))).select(["cls", "n", "words"])
                held.append(batch)
                words, texts = words + len(batch.column(2).flatten()), texts + len(batch)
                if texts and (words >= most or texts > BLOCK_TEXTS - 8192):
                    yield _Block(_Texts(*_taken(held)), hot)
                    held, words, texts = [], 0, 0
    if texts:
        yield _Block(_Texts(*_taken(held)), hot)


#: Lengths are counted and parted in steps of this ratio.
STEP = math.log(1.02)


def _tasks(counts: list[tuple[int, int, int, int]], threshold: float, cores: int) -> tuple[dict[int, tuple[int, int]], int]:
    """For each step of length the first task and the number of tasks that have its texts, and the number of all tasks.

    ``counts``: step, texts of the first part, their words, texts of the second part.
    """
    reach = math.ceil(-math.log(threshold) / STEP) + 1 if threshold > 0 else 1 << 30
    near = {k: sum(c[3] for c in counts if abs(c[0] - k) <= reach) for k, *_ in counts}
    # A text costs as much as some 40,000 others that its words are held against, or as 500 words that are read.
    work = {k: (first * 40_000 + words * (80 + near[k] // 180), words) for k, first, words, _ in counts if first}
    share = max(1, math.ceil(sum(w for w, _ in work.values()) / (2 * cores)))
    # Long texts, if they are of few different words, cost more than that; tasks have no more words than they would evenly.
    most = max(1, min(TASK_WORDS, math.ceil(1.2 * sum(w for _, w in work.values()) / (2 * cores))))
    out, task, filled, held = {}, 0, 0, 0
    for k, (cost, words) in sorted(work.items()):
        need = max(math.ceil(cost / share), math.ceil(words / most))
        if filled and (filled + cost > share or held + words > most):
            task, filled, held = task + 1, 0, 0
        out[k] = (task, need)
        if need > 1:
            task, filled, held = task + need, 0, 0
        else:
            filled, held = filled + cost, held + words
    return out, task + 1


def pairs_of_classes(docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes, a in the first part and b in the second, that reach the threshold, each once.

    The texts of the second part are written by length to the shared folder; each task reads those near its own in length.
    """
    spark = docs.sparkSession
    hot, most = HOT, SALTED
    step = F.floor(F.log("n") / STEP).cast("int")
    of = lambda part, x: F.coalesce(F.sum(F.when(F.col(part), x)), F.lit(0))
    counts = [tuple(r) for r in docs.groupBy(step.alias("k")).agg(of("first", F.lit(1)), of("first", F.col("n")), of("second", F.lit(1))).collect()]  # a row a step
    tasks, number = _tasks(counts, threshold, spark.sparkContext.defaultParallelism)
    if not tasks or not any(c[3] for c in counts):
        return docs.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    listed = docs.where("second").select("cls", "n", "words")
    listed = staged(listed.repartitionByRange(number, "n").sortWithinPartitions("n"), "overlap-second")
    files = sorted(tuple(r) for r in listed.groupBy(F.input_file_name().alias("path")).agg(F.min("n"), F.max("n")).collect())  # a row a task
    at = lambda k: F.element_at(F.create_map(*(F.lit(x) for step, v in tasks.items() for x in (step, v[k]))), step)
    parted = docs.where("first").select("cls", "n", "words").repartitionById(number, at(0) + F.pmod(F.hash("cls"), at(1))).sortWithinPartitions("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (own := list(batches)):
            return
        ids, words, n = _taken(own)
        del own
        stop = np.cumsum(n, dtype=np.int64)
        for block in _blocks(files, math.ceil(threshold * int(n[0]) - 1e-9), math.floor(int(n[-1]) / threshold + 1e-9), hot, most):
            for begin in range(0, len(n), AT_ONCE):
                end = min(len(n), begin + AT_ONCE)
                some = _Texts(ids[begin:end], words[stop[begin] - n[begin] : stop[end - 1]], n[begin:end])
                pairs = list(_reaching(some, block, threshold))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return parted.mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, docs: DataFrame, df: DataFrame, item: str, text: str, threshold: float) -> DataFrame:
    """The pairs (staged) whose texts, read again and with words in 64 bits, reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = staged(docs.select("cls", "item", "digest").join(_held(ids), "cls"), "overlap-alike-items")
    rows = df.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).join(_held(wanted), "item").select("cls", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords()
        for batch in batches:
            words, n, _ = hashed(batch.column(2).to_pylist())
            stop = np.cumsum(n)
            own = [words[b - k : b] for b, k in zip(stop, n)]
            # An item may stand in several rows; the one of this class is meant.
            same = [i for i, (w, d) in enumerate(zip(own, batch.column(1).to_pylist())) if xxhash.xxh3_128_digest(w.tobytes()) == d]
            lists = pa.array([own[i].view(np.int64) for i in same], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same, pa.int32())), lists], names=["cls", "words"])

    whole = rows.mapInArrow(run, "cls bigint, words array<bigint>").groupBy("cls").agg(F.first("words").alias("words"))
    whole = staged(whole, "overlap-alike-words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                if _reaches(x, y, placed(y), threshold):
                    keep.append(i)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    left = whole.select(F.col("cls").alias("a"), F.col("words").alias("words_a"))
    right = whole.select(F.col("cls").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b").mapInArrow(compare, "a bigint, b bigint")


def linked_classes(df: DataFrame, item: str, text: str, in_first: str, threshold: float = 0.8, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Members (``item``, ``side``, ``cls``) of the classes of texts with the same words, and links (``a``, ``b``) of classes.

    ``a`` holds items of the first part and ``b`` of the second; a class that holds both is linked with itself.
    """
    usable = df.where(F.col(in_first).isNotNull() & F.col(item).isNotNull())
    tokens = staged(_tokens(usable, item, text, in_first, least), "overlap-words")
    docs = tokens.groupBy("digest").agg(F.first("item").alias("item"), F.max("side").alias("first"), (~F.min("side")).alias("second"), F.first("n").alias("n"), F.first("words").alias("words"))
    docs = staged(docs.withColumn("cls", F.monotonically_increasing_id()), "overlap-classes")
    # Words of 32 bits first: two words in one can only make a pair look more alike.
    alike = staged(pairs_of_classes(docs, threshold), "overlap-alike")
    links = _confirmed(alike, docs, usable, item, text, threshold)
    same = docs.where("first and second").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    members = tokens.select("item", "side", "digest").join(docs.select("digest", "cls"), "digest").select("item", "side", "cls").distinct()
    return members, links.unionByName(same)


def overlapping_pairs(df: DataFrame, item: str, text: str, in_first: str, threshold: float = 0.8, least: int = 10) -> DataFrame:
    """Pairs of an item of the first part and one of the second with (nearly) the same text.

    ``in_first`` names a boolean column: true for the first part, false for the second, rows
    with null take no part. A pair counts if the longest common subsequence of words is at
    least ``threshold`` of the longer text; texts of fewer than ``least`` words holding a
    letter or digit, null and empty texts are in no pair. Returns ``lo`` and ``hi``, each pair
    once, whole: nothing is capped or sampled, no bound used on the way drops a pair that counts,
    and texts are compared over their full length.
    """
    members, links = linked_classes(df, item, text, in_first, threshold, least)
    first = members.where("side").select(F.col("cls").alias("a"), F.col("item").alias("item_a"))
    second = members.where("not side").select(F.col("cls").alias("b"), F.col("item").alias("item_b"))
    pairs = links.join(first, "a").join(second, "b").where(F.col("item_a") != F.col("item_b"))
    return pairs.select(F.least("item_a", "item_b").alias("lo"), F.greatest("item_a", "item_b").alias("hi")).distinct()


def overlap_report(df: DataFrame, members: DataFrame, links: DataFrame, item: str, split: str, source: str) -> DataFrame:
    """Per split and source: records, those with a partner in the other part, and the pairs they are in.

    Counted from the sizes of the linked classes (``linked_classes``); copies are not expanded into
    pairs. Each item is meant to stand in one row; one with several texts counts its partners per text.
    """
    sizes = members.groupBy("cls").agg(F.count_if("side").alias("in_first"), F.count_if(~F.col("side")).alias("in_second"))
    of = lambda key, other, size, side: links.join(sizes.withColumnRenamed("cls", other), other).groupBy(F.col(key).alias("cls")).agg(F.sum(size).alias("n")).withColumn("side", F.lit(side))
    per_class = of("a", "b", "in_second", True).unionByName(of("b", "a", "in_first", False))
    per_item = members.join(per_class, ["cls", "side"]).groupBy(F.col("item").alias("__item")).agg(F.sum("n").alias("links"))
    rows = df.select(F.col(item).alias("__item"), F.col(split).alias("split"), F.col(source).alias("source")).join(per_item, "__item", "left")
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
