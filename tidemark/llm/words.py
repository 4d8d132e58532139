"""Words, word hashes and word shingles: as column expressions, and as arrays over the bytes of many texts at once.

The array half takes an Arrow string column and works on its byte buffer, so no Python object is made per word. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- column expressions

def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column, gap: str = GAP) -> Column:
    """The words after lower-casing A-Z; empty for null or no word."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), gap), "")


def with_shingles(df: DataFrame, text: str, k: int, words: str, hashes: str, gap: str = GAP) -> DataFrame:
    """Adds the words of a text column and the hash of each k consecutive words (none for fewer).

    Each step is a column of its own: an expression that is repeated, or stands in a lambda, would be worked out again and again.
    """
    df = df.withColumn(words, word_array(F.col(text), gap)).withColumn("__each", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("__count", F.greatest(F.size("__each") - (k - 1), F.lit(0)))
    df = df.withColumn("__side", F.arrays_zip(*[F.slice("__each", i + 1, F.col("__count")) for i in range(k)]))
    return df.withColumn(hashes, F.transform("__side", lambda s: F.xxhash64(s))).drop("__each", "__count", "__side")


# ---------------------------------------------------------------- arrays

class Words(NamedTuple):
    """Start and end byte of each word, the text it belongs to, and the first word of each text (one entry more than texts)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about ``size`` bytes (a longer text is a run of its own): first, last, bytes, offsets."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not ``outside``; no run crosses the border of a text."""
    n = len(data)
    inside = ~outside[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[(offsets[1:] - 1)[offsets[1:] > offsets[:-1]]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit (the published splitmix64 step)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 20)
        for_all = np.full(size, _MULTIPLIER, np.uint64)
        for_all[0] = 1
        _POWERS = np.cumprod(for_all, dtype=np.uint64)
        for_all[1:] = pow(_MULTIPLIER, -1, 1 << 64)
        _INVERSES = np.cumprod(for_all, dtype=np.uint64)
    return _POWERS, _INVERSES


#: Sums modulo 2^64 give equal values for different strings of 1,024 bytes or more of some regular patterns, whatever the base. Modulo a prime there are no
#: such strings, so hashes are made of two sums modulo this prime, with bases and digits of their own.
PRIME = (1 << 31) - 1
_BASES = (0x2545F491 % PRIME, 0x5DEECE66 % PRIME)
_LANES: list[tuple[np.ndarray, np.ndarray]] = []


def _rest(x: np.ndarray) -> np.ndarray:
    """x below 2^62 modulo PRIME, up to one PRIME too large: enough to be multiplied or summed again."""
    p = np.uint64(PRIME)
    return (x & p) + (x >> np.uint64(31))


def _lanes(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers and inverse powers of both bases, n or more of them."""
    if not _LANES or len(_LANES[0][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in _BASES:
            pair = []
            for x in (base, pow(base, -1, PRIME)):
                powers = np.ones(1, np.uint64)
                while len(powers) < size:  # twice as many each time
                    powers = np.concatenate([powers, powers * np.uint64(pow(x, len(powers), PRIME)) % np.uint64(PRIME)])
                pair.append(powers[:size])
            made.append(tuple(pair))
        _LANES[:] = made
    return _LANES


class Running:
    """Running sums of both lanes (digits below 2^31), from which the hash of any span follows."""

    def __init__(self, digits: tuple[np.ndarray, np.ndarray]):
        n = len(digits[0])
        self.lanes = _lanes(n + 1)
        self.totals = [np.zeros(n + 1, np.uint64) for _ in digits]
        for (powers, _), lane, total in zip(self.lanes, digits, self.totals, strict=True):
            np.cumsum(_rest(lane * powers[:n]), out=total[1:])  # 2^30 entries stay below 2^62

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the entries from start to end: of each lane, the difference of sums, brought to the first power."""
        out, p = (end - start).astype(np.uint64) * np.uint64(_MULTIPLIER), np.uint64(PRIME)
        for (_, inverses), total, shift in zip(self.lanes, self.totals, (0, 32), strict=True):
            out ^= ((total[end] - total[start]) % p * inverses[start] % p) << np.uint64(shift)
        return mix(out)


_DIGITS = tuple(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER) + np.uint64(lane)) % np.uint64(PRIME) for lane in (1, 2))


def running_bytes(data: np.ndarray) -> Running:
    """For hashes of several kinds of spans over the same bytes."""
    return Running((_DIGITS[0][data], _DIGITS[1][data]))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, for many spans."""
    return running_bytes(data).hashes(start, end)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the entries (64-bit hashes) from start to end, for many ranges. The lanes see different halves of an entry."""
    low = values ^ (values >> np.uint64(31))
    return Running((low & np.uint64(PRIME), values >> np.uint64(33))).hashes(start, end)


def run_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive entries within one text, and the index of its first entry."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[k - 1:])
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = out * np.uint64(_MULTIPLIER) + hashes[i:i + m]
    return mix(out[at]), at


def shingles(hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their text; a text with 1 to k-1 words gives its whole sequence as one."""
    h, at = run_hashes(hashes, words.doc, k)
    doc = words.doc[at]
    count = np.diff(words.first)
    for n in range(1, k):
        few = np.flatnonzero(count == n)
        if len(few):
            whole = np.full(len(few), n, np.uint64)
            for i in range(n):
                whole = whole * np.uint64(_MULTIPLIER) + hashes[words.first[few] + i]
            h, doc = np.concatenate([h, mix(~whole)]), np.concatenate([doc, few])
    return h, doc
