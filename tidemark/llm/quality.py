"""Quality rules as a short-circuit cascade.

Each rule rejects documents by one figure of the whole text. What a rule costs and what it rejects after other rules is measured on a sample of the documents that the rules will see, and
they run in the order of rejections per second; a document that one rule has rejected is not looked at by the next. The verdict is that of all rules together, so
the order changes the cost only, never a result.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

SYMBOLS = W.byte_set()
SYMBOLS[list(b"#*$%&|<>")] = True
CAPITALS = W.byte_set((65, 90))
LETTERS = W.byte_set((65, 90), (97, 122))
LEAD = ~W.byte_set((0x80, 0xBF))
SAMPLE_ROWS = 2000


class Batch:
    """Some whole texts as bytes; words and their hashes are found when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._words = self._hashes = None

    def only(self, rows: np.ndarray) -> Batch:
        if len(rows) == self.n:
            return self
        size = self.offsets[rows + 1] - self.offsets[rows]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(offsets[-1]) + np.repeat(self.offsets[rows] - offsets[:-1], size)
        out = Batch(self.data[at], offsets)
        if self._words is not None:  # what has been found goes along
            place = np.full(self.n, -1)
            place[rows] = np.arange(len(rows))
            doc = place[self._words.doc]
            held = doc >= 0
            doc = doc[held]
            moved = offsets[doc] - self.offsets[rows[doc]]
            out._words = W.Words(self._words.start[held] + moved, self._words.end[held] + moved, doc, np.searchsorted(doc, np.arange(len(rows) + 1)))
            out._hashes = None if self._hashes is None else self._hashes[held]
        return out

    @property
    def words(self) -> W.Words:
        if self._words is None:
            self._words = W.find_words(self.data, self.offsets)
        return self._words

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = W.span_hashes(self.data, self.words.start, self.words.end)
        return self._hashes

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """Bytes of each text that a mask holds for."""
        total = np.concatenate([[0], np.cumsum(wanted)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)


def _repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in order: which value stands elsewhere in the same text too; which has stood there before."""
    key = W.mix(value + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    again[order[1:][same]] = True
    return twice, again


def word_chars(b: Batch) -> np.ndarray:
    return b.count(LEAD[b.data] & ~W.SPACE[b.data])


def n_symbols(b: Batch) -> np.ndarray:
    return b.count(SYMBOLS[b.data])


def n_repeat_words(b: Batch) -> np.ndarray:
    run, at = W.run_hashes(b.hashes, b.words.doc, 3)
    twice, _ = _repeated(b.words.doc[at], run)
    covered = np.zeros(len(b.words.start), bool)
    for i in range(3):
        covered[at[twice] + i] = True
    return np.bincount(b.words.doc[covered], minlength=b.n)


def _lines(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each line that has a word."""
    breaks = np.flatnonzero(b.data == 10)
    start = np.sort(np.concatenate([b.offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([b.offsets[1:], breaks]), kind="stable")
    doc = np.concatenate([np.arange(b.n), np.searchsorted(b.offsets, breaks, "right") - 1])
    doc = np.sort(doc, kind="stable")
    filled = np.searchsorted(b.words.start, end) > np.searchsorted(b.words.start, start)
    return start[filled], end[filled], doc[filled]


def n_dup_lines(b: Batch) -> np.ndarray:
    start, end, doc = _lines(b)
    _, again = _repeated(doc, W.span_hashes(b.data, start, end))
    return np.bincount(doc[again], minlength=b.n)


def n_lines(b: Batch) -> np.ndarray:
    return np.bincount(_lines(b)[2], minlength=b.n)


def n_distinct_words(b: Batch) -> np.ndarray:
    _, again = _repeated(b.words.doc, b.hashes)
    return b.n_words() - np.bincount(b.words.doc[again], minlength=b.n)


@dataclass(frozen=True)
class Limits:
    """Bounds of the rules; a document on a bound stays."""

    least_words: int = 50
    repeat_share: float = 0.5
    symbols_per_word: float = 0.3
    word_length: tuple[float, float] = (2.0, 20.0)
    dup_line_share: float = 0.5
    capital_share: float = 0.6
    distinct_share: float = 0.05


def rules(limits: Limits) -> dict:
    """Name -> function of a batch that says which texts are rejected."""
    low, high = limits.word_length
    return {
        "too_short": lambda b: b.n_words() < limits.least_words,
        "repeats": lambda b: n_repeat_words(b) > limits.repeat_share * b.n_words(),
        "symbols": lambda b: n_symbols(b) > limits.symbols_per_word * b.n_words(),
        "word_length": lambda b: (word_chars(b) < low * b.n_words()) | (word_chars(b) > high * b.n_words()),
        "dup_lines": lambda b: n_dup_lines(b) > limits.dup_line_share * n_lines(b),
        "capitals": lambda b: b.count(CAPITALS[b.data]) > limits.capital_share * b.count(LETTERS[b.data]),
        "few_distinct": lambda b: n_distinct_words(b) < limits.distinct_share * b.n_words(),
    }


def cascade(b: Batch, checks: dict, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Kept or not, and for each rule in the order the number of texts that it still looked at."""
    left, seen = np.arange(b.n), []
    for name in order:
        seen.append(len(left))
        if len(left):
            part = b.only(left)
            left = left[~checks[name](part)]
    kept = np.zeros(b.n, bool)
    kept[left] = True
    return kept, np.array(seen)


def base_failed(n: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Fixed lower bar, before all rules."""
    return (n < 50) | (100 * repeat > 50 * n)


def after_base(limits: Limits) -> dict:
    """The rules that can still reject a text which has passed the bar."""
    dead = {"too_short"} if limits.least_words <= 50 else set()
    dead |= {"repeats"} if limits.repeat_share >= 0.5 else set()
    return {name: check for name, check in rules(limits).items() if name not in dead}


def measure(df: DataFrame, text: str, limits: Limits, rows: int = SAMPLE_ROWS, seed: int = 10) -> tuple[dict[str, float], dict[int, int]]:
    """From a sample of about ``rows`` texts, those that pass the bar: seconds of each rule, and the number of texts by the set of rules that reject them (bit i: rule i).

    That is what the cascade sees: words and hashes are there already, and the sets say how much a rule still rejects after others. Tasks measure; the driver gets one
    row per rule and one per set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checks = after_base(limits)
        for batch in batches:
            for _, _, data, offsets in W.pieces(*W.text_bytes(batch.column(0))):
                whole = Batch(data, offsets)
                b = whole.only(np.flatnonzero(~base_failed(whole.n_words(), n_repeat_words(whole))))
                sets, out = np.zeros(b.n, np.int64), []
                for i, (name, check) in enumerate(checks.items()):
                    began = time.perf_counter()
                    sets |= check(b).astype(np.int64) << i
                    out.append((name, -1, time.perf_counter() - began, b.n))
                out += [(None, int(s), 0.0, int(n)) for s, n in zip(*np.unique(sets, return_counts=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["rule", "rejecting", "s", "n"])

    share = min(1.0, rows / max(1, df.count()))
    found = df.select(text).sample(fraction=share, seed=seed).mapInArrow(run, "rule string, rejecting long, s double, n long")
    found = found.groupBy("rule", "rejecting").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return {r["rule"]: r["s"] for r in found if r["rule"] is not None}, {r["rejecting"]: r["n"] for r in found if r["rule"] is None}


def cascade_order(costs: dict[str, float], sets: dict[int, int], names: list[str]) -> list[str]:
    """Rules by rejections per second, each counted on the texts that the rules before it let through; rules that are left without any come last, the cheapest first."""
    left, out, seen = list(range(len(names))), [], 0
    while left:
        def worth(i: int) -> tuple[float, float]:
            cost = max(costs.get(names[i], 0.0), 1e-12)
            return sum(n for s, n in sets.items() if s >> i & 1 and not s & seen) / cost, -cost

        best = max(left, key=worth)
        left.remove(best)
        out.append(names[best])
        seen |= 1 << best
    return out


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: the key, the figures of the whole text, ``base_failed`` and ``kept``.

    A null text is an empty one: no words, base failed. Rows are judged one by one, so ties and repeated rows get equal results; no shuffle.
    The sample (``sample_rows`` texts or so) settles the order of the rules only.
    """
    limits = limits or Limits()
    order = cascade_order(*measure(df, text, limits, sample_rows), list(after_base(limits)))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checks = after_base(limits)
        for batch in batches:
            for lo, hi, data, offsets in W.pieces(*W.text_bytes(batch.column(1))):
                b = Batch(data, offsets)
                n, repeat = b.n_words(), n_repeat_words(b)
                failed = base_failed(n, repeat)
                figures = [n, word_chars(b), n_symbols(b), n_dup_lines(b), repeat]
                kept = np.zeros(b.n, bool)
                passed = np.flatnonzero(~failed)
                kept[passed] = cascade(b.only(passed), checks, order)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(x.astype(np.int64)) for x in figures], pa.array(failed), pa.array(kept)],
                                                 names=[key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
