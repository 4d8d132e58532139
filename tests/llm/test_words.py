import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import linededup, neardup, quality
from tidemark.llm import words as W


def regular(n, swap=False):
    """The Thue-Morse word over two letters: it and its complement collide under any polynomial modulo 2^64."""
    return "".join("ab"[(bin(i).count("1") & 1) ^ swap] for i in range(n))


PAIRS = [(regular(1 << k), regular(1 << k, True)) for k in (10, 11, 13)]


@pytest.mark.parametrize("one,two", PAIRS)
def test_regular_strings_are_told_apart(one, two):
    data, offsets = W.text_bytes(pa.array([one, two, one]))
    h = W.span_hashes(data, offsets[:-1], offsets[1:])
    assert h[0] == h[2] != h[1]
    entries = {"a": np.uint64(0x0123456789ABCDEF), "b": np.uint64(0xFEDCBA9876543210)}
    values = np.array([entries[c] for c in one + two], np.uint64)
    r = W.range_hashes(values, np.array([0, len(one)]), np.array([len(one), 2 * len(one)]))
    assert r[0] != r[1]


def test_hashes_follow_the_bytes_alone():
    r = np.random.default_rng(1)
    data = r.integers(0, 3, 3000).astype(np.uint8)
    start = r.integers(0, 2900, 4000)
    end = start + r.integers(0, 6, 4000)
    h = W.span_hashes(data, start, end)
    seen = {}
    for s, e, x in zip(start, end, h.tolist()):
        assert seen.setdefault(bytes(data[s:e]), x) == x
    assert len(set(seen.values())) == len(seen)
    values = r.integers(0, 2 ** 63, 500, dtype=np.uint64)[r.integers(0, 500, 3000)]
    many = {}
    for s, e, x in zip(start, end, W.range_hashes(values, start, end).tolist()):
        assert many.setdefault(values[s:e].tobytes(), x) == x
    assert len(set(many.values())) == len(many)


@pytest.mark.parametrize("one,two", PAIRS)
def test_operators_tell_regular_strings_apart(spark, one, two):
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    lines = spark.createDataFrame([(1, f"{one}\n{two}"), (2, f"{one}\n{one}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(lines).collect()} == {1: 0, 2: 1}
    b = quality.Batch(*W.text_bytes(pa.array([f"{one} {two}", f"{one} {one}"])))
    assert quality.n_distinct_words(b).tolist() == [2, 1]
