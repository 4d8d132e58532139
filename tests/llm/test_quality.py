import re
from collections import Counter

import numpy as np
import pyarrow as pa
from messy import rows, table

from tidemark.llm import quality
from tidemark.llm import words as W


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_figures_of_messy_rows(spark):
    got = quality.judge(table(spark)).collect()
    key = lambda x: (x[0] is not None, x)
    want = sorted(((r[0], *brute(r[1])) for r in rows()), key=key)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=key) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(table(spark, [])).count() == 0


def test_order_of_rules_changes_no_verdict():
    data, offsets = W.text_bytes(pa.array([r[1] for r in rows()]))
    checks = quality.rules(quality.Limits())
    b = quality.Batch(data, offsets)
    kept, seen = quality.cascade(b, checks, list(checks))
    turned, _ = quality.cascade(b, checks, list(reversed(checks)))
    assert (kept == turned).all() and (np.diff(seen) <= 0).all()
    alone = ~np.any([check(quality.Batch(data, offsets)) for check in checks.values()], axis=0)
    assert (kept == alone).all()


def test_rules_are_ordered_by_what_they_still_reject():
    names = ["a", "b", "c", "d"]
    costs = {"a": 2.0, "b": 1.0, "c": 1.0, "d": 0.5}
    assert quality.cascade_order(costs, {0b0001: 30, 0b0010: 10, 0b0000: 99}, names) == ["a", "b", "d", "c"]
    # c rejects most of what b rejects: after b it is worth less than a
    assert quality.cascade_order(costs, {0b0110: 50, 0b0100: 1, 0b0010: 2, 0b0001: 30}, names) == ["b", "a", "c", "d"]


def test_order_comes_from_rows_that_pass_the_bar(spark):
    """Many short texts full of symbols say nothing on what the cascade sees."""
    from messy import prose

    short = [(i, "# $ % &", None) for i in range(300)]
    loud = [(i, prose(80, i).upper(), None) for i in range(300, 340)]
    plain = [(i, prose(80, i), None) for i in range(340, 360)]
    df = spark.createDataFrame(short + loud + plain, "doc_id long, text string, x string").repartition(2)
    limits = quality.Limits()
    costs, sets = quality.measure(df, "text", limits, rows=10 ** 6)
    names = list(quality.after_base(limits))
    assert "too_short" not in names and "repeats" not in names and set(costs) == set(names)
    assert sum(sets.values()) == 60 and sets == {0: 20, 1 << names.index("capitals"): 40}
    assert quality.cascade_order(costs, sets, names)[0] == "capitals"


def test_parts_of_a_batch_take_their_words_along():
    data, offsets = W.text_bytes(pa.array([r[1] for r in rows()]))
    b = quality.Batch(data, offsets)
    b.hashes  # noqa: B018
    some = np.flatnonzero(np.arange(b.n) % 3 == 1)
    part, fresh = b.only(some), quality.Batch(*W.text_bytes(pa.array([rows()[i][1] for i in some])))
    assert all((x == y).all() for x, y in zip(part.words, fresh.words)) and (part.hashes == fresh.hashes).all()
