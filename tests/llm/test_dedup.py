import difflib
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from messy import SCHEMA, prose, rows, table

from tidemark.llm import linededup, neardup, substrings
from tidemark.llm import words as W

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(data, percent=75):
    """Smallest id reachable, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in data if i is not None]
    comp = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and comp[i] != comp[j] and 100 * len(a & b) >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def with_texts(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def chain(n, seed):
    """Copies of copies: far ends are not alike, so that only steps in between link them; smallest ids are scattered."""
    r, words, out = random.Random(seed), prose(150, seed).split(), []
    for i in range(n):
        for _ in range(3):
            words[r.randrange(150)] = f"w{seed}x{i}x{r.random():.5f}"
        out.append(" ".join(words))
    r.shuffle(out)
    return out


def check_groups(spark, df, data):
    got = neardup.near_duplicates(df).collect()
    want = groups(data)
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = sorted((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None)
    assert sizes == sorted((i, len(shingles(t))) for i, t in data if i is not None)


def test_near_duplicates_of_messy_rows(spark):
    check_groups(spark, table(spark), [(r[0], r[1]) for r in rows()])
    assert neardup.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [neardup.BLOCK, 500])
def test_near_duplicates_along_chains(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = chain(20, 1) + chain(15, 2) + [prose(100, s) for s in range(5)] + chain(10, 3)
    check_groups(spark, with_texts(spark, texts), list(enumerate(texts)))


def test_keep_one(spark):
    df = table(spark)
    kept = neardup.keep_one(df).collect()
    want = groups([(r[0], r[1]) for r in rows()])
    assert kept[0].asDict().keys() == set(df.columns)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i, c in want.items() if i == c)
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_repeated_keys_lose_no_text(spark):
    a, b, c, d = (prose(80, 300 + i) for i in range(4))
    near = a + " end"
    data = [(1, a), (3, near), (2, b), (3, b), (3, c), (4, c + " end"), (5, d), (5, a), (5, None), (6, d), (5, d)]
    df = spark.createDataFrame([(i, t, None, f"s{n}", None, None, None, None, None, None) for n, (i, t) in enumerate(data)], SCHEMA).repartition(4)
    check_groups(spark, df, data)
    kept = neardup.keep_one(df).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["source"]) for r in kept) == sorted([(1, a, "s0"), (2, b, "s2"), (3, c, "s4"), (5, d, "s10"), (5, "", "s8")])


@pytest.mark.parametrize("block", [neardup.BLOCK, 500])
def test_near_duplicates_along_chains_under_repeated_keys(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = chain(20, 1) + [prose(100, s) for s in range(5)] + chain(10, 3)
    data = [(i // 2 if i < 8 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in data], SCHEMA)
    check_groups(spark, df, data)
    assert len({r["text"] for r in neardup.keep_one(df).collect()}) == 7


def test_links_within_a_group_join_all_that_are_alike():
    r = random.Random(8)
    for _ in range(40):
        base = [r.randrange(1 << 40) for _ in range(30)]
        sets = [sorted({*r.sample(base, r.randint(18, 30)), *(r.randrange(1 << 40) for _ in range(r.randint(0, 8)))}) for _ in range(12)]
        side = np.array([r.randrange(2) for _ in sets]) if r.random() < 0.5 else np.zeros(12, int)
        border = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        values = np.array([x for s in sets for x in s], np.int64)
        us, vs = neardup.links_within(pa.array(range(12)), pa.array(range(12)), side, border, values, 75)
        two = len(set(side.tolist())) > 1

        def close(pairs):
            comp = list(range(12))
            for _ in range(12):
                for i, j in pairs:
                    comp[i] = comp[j] = min(comp[i], comp[j])
            return comp

        alike = [(i, j) for i in range(12) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= 75 * len({*sets[i]} | {*sets[j]}) and (not two or side[i] != side[j])]
        assert {tuple(sorted(x, reverse=True)) for x in zip(us, vs, strict=True)} <= set(alike) and len(us) < 12
        assert close(list(zip(us, vs, strict=True))) == close(alike)


def test_densified_bins_agree_as_often_as_sets():
    r = np.random.default_rng(3)
    for size in (4, 20, 400):
        agree = []
        for _ in range(60):
            h = r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(h), np.sort(h[: size * 3 // 4])
            v = neardup.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
            agree.append((v[0] == v[1]).mean())
        assert abs(np.mean(agree) - 0.75) < 0.06


def repeats(data, length):
    seen, out = set(), {}
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(b[s:s + length])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[i] = (len(b), int(gone.sum()), [tuple(map(int, x)) for x in edge.reshape(-1, 2)], hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_substrings_against_brute_force(spark, hot):
    r = random.Random(4)
    passage, filler = prose(60, 20), prose(400, 21)
    texts = [x[1] for x in rows()[:-3]] + [prose(r.randint(0, 30), 30 + i) + " " + passage[r.randint(0, 40):r.randint(200, 260)] + " " + prose(10, 60 + i) for i in range(25)]
    texts += [filler[i:i + r.randint(90, 600)] for i in (0, 13, 500, 40, 0)] + ["a" * 1000, "ab" * 300 + "a" * 150, "é" * 120, prose(30, 90) + filler[:101], filler[:100], filler[:99]]
    got = substrings.remove_repeats(with_texts(spark, texts).repartition(4), hot=hot).collect()
    want = repeats(list(enumerate(texts)), 100)
    for x in got:
        assert (x["n_bytes"], x["n_removed"], [tuple(s) for s in x["spans"]], x["kept_sha256"]) == want[x["doc_id"]], x["doc_id"]
        assert x["n_spans"] == len(x["spans"]) and hashlib.sha256(x["kept"]).hexdigest() == x["kept_sha256"]
    assert len(got) == len(texts)


def test_substrings_of_messy_rows(spark):
    data = rows()
    got = substrings.remove_repeats(table(spark)).collect()
    assert len(got) == len(data)
    assert sum(r["doc_id"] is None for r in got) == 2
    twice = [r for r in got if r["doc_id"] == data[3][0]]
    assert len(twice) == 2 and twice[0] == twice[1]  # a repeated row is one document
    assert substrings.remove_repeats(table(spark, [])).count() == 0


def test_substrings_of_repeated_keys_of_any_size(spark):
    passage = prose(40, 320)
    far = [(k, f"{prose(5, 330 + n)} {passage} {prose(20, 340 + n % 2)}") for n, k in enumerate([(1 << 62) + 1, 5, -(1 << 62), (1 << 62) + 1, None, 5, (1 << 62) + 2])]
    data = [*far, far[0], (1, "short"), (-(1 << 63), "short"), (None, "short")]
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in data], SCHEMA).repartition(3)
    order = sorted(set(data), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = repeats([(n, t) for n, (_, t) in enumerate(order)], 100)
    left = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["kept_sha256"]) for r in substrings.remove_repeats(df).collect())
    index = {x: n for n, x in enumerate(order)}
    assert left == sorted((i is not None, i or 0, want[index[i, t]][3]) for i, t in data)


def test_small_runs_of_segments(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENTS", 3)
    texts = [prose(80, 70 + i % 3) + f" tail {i} " + prose(30, 75 + i % 2) for i in range(12)]
    got = substrings.remove_repeats(with_texts(spark, texts)).collect()
    want = repeats(list(enumerate(texts)), 100)
    assert all((x["n_removed"], x["kept_sha256"]) == (want[x["doc_id"]][1], want[x["doc_id"]][3]) for x in got)


def test_patience_pairs_are_a_common_subsequence():
    r = random.Random(5)
    for _ in range(300):
        a, b = [r.randrange(8) for _ in range(r.randint(0, 12))], [r.randrange(8) for _ in range(r.randint(0, 12))]
        pairs = linededup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:]))
    a, b = list("abcdefghij"), list("xabcyefgzhij")
    assert [b[j] for _, j in linededup.aligned(a, b)] == [b[m.b + i] for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks() for i in range(m.size)]


def lines_by_brute(data, least=100):
    """Earliest holder of each line against each later text; equal texts lose all."""
    first_text, out = {}, {}
    texts = sorted((i, t or "") for i, t in data)
    for i, t in texts:
        first_text.setdefault(t, i)
    kept = [(i, t) for i, t in texts if first_text[t] == i]
    word = re.compile(r"[^\x20\x09-\x0D]")
    holder = {}
    for i, t in kept:
        for x in t.split("\n"):
            if word.search(x):
                holder.setdefault(x, i)
    by_id = dict(kept)
    for i, t in texts:
        if first_text[t] != i:
            out[i] = ("", len(t.split("\n")), [first_text[t]])
            continue
        mine, cut, partners = t.split("\n"), set(), []
        mark = [x if word.search(x) else "" for x in mine]
        for u in sorted({holder[x] for x in mine if word.search(x)} - {i}):
            other = [x if word.search(x) else "" for x in by_id[u].split("\n")]
            got = linededup.common_blocks(other, mark, [len(x.encode()) for x in mine], least)
            cut |= set(got)
            partners += [u] * bool(got)
        out[i] = ("\n".join(x for n, x in enumerate(mine) if n not in cut), len(cut), partners)
    return out


def test_lines_against_brute_force(spark):
    block = [prose(20, 200 + i) for i in range(6)]
    texts = ["\n".join(block), prose(30, 210) + "\n" + "\n".join(block[2:5]) + "\n" + prose(30, 211), "\n".join(block), "\n".join([block[0], "new", *block[1:]]), "\n".join(block[::-1]), "short\nlines", "short\nother", "", None, " \n\n" + block[3], "\n".join([block[5], "", "", block[4]])]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(with_texts(spark, texts)).collect()}
    for i, (text, n, partners) in lines_by_brute(list(enumerate(texts))).items():
        assert (got[i]["text"], got[i]["n_removed"], got[i]["partners"]) == (text, n, partners), i
        assert got[i]["n_lines"] == len((texts[i] or "").split("\n"))


def test_lines_of_large_groups_are_found_without_a_bound(spark):
    block = "\n".join(prose(20, 220 + i) for i in range(3))
    texts = [block + f"\nown {i}" for i in range(12)]
    got = linededup.dedup_lines(with_texts(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(0, 0), *((i, 3) for i in range(1, 12))]


def test_lines_whose_block_has_another_first_holder_than_its_lines(spark):
    x, y, z = ("".join(random.Random(230 + i).choices("abcdefgh", k=60)) for i in range(3))
    texts = [f"{x}\nfirst", f"{y}\nsecond", f"{z}\n{y}\nthird", f"{x}\napart\n{y}", f"head\n{x}\n{y}", f"{x}\n{y}\ntail", f"{x}\n{y}\n{z}", f"{x}\n{y}\n{z}\nend"]
    got = linededup.dedup_lines(with_texts(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [0, 0, 0, 0, 0, 2, 2, 3]
    assert [r["partners"] for r in got[5:]] == [[4], [4], [4, 6]]
    assert got[7]["text"] == "end"


def test_lines_of_frequent_blocks_beside_rarer_ones(spark):
    common, rarer = prose(30, 240), [prose(30, 241 + i) for i in range(4)]
    texts = [f"{common}\nown {i}" for i in range(6)] + ["\nbetween\n".join(rarer), "\nor else\n".join([common, *rarer])]
    got = linededup.dedup_lines(with_texts(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["partners"]) for r in got] == [(0, []), *[(1, [0])] * 5, (0, []), (5, [0, 6])]


def all_blocks(a, b, size, least):
    """Positions in b of all equal runs of enough bytes."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            out |= set(range(j, j + n)) if n and sum(size[j:j + n]) >= least else set()
    return sorted(out)


def test_nothing_is_deleted_but_by_alignment(spark, monkeypatch):
    block = prose(30, 400)
    texts = [f"{block}\nthen\n{prose(25, 401)}", f"one\n{prose(25, 401)}\ntwo\n{block}\nthree\n{block}"]
    assert linededup.common_blocks(*[t.split("\n") for t in texts], [len(x) for x in texts[1].split("\n")], 100) == [1, 3, 5]
    monkeypatch.setattr(linededup, "aligned", lambda a, b: [])
    assert linededup.common_blocks(*[t.split("\n") for t in texts], [len(x) for x in texts[1].split("\n")], 100) == []


def test_common_blocks_in_any_order_and_number():
    size = {"P": 60, "Q": 60, "x": 10, "y": 10, "z": 10, "w": 10, "R": 120, "": 0}
    blocks = lambda a, b: sorted(linededup.common_blocks(list(a), list(b), [size[x] for x in b], 100))
    assert blocks("PQx", "yPQzPQw") == [1, 2, 4, 5]
    assert blocks("PQxR", "RyPQ") == [0, 2, 3]
    assert blocks("PxQ", "PQ") == [] and blocks("", "PQ") == [] and blocks("PQ", "") == []
    r = random.Random(7)
    for _ in range(500):
        a, b = (r.choices(list(size), k=r.randint(0, 12)) for _ in range(2))
        sizes = [size[x] for x in b]
        assert sorted(linededup.common_blocks(a, b, sizes, 100)) == all_blocks(a, b, sizes, 100)


def test_lines_against_all_earlier_documents(spark):
    r, lines = random.Random(8), ["".join(random.Random(250 + i).choices("abcdefgh", k=30 + 15 * (i % 5))) for i in range(10)]
    texts = ["\n".join(r.choice([*lines, "", "  ", f"own {i}"]) for _ in range(r.randint(1, 14))) for i in range(60)]
    got = linededup.dedup_lines(with_texts(spark, texts)).orderBy("doc_id").collect()
    for i, text in enumerate(texts):
        mine = [x.strip() and x for x in text.split("\n")]
        cut = set()
        for u in texts[:i]:
            cut |= set(all_blocks([x.strip() and x for x in u.split("\n")], mine, [len(x) for x in mine], 100))
        cut = set(range(len(mine))) if text in texts[:i] else cut
        assert got[i]["text"] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in cut), i


def test_windows_cover_each_run_of_enough_bytes():
    r = random.Random(6)
    for _ in range(200):
        border = np.cumsum([0, *(r.randint(0, 6) for _ in range(4))])
        size = np.array([r.choice([0, 1, 5, 30, 99, 100, 120]) for _ in range(border[-1])], np.int32)
        start, end = linededup.windows(size, border, 100)
        assert len(start) <= 2 * len(size) and all(size[a:b].sum() >= 100 and sum(border <= a) == sum(border < b) for a, b in zip(start, end))
        for lo, hi in zip(border[:-1], border[1:]):
            for a in range(lo, hi):
                for b in range(a + 1, hi + 1):
                    if size[a:b].sum() >= 100:
                        assert {n for c, d in zip(start, end) if a <= c and d <= b for n in range(c, d)} == set(range(a, b))


def test_lines_of_messy_rows(spark):
    got = linededup.dedup_lines(table(spark)).collect()
    assert len(got) == len(rows()) and sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
    assert linededup.dedup_lines(table(spark, [])).count() == 0


def test_word_arrays_against_plain_python():
    texts = [r[1] for r in rows()]
    data, offsets = W.text_bytes(pa.array(texts))
    found = W.find_words(data, offsets)
    got = [[] for _ in texts]
    for s, e, d in zip(found.start, found.end, found.doc, strict=True):
        got[d].append(data[s:e].tobytes().decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    h = W.span_hashes(data, found.start, found.end)
    word = [w for g in got for w in g]
    assert len(set(zip(word, h.tolist(), strict=True))) == len(set(word)) == len(set(h.tolist()))
