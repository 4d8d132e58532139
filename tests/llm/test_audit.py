import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from messy import rows

from tidemark.llm import audit, q_audit
from tidemark.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for r in docs:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    counts = Counter()
    for r in docs:
        text = r[1] or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": r[0] is not None and r[0] > first[text]}
        counts[r[2] or "", frozenset(k for k, v in fails.items() if v), r[0] in good, r[0] in bad] += 1
    out = {}
    for part in {k[0] for k in counts}:
        mine = [(k[1], k[2], k[3], n) for k, n in counts.items() if k[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for i, x in enumerate(order):
                before = set(order[:i])
                hit = [(s, g, b, n) for s, g, b, n in mine if x in s and not s & before]
                shapley[x] += sum(n for *_, n in hit)
                out[part, "".join(order), i + 1] = [
                    sum(n for s, _, _, n in mine if not s & (before | {x})), sum(n for *_, n in hit), sum(n for s, _, _, n in mine if x in s and s & before),
                    sum(n for s, _, _, n in mine if s == {x}), sum(n for _, g, _, n in hit if g), sum(n for _, _, b, n in hit if b)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("some", [True, False])
def test_audit_of_messy_rows(spark, tmp_path, some, monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", 3000)
    docs = [r[:5] + ("clash",) for r in rows()] if some else []
    docs += [(100 + i, docs[0][1] + " ONE", "fr", "s", None, "x") for i in range(5)] + [(100, docs[0][1] + " ONE", "fr", "s", None, "x")] if some else []
    labels = [(0, 1, 0), (0, 1, 0), (1, 0, 1), (6, 1, 1), (7, None, None), (101, 1, 0), (None, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, shard string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q_audit.op11_filter_audit(spark, str(tmp_path))
    want = brute(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley", "good_lost", "toxic_lost"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got.collect()} == want


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_matrix_gives_back_every_word(spark, size, monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", size)
    docs = [(i, t) for i, t in enumerate([r[1] for r in rows()])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    matrix, words = audit.document_term_matrix(df, "text", ["doc_id"])
    name = {r["word_id"]: bytes(r["word"]) for r in words.collect()}
    assert set(name.values()) == {w.encode() for _, t in docs for w in WORD.findall(t or "")} and len(set(name.values())) == len(name)
    seen = {}
    shards = matrix.collect()
    assert len({s["shard"] for s in shards}) == len(shards) and (len(shards) > 4) == (size == 200)
    for s in shards:
        for i, row in enumerate(s["rows"]):
            lo, hi = s["indptr"][i], s["indptr"][i + 1]
            assert s["indices"][lo:hi] == sorted(s["indices"][lo:hi])
            seen[row["doc_id"]] = Counter({name[k]: n for k, n in zip(s["indices"][lo:hi], s["data"][lo:hi])})
    assert seen == {i: Counter(w.encode() for w in WORD.findall(t or "")) for i, t in docs}
    figures = {r["doc_id"]: (r["row_sum"], r["nonzeros"]) for r in audit.row_figures(matrix).collect()}
    assert figures == {i: (sum(c.values()), len(c)) for i, c in seen.items()}


def test_rows_of_one_array():
    starts, words, counts, names, bucket = audit.csr(*W.text_bytes(pa.array(["b a b", None, "", "a  c"])), 7)
    assert starts.tolist() == [0, 2, 2, 2, 4] and (bucket == sorted(bucket)).all() and (bucket < 7).all()
    found = [(names[w].as_py(), c) for w, c in zip(words.tolist(), counts.tolist())]
    assert sorted(found[:2]) == [(b"a", 1), (b"b", 2)] and sorted(found[2:]) == [(b"a", 1), (b"c", 1)]
