import itertools

import numpy as np
import pyarrow as pa
from messy import SCHEMA, prose, rows, table

from tidemark.llm import toxicity as T


def test_marginals_against_all_paths():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        odds, pair = np.exp(r.normal(size=n)), np.exp(r.normal(size=(2, 2)))
        total, one = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            p = np.prod([odds[i] if y else 1 for i, y in enumerate(path)]) * np.prod([pair[a, b] for a, b in itertools.pairwise(path)])
            total += p
            one += p * np.array(path)
        got, _, _ = T.forward_backward(odds, np.array([0]), np.array([n]), pair)
        assert np.allclose(got, one / total)


def test_chains_side_by_side_are_as_alone():
    r = np.random.default_rng(2)
    length = np.array([3, 1, 7, 2])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    odds, pair = np.exp(r.normal(size=13)), np.exp(r.normal(size=(2, 2)))
    got, _, _ = T.forward_backward(odds, start, length, pair)
    for s, n in zip(start, length, strict=True):
        assert np.allclose(got[s:s + n], T.forward_backward(odds[s:s + n], np.array([0]), np.array([n]), pair)[0])


def test_tokens_cover_every_word_once():
    texts = [r[1] for r in rows()] + ["no stop " * 400]
    t = T.tokens(*T.W.text_bytes(pa.array(texts)))
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(t.chain_start, t.chain_length, strict=True)])
    assert (np.sort(at) == np.arange(len(t.words.start))).all() and t.chain_length.max() <= T.CHAIN


def corpus(n, seed):
    texts, toxic = [], []
    for i in range(n):
        w = prose(40, seed + i).split()
        bad = i % 3 == 0
        if bad:
            for j in range(5, 40, 9):
                w[j] = ("vile", "nasty", "grim")[(i // 3 + j // 9) % 3]
        texts.append(" ".join(w) + ".")
        toxic.append(int(bad))
    return texts, toxic


def test_unseen_documents_are_told_apart(spark):
    texts, toxic = corpus(240, 100)
    docs = spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    new, truth = corpus(90, 5000)
    got = T.tag(spark.createDataFrame([(i, t) for i, t in enumerate(new)], "doc_id long, text string"), model).collect()
    assert all((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got)
    bad = {"vile", "nasty", "grim"}
    tagged = [w for r in got for s in r["spans"] for w in new[r["doc_id"]][s["start"]:s["end"]].split()]
    planted = sum(w.strip(".") in bad for t in new for w in t.split())
    assert sum(w in bad for w in tagged) == planted
    assert sum(w not in bad for w in tagged) <= 0.05 * planted  # words of clean text that stood in toxic rows only, by chance
    seen = table(spark)
    assert T.tag(seen, model).count() == len(rows())
    kept = T.keep_clean(seen, model, cut=0.3)
    assert kept.columns == seen.columns
    below = [r["doc_id"] for r in T.tag(seen, model).collect() if r["score"] < 0.3]
    assert sorted(map(str, below)) == sorted(str(r["doc_id"]) for r in kept.collect())
    assert T.tag(table(spark, []), model).count() == 0


def test_curve_ends_at_the_minimum_for_rare_classes():
    r = np.random.default_rng(6)
    for rare in (0.5, 0.01):
        y = (np.arange(1000) % 2).astype(int)
        m = np.clip(np.where(y == 1, 0.97, 0.15) + 0.03 * r.normal(size=1000), 0, 1)
        x = np.stack([np.ones(1000), np.log1p(2 * m), m, np.log1p(20 * m)], 1)
        weight = np.where(y == 1, rare, 1 - rare)
        w = T.fit_curve(x, y, weight)
        p = 1 / (1 + np.exp(-(x @ w)))
        weight = weight / weight.mean()
        assert np.abs(x.T @ (weight * (y - p)) - 0.05 * w).max() < 2e-3
        assert p[y == 1].min() > 0.3 > p[y == 0].max()


def test_spans_count_code_points(spark):
    texts, toxic = corpus(240, 100)
    model = T.fit(pa.array(texts), np.array(toxic), np.arange(240) // 3 % 3)
    text = "été ünd vile über alles und mehr nasty wörter."
    r = T.tag(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[s["start"]:s["end"]] for s in r["spans"]] == ["vile", "nasty"]


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert abs(T.tag(docs, model).first()["score"] - want) < 1e-3
