import re

from messy import prose, rows, table
from test_dedup import FOLD, shingles, with_texts

from tidemark.llm import decontaminate, licenses

ITEMS = [(0, prose(120, 1)[:200]), (1, prose(25, 50)), (2, "one two"), (3, None), (4, " "), (5, prose(40, 51)), (5, prose(40, 52)), (None, prose(30, 53)), (6, prose(9, 54))]


def leaky():
    r1, r5 = prose(25, 50).split(), prose(40, 51).split()
    texts = [r[1] for r in rows()[:-3]]
    texts += [prose(500, 80) + " " + " ".join(r1).upper() + " " + prose(900, 81), " ".join(r5[:34]), " ".join(r5[:30]), " ".join(r5[:20] + ["x"] + r5[21:]), " ".join(r1[::-1]), prose(30, 53), prose(2000, 82) + "\n" + prose(9, 54)]
    return texts


def test_leaks_against_brute_force(spark):
    texts = leaky()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contained(with_texts(spark, texts), items).collect()
    want = []
    for i, t in enumerate(texts):
        for item, x in ITEMS:
            a, b = shingles(x), shingles(t)
            if a and len(a & b) >= 0.75 * len(a):
                want.append((i, item, len(a & b), len(a)))
    key = str
    assert sorted(((r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in got), key=key) == sorted(want, key=key)
    clean = decontaminate.clean(with_texts(spark, texts), items).collect()
    assert {r["doc_id"] for r in clean} == set(range(len(texts))) - {w[0] for w in want}


def test_larger_sides_are_not_broadcast(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = with_texts(spark, leaky())
    want = sorted(map(str, decontaminate.contained(df, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontaminate.contained(df, items).collect())) == want


def test_leaks_of_messy_and_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contained(table(spark), items).collect()
    assert any(r["doc_id"] is None for r in got)  # a document without id is found too
    assert decontaminate.contained(table(spark, []), items).count() == 0
    assert decontaminate.contained(table(spark), items.limit(0)).count() == 0
    assert decontaminate.clean(table(spark), items.limit(0)).count() == len(rows())


TEXTS = [
    "Released under the MIT License.", "mit license mit LICENSE", "MIT-License; Apache\tLicense, version 2", "the General Public, License", "general public license general public license", "mit", "license", "", None,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    prose(100, 1) + " Permission is hereby granted, free of all charge, to any person obtaining a copy of this software and the associated documentation files " + prose(50, 2) + " gpl",
    "Licensed under CC BY-NC 4.0.", "apache license " * 50, "permission is hereby granted to nobody", "éapache license",
]


def test_licenses_against_brute_force(spark):
    got = {r["doc_id"]: r for r in licenses.scan(with_texts(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
        at, labels = [], set()
        for p in licenses.PHRASES:
            n = p.text.split()
            hits = [j for j in range(len(w) - len(n) + 1) if w[j:j + len(n)] == n]
            at += hits
            labels |= {p.label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), i
        assert labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[9]["labels"] == "mit" and got[9]["score"] == 1
    assert got[10]["labels"] == "mit" and 0.8 <= got[10]["score"] < 1  # two words were added; the diagonals beside each other are merged
    assert got[11]["labels"] == "cc-by-nc" and got[13]["labels"] == "" and got[14]["labels"] == ""


def test_no_license_where_its_words_drift_apart(spark):
    notice = licenses.NOTICES[0].text.split()
    drifting = " ".join(w + " x" * (i % 2) for i, w in enumerate(notice))
    texts = ["licensed under a under cc b cc by c by nc", drifting, " ".join(notice[:9] + ["so", "to", "say"] + notice[9:]), " ".join(notice) + " " + " ".join(notice)]
    got = {r["doc_id"]: r for r in licenses.scan(with_texts(spark, texts)).collect()}
    assert got[0]["labels"] == got[1]["labels"] == "" and got[0]["score"] < 0.8
    assert got[2]["labels"] == got[3]["labels"] == "mit"
    found = licenses.spans(with_texts(spark, texts[2:]), licenses.NOTICES).filter("verified").orderBy("doc_id", "first").collect()
    assert [(r["doc_id"], r["first"], r["last"]) for r in found] == [(0, 0, len(notice) + 2), (1, 0, len(notice) - 1), (1, len(notice), 2 * len(notice) - 1)]


def test_licenses_of_messy_rows(spark):
    assert licenses.scan(table(spark)).count() == len(rows())
    assert licenses.scan(table(spark, [])).count() == 0
