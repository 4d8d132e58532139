import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import q_embeddings, whitening

SCHEMA = "vec_id long, embedding array<float>, label string, deviation string, whitened string"


def write(spark, tmp_path, vectors):
    rows = [(i, v, "clash", "x", "y") for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/t/embeddings.parquet")
    return q_embeddings.op13_whitening(spark, f"{tmp_path}/t")


def brute(vectors):
    good = {i: v for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)}
    d = len(next(iter(good.values())))
    good = {i: v for i, v in good.items() if len(v) == d}
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in good.values()], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for i, row in zip(good, x)}
    a = np.array((n * x - s).tolist(), float) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    return n, deviation, {i: row for i, row in zip(good, a)}, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("spread", [1.0, 1e-2, 1e4])
def test_against_eigenvectors(spark, tmp_path, spread):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 12)) * np.geomspace(min(1.0, 1e2 / spread), min(spread, 1e2), 12) @ np.linalg.qr(r.normal(size=(12, 12)))[0]
    vectors = [[float(np.float32(c)) for c in v] for v in base]
    vectors += [vectors[5]] * 40 + [None, [], [None] * 12, [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [1.0, 2.0]]
    got = write(spark, tmp_path, vectors).collect()
    n, deviation, rows, e, v = brute(vectors)
    assert n == 340 and len(got) == n * 8 and {r["vec_id"] for r in got} == set(range(340))
    signs = {}
    for r in got:
        k = r["component"] - 1
        want = rows[r["vec_id"]] @ v[:, k] / math.sqrt(e[k])
        if abs(want) > 1e-3:
            assert signs.setdefault(k, math.copysign(1, want * r["whitened"])) == math.copysign(1, want * r["whitened"])
        assert abs(want) == pytest.approx(abs(r["whitened"]), rel=1e-6, abs=1e-6)
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-8) and r["identity_error"] < 1e-9


def test_directions_without_variance(spark, tmp_path):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 4))
    vectors = [[float(c) for c in (a, b, c, d, 0.5, 0.5, a, b, c, d)] for a, b, c, d in x]
    got = write(spark, tmp_path, vectors).collect()
    n, deviation, rows, e, v = brute(vectors)
    for row in got:
        k = row["component"] - 1
        assert (row["whitened"] is None) == (k >= 4), k
        assert row["explained"] == pytest.approx(max(e[k], 0) / e.sum(), rel=1e-8, abs=1e-12) and row["identity_error"] < 1e-9
        if k < 4:
            assert abs(row["whitened"]) == pytest.approx(abs(rows[row["vec_id"]] @ v[:, k] / math.sqrt(e[k])), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("vectors", [[], [None, [], [float("nan"), 1.0]]])
def test_nothing_to_whiten(spark, tmp_path, vectors):
    out = write(spark, tmp_path, vectors)
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("copies", [1, 5])
def test_equal_vectors_only(spark, tmp_path, copies):
    got = write(spark, tmp_path, [[1.0, 2.0, 3.0]] * copies).collect()
    assert len(got) == 3 * copies and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None and r["identity_error"] == 0.0 for r in got)


def test_factors_give_the_gram_matrix(spark):
    r = np.random.default_rng(5)
    x = (r.normal(size=(500, 6)) * np.geomspace(1, 1e7, 6) @ np.linalg.qr(r.normal(size=(6, 6)))[0]).astype(np.int64)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(4)
    model = whitening.fit(df, "x")
    a = x - x.mean(0)
    assert np.allclose((model.axes * model.variances) @ model.axes.T, a.T @ a / len(x), rtol=1e-9, atol=1e-3)
    one, _, few = whitening.one_length(df.withColumn("x", F.when(F.rand(1) < 0.1, F.slice("x", 1, 2)).otherwise(F.col("x"))), "x")
    assert few == one.count() > 300


@pytest.mark.parametrize("far,kind", [(24_000.0, "bigint"), (1e9, "decimal(38,0)")])
def test_deviations_near_and_beyond_a_long(spark, tmp_path, far, kind):
    # the first has entries whose square times the dimension is beyond a long, while every sum is within
    r = np.random.default_rng(6)
    vectors = [[far * (-1) ** i, *map(float, r.normal(size=63))] for i in range(40)]
    out = write(spark, tmp_path, vectors)
    n, deviation, *_ = brute(vectors)
    assert dict(out.dtypes)["deviation"] == kind and max(deviation.values()) > 2 ** 59
    got = out.collect()
    assert len(got) == 320 and all(int(x["deviation"]) == deviation[x["vec_id"]] for x in got)


def test_deviations_of_a_large_table(spark):
    x = np.array([[100_000, 100_500], [99_400, 100_020]])
    model = whitening.Whitening(4_000_000_000, x.mean(0).astype(np.int64) * 4_000_000_000, np.eye(2), np.ones(2), 2.0)
    got = whitening.whiten(spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>"), "x", model, 1)
    want = [sum((model.n * int(a) - int(s)) ** 2 for a, s in zip(v, model.sums)) for v in x]
    assert dict(got.dtypes)["deviation"] == "decimal(38,0)" and sorted(int(r["deviation"]) for r in got.collect()) == sorted(want) and min(want) > 2 ** 63
