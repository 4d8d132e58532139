"""The piecewise order primitives against brute force, with pieces far smaller than the data."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import discrimination as D
from tidemark.operators import ordered as O


def frame(spark, n=3000, seed=0, heavy=0.3):
    rng = np.random.default_rng(seed)
    p = np.round(rng.beta(1, 8, n), 3)
    p[rng.random(n) < heavy] = 0.07  # one score holds about a third of all rows
    g = rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1])
    y = (rng.random(n) < 0.1 + p).astype(int)
    pdf = pd.DataFrame({"g": g, "y": y, "p": p})
    return pdf, spark.createDataFrame([(r.g, int(r.y), float(r.p)) for r in pdf.itertuples()], "g string, y int, p double")


def brute_auc(y, p):
    r = pd.Series(p).rank().to_numpy()
    pos, neg = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


def groups(pdf):
    return {k if isinstance(k, str) else None: d for k, d in pdf.assign(g=pdf.g.where(pdf.g.notna(), "~")).replace({"g": {"~": np.nan}}).groupby("g", dropna=False)}


@pytest.mark.parametrize("rows_per_piece", [50, 400, 10_000])
def test_auroc_and_average_precision(spark, rows_per_piece):
    pdf, df = frame(spark)
    points = O.split_points(df, "p", rows_per_piece)
    assert (len(points) > 1) == (rows_per_piece < 3000)
    got = {r.g: r for r in D.auroc(df, by=["g"], points=points).collect()}
    full = {r.g: r for r in D.discrimination(df, by=["g"], points=points).collect()}
    for k, d in groups(pdf).items():
        y, p = d.y.to_numpy(), d.p.to_numpy()
        assert got[k].auroc == pytest.approx(brute_auc(y, p), abs=1e-12)
        assert full[k].auroc == pytest.approx(got[k].auroc, abs=1e-12)
        c = d.groupby("p").y.agg(["sum", "count"]).sort_index(ascending=False).cumsum()
        steps = np.diff(np.r_[0, c["sum"]]) / c["sum"].iloc[-1]
        assert full[k].auprc == pytest.approx((steps * c["sum"] / c["count"]).sum(), abs=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    pdf, df = frame(spark, 1000)
    points = O.split_points(df, "p", 40)
    got = O.cumulate(df.filter("g = 'a'"), "p", {"n": F.lit(1), "s": F.col("y")}, ["g"], descending, points).toPandas()
    d = pdf[pdf.g == "a"].groupby("p").y.agg(["count", "sum"]).sort_index(ascending=not descending)
    want = d.cumsum() - d
    got = got.set_index("p").loc[d.index]
    assert (got.n_before.to_numpy() == want["count"].to_numpy()).all() and (got.s_before.to_numpy() == want["sum"].to_numpy()).all()
    assert set(got.n_total) == {d["count"].sum()}


def test_quantiles_interpolate(spark):
    pdf, df = frame(spark, 777)
    got = O.quantiles(df, "p", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, ["g"], points=O.split_points(df, "p", 30)).collect()
    for r in got:
        d = groups(pdf)[r.g].p
        assert (r.q25, r.q50, r.q90) == pytest.approx(tuple(d.quantile([0.25, 0.5, 0.9])), abs=1e-12)
        assert r.n == len(d)


def test_weighted_quantiles_repeat_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 0), (10.0, 1)], "v double, w int")
    got = O.quantiles(df, "v", {"q": 0.75}, weight="w").first()
    assert (got.n, got.q) == (4, np.quantile([1, 1, 1, 10], 0.75))


def test_quantile_bins_like_pandas(spark):
    values = [0.1, 0.1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = sorted((r.p, r.bin) for r in O.quantile_bins(df, "p", 4).collect())
    assert [b for _, b in got] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]
    ties = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "p double")
    assert {(r.p, r.bin) for r in O.quantile_bins(ties, "p", 10).collect()} == {(v, int(b)) for v, b in zip([1.0] * 8 + [2.0, 3.0], pd.qcut([1.0] * 8 + [2.0, 3.0], 10, labels=False, duplicates="drop"))}


def test_midranks(spark):
    pdf, df = frame(spark, 500)
    got = O.midranks(df.filter("g = 'b'"), "p", points=O.split_points(df, "p", 25)).toPandas()
    want = pdf[pdf.g == "b"].p.rank()
    assert sorted(got.midrank) == sorted(want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.25, 0.5, 0.5000001, 1.0])), min_size=2, max_size=40))
def test_auroc_symmetry(spark, rows):
    df = spark.createDataFrame([(y, float(p)) for y, p in rows], "y int, p double")
    a = D.auroc(df, points=[0.25, 0.5]).first().auroc
    b = D.auroc(df.withColumn("p", -F.col("p")), points=[-0.5, -0.25]).first().auroc
    ys = {y for y, _ in rows}
    if len(ys) < 2:
        assert a is None and b is None
    else:
        assert a + b == pytest.approx(1.0, abs=1e-12)


def test_thin_curve_keeps_both_ends(spark):
    df = spark.createDataFrame([(i % 2, i / 100) for i in range(100)], "y int, p double")
    curve = D.curve(df, points=[0.3, 0.6])
    kept = sorted(r.threshold for r in D.thin_curve(curve, 7).collect())
    assert len(kept) == 7 and kept[0] == 0.0 and kept[-1] == 0.99


def test_rows_of_few_groups_are_not_shuffled_to_meet_their_group(spark):
    """A join with one row per group leaves rows where they are, so no task gets a whole group."""
    rows = spark.range(0, 4000, 1, 8).selectExpr("IF(id % 7 = 0, NULL, id % 2) AS g", "CAST(id AS DOUBLE) AS v")
    groups = rows.groupBy("g").agg(F.max("v").alias("top"))
    out = O.join_groups(rows, groups, ["g"])
    assert out.rdd.getNumPartitions() == 8 and out.count() == 4000
    tops = {r["g"]: r["top"] for r in groups.collect()}
    assert all(r["top"] == tops[r["g"]] for r in out.collect())
    layer = C.fit_layer(rows.select("g", (F.col("v") % 3 == 0).cast("int").alias("y"), ((F.col("v") + 1) / 4002).alias("p")), by=["g"], steps=2)
    assert "SortMergeJoin" not in layer._jdf.queryExecution().executedPlan().toString()
