import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import recalibrate
from tidemark.operators import alerts as AL
from tidemark.operators import bootstrap as B
from tidemark.operators import calibration as C
from tidemark.operators import discrimination as D
from tidemark.operators import ordered as O


def test_hand_computed_auroc_and_ap(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0.1, 0.4, 0.4, 0.35, 0.8])), "y int, p double")
    got = D.discrimination(df).first()
    assert got.auroc == pytest.approx(0.75) and got.auprc == pytest.approx(0.8055555556)


def test_unit_weights_change_nothing(spark):
    df = spark.createDataFrame([(i % 3 == 0, i % 7 / 7.0, 1.0) for i in range(60)], "b boolean, p double, w double").withColumn("y", F.col("b").cast("int"))
    assert D.auroc(df, weight="w").first().auroc == pytest.approx(D.auroc(df).first().auroc)


def test_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert D.auroc(df).first().auroc is None
    assert C.brier(df).first().skill is None


def test_trend_exact_p_by_enumeration(spark):
    for values in ([0.1, 0.2, 0.3], [0.5, 0.4, 0.6, 0.7], [0.3, 0.1, 0.2, 0.5, 0.4]):
        df = spark.createDataFrame(list(enumerate(values)), "o int, v double")
        got = D.concordance(df, "o", "v").first()

        def s(v):
            return sum(np.sign(v[j] - v[i]) for i in range(len(v)) for j in range(i + 1, len(v)))

        every = [s(p) for p in itertools.permutations(values)]
        assert got.s == s(values)
        assert got.p_exact == pytest.approx(min(1.0, 2 * np.mean([x >= abs(s(values)) for x in every])))


def test_hour_strata_borders(spark):
    df = spark.createDataFrame([(h,) for h in (24.0, 30.0, 48.0, 54.0, 168.0, 174.0)], "h double")
    got = df.select(D.hour_strata("h").alias("a"), D.hour_strata("h", right_closed=False).alias("b")).collect()
    assert [r.a for r in got] == [None, 48.0, 48.0, 72.0, 168.0, None]
    assert [r.b for r in got][:4] == [24.0, 24.0, 48.0, 48.0]


def test_delong_against_components(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 80)
    p, q = np.round(rng.random(80), 1), np.round(rng.random(80) + 0.2 * y, 1)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, p, q)], "y int, p1 double, p2 double")
    got = D.delong(df).first()

    def parts(s):
        pos, neg = s[y == 1], s[y == 0]
        k = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
        return k.mean(1), k.mean(0)

    (v1, u1), (v2, u2) = parts(p), parts(q)
    var = np.var(v1 - v2, ddof=1) / len(v1) + np.var(u1 - u2, ddof=1) / len(u1)
    assert got.auc1 == pytest.approx(v1.mean()) and got.var == pytest.approx(var)
    assert 0 <= got.p_value <= 1


def test_layer_recovers_known_shift(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.05, 0.6, 4000)
    true = 1 / (1 + np.exp(-(0.4 + 0.7 * np.log(p / (1 - p)))))
    y = (rng.random(4000) < true).astype(int)
    df = spark.createDataFrame([(int(a), float(b), i % 2) for i, (a, b) in enumerate(zip(y, p))], "y int, p double, g int")
    whole = C.fit_layer(df).first()
    assert whole.a == pytest.approx(0.4, abs=0.25) and whole.b == pytest.approx(0.7, abs=0.15)
    # At the optimum the mean recalibrated risk equals the event rate.
    rec = df.select(recalibrate("p", F.lit(whole.a), F.lit(whole.b)).alias("r"), "y").agg(F.avg("r"), F.avg("y")).first()
    assert rec[0] == pytest.approx(rec[1], abs=1e-8)
    # Leaving one of two folds out is the same as fitting the other.
    held = {r.g: r for r in C.held_out_layers(df, "g").collect()}
    for g in (0, 1):
        other = C.fit_layer(df.filter(F.col("g") != g)).first()
        assert held[g].b == pytest.approx(other.b, abs=1e-8) and held[g].a == pytest.approx(other.a, abs=1e-8)


def test_calibration_error_weighting(spark):
    df = spark.createDataFrame([(i % 2, round(0.05 * (i % 11), 2)) for i in range(110)], "y int, p double")
    w, u = C.calibration_error(df).first().ece, C.calibration_error(df, weighted=False).first().ece
    pdf = df.toPandas()
    q = pd.qcut(pdf.p, 10, duplicates="drop")
    g = pdf.groupby(q, observed=True)
    gap = (g.y.mean() - g.p.mean()).abs()
    assert w == pytest.approx((g.size() / len(pdf) * gap).sum()) and u == pytest.approx(gap.mean())


def test_matched_sensitivity_hits_a_known_point(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.4)], "y int, p double")
    target = spark.createDataFrame([(2 / 3,)], "sensitivity double")
    got = D.matched_sensitivity(df, target).first()
    assert got.ppv == pytest.approx(2 / 3) and got.threshold == pytest.approx(0.7)


# ---------------------------------------------------------------- bootstrap


def weights_of(spark, entities, replicates, seed=42):
    df = spark.createDataFrame([(int(e),) for e in entities], "entity long")
    draws = B.resample(df.withColumn("one", F.lit(1)), ["entity"], {"w": F.col("one")}, replicates, ["entity"], seed)
    return {(r.entity, r.replicate): r.w for r in draws.collect()}


def test_blocks_agree_with_weighted_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 400
    e, p = rng.integers(0, 60, n), np.round(rng.random(n), 2)
    p[rng.random(n) < 0.35] = 0.5
    y = (rng.random(n) < p).astype(int)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(e, y, p)], "entity long, y int, p double")
    w = weights_of(spark, range(60), 12)
    for points in ([], O.split_points(df, "p", 40)):
        got = {r.replicate: r.auroc for r in B.bootstrap_auroc(df, replicates=12, points=points).collect()}
        for b in range(1, 13):
            rep = np.array([w.get((int(x), b), 0) for x in e])
            yy, pp = np.repeat(y, rep), np.repeat(p, rep)
            r = pd.Series(pp).rank().to_numpy()
            pos = yy.sum()
            want = (r[yy == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(yy) - pos))
            assert got[b] == pytest.approx(want, abs=1e-12)


def test_draws_look_like_poisson_one(spark):
    w = weights_of(spark, range(4000), 5)
    for b in range(1, 6):
        x = np.array([w.get((i, b), 0) for i in range(4000)])
        assert x.mean() == pytest.approx(1.0, abs=0.06) and x.var() == pytest.approx(1.0, abs=0.12)
    a, c = (np.array([w.get((i, b), 0) for i in range(4000)]) for b in (1, 2))
    assert abs(np.corrcoef(a, c)[0, 1]) < 0.05


def test_identical_scores_have_no_difference(spark):
    df = spark.createDataFrame([(i % 40, i % 3 == 0, i % 9 / 9.0) for i in range(200)], "entity long, b boolean, p double").withColumn("y", F.col("b").cast("int"))
    reps = B.bootstrap_auroc(df, replicates=10)
    got = B.difference_test(B.difference(reps, reps)).first()
    assert got.delta == 0 and got.lo == got.hi == 0 and got.p_value == 2.0


# ---------------------------------------------------------------- alerts


def test_hand_computed_deployment(spark):
    rows = [("A", 24, 0, .20), ("A", 30, 1, .05), ("A", 36, 1, .30), ("B", 24, 0, .01), ("B", 30, 1, .02), ("B", 36, 1, .50), ("C", 24, 0, .16), ("C", 30, 0, .02), ("D", 24, 0, .02)]
    df = spark.createDataFrame([(e, float(t), y, p) for e, t, y, p in rows], "entity string, t_hr double, y int, p double")
    got = AL.deployment(AL.entity_alerts(df, [0.15])).first()
    assert (got.n_event, got.n_captured, got.n_alerted) == (2, 1, 3)
    assert got.lead_median == 12 and got.nne == 3.0 and got.pct_alerted == 75.0
    assert got.days == pytest.approx(4.75) and got.fa_per_100_days == pytest.approx(21.0526, abs=1e-4)
    # An alert at the anchor only is a miss that still counts as alerted.
    b = AL.entity_alerts(df, [0.15]).filter("entity = 'B'").first()
    assert (b.captured, b.alerted, b.lead) == (0, 1, None)


def test_no_capture_gives_null_rates(spark):
    df = spark.createDataFrame([("A", 24.0, 1, 0.1)], "entity string, t_hr double, y int, p double")
    got = AL.deployment(AL.entity_alerts(df, [0.5])).first()
    assert got.nne is None and got.lead_median is None and got.capture == 0.0


def test_fixed_size_draws_are_exact(spark):
    df = spark.createDataFrame([(i % 50, 1) for i in range(170)], "entity long, y int")
    draws = B.fixed_size_draws(df, ["entity"], 8)
    got = draws.groupBy("replicate").agg(F.sum("draws").alias("n"), F.count("*").alias("k")).collect()
    assert len(got) == 8 and {r.n for r in got} == {50} and all(20 <= r.k <= 45 for r in got)


def test_normal_p_of_a_trend(spark):
    rising = spark.createDataFrame([(i, float(i)) for i in range(7)], "o int, v double")
    got = D.concordance(rising, "o", "v").first()
    assert got["z"] == pytest.approx(3.1540, abs=1e-4) and got["p_normal"] == pytest.approx(0.00161, abs=2e-5) and got["p_exact"] == pytest.approx(2 / 5040)
