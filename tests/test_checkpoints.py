import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import checkpoints as K
from tidemark.operators import timeline as T
from tidemark.operators import cohort as H

FIELDS = ("last", "min", "max", "delta", "slope", "n", "h_last", "sd", "cv")


def series(spark, rows, fam="x"):
    return spark.createDataFrame([(1, fam, float(t), float(v)) for t, v in rows], "entity long, fam string, hr double, val double")


def points(spark, *ts):
    return spark.createDataFrame([(1, float(t)) for t in ts], "entity long, t_hr double")


def test_window_edges_and_statistics(spark):
    s = series(spark, [(24.0, 5.0), (24.5, 1.0), (36, 2.0), (48, 4.0)])
    for out in (K.window_features(points(spark, 48), s, ["entity"], ["x"]),
                K.window_features_exact(points(spark, 48), s, ["entity"], 24.0)):
        got = out.first()
        assert (got["last"], got["min"], got["max"], got["delta"], got["n"], got["h_last"]) == (4, 1, 4, 3, 3, 0)
        assert got["slope"] == pytest.approx(0.1279420640) and got["sd"] == pytest.approx(1.5275252317) and got["cv"] == pytest.approx(0.6546536708)


def test_single_value_window(spark):
    got = K.window_features(points(spark, 48), series(spark, [(36, 2.0)]), ["entity"], ["x"]).first()
    assert (got["slope"], got["sd"], got["cv"], got["n"]) == (0.0, None, None, 1)


def test_equal_times_have_zero_slope(spark):
    got = K.window_features(points(spark, 48), series(spark, [(36, 2.0), (36, 5.0)]), ["entity"], ["x"]).first()
    assert got["slope"] == 0.0 and got["last"] == 5.0 and got["delta"] == 3.0


def test_empty_window_is_null(spark):
    got = K.window_features(points(spark, 48), series(spark, [(3, 2.0)]), ["entity"], ["x"]).first()
    assert [got[f] for f in FIELDS] == [None] * 9 and got["locf"] == 2.0 and got["locf_age"] == 45.0


def test_binned_features_equal_the_range_join(spark):
    rng = np.random.default_rng(2)
    rows = [(int(e), f, float(t), float(v)) for e, f, t, v in zip(rng.integers(0, 4, 600), rng.choice(["x", "y"], 600), np.round(rng.uniform(0, 120, 600), 1), rng.normal(1000, 0.01, 600))]
    s = spark.createDataFrame(rows, "entity long, fam string, hr double, val double")
    g = spark.createDataFrame([(e, float(t)) for e in range(4) for t in range(24, 121, 6)], "entity long, t_hr double")
    a = K.window_features(g, s, ["entity"], ["x", "y"], 24.0, locf=False).filter("n IS NOT NULL").toPandas().set_index(["entity", "fam", "t_hr"]).sort_index()
    b = K.window_features_exact(g, s, ["entity"], 24.0).toPandas().set_index(["entity", "fam", "t_hr"]).sort_index()
    assert len(a) == len(b)
    for f in FIELDS:
        np.testing.assert_allclose(a[f].astype(float), b[f].astype(float), rtol=1e-6, atol=1e-9)


def test_locf(spark):
    got = T.as_of(points(spark, 30), series(spark, [(10, 1.0), (24, 3.0), (31, 9.0)]), ["entity"], width=5.0).first()
    assert (got.locf, got.locf_age) == (3.0, 6.0)
    early = T.as_of(points(spark, 5), series(spark, [(10, 1.0)]), ["entity"]).first()
    assert early.locf is None


def test_as_of_and_totals_against_brute_force(spark):
    rng = np.random.default_rng(4)
    t, v = np.round(rng.uniform(0, 100, 300), 1), np.round(rng.random(300), 3)
    s = series(spark, list(zip(t, v)))
    at = [0.0, 0.05, 3.0, 7.5, 24.0, 48.0, 99.9, 140.0]
    for width in (0.7, 24.0):
        a = {r.t_hr: r for r in T.as_of(points(spark, *at), s, ["entity"], width=width).collect()}
        b = {r.t_hr: r for r in T.running_total(points(spark, *at), s, ["entity"], "t_hr", "hr", {"n": F.lit(1), "s": F.col("val")}, width).collect()}
        for x in at:
            m = t <= x
            assert b[x].n == m.sum() and b[x].s == pytest.approx(v[m].sum())
            assert a[x].locf == (v[m & (t == t[m].max())].max() if m.any() else None)


def test_intervals(spark):
    iv = spark.createDataFrame([(1, 10.0, 20.0), (1, 15.0, 18.0), (1, 30.0, 30.0)], "entity long, start_hr double, end_hr double")
    got = {r.t_hr: r.on for r in T.interval_active(points(spark, 9, 10, 16, 19, 20, 30), iv, ["entity"], width=4.0).collect()}
    assert got == {9.0: 0, 10.0: 1, 16.0: 1, 19.0: 1, 20.0: 0, 30.0: 0}


def test_look_back_includes_its_border(spark):
    rng = np.random.default_rng(7)
    t = np.r_[0.0, 48.0, np.round(rng.uniform(0, 300, 200), 1)]
    v = np.r_[-5.0, 1.0, rng.random(200)]
    for back in (48.0, 2.5):
        got = T.look_back(series(spark, list(zip(t, v))), ["entity"], "hr", {"low": ("min", "val"), "n": ("sum", "val")}, back).collect()
        for r in got:
            m = (t >= r.hr - back - 1e-12) & (t <= r.hr)
            assert r.low == v[m].min() and r.n == pytest.approx(v[m].sum())


def test_baseline_branches(spark):
    got = K.baseline(series(spark, [(-5, 0.6), (3, 1.1), (24, 0.9), (25, 0.5)]), ["entity"]).first()
    assert (got.base, got.branch) == (0.9, "window")
    got = K.baseline(series(spark, [(-30, 0.2), (-5, 0.6), (25, 0.5)]), ["entity"], earliest=-24.0).first()
    assert (got.base, got.branch) == (0.6, "before")
    assert K.baseline(series(spark, [(25, 0.5)]), ["entity"]).first().branch == "none"


def axis_of(spark, rows, stop=None):
    s = series(spark, rows).select("entity", "hr", "val")
    e = spark.createDataFrame([(1, 100.0)], "entity long, los_h double")
    iv = None if stop is None else spark.createDataFrame([(1, float(stop))], "entity long, hr double")
    return K.event_axis(e, s, ["entity"], iv).first()


def test_status_order(spark):
    assert axis_of(spark, [(3, 1.0), (40, 1.6)]).status == "event"
    assert axis_of(spark, [(3, 1.0), (40, 1.6)]).event_hr == 40.0
    assert axis_of(spark, [(3, 1.0), (40, 1.1)]).status == "no_event"
    assert axis_of(spark, [(3, 1.0), (20, 1.5)]).status == "prevalent_or_no_base"
    assert axis_of(spark, [(30, 1.0)]).status == "prevalent_or_no_base"
    assert axis_of(spark, [(-10, 2.0), (3, 1.0)]).status == "carried_in"
    assert axis_of(spark, [(3, 1.0), (40, 1.6)], stop=20).status == "stopped_before"
    assert axis_of(spark, [(3, 1.0), (40, 1.6)], stop=35).status == "no_event"
    assert axis_of(spark, [(3, 1.0), (40, 1.6)], stop=45).onset_hr == 40.0


def test_rise_needs_only_half_the_fold(spark):
    assert axis_of(spark, [(3, 1.0), (40, 1.31)]).event_hr == 40.0
    assert axis_of(spark, [(3, 1.0), (52, 1.31)]).status == "no_event"  # 49 h later: outside the look-back


def grid_of(spark, los, onset=None, include=False):
    df = spark.createDataFrame([(1, float(los), None if onset is None else float(onset), None)], "entity long, los_h double, onset_hr double, stop_hr double")
    return [r.t_hr for r in K.grid(df, include_onset=include).orderBy("t_hr").collect()]


def test_grid_ends(spark):
    assert grid_of(spark, 50.9) == [24, 30, 36, 42]
    assert grid_of(spark, 30.0) == [24] and grid_of(spark, 29.9) == []
    assert grid_of(spark, 80, 36) == [24, 30] and grid_of(spark, 80, 36, True) == [24, 30, 36]
    assert grid_of(spark, 500)[-1] == 168


def stages(spark, base, rows, **kw):
    g = spark.createDataFrame([(1, float(t), base) for t in (24, 30, 36)], "entity long, t_hr double, base double")
    s = series(spark, rows).select("entity", "hr", "val")
    return [r.stage for r in K.stage_labels(g, s, ["entity"], **kw).orderBy("t_hr").collect()]


def test_stage_labels(spark):
    assert stages(spark, 1.0, [(24, 1.0), (36, 1.5)]) == [1, 1, 1]
    assert stages(spark, 3.8, [(24, 4.0)]) == [0, 0, 0]
    assert stages(spark, 3.8, [(24, 4.0)], legacy=True)[0] == 3
    assert stages(spark, 1.0, [(24, 2.1)], include_current=False) == [0, 0, 0]
    assert stages(spark, 1.0, [(30, 3.0)]) == [3, 3, 0]
    assert stages(spark, 1.0, [(43, 9.0)]) == [0, 0, 0]  # a bin that is not on the grid is not seen


def test_covered_buckets(spark):
    full = [(h + 0.5, 10.0) for h in range(6)] + [(2.9, 99.0)] + [(h, 1.0) for h in (6, 7, 8, 9, 10)]
    got = {r.bucket: r for r in T.covered_buckets(series(spark, full), ["entity"]).collect()}
    assert got[0].evaluable == 1 and got[0].total == 10 * 5 + 99 and got[1].evaluable == 0


@pytest.mark.parametrize("flags, runs", [([1, 1, 0, 1], 2), ([0, 1, 0, 1], 2), ([0, 0], 0), ([1, 1, 1], 1)])
def test_episode_runs(spark, flags, runs):
    df = spark.createDataFrame([(1, float(i), f) for i, f in enumerate(flags)], "entity long, t_hr double, f int")
    assert T.episodes(df, ["entity"], "t_hr", F.col("f") == 1).first().episodes == runs


def test_comorbidity_rules(spark):
    codes = spark.createDataFrame([(1, "I252"), (1, "E112"), (2, "C341"), (2, "C78"), (3, "K704"), (3, "K73"), (4, "Z00")], "entity long, code string")
    got = {r.entity: r for r in H.category_flags(codes, ["entity"], "code", H.COMORBIDITY_ICD10).withColumn("score", H.comorbidity_score()).collect()}
    assert (got[1].myocardial_infarct, got[1].diabetes_with_cc, got[1].score) == (1, 1, 3)
    assert (got[2].malignant_cancer, got[2].metastatic_solid_tumor, got[2].score) == (1, 1, 6)
    assert got[3].score == 3 and got[4].score == 0
    nine = spark.createDataFrame([(1, "41001"), (1, "4255"), (2, "1749"), (2, "V434"), (3, "43")], "entity long, code string")
    got = {r.entity: r for r in H.category_flags(nine, ["entity"], "code", H.COMORBIDITY_ICD9).collect()}
    assert (got[1].myocardial_infarct, got[1].congestive_heart_failure, got[2].malignant_cancer, got[2].peripheral_vascular_disease) == (1, 1, 1, 1)
    assert sum(v for k, v in got[3].asDict().items() if k != "entity") == 0


def test_first_episode(spark):
    rows = [(1, 5.0, "ward", "icu"), (1, 50.0, "icu", "ward"), (1, 60.0, "ward", "icu"), (2, 5.0, "er", "icu"), (3, 5.0, "er", "ward")]
    df = spark.createDataFrame(rows, "entity long, t double, src string, dst string")
    ends = spark.createDataFrame([(1, None, 99.0), (2, None, 80.0)], "entity long, d1 double, d2 double")
    got = {r.entity: (r.start, r.end, r.los) for r in H.first_episode(df, "entity", "t", F.col("src") == "icu", F.col("dst") == "icu", ends, ["d1", "d2"]).collect()}
    assert got == {1: (5.0, 50.0, 45.0), 2: (5.0, 80.0, 75.0)}


def test_bin_onset_stops_before_the_end(spark):
    clock = K.Clock()
    base = spark.createDataFrame([(1, 1.0)], "entity long, base double")
    at_end = series(spark, [(clock.end, 100.0), (clock.start, 1.0)])
    assert K.onset_bin(at_end, base, ["entity"]).first()["onset_hr"] is None
    last = series(spark, [(clock.end - clock.step, 100.0), (clock.start, 1.0)])
    assert K.onset_bin(last, base, ["entity"]).first()["onset_hr"] == clock.end - clock.step
    first = series(spark, [(clock.start, 100.0)])
    assert K.onset_bin(first, base, ["entity"]).first()["onset_hr"] == clock.start


def test_values_at_one_time_give_one_summary(spark):
    tied = [(36.0, 3.0), (36.0, 1.0), (40.0, 7.0), (40.0, 2.0)]
    rows = {tuple(K.window_features(points(spark, 48), series(spark, order), ["entity"], ["x"]).first()) for order in (tied, tied[::-1])}
    assert len(rows) == 1


def test_a_baseline_of_zero_is_an_infinite_fold(spark):
    clock = K.Clock()
    s = spark.createDataFrame([(1, 3.0, 0.0), (1, 30.0, 0.5), (2, 3.0, 0.0), (2, 30.0, 0.0), (3, 3.0, 1.0), (3, 30.0, 1.0)], "entity long, hr double, val double")
    base = K.baseline(s, ["entity"], clock=clock)
    assert {r["entity"]: r["prevalent"] for r in K.prevalent(s, base, ["entity"], clock=clock).collect()} == {1: 1, 2: 1, 3: 0}
    assert {r["entity"]: r["onset_hr"] for r in K.onset_bin(s, base, ["entity"], clock=clock).collect()} == {1: 30.0, 2: 30.0, 3: None}
    stay = s.select("entity").distinct().withColumn("los_h", F.lit(100.0))
    assert {r["entity"]: r["status"] for r in K.event_axis(stay, s, ["entity"], clock=clock).collect()} == {1: "prevalent_or_no_base", 2: "prevalent_or_no_base", 3: "no_event"}
    assert {r["entity"]: r["status"] for r in K.bin_axis(stay, s, ["entity"], clock=clock).collect()} == {1: "prevalent", 2: "prevalent", 3: "no_event"}


def test_plain_statistics_equal_those_from_lists(spark):
    rows = [(f, float(h), float(h * 7 % 11)) for f in ("x", "z") for h in (*range(1, 30, 2), *range(40, 48))]
    s = spark.createDataFrame([(1, *r) for r in rows], "entity int, fam string, hr double, val double")
    grid = spark.createDataFrame([(1, float(t)) for t in range(24, 84, 6)], "entity int, t_hr double")
    names = ["entity", "fam", "t_hr", "last", "min", "max", "n", "h_last"]
    full = K.window_features(grid, s, ["entity"], ["x", "z", "none"], 24.0, locf=False).select(*names)
    plain = K.window_features(grid, s, ["entity"], ["x", "z", "none"], 24.0, locf=False, stats=names[3:])
    assert plain.columns == names and plain.dtypes == full.dtypes
    assert sorted(map(str, plain.collect())) == sorted(map(str, full.collect())) and plain.count() == 30
