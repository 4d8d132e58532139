"""Time operators when one entity and one hour hold most of the rows: the same results, in pieces of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeline as T


@pytest.fixture(scope="module")
def busy(spark):
    rng = np.random.default_rng(11)
    rows = []
    for entity, n, lo, hi in ((1, 1500, 30, 31), (1, 300, 0, 200), (2, 200, 0, 200), (3, 100, 0, 200)):
        rows += [(entity, float(t), float(v)) for t, v in zip(np.round(rng.uniform(lo, hi, n), 3), np.round(rng.random(n), 3), strict=True)]
    rows += [(1, 30.5, float(v)) for v in np.round(rng.random(150), 3)]  # one instant
    at = [(e, float(t)) for e in (1, 2, 3, 4) for t in [*range(0, 240, 12), 30.2, 30.5, 30.501, 30.9999, 31.0]]
    return rows, spark.createDataFrame(rows, "entity long, hr double, val double").cache(), spark.createDataFrame(at, "entity long, t_hr double"), at


@pytest.mark.parametrize("limit", [40, 400])
def test_as_of_and_totals(busy, limit):
    rows, series, points, at = busy
    data = {e: np.array([(t, v) for k, t, v in rows if k == e]).reshape(-1, 2) for e in (1, 2, 3, 4)}
    last = {(r.entity, r.t_hr): r for r in T.as_of(points, series, ["entity"], rows_per_slot=limit).collect()}
    total = {(r.entity, r.t_hr): r for r in T.running_total(points, series, ["entity"], "t_hr", "hr", {"n": F.lit(1), "s": F.col("val")}, rows_per_slot=limit).collect()}
    assert set(last) == set(total) == set(at)
    for e, x in at:
        t, v = data[e].T
        m = t <= x
        assert total[e, x].n == m.sum() and total[e, x].s == pytest.approx(v[m].sum())
        assert last[e, x].locf == (v[m & (t == t[m].max())].max() if m.any() else None)


@pytest.mark.parametrize("back", [0.5, 48.0])
def test_look_back(busy, back):
    rows, series, _, _ = busy
    got = T.look_back(series, ["entity"], "hr", {"low": ("min", "val"), "high": ("max", "val"), "s": ("sum", "val")}, back, rows_per_slot=50)
    assert got.columns == ["entity", "hr", "val", "low", "high", "s"]
    got = got.collect()
    assert sorted((r.entity, r.hr, r.val) for r in got) == sorted(rows)
    data = {e: np.array([(t, v) for k, t, v in rows if k == e]) for e in (1, 2, 3)}
    for r in got[::7]:
        t, v = data[r.entity].T
        m = (t >= r.hr - back - 1e-9) & (t <= r.hr)
        assert (r.low, r.high) == (v[m].min(), v[m].max()) and r.s == pytest.approx(v[m].sum())


def test_pieces_are_bounded_and_instants_stay_whole(busy):
    _, series, _, _ = busy
    placed = series.withColumns({"_t": F.col("hr"), "_slot": T.time_slot("hr", 24.0)})
    (cut,), place = T.cut_busy([placed], ["entity"], rows_per_slot=100)
    assert place == ["_slot", "_piece"]
    sizes = {(r.entity, r["_slot"], r["_piece"]): r for r in cut.groupBy("entity", *place).agg(F.count("*").alias("n"), F.count_distinct("_t").alias("times")).collect()}
    assert sum(r.n for r in sizes.values()) == series.count()
    assert max(r.n for r in sizes.values() if r.times > 1) <= 200 + 150
    assert cut.groupBy("entity", "_t").agg(F.count_distinct("_piece").alias("k")).agg(F.max("k")).first()[0] == 1
    order = [(r.lo, r.hi) for r in cut.filter("entity = 1 AND _slot = 1").groupBy("_piece").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).orderBy("_piece").collect()]
    assert len(order) > 8 and all(a[1] < b[0] for a, b in zip(order, order[1:], strict=False))
    assert T.cut_busy([placed], ["entity"], rows_per_slot=10**6)[1] == ["_slot"]


def test_nulls_and_empty_tables(spark):
    schema = "entity long, hr double, val double"
    some = spark.createDataFrame([(None, 1.0, 2.0), (None, 1.5, 3.0), (None, 1.7, 1.0), (5, None, 1.0), (5, None, 2.0), (5, None, 3.0)], schema)
    rows = {(r.entity, r.hr): r.low for r in T.look_back(some, ["entity"], "hr", {"low": ("min", "val")}, 1.0, rows_per_slot=2).collect()}
    assert (rows[None, 1.0], rows[None, 1.5], rows[None, 1.7]) == (2.0, 2.0, 1.0)
    none = spark.createDataFrame([], schema)
    points = spark.createDataFrame([(1, 2.0)], "entity long, t_hr double")
    assert T.as_of(points, none, ["entity"], rows_per_slot=1).first().locf is None
    assert T.look_back(none, ["entity"], "hr", {"low": ("min", "val")}, 1.0, rows_per_slot=1).count() == 0
