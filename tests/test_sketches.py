"""Rank sketches against exact ranks: error, merging, storage, and groups with nothing in them."""

import math

import numpy as np
import pytest

from tidemark.operators import models as M
from tidemark.operators import sketches as S

PROBS = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(40_000) < 0.3, 7.0, np.round(rng.lognormal(1, 2, 40_000), 3))  # one value holds a third of the rows
    day, g = rng.integers(0, 20, 40_000), rng.choice(["a", "b"], 40_000, p=[0.9, 0.1])
    data = [(str(gi), int(d), float(x)) for gi, d, x in zip(g, day, v, strict=True)]
    return spark.createDataFrame([*data, ("a", 1, None), ("b", 2, math.nan), ("none", 3, None), (None, 4, 1.5)], "g string, day int, v double").cache(), data


def held(rows, answers, by):
    errors = {tuple(r[b] for b in by): r for r in S.measured_errors(rows, "v", answers, PROBS, by).collect()}
    assert all(r[f"e_{k}"] <= 2 * S.rank_error(400) for r in errors.values() for k in PROBS)
    return errors


def test_answers_are_within_the_stated_error(rows):
    df, data = rows
    answers = S.sketched_quantiles(S.rank_sketches(df, "v", ["g"], 400), {"lo": 0.0, **PROBS, "hi": 1.0}, ["g"])
    answers = df.sparkSession.createDataFrame(answers.collect(), answers.schema)
    held(df, answers, ["g"])
    got = {r.g: r for r in answers.collect()}
    for g in ("a", "b"):
        mine = np.array([x for gi, _, x in data if gi == g])
        assert (got[g].n, got[g].lo, got[g].hi) == (len(mine), mine.min(), mine.max())
        for k, p in PROBS.items():
            assert (mine < got[g][k]).mean() - 2 * S.rank_error(400) <= p <= (mine <= got[g][k]).mean() + 2 * S.rank_error(400)
    assert (got["none"].n, got["none"].p50) == (0, None)
    assert (got[None].n, got[None].p50) == (1, 1.5)


def test_stored_days_merge_to_groups_and_to_one(spark, rows, tmp_path):
    df, data = rows
    S.rank_sketches(df, "v", ["g", "day"], 400).write.parquet(str(tmp_path / "daily"))
    daily = spark.read.parquet(str(tmp_path / "daily"))
    for by in (["g"], []):
        merged = S.sketched_quantiles(S.merge_sketches(daily, by), PROBS, by)
        merged = spark.createDataFrame(merged.collect(), merged.schema)
        held(df, merged, by)
        assert sum(r.n for r in merged.collect()) == len(data) + 1
    sizes = [len(r.sketch) for r in daily.collect() if r.sketch is not None]
    assert max(sizes) < 20 * 400


def test_empty_table_and_larger_sketches(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert S.rank_sketches(none, "v", ["g"]).count() == 0
    whole = S.sketched_quantiles(S.merge_sketches(S.rank_sketches(none, "v")), PROBS).first()
    assert (whole.n, whole.p50) == (0, None)
    assert S.rank_error(200) == pytest.approx(0.0133, abs=1e-4)
    assert S.rank_error(1600) < S.rank_error(400) / 3


def test_share_below(spark):
    df = spark.range(1, 1001).selectExpr("CAST(id AS double) AS v")
    share = S.rank_sketches(df, "v").select(S.share_below("sketch", 250.0).alias("s")).first().s
    assert abs(share - 0.25) <= 2 * S.rank_error()


def test_catalogue_from_sketches(spark):
    df = spark.range(5000).selectExpr("CAST(id % 1000 AS double) AS a", "IF(id % 4 = 0, NULL, CAST(id AS double) / 5000) AS b", "CAST(NULL AS double) AS c")
    exact = {r.feature: r for r in M.feature_catalogue(df, ["a", "b", "c"]).collect()}
    near = {r.feature: r for r in M.feature_catalogue(df, ["a", "b", "c"], sketch_size=400).collect()}
    for f in "abc":
        assert [near[f][c] for c in ("min", "max", "step", "missing_share")] == [exact[f][c] for c in ("min", "max", "step", "missing_share")]
    assert abs(near["a"].default - exact["a"].default) <= 2 * S.rank_error(400) * 1000
    assert near["c"].default is None
