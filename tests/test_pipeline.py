"""Sources, sinks, splits, quality checks, models and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as C
from tidemark.operators import models as M
from tidemark.operators import quality as Q
from tidemark.operators import sampling as L
from tidemark.operators import summary as A
from tidemark.sources import readers as R
from tidemark.sources import writers as W
from tidemark.streaming import windows as S


def test_text_scan_keeps_unreadable_cells_as_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,val\n1,2.5\n2,"bad, cell"\n3,\n')
    df = R.read_text_table(spark, str(tmp_path / "a.csv"), ["id", "val"])
    assert [r.v for r in df.select(F.col("val").try_cast("double").alias("v")).collect()] == [2.5, None, None]


def test_extract_counts_rows_and_entities(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "entity long, v long")
    assert W.extract(df, str(tmp_path / "x"), "x", "entity") == {"name": "x", "rows": 3, "entities": 2}


def test_file_fingerprint(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    got = R.file_fingerprints(spark, str(tmp_path), "*.txt").first()
    assert got.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and got.bytes == 3


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    assert Q.fingerprint(a).first() == Q.fingerprint(a.orderBy(F.desc("a"))).first()
    assert Q.fingerprint(a).first() != Q.fingerprint(a.withColumn("b", F.lit("x"))).first()


def test_enforce_fails_the_job(spark):
    metrics = spark.createDataFrame([("n", 3.0)], "metric string, value double")
    good = Q.check(metrics, Q.expectations(spark, [("n", 3.0, 0.0)]))
    assert Q.enforce(good).first().ok == 1
    bad = Q.check(metrics, Q.expectations(spark, [("n", 4.0, 0.5), ("gone", 1.0, 0.0)]))
    assert {r.metric: r.ok for r in bad.collect()} == {"n": 0, "gone": 0}
    with pytest.raises(Exception, match="expectation failed"):
        Q.enforce(bad).collect()


def test_preferred_variant_and_best_value(spark):
    df = spark.createDataFrame([(1, "plain", 1.0, 5.0), (1, "best", 2.0, 6.0), (1, "best", 1.0, 7.0), (2, "plain", 1.0, 8.0)], "e long, label string, t double, v double")
    rank = F.when(F.col("label") == "best", 1).otherwise(2)
    assert sorted(r.v for r in C.preferred_variant(df, ["e"], rank).collect()) == [6.0, 7.0, 8.0]
    assert {r.e: r.v for r in C.best_single_value(df, "e", "v", rank, "t").collect()} == {1: 7.0, 2: 8.0}


@pytest.mark.parametrize("values, scaled", [([0.3, 0.4, 0.5], True), ([30.0, 40.0, 50.0], False), ([0.4, 0.5, 2.0, 40.0], True), ([1.0, 3.0], False)])
def test_scale_by_median(spark, values, scaled):
    df = spark.createDataFrame([("hct", v) for v in values] + [("other", 0.1)], "fam string, val double")
    got = C.scale_by_median(df, "hct").filter("fam = 'hct'").agg(F.sum("val")).first()[0]
    assert got == pytest.approx(sum(values) * (100 if scaled else 1))


def units(spark, n=997):
    return spark.createDataFrame([(i % 101, i, float(i)) for i in range(n)], "subject long, entity long, v double")


def test_split_is_exact_and_clean(spark):
    df = L.group_split(units(spark), "subject", 0.8)
    got = L.leakage(df, "subject").first()
    assert (got.train_subjects, got.test_subjects, got.shared_subjects) == (80, 21, 0)
    assert got.train_rows + got.test_rows == 997
    again = L.group_split(units(spark).repartition(7), "subject", 0.8)
    assert df.exceptAll(again).count() == 0
    assert L.leakage(L.group_split(units(spark), "entity", 0.7), "subject").first().shared_subjects > 50
    assert L.group_split(units(spark), "subject", 1.0).filter("split = 'test'").count() == 0


def test_folds_are_even_and_grouped(spark):
    df = L.group_folds(units(spark), "subject", 5)
    assert df.count() == 997 and df.select("subject", "fold").distinct().count() == 101
    sizes = [r["count"] for r in df.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 20


def test_cumulative_cut_is_the_smallest_prefix(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.05)], "feature string, share double")
    assert [r.feature for r in A.cumulative_cut(df, "feature", "share", 0.8).orderBy("position").collect()] == ["a", "b"]
    assert A.cumulative_cut(df, "feature", "share", 0.81).count() == 3


def test_pooling(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.3, 0.2)], "delta double, se double")
    got = A.pool(df).first()
    assert got.pooled == pytest.approx(0.14) and got.q == pytest.approx(0.8) and got.i2 == 0.0 and got.se_fixed == pytest.approx(0.0894427191)


# ---------------------------------------------------------------- models

QUICK = M.TreeSettings(trees=3, rate=0.3, depth=2)


def training(spark, n=300):
    rows = [(i % 60, float(i), float(i % 7) if i % 5 else None, float(i % 3), int(i % 7 > 3)) for i in range(n)]
    return spark.createDataFrame(rows, "entity long, t_hr double, a double, b double, y int")


def test_trees_survive_missing_and_absent_features(spark, tmp_path):
    df = training(spark)
    model = M.train_trees(df, ["a", "b"], "y", QUICK)
    full, absent = M.apply_trees(df, model), M.apply_trees(df.drop("b"), model)
    assert full.count() == 300 and absent.filter("p IS NULL OR p < 0 OR p > 1").count() == 0
    # Column order does not matter.
    shuffled = M.apply_trees(df.select("y", "b", "a", "t_hr", "entity"), model)
    assert full.select("t_hr", "p").exceptAll(shuffled.select("t_hr", "p")).count() == 0
    M.save(model, str(tmp_path / "m"), 0.1, 0.9)
    again, a, b = M.load(spark, str(tmp_path / "m"))
    assert (again.features, a, b) == (("a", "b"), 0.1, 0.9)
    assert M.apply_trees(df, again).select("t_hr", "p").exceptAll(full.select("t_hr", "p")).count() == 0


def test_out_of_fold_scores_every_row_once(spark):
    df = L.group_folds(training(spark), "entity", 3)
    got = M.out_of_fold(df, ["a", "b"], "y", "fold", 3, QUICK)
    assert got.count() == 300 and got.select("t_hr").distinct().count() == 300


def test_score_rows_coerces_text(spark):
    df = training(spark)
    model = M.train_trees(df, ["a", "b"], "y", QUICK)
    raw = df.select("entity", "t_hr", F.col("a").cast("string").alias("a"), F.when(F.col("t_hr") < 5, "n/a").otherwise(F.col("b").cast("string")).alias("b"))
    got = M.score_rows(raw, model, model, 0.0, 1.0)
    assert got.columns == ["entity", "t_hr", "p_raw", "p_rec", "p_severe", "band"]
    assert got.filter("abs(p_raw - p_rec) > 1e-9 OR band NOT IN (0, 1, 2)").count() == 0


def test_bedside_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.5, 1.0, 54.0), (0.0, 1.0, 3.0, 1.0, 4.0)], "base double, cur double, low double, first double, hour double")
    f = M.bedside_features("base", "cur", "low", "first", "hour")
    a, b = df.select(*[c.alias(n) for n, c in f.items()]).collect()
    assert (a.cr_ratio_base, a.cr_delta_since_adm, a.cr_min, a.cr_delta48) == (2.0, 1.0, 1.5, 1.0)
    import numpy as np

    assert a.cr_slope48 == pytest.approx(np.polyfit([6, 42, 54], [1.0, 1.5, 2.0], 1)[0]) and a.cr_sd48 == pytest.approx(np.std([1.0, 1.5, 2.0], ddof=1))
    assert b.cr_base == 0.1 and b.cr_min == 1.0 and b.cr_slope48 == 0.0  # span 6 h: two points only


# ---------------------------------------------------------------- streams


def test_stream_windows_match_the_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, "x", t0 + datetime.timedelta(hours=h), float(v)) for h, v in ((24, 5), (24.5, 1), (36, 2), (48, 4), (90, 7), (200, 1))]
    spark.createDataFrame(rows, "entity long, fam string, ts timestamp, val double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity long, fam string, ts timestamp, val double").parquet(str(tmp_path / "in"))
    q = (S.trailing_windows(stream, "entity", "fam", "ts", "val").writeStream.outputMode("append").format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).filter(F.col("at") == F.lit(t0 + datetime.timedelta(hours=48))).first()
    assert (got.n, got.min, got.max, got["last"], got.delta) == (3, 1.0, 4.0, 4.0, 3.0)  # the 24.0 row is outside


def test_first_alert_aggregate(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t0, 0.1), (1, t0 + datetime.timedelta(hours=2), 0.4), (1, t0 + datetime.timedelta(hours=1), 0.3)], "entity long, ts timestamp, p double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity long, ts timestamp, p double").parquet(str(tmp_path / "in"))
    q = S.first_alerts(stream, "entity", "ts", "p", 0.2).writeStream.outputMode("complete").format("memory").queryName("first_alerts").start()
    q.processAllAvailable()
    q.stop()
    assert [r.first_alert for r in spark.table("first_alerts").collect()] == [t0 + datetime.timedelta(hours=1)]


def test_rows_of_several_fits_are_kept_only_while_they_run(spark, monkeypatch):
    df = spark.range(200).selectExpr("cast(id % 7 as double) AS a", "cast(id % 5 as double) AS b", "cast(id % 2 as int) AS y", "cast(id % 2 as int) AS z")
    seen = []
    monkeypatch.setattr(M, "train_trees", lambda rows, features, y, settings: seen.append((rows.columns, rows.storageLevel.useMemory)) or y)
    assert M.endpoint_models(df, ["a", "b"], ["y", "z"], QUICK) == {"y": "y", "z": "z"}
    assert seen == [(["a", "b", "y", "z"], True)] * 2 and not df.select("a", "b", "y", "z").storageLevel.useMemory
