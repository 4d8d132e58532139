"""Streams in several batches: rows out of order, rows behind the watermark, restarts, and timers that clear state."""

import datetime

from pyspark.sql import functions as F

from tidemark.streaming import replay as R
from tidemark.streaming import windows as S

T0 = datetime.datetime(2024, 1, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    # (hour of the event, batch it arrives in); the last one comes when the watermark is at 194 hours
    arrivals = [(1, 0), (30, 0), (29, 1), (26, 1), (200, 1), (5, 2), (197, 2), (300, 2)]
    rows = spark.createDataFrame([(1, "x", at(h), float(h), b) for h, b in arrivals], "entity long, fam string, ts timestamp, val double, batch int")

    def job(r):
        return S.trailing_windows(r, "entity", "fam", "ts", "val", "24 hours", "24 hours", "6 hours")

    done = R.late_rows(R.replay(rows, 3, job, str(tmp_path)), job(rows.drop("batch")), ["entity", "fam", "at"])
    got = {r["at"]: (r.n, r["min"], r["last"], r.late) for r in done.collect()}
    assert got == {at(24): (1, 1.0, 1.0, 1), at(48): (3, 26.0, 30.0, 0), at(216): (2, 197.0, 200.0, 0)}


def test_without_late_rows_the_restarted_stream_equals_the_batch(spark, tmp_path):
    rows = spark.range(400).selectExpr("id % 3 AS entity", "'x' AS fam", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, CAST((id * 37) % 400 AS int) * 30) AS ts", "CAST(id % 11 AS double) AS val")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))

    def job(r):
        return S.trailing_windows(r, "entity", "fam", "ts", "val", "12 hours", "6 hours", "6 hours")

    at_us = F.unix_micros("ts")
    first = rows.agg(F.min(at_us)).first()[0]
    hour = 3_600_000_000
    placed = R.by_arrival(rows, at_us + (F.hash("ts") % 3) * F.lit(hour), [first + h * hour for h in (50, 100, 150)])
    streamed = {(r.entity, r["at"]): tuple(r) for r in R.replay(placed, 4, job, str(tmp_path)).collect()}
    whole = {(r.entity, r["at"]): tuple(r) for r in job(rows).collect()}
    assert placed.select("batch").distinct().count() == 4
    assert len(streamed) > 60 and all(whole[k] == v for k, v in streamed.items())
    assert {k for k in whole if k not in streamed} == {k for k in whole if k[1] > max(at for _, at in streamed)}


def test_episodes_and_their_timers(spark, tmp_path):
    quiet = datetime.timedelta(hours=10)
    # entity, hour, score, batch: within a batch in any order
    data = [(1, 5, 0.9, 0), (1, 1, 0.9, 0), (2, 2, 0.9, 0), (2, 3, 0.1, 0), (1, 12, 0.9, 1), (3, 30, 0.9, 1), (1, 40, 0.9, 2), (3, 39, 0.9, 2), (2, 41, 0.9, 2), (3, 60, 0.2, 3), (4, 90, 0.9, 3)]
    rows = spark.createDataFrame([(e, at(h), p, b) for e, h, p, b in data] + [(None, at(91), 0.9, 3), (5, None, 0.9, 3), (6, at(90), None, 3)], "entity long, ts timestamp, p double, batch int")

    def job(r):
        return S.alert_episodes(r, "entity", "ts", "p", 0.5, quiet)

    done = R.replay(rows, 4, job, str(tmp_path), stateful=True)
    assert sorted((r.entity, r.started) for r in done.collect()) == [(1, at(1)), (1, at(40)), (2, at(2)), (2, at(41)), (3, at(30)), (4, at(90))]
    # Only the entity whose quiet time is still running keeps state.
    kept = spark.read.format("statestore").option("stateVarName", "latest_alert").load(str(tmp_path / "state"))
    assert [r.key[0] for r in kept.select("key").collect()] == [4]
