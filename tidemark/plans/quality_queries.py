"""Queries for expectations, reconciliation and the metric ledger (Q1-Q8, M14), and the streaming jobs (ST1, ST2)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidemark.operators import alerts as AL
from tidemark.operators import calibration as C
from tidemark.operators import discrimination as D
from tidemark.operators import quality as Q
from tidemark.plans.alert_queries import SWEEP, alerts_sql
from tidemark.plans.fixtures import THRESHOLDS, endpoints, predictions, r, rounded, scratch, table, with_ctes
from tidemark.plans.registry import query
from tidemark.plans.timeline_queries import auc_sql
from tidemark.streaming import replay as R
from tidemark.streaming import windows as S


@query("Q1_expectations", with_ctes("SELECT metric, expected, tolerance, got, (coalesce(abs(got - expected) <= tolerance, false))::INT AS ok FROM (VALUES ('lines', 4.0::DOUBLE, 0.5::DOUBLE), ('rate', 0.33::DOUBLE, 0.02::DOUBLE), ('absent', 1.0::DOUBLE, 0.0::DOUBLE)) e(metric, expected, tolerance) "
                                    "LEFT JOIN (SELECT 'lines' AS metric, round(count(*)::DOUBLE / count(DISTINCT l_orderkey), 6) AS got FROM lineitem UNION ALL SELECT 'rate', round(avg((l_returnflag = 'R')::INT), 6) FROM lineitem) USING (metric)"))
def expectations(spark, sf):
    per = table(spark, sf, "lineitem").agg(F.round(F.count("*") / F.countDistinct("l_orderkey"), 6).alias("lines"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), 6).alias("rate"))
    want = Q.expectations(spark, [("lines", 4.0, 0.5), ("rate", 0.33, 0.02), ("absent", 1.0, 0.0)])
    return Q.check(Q.long_metrics(per, ["lines", "rate"]), want)


def stored_metrics(spark, sf):
    """A metric table written earlier: AUROC and Brier score per endpoint."""
    e = endpoints(spark, sf)
    auc = Q.long_metrics(D.auroc(e, by=["endpoint"]), ["n_pos", "auroc"], ["endpoint"])
    return auc.unionByName(Q.long_metrics(C.brier(e, by=["endpoint"]), ["brier"], ["endpoint"]))


@query("Q2_reproduction_block", with_ctes(f"WITH a AS ({auc_sql('ends', by='endpoint')}), b AS (SELECT endpoint, {r('avg((p - y) * (p - y))')} AS v FROM ends GROUP BY 1) SELECT endpoint, 'n_pos' AS metric, n_pos::DOUBLE AS expected, n_pos::DOUBLE AS got, 1 AS ok FROM a UNION ALL SELECT endpoint, 'auroc', auroc, auroc, 1 FROM a UNION ALL SELECT endpoint, 'brier', v, v, 1 FROM b", "ends"))
def reproduction(spark, sf):
    path = scratch(spark, "metrics")
    stored_metrics(spark, sf).write.parquet(path)
    stored = spark.read.parquet(path).withColumnRenamed("value", "expected").withColumn("tolerance", F.lit(1e-9))
    # The second route: the area under the curve from the curve points, the error from score counts.
    e = endpoints(spark, sf)
    auc = Q.long_metrics(D.discrimination(e, by=["endpoint"]), ["n_pos", "auroc"], ["endpoint"])
    counts = C.score_counts(e, by=["endpoint"])
    sq = F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + (F.col("n") - F.col("pos")) * F.col("p") * F.col("p")
    err = Q.long_metrics(counts.groupBy("endpoint").agg((F.sum(sq) / F.sum("n")).alias("brier")), ["brier"], ["endpoint"])
    out = Q.check(auc.unionByName(err), stored, ["endpoint", "metric"])
    return rounded(out.select("endpoint", "metric", "expected", "got", "ok"))


@query("Q3_independent_recount", with_ctes("SELECT threshold, CAST(sum(captured) AS BIGINT) AS claim, CAST(sum(captured) AS BIGINT) AS got, 1 AS ok FROM (" + alerts_sql() + ") GROUP BY 1", "pred"))
def recount(spark, sf):
    pr = predictions(spark, sf)
    claim = AL.deployment(AL.entity_alerts(pr, THRESHOLDS)).select("threshold", F.col("n_captured").alias("claim"))
    # Another route: alerts joined to the anchors, then distinct entities.
    anchors = pr.filter("y = 1").groupBy("entity").agg(F.max("t_hr").alias("anchor"))
    hits = AL.at_thresholds(pr, THRESHOLDS).filter(F.col("p") >= F.col("threshold")).join(anchors, "entity").filter(F.col("t_hr") < F.col("anchor"))
    got = hits.groupBy("threshold").agg(F.count_distinct("entity").alias("got"))
    return claim.join(got, "threshold", "left").withColumn("ok", F.when(F.col("claim") == F.col("got"), 1).otherwise(0))


@query("Q4_key_report", "SELECT CAST(sum((a > 1)::INT) AS BIGINT) AS left_duplicates, CAST(sum((b > 1)::INT) AS BIGINT) AS right_duplicates, CAST(sum((a IS NOT NULL AND b IS NOT NULL)::INT) AS BIGINT) AS matched, CAST(sum((b IS NULL)::INT) AS BIGINT) AS left_only, CAST(sum((a IS NULL)::INT) AS BIGINT) AS right_only, CAST(sum((a IS NOT NULL AND v = 0)::INT) AS BIGINT) AS missing_after_match FROM (SELECT doc_id, count(*) AS a FROM documents GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS b, count(quality) AS v FROM labels GROUP BY 1) USING (doc_id)")
def key_report(spark, sf):
    return Q.key_report(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], "quality")


@query("Q5_monotone_in_threshold", with_ctes(f"WITH a AS (SELECT threshold, sum(captured) AS c FROM ({alerts_sql('pred', SWEEP)}) GROUP BY 1), b AS (SELECT c - lag(c) OVER (ORDER BY threshold) AS s FROM a) SELECT count(*) AS n, CAST(sum(coalesce(s > 0, false)::INT) AS BIGINT) AS violations, (sum(coalesce(s > 0, false)::INT) = 0)::INT AS ok FROM b", "pred"))
def monotone(spark, sf):
    return Q.monotone(AL.deployment(AL.entity_alerts(predictions(spark, sf), SWEEP)), "threshold", "n_captured")


@query("Q5_parts_equal_total", "SELECT o_orderstatus, count(*) AS sum_of_parts, count(*) AS total, 1 AS ok FROM orders GROUP BY 1")
def parts_total(spark, sf):
    od = table(spark, sf, "orders")
    parts = od.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return Q.parts_equal_total(parts, od.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "n", ["o_orderstatus"])


@query("Q6_metric_ledger", with_ctes(f"WITH a AS ({auc_sql('ends', by='endpoint')}) SELECT endpoint, 'n_pos' AS metric, n_pos::DOUBLE AS \"value\", 'predictions' AS source, 'discrimination.n_pos' AS field FROM a UNION ALL SELECT endpoint, 'auroc', auroc, 'predictions', 'discrimination.auroc' FROM a", "ends"))
def ledger(spark, sf):
    out = Q.long_metrics(D.auroc(endpoints(spark, sf), by=["endpoint"]), ["n_pos", "auroc"], ["endpoint"], "predictions", "discrimination")
    return rounded(out)


@query("Q7_membership", "SELECT l_linestatus, count(*) AS n, count(k) AS found, count(*) - count(k) AS lost FROM lineitem LEFT JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = k GROUP BY 1")
def membership(spark, sf):
    small = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linestatus")
    large = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return Q.membership(small, large, ["k"], "l_linestatus")


@query("Q8_label_agreement", with_ctes(f"SELECT count(*) AS n, CAST(sum((y = ge2)::INT) AS BIGINT) AS agree, {r('avg((y = ge2)::INT)')} AS rate FROM pred", "pred"))
def label_agreement(spark, sf):
    pr = predictions(spark, sf)
    return rounded(Q.agreement(pr, pr.select("entity", "t_hr", F.col("ge2").alias("y")), ["entity", "t_hr"], "y"))


# ---------------------------------------------------------------- streaming


def event_stream(spark, sf):
    static = table(spark, sf, "events")
    return spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf)


def run_once(stream, mode: str, name: str, stateful: bool = False):
    """Drive a stream over everything that is there, into a parquet folder, and read the result back."""
    spark = stream.sparkSession
    path, check = scratch(spark, name), scratch(spark, f"{name}-state")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if stateful:
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if stateful:
            spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.parquet(path)


# Closed windows only: the watermark trails the newest event by the allowed lateness. Window ends are reported in hours.
@query("ST1_stream_windows", with_ctes("""
    WITH e AS (SELECT user_id AS entity, event_type AS fam, epoch_us(ts) - 1 AS u, "value" AS val FROM events), m AS (SELECT max(u) - 21600000000 AS mark FROM e),
         w AS (SELECT entity, fam, val, u, (u // 86400000000 + k) * 86400000000 AS e_us FROM e, (SELECT unnest([1, 2, 3]) AS k))
    SELECT entity, fam, (e_us - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS t_hr, count(*) AS n, min(val) AS min, max(val) AS max, arg_max(val, (u, val)) AS last FROM w, m WHERE e_us <= mark GROUP BY 1, 2, 3"""))
def stream_windows(spark, sf):
    out = S.trailing_windows(event_stream(spark, sf), "user_id", "event_type", "ts", "value", "72 hours", "24 hours", "6 hours")
    done = run_once(out, "append", "windows")
    hours = (F.unix_micros("at") - F.lit(1704067200000000)) / F.lit(3.6e9)
    return done.select(F.col("user_id").alias("entity"), F.col("event_type").alias("fam"), hours.alias("t_hr"), "n", "min", "max", "last")


@query("ST2_stream_first_alert", "SELECT user_id AS entity, epoch_us(min(ts)) AS first_alert_us FROM events WHERE \"value\" >= 120 GROUP BY 1")
def stream_first_alert(spark, sf):
    ev = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    done = run_once(S.alert_once(ev, "user_id", "ts", "value", 120.0), "append", "alerts", stateful=True)
    return done.select(F.col("user_id").alias("entity"), F.unix_micros("first_alert").alias("first_alert_us"))


SIX_DAYS = 144 * 3_600_000_000
BORDERS = [i * SIX_DAYS for i in range(1, 5)]
# Every twentieth event arrives ten days late, the others up to three hours.
_ARRIVALS = f"""
    WITH e AS (SELECT user_id AS entity, event_type AS fam, epoch_us(ts) - 1 AS u, "value" AS val,
                      epoch_us(ts) - 1704067200000000 + 3600000000 * CASE WHEN event_id % 20 = 7 THEN 240 ELSE event_id % 4 END AS arrival FROM events),
         a AS (SELECT *, least(4, arrival // {SIX_DAYS}) AS b FROM e),
         ends AS (SELECT b, max(u) - 21600000000 AS mark FROM a GROUP BY 1),
         marks AS (SELECT x.b, max(y.mark) AS mark FROM ends x LEFT JOIN ends y ON y.b < x.b GROUP BY 1),
         w AS (SELECT entity, fam, val, u, (u // 86400000000 + k) * 86400000000 AS e_us, b FROM a, (SELECT unnest([1, 2, 3]) AS k)),
         k AS (SELECT w.*, marks.mark IS NULL OR e_us > marks.mark AS kept FROM w JOIN marks USING (b))"""


@query("ST1_replayed_windows", with_ctes(_ARRIVALS + """
    SELECT entity, fam, (e_us - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS t_hr, count(*) FILTER (kept) AS n, min(val) FILTER (kept) AS min, max(val) FILTER (kept) AS max,
           arg_max(val, (u, val)) FILTER (kept) AS last, count(*) FILTER (NOT kept) AS late
    FROM k WHERE e_us <= (SELECT max(mark) FROM ends) GROUP BY 1, 2, 3 HAVING count(*) FILTER (kept) > 0"""))
def replayed_windows(spark, sf):
    """Five batches with rows out of order, restarted from the checkpoint between them; rows behind the watermark are counted."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    delay = F.when(F.col("event_id") % 20 == 7, 240).otherwise(F.col("event_id") % 4) * F.lit(3_600_000_000)
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000) + delay

    def job(rows):
        return S.trailing_windows(rows, "user_id", "event_type", "ts", "value", "72 hours", "24 hours", "6 hours")

    done = R.replay(R.by_arrival(ev, arrival, BORDERS), 5, job, scratch(spark, "replay"))
    counted = R.late_rows(done, job(ev), ["user_id", "event_type", "at"])
    hours = (F.unix_micros("at") - F.lit(1704067200000000)) / F.lit(3.6e9)
    return counted.select(F.col("user_id").alias("entity"), F.col("event_type").alias("fam"), hours.alias("t_hr"), "n", "min", "max", "last", "late")


@query("ST2_replayed_episodes", """
    SELECT entity, u AS started_us FROM (SELECT user_id AS entity, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE "value" >= 60)
    WHERE before IS NULL OR u - before >= 172800000000""")
def replayed_episodes(spark, sf):
    """First alerts of episodes with two quiet days between them, over five batches; timers clear the state of ended episodes."""
    ev = table(spark, sf, "events").select("ts", "user_id", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    done = R.replay(R.by_arrival(ev, at, BORDERS), 5, lambda rows: S.alert_episodes(rows, "user_id", "ts", "value", 60.0, datetime.timedelta(days=2)), scratch(spark, "episodes"), stateful=True)
    return done.select(F.col("user_id").alias("entity"), F.unix_micros("started").alias("started_us"))
