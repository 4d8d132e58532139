"""Queries for alert performance and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import alerts as AL
from tidemark.operators import checkpoints as K
from tidemark.plans.checkpoint_queries import two_onsets
from tidemark.plans.cleaning_queries import P_REC
from tidemark.plans.fixtures import LAYER, THRESHOLDS, predictions, r, rounded, table, with_ctes
from tidemark.plans.metric_queries import diagnostic_rows, subtype_rows, _DIAG, _SUBROWS
from tidemark.plans.registry import query

SWEEP = tuple(round(0.03 + 0.01 * i, 2) for i in range(28))


def alerts_sql(source: str = "pred", thresholds=THRESHOLDS, anchor: str | None = None, score: str = "p", by: str = "") -> str:
    """One row per entity and threshold."""
    ths = ", ".join(repr(t) for t in thresholds)
    head = f"{by}, " if by else ""
    at = anchor or "max(CASE WHEN y = 1 THEN t_hr END)"
    return (f"SELECT *, (anchor IS NOT NULL)::INT AS event, (first_alert IS NOT NULL)::INT AS alerted, coalesce(first_alert < anchor, false)::INT AS captured, CASE WHEN first_alert < anchor THEN anchor - first_alert END AS lead "
            f"FROM (SELECT {head}entity, threshold, max(CASE WHEN y = 1 THEN t_hr END) AS last_pos, min(CASE WHEN y = 1 THEN t_hr END) AS first_pos, max(t_hr) AS t_last, min(t_hr) AS t_first, count(*) AS n_rows, max({score}) AS max_p, "
            f"{at} AS anchor, min(CASE WHEN {score} >= threshold THEN t_hr END) AS first_alert FROM {source}, (SELECT unnest([{ths}]::DOUBLE[]) AS threshold) GROUP BY {head}entity, threshold)")


DEPLOY = (f"count(*) AS n_entities, CAST(sum(event) AS BIGINT) AS n_event, CAST(sum(captured) AS BIGINT) AS n_captured, CAST(sum(alerted) AS BIGINT) AS n_alerted, CAST(sum((alerted = 1 AND event = 0)::INT) AS BIGINT) AS n_false, "
          f"{r('sum(CASE WHEN event = 0 THEN greatest(t_last, 6) ELSE greatest(coalesce(first_pos, anchor), 6) END / 24)', 4)} AS days, {r('sum(captured) / nullif(sum(event), 0)::DOUBLE')} AS capture, {r('quantile_cont(lead, 0.25)')} AS lead_p25, "
          f"{r('quantile_cont(lead, 0.5)')} AS lead_median, {r('quantile_cont(lead, 0.75)')} AS lead_p75, {r('sum(alerted) / nullif(sum(captured), 0)::DOUBLE')} AS nne, "
          f"{r('100 * sum((alerted = 1 AND event = 0)::INT) / sum(CASE WHEN event = 0 THEN greatest(t_last, 6) ELSE greatest(coalesce(first_pos, anchor), 6) END / 24)')} AS fa_per_100_days, "
          f"{r('100 * sum(alerted) / count(*)::DOUBLE')} AS pct_alerted, {r('count(*) FILTER (lead > 48) / nullif(sum(captured), 0)::DOUBLE')} AS lead_over_48_share")


def recalibrated(spark, sf):
    return predictions(spark, sf).withColumn("p", N.recalibrate("p", *LAYER))


REC = f"rec AS MATERIALIZED (SELECT * REPLACE ({P_REC} AS p) FROM pred)"
REC_THRESHOLDS = (0.16, 0.22, 0.28)


@query("D1_deployment", with_ctes(f"WITH {REC}, a AS ({alerts_sql('rec', REC_THRESHOLDS)}) SELECT threshold, {DEPLOY} FROM a GROUP BY 1", "pred"))
def deployment(spark, sf):
    out = rounded(AL.deployment(AL.entity_alerts(recalibrated(spark, sf), REC_THRESHOLDS)))
    return out.withColumn("days", F.round("days", 4))


@query("D2_threshold_sweep", with_ctes(f"WITH a AS ({alerts_sql('pred', SWEEP)}) SELECT threshold, {DEPLOY} FROM a GROUP BY 1", "pred"))
def sweep(spark, sf):
    out = rounded(AL.deployment(AL.entity_alerts(predictions(spark, sf), SWEEP)))
    return out.withColumn("days", F.round("days", 4))


@query("D3_criterion_anchor", with_ctes(f"WITH c AS (SELECT *, min(CASE WHEN x1 >= 0.09 THEN t_hr END) OVER (PARTITION BY entity) AS crit FROM pred), a AS ({alerts_sql('c', anchor='min(crit)')}) SELECT threshold, {DEPLOY} FROM a GROUP BY 1", "pred"))
def criterion(spark, sf):
    pr = predictions(spark, sf).withColumn("crit", F.when(F.col("x1") >= 0.09, F.col("t_hr")))
    out = rounded(AL.deployment(AL.entity_alerts(pr, THRESHOLDS, anchor="crit")))
    return out.withColumn("days", F.round("days", 4))


def view_rows(spark, sf):
    """Grid rows with an onset and a score from a trailing feature."""
    return subtype_rows(spark, sf).select("entity", "t_hr", "onset_hr", "subtype", (F.col("p") / 500.0).alias("p"))


VIEW = (0.2, 0.3)


@query("D4_four_view", with_ctes(f"""
    WITH {_SUBROWS}, a AS (SELECT entity, t_hr, onset_hr, threshold, coalesce((p / 500 >= threshold)::INT, 0) AS o FROM sr, (SELECT unnest([0.2, 0.3]::DOUBLE[]) AS threshold)),
         b AS (SELECT *, coalesce(lag(o) OVER w, 0) AS pr, coalesce(lead(o) OVER w, 0) AS nx FROM a WINDOW w AS (PARTITION BY entity, threshold ORDER BY t_hr)),
         e AS (SELECT entity, threshold, min(onset_hr) AS onset, sum((o = 1 AND pr = 0)::INT) AS ep, sum((o = 1 AND nx = 1 AND pr = 0)::INT) AS de, min(CASE WHEN o = 1 THEN t_hr END) AS fa, min(CASE WHEN o = 1 AND nx = 1 THEN t_hr END) AS fd,
                 (max(t_hr) + 24 - min(t_hr)) / 24 AS days FROM b GROUP BY 1, 2),
         l AS (SELECT *, CASE WHEN fa < onset THEN onset - fa END AS lead FROM e)
    SELECT threshold, count(onset) AS n_event, count(*) - count(onset) AS n_free, count(lead) AS captured, count(*) FILTER (fd < onset) AS captured_double, CAST(sum(ep) AS BIGINT) AS episodes, CAST(sum(de) AS BIGINT) AS double_episodes,
      CAST(coalesce(sum(ep) FILTER (onset IS NULL), 0) AS BIGINT) AS false_episodes, {r('count(lead) / count(onset)::DOUBLE')} AS capture, {r('count(*) FILTER (fd < onset) / count(onset)::DOUBLE')} AS capture_double,
      {r('quantile_cont(lead, 0.25)')} AS lead_p25, {r('quantile_cont(lead, 0.5)')} AS lead_median, {r('quantile_cont(lead, 0.75)')} AS lead_p75, {r('sum(ep) / nullif(count(lead), 0)::DOUBLE')} AS nne_single,
      {r('sum(de) / nullif(count(*) FILTER (fd < onset), 0)::DOUBLE')} AS nne_double, {r('100 * coalesce(sum(ep) FILTER (onset IS NULL), 0) / sum(days) FILTER (onset IS NULL)')} AS false_per_100_days,
      {r('count(*) FILTER (lead >= 12) / count(onset)::DOUBLE')} AS capture_12h FROM l GROUP BY 1""", "series", "full_grid"))
def four_view(spark, sf):
    return rounded(AL.four_view(view_rows(spark, sf), VIEW, step=24.0))


def group_capture_sql(group: str, source: str, extra: str = "") -> str:
    return (f"SELECT threshold, {group}, count(*) AS n_event, CAST(sum(captured) AS BIGINT) AS n_captured, {r('sum(captured) / count(*)::DOUBLE')} AS capture, {r('quantile_cont(lead, 0.25)')} AS lead_p25, "
            f"{r('quantile_cont(lead, 0.5)')} AS lead_median, {r('quantile_cont(lead, 0.75)')} AS lead_p75 FROM {source} {extra} WHERE event = 1 GROUP BY 1, 2")


@query("D5_capture_by_subtype", with_ctes(f"WITH {_SUBROWS}, v AS (SELECT entity, t_hr, onset_hr, p / 500 AS p, 0 AS y FROM sr), a AS ({alerts_sql('v', VIEW, anchor='min(onset_hr)')}) {group_capture_sql('subtype', 'a JOIN (SELECT DISTINCT entity, subtype FROM sr) USING (entity)')}", "series", "full_grid"))
def capture_subtype(spark, sf):
    rows = view_rows(spark, sf).withColumn("y", F.lit(0))
    al = AL.entity_alerts(rows, VIEW, anchor="onset_hr")
    kinds = two_onsets(spark, sf).select("entity", K.event_subtype("a", "b").alias("subtype"))
    return rounded(AL.capture_by(al.join(kinds, "entity"), "subtype"))


@query("D6_capture_by_progression", with_ctes(f"WITH a AS ({alerts_sql()}) {group_capture_sql('stage', 'a JOIN (SELECT entity, max(CASE WHEN ge3 = 1 THEN 3 WHEN ge2 = 1 THEN 2 ELSE y END) AS stage FROM pred GROUP BY 1) USING (entity)')}", "pred"))
def capture_progression(spark, sf):
    pr = predictions(spark, sf)
    stage = pr.groupBy("entity").agg(F.max(F.when(F.col("ge3") == 1, 3).when(F.col("ge2") == 1, 2).otherwise(F.col("y"))).alias("stage"))
    return rounded(AL.capture_by(AL.entity_alerts(pr, THRESHOLDS).join(stage, "entity"), "stage"))


@query("D7_false_alert_review", with_ctes(f"""
    WITH {_DIAG}, d AS (SELECT entity, t_hr, y, p / 500 AS p FROM dg), a AS ({alerts_sql('d', VIEW)}), k AS (SELECT entity, max(ratio) AS pf, max(rise) AS pr, min(onset_hr) AS onset FROM dg GROUP BY 1),
         f AS (SELECT threshold, coalesce(onset - first_alert > 168, false) AS early, coalesce(pf >= 8 OR pr >= 60, false) AS near FROM a JOIN k USING (entity) WHERE alerted = 1 AND event = 0)
    SELECT threshold, count(*) AS n_false, count(*) FILTER (early) AS too_early, count(*) FILTER (NOT early AND near) AS near_criterion, count(*) FILTER (NOT early AND NOT near) AS neither FROM f GROUP BY 1""", "analyte", "cgrid"))
def false_review(spark, sf):
    rows = diagnostic_rows(spark, sf).withColumn("p", F.col("p") / 500.0)
    peaks = rows.groupBy("entity").agg(F.max("ratio").alias("peak_fold"), F.max("rise").alias("peak_rise"), F.min("onset_hr").alias("onset_hr"))
    return AL.false_alert_review(AL.entity_alerts(rows, VIEW), peaks, fold=8.0, rise=60.0, horizon=168.0)


@query("D8_workload", with_ctes(f"""
    WITH d AS (SELECT entity, threshold, floor(t_hr / 24) AS dy, max((p >= threshold)::INT) AS o FROM pred, (SELECT unnest([0.15, 0.25, 0.35]::DOUBLE[]) AS threshold) GROUP BY 1, 2, 3), e AS (SELECT entity, threshold, max(o) AS o, sum(o) AS s, count(*) AS k FROM d GROUP BY 1, 2)
    SELECT count(*) AS n_entities, CAST(sum(k) AS BIGINT) AS n_days, threshold, CAST(sum(o) AS BIGINT) AS entities_alerted, CAST(sum(s) AS BIGINT) AS days_alerted, {r('100 * sum(o) / count(*)::DOUBLE')} AS pct_entities, {r('100 * sum(s) / sum(k)::DOUBLE')} AS pct_days FROM e GROUP BY threshold""", "pred"))
def workload(spark, sf):
    return rounded(AL.workload(predictions(spark, sf), THRESHOLDS))


@query("D9_rule_versus_score", with_ctes(f"""
    WITH e AS (SELECT entity, max(CASE WHEN y = 1 THEN t_hr END) AS anchor, min(CASE WHEN p >= 0.2 THEN t_hr END) AS m, min(CASE WHEN q >= 0.2 THEN t_hr END) AS u FROM pred GROUP BY 1),
         f AS (SELECT anchor, CASE WHEN m < anchor THEN m END AS m, CASE WHEN u < anchor THEN u END AS u FROM e WHERE anchor IS NOT NULL)
    SELECT count(*) AS n_event, count(m) AS n_captured, count(*) FILTER (m IS NOT NULL AND u IS NOT NULL) AS n_rule_fired, count(*) FILTER (m < u) AS n_earlier, quantile_cont(anchor - m, 0.5) AS lead_median, quantile_cont(CASE WHEN m IS NOT NULL THEN anchor - u END, 0.5) AS rule_lead_median,
      {r('100 * count(*) FILTER (m IS NOT NULL AND u IS NOT NULL) / count(m)::DOUBLE')} AS rule_fired_pct, {r('100 * count(*) FILTER (m < u) / count(*) FILTER (m IS NOT NULL AND u IS NOT NULL)::DOUBLE')} AS earlier_pct,
      {r('100 * count(*) FILTER (m IS NOT NULL AND u IS NULL) / count(m)::DOUBLE')} AS never_fired_pct, quantile_cont(u - m, 0.25) AS gain_p25, quantile_cont(u - m, 0.5) AS gain_median, quantile_cont(u - m, 0.75) AS gain_p75 FROM f""", "pred"))
def rule_versus(spark, sf):
    return rounded(AL.rule_versus_score(predictions(spark, sf), 0.2, F.col("q") >= 0.2))


@query("D10_rule_lead", with_ctes(f"""
    WITH {_DIAG}, e AS (SELECT entity, min(onset_hr) - min(CASE WHEN ratio >= 4 THEN t_hr END) AS lead FROM dg WHERE y = 1 AND onset_hr IS NOT NULL GROUP BY 1)
    SELECT count(*) AS n_event, count(lead) AS captured, {r('count(lead) / count(*)::DOUBLE')} AS capture, {r('quantile_cont(lead, 0.25)')} AS lead_p25, {r('quantile_cont(lead, 0.5)')} AS lead_median, {r('quantile_cont(lead, 0.75)')} AS lead_p75 FROM e""", "analyte", "cgrid"))
def rule_lead(spark, sf):
    return rounded(AL.rule_lead(diagnostic_rows(spark, sf), F.col("ratio") >= 4.0))


def outcomes(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("death"), F.col("o_totalprice").alias("los"))


@query("D11_outcome_gradient", with_ctes(f"""
    WITH a AS ({alerts_sql()}), o AS (SELECT a.*, (o_orderstatus = 'F')::INT AS death, o_totalprice AS los FROM a JOIN orders ON entity = o_orderkey)
    SELECT threshold, CASE WHEN event = 0 THEN 'event_free' WHEN captured = 1 THEN 'captured' ELSE 'missed' END AS "group", count(*) AS n_entities, CAST(sum(death) AS BIGINT) AS deaths, {r('100 * avg(death)')} AS death_pct, {r('quantile_cont(los, 0.5)', 3)} AS los_median FROM o GROUP BY 1, 2""", "pred"))
def outcome_gradient(spark, sf):
    out = rounded(AL.outcome_gradient(AL.entity_alerts(predictions(spark, sf), THRESHOLDS), outcomes(spark, sf), by=["threshold"]))
    return out.withColumn("los_median", F.round("los_median", 3))


@query("D12_outcome_by_band", with_ctes(f"""
    WITH m AS (SELECT entity, max(p) AS max_p FROM pred GROUP BY 1), e AS (SELECT list_sort(list_distinct(quantile_cont(max_p, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM m),
         b AS (SELECT CAST(greatest(len(list_filter(edges, lambda x: x < max_p)) - 1, 0) AS INT) AS band, (o_orderstatus = 'F')::INT AS death, o_totalprice AS los FROM m JOIN orders ON entity = o_orderkey, e)
    SELECT band, count(*) AS n_entities, CAST(sum(death) AS BIGINT) AS deaths, {r('100 * avg(death)')} AS death_pct, {r('quantile_cont(los, 0.5)', 3)} AS los_median FROM b GROUP BY 1""", "pred"))
def outcome_band(spark, sf):
    per = predictions(spark, sf).groupBy("entity").agg(F.max("p").alias("max_p")).join(outcomes(spark, sf), "entity")
    out = rounded(AL.outcome_by_band(per))
    return out.withColumn("los_median", F.round("los_median", 3))


_EX = f"""a AS ({alerts_sql('pred', (0.2,))}), c AS (SELECT *, CASE WHEN lead >= 24 AND n_rows >= 4 THEN 'long' WHEN lead BETWEEN 6 AND 12 AND n_rows >= 3 THEN 'medium' END AS class FROM a WHERE captured = 1),
    x AS (SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY n_rows DESC, entity) AS INT) AS position, entity, lead, n_rows, anchor FROM c WHERE class IS NOT NULL)"""


@query("D13_exemplars", with_ctes(f"WITH {_EX} SELECT class, position, x.entity, lead, t_hr, round(p, 6) AS p1, y AS y1, round(q, 6) AS p2, ge2 AS y2 FROM x JOIN pred USING (entity) WHERE position <= 2", "pred"))
def exemplars(spark, sf):
    pr = predictions(spark, sf)
    classes = {"long": (F.col("lead") >= 24) & (F.col("n_rows") >= 4), "medium": F.col("lead").between(6.0, 12.0) & (F.col("n_rows") >= 3)}
    picks = AL.exemplars(AL.entity_alerts(pr, (0.2,)), classes).select("class", "position", "entity", "lead")
    return rounded(picks.join(pr, "entity").select("class", "position", "entity", "lead", "t_hr", F.col("p").alias("p1"), F.col("y").alias("y1"), F.col("q").alias("p2"), F.col("ge2").alias("y2")))


@query("D14_severe_thresholds", with_ctes(f"WITH {REC}, s AS (SELECT entity, t_hr, ge3 AS y, p FROM rec), a AS ({alerts_sql('s', (0.15, 0.2, 0.25))}) SELECT threshold, {DEPLOY} FROM a GROUP BY 1", "pred"))
def severe(spark, sf):
    rows = recalibrated(spark, sf).drop("y").withColumnRenamed("ge3", "y")
    out = rounded(AL.deployment(AL.entity_alerts(rows, (0.15, 0.2, 0.25))))
    return out.withColumn("days", F.round("days", 4))
