"""Queries for discrimination, calibration and label diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import calibration as C
from tidemark.operators import checkpoints as K
from tidemark.operators import diagnostics as G
from tidemark.operators import discrimination as D
from tidemark.operators import ordered as O
from tidemark.operators import quality as Q
from tidemark.plans.checkpoint_queries import TWO_ONSETS, two_onsets
from tidemark.plans.cleaning_queries import P_REC
from tidemark.plans.fixtures import (CLOCK, LAYER, THRESHOLDS, analyte, checkpoint_grid, endpoints, full_grid, predictions, r, rounded, series, sites, stays, table, with_ctes)
from tidemark.plans.registry import query
from tidemark.plans.timeline_queries import auc_sql


def curve_sql(source: str, by: str = "", p: str = "p", y: str = "y") -> str:
    """Running counts per distinct score, from the highest score down."""
    part = f"PARTITION BY {by} " if by else ""
    every = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return (f"SELECT {head}{p} AS threshold, sum({y}) AS pos, count(*) - sum({y}) AS neg, sum(sum({y})) OVER ({part}ORDER BY {p} DESC) AS tp, "
            f"sum(count(*) - sum({y})) OVER ({part}ORDER BY {p} DESC) AS fp, sum(sum({y})) OVER ({every}) AS np, sum(count(*) - sum({y})) OVER ({every}) AS nn "
            f"FROM {source} WHERE {p} IS NOT NULL GROUP BY {head}{p}")


def ap_sql(source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {head}CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, {r('sum(pos * (nn - fp + neg / 2.0::DOUBLE)) / (max(np)::DOUBLE * max(nn))')} AS auroc, "
            f"{r('sum(pos * (tp / (tp + fp)::DOUBLE)) / max(np)')} AS auprc, {r('max(np) / (max(np) + max(nn))::DOUBLE')} AS prevalence, "
            f"{r('sum(pos * (tp / (tp + fp)::DOUBLE)) / max(np) / (max(np) / (max(np) + max(nn))::DOUBLE)')} AS lift FROM ({curve_sql(source, by)}){group}")


@query("E1_auroc", with_ctes(auc_sql("ends", by="endpoint"), "ends"))
def auroc(spark, sf):
    return rounded(D.auroc(endpoints(spark, sf), by=["endpoint"]))


@query("E1_auroc_pieces", auc_sql("(SELECT l_linestatus AS g, (l_returnflag = 'R')::INT AS y, l_extendedprice AS p FROM lineitem)", by="g"))
def auroc_pieces(spark, sf):
    """The same metric with a small piece size, so that the score axis is really cut."""
    li = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("g"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_extendedprice").alias("p"))
    return rounded(D.auroc(li, by=["g"], points=O.split_points(li, "p", rows_per_piece=2_000)))


@query("E1_weighted_auroc", with_ctes(f"""
    WITH c AS (SELECT p, sum(CASE WHEN y = 1 THEN w END) AS pos, sum(CASE WHEN y = 0 THEN w END) AS neg FROM (SELECT *, (ship_year - 1990)::DOUBLE / 4 AS w FROM pred) GROUP BY 1),
         d AS (SELECT coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, sum(coalesce(neg, 0)) OVER (ORDER BY p) - coalesce(neg, 0) AS below FROM c)
    SELECT {r('sum(pos)')} AS n_pos, {r('sum(neg)')} AS n_neg, {r('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))')} AS auroc FROM d""", "pred"))
def weighted(spark, sf):
    pr = predictions(spark, sf).withColumn("w", (F.col("ship_year") - 1990).cast("double") / 4)
    return rounded(D.auroc(pr, weight="w"))


@query("E2_average_precision", with_ctes(ap_sql("ends", "endpoint"), "ends"))
def average_precision(spark, sf):
    return rounded(D.discrimination(endpoints(spark, sf), by=["endpoint"]))


@query("E3_curve_points", with_ctes(f"SELECT endpoint, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {r('tp / np::DOUBLE')} AS tpr, {r('fp / nn::DOUBLE')} AS fpr, {r('tp / (tp + fp)::DOUBLE')} AS precision FROM ({curve_sql('ends', 'endpoint')})", "ends"))
def curve(spark, sf):
    return rounded(D.curve(endpoints(spark, sf), by=["endpoint"]).select("endpoint", "threshold", "tp", "fp", "tpr", "fpr", "precision"))


_RATES = (f"CAST(np - tp AS BIGINT) AS fn, CAST(nn - fp AS BIGINT) AS tn, {r('tp / nullif(np, 0)::DOUBLE')} AS sensitivity, {r('(nn - fp) / nullif(nn, 0)::DOUBLE')} AS specificity, "
          f"{r('tp / nullif(tp + fp, 0)::DOUBLE')} AS ppv, {r('(tp + fp) / nullif(tp, 0)::DOUBLE')} AS nne, {r('(tp + fp) / (np + nn)::DOUBLE')} AS alert_rate")
_AT = ("SELECT endpoint, threshold, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp "
       "FROM ends, (SELECT unnest([0.15, 0.25, 0.35]::DOUBLE[]) AS threshold) GROUP BY 1, 2")


@query("E4_confusion", with_ctes(f"SELECT endpoint, threshold, np AS n_pos, nn AS n_neg, tp, fp, {_RATES} FROM ({_AT})", "ends"))
def confusion(spark, sf):
    return rounded(D.threshold_counts(endpoints(spark, sf), THRESHOLDS, by=["endpoint"]))


@query("E5_matched_sensitivity", with_ctes(f"""
    WITH t AS (SELECT count(*) FILTER (y = 1 AND q >= 0.2) / count(*) FILTER (y = 1)::DOUBLE AS want FROM pred),
         c AS (SELECT threshold, tp / np::DOUBLE AS tpr, tp / (tp + fp)::DOUBLE AS pr FROM ({curve_sql('pred')})),
         lo AS (SELECT * FROM c, t WHERE tpr <= want ORDER BY tpr DESC, pr DESC LIMIT 1), hi AS (SELECT * FROM c, t WHERE tpr >= want ORDER BY tpr, pr DESC LIMIT 1),
         s AS (SELECT lo.want, CASE WHEN hi.tpr = lo.tpr THEN 0 ELSE (lo.want - lo.tpr) / (hi.tpr - lo.tpr) END AS f, lo.pr AS a, hi.pr AS b, lo.threshold AS c, hi.threshold AS d FROM lo, hi)
    SELECT {r('want')} AS sensitivity, {r('a + f * (b - a)')} AS ppv, {r('c + f * (d - c)')} AS threshold, {r('1 / (a + f * (b - a))')} AS nne FROM s""", "pred"))
def matched(spark, sf):
    pr = predictions(spark, sf)
    rule = D.flag_counts(pr, F.col("q") >= 0.2)
    return rounded(D.matched_sensitivity(pr, rule))


_BRIER = (f"SELECT endpoint, count(*) AS n, {r('avg((p - y) * (p - y))')} AS brier, {r('avg(y)')} AS prevalence, {r('avg(y) * (1 - avg(y))')} AS brier_null, "
          f"{r('1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y)))')} AS skill FROM ends GROUP BY 1")


@query("E6_brier", with_ctes(_BRIER, "ends"))
def brier(spark, sf):
    return rounded(C.brier(endpoints(spark, sf), by=["endpoint"]))


def edges_sql(source: str, by: str, value: str, bins: int) -> str:
    probs = ", ".join(repr(i / bins) for i in range(bins + 1))
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {head}list_sort(list_distinct(quantile_cont({value}, [{probs}]))) AS edges FROM {source}{group}"


BIN = "greatest(len(list_filter(edges, lambda e: e < {0})) - 1, 0)"


@query("E7_quantile_bins", with_ctes(f"WITH e AS ({edges_sql('pred', '', 'p', 10)}) SELECT CAST({BIN.format('p')} AS INT) AS bin, count(*) AS n, min(p) AS lo_p, max(p) AS hi_p FROM pred, e GROUP BY 1", "pred"))
def quantile_bins(spark, sf):
    return O.quantile_bins(predictions(spark, sf).select("p"), "p", 10).groupBy("bin").agg(F.count("*").alias("n"), F.min("p").alias("lo_p"), F.max("p").alias("hi_p"))


def curve_bins(source: str, by: str = "", bins: int = 10) -> str:
    head = f"{by}, " if by else ""
    join = f"JOIN e USING ({by})" if by else ", e"
    return (f"SELECT {head}bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, avg(p) AS predicted, avg(y) AS observed FROM (SELECT *, CAST({BIN.format('p')} AS INT) AS bin FROM {source} {join}) GROUP BY {head}bin")


def ece_sql(weighted: bool) -> str:
    value = "sum(n * abs(observed - predicted)) / sum(n)" if weighted else "avg(abs(observed - predicted))"
    return with_ctes(f"WITH e AS ({edges_sql('ends', 'endpoint', 'p', 10)}), b AS ({curve_bins('ends', 'endpoint')}) SELECT endpoint, count(*) AS n_bins, {r(value)} AS ece FROM b GROUP BY 1", "ends")


@query("E8_calibration_error", ece_sql(True))
def calibration_error(spark, sf):
    return rounded(C.calibration_error(endpoints(spark, sf), by=["endpoint"]))


@query("E8_plain_calibration_error", ece_sql(False))
def plain_error(spark, sf):
    return rounded(C.calibration_error(endpoints(spark, sf), by=["endpoint"], weighted=False))


@query("E9_calibration_curve", with_ctes(f"WITH e AS ({edges_sql('ends', 'endpoint', 'p', 10)}) SELECT endpoint, bin, n, n_pos, {r('predicted')} AS predicted, {r('observed')} AS observed FROM ({curve_bins('ends', 'endpoint')})", "ends"))
def calibration_curve(spark, sf):
    return rounded(C.calibration_curve(endpoints(spark, sf), by=["endpoint"]))


def newton_sql(source: str, by: str, final: str, steps: int = 8, z: str = "ln(p / (1 - p))", counts: str | None = None) -> str:
    """Logistic recalibration with the Newton steps written out."""
    counts = counts or f"SELECT {by}, {z} AS z, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM {source} GROUP BY {by}, p"
    parts = [f"d AS MATERIALIZED ({counts})", f"p0 AS MATERIALIZED (SELECT {by}, ln(sum(pos) / sum(n) / (1 - sum(pos) / sum(n))) AS a, 0.0::DOUBLE AS b FROM d GROUP BY {by})"]
    for i in range(steps):
        parts.append(
            f"s{i} AS MATERIALIZED (SELECT {by}, a, b, sum(pos - n * mu) AS g0, sum((pos - n * mu) * z) AS g1, sum(n * mu * (1 - mu)) AS h0, sum(n * mu * (1 - mu) * z) AS h1, sum(n * mu * (1 - mu) * z * z) AS h2 "
            f"FROM (SELECT *, 1 / (1 + exp(-(a + b * z))) AS mu FROM d JOIN p{i} USING ({by})) GROUP BY {by}, a, b)")
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT {by}, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM s{i})")
    return f"WITH {', '.join(parts)} {final.format(params=f'p{steps}')}"


@query("E10_calibration_slope", with_ctes(newton_sql("ends", "endpoint", f"SELECT endpoint, CAST((SELECT sum(n) FROM d WHERE d.endpoint = q.endpoint) AS BIGINT) AS n_rows, CAST((SELECT sum(pos) FROM d WHERE d.endpoint = q.endpoint) AS BIGINT) AS n_pos, {r('a', 5)} AS a, {r('b', 5)} AS b FROM {{params}} q"), "ends"))
def slope(spark, sf):
    return rounded(C.fit_layer(endpoints(spark, sf), by=["endpoint"]), 5)


@query("L17_layer_fit_and_apply", with_ctes(newton_sql("ends", "endpoint", f"SELECT endpoint, entity, t_hr, {r('1 / (1 + exp(-(a + b * ln(p / (1 - p)))))', 5)} AS p_rec FROM ends JOIN {{params}} USING (endpoint)"), "ends"))
def layer_apply(spark, sf):
    df = endpoints(spark, sf)
    layer = C.fit_layer(df, by=["endpoint"])
    return rounded(C.apply_layer(df, layer, by=["endpoint"]).select("endpoint", "entity", "t_hr", "p_rec"), 5)


_FOLD = "CAST(('0x' || substr(md5('42|' || entity), 1, 8))::BIGINT % 5 AS INT)"


def fold_column():
    return (N.hash32("entity") % 5).cast("int")


_OUT = "SELECT f.fold, ln(p / (1 - p)) AS z, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM folded d JOIN (SELECT DISTINCT fold FROM folded) f ON d.fold <> f.fold GROUP BY f.fold, p"


@query("L18_cross_fitted_layer", with_ctes(
    "WITH folded AS MATERIALIZED (SELECT *, " + _FOLD + " AS fold FROM pred), " + newton_sql("folded", "fold", f"SELECT fold, {r('a', 4)} AS a, {r('b', 4)} AS b FROM {{params}}", counts=_OUT)[5:], "pred"))
def cross_fitted(spark, sf):
    df = predictions(spark, sf).withColumn("fold", fold_column())
    return rounded(C.held_out_layers(df, "fold").select("fold", "a", "b"), 4)


_SITE_OUT = "SELECT f.site, ln(p / (1 - p)) AS z, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM sited d JOIN (SELECT DISTINCT site FROM sited) f ON d.site <> f.site GROUP BY f.site, p"


@query("L19_leave_site_out", with_ctes(newton_sql("sited", "site", f"SELECT site, {r('a', 4)} AS a, {r('b', 4)} AS b FROM {{params}}", counts=_SITE_OUT), "sited"))
def leave_site_out(spark, sf):
    return rounded(C.held_out_layers(sites(spark, sf), "site").select("site", "a", "b"), 4)


@query("L19_site_slopes", with_ctes("WITH " + "rec AS MATERIALIZED (SELECT site, y, " + P_REC + " AS p FROM sited), " + newton_sql("rec", "site", f"SELECT site, {r('b', 4)} AS slope, (b BETWEEN 0.8 AND 1.25)::INT AS inside FROM {{params}}")[5:], "sited"))
def site_slopes(spark, sf):
    df = sites(spark, sf).withColumn("p", N.recalibrate("p", *LAYER))
    out = C.fit_layer(df, by=["site"])
    return rounded(out.select("site", F.col("b").alias("slope"), F.when(F.col("b").between(0.8, 1.25), 1).otherwise(0).alias("inside")), 4)


_RAW_B = newton_sql("sited", "site", "SELECT site, b FROM {params}")
_OUT_B = newton_sql("sited", "site", "SELECT site, b FROM {params}", counts=_SITE_OUT)


@query("L19_refit_slopes", with_ctes(f"SELECT site, {r('u.b / v.b', 2)} AS slope FROM ({_RAW_B}) u JOIN ({_OUT_B}) v USING (site)", "sited"))
def refit_slopes(spark, sf):
    """Each site recalibrated by the layer of all other sites: its calibration slope after that."""
    df = sites(spark, sf)
    refit = C.apply_layer(df, C.held_out_layers(df, "site"), by=["site"], name="p_new")
    return rounded(C.fit_layer(refit, p="p_new", by=["site"]).select("site", F.col("b").alias("slope")), 2)


_TR = "1 / (1 + exp(-(-0.3::DOUBLE + 0.8::DOUBLE * ln(p / (1 - p)))))"
_LEFT_OUT = f"""ly AS MATERIALIZED ({newton_sql('sited', 'site', 'SELECT site, a, b FROM {params}', counts=_SITE_OUT)}), big AS (SELECT site, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM sited GROUP BY 1 HAVING sum(y) >= 20),
    both_ AS MATERIALIZED (SELECT site || '|transported' AS sv, y, {_TR} AS p FROM sited JOIN big USING (site) UNION ALL SELECT site || '|local' AS sv, y, 1 / (1 + exp(-(a + b * ln(p / (1 - p))))) AS p FROM sited JOIN big USING (site) JOIN ly USING (site)),
    sl AS MATERIALIZED ({newton_sql('both_', 'sv', 'SELECT sv, b AS slope FROM {params}')}), ed AS MATERIALIZED (SELECT sv, list_sort(list_distinct(quantile_cont(p, [{', '.join(repr(i / 10) for i in range(11))}]))) AS edges FROM both_ GROUP BY 1),
    er AS MATERIALIZED (SELECT sv, avg(abs(ob - pr)) AS ece FROM (SELECT sv, bin, avg(p) AS pr, avg(y) AS ob FROM (SELECT sv, y, p, CAST({BIN.format('p')} AS INT) AS bin FROM both_ JOIN ed USING (sv)) GROUP BY 1, 2) GROUP BY 1),
    lo AS MATERIALIZED (SELECT big.site, big.n, big.n_pos, s1.slope AS slope_transported, s2.slope AS slope_local, e1.ece AS ece_transported, e2.ece AS ece_local, ly.b FROM big JOIN ly USING (site)
      JOIN sl s1 ON s1.sv = big.site || '|transported' JOIN sl s2 ON s2.sv = big.site || '|local' JOIN er e1 ON e1.sv = big.site || '|transported' JOIN er e2 ON e2.sv = big.site || '|local')"""


def left_out(spark, sf):
    return C.leave_out_evaluation(sites(spark, sf).withColumn("p_tr", N.recalibrate("p", *LAYER)), "site")


@query("L19_leave_out_evaluation", with_ctes(f"WITH {_LEFT_OUT} SELECT site, n, n_pos, {r('slope_transported', 3)} AS slope_transported, {r('slope_local', 3)} AS slope_local, {r('ece_transported', 5)} AS ece_transported, {r('ece_local', 5)} AS ece_local, {r('b', 3)} AS b FROM lo", "sited"))
def leave_out_evaluation(spark, sf):
    """Each site with 20 positives or more, before and after the layer of all other sites."""
    out = left_out(spark, sf)
    return out.select("site", "n", "n_pos", *[F.round(c, d).alias(c) for c, d in (("slope_transported", 3), ("slope_local", 3), ("ece_transported", 5), ("ece_local", 5), ("b", 3))])


_SUMMED = ", ".join(f"{r(f'quantile_cont(slope_{v}, 0.25)', 3)} AS slope_{v}_p25, {r(f'quantile_cont(slope_{v}, 0.5)', 3)} AS slope_{v}_median, {r(f'quantile_cont(slope_{v}, 0.75)', 3)} AS slope_{v}_p75, count(*) FILTER (slope_{v} BETWEEN 0.8 AND 1.25) AS inside_{v}, {r(f'quantile_cont(ece_{v}, 0.5)', 5)} AS ece_{v}_median"
                    for v in ("transported", "local"))


@query("L19_leave_out_summary", with_ctes(f"WITH {_LEFT_OUT} SELECT count(*) AS n_sites, {_SUMMED} FROM lo", "sited"))
def leave_out_summary(spark, sf):
    out = C.leave_out_summary(left_out(spark, sf))
    return out.select(*[F.round(c, 5 if c.startswith("ece") else 3).alias(c) if c.startswith(("slope", "ece")) else F.col(c) for c in out.columns])


@query("L20_intercept_update", with_ctes(newton_sql("(SELECT *, 1 AS g FROM pred)", "g", f"SELECT entity, t_hr, {r('1 / (1 + exp(-(a + ln(p / (1 - p)))))', 5)} AS p_new FROM pred, {{params}}"), "pred"))
def intercept_update(spark, sf):
    pr = predictions(spark, sf)
    layer = C.fit_layer(pr.withColumn("g", F.lit(1)), by=["g"]).select(F.col("a"))
    return rounded(O.join_on(pr, layer.agg(F.max("a").alias("a")), []).select("entity", "t_hr", N.sigmoid(F.col("a") + N.logit("p")).alias("p_new")), 5)


_DCA = (f"SELECT endpoint, threshold, {r('tp / n - fp / n * (threshold / (1 - threshold))')} AS net_benefit, {r('np / n - nn / n * (threshold / (1 - threshold))')} AS treat_all, 0.0::DOUBLE AS treat_none, "
        f"(tp / n - fp / n * (threshold / (1 - threshold)) > greatest(np / n - nn / n * (threshold / (1 - threshold)), 0))::INT AS wins FROM (SELECT *, (np + nn)::DOUBLE AS n FROM ({_AT}))")


@query("E11_decision_curve", with_ctes(_DCA, "ends"))
def decision_curve(spark, sf):
    return rounded(C.decision_curve(endpoints(spark, sf), THRESHOLDS, by=["endpoint"]))


@query("E11_winning_range", with_ctes(f'SELECT endpoint, CAST(sum(wins) AS BIGINT) AS n_wins, min(CASE WHEN wins = 1 THEN threshold END) AS "from", max(CASE WHEN wins = 1 THEN threshold END) AS "to" FROM ({_DCA}) GROUP BY 1', "ends"))
def winning_range(spark, sf):
    return C.winning_range(C.decision_curve(endpoints(spark, sf), THRESHOLDS, by=["endpoint"]), ["endpoint"])


def placements(p: str) -> str:
    return (f"SELECT entity, t_hr, y, CASE WHEN y = 1 THEN (rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0::DOUBLE - (rank() OVER (PARTITION BY y ORDER BY {p}) + (count(*) OVER (PARTITION BY y, {p}) - 1) / 2.0::DOUBLE)) / (SELECT count(*) FROM pred WHERE y = 0) "
            f"ELSE 1 - (rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0::DOUBLE - (rank() OVER (PARTITION BY y ORDER BY {p}) + (count(*) OVER (PARTITION BY y, {p}) - 1) / 2.0::DOUBLE)) / (SELECT count(*) FROM pred WHERE y = 1) END AS v FROM pred")


@query("E17_delong", with_ctes(f"""
    WITH a AS ({placements('p')}), b AS ({placements('q')}), j AS (SELECT a.y, a.v AS v1, b.v AS v2 FROM a JOIN b USING (entity, t_hr)),
         s AS (SELECT y, count(*) AS n, avg(v1) AS a1, avg(v2) AS a2, var_samp(v1) + var_samp(v2) - 2 * covar_samp(v1, v2) AS vr FROM j GROUP BY 1),
         t AS (SELECT max(n) FILTER (y = 1) AS n_pos, max(n) FILTER (y = 0) AS n_neg, max(a1) FILTER (y = 1) AS auc1, max(a2) FILTER (y = 1) AS auc2, sum(vr / n) AS vr FROM s)
    SELECT n_pos, n_neg, {r('auc1')} AS auc1, {r('auc2')} AS auc2, {r('vr', 9)} AS var, {r('(auc1 - auc2) / sqrt(vr)', 4)} AS z FROM t""", "pred"))
def delong(spark, sf):
    out = D.delong(predictions(spark, sf), "p", "q")
    return out.select("n_pos", "n_neg", F.round("auc1", 6).alias("auc1"), F.round("auc2", 6).alias("auc2"), F.round("var", 9).alias("var"), F.round("z", 4).alias("z"))


_CLASSES = "SELECT *, unnest(['any', 'light', 'severe']) AS class FROM pred"


@query("E21_severity_gradient", with_ctes("WITH c AS (SELECT * FROM (" + _CLASSES + ") WHERE y = 0 OR class = 'any' OR (class = 'light' AND ge3 = 0) OR (class = 'severe' AND ge3 = 1)) " + auc_sql("c", by="class"), "pred"))
def severity(spark, sf):
    classes = {"any": F.lit(True), "light": F.col("ge3") == 0, "severe": F.col("ge3") == 1}
    return rounded(D.auroc(G.severity_classes(predictions(spark, sf), classes), by=["class"]))


def subtype_rows(spark, sf):
    """Grid rows with two onsets; the score is the last value of one family."""
    g = full_grid(spark, sf).join(two_onsets(spark, sf), "entity")
    x = K.window_features(full_grid(spark, sf), series(spark, sf), ["entity"], ["view"], 168.0, CLOCK, locf=False).select("entity", "t_hr", F.col("max").alias("p"))
    return g.join(x, ["entity", "t_hr"]).withColumn("onset_hr", F.least("a", "b")).withColumn("subtype", K.event_subtype("a", "b"))


_SUBROWS = f"""
    o AS MATERIALIZED ({TWO_ONSETS}), x AS MATERIALIZED (SELECT g.entity, g.t_hr, max(val) AS p FROM full_grid g JOIN series s ON g.entity = s.entity AND fam = 'view' AND hr > g.t_hr - 168 AND hr <= g.t_hr GROUP BY 1, 2),
    sr AS MATERIALIZED (SELECT g.entity, g.t_hr, a, b, p, least(a, b) AS onset_hr, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'dual' WHEN a IS NOT NULL THEN 'a_only' WHEN b IS NOT NULL THEN 'b_only' ELSE 'none' END AS subtype
      FROM full_grid g JOIN o USING (entity) LEFT JOIN x ON g.entity = x.entity AND g.t_hr = x.t_hr)"""


@query("E22_subtype_discrimination", with_ctes(f"WITH {_SUBROWS}, c AS (SELECT s.subtype, y, p FROM (SELECT subtype, 1 AS y, p FROM sr WHERE subtype <> 'none' AND onset_hr - t_hr > 0 AND onset_hr - t_hr <= 168 "
                                                "UNION ALL SELECT k, 0, p FROM sr, (SELECT unnest(['a_only', 'b_only', 'dual']) AS k) WHERE subtype = 'none') s) " + auc_sql("c", by="subtype"), "series", "full_grid"))
def subtype_discrimination(spark, sf):
    rows = subtype_rows(spark, sf)
    hit = K.horizon_label(horizon=168.0)
    kept = rows.withColumn("y", hit).filter((F.col("subtype") == "none") | (F.col("y") == 1))
    classes = {s: F.col("subtype") == s for s in ("a_only", "b_only", "dual")}
    out = G.severity_classes(kept.withColumnRenamed("subtype", "own").withColumn("subtype", F.col("own")).drop("own"), classes, name="restricted")
    return rounded(D.auroc(out, by=["restricted"]).withColumnRenamed("restricted", "subtype"))


@query("E22_endpoint_relabelling", with_ctes(f"WITH {_SUBROWS}, c AS (SELECT p, unnest(['a', 'b', 'union']) AS endpoint, unnest([a - t_hr, b - t_hr, onset_hr - t_hr]) AS d FROM sr), l AS (SELECT endpoint, p, coalesce((d > 0 AND d <= 168)::INT, 0) AS y FROM c) " + auc_sql("l", by="endpoint"), "series", "full_grid"))
def relabelling(spark, sf):
    rows = subtype_rows(spark, sf)
    parts = F.array(*[F.struct(F.lit(n).alias("endpoint"), K.horizon_label(onset=c, horizon=168.0).alias("y")) for n, c in (("a", "a"), ("b", "b"), ("union", "onset_hr"))])
    return rounded(D.auroc(rows.select("p", F.inline(parts)), by=["endpoint"]))


_GROUPS = "SELECT *, unnest(['overall', 'status F', 'status O', 'early ship', 'large']) AS subgroup FROM pred"
_GROUPED = f"SELECT * FROM ({_GROUPS}) WHERE subgroup = 'overall' OR (subgroup = 'status F' AND status = 'F') OR (subgroup = 'status O' AND status = 'O') OR (subgroup = 'early ship' AND ship_year < 1996) OR (subgroup = 'large' AND x1 >= 0.05)"


def masks():
    return {"overall": F.lit(True), "status F": F.col("status") == "F", "status O": F.col("status") == "O", "early ship": F.col("ship_year") < 1996, "large": F.col("x1") >= 0.05}


@query("E23_subgroups", with_ctes(f"WITH c AS ({_GROUPED}) SELECT a.*, n_entities, n_event_entities FROM ({auc_sql('c', by='subgroup')}) a JOIN (SELECT subgroup, count(DISTINCT entity) AS n_entities, count(DISTINCT CASE WHEN y = 1 THEN entity END) AS n_event_entities FROM c GROUP BY 1) USING (subgroup)", "pred"))
def subgroups(spark, sf):
    rows = G.in_subgroups(predictions(spark, sf), masks())
    return rounded(O.join_on(D.auroc(rows, by=["subgroup"]), G.counts_per_group(rows, ["subgroup"]), ["subgroup"]))


@query("E23_subgroup_gap", with_ctes(f"WITH c AS ({_GROUPED}), a AS ({auc_sql('c', by='subgroup').replace(', 6) + 0) AS auroc', ', 12) + 0) AS auroc')}) SELECT {r('f.auroc')} AS \"first\", {r('o.auroc')} AS \"second\", {r('f.auroc - o.auroc')} AS gap FROM a f, a o WHERE f.subgroup = 'status F' AND o.subgroup = 'status O'", "pred"))
def subgroup_gap(spark, sf):
    rows = G.in_subgroups(predictions(spark, sf), masks())
    return rounded(G.gap(D.auroc(rows, by=["subgroup"]), "subgroup", "status F", "status O"))


@query("E24_site_distribution", with_ctes(f"""
    WITH s AS ({auc_sql('sited', by='site').replace(', 6) + 0) AS auroc', ', 12) + 0) AS auroc')}), k AS (SELECT * FROM s WHERE n_pos >= 20 AND auroc IS NOT NULL)
    SELECT count(*) AS n_sites, {r('min(auroc)')} AS min, {r('max(auroc)')} AS max, {r('stddev_samp(auroc)')} AS sd, count(*) FILTER (auroc < 0.5) AS n_below, {r('quantile_cont(auroc, 0.1)')} AS p10,
      {r('quantile_cont(auroc, 0.25)')} AS p25, {r('quantile_cont(auroc, 0.5)')} AS median, {r('quantile_cont(auroc, 0.75)')} AS p75, {r('quantile_cont(auroc, 0.9)')} AS p90 FROM k""", "sited"))
def site_distribution(spark, sf):
    return rounded(D.site_spread(D.auroc(sites(spark, sf), by=["site"]).filter("n_pos >= 20"), low=0.5))


def strata_sql(right: bool) -> str:
    expr = "CASE WHEN t_hr > 24 AND t_hr <= 168 THEN ceil((t_hr - 24) / 12) * 12 + 24 END" if right else "CASE WHEN t_hr >= 24 THEN (floor((t_hr - 24) / 12) + 1) * 12 END"
    return with_ctes(f"WITH c AS (SELECT *, CAST({expr} AS DOUBLE) AS stratum FROM pred) {auc_sql('c', by='stratum', where='stratum IS NOT NULL')}", "pred")


@query("E25_hour_strata", strata_sql(True))
def strata(spark, sf):
    rows = predictions(spark, sf).withColumn("stratum", D.hour_strata("t_hr", width=12.0).cast("double")).filter("stratum IS NOT NULL")
    return rounded(D.auroc(rows, by=["stratum"]))


@query("E25_hour_buckets", strata_sql(False))
def buckets(spark, sf):
    rows = predictions(spark, sf).withColumn("stratum", D.hour_strata("t_hr", width=12.0, right_closed=False).cast("double")).filter("stratum IS NOT NULL")
    return rounded(D.auroc(rows, by=["stratum"]))


@query("E26_trend", with_ctes(f"""
    WITH s AS ({auc_sql('pred', by='t_hr').replace(', 6) + 0) AS auroc', ', 12) + 0) AS auroc')}), k AS (SELECT count(*) AS n FROM s),
         m AS (SELECT CAST(sum(sign(b.auroc - a.auroc)) AS INT) AS s FROM s a JOIN s b ON a.t_hr < b.t_hr),
         perm AS (SELECT list(v) AS v FROM (SELECT unnest(range(1, 8)) AS v)),
         o AS (SELECT a.v AS a, b.v AS b, c.v AS c, d.v AS d, e.v AS e, f.v AS f, g.v AS g FROM (SELECT unnest(v) AS v FROM perm) a, (SELECT unnest(v) AS v FROM perm) b, (SELECT unnest(v) AS v FROM perm) c, (SELECT unnest(v) AS v FROM perm) d,
               (SELECT unnest(v) AS v FROM perm) e, (SELECT unnest(v) AS v FROM perm) f, (SELECT unnest(v) AS v FROM perm) g WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v, f.v, g.v])) = 7),
         ss AS (SELECT sign(b-a)+sign(c-a)+sign(d-a)+sign(e-a)+sign(f-a)+sign(g-a)+sign(c-b)+sign(d-b)+sign(e-b)+sign(f-b)+sign(g-b)+sign(d-c)+sign(e-c)+sign(f-c)+sign(g-c)+sign(e-d)+sign(f-d)+sign(g-d)+sign(f-e)+sign(g-e)+sign(g-f) AS x FROM o)
    SELECT CAST(n AS INT) AS n_strata, s, {r('s / (n * (n - 1) / 2)::DOUBLE')} AS tau, {r('least(1, 2 * (SELECT avg((x >= abs(s))::INT) FROM ss))')} AS p_exact, {r('s / sqrt(n * (n - 1) * (2 * n + 5) / 18.0::DOUBLE)')} AS z FROM k, m""", "pred"))
def trend(spark, sf):
    return rounded(D.concordance(D.auroc(predictions(spark, sf), by=["t_hr"]), "t_hr", "auroc").drop("p_normal"))


@query("E27_univariate", f"""
    WITH l AS (SELECT (label >= 5)::INT AS y, CAST(generate_subscripts(embedding, 1) AS INT) - 1 AS feature, CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings)
    SELECT feature, n_pos, n_neg, auroc FROM ({auc_sql('l', by='feature')})""")
def univariate(spark, sf):
    long = table(spark, sf, "embeddings").select(F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"), F.posexplode("embedding").alias("feature", "p"))
    return rounded(D.auroc(long.withColumn("p", F.col("p").cast("double")), by=["feature"]))


_UNI = " UNION ALL ".join(f"SELECT '{c}' AS feature, y, CAST({c} AS DOUBLE) AS p FROM pred" for c in ("x1", "x2", "q"))


@query("E27_ranked_features", with_ctes(f"WITH l AS ({_UNI}), a AS ({auc_sql('l', by='feature').replace(', 6) + 0) AS auroc', ', 12) + 0) AS auroc')}) SELECT feature, n_pos + n_neg AS n, CAST(0 AS BIGINT) AS n_missing, n_pos, n_neg, {r('auroc')} AS auroc, {r('abs(auroc - 0.5) + 0.5')} AS strength FROM a", "pred"))
def ranked(spark, sf):
    return rounded(G.univariate(predictions(spark, sf), ["x1", "x2", "q"]))


def diagnostic_rows(spark, sf):
    """Grid rows with onset, a trailing ratio feature and a score."""
    g = checkpoint_grid(spark, sf).withColumnRenamed("label", "y")
    w = K.window_features(g, analyte(spark, sf).withColumn("fam", F.lit("x")), ["entity"], ["x"], 168.0, CLOCK, locf=False).select("entity", "t_hr", "last", "max")
    return g.join(w, ["entity", "t_hr"]).select("entity", "t_hr", "y", "onset_hr", N.fold_of("last", "base").alias("ratio"), (F.col("last") - F.col("base")).alias("rise"), F.col("max").alias("p"))


_DIAG = """dg AS MATERIALIZED (SELECT g.entity, g.t_hr, label AS y, onset_hr, last / base AS ratio, last - base AS rise, mx AS p FROM cgrid g LEFT JOIN
    (SELECT g.entity, g.t_hr, arg_max(val, (hr, val)) AS last, max(val) AS mx FROM cgrid g JOIN analyte s ON g.entity = s.entity AND hr > g.t_hr - 168 AND hr <= g.t_hr GROUP BY 1, 2) w ON g.entity = w.entity AND g.t_hr = w.t_hr)"""


@query("E28_label_decoupled", with_ctes(f"WITH {_DIAG}, c AS (SELECT * FROM dg, (SELECT unnest([12, 24, 48]::DOUBLE[]) AS lead) WHERE y = 0 OR onset_hr - t_hr >= lead) " + auc_sql("c", by="lead"), "analyte", "cgrid"))
def label_decoupled(spark, sf):
    return rounded(D.auroc(G.decoupled(diagnostic_rows(spark, sf), [12.0, 24.0, 48.0]), by=["lead"]))


_MET = "(coalesce(ratio >= 8, false) OR coalesce(rise >= 60, false))"


@query("E29_definitional_share", with_ctes(f"WITH {_DIAG} SELECT count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 1 AND ratio IS NOT NULL) AS n_observed, count(*) FILTER (y = 1 AND ratio IS NOT NULL AND {_MET}) AS n_definitional, "
                                               f"{r(f'count(*) FILTER (y = 1 AND ratio IS NOT NULL AND {_MET}) / nullif(count(*) FILTER (y = 1 AND ratio IS NOT NULL), 0)::DOUBLE')} AS share FROM dg", "analyte", "cgrid"))
def definitional(spark, sf):
    return rounded(G.definitional_share(diagnostic_rows(spark, sf), G.already_met("ratio", "rise", 8.0, 60.0), "ratio"))


@query("E29_forecast_tasks", with_ctes(f"""WITH {_DIAG}, c AS (SELECT *, unnest(['all', 'forecast', 'forecast_early']) AS task FROM dg),
    k AS (SELECT * FROM c WHERE task = 'all' OR y = 0 OR (ratio IS NOT NULL AND NOT {_MET} AND (task = 'forecast' OR coalesce(onset_hr - t_hr >= 24, false)))) """ + auc_sql("k", by="task"), "analyte", "cgrid"))
def forecast_tasks(spark, sf):
    return rounded(D.auroc(G.task_rows(diagnostic_rows(spark, sf), G.already_met("ratio", "rise", 8.0, 60.0), "ratio"), by=["task"]))


@query("E30_excess_share", with_ctes(f"""WITH {_DIAG}, k AS (SELECT * FROM dg WHERE ratio IS NOT NULL), a AS ({auc_sql('k').replace(', 6) + 0) AS auroc', ', 12) + 0) AS auroc')}), b AS ({auc_sql('k', p='ratio').replace(', 6) + 0) AS auroc', ', 12) + 0) AS auroc')})
    SELECT a.n_pos, a.n_neg, {r('a.auroc')} AS auroc_score, {r('b.auroc')} AS auroc_feature, {r('(b.auroc - 0.5) / (a.auroc - 0.5)', 4)} AS share FROM a, b""", "analyte", "cgrid"))
def excess_share(spark, sf):
    out = G.excess_share(diagnostic_rows(spark, sf), "ratio")
    return out.select("n_pos", "n_neg", F.round("auroc_score", 6).alias("auroc_score"), F.round("auroc_feature", 6).alias("auroc_feature"), F.round("share", 4).alias("share"))


@query("E31_complete_horizon", with_ctes(f"WITH {_DIAG}, c AS (SELECT dg.*, CASE WHEN dg.t_hr + 168 <= least(los_h, 672) THEN 'complete' WHEN dg.t_hr > los_h - 168 THEN 'los_truncated' ELSE 'window_capped' END AS visibility FROM dg JOIN cgrid USING (entity, t_hr)) " + auc_sql("c", by="visibility"), "analyte", "cgrid"))
def complete_horizon(spark, sf):
    los = stays(spark, sf).select("entity", (F.col("los_h") - 120.0).alias("los_h"))
    rows = diagnostic_rows(spark, sf).join(los, "entity").withColumn("visibility", K.visibility(clock=CLOCK))
    return rounded(D.auroc(rows, by=["visibility"]))


@query("E32_band_rates", with_ctes(f"SELECT CASE WHEN p < 0.2 THEN 0 WHEN p < 0.3 THEN 1 ELSE 2 END AS band, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, {r('avg(y)')} AS rate FROM pred GROUP BY 1", "pred"))
def band_rates(spark, sf):
    return rounded(predictions(spark, sf).groupBy(N.band("p", (0.2, 0.3)).alias("band")).agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), F.avg("y").alias("rate")))


@query("E33_transform_invariance", with_ctes(f"WITH a AS ({auc_sql('pred')}) SELECT 'auroc' AS metric, auroc AS expected, 1e-9::DOUBLE AS tolerance, auroc AS got, 1 AS ok FROM a", "pred"))
def invariance(spark, sf):
    pr = predictions(spark, sf)
    rec = pr.withColumn("p", N.recalibrate("p", *LAYER))
    expected = D.auroc(pr).select(F.lit("auroc").alias("metric"), F.col("auroc").alias("expected"), F.lit(1e-9).alias("tolerance"))
    out = Q.check(D.auroc(rec).select(F.lit("auroc").alias("metric"), F.col("auroc").alias("value")), expected)
    return out.select("metric", F.round("expected", 6).alias("expected"), "tolerance", F.round("got", 6).alias("got"), "ok")
