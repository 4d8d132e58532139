"""Queries for the cluster bootstrap family and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B
from tidemark.operators import calibration as C
from tidemark.operators import diagnostics as G
from tidemark.operators import ordered as O
from tidemark.operators import resampled as P
from tidemark.operators import sampling as L
from tidemark.operators import summary as A
from tidemark.plans.cleaning_queries import P_REC
from tidemark.plans.fixtures import CTE, LAYER, endpoints, predictions, r, rounded, table, with_ctes
from tidemark.plans.metric_queries import BIN, _CLASSES, _GROUPED, masks, newton_sql
from tidemark.plans.registry import query
from tidemark.plans.timeline_queries import mixed_stages
from tidemark.session import stage

REPLICATES = 500

CTE["owned"] = ("SELECT pred.*, o_custkey AS subject, c_nationkey AS nation, o_orderstatus AS cohort FROM pred JOIN orders ON entity = o_orderkey JOIN customer ON o_custkey = c_custkey", ("pred",))


def owned(spark, sf):
    """Predictions with subject, nation and cohort of their entity."""
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("cohort"))
    cu = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("nation"))
    return predictions(spark, sf).join(od, "entity").join(cu, "subject")


def draws_sql(keys: str, source: str, seed: int = 42, name: str = "w", replicates: int = REPLICATES, text: str | None = None) -> str:
    """Multiplicities of every unit in every replicate."""
    text = text or keys
    base = f"(SELECT DISTINCT {keys}, ('0x' || substr(md5('{seed}|' || {text}), 1, 8))::BIGINT AS b FROM {source}), (SELECT unnest(range(1, {replicates + 1})) AS replicate)"
    return mixed_stages(base, "b", "replicate", name, keep=f"{keys}, replicate")


def weighted_auc_sql(source: str, by: str, digits: int = 12) -> str:
    """AUROC per group of rows (``by``, y, p, w)."""
    return (f"SELECT {by}, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), {digits}) AS auroc FROM (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY p) - neg AS below FROM "
            f"(SELECT {by}, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM {source} GROUP BY {by}, p)) GROUP BY {by}")


_CI = f"count(auroc) AS n_valid, {r('avg(auroc)')} AS mean, {r('stddev_samp(auroc)')} AS se, {r('quantile_cont(auroc, 0.025)')} AS lo, {r('quantile_cont(auroc, 0.975)')} AS hi"


@query("E12_cluster_bootstrap", with_ctes(f"WITH k AS MATERIALIZED ({draws_sql('entity', 'pred')}), b AS ({weighted_auc_sql('(SELECT * FROM ends JOIN k USING (entity))', 'endpoint, replicate')}) SELECT endpoint, {_CI} FROM b GROUP BY 1", "ends"))
def cluster_bootstrap(spark, sf):
    reps = B.bootstrap_auroc(endpoints(spark, sf), ["entity"], replicates=REPLICATES, by=["endpoint"])
    return rounded(B.interval(reps, by=["endpoint"]))


@query("E12_small_blocks", with_ctes(f"WITH k AS MATERIALIZED ({draws_sql('entity', 'pred')}), b AS ({weighted_auc_sql('(SELECT * FROM pred JOIN k USING (entity))', 'replicate')}) SELECT replicate, {r('auroc')} AS auroc FROM b", "pred"))
def small_blocks(spark, sf):
    """The same replicates with many score blocks, heavy scores spread over several of them."""
    pr = predictions(spark, sf)
    reps = B.bootstrap_auroc(pr, ["entity"], replicates=REPLICATES, points=O.split_points(pr, "p", rows_per_piece=2_000))
    return rounded(reps.select("replicate", "auroc"))


@query("E12_additive_metric", with_ctes(f"WITH k AS MATERIALIZED ({draws_sql('entity', 'pred')}) SELECT replicate, CAST(sum(w) AS BIGINT) AS n, {r('sum(w * (p - y) * (p - y)) / sum(w)')} AS brier FROM pred JOIN k USING (entity) GROUP BY 1", "pred"))
def additive(spark, sf):
    err = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    reps = B.resample(predictions(spark, sf), ["entity"], {"n": F.lit(1), "sq": err}, REPLICATES)
    return rounded(reps.select("replicate", "n", (F.col("sq") / F.col("n")).alias("brier")))


def discrimination_sql(source: str, by: str) -> str:
    """AUROC, average precision and lift per group of rows (``by``, y, p, w), from one row per score."""
    return (f"SELECT {by}, CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, {r('sum(pos * (below + neg / 2)) / nullif(max(np) * max(nn), 0)')} AS auroc, {r('sum(pos * tp / nullif(tp + fp, 0)) / nullif(max(np), 0)')} AS auprc, "
            f"{r('max(np) / (max(np) + max(nn))')} AS prevalence, {r('sum(pos * tp / nullif(tp + fp, 0)) / nullif(max(np), 0) / (max(np) / (max(np) + max(nn)))')} AS lift FROM "
            f"(SELECT *, sum(neg) OVER up - neg AS below, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp, sum(pos) OVER (PARTITION BY {by}) AS np, sum(neg) OVER (PARTITION BY {by}) AS nn FROM "
            f"(SELECT {by}, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM {source} GROUP BY {by}, p) WINDOW up AS (PARTITION BY {by} ORDER BY p), down AS (PARTITION BY {by} ORDER BY p DESC)) GROUP BY {by}")


@query("E12_average_precision", with_ctes(f"WITH k AS MATERIALIZED ({draws_sql('entity', 'pred')}) " + discrimination_sql("(SELECT * FROM pred JOIN k USING (entity))", "replicate"), "pred"))
def average_precision(spark, sf):
    return rounded(B.bootstrap_discrimination(predictions(spark, sf), ["entity"], replicates=REPLICATES))


@query("E12_average_precision_blocks", with_ctes(f"WITH k AS MATERIALIZED ({draws_sql('entity', 'pred')}) " + discrimination_sql("(SELECT * FROM ends JOIN k USING (entity))", "endpoint, replicate"), "ends"))
def average_precision_blocks(spark, sf):
    """The same by endpoint with many score blocks, so that running totals cross them."""
    rows = endpoints(spark, sf)
    return rounded(B.bootstrap_discrimination(rows, ["entity"], replicates=REPLICATES, by=["endpoint"], points=[0.1, 0.13, 0.17, 0.2, 0.23, 0.27, 0.3]))


@query("E21_gradient_intervals", with_ctes(f"WITH c AS MATERIALIZED (SELECT * FROM ({_CLASSES}) WHERE y = 0 OR class = 'any' OR (class = 'light' AND ge3 = 0) OR (class = 'severe' AND ge3 = 1)), k AS MATERIALIZED ({draws_sql('entity', 'pred')}), "
                                           f"b AS ({weighted_auc_sql('(SELECT * FROM c JOIN k USING (entity))', 'class, replicate')}) SELECT class, {_CI} FROM b GROUP BY 1", "pred"))
def gradient_intervals(spark, sf):
    rows = G.severity_classes(predictions(spark, sf), {"any": F.lit(True), "light": F.col("ge3") == 0, "severe": F.col("ge3") == 1})
    return rounded(B.interval(B.bootstrap_auroc(rows, ["entity"], replicates=REPLICATES, by=["class"]), by=["class"]))


@query("E23_subgroup_intervals", with_ctes(f"WITH c AS MATERIALIZED ({_GROUPED}), k AS MATERIALIZED ({draws_sql('entity', 'pred')}), b AS ({weighted_auc_sql('(SELECT * FROM c JOIN k USING (entity))', 'subgroup, replicate')}) SELECT subgroup, {_CI} FROM b GROUP BY 1", "pred"))
def subgroup_intervals(spark, sf):
    rows = G.in_subgroups(predictions(spark, sf), masks())
    return rounded(B.interval(B.bootstrap_auroc(rows, ["entity"], replicates=REPLICATES, by=["subgroup"]), by=["subgroup"]))


@query("E13_subject_unit", with_ctes(f"WITH k AS MATERIALIZED ({draws_sql('subject', 'owned')}), b AS ({weighted_auc_sql('(SELECT * FROM owned JOIN k USING (subject))', 'cohort, replicate')}) SELECT cohort, {_CI} FROM b GROUP BY 1", "owned"))
def subject_unit(spark, sf):
    return rounded(B.interval(B.bootstrap_auroc(owned(spark, sf), ["subject"], replicates=REPLICATES, by=["cohort"]), by=["cohort"]))


_ROWKEY = "entity || '|' || CAST(t_hr AS VARCHAR)"


@query("E13_row_unit", with_ctes(f"WITH k AS MATERIALIZED ({draws_sql('entity, t_hr', 'pred', text=_ROWKEY)}), b AS ({weighted_auc_sql('(SELECT * FROM pred JOIN k USING (entity, t_hr))', 'replicate')}) SELECT {_CI} FROM b", "pred"))
def row_unit(spark, sf):
    return rounded(B.interval(B.bootstrap_auroc(predictions(spark, sf), ["entity", "t_hr"], replicates=REPLICATES)))


@query("E14_two_level", with_ctes(f"""WITH k AS MATERIALIZED ({draws_sql('entity', 'owned')}), s AS MATERIALIZED ({draws_sql('nation', 'owned', seed=43, name='ws')}),
    b AS ({weighted_auc_sql('(SELECT owned.*, replicate, k.w * s.ws AS w FROM owned JOIN k USING (entity) JOIN s USING (nation, replicate))', 'replicate')}) SELECT {_CI} FROM b""", "owned"))
def two_level(spark, sf):
    return rounded(B.interval(B.bootstrap_auroc(owned(spark, sf), ["entity"], replicates=REPLICATES, outer="nation")))


@query("E14_site_only", with_ctes(f"WITH s AS MATERIALIZED ({draws_sql('nation', 'owned')}), b AS ({weighted_auc_sql('(SELECT * FROM owned JOIN s USING (nation))', 'replicate')}) SELECT {_CI} FROM b", "owned"))
def site_only(spark, sf):
    return rounded(B.interval(B.bootstrap_auroc(owned(spark, sf), ["nation"], replicates=REPLICATES)))


_TEST = (f"count(*) AS n_valid, {r('avg(delta)')} AS delta, {r('quantile_cont(delta, 0.025)')} AS lo, {r('quantile_cont(delta, 0.975)')} AS hi, "
         f"{r('2 * least(avg((delta <= 0)::INT), avg((delta >= 0)::INT))')} AS p_value")
_PAIRED = f"""k AS MATERIALIZED ({draws_sql('entity', 'pred')}), b AS MATERIALIZED ({weighted_auc_sql('(SELECT * FROM ends JOIN k USING (entity))', 'endpoint, replicate')}),
    d AS (SELECT y.endpoint, replicate, y.auroc - x.auroc AS delta FROM b x JOIN b y USING (replicate) WHERE x.endpoint = 1 AND y.endpoint > 1)"""


def paired_deltas(spark, sf):
    reps = stage(B.bootstrap_auroc(endpoints(spark, sf), ["entity"], replicates=REPLICATES, by=["endpoint"]))
    first = reps.filter("endpoint = 1").select("replicate", F.col("auroc").alias("_a"))
    return reps.filter("endpoint > 1").join(first, "replicate").select("endpoint", "replicate", (F.col("auroc") - F.col("_a")).alias("delta"))


@query("E15_paired_difference", with_ctes(f"WITH {_PAIRED} SELECT endpoint, {_TEST} FROM d GROUP BY 1", "ends"))
def paired(spark, sf):
    return rounded(B.difference_test(paired_deltas(spark, sf), ["endpoint"]))


@query("E15_two_scores", with_ctes(f"""WITH k AS MATERIALIZED ({draws_sql('entity', 'pred')}), x AS ({weighted_auc_sql('(SELECT * FROM pred JOIN k USING (entity))', 'replicate')}),
    z AS ({weighted_auc_sql('(SELECT entity, y, q AS p, replicate, w FROM pred JOIN k USING (entity))', 'replicate')}), d AS (SELECT z.auroc - x.auroc AS delta FROM x JOIN z USING (replicate)) SELECT {_TEST} FROM d""", "pred"))
def two_scores(spark, sf):
    both = F.array(F.struct(F.lit("p").alias("score"), F.col("p").alias("s")), F.struct(F.lit("q").alias("score"), F.col("q").alias("s")))
    long = predictions(spark, sf).select("entity", "y", F.inline(both))
    reps = stage(B.bootstrap_auroc(long, ["entity"], p="s", replicates=REPLICATES, by=["score"]))
    left, right = (reps.filter(F.col("score") == name).drop("score") for name in ("p", "q"))
    return rounded(B.difference_test(B.difference(left, right)))


@query("E16_unpaired_difference", with_ctes(f"""WITH k AS MATERIALIZED ({draws_sql('entity', 'owned')}), b AS MATERIALIZED ({weighted_auc_sql('(SELECT * FROM owned JOIN k USING (entity))', 'cohort, replicate')}),
    d AS (SELECT y.auroc - x.auroc AS delta FROM b x JOIN b y USING (replicate) WHERE x.cohort = 'F' AND y.cohort = 'O') SELECT {_TEST} FROM d""", "owned"))
def unpaired(spark, sf):
    # The cohorts share no entity, so hashed draws are independent between them.
    reps = stage(B.bootstrap_auroc(owned(spark, sf).filter("cohort IN ('F', 'O')"), ["entity"], replicates=REPLICATES, by=["cohort"]))
    return rounded(B.difference_test(B.difference(reps.filter("cohort = 'F'"), reps.filter("cohort = 'O'"))))


CAL_REPLICATES = 1000
_RANKS = ", ".join(f"floor({i / 10!r}::DOUBLE * (n - 1)), ceil({i / 10!r}::DOUBLE * (n - 1))" for i in range(11))
_CAL = f"""k AS MATERIALIZED ({draws_sql('entity', 'pred', replicates=CAL_REPLICATES)}), j AS MATERIALIZED (SELECT replicate, p, sum(w)::DOUBLE AS w, sum(w * y)::DOUBLE AS pos FROM pred JOIN k USING (entity) WHERE w > 0 GROUP BY 1, 2),
    v AS MATERIALIZED (SELECT replicate, version, CASE WHEN version = 'raw' THEN p ELSE {P_REC} END AS p, w, pos, replicate * 2 + (version = 'raw')::INT AS g FROM j, (SELECT unnest(['raw', 'recalibrated']) AS version)),
    o AS (SELECT g, p, sum(w) OVER (PARTITION BY g ORDER BY p) - w AS below, w, sum(w) OVER (PARTITION BY g) AS n FROM v), wr AS (SELECT g, unnest([{_RANKS}]) AS rank, unnest(range(22)) AS i FROM (SELECT g, sum(w) AS n FROM v GROUP BY 1)),
    s AS (SELECT wr.g, i // 2 AS e, max(p) FILTER (i % 2 = 0) AS lo, max(p) FILTER (i % 2 = 1) AS hi, max(n) AS n FROM wr JOIN o ON wr.g = o.g AND rank >= below AND rank < below + w GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT g, list_sort(list_distinct(list(lo + (hi - lo) * (e / 10.0::DOUBLE * (n - 1) - floor(e / 10.0::DOUBLE * (n - 1)))))) AS edges FROM s GROUP BY 1),
    q AS (SELECT g, bin, sum(w) AS n, sum(w * p) / sum(w) AS pr, sum(pos) / sum(w) AS ob FROM (SELECT v.*, CAST({BIN.format('p')} AS INT) AS bin FROM v JOIN e USING (g)) GROUP BY 1, 2), c AS MATERIALIZED (SELECT g, sum(n * abs(ob - pr)) / sum(n) AS ece FROM q GROUP BY 1),
    m AS MATERIALIZED (SELECT replicate, version, g, sum(w) AS n, sum(pos * (1 - p) * (1 - p) + (w - pos) * p * p) / sum(w) AS brier, sum(pos) / sum(w) AS prevalence FROM v GROUP BY 1, 2, 3)"""


@query("E18_calibration_replicates", with_ctes(f"WITH {_CAL}, " + newton_sql("v", "g", f"""SELECT replicate, version, CAST(n AS BIGINT) AS n, {r('brier')} AS brier, {r('prevalence')} AS prevalence, {r('prevalence * (1 - prevalence)')} AS brier_null,
    {r('1 - brier / (prevalence * (1 - prevalence))')} AS skill, {r('ece')} AS ece, {r('b', 4)} AS slope FROM {{params}} JOIN m USING (g) JOIN c USING (g)""", counts="SELECT g, ln(p / (1 - p)) AS z, w AS n, pos FROM v")[5:], "pred"))
def calibration_replicates(spark, sf):
    out = P.calibration_replicates(predictions(spark, sf), ["entity"], CAL_REPLICATES, *LAYER)
    return out.select("replicate", "version", "n", F.round("slope", 4).alias("slope"), *[F.round(c, 6).alias(c) for c in ("brier", "prevalence", "brier_null", "skill", "ece")])


@query("E18_calibration_intervals", with_ctes(f"WITH {_CAL} SELECT version, count(*) AS n_valid, {r('avg(ece)')} AS mean, {r('stddev_samp(ece)')} AS se, {r('quantile_cont(ece, 0.025)')} AS lo, {r('quantile_cont(ece, 0.975)')} AS hi FROM m JOIN c USING (g) GROUP BY 1", "pred"))
def calibration_intervals(spark, sf):
    """Interval of the calibration error, from replicates (over many score blocks where scores are many)."""
    reps = P.calibration_replicates(predictions(spark, sf), ["entity"], CAL_REPLICATES, *LAYER, steps=1, points=[0.1, 0.14, 0.17, 0.2, 0.26, 0.31])
    return rounded(B.interval(reps, "ece", ["version"]))


_EQ = (f"count(*) AS n_valid, {r('stddev_samp(delta)')} AS se, {r('avg((delta <= -0.05)::INT)')} AS p_lower, {r('avg((delta >= 0.05)::INT)')} AS p_upper, {r('quantile_cont(delta, 0.05)')} AS lo90, {r('quantile_cont(delta, 0.95)')} AS hi90, "
       f"{r('quantile_cont(delta, 0.025)')} AS lo95, {r('quantile_cont(delta, 0.975)')} AS hi95, {r('greatest(avg((delta <= -0.05)::INT), avg((delta >= 0.05)::INT))')} AS p_tost, "
       f"(quantile_cont(delta, 0.05) > -0.05 AND quantile_cont(delta, 0.95) < 0.05)::INT AS equivalent, {r('greatest(abs(quantile_cont(delta, 0.05)), abs(quantile_cont(delta, 0.95)))')} AS min_margin")


@query("E19_equivalence", with_ctes(f"WITH {_PAIRED} SELECT endpoint, {_EQ} FROM d GROUP BY 1", "ends"))
def equivalence(spark, sf):
    return rounded(B.equivalence(paired_deltas(spark, sf), by=["endpoint"]))


@query("E19_pooled_equivalence", with_ctes(f"""WITH {_PAIRED}, e AS (SELECT endpoint, avg(delta) AS d, stddev_samp(delta) AS se FROM d GROUP BY 1), s AS (SELECT count(*) AS k, sum(1 / (se * se)) AS w, sum(d / (se * se)) AS wd FROM e),
    q AS (SELECT sum((d - wd / w) * (d - wd / w) / (se * se)) AS q FROM e, s) SELECT k, {r('wd / w')} AS pooled, {r('1 / sqrt(w)')} AS se_fixed, {r('q', 4)} AS q, k - 1 AS df, {r('greatest(0, (q - (k - 1)) / q)', 4)} AS i2 FROM s, q""", "ends"))
def pooled_equivalence(spark, sf):
    per = paired_deltas(spark, sf).groupBy("endpoint").agg(F.avg("delta").alias("delta"), F.stddev_samp("delta").alias("se"))
    out = A.pool(per)
    return out.select("k", F.round("pooled", 6).alias("pooled"), F.round("se_fixed", 6).alias("se_fixed"), F.round("q", 4).alias("q"), "df", F.round("i2", 4).alias("i2"))


_HB = "hb AS MATERIALIZED (SELECT *, CASE WHEN d = 0 THEN 0 WHEN d <= 6 THEN 1 WHEN d <= 18 THEN 2 ELSE 3 END AS bin FROM (SELECT *, max(t_hr) OVER (PARTITION BY entity, endpoint) - t_hr AS d FROM ends))"
_STD = """sh AS (SELECT {g}endpoint, bin, sum({w} * y) / sum(sum({w} * y)) OVER (PARTITION BY {g}endpoint)::DOUBLE AS own FROM {src} GROUP BY {g}endpoint, bin),
    tg AS (SELECT {g}bin, own AS want FROM sh WHERE endpoint = 3),
    ws AS MATERIALIZED (SELECT h.* EXCLUDE ({x}), CASE WHEN y = 1 THEN {w} * coalesce(want, 0) / own ELSE {w} END AS w FROM {src} h JOIN sh USING ({g}endpoint, bin) LEFT JOIN tg USING ({g}bin))"""


def frac_auc_sql(source: str, by: str) -> str:
    return (f"SELECT {by}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY p) - neg AS below FROM "
            f"(SELECT {by}, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END)::DOUBLE AS neg FROM {source} GROUP BY {by}, p)) GROUP BY {by}")


@query("E20_proximity", with_ctes(f"""WITH {_HB}, h1 AS (SELECT *, 1 AS w FROM hb), {_STD.format(g='', w='w', src='h1', x='w')}, a AS ({frac_auc_sql('ws', 'endpoint')}), b AS ({frac_auc_sql('h1', 'endpoint')})
    SELECT endpoint, {r('b.auroc')} AS raw, {r('a.auroc')} AS standardised FROM a JOIN b USING (endpoint)""", "ends"))
def proximity(spark, sf):
    return rounded(P.proximity_point(endpoints(spark, sf), ["entity"], 3))


@query("E20_proximity_by_bin", with_ctes(f"""WITH {_HB}, c AS (SELECT endpoint, bin, y, p, 1 AS w FROM hb WHERE y = 1 UNION ALL SELECT endpoint, k, y, p, 1 FROM hb, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE y = 0),
    n AS (SELECT endpoint, bin, CAST(sum(y) AS BIGINT) AS n_pos FROM c GROUP BY 1, 2) SELECT endpoint, bin, n_pos, CASE WHEN n_pos >= 10 THEN {r('auroc')} END AS auroc FROM n JOIN ({frac_auc_sql('c', 'endpoint, bin')}) USING (endpoint, bin)""", "ends"))
def proximity_by_bin(spark, sf):
    return rounded(P.proximity_by_bin(endpoints(spark, sf), ["entity"], ["endpoint"]))


@query("E20_proximity_replicates", with_ctes(f"""WITH {_HB}, k AS MATERIALIZED ({draws_sql('entity', 'pred', replicates=CAL_REPLICATES)}), h2 AS MATERIALIZED (SELECT * FROM hb JOIN k USING (entity)), {_STD.format(g='replicate, ', w='w', src='h2', x='w')},
    a AS MATERIALIZED ({frac_auc_sql('ws', 'replicate, endpoint')}) SELECT replicate, o.endpoint, {r('o.auroc')} AS standardised, {r('t.auroc - o.auroc')} AS delta FROM a o JOIN a t USING (replicate) WHERE t.endpoint = 3 AND o.endpoint < 3""", "ends"))
def proximity_replicates(spark, sf):
    return rounded(P.proximity_replicates(endpoints(spark, sf), ["entity"], 3, CAL_REPLICATES))


# ---------------------------------------------------------------- splits


def _ranked_units(key: str, source: str) -> str:
    h = "('0x' || substr(md5('{s}|' || {k}), 1, 8))::BIGINT"
    return (f"SELECT {key}, row_number() OVER (ORDER BY {h.format(s=42, k=key)}, {h.format(s=42 + 7919, k=key)}, {key}) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {source})")


_SLOTS = mixed_stages(f"({_ranked_units('subject', 'owned')}), (SELECT unnest(range(1, 13)) AS replicate)", "pos", "replicate", "at_pos", keep="replicate, n AS n_units, pos", value="CAST(floor(h / 4294967296.0::DOUBLE * n_units) AS BIGINT)")


@query("E12_fixed_size_draws", with_ctes(f"""WITH u AS MATERIALIZED ({_ranked_units('subject', 'owned')}), s AS MATERIALIZED ({_SLOTS}), d AS (SELECT replicate, at_pos, count(*) AS draws FROM s GROUP BY 1, 2)
    SELECT replicate, CAST(sum(draws * k) AS BIGINT) AS n, CAST(sum(draws * pos_y) AS BIGINT) AS n_pos, CAST(sum(draws) AS BIGINT) AS units FROM d JOIN u ON d.at_pos = u.pos
    JOIN (SELECT subject, count(*) AS k, sum(y) AS pos_y FROM owned GROUP BY 1) o USING (subject) GROUP BY 1""", "owned"))
def fixed_size(spark, sf):
    rows = owned(spark, sf)
    draws = B.fixed_size_draws(rows, ["subject"], 12)
    sums = B.resample_with(rows, draws, ["subject"], {"n": F.lit(1), "n_pos": F.col("y")})
    return sums.join(draws.groupBy("replicate").agg(F.sum("draws").alias("units")), "replicate")


EXACT_RATE = 0.8
_EXACT_W = "(" + " + ".join(f"(h >= {c})::INT" for c in B.poisson_cuts(EXACT_RATE)) + ")"
_EXACT = f"""u AS MATERIALIZED ({_ranked_units('entity', 'pred')}), kp AS MATERIALIZED ({mixed_stages(f"(SELECT DISTINCT entity, ('0x' || substr(md5('42|' || entity), 1, 8))::BIGINT AS b FROM pred), (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate)", 'b', 'replicate', 'w', keep='entity, replicate', value=_EXACT_W)}),
    ms AS (SELECT replicate, (SELECT count(*) FROM u) AS n_units, (SELECT count(*) FROM u) - sum(w) AS missing FROM kp GROUP BY 1),
    xt AS (SELECT replicate, at_pos, count(*) AS extra FROM ({mixed_stages("(SELECT replicate, n_units, unnest(range(1::BIGINT, missing::BIGINT + 1)) AS slot FROM ms)", 'slot', 'replicate', 'at_pos', keep='replicate, n_units', value="CAST(floor(h / 4294967296.0::DOUBLE * n_units) AS BIGINT)")}) GROUP BY 1, 2),
    k AS MATERIALIZED (SELECT kp.entity, kp.replicate, kp.w + coalesce(extra, 0) AS w FROM kp JOIN u USING (entity) LEFT JOIN xt ON xt.replicate = kp.replicate AND xt.at_pos = u.pos)"""


@query("E12_fixed_size_auroc", with_ctes(f"WITH {_EXACT}, b AS ({weighted_auc_sql('(SELECT * FROM ends JOIN k USING (entity))', 'endpoint, replicate')}) SELECT endpoint, {_CI} FROM b GROUP BY 1", "ends"))
def fixed_size_auroc(spark, sf):
    """Intervals from replicates of exactly as many entities as there are."""
    rows = endpoints(spark, sf)
    draws = B.exact_draws(rows, ["entity"], REPLICATES, rate=EXACT_RATE)
    return rounded(B.interval(B.bootstrap_auroc(rows, ["entity"], replicates=REPLICATES, by=["endpoint"], draws=draws), by=["endpoint"]))


@query("E12_fixed_size_units", with_ctes(f"WITH {_EXACT} SELECT replicate, CAST(sum(w) AS BIGINT) AS units, CAST(sum(w * c) AS BIGINT) AS n, CAST(sum(w * s) AS BIGINT) AS n_pos FROM k JOIN (SELECT entity, count(*) AS c, sum(y) AS s FROM pred GROUP BY 1) USING (entity) GROUP BY 1", "pred"))
def fixed_size_units(spark, sf):
    """What every such replicate holds: units (always all of them), rows and positives."""
    pr = predictions(spark, sf)
    draws = B.exact_draws(pr, ["entity"], REPLICATES, rate=EXACT_RATE)
    sums = B.bootstrap_auroc(pr, ["entity"], replicates=REPLICATES, draws=draws)
    each = pr.groupBy("entity").agg(F.lit(1).alias("y"), F.lit(0.5).alias("p"))
    units = B.bootstrap_auroc(each, ["entity"], replicates=REPLICATES, draws=draws)
    both = sums.join(units.select("replicate", F.col("n_pos").cast("long").alias("units")), "replicate")
    return both.select("replicate", "units", (F.col("n_pos") + F.col("n_neg")).cast("long").alias("n"), F.col("n_pos").cast("long").alias("n_pos"))


@query("L1_group_split", with_ctes(f"WITH u AS ({_ranked_units('subject', 'owned')}) SELECT subject, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM owned JOIN (SELECT subject, pos, n FROM u) USING (subject) GROUP BY 1, 2".replace("count(*) AS n FROM owned", "count(*) AS n_rows FROM owned"), "owned"))
def group_split(spark, sf):
    return L.group_split(owned(spark, sf), "subject").groupBy("subject", "split").agg(F.count("*").alias("n_rows"))


@query("L1_no_overlap", with_ctes(f"""WITH u AS ({_ranked_units('subject', 'owned')}), s AS (SELECT subject, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 1 ELSE 0 END AS tr FROM u), c AS (SELECT subject, tr, count(*) AS k FROM owned JOIN s USING (subject) GROUP BY 1, 2)
    SELECT CAST(sum(k * tr) AS BIGINT) AS train_rows, CAST(sum(k * (1 - tr)) AS BIGINT) AS test_rows, CAST(sum(tr) AS BIGINT) AS train_subjects, CAST(sum(1 - tr) AS BIGINT) AS test_subjects, CAST(0 AS BIGINT) AS shared_subjects FROM c""", "owned"))
def no_overlap(spark, sf):
    return L.leakage(L.group_split(owned(spark, sf), "subject"), "subject")


@query("L2_group_folds", with_ctes("""
    WITH s AS (SELECT subject, count(*) AS k, ('0x' || substr(md5('42|' || subject), 1, 8))::BIGINT AS h FROM owned GROUP BY 1), p AS (SELECT subject, k, row_number() OVER (ORDER BY k + h / 4294967296.0::DOUBLE DESC, subject) - 1 AS p FROM s)
    SELECT CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INT) AS fold, count(*) AS subjects, CAST(sum(k) AS BIGINT) AS n_rows FROM p GROUP BY 1""", "owned"))
def group_folds(spark, sf):
    rows = L.group_folds(owned(spark, sf), "subject", 5)
    return rows.groupBy("subject", "fold").agg(F.count("*").alias("_k")).groupBy("fold").agg(F.count("*").alias("subjects"), F.sum("_k").alias("n_rows"))


def unit_leak_sql(key: str, text: str) -> str:
    h = "('0x' || substr(md5('{s}|' || {t}), 1, 8))::BIGINT"
    return with_ctes(f"""WITH u AS (SELECT {key}, row_number() OVER (ORDER BY {h.format(s=42, t=text)}, {h.format(s=7961, t=text)}, {key}) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM owned)),
        s AS (SELECT {key}, (pos < floor(n * 0.7::DOUBLE))::INT AS tr FROM u), c AS (SELECT subject, sum(tr) AS a, sum(1 - tr) AS b FROM owned JOIN s USING ({key}) GROUP BY 1)
        SELECT CAST(sum(a) AS BIGINT) AS train_rows, CAST(sum(b) AS BIGINT) AS test_rows, count(*) FILTER (a > 0) AS train_subjects, count(*) FILTER (b > 0) AS test_subjects, count(*) FILTER (a > 0 AND b > 0) AS shared_subjects FROM c""", "owned")


@query("L3_row_split_leaks", unit_leak_sql("entity, t_hr", "entity || '|' || CAST(t_hr AS VARCHAR)"))
def row_split(spark, sf):
    return L.leakage(L.group_split(owned(spark, sf), ["entity", "t_hr"], 0.7), "subject")


@query("L3_entity_split_leaks", unit_leak_sql("entity", "entity"))
def entity_split(spark, sf):
    return L.leakage(L.group_split(owned(spark, sf), "entity", 0.7), "subject")


@query("L4_year_split", "SELECT CASE WHEN y <= 1996 THEN 'train' WHEN y <= 1998 THEN 'select' WHEN y IS NOT NULL THEN 'test' END AS period, count(*) AS n FROM (SELECT year(l_shipdate) AS y FROM lineitem) GROUP BY 1")
def year_split(spark, sf):
    li = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y"))
    return li.groupBy(L.year_split("y", 1996, 1998).alias("period")).agg(F.count("*").alias("n"))


@query("L5_era_split", "WITH o AS (SELECT o_orderstatus, epoch(o_orderdate)::DOUBLE AS s FROM orders), m AS (SELECT o_orderstatus, quantile_cont(s, 0.5) AS mid FROM o GROUP BY 1) SELECT o_orderstatus, CASE WHEN s <= mid THEN 'early' ELSE 'late' END AS era, count(*) AS n FROM o JOIN m USING (o_orderstatus) GROUP BY 1, 2")
def era_split(spark, sf):
    od = table(spark, sf, "orders").select("o_orderstatus", (F.unix_date(F.col("o_orderdate").cast("date")) * F.lit(86400.0)).alias("s"))
    return L.era_split(od, "s", ["o_orderstatus"]).groupBy("o_orderstatus", "era").agg(F.count("*").alias("n"))


@query("L6_sample_rows", with_ctes("SELECT entity, t_hr FROM pred ORDER BY ('0x' || substr(md5('42|' || entity || '|' || CAST(t_hr AS VARCHAR)), 1, 8))::BIGINT, entity, t_hr LIMIT 4000", "pred"))
def sample_rows(spark, sf):
    return L.sample_rows(predictions(spark, sf).select("entity", "t_hr"), 4000, ["entity", "t_hr"])


@query("L6_half_splits", with_ctes("SELECT repeat, CASE WHEN ('0x' || substr(md5('42|' || entity || '|' || repeat), 1, 8))::BIGINT < 2147483648 THEN 0 ELSE 1 END AS half, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM pred, (SELECT unnest(range(1, 4)) AS repeat) GROUP BY 1, 2".replace("SELECT repeat,", "SELECT CAST(repeat AS INT) AS repeat,"), "pred"))
def half_splits(spark, sf):
    return L.half_splits(predictions(spark, sf), ["entity"], 3).groupBy("repeat", "half").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


_RH = "('0x' || substr(md5('{s}|' || entity || '|' || CAST(t_hr AS VARCHAR) || '|' || repeat), 1, 8))::BIGINT"
_HALVES = (f"hf AS MATERIALIZED (SELECT repeat, y, p, CASE WHEN row_number() OVER (PARTITION BY repeat ORDER BY {_RH.format(s=42)}, {_RH.format(s=42 + L.TIE)}, entity, t_hr) <= n // 2 THEN 0 ELSE 1 END AS half "
           "FROM (SELECT *, count(*) OVER () AS n FROM pred), (SELECT unnest(range(1, 21)) AS repeat))")


@query("L6_exact_halves", with_ctes(f"WITH {_HALVES} SELECT CAST(repeat AS INT) AS repeat, half, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM hf GROUP BY 1, 2", "pred"))
def exact_halves(spark, sf):
    return L.exact_halves(predictions(spark, sf), ["entity", "t_hr"], 20).groupBy("repeat", "half").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


_REFIT = f"""{_HALVES}, ly AS MATERIALIZED ({newton_sql("(SELECT * FROM hf WHERE half = 0)", "repeat", "SELECT repeat, a, b FROM {params}")}), ot AS MATERIALIZED (SELECT repeat, y, 1 / (1 + exp(-(a + b * ln(p / (1 - p))))) AS p FROM hf JOIN ly USING (repeat) WHERE half = 1),
    e AS MATERIALIZED (SELECT repeat, list_sort(list_distinct(quantile_cont(p, [{', '.join(repr(i / 10) for i in range(11))}]))) AS edges FROM ot GROUP BY 1), q AS (SELECT repeat, bin, count(*) AS n, avg(p) AS pr, avg(y) AS ob FROM (SELECT ot.*, CAST({BIN.format('p')} AS INT) AS bin FROM ot JOIN e USING (repeat)) GROUP BY 1, 2),
    hr AS MATERIALIZED (SELECT * FROM (SELECT repeat, sum(n * abs(ob - pr)) / sum(n) AS ece FROM q GROUP BY 1) JOIN (SELECT repeat, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM ot GROUP BY 1) USING (repeat) JOIN ly USING (repeat))"""


@query("L6_half_recalibration", with_ctes(f"WITH {_REFIT} SELECT CAST(repeat AS INT) AS repeat, n, {r('a', 4)} AS a, {r('b', 4)} AS b, {r('ece', 5)} AS ece, {r('brier')} AS brier FROM hr", "pred"))
def half_recalibration(spark, sf):
    """Twenty random halves: the layer of one, checked on the other."""
    out = C.half_sample_recalibration(predictions(spark, sf), ["entity", "t_hr"])
    return out.select("repeat", "n", *[F.round(c, d).alias(c) for c, d in (("a", 4), ("b", 4), ("ece", 5), ("brier", 6))])


@query("L6_half_recalibration_medians", with_ctes(f"WITH {_REFIT} SELECT count(*) AS n_repeats, {r('quantile_cont(ece, 0.5)', 5)} AS ece_median, {r('quantile_cont(brier, 0.5)')} AS brier_median FROM hr", "pred"))
def half_recalibration_medians(spark, sf):
    out = C.half_sample_recalibration(predictions(spark, sf), ["entity", "t_hr"])
    return out.agg(F.count("*").alias("n_repeats"), F.round(F.percentile("ece", 0.5), 5).alias("ece_median"), F.round(F.percentile("brier", 0.5), 6).alias("brier_median"))


@query("L7_class_weights", with_ctes(f"WITH c AS (SELECT endpoint, y, count(*) AS n FROM ends GROUP BY 1, 2) SELECT endpoint, y, n, {r('sum(n) OVER (PARTITION BY endpoint) / (2.0::DOUBLE * n)')} AS class_weight FROM c", "ends"))
def class_weights(spark, sf):
    rows = L.class_weights(endpoints(spark, sf), by=["endpoint"])
    return rounded(rows.groupBy("endpoint", "y").agg(F.count("*").alias("n"), F.max("class_weight").alias("class_weight")))
