"""Queries for joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B
from tidemark.operators import checkpoints as K
from tidemark.operators import cleaning as C
from tidemark.operators import cohort as H
from tidemark.operators import discrimination as D
from tidemark.operators import ordered as O
from tidemark.operators import quality as Q
from tidemark.operators import sampling as L
from tidemark.operators import sketches as S
from tidemark.operators import summary as A
from tidemark.operators import timeline as T
from tidemark.plans.cleaning_queries import CLASSES, sparse_wide, _SPARSE
from tidemark.plans.fixtures import FAMILIES, endpoints, full_grid, predictions, r, rounded, series, sites, stays, table, with_ctes
from tidemark.plans.registry import query
from tidemark.session import stage

# ---------------------------------------------------------------- joins


@query("J1_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def inner(spark, sf):
    cu = table(spark, sf, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(cu, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("J2_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left(spark, sf):
    od = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    cu = table(spark, sf, "customer").select("c_custkey")
    return cu.join(od, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("J3_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi(spark, sf):
    cu = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(cu, "o_custkey", "left_semi").select("o_orderkey")


@query("J4_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark, sf):
    od = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(od, "c_custkey", "left_anti")


@query("J5_lookup", with_ctes("SELECT site, count(*) AS n, CAST(sum(CASE WHEN site IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM sited GROUP BY 1", "sited"))
def lookup(spark, sf):
    return sites(spark, sf).groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("site").isNull()).alias("unmatched"))


def as_of_points(spark, sf):
    return full_grid(spark, sf).select("entity", (F.col("t_hr") + F.col("entity") / 1000.0).alias("t_hr"))


@query("J6_as_of", with_ctes(f"""
    WITH g AS (SELECT entity, t_hr + entity / 1000.0::DOUBLE AS t_hr FROM full_grid), s AS (SELECT * FROM series WHERE fam = 'view')
    SELECT g.entity, {r('g.t_hr')} AS t_hr, s.val AS locf, {r('g.t_hr - s.hr')} AS locf_age FROM g ASOF LEFT JOIN s ON g.entity = s.entity AND g.t_hr >= s.hr""", "series", "full_grid"))
def as_of(spark, sf):
    return rounded(T.as_of(as_of_points(spark, sf), series(spark, sf).filter("fam = 'view'"), ["entity"]))


@query("J7_trailing_range", with_ctes(f"""
    SELECT g.entity, t_hr, fam, count(*) AS n, {r('sum(val)')} AS total FROM full_grid g JOIN series s ON g.entity = s.entity AND s.hr > t_hr - 72 AND s.hr <= t_hr GROUP BY 1, 2, 3""", "series", "full_grid"))
def trailing(spark, sf):
    hit = T.trailing_join(full_grid(spark, sf).select("entity", "t_hr"), series(spark, sf), ["entity"], 72.0)
    return rounded(hit.groupBy("entity", "t_hr", "fam").agg(F.count("*").alias("n"), F.sum("val").alias("total")))


@query("J8_interval_active", with_ctes("""
    SELECT g.entity, t_hr, max(CASE WHEN s.entity IS NOT NULL THEN 1 ELSE 0 END) AS "on" FROM full_grid g LEFT JOIN series s
      ON g.entity = s.entity AND s.fam = 'view' AND s.hr <= t_hr AND s.hr + s.val / 10 > t_hr GROUP BY 1, 2""", "series", "full_grid"))
def active(spark, sf):
    iv = series(spark, sf).filter("fam = 'view'").select("entity", F.col("hr").alias("start_hr"), (F.col("hr") + F.col("val") / 10).alias("end_hr"))
    return T.interval_active(full_grid(spark, sf).select("entity", "t_hr"), iv, ["entity"])


@query("J9_cumulative", with_ctes(f"""
    SELECT g.entity, t_hr, count(s.val) AS n, {r('coalesce(sum(s.val), 0)')} AS total FROM full_grid g LEFT JOIN series s ON g.entity = s.entity AND s.fam = 'error' AND s.hr <= t_hr
    GROUP BY 1, 2""", "series", "full_grid"))
def cumulative(spark, sf):
    ev = series(spark, sf).filter("fam = 'error'")
    return rounded(T.running_total(full_grid(spark, sf).select("entity", "t_hr"), ev, ["entity"], "t_hr", "hr", {"n": F.lit(1), "total": F.col("val")}))


@query("J10_aligned_endpoints", with_ctes("SELECT count(*) AS n_keys, CAST(sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) AS BIGINT) AS aligned, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, CAST(sum(c) AS BIGINT) AS n3 FROM (SELECT entity, t_hr, count(DISTINCT endpoint) AS k, max(CASE WHEN endpoint = 1 THEN y END) AS a, max(CASE WHEN endpoint = 2 THEN y END) AS b, max(CASE WHEN endpoint = 3 THEN y END) AS c FROM ends GROUP BY 1, 2)", "ends"))
def aligned(spark, sf):
    own = [F.max(F.when(F.col("endpoint") == e, F.col("y"))).alias(str(e)) for e in (1, 2, 3)]
    wide = endpoints(spark, sf).groupBy("entity", "t_hr").agg(*own)
    return wide.agg(F.count("*").alias("n_keys"), F.count_if(F.col("1").isNotNull() & F.col("2").isNotNull() & F.col("3").isNotNull()).alias("aligned"),
                    F.sum("1").alias("n1"), F.sum("2").alias("n2"), F.sum("3").alias("n3"))


@query("J11_match_report", "SELECT CAST(0 AS BIGINT) AS left_duplicates, CAST(sum((b > 1)::INT) AS BIGINT) AS right_duplicates, CAST(sum((a IS NOT NULL AND b IS NOT NULL)::INT) AS BIGINT) AS matched, CAST(sum((b IS NULL)::INT) AS BIGINT) AS left_only, CAST(sum((a IS NULL)::INT) AS BIGINT) AS right_only, CAST(0 AS BIGINT) AS missing_after_match FROM (SELECT c_custkey AS k, 1 AS a FROM customer) FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders GROUP BY 1) USING (k)")
def match_report(spark, sf):
    cu = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    od = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    return Q.key_report(cu, od, ["k"], "o_totalprice")


@query("J12_expand_grid", with_ctes("SELECT entity, t_hr FROM full_grid", "full_grid"))
def expand(spark, sf):
    return full_grid(spark, sf).select("entity", "t_hr")


@query("J12_replicates", "SELECT c_nationkey, count(*) * 20 AS n FROM customer GROUP BY 1")
def replicates(spark, sf):
    spread = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return spread.groupBy("c_nationkey").agg(F.sum("k").alias("n"))


@query("J13_strata_pairs", "WITH s AS (SELECT year(o_orderdate) AS yr, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1) SELECT CAST(sum(CASE WHEN b.v > a.v THEN 1 WHEN b.v < a.v THEN -1 ELSE 0 END) AS BIGINT) AS s, count(*) AS pairs FROM s a JOIN s b ON a.yr < b.yr")
def strata_pairs(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    # One row per year: a self join of a report table.
    pair = s.alias("a").join(s.alias("b"), F.col("a.yr") < F.col("b.yr"))
    return pair.agg(F.sum(F.signum(F.col("b.v") - F.col("a.v")).cast("int")).alias("s"), F.count("*").alias("pairs"))


@query("J14_history", "SELECT o.o_orderkey, count(l_partkey) AS history_rows FROM orders o JOIN orders h ON o.o_custkey = h.o_custkey JOIN lineitem ON l_orderkey = h.o_orderkey GROUP BY 1")
def history(spark, sf):
    od = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("l_partkey").alias("k"))
    per_customer = od.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("k").alias("history_rows"))
    return od.join(per_customer, "o_custkey").select("o_orderkey", "history_rows")


@query("J15_contains_join", "SELECT p_partkey, tag FROM part JOIN (VALUES ('red', 'warm'), ('widget', 'part_w'), ('ring', 'part_r'), ('small', 'size_s')) t(word, tag) ON contains(lower(p_name), word)")
def contains_join(spark, sf):
    from tidemark.functions.text import every_match

    return table(spark, sf, "part").select("p_partkey", F.explode(every_match("p_name", CLASSES)).alias("tag"))


# ---------------------------------------------------------------- aggregates


@query("A1_basic", with_ctes(f"SELECT entity, fam, count(*) AS n, min(val) AS lo, max(val) AS hi, {r('sum(val)')} AS total FROM series GROUP BY 1, 2", "series"))
def basic(spark, sf):
    return rounded(series(spark, sf).groupBy("entity", "fam").agg(F.count("*").alias("n"), F.min("val").alias("lo"), F.max("val").alias("hi"), F.sum("val").alias("total")))


@query("A2_first_last", with_ctes("SELECT entity, fam, arg_min(val, (hr, val)) AS first, arg_max(val, (hr, val)) AS last FROM series GROUP BY 1, 2", "series"))
def first_last(spark, sf):
    order = F.struct("hr", "val")
    return series(spark, sf).groupBy("entity", "fam").agg(F.min_by("val", order).alias("first"), F.max_by("val", order).alias("last"))


@query("A3_distinct", with_ctes("SELECT count(DISTINCT entity) AS entities, count(DISTINCT CASE WHEN y = 1 THEN entity END) AS event_entities, count(DISTINCT suppkey) AS suppliers FROM pred", "pred"))
def distinct(spark, sf):
    return predictions(spark, sf).agg(F.count_distinct("entity").alias("entities"), F.count_distinct(F.when(F.col("y") == 1, F.col("entity"))).alias("event_entities"),
                                      F.count_distinct("suppkey").alias("suppliers"))


@query("A4_exact_quantiles", f"SELECT l_returnflag, count(*) AS n, {r('quantile_cont(l_extendedprice, 0.25)')} AS p25, {r('quantile_cont(l_extendedprice, 0.5)')} AS p50, {r('quantile_cont(l_extendedprice, 0.75)')} AS p75 FROM lineitem GROUP BY 1")
def exact_quantiles(spark, sf):
    return rounded(O.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["l_returnflag"]))


SKETCHED = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def within_error(spark, sf, sketches, by):
    """Rows, exact extremes and whether each quartile's exact rank error stays within twice the stated error."""
    rows = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    answers = S.sketched_quantiles(sketches, {"low": 0.0, **SKETCHED, "high": 1.0}, by)
    errors = S.measured_errors(rows, "l_extendedprice", answers, SKETCHED, by).drop("n")
    ok = [(F.col(f"e_{k}") <= 2 * S.rank_error()).cast("int").alias(f"{k}_ok") for k in SKETCHED]
    return rounded(O.join_on(answers, errors, by).select(*by, "n", "low", "high", *ok))


_WITHIN = f"count(*) AS n, {r('min(l_extendedprice)')} AS low, {r('max(l_extendedprice)')} AS high, 1::INT AS p25_ok, 1::INT AS p50_ok, 1::INT AS p75_ok FROM lineitem"


@query("A4_sketched_quantiles", f"SELECT l_returnflag, {_WITHIN} GROUP BY 1")
def sketched_quantiles(spark, sf):
    sketches = stage(S.rank_sketches(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))
    return within_error(spark, sf, sketches, ["l_returnflag"])


@query("A4_merged_sketches", f"SELECT l_returnflag, {_WITHIN} GROUP BY 1 UNION ALL SELECT 'all' AS l_returnflag, {_WITHIN}")
def merged_sketches(spark, sf):
    """One sketch per flag and day is kept; flags and the whole table are merged from these rows alone."""
    rows = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    daily = stage(S.rank_sketches(rows, "l_extendedprice", ["l_returnflag", "day"]))
    flags = within_error(spark, sf, stage(S.merge_sketches(daily, ["l_returnflag"])), ["l_returnflag"])
    whole = within_error(spark, sf, stage(S.merge_sketches(daily)), [])
    return flags.unionByName(whole.withColumn("l_returnflag", F.lit("all")))


@query("A4_quantiles_by_entity", with_ctes(f"SELECT entity, fam, {r('quantile_cont(val, 0.5)')} AS median FROM series GROUP BY 1, 2", "series"))
def entity_quantiles(spark, sf):
    return rounded(O.quantiles(series(spark, sf), "val", {"median": 0.5}, ["entity", "fam"]).drop("n"))


@query("A5_spread", with_ctes(f"SELECT entity, fam, count(*) AS n, {r('avg(val)')} AS mean, {r('stddev_samp(val)')} AS sd, {r('CASE WHEN abs(avg(val)) > 1e-9 THEN stddev_samp(val) / abs(avg(val)) END')} AS cv FROM series GROUP BY 1, 2", "series"))
def spread(spark, sf):
    return rounded(A.spread(series(spark, sf), "val", ["entity", "fam"]))


@query("A6_slope", with_ctes(f"SELECT entity, fam, count(*) AS n, CASE WHEN count(*) >= 2 AND max(hr) > min(hr) THEN {r('regr_slope(val, hr)', 5)} ELSE 0.0::DOUBLE END AS slope FROM series GROUP BY 1, 2", "series"))
def slope(spark, sf):
    return rounded(A.slope(series(spark, sf), "val", "hr", ["entity", "fam"]), 5)


@query("A7_value_shares", f"SELECT c_mktsegment, count(*) AS n, {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()')} AS pct FROM customer GROUP BY 1")
def shares(spark, sf):
    return rounded(A.value_shares(table(spark, sf, "customer"), "c_mktsegment"))


@query("A8_composition_audit", f"""
    WITH a AS (SELECT o_orderpriority AS k, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct_a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
         b AS (SELECT o_orderpriority AS k, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct_b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
         c AS (SELECT coalesce(a.k, b.k) AS o_orderpriority, coalesce(pct_a, 0) AS pct_a, coalesce(pct_b, 0) AS pct_b FROM a FULL JOIN b ON a.k = b.k)
    SELECT o_orderpriority, {r('pct_a')} AS pct_a, {r('pct_b')} AS pct_b, {r('abs(pct_a - pct_b)')} AS drift, {r('max(abs(pct_a - pct_b)) OVER ()')} AS max_drift FROM c""")
def audit(spark, sf):
    od = table(spark, sf, "orders")
    return rounded(A.composition_audit(od.filter("o_orderstatus = 'F'"), od.filter("o_orderstatus = 'O'"), "o_orderpriority"))


_SHARES = " UNION ALL ".join(f"SELECT '{f}' AS \"column\", count(*) AS n, count(*) - count({f}) AS missing, {r(f'(count(*) - count({f})) / count(*)::DOUBLE')} AS share FROM w" for f in FAMILIES)


@query("A9_missing_shares", with_ctes(f"WITH w AS ({_SPARSE}) {_SHARES}", "series"))
def missing(spark, sf):
    return rounded(C.missing_shares(sparse_wide(spark, sf), list(FAMILIES)))


@query("A10_group_filter", with_ctes("SELECT site, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM sited GROUP BY 1 HAVING sum(y) >= 20 AND min(y) < max(y)", "sited"))
def group_filter(spark, sf):
    per = sites(spark, sf).groupBy("site").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    return per.filter((F.col("positives") >= 20) & (F.col("_lo") < F.col("_hi"))).select("site", "n", "positives")


_TABLE1_ITEMS = {
    "checkpoints": "count(*)", "entities": "count(DISTINCT entity)", "subjects": "count(DISTINCT c)", "y_checkpoints": "sum(y)", "y_entities": "count(DISTINCT CASE WHEN y = 1 THEN entity END)",
    "ge3_checkpoints": "sum(ge3)", "ge3_entities": "count(DISTINCT CASE WHEN ge3 = 1 THEN entity END)",
    "x2_p25": "quantile_cont(CASE WHEN rn = 1 THEN x2 END, 0.25)", "x2_median": "quantile_cont(CASE WHEN rn = 1 THEN x2 END, 0.5)", "x2_p75": "quantile_cont(CASE WHEN rn = 1 THEN x2 END, 0.75)",
    "b_pct": "avg(CASE WHEN rn = 1 THEN b END) * 100"}
_TABLE1 = " UNION ALL ".join(f"SELECT split, '{k}' AS item, {r(f'CAST({v} AS DOUBLE)')} AS \"value\" FROM t GROUP BY 1" for k, v in _TABLE1_ITEMS.items())


@query("A11_baseline_table", with_ctes(f"""
    WITH t AS (SELECT pred.*, o_custkey AS c, o_orderstatus AS split, (status = 'F')::INT AS b, row_number() OVER (PARTITION BY entity ORDER BY t_hr) AS rn
               FROM pred JOIN orders ON entity = o_orderkey) {_TABLE1}""", "pred"))
def baseline_table(spark, sf):
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("split"))
    rows = predictions(spark, sf).join(od, "entity").withColumn("b", F.when(F.col("status") == "F", 1).otherwise(0))
    return rounded(A.baseline_table(rows, "entity", "subject", "t_hr", ["x2"], ["b"], ["y", "ge3"], ["split"]))


@query("A12_multiplicity", "SELECT count(*) AS subjects, CAST(sum((n > 1)::INT) AS BIGINT) AS with_several, max(n) AS max_per_subject, CAST(sum(n) AS BIGINT) AS entities FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def multiplicity(spark, sf):
    return A.multiplicity(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@query("A13_funnel", """
    WITH s AS (SELECT count(*) AS a, count(*) FILTER (c_acctbal > 0) AS b, count(*) FILTER (c_acctbal > 0 AND c_nationkey < 20) AS c,
                      count(*) FILTER (c_acctbal > 0 AND c_nationkey < 20 AND c_mktsegment <> 'MACHINERY') AS d FROM customer)
    SELECT 0 AS step, 'all' AS name, a AS n, CAST(0 AS BIGINT) AS dropped FROM s UNION ALL SELECT 1, 'solvent', b, a - b FROM s
    UNION ALL SELECT 2, 'region', c, b - c FROM s UNION ALL SELECT 3, 'segment', d, c - d FROM s""")
def funnel(spark, sf):
    return H.funnel(table(spark, sf, "customer"), [("solvent", F.col("c_acctbal") > 0), ("region", F.col("c_nationkey") < 20), ("segment", F.col("c_mktsegment") != "MACHINERY")], "c_custkey")


@query("A14_mean_differences", f"""
    WITH c AS (SELECT c_acctbal, (c_mktsegment = 'BUILDING')::INT AS b, (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))::INT AS i FROM customer),
         s AS (SELECT CAST(sum(i) AS BIGINT) AS n_included, count(*) - CAST(sum(i) AS BIGINT) AS n_excluded, avg(c_acctbal) FILTER (i = 1) AS m1, avg(c_acctbal) FILTER (i = 0) AS m0,
               var_samp(c_acctbal) FILTER (i = 1) AS v1, var_samp(c_acctbal) FILTER (i = 0) AS v0, avg(b) FILTER (i = 1) AS p1, avg(b) FILTER (i = 0) AS p0 FROM c)
    SELECT n_included, n_excluded, 'c_acctbal' AS variable, {r('m1')} AS mean_included, {r('m0')} AS mean_excluded, {r('(m1 - m0) / sqrt((v1 + v0) / 2)')} AS smd FROM s
    UNION ALL SELECT n_included, n_excluded, 'b', {r('p1')}, {r('p0')}, {r('(p1 - p0) / sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2)')} FROM s""")
def mean_differences(spark, sf):
    od = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("i", F.lit(1))
    cu = table(spark, sf, "customer").join(od, "c_custkey", "left").withColumn("b", F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0))
    return rounded(A.mean_differences(cu, F.col("i") == 1, ["c_acctbal"], ["b"]))


@query("A15_pooled", f"""
    WITH e AS (SELECT o_orderstatus, avg(o_totalprice) AS d, stddev_samp(o_totalprice) / sqrt(count(*)) AS se FROM orders GROUP BY 1),
         s AS (SELECT count(*) AS k, sum(1 / (se * se)) AS w, sum(d / (se * se)) AS wd FROM e),
         q AS (SELECT sum((d - wd / w) * (d - wd / w) / (se * se)) AS q FROM e, s)
    SELECT k, {r('wd / w', 4)} AS pooled, {r('1 / sqrt(w)', 4)} AS se_fixed, {r('q', 4)} AS q, k - 1 AS df, {r('greatest(0, (q - (k - 1)) / q)', 4)} AS i2 FROM s, q""")
def pooled(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("delta"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("se"))
    return rounded(A.pool(per), 4)


@query("A16_events_per_parameter", with_ctes(f"SELECT CAST(sum(y) AS BIGINT) AS positive_rows, count(DISTINCT CASE WHEN y = 1 THEN entity END) AS event_units, 166 AS parameters, {r('sum(y) / 166.0::DOUBLE')} AS rows_per_parameter, {r('count(DISTINCT CASE WHEN y = 1 THEN entity END) / 166.0::DOUBLE')} AS units_per_parameter FROM pred", "pred"))
def events_per_parameter(spark, sf):
    return rounded(A.events_per_parameter(predictions(spark, sf), 166, "y", "entity"))


@query("A17_set_overlap", f"WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS \"both\", (SELECT count(*) FROM a FULL JOIN b USING (k)) AS either, {r('(SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM a FULL JOIN b USING (k))::DOUBLE')} AS jaccard")
def set_overlap(spark, sf):
    od = table(spark, sf, "orders")
    return rounded(A.set_overlap(od.filter("o_orderstatus = 'F'"), od.filter("o_orderpriority = '1-URGENT'"), "o_custkey"))


_MID = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@query("A17_rank_correlation", with_ctes(f"SELECT count(*) AS n, {r('corr(a, b)')} AS rho FROM (SELECT {_MID.format('p')} AS a, {_MID.format('q')} AS b FROM pred)", "pred"))
def rank_correlation(spark, sf):
    return rounded(A.rank_correlation(predictions(spark, sf).select("p", "q"), "p", "q"))


def auc_sql(source: str, y: str = "y", p: str = "p", by: str = "", where: str = "true") -> str:
    """AUROC of each group by mid-ranks."""
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by}, {p}" if by else f"PARTITION BY {p}"
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {head}CAST(sum({y}) AS BIGINT) AS n_pos, CAST(count(*) - sum({y}) AS BIGINT) AS n_neg, "
            f"(round((sum(CASE WHEN {y} = 1 THEN mr END) - sum({y}) * (sum({y}) + 1) / 2.0::DOUBLE) / nullif(sum({y})::DOUBLE * (count(*) - sum({y})), 0), 6) + 0) AS auroc "
            f"FROM (SELECT *, rank() OVER ({part}ORDER BY {p}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS mr FROM {source} WHERE {where} AND {p} IS NOT NULL AND {y} IS NOT NULL){group}")


@query("A18_learning_fractions", with_ctes("""
    WITH u AS (SELECT DISTINCT entity, ('0x' || substr(md5('42|' || entity), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM pred)
    SELECT f AS fraction, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, count(DISTINCT entity) AS entities FROM pred JOIN u USING (entity), (VALUES (0.25::DOUBLE), (0.5), (1.0)) t(f) WHERE u < f GROUP BY 1""", "pred"))
def learning_fractions(spark, sf):
    nested = L.sample_fractions(predictions(spark, sf), ["entity"], [0.25, 0.5, 1.0])
    return nested.groupBy("fraction").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.count_distinct("entity").alias("entities"))


@query("A19_entity_rollup", with_ctes("WITH e AS (SELECT entity, max(y) AS y, max(p) AS p FROM pred GROUP BY 1) " + auc_sql("e"), "pred"))
def entity_rollup(spark, sf):
    return rounded(D.auroc(A.entity_rollup(predictions(spark, sf), ["entity"])))


_HASH = "('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT"


POISSON_SQL = "(" + " + ".join(f"(h >= {c})::INT" for c in B.POISSON_CUTS) + ")"


def mixed_stages(source: str, base: str, rep: str, out: str, keep: str = "*", value: str | None = None) -> str:
    """The draw hash ``h`` step by step, so that no expression is repeated: adds a Poisson count (or ``value``) as ``out``."""
    m = "4294967295::UBIGINT"
    q = f"SELECT {keep}, {base}::UBIGINT AS u_lo, {rep}::UBIGINT AS u_hi, {B.M3_SEED}::UBIGINT AS h, 0::UBIGINT AS k FROM {source}"

    def step(name, expression):
        nonlocal q
        q = f"SELECT * REPLACE ({expression} AS {name}) FROM ({q})"

    for part in ("u_lo", "u_hi"):
        step("k", f"({part} * {B.M3_K1}::UBIGINT) & {m}")
        step("k", f"(((k << 15) | (k >> 17)) & {m}) * {B.M3_K2}::UBIGINT & {m}")
        step("h", "xor(h, k)")
        step("h", f"((((h << 13) | (h >> 19)) & {m}) * 5::UBIGINT + {B.M3_H}::UBIGINT) & {m}")
    step("h", "xor(h, 8::UBIGINT)")
    for down, mul in ((16, B.M3_F1), (13, B.M3_F2)):
        step("h", f"xor(h, h >> {down})")
        step("h", f"(h * {mul}::UBIGINT) & {m}")
    step("h", "xor(h, h >> 16)")
    return f"SELECT * EXCLUDE (h, k, u_lo, u_hi), {value or POISSON_SQL} AS {out} FROM ({q})"


_RUNS = mixed_stages(f"(SELECT entity, sum(y) AS pos, count(*) AS n, {_HASH.format(seed=42, key='entity')} AS b FROM pred GROUP BY 1), (SELECT unnest(range(1, 21)) AS replicate)", "b", "replicate", "w")


@query("A20_run_summary", with_ctes(f"SELECT count(v) AS n_runs, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, {r('min(v)')} AS min, {r('max(v)')} AS max FROM (SELECT replicate, sum(w * pos) / sum(w * n)::DOUBLE AS v FROM ({_RUNS}) GROUP BY 1)", "pred"))
def run_summary(spark, sf):
    reps = B.resample(predictions(spark, sf), ["entity"], {"pos": F.col("y"), "n": F.lit(1)}, 20)
    return rounded(A.run_summary(reps.withColumn("v", F.col("pos") / F.col("n")), "v", []))


# ---------------------------------------------------------------- windows


@query("W1_forward_max", with_ctes("SELECT entity, t_hr, max(p) OVER (PARTITION BY entity ORDER BY t_hr ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS forward FROM pred", "pred"))
def forward(spark, sf):
    return T.forward_max(predictions(spark, sf), ["entity"], "t_hr", "p", 3).select("entity", "t_hr", "forward")


@query("W2_strict_forward_max", with_ctes("SELECT entity, t_hr, max(p) OVER (PARTITION BY entity ORDER BY t_hr ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS forward FROM pred", "pred"))
def strict_forward(spark, sf):
    return T.forward_max(predictions(spark, sf), ["entity"], "t_hr", "p", 3, include_current=False).select("entity", "t_hr", "forward")


@query("W3_lookback_rise", with_ctes(f"SELECT entity, fam, {r('hr')} AS hr, {r('val - min(val) OVER (PARTITION BY entity, fam ORDER BY hr RANGE BETWEEN 48.0 PRECEDING AND CURRENT ROW)')} AS rise FROM series", "series"))
def lookback(spark, sf):
    return rounded(T.rise_over(series(spark, sf), ["entity", "fam"]).select("entity", "fam", "hr", "rise"))


@query("W4_bin_rise", with_ctes(f"WITH b AS (SELECT entity, floor(hr / 6) * 6 AS bin_hr, max(val) AS bin_max FROM series WHERE fam = 'purchase' GROUP BY 1, 2) SELECT entity, bin_hr, bin_max, {r('bin_max - min(bin_max) OVER (PARTITION BY entity ORDER BY bin_hr RANGE BETWEEN 48 PRECEDING AND CURRENT ROW)')} AS rise FROM b", "series"))
def bin_rise(spark, sf):
    return rounded(T.bin_rise(series(spark, sf).filter("fam = 'purchase'"), ["entity"]))


@query("W5_spread_back", with_ctes("SELECT entity, t_hr, max(t_hr) OVER (PARTITION BY entity) AS last_t, min(t_hr) OVER (PARTITION BY entity) AS first_t FROM pred", "pred"))
def spread_back(spark, sf):
    return T.spread_back(predictions(spark, sf).select("entity", "t_hr"), ["entity"], {"last_t": F.max("t_hr"), "first_t": F.min("t_hr")})


@query("W6_episodes", with_ctes("""
    WITH a AS (SELECT entity, t_hr, (p >= 0.25)::INT AS o FROM pred), b AS (SELECT *, coalesce(lag(o) OVER w, 0) AS pr, coalesce(lead(o) OVER w, 0) AS nx FROM a WINDOW w AS (PARTITION BY entity ORDER BY t_hr))
    SELECT entity, CAST(sum((o = 1 AND pr = 0)::INT) AS BIGINT) AS episodes, CAST(sum((o = 1 AND nx = 1 AND pr = 0)::INT) AS BIGINT) AS double_episodes, min(CASE WHEN o = 1 THEN t_hr END) AS first_alert,
      min(CASE WHEN o = 1 AND nx = 1 THEN t_hr END) AS first_double FROM b GROUP BY 1""", "pred"))
def episode_counts(spark, sf):
    return T.episodes(predictions(spark, sf), ["entity"], "t_hr", F.col("p") >= 0.25)


@query("W7_midranks", with_ctes(f"SELECT entity, t_hr, {_MID.format('p')} AS midrank FROM pred", "pred"))
def midranks(spark, sf):
    return O.midranks(predictions(spark, sf).select("entity", "t_hr", "p"), "p").select("entity", "t_hr", "midrank")


@query("W8_running_counts", with_ctes("SELECT p AS threshold, CAST(sum(sum(y)) OVER (ORDER BY p DESC) AS BIGINT) AS cum_tp, CAST(sum(count(*) - sum(y)) OVER (ORDER BY p DESC) AS BIGINT) AS cum_fp FROM pred GROUP BY 1", "pred"))
def running_counts(spark, sf):
    runs = A.running_rows(predictions(spark, sf), "p", {"tp": F.col("y"), "fp": 1 - F.col("y")})
    return runs.select(F.col("p").alias("threshold"), "cum_tp", "cum_fp")


@query("W9_first_episode", with_ctes(f"""
    WITH t AS (SELECT entity, hr, fam, lag(fam) OVER (PARTITION BY entity ORDER BY hr) AS origin FROM series),
         s AS (SELECT entity, min(CASE WHEN fam = 'signup' THEN hr END) AS "start" FROM t GROUP BY 1),
         e AS (SELECT t.entity, min(hr) AS "end" FROM t JOIN s USING (entity) WHERE origin = 'signup' AND hr > "start" GROUP BY 1)
    SELECT s.entity, {r('"start"')} AS "start", {r('coalesce("end", los_h)')} AS "end", {r('coalesce("end", los_h) - "start"')} AS los FROM s LEFT JOIN e USING (entity) JOIN stays USING (entity) WHERE "start" IS NOT NULL""", "series", "stays"))
def first_episode(spark, sf):
    # The origin of a move is the type of the event before it: one value per event, found through slots.
    moves = T.as_of(series(spark, sf).select("entity", "hr", "fam", (F.col("hr") - 1e-7).alias("before")), series(spark, sf).withColumn("val", F.col("fam")),
                    ["entity"], at="before", name="origin", width=168.0)
    return rounded(H.first_episode(moves, "entity", "hr", F.col("origin") == "signup", F.col("fam") == "signup", stays(spark, sf), ["los_h"]))


@query("W10_covered_buckets", with_ctes(f"""
    WITH h AS (SELECT entity, CAST(floor(hr) AS INT) AS hour, arg_max(val, (hr, val)) AS v FROM series WHERE fam = 'click' AND hr >= 0 GROUP BY 1, 2)
    SELECT entity, CAST(floor(hour / 6) AS INT) AS bucket, CAST(floor(hour / 6) AS INT) * 6 AS t0_hr, {r('sum(v)')} AS total, CAST(count(*) AS INT) AS cover, (count(*) >= 2)::INT AS evaluable FROM h GROUP BY 1, 2""", "series"))
def covered(spark, sf):
    return rounded(T.covered_buckets(series(spark, sf).filter("fam = 'click'"), ["entity"], min_cover=2, clip=False))


@query("W11_hourly_slices", with_ctes(f"""
    WITH h AS (SELECT entity, fam, CAST(floor(hr) AS INT) AS hour, CASE WHEN fam = 'click' THEN sum(val) ELSE arg_max(val, (hr, val)) END AS v FROM series WHERE fam IN ('click', 'view') GROUP BY 1, 2, 3),
         x AS (SELECT g.entity, g.t_hr, fam, hour - (CAST(g.t_hr AS INT) - 48) AS ago, v FROM full_grid g JOIN h ON g.entity = h.entity AND hour >= g.t_hr - 48 AND hour < g.t_hr)
    SELECT g.entity, g.t_hr, CAST(count(v) AS INT) AS covered, {r('coalesce(sum(CAST(CAST(v AS FLOAT) AS DOUBLE) * (ago + 1)), 0)', 3)} AS moment FROM full_grid g LEFT JOIN x ON g.entity = x.entity AND g.t_hr = x.t_hr GROUP BY 1, 2""", "series", "full_grid"))
def slices(spark, sf):
    out = T.hourly_slices(full_grid(spark, sf).select("entity", "t_hr"), series(spark, sf), ["entity"], ["click", "view"], summed=["click"])
    covered_hours = F.aggregate(F.flatten("mask"), F.lit(0), lambda a, m: a + m)
    moment = F.aggregate(F.transform("values", lambda c: F.aggregate(F.transform(c, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)), F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("entity", "t_hr", covered_hours.alias("covered"), moment.alias("moment")), 3)


@query("W12_reach_back_bins", with_ctes("SELECT CASE WHEN d = 0 THEN 0 WHEN d = 6 THEN 1 WHEN d <= 18 THEN 2 ELSE 3 END AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM (SELECT *, max(t_hr) OVER (PARTITION BY entity) - t_hr AS d FROM pred) GROUP BY 1", "pred"))
def reach_back(spark, sf):
    from tidemark.operators.resampled import reach_back_bin

    return reach_back_bin(predictions(spark, sf), ["entity"]).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("W13_longest_trajectories", with_ctes("SELECT status AS class, entity, n, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY n DESC, entity) AS INT) AS position FROM (SELECT entity, max(status) AS status, count(*) AS n FROM pred GROUP BY 1)) WHERE position <= 5", "pred"))
def longest(spark, sf):
    per = predictions(spark, sf).groupBy("entity").agg(F.max("status").alias("class"), F.count("*").alias("n"))
    return C.top_per_group(per, ["class"], [F.desc("n"), F.asc("entity")], 5)


@query("W14_leave_group_out", with_ctes(f"WITH g AS (SELECT site, count(*) AS n, sum(y) AS s FROM sited GROUP BY 1) SELECT site, CAST(sum(n) OVER () - n AS BIGINT) AS n_others, {r('(sum(s) OVER () - s) / (sum(n) OVER () - n)::DOUBLE')} AS rate_others FROM g", "sited"))
def leave_out(spark, sf):
    per = sites(spark, sf).groupBy("site").agg(F.count("*").alias("_n"), F.sum("y").alias("_s"))
    total = per.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    out = O.join_on(per, total, [])
    return rounded(out.select("site", (F.col("_tn") - F.col("_n")).alias("n_others"), ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("rate_others")))


# ---------------------------------------------------------------- sorts, limits, sets


@query("T1_stable_order", with_ctes("SELECT entity, fam, CAST(row_number() OVER (PARTITION BY entity, fam, CAST(floor(hr / 168) AS BIGINT) ORDER BY hr, val) AS INT) AS position, val FROM series", "series"))
def stable_order(spark, sf):
    from pyspark.sql.window import Window

    s = series(spark, sf).withColumn("week", T.time_slot("hr", 168.0))
    w = Window.partitionBy("entity", "fam", "week").orderBy("hr", "val")
    return s.select("entity", "fam", F.row_number().over(w).alias("position"), "val")


@query("T2_top_k", "SELECT p_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_k(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    known = table(spark, sf, "part").select("p_partkey")
    return per.join(known, "p_partkey", "left_semi").orderBy(F.desc("revenue"), "p_partkey").limit(15)


@query("T3_cumulative_cut", f"""
    WITH s AS (SELECT p_brand AS feature, round(sum(l_extendedprice), 2) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
         c AS (SELECT *, share / sum(share) OVER () AS part, row_number() OVER (ORDER BY share DESC, feature) AS position FROM s),
         d AS (SELECT *, sum(part) OVER (ORDER BY position) AS cum FROM c)
    SELECT feature, share, CAST(position AS INT) AS position, {r('cum')} AS cumulative FROM d WHERE cum - part < 0.9""")
def cumulative_cut(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    per = li.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    shares_ = per.groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.sum("v"), 2).alias("share"))
    return rounded(A.cumulative_cut(shares_, "feature", "share", 0.9))


@query("T4_top_per_group", "SELECT o_orderstatus, o_orderkey, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS position FROM orders) WHERE position <= 8")
def top_group(spark, sf):
    od = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return C.top_per_group(od, ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8).select("o_orderstatus", "o_orderkey", "position")


_CURVE = ("SELECT p AS threshold, CAST(sum(sum(y)) OVER w AS BIGINT) AS tp, CAST(sum(count(*) - sum(y)) OVER w AS BIGINT) AS fp, row_number() OVER w - 1 AS pos_at, count(*) OVER () - 1 AS last_at "
          "FROM pred GROUP BY 1 WINDOW w AS (ORDER BY p DESC)")


@query("T5_thinned_curve", with_ctes(f"WITH c AS ({_CURVE}) SELECT threshold, tp, fp FROM c WHERE pos_at IN (SELECT CAST(round_even(i * last_at / 49.0::DOUBLE, 0) AS BIGINT) FROM range(50) t(i)) OR last_at < 50", "pred"))
def thinned(spark, sf):
    return D.thin_curve(D.curve(predictions(spark, sf)), 50).select("threshold", "tp", "fp")


@query("U1_union_all", with_ctes("SELECT fam, count(*) AS n FROM (SELECT fam FROM series WHERE fam = 'click' UNION ALL SELECT fam FROM series WHERE fam <> 'error') GROUP BY 1", "series"))
def union_all(spark, sf):
    s = series(spark, sf)
    return C.merge_feeds(s.filter("fam = 'click'"), s.filter("fam <> 'error'")).groupBy("fam").agg(F.count("*").alias("n"))


@query("U2_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("U3_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_(spark, sf):
    od = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(od, "k", "left_anti").distinct()


@query("U4_first_per_key", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def first_per_key(spark, sf):
    return C.first_per_key(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


# ---------------------------------------------------------------- flagship


@query("flagship_feature_auroc", with_ctes(f"""
    WITH f AS (SELECT g.entity, g.t_hr, arg_max(s.val, (s.hr, s.val)) AS x FROM full_grid g JOIN series s ON g.entity = s.entity AND s.fam = 'view' AND s.hr > g.t_hr - 72 AND s.hr <= g.t_hr GROUP BY 1, 2),
         l AS (SELECT g.entity, g.t_hr, max((s.val > 150)::INT) AS y FROM full_grid g JOIN series s ON g.entity = s.entity AND s.fam = 'purchase' AND s.hr > g.t_hr AND s.hr <= g.t_hr + 72 GROUP BY 1, 2),
         m AS (SELECT x, coalesce(y, 0) AS y FROM f LEFT JOIN l USING (entity, t_hr))
    {auc_sql('m', p='x')}""", "series", "full_grid"))
def flagship(spark, sf):
    """Trailing-window feature of one family against a forward-window label of another, in one plan."""
    from tidemark.plans.fixtures import CLOCK

    s = series(spark, sf)
    g = full_grid(spark, sf)
    feats = K.window_features(g, s, ["entity"], ["view"], 72.0, CLOCK, locf=False).select("entity", "t_hr", F.col("last").alias("x"))
    # (t, t + 72] is the trailing window of the checkpoint 72 h later.
    events = s.filter("fam = 'purchase' AND val > 150").withColumn("hr", F.col("hr") - 72.0)
    label = K.event_counts(g, events, ["entity"], ["purchase"], 72.0, CLOCK).select("entity", "t_hr", F.col("any").alias("y"))
    return rounded(D.auroc(feats.join(label, ["entity", "t_hr"]), p="x"))
