"""Roles of the driver tables: which columns play series, cohort, grid and predictions, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import hours_between, sigmoid
from tidemark.operators import checkpoints as K
from tidemark.session import dealt, shared_folder

EPOCH = "2024-01-01 00:00:00"
CLOCK = K.Clock(start=168.0, step=24.0, end=672.0, lead_out=24.0, horizon=168.0, fold=20.0, rise=150.0, back=168.0, carry=336.0)
FAMILIES = ("click", "error", "purchase", "signup", "view")
THRESHOLDS = (0.15, 0.25, 0.35)
LAYER = (-0.3, 0.8)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediates, in the folder that the session shares."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rnd(col, digits: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every floating column rounded: engines add numbers in different orders."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def series(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(F.col("user_id").alias("entity"), hours_between(F.lit(EPOCH).cast("timestamp_ntz"), "ts").alias("hr"),
                     F.col("event_type").alias("fam"), F.col("value").alias("val"))


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """One row per entity; the length of stay is the hour of its last event."""
    return series(spark, sf).groupBy("entity").agg(F.max("hr").alias("los_h"))


SHIFT = 120.0


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """The same series with the anchor five days later, so that history before the anchor exists."""
    return series(spark, sf).withColumn("hr", F.col("hr") - SHIFT)


def analyte(spark: SparkSession, sf: str) -> DataFrame:
    return shifted(spark, sf).filter("fam = 'purchase'").select("entity", "hr", "val")


def axis(spark: SparkSession, sf: str) -> DataFrame:
    stay = stays(spark, sf).withColumn("los_h", F.col("los_h") - SHIFT)
    stops = shifted(spark, sf).filter("fam = 'error' AND val > 150")
    return K.event_axis(stay, analyte(spark, sf), ["entity"], stops, clock=CLOCK)


def checkpoint_grid(spark: SparkSession, sf: str) -> DataFrame:
    """At-risk checkpoints with baseline, onset and horizon label."""
    g = K.grid(K.at_risk(axis(spark, sf)), clock=CLOCK)
    return g.select("entity", "t_hr", "los_h", "base", "onset_hr", K.horizon_label(horizon=CLOCK.horizon).alias("label"))


def full_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoints of every entity, without stopping rules."""
    s = stays(spark, sf).withColumn("onset_hr", F.lit(None).cast("double"))
    return K.grid(s, stop=None, clock=CLOCK).select("entity", "los_h", "t_hr")


def score(intercept: float, **terms: float) -> Column:
    z = F.lit(intercept)
    for name, weight in terms.items():
        z = z + F.lit(weight) * F.col(name)
    return F.round(sigmoid(z), 6)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (entity, t_hr): three nested endpoints, two scores, a site key and a status."""
    li = dealt(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "entity"), "entity")
    y1 = F.col("l_returnflag") == "R"
    y2 = y1 & (F.col("l_linestatus") == "F")
    y3 = y2 & (F.col("l_quantity") >= 30)

    def flag(c):
        return F.max(F.when(c, 1).otherwise(0))

    return li.groupBy("entity", (F.lit(18.0) + F.lit(6.0) * F.col("l_linenumber")).alias("t_hr")).agg(
        flag(y1).alias("y"), flag(y2).alias("ge2"), flag(y3).alias("ge3"),
        F.max(score(-2.2, l_quantity=0.03, l_discount=4.0)).alias("p"), F.max(score(-2.0, l_tax=5.0, l_quantity=0.01)).alias("q"),
        F.min("l_suppkey").alias("suppkey"), F.max("l_linestatus").alias("status"), F.min(F.year("l_shipdate")).alias("ship_year"),
        F.max("l_discount").alias("x1"), F.max("l_tax").alias("x2"))


def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """The three endpoints as one long table: the first score for the first endpoint, blends for the others."""
    pr = predictions(spark, sf)
    rows = F.array(F.struct(F.lit(1).alias("endpoint"), F.col("y").alias("y"), F.col("p").alias("p")),
                   F.struct(F.lit(2).alias("endpoint"), F.col("ge2").alias("y"), F.col("q").alias("p")),
                   F.struct(F.lit(3).alias("endpoint"), F.col("ge3").alias("y"), F.col("p").alias("p")))
    return pr.select("entity", "t_hr", F.inline(rows))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with their site (nation of the supplier)."""
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("site"))
    return predictions(spark, sf).join(sup, "suppkey")


# ---------------------------------------------------------------- the same roles in SQL

_P = "round(1/(1+exp(-(-2.2::DOUBLE+0.03::DOUBLE*l_quantity+4.0::DOUBLE*l_discount))),6)"
_Q = "round(1/(1+exp(-(-2.0::DOUBLE+5.0::DOUBLE*l_tax+0.01::DOUBLE*l_quantity))),6)"

CTE = {
    "series": (
        "SELECT user_id AS entity, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS hr, event_type AS fam, \"value\" AS val FROM events", ()),
    "stays": ("SELECT entity, max(hr) AS los_h FROM series GROUP BY 1", ("series",)),
    "full_grid": (
        "SELECT entity, los_h, unnest(generate_series(0, CAST(floor((least(los_h - 24, 672) - 168) / 24 + 1e-9) AS INT))) * 24.0::DOUBLE + 168 AS t_hr "
        "FROM stays WHERE least(los_h - 24, 672) >= 168", ("stays",)),
    "analyte": ("SELECT entity, hr - 120.0::DOUBLE AS hr, val FROM series WHERE fam = 'purchase'", ("series",)),
    "risen": (
        "SELECT entity, hr, val, val - min(val) OVER (PARTITION BY entity ORDER BY hr RANGE BETWEEN 168 PRECEDING AND CURRENT ROW) AS rise FROM analyte", ("analyte",)),
    "bases": (
        "SELECT entity, coalesce(min(val) FILTER (hr BETWEEN 0 AND 168), min(val) FILTER (hr < 0)) AS base, CASE WHEN count(val) FILTER (hr BETWEEN 0 AND 168) > 0 THEN 'window' "
        "WHEN count(val) FILTER (hr < 0) > 0 THEN 'before' ELSE 'none' END AS branch FROM analyte GROUP BY 1", ("analyte",)),
    "early": (
        "SELECT entity, max(val) AS mx, max(rise) AS mr FROM (SELECT entity, val, val - min(val) OVER (PARTITION BY entity ORDER BY hr RANGE BETWEEN 168 PRECEDING AND CURRENT ROW) AS rise "
        "FROM analyte WHERE hr BETWEEN 0 AND 168) GROUP BY 1", ("analyte",)),
    "prev": (
        "SELECT entity, base, branch, CASE WHEN base IS NOT NULL AND mx IS NOT NULL THEN CASE WHEN mx / base >= 20 OR mr >= 150 THEN 1 ELSE 0 END END AS prevalent FROM bases LEFT JOIN early USING (entity)",
        ("bases", "early")),
    "stops": ("SELECT entity, min(hr - 120.0::DOUBLE) AS stop_hr FROM series WHERE fam = 'error' AND val > 150 GROUP BY 1", ("series",)),
    "evidence": (
        "SELECT r.entity, c, max((base IS NOT NULL AND e > 168 AND hr + 336 > 168 AND hr < e)::INT) AS ok, "
        "min(least(CASE WHEN base IS NOT NULL AND e > 168 AND hr + 336 > 168 AND hr < e AND val >= 20 * base AND greatest(hr, 168) > 168 THEN greatest(hr, 168) END, "
        "CASE WHEN base IS NOT NULL AND e > 168 AND rise >= 150 AND greatest(hr, 168) > 168 AND greatest(hr, 168) < e THEN greatest(hr, 168) END)) AS ev, "
        "max((base IS NOT NULL AND e > 168 AND hr + 336 > 168 AND hr < e AND val >= 20 * base AND greatest(hr, 168) = 168)::INT) AS at_start "
        "FROM risen r JOIN (SELECT entity, base, 'full' AS c, 672.0::DOUBLE AS e FROM bases UNION ALL SELECT entity, base, 'cut', CASE WHEN stop_hr <= 672 THEN stop_hr ELSE 672 END "
        "FROM bases LEFT JOIN stops USING (entity)) b USING (entity) GROUP BY 1, 2", ("risen", "bases", "stops")),
    "axis": (
        "SELECT *, CASE WHEN status IN ('event', 'no_event') THEN cut_ev END AS onset_hr FROM (SELECT entity, los_h - 120.0::DOUBLE AS los_h, base, branch, prevalent, stop_hr, x.ev AS cut_ev, "
        "CASE WHEN p.entity IS NULL THEN 'no_series' WHEN base IS NULL OR prevalent IS NULL OR prevalent = 1 THEN 'prevalent_or_no_base' WHEN coalesce(f.ok, 0) = 0 THEN 'no_evidence' "
        "WHEN f.ok = 1 AND f.ev IS NULL AND f.at_start = 1 THEN 'carried_in' WHEN stop_hr <= 168 THEN 'stopped_before' "
        "WHEN x.ok = 0 OR (x.ok = 1 AND x.ev IS NULL AND x.at_start = 1) THEN 'stop_censored' WHEN x.ok = 1 AND x.ev IS NOT NULL THEN 'event' ELSE 'no_event' END AS status "
        "FROM stays LEFT JOIN prev p USING (entity) LEFT JOIN stops USING (entity) LEFT JOIN (SELECT * FROM evidence WHERE c = 'full') f USING (entity) "
        "LEFT JOIN (SELECT * FROM evidence WHERE c = 'cut') x USING (entity))", ("stays", "prev", "stops", "evidence")),
    "cgrid": (
        "SELECT entity, t_hr, los_h, base, onset_hr, CASE WHEN onset_hr - t_hr > 0 AND onset_hr - t_hr <= 168 THEN 1 ELSE 0 END AS label FROM (SELECT *, "
        "unnest(generate_series(0, CAST(floor((least(los_h - 24, 672) - 168) / 24 + 1e-9) AS INT))) * 24.0::DOUBLE + 168 AS t_hr FROM axis "
        "WHERE status IN ('event', 'no_event') AND least(los_h - 24, 672) >= 168) WHERE (onset_hr IS NULL OR t_hr < onset_hr) AND (stop_hr IS NULL OR t_hr < stop_hr)", ("axis",)),
    "pred": (
        f"SELECT l_orderkey AS entity, 18.0::DOUBLE + 6.0::DOUBLE * l_linenumber AS t_hr, max((l_returnflag = 'R')::INT) AS y, "
        f"max((l_returnflag = 'R' AND l_linestatus = 'F')::INT) AS ge2, max((l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 30)::INT) AS ge3, "
        f"max({_P}) AS p, max({_Q}) AS q, min(l_suppkey) AS suppkey, max(l_linestatus) AS status, min(CAST(year(l_shipdate) AS INT)) AS ship_year, "
        f"max(l_discount) AS x1, max(l_tax) AS x2 FROM lineitem GROUP BY 1, 2", ()),
    "ends": (
        "SELECT entity, t_hr, 1 AS endpoint, y, p FROM pred UNION ALL SELECT entity, t_hr, 2, ge2, q FROM pred UNION ALL SELECT entity, t_hr, 3, ge3, p FROM pred",
        ("pred",)),
    "sited": ("SELECT pred.*, s_nationkey AS site FROM pred JOIN supplier ON suppkey = s_suppkey", ("pred",)),
}


def with_ctes(body: str, *names: str) -> str:
    """Prefix a query with the role tables it uses."""
    order: list[str] = []

    def visit(n):
        for d in CTE[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    # Materialised once: the engine would otherwise inline a role table at every use.
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][0]})" for n in order)
    body = body.strip()
    if not order:
        return body
    return f"WITH {head}\n{',' + body[4:] if body.upper().startswith('WITH') else body}"


def r(expression: str, digits: int = 6) -> str:
    """SQL rounding that never gives a negative zero."""
    return f"(round({expression}, {digits}) + 0)"
