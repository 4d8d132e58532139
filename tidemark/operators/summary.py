"""Descriptive aggregates: composition audits, baseline tables, standardised differences, pooling, set overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import safe_divide
from tidemark.operators.ordered import cumulate, join_on, midranks, quantiles
from tidemark.session import stage


def value_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and percentages of each value (within ``by``)."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    return join_on(counts, totals, list(by)).withColumn("pct", F.col("n") * 100.0 / F.col("_all")).drop("_all")


def composition_audit(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Percentages of two populations side by side with their difference and the largest difference."""
    left = value_shares(a, column).select(column, F.col("pct").alias("pct_a"))
    right = value_shares(b, column).select(F.col(column).alias("_c"), F.col("pct").alias("pct_b"))
    both = left.join(right, F.col(column).eqNullSafe(F.col("_c")), "full")
    out = both.select(F.coalesce(column, "_c").alias(column), F.coalesce("pct_a", F.lit(0.0)).alias("pct_a"), F.coalesce("pct_b", F.lit(0.0)).alias("pct_b"))
    out = out.withColumn("drift", F.abs(F.col("pct_a") - F.col("pct_b")))
    return join_on(out, out.agg(F.max("drift").alias("max_drift")), [])


def spread(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and coefficient of variation (NULL near a zero mean)."""
    out = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("cv", F.when(F.abs("mean") > 1e-9, F.col("sd") / F.abs("mean")))


def slope(df: DataFrame, value: str, time: str, by: Sequence[str]) -> DataFrame:
    """Least-squares slope; 0 for a single value or when all times are equal."""
    out = df.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.regr_slope(value, time).alias("_s"))
    return out.select(*by, "n", F.when((F.col("n") >= 2) & (F.col("_hi") > F.col("_lo")), F.col("_s")).otherwise(F.lit(0.0)).alias("slope"))


def baseline_table(rows: DataFrame, entity: str, subject: str, t: str, continuous: Sequence[str], binary: Sequence[str], endpoints: Sequence[str],
                   by: Sequence[str] = ()) -> DataFrame:
    """Rows, entities, subjects, median and quartiles at each entity's first checkpoint, percentages and positives.

    Long form ``(by, item, value)``; quartiles come from exact ranks, distinct counts from one row per entity.
    """
    by = list(by)
    first = F.struct(F.col(t).alias("t"), *[F.col(c) for c in [*continuous, *binary]])
    per = rows.groupBy(*by, entity).agg(F.count("*").alias("_n"), F.min(first).alias("_f"), F.min(subject).alias("_s"),
                                        *[F.sum(e).alias(f"_p_{e}") for e in endpoints])
    per = per.select(*by, entity, "_n", "_s", *[F.col(f"_f.{c}").alias(c) for c in [*continuous, *binary]], *[f"_p_{e}" for e in endpoints])
    per = stage(per)
    subjects = per.groupBy(*by, "_s").agg(F.count("*").alias("_k")).groupBy(*by).agg(F.count("*").alias("subjects"))
    flat = per.groupBy(*by).agg(
        F.sum("_n").alias("checkpoints"), F.count("*").alias("entities"), *[(F.avg(b) * 100.0).alias(f"{b}_pct") for b in binary],
        *[F.sum(f"_p_{e}").alias(f"{e}_checkpoints") for e in endpoints], *[F.count_if(F.col(f"_p_{e}") > 0).alias(f"{e}_entities") for e in endpoints])
    flat = join_on(flat, subjects, by)
    for c in continuous:
        q = quantiles(per, c, {f"{c}_p25": 0.25, f"{c}_median": 0.5, f"{c}_p75": 0.75}, by).drop("n")
        flat = join_on(flat, q, by)
    items = [c for c in flat.columns if c not in by]
    return flat.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("value")) for i in items])))


def multiplicity(df: DataFrame, subject: str, entity: str) -> DataFrame:
    """Subjects with more than one entity and the largest number per subject."""
    per = df.select(subject, entity).distinct().groupBy(subject).agg(F.count("*").alias("_n"))
    return per.agg(F.count("*").alias("subjects"), F.count_if(F.col("_n") > 1).alias("with_several"), F.max("_n").alias("max_per_subject"), F.sum("_n").alias("entities"))


def mean_differences(df: DataFrame, included: Column, continuous: Sequence[str], binary: Sequence[str]) -> DataFrame:
    """Standardised mean difference, included against excluded: pooled deviation, or binary variance ``p (1 - p)``."""
    inc, exc = F.coalesce(included, F.lit(False)), ~F.coalesce(included, F.lit(False))
    cols = []
    for c in [*continuous, *binary]:
        cols += [F.avg(F.when(inc, F.col(c))).alias(f"m1_{c}"), F.avg(F.when(exc, F.col(c))).alias(f"m0_{c}"),
                 F.var_samp(F.when(inc, F.col(c))).alias(f"v1_{c}"), F.var_samp(F.when(exc, F.col(c))).alias(f"v0_{c}")]
    wide = df.agg(F.count_if(inc).alias("n_included"), F.count_if(exc).alias("n_excluded"), *cols)

    def row(c, is_binary):
        m1, m0 = F.col(f"m1_{c}"), F.col(f"m0_{c}")
        var = (m1 * (1 - m1) + m0 * (1 - m0)) / 2.0 if is_binary else (F.col(f"v1_{c}") + F.col(f"v0_{c}")) / 2.0
        return F.struct(F.lit(c).alias("variable"), m1.alias("mean_included"), m0.alias("mean_excluded"), safe_divide(m1 - m0, F.sqrt(var)).alias("smd"))

    rows = [row(c, False) for c in continuous] + [row(c, True) for c in binary]
    return wide.select("n_included", "n_excluded", F.inline(F.array(*rows)))


def pool(estimates: DataFrame, value: str = "delta", se: str = "se", by: Sequence[str] = ()) -> DataFrame:
    """Inverse-variance pooled estimate with Cochran's Q, I-squared and the fixed-effect error."""
    w, d = 1.0 / (F.col(se) * F.col(se)), F.col(value)
    out = estimates.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("_w"), F.sum(w * d).alias("_wd"), F.sum(w * d * d).alias("_wdd"))
    q = F.greatest(F.lit(0.0), F.col("_wdd") - F.col("_wd") * F.col("_wd") / F.col("_w"))
    out = out.select(*by, "k", (F.col("_wd") / F.col("_w")).alias("pooled"), (1.0 / F.sqrt("_w")).alias("se_fixed"), q.alias("q"), (F.col("k") - 1).alias("df"))
    return out.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).otherwise(F.lit(0.0)))


def events_per_parameter(rows: DataFrame, parameters: int, y: str, unit: str) -> DataFrame:
    """Positive rows and event units per model parameter."""
    per = rows.groupBy(unit).agg(F.sum(y).alias("_p"))
    out = per.agg(F.sum("_p").alias("positive_rows"), F.count_if(F.col("_p") > 0).alias("event_units"))
    return out.select("positive_rows", "event_units", F.lit(parameters).alias("parameters"), (F.col("positive_rows") / F.lit(float(parameters))).alias("rows_per_parameter"),
                      (F.col("event_units") / F.lit(float(parameters))).alias("units_per_parameter"))


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes, intersection, union and Jaccard index of two key sets."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    out = both.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count("*").alias("either"))
    return out.withColumn("jaccard", safe_divide(F.col("both"), F.col("either")))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho: correlation of mid-ranks."""
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = midranks(midranks(known, a, name="_ra"), b, name="_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def entity_rollup(df: DataFrame, entity: Sequence[str], y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, *entity).agg(F.max(y).alias(y), F.max(p).alias(p))


def run_summary(runs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, deviation and range over repeated runs."""
    return runs.groupBy(*by).agg(F.count(value).alias("n_runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def cumulative_cut(importance: DataFrame, name: str, share: str, cut: float = 0.99) -> DataFrame:
    """Smallest set of the largest shares that reaches the cut, with the running share; ties in name order.

    One row per feature: the size is the width of a table.
    """
    from pyspark.sql.window import Window

    whole = Window.partitionBy()
    order = Window.orderBy(F.desc(share), F.asc(name))
    part = F.col(share) / F.sum(share).over(whole)
    ranked = importance.withColumn("_part", part)
    before = F.coalesce(F.sum("_part").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return (ranked.withColumn("position", F.row_number().over(order)).withColumn("_before", before)
            .filter(F.col("_before") < cut).select(name, share, "position", (F.col("_before") + F.col("_part")).alias("cumulative")))


def running_rows(df: DataFrame, order: str, sums: Mapping[str, Column], descending: bool = True) -> DataFrame:
    """Running sums over distinct values of an order, all rows of one value together (inclusive)."""
    runs = cumulate(df, order, sums, descending=descending)
    return runs.select(order, *[(F.col(f"{n}_before") + F.col(n)).alias(f"cum_{n}") for n in sums])
