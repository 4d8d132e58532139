"""Rank sketches: approximate quantiles whose error is stated and whose state is a column that can be stored and merged.

Exact quantiles (``ordered.quantiles``) shuffle every distinct value. A sketch is a few kilobytes per group, built on the map side, so only
sketches are shuffled; sketches of days, files or sites are merged later without the rows. Spark's KLL sketch does the work. It draws at
random, so sketches that are read more than once are staged first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import join_groups

SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Share of the rows by which the rank of an answer may be off, in 99 of 100 answers (the published fit for KLL sketches)."""
    return 2.296 / size**0.9723


def rank_sketches(df: DataFrame, value: str, by: Sequence[str] = (), size: int = SIZE, name: str = "sketch") -> DataFrame:
    """One sketch of ``value`` per group and the rows in it, ``n``.

    Nulls and NaN are left out. A group without any other value keeps its row, with a null sketch and ``n`` = 0. ``size`` is the number of
    values kept at the top level: the state is about 14 bytes times that, whatever the number of rows.
    """
    v = F.col(value).cast("double")
    known = F.when(~F.isnan(v), v)
    out = df.groupBy(*by).agg(F.kll_sketch_agg_double(known, F.lit(size)).alias(name), F.count(known).alias("n"))
    return out.select(*by, F.when(F.col("n") > 0, F.col(name)).alias(name), "n")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), name: str = "sketch") -> DataFrame:
    """Sketches of finer groups as one sketch per coarser group. The error is that of a sketch over all rows; null sketches add nothing."""
    out = sketches.groupBy(*by).agg(F.kll_merge_agg_double(F.col(name)).alias(name), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return out.select(*by, F.when(F.col("n") > 0, F.col(name)).alias(name), "n")


def sketched_quantiles(sketches: DataFrame, probs: Mapping[str, float], by: Sequence[str] = (), name: str = "sketch") -> DataFrame:
    """The quantiles of each sketch, one column per entry of ``probs`` plus ``n``: values that were seen, without interpolation.

    Probabilities 0 and 1 give the exact minimum and maximum. Null without any value.
    """
    picked = sketches.withColumn("_q", F.kll_sketch_get_quantile_double(name, F.array(*[F.lit(float(p)) for p in probs.values()])))
    return picked.select(*by, "n", *[F.get("_q", F.lit(i)).alias(k) for i, k in enumerate(probs)])


def share_below(sketch: str, value: float) -> Column:
    """Approximate share of a sketch's rows at or below a number."""
    return F.kll_sketch_get_rank_double(sketch, F.lit(float(value)))


def measured_errors(df: DataFrame, value: str, answers: DataFrame, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact rank error of each answer (``e_{name}``), from one more pass over the rows.

    An answer holds the ranks from the rows below it to the rows up to it, so ties are no error.
    """
    by = list(by)
    seen = join_groups(df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")), answers.drop("n"), by)
    counts = [c for k in probs for c in (F.count_if(F.col("_v") < F.col(k)).alias(f"_b_{k}"), F.count_if(F.col("_v") <= F.col(k)).alias(f"_u_{k}"))]
    out = seen.groupBy(*by).agg(F.count("*").alias("n"), *counts)
    return out.select(*by, "n", *[F.greatest(F.lit(0.0), F.col(f"_b_{k}") / F.col("n") - p, p - F.col(f"_u_{k}") / F.col("n")).alias(f"e_{k}") for k, p in probs.items()])
