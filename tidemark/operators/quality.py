"""Expectations, reconciliation and fingerprints of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.cleaning import small_table


def expectations(spark, rows: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Declared expectations: metric, value, tolerance (0 for an exact count)."""
    return small_table(spark, rows, "metric string, expected double, tolerance double")


def check(metrics: DataFrame, expected: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Expected against got; a metric that was not produced fails."""
    got = metrics.select(*keys, F.col(value).cast("double").alias("got"))
    out = expected.join(got, list(keys), "left")
    near = F.abs(F.col("got") - F.col("expected")) <= F.col("tolerance")
    return out.withColumn("ok", F.when(F.coalesce(near, F.lit(False)), 1).otherwise(0))


def enforce(checked: DataFrame) -> DataFrame:
    """Fail the job at the first row that is not ok, inside the plan: nothing is collected."""
    message = F.concat_ws(" ", F.lit("expectation failed:"), F.col("metric"), F.col("got").cast("string"))
    return checked.withColumn("ok", F.when(F.col("ok") == 1, F.col("ok")).otherwise(F.raise_error(message).cast("int")))


def long_metrics(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), source: str | None = None, field: str | None = None) -> DataFrame:
    """Metric ledger rows ``(keys, metric, value)`` with the lineage of each number."""
    rows = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    out = df.select(*keys, F.inline(rows))
    if source is not None:
        out = out.withColumn("source", F.lit(source)).withColumn("field", F.concat_ws(".", F.lit(field or source), F.col("metric")))
    return out


def key_report(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Uniqueness of the keys on both sides, unmatched keys, and values missing after the match."""
    a = left.groupBy(*keys).agg(F.count("*").alias("_a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("_b"), F.count(value).alias("_v"))
    both = a.join(b, list(keys), "full")
    hit = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(
        F.count_if(F.col("_a") > 1).alias("left_duplicates"), F.count_if(F.col("_b") > 1).alias("right_duplicates"), F.count_if(hit).alias("matched"),
        F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"),
        F.count_if(hit & (F.col("_v") == 0)).alias("missing_after_match"))


def monotone(metrics: DataFrame, order: str, value: str, by: Sequence[str] = (), decreasing: bool = True) -> DataFrame:
    """Does a metric move in one direction along its parameter (a report table with a row per setting)?"""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    wrong = (step > 0) if decreasing else (step < 0)
    out = metrics.withColumn("_bad", F.when(F.coalesce(wrong, F.lit(False)), 1).otherwise(0)).groupBy(*by).agg(F.count("*").alias("n"), F.sum("_bad").alias("violations"))
    return out.withColumn("ok", F.when(F.col("violations") == 0, 1).otherwise(0))


def parts_equal_total(parts: DataFrame, total: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over the parts against a total that was computed on its own."""
    summed = parts.groupBy(*by).agg(F.sum(value).alias("sum_of_parts"))
    other = total.select(*by, F.col(value).alias("total"))
    joined = summed.join(other, list(by), "full") if by else summed.crossJoin(other)
    return joined.withColumn("ok", F.when(F.col("sum_of_parts") == F.col("total"), 1).otherwise(0))


def membership(small: DataFrame, large: DataFrame, keys: Sequence[str], strata: str) -> DataFrame:
    """Is every key of one table in the other? Rows found and lost per stratum."""
    marked = small.join(large.select(*keys).distinct().withColumn("_in", F.lit(1)), list(keys), "left")
    return marked.groupBy(strata).agg(F.count("*").alias("n"), F.count("_in").alias("found"), F.count_if(F.col("_in").isNull()).alias("lost"))


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Share of matched rows whose labels agree."""
    pair = a.select(*keys, F.col(label).alias("_a")).join(b.select(*keys, F.col(label).alias("_b")), list(keys))
    return pair.agg(F.count("*").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), 1).otherwise(0)).alias("agree"),
                    F.avg(F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0)).alias("rate"))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Content fingerprint of a table that does not depend on row order: row count, xor and sum of row digests."""
    cols = sorted(columns or df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.select(digest.alias("_d")).agg(F.count("*").alias("rows"), F.bit_xor("_d").alias("xor_digest"), F.sum("_d").alias("sum_digest"))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
