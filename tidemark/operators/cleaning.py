"""Harmonising raw long tables: item mapping, units, ranges, ordinal texts, duplicates, missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X


def small_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Mapping declared in code, as a table. Its size is that of the declaration, so it may be broadcast."""
    return spark.createDataFrame(list(rows), schema)


def map_items(df: DataFrame, item: str, families: Mapping[str, Sequence[str]], name: str = "fam") -> DataFrame:
    """Attach the family of each item and keep mapped items only."""
    table = small_table(df.sparkSession, [(i, f) for f, items in families.items() for i in items], f"_item string, {name} string")
    return df.join(F.broadcast(table), F.col(item) == F.col("_item"), "inner").drop("_item")


def convert_units(df: DataFrame, factors: Mapping[str, float], fam: str = "fam", value: str = "val") -> DataFrame:
    """Linear conversion per family; families without a factor stay as they are."""
    factor = F.coalesce(*[F.when(F.col(fam) == k, F.lit(float(v))) for k, v in factors.items()], F.lit(1.0))
    return df.withColumn(value, F.col(value) * factor)


def scale_by_median(df: DataFrame, family: str, limit: float = 1.5, factor: float = 100.0, fam: str = "fam",
                    value: str = "val") -> DataFrame:
    """Multiply one family by ``factor`` when its median shows that it was recorded as a fraction.

    "Median below the limit" only needs two counts (values below the limit against all values) except when the
    middle falls exactly between the two sides, where the two neighbours of the limit decide.
    """
    mine = F.col(fam) == family
    v = F.when(mine & ~F.isnan(value), F.col(value))
    low = F.when(v < limit, v)
    high = F.when(v >= limit, v)
    facts = df.agg(F.count(v).alias("_all"), F.count(low).alias("_low"), F.max(low).alias("_top"), F.min(high).alias("_bottom"))
    half = F.col("_all") / 2.0
    below = F.when(F.col("_low") > half, True).when(F.col("_low") < half, False).otherwise(
        (F.col("_top") + F.col("_bottom")) / 2.0 < limit)
    flagged = df.crossJoin(F.broadcast(facts.select(F.coalesce(below, F.lit(False)).alias("_scale"))))
    return flagged.withColumn(value, F.when(mine & F.col("_scale"), F.col(value) * factor).otherwise(F.col(value))).drop("_scale")


def within_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]], fam: str = "fam", value: str = "val") -> DataFrame:
    """Drop values outside the closed range of their family; families without a range keep everything."""
    v = F.col(value)
    inside = F.coalesce(*[F.when(F.col(fam) == k, v.between(float(lo), float(hi))) for k, (lo, hi) in bounds.items()], F.lit(True))
    return df.filter(v.isNotNull() & inside)


def fahrenheit_to_celsius(df: DataFrame, family: str, target: str, fam: str = "fam", value: str = "val") -> DataFrame:
    """One item in Fahrenheit joins the native Celsius family."""
    mine = F.col(fam) == family
    return (df.withColumn(value, F.when(mine, (F.col(value) - 32) / 1.8).otherwise(F.col(value)))
            .withColumn(fam, F.when(mine, F.lit(target)).otherwise(F.col(fam))))


def preferred_variant(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """Keep only the best-ranked label variant present for each key (all its rows).

    The best rank per key is a map-side combined minimum joined back, so a hot key is never sorted as one group.
    """
    ranked = df.withColumn("_rank", rank)
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    return ranked.join(best, list(keys)).filter(F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def best_single_value(df: DataFrame, entity: str, value: str, priority: Column, time: str) -> DataFrame:
    """One value per entity: best priority first, then the earliest, then the smallest."""
    return df.filter(F.col(value).isNotNull()).groupBy(entity).agg(
        F.min_by(value, F.struct(priority.alias("p"), F.col(time).alias("t"), F.col(value).alias("v"))).alias(value))


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    """Several feeds of one variable as one series; consumers order by time, so no sort happens here."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing, NaN included, becomes 0."""
    return df.select(*[F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), F.lit(0)).alias(c) if c in columns
                       else F.col(c) for c in df.columns])


def fill_from(df: DataFrame, defaults: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values take the value of a one-row table of defaults (training medians, a profile). A table with more rows is refused."""
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("the table of defaults has more than one row")).cast("boolean")).otherwise(True)
    picked = defaults.agg(single.alias("_single"), *[F.first(c).alias(f"_d_{c}") for c in columns])
    one = picked.filter("_single").select(*[f"_d_{c}" for c in columns])
    joined = df.crossJoin(F.broadcast(one))
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_d_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share of every column in one pass, as rows (column, n, missing, share)."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(columns)])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n"), F.col(f"m_{i}").alias("missing"))
                      for i, c in enumerate(columns)])
    return wide.select(F.inline(parts)).withColumn("share", F.try_divide(F.col("missing"), F.col("n")))


def drop_sparse(df: DataFrame, columns: Sequence[str], limit: float = 0.6) -> DataFrame:
    """Drop the columns whose missing share exceeds the limit (the share table has one row per column)."""
    shares = missing_shares(df, columns).filter(F.col("share") > limit).collect()
    return df.drop(*[r["column"] for r in shares])


def unmapped_values(df: DataFrame, value: str, table: dict, pattern: str) -> DataFrame:
    """How often each text was met that no rule can read."""
    return df.filter(X.ordinal_unmapped(value, table, pattern)).groupBy(value).agg(F.count("*").alias("n"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key under a total order: a minimum over (order, row), combined on the map side. Spark aggregates structs by sort, on both sides of the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_cols)], *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)])
    picked = df.groupBy(*keys).agg(F.min(key).alias("_first"))
    out = {c: F.col(f"_first.r{i}") for i, c in enumerate(rest)}
    return picked.select(*[F.col(c) if c in keys else out[c].alias(c) for c in df.columns])


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; Spark prunes with a per-task group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
