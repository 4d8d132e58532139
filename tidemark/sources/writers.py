"""Sinks and the extraction helper that counts what it writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested report rows, one JSON document per line."""
    df.write.mode("overwrite").json(path)


def nest_report(metrics: DataFrame, outer: str, key: str = "metric", value: str = "value") -> DataFrame:
    """Long metric rows as one document per outer key: ``{outer, metrics: {name: value}}``."""
    return metrics.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("metrics"))


def extract(df: DataFrame, path: str, name: str, entity: str) -> dict:
    """Run an extraction, store it as parquet and report row and entity counts, read off one column of what was stored.

    (Counting while writing needs an observation, and a session that has used one can no longer ship fitted logistic
    models to executors.)
    """
    df.write.mode("overwrite").parquet(path)
    counts = df.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities")).first()
    return {"name": name, **counts.asDict()}
