"""Rows dealt out before a grouping with nearly an entry per row: no task gets more than its share, however well the rows compress."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from tidemark import session
from tidemark.plans import fixtures


def test_partitions_follow_the_rows(spark):
    rows = spark.range(0, 40_000, 1, 4).withColumn("key", F.col("id") % 5000)
    out = session.dealt(rows, "key", rows_per_task=1000)
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 40 and max(r["count"] for r in sizes) < 2000
    assert session.dealt(rows, "key").rdd.getNumPartitions() == 4


def test_queries_on_dealt_rows_equal_their_sql(spark, monkeypatch):
    """With tasks of 100 rows: J10, D2, Q5 and E23 shuffle rows by entity once and still give what SQL gives."""
    monkeypatch.setattr(fixtures, "dealt", lambda df, *keys: session.dealt(df, *keys, rows_per_task=100))
    sf = "/root/testdata/sf0.001"
    assert fixtures.predictions(spark, sf).rdd.getNumPartitions() > 30
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    for name in ("J10_aligned_endpoints", "D2_threshold_sweep", "Q5_monotone_in_threshold", "E23_subgroups"):
        got = __spark_entry__.queries()[name](spark, sf)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
