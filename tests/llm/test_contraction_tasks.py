from pyspark.sql import functions as F

from tidemark.llm import neardup


def test_steps_over_few_links_are_few_tasks(spark, monkeypatch):
    widths, stage = [], neardup.stage

    def watched(df):
        out = stage(df)
        widths.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(neardup, "stage", watched)
    conf = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 40).select(F.col("id").alias("__u"), (F.col("id") - F.col("id") % 4).alias("__v")).filter("__u > __v AND __v > 0")
        got = {r["__node"]: r["__comp"] for r in neardup.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 4 for i in range(4, 40)}
    assert len(widths) > 2 and max(widths[1:]) == 1
