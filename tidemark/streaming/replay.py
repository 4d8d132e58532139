"""Replaying a table as a stream that arrives in several batches, out of order and partly too late."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def by_arrival(rows: DataFrame, arrival: Column, borders: Sequence, name: str = "batch") -> DataFrame:
    """Rows with the number of the batch they arrive in: how many of the ascending borders their arrival has reached."""
    reached = [F.when(arrival >= F.lit(b), 1).otherwise(0) for b in borders]
    return rows.withColumn(name, sum(reached, F.lit(0)))


def replay(rows: DataFrame, batches: int, job: Callable[[DataFrame], DataFrame], folder: str, batch: str = "batch", mode: str = "append", stateful: bool = False) -> DataFrame:
    """What a streaming job has written after all batches have come, one after the other.

    Rows are laid out by batch once. For each batch its rows are added to the input folder and the job is started anew from its checkpoint, takes
    what is there, closes what the watermark closes, and stops. So every batch but the first is a restart in mid-stream: state, watermark and
    sink come from the checkpoint alone. ``folder`` must be shared by driver and executors.
    """
    spark = rows.sparkSession
    laid, inbox, out, check = (f"{folder}/{part}" for part in ("laid", "in", "out", "state"))
    rows.write.partitionBy(batch).parquet(laid)
    schema = rows.drop(batch).schema
    before = spark.conf.get(PROVIDER, None)
    if stateful:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        for b in range(batches):
            spark.read.schema(rows.schema).parquet(laid).filter(F.col(batch) == b).drop(batch).write.mode("append").parquet(inbox)
            stream = spark.readStream.schema(schema).parquet(inbox)
            job(stream).writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    finally:
        if stateful:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.parquet(out)


def late_rows(streamed: DataFrame, whole: DataFrame, keys: Sequence[str], n: str = "n", name: str = "late") -> DataFrame:
    """Streamed groups with the rows that came too late for them: the same job's count over the whole table less the streamed one."""
    counts = whole.select(*keys, F.col(n).alias("_whole"))
    return streamed.join(counts, list(keys)).withColumn(name, F.col("_whole") - F.col(n)).drop("_whole")
