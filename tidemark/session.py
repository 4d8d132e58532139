"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task gets where it holds nearly an entry per row.
ROWS_PER_TASK = 250_000


def local_session(cpus: int | str = "*", app: str = "tidemark", driver_memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks. A cluster supplies its own session instead."""
    cores = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def stage(df: DataFrame) -> DataFrame:
    """Write a stage table to reliable storage and continue from it.

    Uses the folder the session names in ``spark.checkpoint.dir`` (or one already set on the context), so the
    rows survive the loss of executors. A machine-local folder is used only by a session that runs in one process, as in tests; any
    other session without a shared folder is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="spark-")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def dealt(df: DataFrame, *keys: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt out by key before a grouping that keeps nearly an entry per row: into as many partitions as the rows ask for.

    Spark sizes partitions by their compressed bytes, which say little about the entries a task will hold. Tables that ask for no more
    partitions than there are cores are left to Spark. The rows are counted once; for a parquet table that reads the footers only.
    """
    wanted = -(-df.count() // rows_per_task)
    return df.repartition(wanted, *keys) if wanted > df.sparkSession.sparkContext.defaultParallelism else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
