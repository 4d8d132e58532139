"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Expected copies are summed up along the source, one
random offset is added, and a copy is emitted for each whole number that the running sum crosses. The documents of a source stand in order of
their size class, so every class is taken in proportion and the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CELL = 100_000


def size_class(size: Column) -> Column:
    """Eight classes per doubling of the size, 0 for size 0; the classes follow the size."""
    bits = F.length(F.bin(size))
    return F.when(size > 0, bits * 8 + (F.floor((size * 8) / F.pow(F.lit(2.0), bits - 1)) - 8)).otherwise(0).cast("int")


def _number(text: Column) -> Column:
    """32 bits of a digest as a long; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def weighted_targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """Adds ``target`` to a table with one row per ``source`` and its ``source_size``.

    Sources by code point, null last, get the weights in turn and share the total size. A target stops at ``most`` times its source's size; the
    excess goes to the others by weight, again and again, until none is above. That is a common level times the weight, cut at the cap: sources
    are put in the order in which they reach their cap, and the level is read from running sums. One row per source is all that is in memory.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    in_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    capped = F.coalesce(F.sum("cap").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (total - capped) / open_weight)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).drop("weight", "cap", "level")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 7) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` (words that the mix takes) to each row.

    Columns of these names in the input are replaced. A null source is a source of its own; rows of size 0 are sampled like the others and add
    nothing; a source whose size is 0 gets no target and no copies. Rows alike in key and size may swap their copies. No row gets more than
    ``most`` copies, rounded up. The same rows and seed give the same mix, whatever the partitions.

    A source is cut into cells (size class, hash of the key) that hold a bounded number of rows. Only cell counts are summed up along a source; rows
    are ranked inside their cell.
    """
    df = df.drop("source_size", "target", "copies", "taken")
    buckets = df.count() // ROWS_PER_CELL + 1
    df = df.withColumn("__class", size_class(F.col(size))).withColumn("__hash", _number(F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    df = df.withColumn("__cell", F.pmod("__hash", F.lit(buckets)))
    cells = df.groupBy(F.col(source).alias("source"), "__class", "__cell").agg(F.count(F.lit(1)).alias("__rows"), F.sum(size).alias("__size"))
    before = Window.partitionBy("source").orderBy("__class", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows", "__size")
    targets = weighted_targets(cells.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, most)
    offset = _number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("null")))) / F.lit(4294967296.0)
    targets = targets.withColumn("__offset", offset).withColumnRenamed("source", "__name")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("__name"))).drop("__name").withColumnsRenamed({"source": "__source", "__class": "__class2", "__cell": "__cell2"})
    inside = Window.partitionBy(source, "__class", "__cell").orderBy(size, "__hash", key)
    ranked = df.withColumn("__rank", F.row_number().over(inside))
    at_cell = ranked[source].eqNullSafe(starts["__source"]) & (ranked["__class"] == starts["__class2"]) & (ranked["__cell"] == starts["__cell2"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("__start") + F.col("__rank")
    copies = F.floor(rate * place + F.col("__offset")) - F.floor(rate * (place - 1) + F.col("__offset"))
    out = ranked.join(starts, at_cell).withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col(size))
    return out.drop("__class", "__hash", "__cell", "__rank", "__source", "__class2", "__cell2", "__start", "__offset")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say; ``copy`` counts from 1."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
