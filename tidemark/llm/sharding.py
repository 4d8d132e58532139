"""Reproducible shuffle into shards: a keyed permutation of global row numbers.

A row's place is ``p = permute(row number)``; its shard is ``p mod shards`` and its slot ``p div shards``, so both follow from the row number
alone, shard counts differ by one at most, and slots have no gaps. The permutation is a Feistel network over two digits in mixed radix
(a x b >= n, at most sqrt(n) values above n); a value of n or more is fed in again until it is below n (cycle walking).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
WALKS = 64


def radix(n: int) -> tuple[int, int]:
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _div(x: Column, by: int) -> Column:
    """Whole quotient of longs, without a detour over doubles."""
    return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("long")


def _network(x: Column, n: int, seed: int, back: bool) -> Column:
    a, b = radix(n)

    def step(acc: Column, i: Column) -> Column:
        left, right = acc["left"], acc["right"]
        sign = F.lit(-1 if back else 1)
        on_left = F.struct(F.pmod(left + sign * F.pmod(F.xxhash64(F.lit(seed), i, right), F.lit(a)), F.lit(a)).alias("left"), right.alias("right"))
        on_right = F.struct(left.alias("left"), F.pmod(right + sign * F.pmod(F.xxhash64(F.lit(seed), i, left), F.lit(b)), F.lit(b)).alias("right"))
        return F.when(i % 2 == 0, on_left).otherwise(on_right)

    start = F.struct(_div(x, b).alias("left"), F.pmod(x, F.lit(b)).cast("long").alias("right"))
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda acc: acc["left"] * F.lit(b) + acc["right"])


def permute(x: Column, n: int, seed: int = 0, back: bool = False) -> Column:
    """Image of ``x`` in 0..n-1 under the permutation of the seed (``back``: under its inverse).

    A walk visits distinct values of n or more, and there are fewer than sqrt(n) of them, so 64 steps are always enough for n up to 4096;
    for more rows the chance that a walk needs as many is below (1/sqrt(n))**64. A walk that is still outside raises.
    """
    x = x.cast("long")
    first = _network(x, n, seed, back)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda acc, _: F.when(acc < n, acc).otherwise(_network(acc, n, seed, back)))
    return F.when(first < n, first).when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def row_numbers(df: DataFrame, keys: list[str], count: int, name: str = "row_number") -> DataFrame:
    """Adds the global row number, from 0 and without gaps, in the order (hash of the first key, all keys).

    Rows are numbered inside about sqrt(count) hash buckets; the bucket counts, which need one column only, are summed up before them. The
    order depends on the values alone, not on partitions or tasks, so a retried task numbers its rows alike. Rows that agree in all keys are
    numbered in any order: give keys that tell rows apart, or whose ties are equal rows.
    """
    bucket = F.pmod(F.xxhash64(F.col(keys[0])), F.lit(max(1, isqrt(count))))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.select(bucket.alias("__bucket")).groupBy("__bucket").agg(F.count(F.lit(1)).alias("__rows"))
              .select("__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys)) - 1
    numbered = df.drop(name).withColumn("__bucket", bucket).withColumn("__inside", inside)
    return numbered.join(starts, "__bucket").withColumn(name, F.col("__start") + F.col("__inside")).drop("__bucket", "__start", "__inside")


def shard(df: DataFrame, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Adds ``row_number`` (long), ``shard`` (int) and ``slot`` (long); columns of these names in the input are replaced.

    Null keys are a value like any other, equal rows get different slots, and an empty input gives an empty result.
    """
    count = df.count()
    place = permute(F.col("row_number"), count, seed)
    return (row_numbers(df.drop("shard", "slot"), keys, count).withColumn("__place", place)
            .withColumn("shard", F.pmod("__place", F.lit(shards)).cast("int")).withColumn("slot", _div(F.col("__place"), shards)).drop("__place"))


def row_at(shard_: Column, slot: Column, count: int, shards: int, seed: int = 0) -> Column:
    """The row number that stands in a slot: what to read next can be computed without a lookup."""
    return permute(slot.cast("long") * shards + shard_, count, seed, back=True)
