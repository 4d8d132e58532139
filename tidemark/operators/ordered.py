"""Running totals, exact quantiles, bins and ranks over orders that have no small partition key.

``Window.orderBy(score)`` alone sends all rows to one task. Here the score axis is cut at sampled split points;
each piece is summed on its own, the piece totals (a handful of rows per group) are accumulated, and the offsets
are joined back. The split points only decide how even the pieces are, never the result. A score that holds a
large share of all rows becomes a piece of its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import stage

PIECE = "_piece"
ROWS_PER_PIECE = 1_000_000
#: Rows that a table with one row per group may have to be sent to every task.
GROUPS_SENT = 100_000


def split_points(df: DataFrame, order: str, rows_per_piece: int = ROWS_PER_PIECE) -> list[float]:
    """Values that cut ``order`` into pieces of about ``rows_per_piece`` rows, into two at least; none for an empty table.

    Every size takes the same path, and the number of pieces has no ceiling. The cuts come from a mergeable quantile sketch over the one
    column; the driver receives one number per piece.
    """
    rows = df.agg(F.count(order)).first()[0]
    if not rows:
        return []
    wanted = max(2, -(-rows // rows_per_piece))
    fractions = [i / wanted for i in range(1, wanted)]
    sketch = F.percentile_approx(F.col(order).cast("double"), fractions, max(1000, 4 * wanted))
    return sorted(set(df.agg(sketch).first()[0]))


def add_piece(df: DataFrame, order: str, points: Sequence[float]) -> DataFrame:
    """Piece number, non-decreasing in ``order``. Even pieces hold exactly one value (a split point)."""
    if not points:
        return df.withColumn(PIECE, F.lit(1).cast("long"))
    splits = [-math.inf]
    for p in map(float, points):
        # Each point and the next number after it are borders, so that a point's own rows are a bucket.
        if p > splits[-1]:
            splits += [p, math.nextafter(p, math.inf)]
    cut = Bucketizer(splits=[*splits, math.inf], inputCol="_order", outputCol="_slot", handleInvalid="keep")
    slotted = cut.transform(df.withColumn("_order", F.col(order).cast("double")))
    return slotted.withColumn(PIECE, F.col("_slot").cast("long") + 1).drop("_order", "_slot")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table per group: NULL is a group of its own, and without a key the right side is one row.

    Joins on entities use plain equality instead, which lets Spark reuse the partitioning by entity.
    """
    if not keys:
        return left.crossJoin(right)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def few_groups(groups: DataFrame) -> bool:
    """Whether a table of one row per group is small enough to go to every task."""
    return groups.limit(GROUPS_SENT + 1).count() <= GROUPS_SENT


def join_groups(left: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``join_on`` with a table of one row per group, which is staged and goes to the tasks if it has few rows.

    Shuffled by a handful of groups, all rows of a group would be one task's. Adaptive execution does not turn such a join into a broadcast
    later, since most partitions of the shuffle are empty.
    """
    groups = stage(groups)
    return join_on(left, F.broadcast(groups) if few_groups(groups) else groups, keys, how)


def join_entities(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on entity keys, which are never NULL."""
    return left.join(right, list(keys), how)


def cumulate(df: DataFrame, order: str, sums: Mapping[str, Column], by: Sequence[str] = (),
             descending: bool = False, points: Sequence[float] | None = None) -> DataFrame:
    """One row per distinct (``by``, ``order``) with each sum, its total strictly before and its grand total.

    Adds ``{name}``, ``{name}_before`` and ``{name}_total`` for every entry of ``sums``. Unless split points are given,
    the table of distinct values is staged first: it is sized, cut and read twice, the input only once.
    """
    by = list(by)
    distinct = df.groupBy(*by, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    if points is None:
        distinct = stage(distinct)
        points = split_points(distinct, order)
    rows = add_piece(distinct, order, points)
    direction = F.desc if descending else F.asc

    pieces = rows.groupBy(*by, PIECE).agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    across = Window.partitionBy(*by).orderBy(direction(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    # The sum of the pieces before enters each piece as its first row: no join, and NULL groups stay groups.
    carry = pieces.select(
        *by, PIECE, F.lit(0).alias("_row"),
        *[F.coalesce(F.sum(f"_{n}").over(across), F.lit(0)).alias(n) for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in sums])
    line = rows.withColumn("_row", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    inside = Window.partitionBy(*by, PIECE).orderBy("_row", direction(order))
    before, so_far = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = line.select(
        *by, order, "_row", *sums, *[F.sum(n).over(before).alias(f"{n}_before") for n in sums],
        *[F.max(f"{n}_total").over(so_far).alias(f"_{n}_total") for n in sums])
    return placed.filter("_row = 1").select(
        *by, order, *sums, *[f"{n}_before" for n in sums], *[F.col(f"_{n}_total").alias(f"{n}_total") for n in sums])


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
              weight: str | None = None, points: Sequence[float] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs`` plus ``n``.

    ``weight`` is an integer repeat count. Group size is unbounded: nothing is gathered into one task.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    ranks = cumulate(known, value, {"_n": F.lit(1) if weight is None else F.col(weight)}, by, points=points)
    if weight is not None:
        ranks = ranks.filter(F.col("_n") > 0)
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    picks = []
    for name, prob in probs.items():
        at = F.lit(float(prob)) * (F.col("_n_total") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        picks += [F.max(F.when((first <= lo) & (lo <= last), F.col(value))).alias(f"_lo_{name}"),
                  F.max(F.when((first <= hi) & (hi <= last), F.col(value))).alias(f"_hi_{name}"),
                  F.max(at - lo).alias(f"_f_{name}")]
    grouped = ranks.groupBy(*by).agg(F.max("_n_total").cast("long").alias("n"), *picks)
    return grouped.select(*by, "n", *[
        (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_f_{k}")).alias(k) for k in probs])


def bin_edges(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), weight: str | None = None,
              points: Sequence[float] | None = None) -> DataFrame:
    """Quantile edges per group as one array; equal edges collapse, so ties give fewer bins."""
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(df, value, names, by, weight, points)
    return edges.select(*by, F.array_distinct(F.array(*names)).alias("edges"))


def bin_number(value, edges="edges") -> Column:
    """Bin of a value for right-closed bins with the lowest edge included."""
    v = F.col(value) if isinstance(value, str) else value
    below = F.size(F.filter(F.col(edges), lambda e: e < v))
    return F.greatest(below - 1, F.lit(0))


def quantile_bins(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), name: str = "bin",
                  weight: str | None = None, points: Sequence[float] | None = None) -> DataFrame:
    """Rows with their quantile bin and the bin's borders ``lo`` and ``hi``."""
    by = list(by)
    edges = bin_edges(df, value, bins, by, weight, points)
    binned = join_groups(df, edges, by).withColumn(name, bin_number(value))
    at = F.col(name)
    return (binned.withColumn("lo", F.element_at("edges", at + 1))
            .withColumn("hi", F.element_at("edges", F.least(at + 2, F.size("edges")))).drop("edges"))


def midranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "midrank",
             points: Sequence[float] | None = None) -> DataFrame:
    """Rank of every row, ties sharing the mean of their positions."""
    by = list(by)
    ranks = cumulate(df.filter(F.col(value).isNotNull()), value, {"_n": F.lit(1)}, by, points=points)
    ranks = ranks.select(*by, value, (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return join_on(df, ranks, [*by, value], "left")
