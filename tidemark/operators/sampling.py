"""Splits, folds, samples and class weights. Randomness is a hash of (seed, unit): no order, no state, no shuffle of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import hash32, hash_text, joined_text
from tidemark.operators.ordered import cumulate, join_entities, join_on, quantiles
from tidemark.session import stage


# Seed distance of the second hash, which orders units whose first hashes collide.
TIE = 7919
#: Number of 32-bit hashes, and half the width of the band around their middle in which a border is looked for, in units of n^-1/2 (eight standard deviations).
HASHES, BAND = 1 << 32, 4


def group_split(df: DataFrame, unit: str | Sequence[str], fraction: float = 0.8, seed: int = 42, name: str = "split") -> DataFrame:
    """Exact split by unit: the first ``floor(fraction * n)`` units in hash order are ``train``, the rest ``test``.

    The unit can be a row key, an entity or a subject; all rows of a unit fall on one side. Units are ranked by their
    hash; what comes back is one border value, so the rows themselves are compared where they are and never shuffled.
    """
    units = [unit] if isinstance(unit, str) else list(unit)
    ranked = unit_positions(df, units, seed)
    key = F.struct(hash32(*units, seed=seed).alias("h"), hash32(*units, seed=seed + TIE).alias("g"), *units)
    at_cut = F.col("_position") == F.floor(F.col("_count") * F.lit(float(fraction)))
    border = ranked.agg(F.max(F.when(at_cut, key)).alias("_border"))
    before = F.coalesce(key < F.col("_border"), F.lit(True))
    return df.crossJoin(F.broadcast(border)).withColumn(name, F.when(before, "train").otherwise("test")).drop("_border")


def unit_positions(df: DataFrame, units: Sequence[str], seed: int = 42) -> DataFrame:
    """0-based position of each distinct unit in hash order, with the number of units."""
    keyed = df.select(*units).distinct().withColumn("_h", hash32(*units, seed=seed))
    runs = cumulate(keyed, "_h", {"_k": F.lit(1)})
    # Collisions are rare and small; inside one hash value the order is that of a second hash.
    joined = join_entities(keyed.withColumn("_g", hash32(*units, seed=seed + TIE)), runs, ["_h"])
    tie = F.row_number().over(Window.partitionBy("_h").orderBy("_g", *units)) - 1
    return joined.select(*units, (F.col("_k_before") + tie).alias("_position"), F.col("_k_total").alias("_count"))


def group_folds(df: DataFrame, unit: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds by unit with even sizes: units in order of size (largest first) are dealt in a snake over the folds.

    Units of one size are dealt in hash order. The number of distinct sizes is small, so ranks come from the piecewise
    running count over sizes plus positions inside a size, which are hash ranks again.
    """
    sizes = df.groupBy(unit).agg(F.count("*").alias("_rows")).withColumn("_h", hash32(unit, seed=seed))
    # One sortable number: size first, then the hash as a fraction.
    keyed = sizes.withColumn("_o", F.col("_rows") + F.col("_h") / F.lit(4294967296.0))
    runs = cumulate(keyed, "_o", {"_k": F.lit(1)}, descending=True)
    joined = join_entities(keyed, runs, ["_o"])
    position = F.col("_k_before") + F.row_number().over(Window.partitionBy("_o").orderBy(unit)) - 1
    placed = joined.withColumn("_p", position)
    lap, at = F.floor(F.col("_p") / k), F.col("_p") % k
    fold = F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int")
    return join_entities(df, placed.select(unit, fold.alias(name)), [unit])


def leakage(df: DataFrame, subject: str, split: str = "split") -> DataFrame:
    """Rows and subjects per side and subjects found on both sides."""
    per = df.groupBy(subject).agg(F.count_if(F.col(split) == "train").alias("_tr"), F.count_if(F.col(split) == "test").alias("_te"))
    return per.agg(F.sum("_tr").alias("train_rows"), F.sum("_te").alias("test_rows"), F.count_if(F.col("_tr") > 0).alias("train_subjects"),
                   F.count_if(F.col("_te") > 0).alias("test_subjects"), F.count_if((F.col("_tr") > 0) & (F.col("_te") > 0)).alias("shared_subjects"))


def year_split(year: str, first: int = 2017, second: int = 2019) -> Column:
    """Development, selection and test periods by calendar year."""
    y = F.col(year)
    return F.when(y <= first, "train").when(y <= second, "select").when(y.isNotNull(), "test")


def era_split(entities: DataFrame, seconds: str, by: Sequence[str] = (), name: str = "era") -> DataFrame:
    """Early and late entities, divided at the median entity time (the median itself is early)."""
    middle = quantiles(entities, seconds, {"_middle": 0.5}, by).drop("n")
    joined = join_on(entities, middle, list(by))
    return joined.withColumn(name, F.when(F.col(seconds) <= F.col("_middle"), "early").otherwise("late")).drop("_middle")


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, in hash order of the row key (a top-n, pruned in every task)."""
    return df.withColumn("_h", hash32(*key, seed=seed)).orderBy("_h", *key).limit(n).drop("_h")


def half_splits(df: DataFrame, unit: Sequence[str], repeats: int, seed: int = 42) -> DataFrame:
    """Repeated random halves by unit: the top bit of a hash per (unit, repeat)."""
    spread = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return spread.withColumn("half", F.when(hash32(*unit, "repeat", seed=seed) < 2147483648, 0).otherwise(1))


def exact_halves(df: DataFrame, unit: Sequence[str], repeats: int, seed: int = 42) -> DataFrame:
    """Repeated exact halves by unit: rows per ``repeat`` with ``half`` 0 for the first n // 2 of n units in the order of a hash per (unit, repeat), else 1.

    The border of every repeat is the middle of even hashes: one pass counts the hashes below a narrow band around it and lists those inside, of the order of sqrt(n), which alone are ranked. Should a
    border lie outside, the band is widened. What a unit has in common over the repeats is made into text once, and the second hash is taken only where the first ones are equal. One border per
    repeat is all that meets the rows then.
    """
    unit = list(unit)
    number = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")
    texts = [joined_text(*unit, seed=seed).alias("_text"), joined_text(*unit, seed=seed + TIE).alias("_tie")]
    first, second = (hash_text(F.concat_ws("|", c, F.col("repeat").cast("string"))) for c in ("_text", "_tie"))
    units = df.select(*unit).distinct()
    n = units.count()
    drawn = units.select(*unit, *texts).select("*", number).withColumn("_h", first)
    wide = HASHES * BAND // math.isqrt(max(n, 1)) + 1
    while True:
        low, high = max(HASHES // 2 - wide, 0), min(HASHES // 2 + wide, HASHES)
        inside = F.col("_h").between(low, high - 1)
        mine = F.when(inside, F.struct("_h", second.alias("_g"), *unit)).alias("_unit")
        near = stage(drawn.filter(F.col("_h") < high).select("repeat", mine).groupBy("repeat", "_unit").agg(F.count("*").alias("_n")))
        counts = near.groupBy("repeat").agg(F.sum(F.when(F.col("_unit").isNull(), F.col("_n")).otherwise(0)).alias("_below"), F.sum("_n").alias("_upto"))
        found = counts.filter((F.col("_below") < n // 2) & (F.col("_upto") >= n // 2)).count()
        if found == repeats or n < 2 or (low, high) == (0, HASHES):
            break
        wide *= 16
    place = F.row_number().over(Window.partitionBy("repeat").orderBy("_unit"))
    ranked = near.filter(F.col("_unit").isNotNull()).withColumn("_place", place).join(F.broadcast(counts), "repeat")
    border = stage(ranked.filter(F.col("_place") + F.col("_below") == n // 2).select("repeat", F.col("_unit").alias("_border")))
    spread = df.select("*", *texts).select("*", number).withColumn("_h", first).join(F.broadcast(border), "repeat", "left")
    tie = F.struct(second.alias("_g"), *unit) <= F.struct("_border._g", *[F.col("_border")[c].alias(c) for c in unit])
    before = F.when(F.col("_h") == F.col("_border._h"), tie).otherwise(F.col("_h") < F.col("_border._h"))
    return spread.withColumn("half", F.when(before, 0).otherwise(1)).drop("_h", "_text", "_tie", "_border")


def sample_fractions(df: DataFrame, unit: Sequence[str], fractions: Sequence[float], seed: int = 42) -> DataFrame:
    """Nested training fractions by unit for a learning curve: a unit is in every fraction above its hash."""
    u = hash32(*unit, seed=seed) / F.lit(4294967296.0)
    spread = df.withColumn("_u", u).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return spread.filter(F.col("_u") < F.col("fraction")).drop("_u")


def class_weights(df: DataFrame, y: str = "y", by: Sequence[str] = (), name: str = "class_weight") -> DataFrame:
    """Balanced weights ``n / (2 n_class)`` on every row."""
    counts = df.groupBy(*by).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    total = F.col("_p") + F.col("_n")
    joined = join_on(df, counts, list(by))
    mine = F.when(F.col(y) == 1, F.col("_p")).otherwise(F.col("_n"))
    return joined.withColumn(name, F.try_divide(total, mine * 2.0)).drop("_p", "_n")
