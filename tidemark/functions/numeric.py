"""Scalar column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def number(col) -> Column:
    """Text to double; anything unreadable, NaN included, becomes NULL."""
    return not_nan(_c(col).try_cast("double"))


def not_nan(col) -> Column:
    """NaN and NULL are one missing marker in this library: NULL."""
    return F.when(~F.isnan(_c(col)), _c(col))


def hours_between(start, end) -> Column:
    """Difference of two timestamps in hours, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(3.6e9)


def minutes_to_hours(col, anchor=None) -> Column:
    shifted = _c(col) if anchor is None else _c(col) - _c(anchor)
    return shifted / F.lit(60.0)


def hour_bin(col, width: float = 6.0) -> Column:
    """Start of the bin that holds an hour; floors, so negative hours work too."""
    return F.floor(_c(col) / F.lit(float(width))) * F.lit(float(width))


def logit(p, eps: float = 1e-12) -> Column:
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), _c(p)))
    # Python-side NULL handling: greatest/least skip NULLs, so the guard keeps a missing score missing.
    return F.when(_c(p).isNotNull(), F.log(clipped / (F.lit(1.0) - clipped)))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def recalibrate(p, intercept, slope, eps: float = 1e-12) -> Column:
    """Two-parameter recalibration layer on the logit scale."""
    a = F.lit(float(intercept)) if not isinstance(intercept, Column) else intercept
    b = F.lit(float(slope)) if not isinstance(slope, Column) else slope
    return sigmoid(a + b * logit(p, eps))


def intercept_update(p, intercept, eps: float = 1e-12) -> Column:
    """Recalibration in the large: the slope stays 1."""
    return recalibrate(p, intercept, 1.0, eps)


def band(p, cuts=(0.10, 0.15)) -> Column:
    """Right-open risk band: number of cut points at or below the score."""
    hits = [F.when(_c(p) >= F.lit(float(c)), 1).otherwise(0) for c in cuts]
    return F.when(_c(p).isNotNull(), reduce(lambda a, b: a + b, hits))


def clamp_missing(col, lo: float, hi: float) -> Column:
    """Values outside the closed range become missing."""
    return F.when(_c(col).between(F.lit(float(lo)), F.lit(float(hi))), _c(col))


def true_or_false(cond: Column) -> Column:
    """Three-valued logic to 0/1: an unknown condition counts as false."""
    return F.when(cond, 1).otherwise(0)


def safe_divide(a, b) -> Column:
    """NULL, not an error, for a zero or missing denominator."""
    return F.try_divide(_c(a), _c(b))


def fold_of(a, b) -> Column:
    """Floating ratio ``a / b`` that keeps a zero denominator: infinite, or NaN for 0 / 0, which like in SQL is above every number. NULL only for a missing side."""
    return F.when(_c(b) == 0, _c(a).cast("double") * F.lit(float("inf"))).otherwise(F.try_divide(_c(a), _c(b)))


# ---------------------------------------------------------------- hashed randomness


def hash32(*parts, seed: int = 42) -> Column:
    """32-bit hash of (seed, parts), read from an md5 digest so other engines can reproduce it."""
    return hash_text(joined_text(*parts, seed=seed))


def joined_text(*parts, seed: int = 42) -> Column:
    """What ``hash32`` digests; further parts may be joined to it by ``|``."""
    return F.concat_ws("|", F.lit(str(seed)), *[_c(p).cast("string") for p in parts])


def hash_text(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hashed_uniform(*parts, seed: int = 42) -> Column:
    return hash32(*parts, seed=seed) / F.lit(4294967296.0)


def draw_hash(base: Column, replicate: Column) -> Column:
    """32-bit hash of an entity hash and a replicate number, by the engine's own generated Murmur3 code.

    Both numbers share one long (replicate in the upper half), so other engines need one round of the same function.
    """
    packed = base + replicate.cast("bigint") * F.lit(4294967296)
    return F.pmod(F.hash(packed).cast("bigint"), F.lit(4294967296))


# floor(2^32 * P(Poisson(1) <= k)) for k = 0..9.
POISSON_CUTS = (
    1580030168, 3160060337, 3950075421, 4213413783, 4279248373,
    4292415291, 4294609777, 4294923276, 4294962463, 4294966817,
)


def poisson_count(hashed: Column) -> Column:
    """Poisson(1) multiplicity from a 32-bit hash: how often an entity is drawn in one replicate."""
    out = F.when(hashed < POISSON_CUTS[0], 0)
    for k, cut in enumerate(POISSON_CUTS[1:], start=1):
        out = out.when(hashed < cut, k)
    return out.otherwise(len(POISSON_CUTS))
