"""Cluster bootstrap: entities are resampled, never rows, and nothing is copied.

An entity's multiplicity in replicate ``b`` is a Poisson(1) count read from a hash of (seed, entity, b). Draws need
no table, no join and no global index; the same entity gets the same count wherever its rows are, which is what
makes comparisons on the same draws paired. A resample of fixed size tops such counts up to the number of units
(``exact_draws``); as a table of draws it is ``fixed_size_draws`` with ``resample_with``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.numeric import POISSON_CUTS, draw_hash, hash32, poisson_count, safe_divide
from tidemark.operators.discrimination import auroc_from_pieces, known_pairs
from tidemark.operators.ordered import PIECE, add_piece, join_entities, join_on, split_points
from tidemark.operators.sampling import unit_positions
from tidemark.session import shuffle_width, stage

STRIP = 64
#: Rows of a block. Blocks cost much arithmetic and few bytes, so they are small, and they are dealt to a stated number of tasks.
ROWS_PER_BLOCK = 25_000
#: Sums that a task may hold where it adds up the draws per score, and the rows that a score must have for that.
SUMS, ROWS_PER_SCORE = 16_000_000, 8
#: Neighbouring units whose further draws travel together, and those that one task counts at a time.
UNITS_PER_PACK, UNITS_PER_COUNT = 4_096, 1 << 26


def single() -> Column:
    """Pieces that hold one score only."""
    return F.col(PIECE) % 2 == 0


def draw_base(unit: Sequence[str], seed: int) -> Column:
    return hash32(*unit, seed=seed)


def resample(df: DataFrame, unit: Sequence[str], sums: Mapping[str, Column], replicates: int, by: Sequence[str] = (),
             seed: int = 42, outer: str | None = None) -> DataFrame:
    """Weighted sums per (replicate, ``by``): the general engine for additive metrics.

    Rows are first summed per (unit, ``by``), then meet the replicates and are summed again before the shuffle.
    With ``outer`` (a site column) the draw has two levels: a unit counts as often as its site times itself.
    """
    by, unit = list(by), list(unit)
    keys = list(dict.fromkeys([*unit, *by, *([outer] if outer else [])]))
    base = df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    base = base.withColumn("_base", draw_base(unit, seed))
    if outer:
        base = base.withColumn("_outer", draw_base([outer], seed + 1))
    spread = base.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)).cast("array<bigint>")))
    weight = poisson_count(draw_hash(F.col("_base"), F.col("replicate")))
    if outer:
        weight = weight * poisson_count(draw_hash(F.col("_outer"), F.col("replicate")))
    drawn = spread.withColumn("_draws", weight).filter(F.col("_draws") > 0)
    return drawn.groupBy("replicate", *by).agg(*[F.sum(F.col(n) * F.col("_draws")).alias(n) for n in sums])


def fixed_size_draws(df: DataFrame, unit: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """Draws of exactly as many units as there are, with replacement: rows (unit, replicate, ``draws``), zero counts left out.

    The n units are numbered in hash order; slot ``d`` of replicate ``b`` draws unit ``floor(u n)`` with a hashed uniform
    ``u`` of (b, d). Costs a shuffle of units times replicates, which Poisson counts do not; needs n below 2^32.
    """
    placed = stage(unit_positions(df, unit, seed))
    slots = placed.select("_position", "_count", F.explode(F.sequence(F.lit(1), F.lit(replicates)).cast("array<bigint>")).alias("replicate"))
    drawn = F.floor(draw_hash(F.col("_position"), F.col("replicate")) / F.lit(4294967296.0) * F.col("_count")).cast("bigint")
    counts = slots.groupBy("replicate", drawn.alias("_position")).agg(F.count("*").alias("draws"))
    return counts.join(placed.drop("_count"), "_position").select(*unit, "replicate", "draws")


def resample_with(df: DataFrame, draws: DataFrame, unit: Sequence[str], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Weighted sums per (replicate, ``by``) under a table of draws."""
    base = df.groupBy(*dict.fromkeys([*unit, *by])).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return join_entities(base, draws, unit).groupBy("replicate", *by).agg(*[F.sum(F.col(n) * F.col("draws")).alias(n) for n in sums])


# Fixed values of the public Murmur3 32-bit hash, whose column expression the draws use.
M3_K1, M3_K2, M3_H, M3_F1, M3_F2, M3_SEED = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35, 42


def _draw_hashes(base: np.ndarray, streams: np.ndarray) -> np.ndarray:
    """Hashes (rows x streams) equal to those of the column expression."""
    u = np.uint32  # products and shifts of 32-bit arrays wrap by themselves

    def turn(x, n):
        return (x << u(n)) | (x >> u(32 - n))

    def absorb(h, part):
        return turn(h ^ (turn(part * u(M3_K1), 15) * u(M3_K2)), 13) * u(5) + u(M3_H)

    first = absorb(np.full(len(base), M3_SEED, u), base.astype(np.uint64).astype(u))
    h = absorb(first[:, None], streams.astype(u)[None, :]) ^ u(8)
    h = (h ^ (h >> u(16))) * u(M3_F1)
    h = (h ^ (h >> u(13))) * u(M3_F2)
    h ^= h >> u(16)
    return h


def _poisson_matrix(base: np.ndarray, streams: np.ndarray, cuts: Sequence[int] = POISSON_CUTS) -> np.ndarray:
    """Multiplicities (rows x streams) from the same hash as the column expression."""
    h = _draw_hashes(base, streams)
    count = np.zeros(h.shape, np.uint8)
    for cut in cuts:
        count += h >= np.uint32(cut)
    return count.astype(np.float64)


class ExactDraws(NamedTuple):
    """Draws of exactly as many units as there are, with replacement: Poisson counts with these cuts and streams (one per replicate), and the few draws that bring each
    replicate to its size, as ``_extra`` (a bit per replicate, then the numbers from 0 of those that draw the unit again) of the units that get them."""

    cuts: tuple[int, ...]
    streams: np.ndarray
    extras: DataFrame
    unit: tuple[str, ...]


def poisson_cuts(rate: float) -> tuple[int, ...]:
    """floor(2^32 * P(Poisson(rate) <= k)) for k = 0, 1, ... as long as it grows."""
    term, total, out = math.exp(-rate), 0.0, []
    for k in range(64):
        total += term
        cut = int(total * 4294967296.0)
        if cut >= 4294967296 or out and cut == out[-1]:
            break
        out.append(cut)
        term *= rate / (k + 1)
    return tuple(out)


def exact_draws(df: DataFrame, unit: Sequence[str], replicates: int, seed: int = 42, rate: float | None = None) -> ExactDraws:
    """Multinomial counts of n draws over n units for every replicate, without a table of draws.

    Independent Poisson counts, given their sum T, are T draws; n - T further draws of evenly chosen units make them n draws, whatever decides on T. The rate is below 1 by eight standard
    deviations of the sum (or as given), so T stays below n; a replicate where it does not takes another stream of hashes. Sums of all replicates come from one scan of the units, in which tasks
    give back one number per replicate. The further draws, of the order of replicates x sqrt(n) (with a lower rate more), are counted where their hashes are made.
    """
    unit = tuple(unit)
    placed = stage(unit_positions(df, unit, seed).withColumn("_base", draw_base(unit, seed)))
    first = placed.select("_count").first()
    n = first[0] if first else 0
    rate = max(0.0, 1.0 - 8.0 / math.sqrt(n)) if rate is None and n else (rate or 0.0)
    cuts, streams = poisson_cuts(rate), np.arange(1, replicates + 1)

    def totals(which: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(which), np.int64)
            for batch in batches:
                base = batch["_base"].to_numpy()
                for at in range(0, len(base), ROWS_PER_BLOCK):
                    for lo in range(0, len(which), STRIP):
                        total[lo:lo + STRIP] += _poisson_matrix(base[at:at + ROWS_PER_BLOCK], which[lo:lo + STRIP], cuts).sum(0).astype(np.int64)
            yield pd.DataFrame({"at": np.arange(len(which)), "total": total})

        out = np.zeros(len(which), np.int64)
        for r in placed.select("_base").mapInPandas(run, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).collect():
            out[r["at"]] = r["total"]
        return out

    drawn = totals(streams) if n else np.zeros(replicates, np.int64)
    while (drawn > n).any():
        again = np.flatnonzero(drawn > n)
        streams[again] += replicates
        drawn[again] = totals(streams[again])
    return ExactDraws(cuts, streams, _extras(placed, unit, streams, n - drawn, n), unit)


def _extras(placed: DataFrame, unit: Sequence[str], streams: np.ndarray, missing: np.ndarray, n: int) -> DataFrame:
    """The further draws of every unit that gets any. A replicate counts its draws over ranges of positions, and what is shuffled are compressed counts of packs of neighbouring
    positions (well below a byte per unit and eight replicates), never a row per draw."""
    spark, replicates = placed.sparkSession, len(streams)
    wide = -(-max(n, 1) // UNITS_PER_COUNT)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job in batch["id"]:
                at, low = job // wide, job % wide * UNITS_PER_COUNT
                held = np.zeros(min(UNITS_PER_COUNT, n - low), np.uint8)
                for first in range(1, int(missing[at]) + 1, 1 << 20):
                    slot = np.arange(first, min(first + (1 << 20), int(missing[at]) + 1))
                    place = np.floor(_draw_hashes(slot, streams[at:at + 1])[:, 0] / 4294967296.0 * n).astype(np.int64) - low
                    where, times = np.unique(place[(place >= 0) & (place < len(held))], return_counts=True)
                    total = held[where] + times
                    if (total > 255).any():
                        raise ValueError("one unit gets more than 255 further draws")
                    held[where] = total
                packs = range(0, len(held), UNITS_PER_PACK)
                found = [(low + p) // UNITS_PER_PACK for p in packs if held[p:p + UNITS_PER_PACK].any()]
                yield pd.DataFrame({"_pack": np.array(found, np.int64), "_at": np.full(len(found), at, np.int32),
                                    "_counts": [zlib.compress(held[k * UNITS_PER_PACK - low:(k + 1) * UNITS_PER_PACK - low].tobytes(), 1) for k in found]})

    def unpack(key, units: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((UNITS_PER_PACK, replicates), np.uint8)
        for at, counts in zip(packs["_at"], packs["_counts"]):
            counts = np.frombuffer(zlib.decompress(counts), np.uint8)
            held[:len(counts), at] = counts
        units = units[held.any(1)[units["_position"].to_numpy() % UNITS_PER_PACK]] if len(units) else units
        mine = held[units["_position"].to_numpy() % UNITS_PER_PACK]
        bits = np.packbits(mine > 0, axis=1)
        row, at = np.nonzero(mine > 1)
        again = mine[row, at].astype(np.int64) - 1
        row, at = np.repeat(row, again), np.repeat(at, again).astype("<u4")
        border = np.searchsorted(row, np.arange(len(mine) + 1))
        return units[list(unit)].assign(_extra=[b.tobytes() + at[border[i]:border[i + 1]].tobytes() for i, b in enumerate(bits)])

    jobs = replicates * wide if missing.any() else 0
    packs = spark.range(0, jobs, 1, max(1, min(jobs, shuffle_width(spark)))).mapInPandas(count, "_pack long, _at int, _counts binary")
    units = placed.select(*unit, "_position", F.floor(F.col("_position") / UNITS_PER_PACK).alias("_pack"))
    schema = T.StructType([*[placed.schema[c] for c in unit], T.StructField("_extra", T.BinaryType())])
    return units.groupBy("_pack").cogroup(packs.groupBy("_pack")).applyInPandas(unpack, schema)


def _extra_counts(extra: Sequence[bytes | None], replicates: int) -> np.ndarray:
    """Further draws (rows x replicates) from their packed form."""
    width = -(-replicates // 8)
    got = [i for i, x in enumerate(extra) if x is not None]
    out = np.zeros((len(extra), replicates), np.uint8)
    if not got:
        return out
    out[got] = np.unpackbits(np.frombuffer(b"".join(bytes(extra[i][:width]) for i in got), np.uint8).reshape(-1, width), axis=1)[:, :replicates]
    row = np.repeat(got, [(len(extra[i]) - width) // 4 for i in got])
    np.add.at(out, (row, np.frombuffer(b"".join(bytes(extra[i][width:]) for i in got), "<u4")), 1)
    return out


def multiplicities(pdf: pd.DataFrame, replicates: int, draws: tuple[tuple[int, ...], np.ndarray] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """The multiplicities of a block's rows, a strip of replicates after the other: first, last (exclusive, from 0), rows x replicates. ``draws``: cuts and streams of exact draws."""
    base, outer = pdf["_base"].to_numpy(), pdf["_outer"].to_numpy() if "_outer" in pdf else None
    cuts, streams = draws or (POISSON_CUTS, np.arange(1, replicates + 1))
    extra = _extra_counts(list(pdf["_extra"]), replicates) if "_extra" in pdf else None
    for lo in range(0, replicates, STRIP):
        hi = min(replicates, lo + STRIP)
        w = _poisson_matrix(base, streams[lo:hi], cuts)
        if outer is not None:
            w *= _poisson_matrix(outer, np.arange(lo + 1, hi + 1))
        if extra is not None:
            w += extra[:, lo:hi]
        yield lo, hi, w


def score_strips(pdf: pd.DataFrame, replicates: int) -> tuple[np.ndarray, Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Distinct scores of a block, rising, and for each strip of replicates the weight and the positives of every score."""
    pdf = pdf.sort_values("_p", kind="stable")
    score, is_pos = pdf["_p"].to_numpy(), (pdf["_y"].to_numpy() == 1).astype(np.float64)[:, None]
    starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])

    def strips():
        for lo, hi, w in multiplicities(pdf, replicates):
            yield lo, hi, np.add.reduceat(w, starts, axis=0), np.add.reduceat(w * is_pos, starts, axis=0)

    return score[starts], strips()


def enough_points(df: DataFrame, y: str, p: str, points: Sequence[float] | None) -> list[float] | None:
    """Given cuts and those that the number of rows asks for: few cuts alone would make pieces that grow with the table."""
    known = known_pairs(df, y, p)
    if points is None or known.count() <= ROWS_PER_BLOCK:
        return points
    return sorted({*map(float, points), *split_points(known, p, ROWS_PER_BLOCK)})


def drawn_rows(df: DataFrame, unit: Sequence[str], y: str = "y", p: str = "p", by: Sequence[str] = (), seed: int = 42, outer: str | None = None, keep: Sequence[str] = (),
               draws: ExactDraws | None = None) -> DataFrame:
    """Known rows: ``by``, ``keep``, ``_p``, ``_y`` and the hash their draws come from (and further exact draws)."""
    cols = [*by, *keep, F.col(p).cast("double").alias("_p"), F.col(y).cast("int").alias("_y"), draw_base(unit, seed).alias("_base")]
    if outer:
        cols.append(draw_base([outer], seed + 1).alias("_outer"))
    known = known_pairs(df, y, p)
    if draws is not None:
        known = known.join(draws.extras, list(draws.unit), "left")
        cols.append("_extra")
    return known.select(*cols)


def score_blocks(df: DataFrame, unit: Sequence[str], y: str = "y", p: str = "p", by: Sequence[str] = (), seed: int = 42, outer: str | None = None,
                 points: Sequence[float] | None = None, keep: Sequence[str] = (), draws: ExactDraws | None = None) -> DataFrame:
    """Rows in blocks of neighbouring scores: ``by``, ``keep``, ``_p``, ``_y``, the hash its draws come from (and further exact draws), the piece of the score axis and a chunk of it.

    A piece holds about ``ROWS_PER_BLOCK`` rows. A score with more rows than that is a piece of its own, which is cut into chunks by its own number of
    rows: inside one score, only sums are needed, so tied scores make more blocks and never a larger one.
    """
    rows = drawn_rows(df, unit, y, p, by, seed, outer, keep, draws)
    if points is None:
        rows = stage(rows)
        points = split_points(rows, "_p", ROWS_PER_BLOCK)
    placed = add_piece(rows, "_p", points)
    sizes = placed.filter(single()).groupBy(PIECE).agg(F.ceil(F.count("*") / F.lit(ROWS_PER_BLOCK)).alias("_chunks"))
    # The partition is part of the chunk, since one unit may hold most rows of a score.
    chunk = F.pmod(F.col("_base") + F.spark_partition_id(), F.col("_chunks"))
    return join_on(placed, sizes, [PIECE], "left").withColumn("_chunk", F.coalesce(chunk, F.lit(0)).cast("long")).drop("_chunks")


def _block_sums(pdf: pd.DataFrame, replicates: int, stratum: str | None = None, strata: Sequence = (None,), draws=None) -> pd.DataFrame:
    """Positives, negatives and inner area of one score block, for every replicate and every stratum of the positives; negatives are not divided."""
    score, kind = pdf["_p"].to_numpy(), pdf["_y"].to_numpy() == 1
    # Class of a row: 0 for negatives, else 1 + its stratum (the last for any other one). Rows are summed once per (score, class).
    width = 2 + len(strata)
    if stratum is None:
        kind = kind.astype(np.int64)
    else:
        code = pd.Categorical(pdf[stratum], categories=list(strata)).codes.astype(np.int64)
        kind = np.where(kind, np.where(code < 0, width - 1, 1 + code), 0)
    order = np.lexsort((kind, score))
    pdf, score, kind = pdf.iloc[order], score[order], kind[order]
    place = np.cumsum(np.r_[True, score[1:] != score[:-1]]) - 1
    cell = place * width + kind
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    out = np.empty((len(strata), 3, replicates))
    for lo, hi, w in multiplicities(pdf, replicates, draws):
        sums = np.zeros(((place[-1] + 1) * width, hi - lo))
        sums[cell[starts]] = np.add.reduceat(w, starts, axis=0)
        sums = sums.reshape(-1, width, hi - lo)
        n = sums[:, 0]
        below = np.cumsum(n, axis=0) - n / 2.0
        for i in range(len(strata)):
            p = sums[:, 1 + i]
            out[i, 0, lo:hi], out[i, 1, lo:hi], out[i, 2, lo:hi] = p.sum(0), n.sum(0), (p * below).sum(0)
    found = {"replicate": np.tile(np.arange(1, replicates + 1), len(strata)), "pos": out[:, 0].ravel(), "neg": out[:, 1].ravel(), "area": out[:, 2].ravel()}
    if stratum is not None:
        found[stratum] = np.repeat(np.array(strata), replicates)
    return pd.DataFrame(found)


def per_block(blocks: DataFrame, by: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], columns: Mapping[str, T.DataType]) -> DataFrame:
    """Runs an array function on every block; what it returns comes with the block's ``by`` and piece. What is shuffled are rows, once, and never replicates of rows."""
    keys = [*by, PIECE]
    schema = T.StructType([*[blocks.schema[k] for k in keys], *[T.StructField(n, t) for n, t in columns.items()]])

    def run(key, pdf):
        out = fn(pdf)
        for name, value in zip(keys, key):
            out[name] = value
        return out[schema.names]

    dealt = blocks.repartition(shuffle_width(blocks.sparkSession), *keys, "_chunk")
    return dealt.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def _pieces(blocks: DataFrame, replicates: int, by: Sequence[str], stratum: str | None = None, strata: Sequence = (None,), draws: ExactDraws | None = None) -> DataFrame:
    """Sums of every (``by``, replicate, stratum, piece)."""
    columns = {"replicate": T.LongType(), "pos": T.DoubleType(), "neg": T.DoubleType(), "area": T.DoubleType()}
    if stratum is not None:
        columns[stratum] = blocks.schema[stratum].dataType
    drawn = draws and (draws.cuts, draws.streams)
    sums = per_block(blocks, by, lambda pdf: _block_sums(pdf, replicates, stratum, strata, drawn), columns)
    return sums.groupBy(*by, "replicate", *([stratum] if stratum else []), PIECE).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.when(single(), F.sum("pos") * F.sum("neg") / 2.0).otherwise(F.sum("area")).alias("area"))


def _few_scores(rows: DataFrame, cells: Sequence[str], replicates: int) -> bool:
    """Whether the sums of all cells of scores fit into a task and are far fewer than rows. Decides on the way only, never on the result."""
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.struct(*cells))).first()
    return distinct * replicates <= SUMS and distinct * ROWS_PER_SCORE <= n


def sums_of_scores(rows: DataFrame, cells: Sequence[str], replicates: int, draws: ExactDraws | None = None) -> DataFrame:
    """Packed draws of all replicates per cell (a score, its label and what else tells rows apart), once for every task: a task adds up its rows where they are and draws each unit of a
    batch once. What is shuffled afterwards depends on tasks and cells, not on rows."""
    cells = list(cells)
    sources = [c for c in ("_base", "_outer", "_extra") if c in rows.columns]
    drawn = draws and (draws.cuts, draws.streams)

    def numbered(pdf: pd.DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = pdf.groupby(list(columns), sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        return code, order, np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[tuple, int] = {}
        total = np.zeros((256, replicates), np.int64)
        for batch in batches:
            if batch.empty:
                continue
            unit, order, starts = numbered(batch, sources)
            units = batch.iloc[order[starts]]
            weight = np.empty((len(units), replicates), np.uint16)
            for lo, hi, w in multiplicities(units, replicates, drawn):
                weight[:, lo:hi] = w
            _, order, starts = numbered(batch, cells)
            sums = np.add.reduceat(weight[unit[order]], starts, axis=0, dtype=np.int64)
            names = [tuple(None if v is None or v != v else v for v in x) for x in batch[cells].iloc[order[starts]].itertuples(index=False, name=None)]
            at = np.array([place.setdefault(x, len(place)) for x in names])
            while len(place) > len(total):
                total = np.concatenate([total, np.zeros_like(total)])
            total[at] += sums
        out = pd.DataFrame([*place], columns=cells, dtype=object)
        out["_sums"] = [zlib.compress(total[i].tobytes(), 1) for i in place.values()]
        yield out

    rows = rows.withColumn("_y", F.when(F.col("_y") == 1, 1).otherwise(0))
    rows = rows.select(*cells, *sources).sortWithinPartitions("_base")  # a unit's rows meet in a batch
    return rows.mapInPandas(run, T.StructType([*[rows.schema[c] for c in cells], T.StructField("_sums", T.BinaryType())]))


def _pieces_of_scores(rows: DataFrame, replicates: int, by: Sequence[str], stratum: str | None = None, strata: Sequence = (None,), draws: ExactDraws | None = None) -> DataFrame:
    """The same sums with a piece per score, for tables with few scores (``sums_of_scores``)."""
    by = list(by)
    cells = [*by, *([stratum] if stratum else []), "_p", "_y"]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pos, neg = np.zeros((len(strata), replicates), np.int64), np.zeros(replicates, np.int64)
        for i, (kind, sums) in enumerate(zip(pdf["_y"], pdf["_sums"])):
            sums = np.frombuffer(zlib.decompress(sums), np.int64)
            if kind != 1:
                neg += sums
            elif stratum is None:
                pos[0] += sums
            elif pdf[stratum].iloc[i] in strata:
                pos[list(strata).index(pdf[stratum].iloc[i])] += sums
        out = pd.DataFrame({"replicate": np.tile(np.arange(1, replicates + 1), len(strata)), "pos": pos.ravel().astype(float), "neg": np.tile(neg, len(strata)).astype(float)})
        for c in by:
            out[c] = pdf[c].iloc[0]
        if stratum is not None:
            out[stratum] = np.repeat(np.array(strata), replicates)
        out[PIECE], out["area"] = pdf["_p"].iloc[0], out["pos"] * out["neg"] / 2.0
        return out[schema.names]

    double, key = T.DoubleType(), [stratum] if stratum else []
    summed = sums_of_scores(rows, cells, replicates, draws)
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("replicate", T.LongType()), *[rows.schema[c] for c in key], *[T.StructField(c, double) for c in (PIECE, "pos", "neg", "area")]])
    return summed.groupBy(*by, "_p").applyInPandas(merge, schema)


def _score_pieces(df: DataFrame, unit: Sequence[str], y: str, p: str, replicates: int, by: Sequence[str], seed: int, outer: str | None, points: Sequence[float] | None,
                  stratum: str | None = None, strata: Sequence = (None,), draws: ExactDraws | None = None) -> DataFrame:
    """Sums of every (``by``, replicate, stratum, piece): per score where there are few scores and no cuts are given, else in blocks of neighbouring scores."""
    keep = [stratum] if stratum else []
    if points is None:
        plain = known_pairs(df, y, p)
        if _few_scores(plain, [*by, *keep, y, p], replicates):
            return _pieces_of_scores(drawn_rows(df, unit, y, p, by, seed, outer, keep, draws), replicates, by, stratum, strata, draws)
    return _pieces(score_blocks(df, unit, y, p, by, seed, outer, points, keep, draws), replicates, by, stratum, strata, draws)


def bootstrap_auroc(df: DataFrame, unit: Sequence[str] = ("entity",), y: str = "y", p: str = "p", replicates: int = 500,
                    by: Sequence[str] = (), seed: int = 42, outer: str | None = None,
                    points: Sequence[float] | None = None, draws: ExactDraws | None = None) -> DataFrame:
    """AUROC of every replicate and group; replicates with one class give NULL. With ``draws`` (of the same unit and seed) every replicate has exactly as many units as there are.

    Where there are few scores, tasks add up their rows per score and nothing else is shuffled. Otherwise
    rows are shuffled once, into blocks of neighbouring scores; each block computes all replicates with array
    arithmetic and returns one row per replicate, so the shuffle does not grow with the number of replicates.
    Inside one score the area is ``pos * neg / 2``, which needs only the sums.
    """
    by = list(by)
    pieces = _score_pieces(df, unit, y, p, replicates, by, seed, outer, points, draws=draws)
    return auroc_from_pieces(pieces, [*by, "replicate"]).select(*by, "replicate", "n_pos", "n_neg", "auroc")


def _precision_steps(rows: pd.DataFrame, above: pd.DataFrame, replicates: int) -> pd.DataFrame:
    """Sum over the scores of one piece of (positives at the score) x (precision from the score up), given what stands in the pieces above."""
    if rows.empty:
        return pd.DataFrame({"replicate": np.zeros(0, np.int64), "step": np.zeros(0)})
    rows = rows.sort_values("_p", kind="stable")
    score, is_pos = rows["_p"].to_numpy(), (rows["_y"].to_numpy() == 1).astype(np.float64)[:, None]
    starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    carried = np.zeros((2, replicates))
    at = above["replicate"].to_numpy() - 1
    carried[0, at], carried[1, at] = above["tp"], above["fp"]
    step = np.empty(replicates)
    for lo, hi, w in multiplicities(rows, replicates):
        p, n = np.add.reduceat(w * is_pos, starts, axis=0), np.add.reduceat(w, starts, axis=0)
        tp, all_ = (np.cumsum(x[::-1], axis=0)[::-1] for x in (p, n))
        tp = tp + carried[0, lo:hi]
        all_ = all_ + carried[:, lo:hi].sum(0)
        step[lo:hi] = (p * tp / np.maximum(all_, 1.0)).sum(0)
    return pd.DataFrame({"replicate": np.arange(1, replicates + 1), "step": step})


def bootstrap_discrimination(df: DataFrame, unit: Sequence[str] = ("entity",), y: str = "y", p: str = "p", replicates: int = 500, by: Sequence[str] = (),
                             seed: int = 42, outer: str | None = None, points: Sequence[float] | None = None) -> DataFrame:
    """AUROC, average precision, prevalence and lift of every replicate and group; ties are taken together.

    Two passes over score blocks. The first gives the positives and negatives of every (block, replicate). Their running totals from the top
    enter the second, which sums the steps of precision inside each block. A score that is a piece of its own needs its totals only. What is shuffled are
    the rows, once for each pass, and (blocks x replicates) sums.
    """
    by = list(by)
    blocks = stage(score_blocks(df, unit, y, p, by, seed, outer, enough_points(df, y, p, points)))
    pieces = stage(_pieces(blocks, replicates, by))
    higher = Window.partitionBy(*by, "replicate").orderBy(F.desc(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(*by, "replicate", PIECE, "pos", "neg", *[F.coalesce(F.sum(c).over(higher), F.lit(0.0)).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))])
    tp = F.col("tp") + F.col("pos")
    tied = placed.filter(single()).select(*by, "replicate", F.coalesce(safe_divide(F.col("pos") * tp, tp + F.col("fp") + F.col("neg")), F.lit(0.0)).alias("step"))
    keys = [*by, PIECE]
    schema = T.StructType([*[blocks.schema[k] for k in by], T.StructField("replicate", T.LongType()), T.StructField("step", T.DoubleType())])

    def run(key, rows, above):
        out = _precision_steps(rows, above, replicates)
        for name, value in zip(keys, key):
            out[name] = value
        return out[schema.names]

    wide = blocks.filter(~single()).groupBy(*keys).cogroup(placed.filter(~single()).select(*keys, "replicate", "tp", "fp").groupBy(*keys)).applyInPandas(run, schema)
    steps = tied.unionByName(wide).groupBy(*by, "replicate").agg(F.sum("step").alias("_step"))
    out = join_on(auroc_from_pieces(pieces, [*by, "replicate"]), steps, [*by, "replicate"])
    prevalence = safe_divide(F.col("n_pos"), F.col("n_pos") + F.col("n_neg"))
    auprc = safe_divide(F.col("_step"), F.col("n_pos"))
    return out.select("replicate", *by, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), "auroc", auprc.alias("auprc"), prevalence.alias("prevalence"),
                      safe_divide(auprc, prevalence).alias("lift"))


def bootstrap_areas(df: DataFrame, unit: Sequence[str], stratum: str, strata: Sequence, y: str = "y", p: str = "p", replicates: int = 500, by: Sequence[str] = (),
                    seed: int = 42, points: Sequence[float] | None = None) -> DataFrame:
    """``n_pos`` and ``area`` over all negatives of every (``by``, replicate, stratum of the positives), with ``n_neg``.

    The area counts (positive, lower negative) pairs, ties by half. It is linear in the weights of the strata, so the AUROC under any weighting of them
    follows from these few rows, without weighted score tables.
    """
    keys = [*by, "replicate", stratum]
    pieces = _score_pieces(df, unit, y, p, replicates, list(by), seed, None, points, stratum, strata)
    out = auroc_from_pieces(pieces, keys)
    return out.select(*keys, "n_pos", "n_neg", F.coalesce(F.col("auroc") * F.col("n_pos") * F.col("n_neg"), F.lit(0.0)).alias("area"))


def interval(replicates: DataFrame, value: str = "auroc", by: Sequence[str] = (), lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval over the replicates (a bounded number per group); NULL replicates are dropped."""
    out = replicates.groupBy(*by).agg(
        F.count(value).alias("n_valid"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"),
        F.percentile(value, [lo, hi]).alias("_q"))
    return out.select(*by, "n_valid", "mean", "se", F.element_at("_q", 1).alias("lo"), F.element_at("_q", 2).alias("hi"))


def difference(left: DataFrame, right: DataFrame, by: Sequence[str] = (), value: str = "auroc") -> DataFrame:
    """Per-replicate difference right - left on the same replicate numbers."""
    keys = [*by, "replicate"]
    a = left.select(*keys, F.col(value).alias("_a"))
    b = right.select(*keys, F.col(value).alias("_b"))
    return join_on(a, b, keys).select(*keys, (F.col("_b") - F.col("_a")).alias("delta"))


def difference_test(deltas: DataFrame, by: Sequence[str] = (), value: str = "delta") -> DataFrame:
    """Mean difference, 95 % interval and ``2 min(P(d <= 0), P(d >= 0))``."""
    d = F.col(value)
    tails = deltas.filter(d.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_valid"), F.avg(d).alias("delta"), F.percentile(d, [0.025, 0.975]).alias("_q"),
        F.avg(F.when(d <= 0, 1.0).otherwise(0.0)).alias("_le"), F.avg(F.when(d >= 0, 1.0).otherwise(0.0)).alias("_ge"))
    return tails.select(*by, "n_valid", "delta", F.element_at("_q", 1).alias("lo"), F.element_at("_q", 2).alias("hi"),
                        (F.least("_le", "_ge") * 2.0).alias("p_value"))


def equivalence(deltas: DataFrame, observed: DataFrame | None = None, margin: float = 0.05, by: Sequence[str] = (),
                value: str = "delta") -> DataFrame:
    """Two one-sided tests from replicates: 90 % and 95 % intervals, tail shares and the smallest symmetric margin."""
    by = list(by)
    d = F.col(value)
    out = deltas.filter(d.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_valid"), F.stddev_samp(d).alias("se"), F.percentile(d, [0.05, 0.95, 0.025, 0.975]).alias("_q"),
        F.avg(F.when(d <= -margin, 1.0).otherwise(0.0)).alias("p_lower"),
        F.avg(F.when(d >= margin, 1.0).otherwise(0.0)).alias("p_upper"))
    names = ["lo90", "hi90", "lo95", "hi95"]
    out = out.select("*", *[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(names)]).drop("_q")
    out = (out.withColumn("p_tost", F.greatest("p_lower", "p_upper"))
           .withColumn("equivalent", F.when((F.col("lo90") > -margin) & (F.col("hi90") < margin), 1).otherwise(0))
           .withColumn("min_margin", F.greatest(F.abs("lo90"), F.abs("hi90"))))
    return out if observed is None else join_on(out, observed, by)
