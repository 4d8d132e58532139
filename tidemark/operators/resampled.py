"""Metrics under resampling that need more than a plain AUROC: proximity standardisation and calibration replicates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.numeric import logit, recalibrate, safe_divide
from tidemark.operators.bootstrap import STRIP, bootstrap_areas, drawn_rows, enough_points, _few_scores, per_block, score_blocks, score_strips, single, sums_of_scores
from tidemark.operators.calibration import NEWTON_STEPS
from tidemark.operators.discrimination import auroc_from_counts, known_pairs
from tidemark.operators.ordered import PIECE, join_on
from tidemark.operators.timeline import spread_back
from tidemark.session import shuffle_width, stage

BIN_LABELS = ("0", "6", "12-18", ">=24")
ROWS_PER_STEP = 50_000


def reach_back_bin(df: DataFrame, entity: Sequence[str], t: str = "t_hr", by: Sequence[str] = ()) -> DataFrame:
    """Hours from a checkpoint to the entity's last one, in the classes 0, 6, 12-18 and 24 or more."""
    back = spread_back(df, [*by, *entity], {"_last": F.max(t)}).withColumn("_back", F.col("_last") - F.col(t))
    d = F.col("_back")
    return back.withColumn("bin", F.when(d <= 0, 0).when(d <= 6, 1).when(d <= 18, 2).otherwise(3)).drop("_last", "_back")


def positive_shares(rows: DataFrame, pos: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of the positives per distance bin."""
    per = rows.groupBy(*by, "bin").agg(F.sum(pos).alias("_p"))
    total = per.groupBy(*by).agg(F.sum("_p").alias("_t"))
    return join_on(per, total, list(by)).select(*by, "bin", safe_divide(F.col("_p"), F.col("_t")).alias("share"))


def standardised_counts(counts: DataFrame, target: DataFrame, by: Sequence[str] = (), p: str = "p") -> DataFrame:
    """Scores with positives re-weighted so that their bin mix equals the target shares; negatives keep weight 1.

    ``counts`` has ``bin``, ``pos``, ``neg`` per score; ``target`` has ``bin`` and ``share``.
    """
    by = list(by)
    own = positive_shares(counts, F.col("pos"), by).withColumnRenamed("share", "_own")
    wanted = target.select(*[c for c in by if c in target.columns], "bin", F.col("share").alias("_want"))
    keys = [c for c in by if c in target.columns]
    weights = join_on(own, wanted, [*keys, "bin"], "left")
    weights = weights.select(*by, "bin", F.when(F.col("_own") > 0, F.coalesce("_want", F.lit(0.0)) / F.col("_own")).otherwise(F.lit(1.0)).alias("_w"))
    weighted = join_on(counts, weights, [*by, "bin"])
    return weighted.groupBy(*by, p).agg(F.sum(F.col("pos") * F.col("_w")).alias("pos"), F.sum("neg").alias("neg"))


def proximity_point(df: DataFrame, entity: Sequence[str], target_endpoint, endpoint: str = "endpoint", y: str = "y", p: str = "p") -> DataFrame:
    """Raw and proximity-standardised AUROC of every endpoint against one target endpoint's bin mix."""
    rows = reach_back_bin(df, entity, by=[endpoint])
    counts = stage(rows.groupBy(endpoint, "bin", p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg")))
    target = positive_shares(counts.filter(F.col(endpoint) == target_endpoint), F.col("pos"))
    std = auroc_from_counts(standardised_counts(counts, target, [endpoint], p), p, [endpoint]).select(endpoint, F.col("auroc").alias("standardised"))
    whole = counts.groupBy(endpoint, p).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    raw = auroc_from_counts(whole, p, [endpoint]).select(endpoint, F.col("auroc").alias("raw"))
    return join_on(raw, std, [endpoint])


def proximity_by_bin(df: DataFrame, entity: Sequence[str], by: Sequence[str] = (), y: str = "y", p: str = "p", min_pos: int = 10) -> DataFrame:
    """AUROC of the positives of one distance bin against all negatives.

    Negatives are needed in every bin, so score counts (not rows) are repeated over the four bins.
    """
    by = list(by)
    counts = stage(reach_back_bin(df, entity, by=by).groupBy(*by, "bin", p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg")))
    positives = counts.select(*by, "bin", p, "pos", F.lit(0).cast("long").alias("neg"))
    negatives = counts.groupBy(*by, p).agg(F.sum("neg").alias("neg")).select(
        *by, F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("bin"), p, F.lit(0).cast("long").alias("pos"), "neg")
    both = positives.unionByName(negatives).groupBy(*by, "bin", p).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    out = auroc_from_counts(both, p, [*by, "bin"])
    return out.select(*by, "bin", "n_pos", F.when(F.col("n_pos") >= min_pos, F.col("auroc")).alias("auroc"))


def proximity_replicates(df: DataFrame, entity: Sequence[str], target_endpoint, replicates: int, endpoint: str = "endpoint", y: str = "y", p: str = "p",
                         seed: int = 42) -> DataFrame:
    """Per replicate: target AUROC minus the standardised AUROC of each other endpoint, on the same draws.

    The areas of the positives of every distance bin are all that is kept of a replicate; re-weighting the bins is arithmetic on four of them.
    """
    keys = [endpoint, "replicate"]
    bins = range(len(BIN_LABELS))
    areas = stage(bootstrap_areas(reach_back_bin(df, entity, by=[endpoint]), entity, "bin", list(bins), y, p, replicates, [endpoint], seed))
    total = F.sum("n_pos").over(Window.partitionBy(*keys))
    shares = areas.withColumn("_share", safe_divide(F.col("n_pos"), total))
    wanted = shares.filter(F.col(endpoint) == target_endpoint).select("replicate", "bin", F.col("_share").alias("_want"))
    weight = F.when(F.col("_share") > 0, F.coalesce("_want", F.lit(0.0)) / F.col("_share")).otherwise(F.lit(0.0))
    weighted = shares.join(wanted, ["replicate", "bin"], "left").withColumn("_w", weight)
    std = weighted.groupBy(*keys).agg(safe_divide(F.sum(F.col("_w") * F.col("area")), F.sum(F.col("_w") * F.col("n_pos")) * F.max("n_neg")).alias("auroc"))
    target = std.filter(F.col(endpoint) == target_endpoint).select("replicate", F.col("auroc").alias("_t"))
    others = std.filter(F.col(endpoint) != target_endpoint)
    return join_on(others, target, ["replicate"]).select("replicate", endpoint, F.col("auroc").alias("standardised"), (F.col("_t") - F.col("auroc")).alias("delta"))


# ---------------------------------------------------------------- calibration of all replicates

def _moments(pdf: pd.DataFrame, replicates: int) -> pd.DataFrame:
    """Weight, positives and squared error of one block for every replicate, and its lowest score."""
    score, strips = score_strips(pdf, replicates)
    out = np.empty((3, replicates))
    for lo, hi, n, pos in strips:
        out[:, lo:hi] = n.sum(0), pos.sum(0), (1.0 - score) ** 2 @ pos + score ** 2 @ (n - pos)
    return pd.DataFrame({"replicate": np.arange(1, replicates + 1), "n": out[0], "pos": out[1], "sq": out[2], "score": score[0]})


def _order_statistics(rows: pd.DataFrame, before: pd.DataFrame, replicates: int, bins: int) -> pd.DataFrame:
    """Scores at the ranks that bin edges need (from 0, two for each edge), as far as they lie in this piece, given the weight before it and in all."""
    if rows.empty:
        return pd.DataFrame({"replicate": np.zeros(0, np.int64), "rank": np.zeros(0, np.int32), "value": np.zeros(0)})
    score, strips = score_strips(rows, replicates)
    before = before.sort_values("replicate")
    below, total = before["below"].to_numpy(), before["total"].to_numpy()
    at = np.arange(bins + 1)[:, None] / bins * (total - 1.0)
    wanted = np.stack([np.floor(at), np.ceil(at)], 1).reshape(2 * (bins + 1), -1) - below
    found = []
    for lo, hi, n, _ in strips:
        so_far = np.cumsum(n, axis=0)
        for r in range(lo, hi):
            held = np.flatnonzero((wanted[:, r] >= 0) & (wanted[:, r] < so_far[-1, r - lo]))
            found.append((np.full(len(held), r + 1), held, score[np.searchsorted(so_far[:, r - lo], wanted[held, r], "right")]))
    replicate, rank, value = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"replicate": replicate, "rank": rank.astype(np.int32), "value": value})


def _bin_sums(pdf: pd.DataFrame, replicates: int, edges: list[np.ndarray]) -> pd.DataFrame:
    """Weight, sum of scores and positives of every (replicate, bin) in one block."""
    score, strips = score_strips(pdf, replicates)
    found = []
    for lo, hi, n, pos in strips:
        sums = np.zeros((3, len(score) + 1, hi - lo))
        for i, figure in enumerate((n, n * score[:, None], pos)):
            np.cumsum(figure, axis=0, out=sums[i, 1:])
        for r in range(lo, hi):
            e = edges[r]
            if not len(e):
                continue
            border = np.r_[0, np.searchsorted(score, e[1:-1], "right"), len(score)]
            part = np.diff(sums[:, border, r - lo], axis=1)
            held = np.flatnonzero(part[0] > 0)
            found.append(np.stack([np.full(len(held), r + 1.0), held, *part[:, held]]))
    out = np.concatenate(found, axis=1) if found else np.zeros((5, 0))
    return pd.DataFrame({"replicate": out[0].astype(np.int64), "bin": out[1].astype(np.int32), "n": out[2], "predicted": out[3], "observed": out[4]})


def _newton_sums(pdf: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gradient (2) and curvature (3) of the layer of every replicate, at its own parameters."""
    z, strips = score_strips(pdf, len(a))
    powers = np.stack([np.ones(len(z)), z, z * z])
    out = np.empty((5, len(a)))
    for lo, hi, n, pos in strips:
        mu = 1.0 / (1.0 + np.exp(-(a[lo:hi] + z[:, None] * b[lo:hi])))
        out[:2, lo:hi] = powers[:2] @ (pos - n * mu)
        out[2:, lo:hi] = powers @ (n * mu * (1.0 - mu))
    return out


def _newton_start(rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = (rate > 0) & (rate < 1)
    start = np.where(known, rate, 0.5)
    return np.where(known, np.log(start / (1 - start)), np.nan), np.zeros(len(rate))


def _newton_move(g0: np.ndarray, g1: np.ndarray, h0: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        det = h0 * h2 - h1 * h1
        det = np.where(det == 0, np.nan, det)
        return (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det


def replicate_layers(rows: DataFrame, rate: np.ndarray, steps: int = NEWTON_STEPS, near: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Intercept and slope of the recalibration layer of every replicate.

    ``rows`` has ``_p`` (logits), ``_y`` and the hashes of the draws; ``rate`` is the share of positives per replicate. A step is one scan: tasks multiply their scores by
    the draws of all replicates and give back five sums for each of them. Nothing is shuffled but these, and the driver holds two numbers per replicate. Steps end
    early once no replicate moves by more than ``near``.
    """
    a, b = _newton_start(rate)
    names = ("g0", "g1", "h0", "h1", "h2")
    for _ in range(steps):
        def run(batches: Iterator[pd.DataFrame], a=a, b=b) -> Iterator[pd.DataFrame]:
            total = np.zeros((5, len(a)))
            for batch in batches:
                for lo in range(0, len(batch), ROWS_PER_STEP):
                    total += _newton_sums(batch.iloc[lo:lo + ROWS_PER_STEP], a, b)
            yield pd.DataFrame({"replicate": np.arange(len(a), dtype=np.int32), **dict(zip(names, total, strict=True))})

        sums = rows.mapInPandas(run, "replicate int, " + ", ".join(f"{c} double" for c in names)).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        g0, g1, h0, h1, h2 = (sums.sort_values("replicate")[c].to_numpy() for c in names)
        da, db = _newton_move(g0, g1, h0, h1, h2)
        a, b = a + da, b + db
        if not (np.nan_to_num(np.abs(da) + np.abs(db)) > near).any():
            break
    return a, b


def _figures(score: np.ndarray, n: np.ndarray, pos: np.ndarray, bins: int) -> dict[str, np.ndarray]:
    """Weight, positives, squared error and calibration error of every replicate (scores x replicates)."""
    order = np.argsort(score, kind="stable")
    score = score[order]
    starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    score, n, pos = score[starts], np.add.reduceat(n[order], starts, axis=0), np.add.reduceat(pos[order], starts, axis=0)
    upto, total = np.cumsum(n, axis=0), n.sum(0)
    sums = np.stack([np.concatenate([np.zeros((1, n.shape[1])), np.cumsum(x, axis=0)]) for x in (n, n * score[:, None], pos)])
    ece = np.full(n.shape[1], np.nan)
    for r in np.flatnonzero(total > 0):
        at = np.arange(bins + 1) / bins * (total[r] - 1.0)
        low, high = (score[np.searchsorted(upto[:, r], x, "right")] for x in (np.floor(at), np.ceil(at)))
        edges = np.array(list(dict.fromkeys(low + (high - low) * (at - np.floor(at)))))
        border = np.r_[0, np.searchsorted(score, edges[1:-1], "right"), len(score)]
        held, predicted, observed = np.diff(sums[:, border, r], axis=1)
        ece[r] = np.abs(predicted - observed)[held > 0].sum() / total[r]
    return {"n": total, "pos": pos.sum(0), "sq": (1.0 - score) ** 2 @ pos + score ** 2 @ (n - pos), "ece": ece}


def _layer_slopes(z: np.ndarray, n: np.ndarray, pos: np.ndarray, steps: int, near: float = 1e-10) -> np.ndarray:
    """Slopes of the recalibration layers of every replicate (logits x replicates)."""
    total = n.sum(0)
    a, b = _newton_start(np.divide(pos.sum(0), total, out=np.full(len(total), np.nan), where=total > 0))
    powers = np.stack([np.ones(len(z)), z, z * z])
    for _ in range(steps):
        mu = 1.0 / (1.0 + np.exp(-(a + z[:, None] * b)))
        da, db = _newton_move(*(powers[:2] @ (pos - n * mu)), *(powers @ (n * mu * (1.0 - mu))))
        a, b = a + da, b + db
        if not (np.nan_to_num(np.abs(da) + np.abs(db)) > near).any():
            break
    return b


def _calibration_by_score(rows: DataFrame, replicates: int, intercept: float, slope: float, steps: int, bins: int) -> DataFrame:
    """The figures of all replicates from sums per score, for tables with few scores. Rows are drawn once and never shuffled; then a task holds the sums of all scores for a strip of replicates."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, pos = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
        for kind, sums in zip(pdf["_y"], pdf["_sums"]):
            sums = np.frombuffer(zlib.decompress(sums), np.int64)
            n += sums
            if kind == 1:
                pos += sums
        lows = range(0, replicates, STRIP)
        return pd.DataFrame({"_p": pdf["_p"].iloc[0], "_low": np.array(lows, np.int32), "_n": [n[lo:lo + STRIP].tobytes() for lo in lows], "_pos": [pos[lo:lo + STRIP].tobytes() for lo in lows]})

    def figures(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, pos = (np.frombuffer(b"".join(map(bytes, pdf[c])), np.int64).reshape(len(pdf), -1).astype(np.float64) for c in ("_n", "_pos"))
        layers = _layer_slopes(pdf["_z"].to_numpy(), n, pos, steps)
        parts = [pd.DataFrame({"replicate": np.arange(key[0] + 1, key[0] + 1 + n.shape[1]), "version": version, **_figures(pdf[score].to_numpy(), n, pos, bins), "slope": layers / scale})
                 for version, score, scale in (("raw", "_p", 1.0), ("recalibrated", "_r", slope if slope else np.nan))]
        return pd.concat(parts)

    merged = sums_of_scores(rows, ["_p", "_y"], replicates).groupBy("_p").applyInPandas(merge, "_p double, _low int, _n binary, _pos binary")
    scored = merged.select("_p", logit("_p").alias("_z"), recalibrate("_p", intercept, slope).alias("_r"), "_low", "_n", "_pos")
    return scored.groupBy("_low").applyInPandas(figures, "replicate long, version string, n double, pos double, sq double, ece double, slope double")


def calibration_replicates(df: DataFrame, entity: Sequence[str], replicates: int, intercept: float, slope: float, y: str = "y", p: str = "p",
                           seed: int = 42, steps: int = NEWTON_STEPS, bins: int = 10, points: Sequence[float] | None = None) -> DataFrame:
    """Slope, calibration error, Brier score and skill, raw and recalibrated, for every replicate.

    Works on blocks of neighbouring scores, whose rows are shuffled and never multiplied. Moments come from matrix products per block. Quantile edges are ranks: running weights of the blocks
    say in which block a rank of a replicate lies, and that block looks up its score. Bin sums and Newton steps then take the edges and parameters of all replicates to the blocks; the driver
    holds a few numbers per replicate. Where there are few scores, rows are drawn once and summed per score instead, and all figures come from these sums; given cuts (``points``) are for
    blocks only and decide on nothing but the way.
    """
    known = known_pairs(df, y, p)
    if _few_scores(known, [y, p], replicates):
        return _replicate_figures(_calibration_by_score(drawn_rows(known, entity, y, p, seed=seed), replicates, intercept, slope, steps, bins))
    versions = F.array(F.struct(F.lit("raw").alias("version"), F.col(p).cast("double").alias("score")),
                       F.struct(F.lit("recalibrated").alias("version"), recalibrate(p, intercept, slope).alias("score")))
    by = ["version"]
    rows = known.select(*entity, y, F.inline(versions))
    blocks = score_blocks(rows, entity, y, "score", by, seed, None, enough_points(rows, y, "score", points))
    blocks = stage(blocks.repartition(shuffle_width(df.sparkSession)))  # steps are arithmetic over few bytes
    long, double = T.LongType(), T.DoubleType()
    sums = per_block(blocks, by, lambda pdf: _moments(pdf, replicates), {"replicate": long, "n": double, "pos": double, "sq": double, "score": double})
    pieces = stage(sums.groupBy(*by, "replicate", PIECE).agg(*[F.sum(c).alias(c) for c in ("n", "pos", "sq")], F.min("score").alias("score")))
    whole = Window.partitionBy(*by, "replicate")
    before = whole.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(*by, "replicate", PIECE, "n", "score", F.coalesce(F.sum("n").over(before), F.lit(0.0)).alias("below"), F.sum("n").over(whole).alias("total"))

    ranks = F.array(*[x for i in range(bins + 1) for x in (F.floor(F.lit(i / bins) * (F.col("total") - 1)), F.ceil(F.lit(i / bins) * (F.col("total") - 1)))])
    tied = placed.filter(single()).filter("n > 0").select(*by, "replicate", "score", "below", "n", F.posexplode(ranks).alias("rank", "_at"))
    tied = tied.filter((F.col("_at") >= F.col("below")) & (F.col("_at") < F.col("below") + F.col("n"))).select(*by, "replicate", "rank", F.col("score").alias("value"))
    keys = [*by, PIECE]

    def run(key, rows, at):
        return _order_statistics(rows, at, replicates, bins).assign(version=key[0])[["version", "replicate", "rank", "value"]]

    wide = blocks.filter(~single()).groupBy(*keys).cogroup(placed.filter(~single()).select(*keys, "replicate", "below", "total").groupBy(*keys)).applyInPandas(run, "version string, replicate long, rank int, value double")
    moments = pieces.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "sq")]).toPandas()
    values = tied.unionByName(wide).toPandas()  # two numbers per edge and replicate
    edges = {name: [np.zeros(0)] * replicates for name in set(moments["version"])}
    totals = moments.set_index(["version", "replicate"])["n"]
    for (name, r), part in values.groupby(["version", "replicate"]):
        at = np.arange(bins + 1) / bins * (totals[name, r] - 1)
        low, high = part.sort_values("rank")["value"].to_numpy().reshape(bins + 1, 2).T
        edges[name][r - 1] = np.array(list(dict.fromkeys(low + (high - low) * (at - np.floor(at)))))

    columns = {"replicate": long, "bin": T.IntegerType(), "n": double, "predicted": double, "observed": double}
    binned = per_block(blocks, by, lambda pdf: _bin_sums(pdf, replicates, edges[pdf["version"].iloc[0]]), columns).groupBy(*by, "replicate", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "predicted", "observed")])
    errors = binned.groupBy(*by, "replicate").agg((F.sum(F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece")).toPandas()

    # The recalibrated logit is a line in the raw one, so its layers follow from the raw ones.
    raw = moments[moments["version"] == "raw"].sort_values("replicate")
    rate = (raw["pos"] / raw["n"].where(raw["n"] > 0)).to_numpy()
    layers = replicate_layers(blocks.filter("version = 'raw'").select(logit("_p").alias("_p"), "_y", "_base"), rate, steps)[1] if len(raw) else np.zeros(0)
    scale = {"raw": 1.0, "recalibrated": slope if slope else np.nan}
    out = moments.merge(errors, on=["version", "replicate"], how="left")
    out["slope"] = [layers[r - 1] / scale[v] for v, r in zip(out["version"], out["replicate"], strict=True)]
    out = df.sparkSession.createDataFrame(out.astype(object).where(out.notna(), None), "version string, replicate long, n double, pos double, sq double, ece double, slope double")
    return _replicate_figures(out)


def _replicate_figures(out: DataFrame) -> DataFrame:
    prevalence = safe_divide(F.col("pos"), F.col("n"))
    null, error = prevalence * (1 - prevalence), safe_divide(F.col("sq"), F.col("n"))
    return out.select("replicate", "version", F.col("n").cast("long").alias("n"), error.alias("brier"), prevalence.alias("prevalence"), null.alias("brier_null"), (1 - safe_divide(error, null)).alias("skill"), "ece", "slope")
