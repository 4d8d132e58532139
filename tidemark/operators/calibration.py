"""Agreement between predicted and observed risk: Brier, bins, slopes, recalibration layers, net benefit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import logit, safe_divide, sigmoid
from tidemark.operators.discrimination import known_pairs, threshold_counts
from tidemark.operators.ordered import bin_edges, bin_number, few_groups, join_groups, join_on
from tidemark.operators.sampling import exact_halves
from tidemark.session import stage

NEWTON_STEPS = 8
#: Entries of the arrays (scores x layers) that a task works on at a time.
CELLS = 4_000_000


def score_counts(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per (``by``, score): rows ``n`` and positives ``pos``. Everything below works on this table."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    return known_pairs(df, y, p).groupBy(*by, p).agg(
        F.sum(w).alias("n"), F.sum(F.when(F.col(y) == 1, w).otherwise(w * 0)).alias("pos"))


def brier(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Brier score, its null value ``prev (1 - prev)`` and the skill score."""
    w = F.lit(1) if weight is None else F.col(weight)
    err = F.col(p) - F.col(y)
    out = known_pairs(df, y, p).groupBy(*by).agg(
        F.sum(w).cast("long").alias("n"), (F.sum(w * err * err) / F.sum(w)).alias("brier"),
        (F.sum(w * F.col(y)) / F.sum(w)).alias("prevalence"))
    null = F.col("prevalence") * (1 - F.col("prevalence"))
    return out.withColumn("brier_null", null).withColumn("skill", 1 - safe_divide(F.col("brier"), null))


def calibration_curve(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), bins: int = 10,
                      weight: str | None = None, points: Sequence[float] | None = None) -> DataFrame:
    """Mean predicted and observed risk per quantile bin of the score."""
    by = list(by)
    counts = score_counts(df, y, p, by, weight)
    if weight is not None:
        counts = counts.filter(F.col("n") > 0)
    counts = stage(counts)
    edges = bin_edges(counts, p, bins, by, weight="n", points=points)
    binned = join_groups(counts, edges, by).withColumn("bin", bin_number(p))
    return binned.groupBy(*by, "bin").agg(
        F.sum("n").cast("long").alias("n"), F.sum("pos").cast("long").alias("n_pos"),
        (F.sum(F.col(p) * F.col("n")) / F.sum("n")).alias("predicted"),
        (F.sum("pos") / F.sum("n")).alias("observed"))


def calibration_error(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), bins: int = 10,
                      weighted: bool = True, weight: str | None = None, points: Sequence[float] | None = None) -> DataFrame:
    """Expected calibration error over quantile bins, weighted by bin size or as a plain mean over bins."""
    table = calibration_curve(df, y, p, by, bins, weight, points)
    gap = F.abs(F.col("observed") - F.col("predicted"))
    value = F.sum(F.col("n") * gap) / F.sum("n") if weighted else F.avg(gap)
    return table.groupBy(*by).agg(F.count("*").alias("n_bins"), value.alias("ece"))


def fit_layer(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), eps: float = 1e-12,
              steps: int = NEWTON_STEPS, weight: str | None = None, staged: bool = True) -> DataFrame:
    """Logistic regression of the label on the logit of the score, for all groups at once.

    Newton's method on grouped counts: every step is one aggregate of five sums per group over the staged score
    table, so the work per step is a scan with map-side combine and the parameters stay one row per group.
    """
    counts = score_counts(df, y, p, by, weight).select(*by, logit(p, eps).alias("_z"), "n", "pos")
    return fit_counts(stage(counts) if staged else counts, by, steps)


def fit_counts(counts: DataFrame, by: Sequence[str] = (), steps: int = NEWTON_STEPS) -> DataFrame:
    """Newton steps on rows (``by``, ``_z``, ``n``, ``pos``); returns intercept ``a`` and slope ``b`` per group."""
    by = list(by)
    rate = F.sum("pos") / F.sum("n")
    params = counts.groupBy(*by).agg(
        F.sum("n").cast("long").alias("n_rows"), F.sum("pos").cast("long").alias("n_pos"),
        F.when((rate > 0) & (rate < 1), F.log(rate / (1 - rate))).alias("a"), F.lit(0.0).alias("b"))
    few = few_groups(params)  # a shuffle by few groups would leave each group's scores to one task
    for _ in range(steps):
        at = join_on(counts, F.broadcast(params) if few else params, by)
        mu = sigmoid(F.col("a") + F.col("b") * F.col("_z"))
        z, r, w = F.col("_z"), F.col("pos") - F.col("n") * mu, F.col("n") * mu * (1 - mu)
        sums = at.groupBy(*by).agg(
            F.max("n_rows").alias("n_rows"), F.max("n_pos").alias("n_pos"), F.max("a").alias("a"), F.max("b").alias("b"),
            F.sum(r).alias("_g0"), F.sum(r * z).alias("_g1"),
            F.sum(w).alias("_h0"), F.sum(w * z).alias("_h1"), F.sum(w * z * z).alias("_h2"))
        det = F.col("_h0") * F.col("_h2") - F.col("_h1") * F.col("_h1")
        da = safe_divide(F.col("_h2") * F.col("_g0") - F.col("_h1") * F.col("_g1"), det)
        db = safe_divide(F.col("_h0") * F.col("_g1") - F.col("_h1") * F.col("_g0"), det)
        params = sums.select(*by, "n_rows", "n_pos", (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"))
    return params


def apply_layer(df: DataFrame, layer: DataFrame, p: str = "p", by: Sequence[str] = (), name: str = "p_rec",
                eps: float = 1e-12) -> DataFrame:
    """Recalibrated score from a layer table with one row per group."""
    joined = join_groups(df, layer.select(*by, F.col("a").alias("_a"), F.col("b").alias("_b")), list(by))
    return joined.withColumn(name, sigmoid(F.col("_a") + F.col("_b") * logit(p, eps))).drop("_a", "_b")


def held_out_layers(df: DataFrame, fold: str, y: str = "y", p: str = "p", by: Sequence[str] = (), eps: float = 1e-12,
                    steps: int = NEWTON_STEPS) -> DataFrame:
    """One layer per left-out fold (site or fold number), fitted on all rows of its group outside it.

    Rows are combined to one per (group, fold, score) and never repeated. A step is one scan: a task works out the curve of every layer at its scores as a
    product of scores and parameters, a row counting for all layers of its group but that of its own fold, and gives back five sums per layer. The driver holds one
    row per layer, as the result does.
    """
    by = list(by)
    counts = score_counts(df, y, p, [*by, fold]).select(*by, fold, logit(p, eps).alias("_z"), F.col("n").cast("double").alias("n"), F.col("pos").cast("double").alias("pos"))
    counts = stage(counts)
    layers = counts.groupBy(*by, fold).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    schema = T.StructType([*[counts.schema[c] for c in (*by, fold)], *[T.StructField(c, k) for c, k in (("n_rows", T.LongType()), ("n_pos", T.LongType()), ("a", T.DoubleType()), ("b", T.DoubleType()))]])
    if not layers:
        return df.sparkSession.createDataFrame([], schema)
    groups: dict[tuple, list[int]] = {}
    for i, row in enumerate(layers):
        groups.setdefault(tuple(row[c] for c in by), []).append(i)
    order = [i for members in groups.values() for i in members]  # the layers of a group stand side by side
    layers = [layers[i] for i in order]
    lows = dict(zip(groups, np.cumsum([0, *[len(m) for m in groups.values()]]).tolist(), strict=False))
    sizes = {key: len(members) for key, members in groups.items()}
    keys = [tuple(row[c] for c in by) for row in layers]
    places = df.sparkSession.createDataFrame([(*(row[c] for c in (*by, fold)), i, lows[key], lows[key] + sizes[key]) for i, (row, key) in enumerate(zip(layers, keys, strict=True))],
                                             T.StructType([*schema.fields[:len(by) + 1], *[T.StructField(c, T.IntegerType()) for c in ("_own", "_low", "_high")]]))
    rows = join_on(counts, places, [*by, fold]).select("_own", "_low", "_high", "_z", "n", "pos")

    inside = np.array([[row["n"], row["pos"]] for row in layers])
    whole = {key: inside[lows[key]:lows[key] + sizes[key]].sum(0) for key in groups}
    outside = np.array([whole[key] for key in keys]) - inside
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = outside[:, 1] / outside[:, 0]
        a = np.where((rate > 0) & (rate < 1), np.log(rate / (1 - rate)), np.nan)
    b = np.zeros(len(a))
    for _ in range(steps):
        sums = np.zeros((5, len(a)))
        found = rows.mapInPandas(_outside_sums(a, b), "layer int, g0 double, g1 double, h0 double, h1 double, h2 double")
        for r in found.groupBy("layer").agg(*[F.sum(c).alias(c) for c in ("g0", "g1", "h0", "h1", "h2")]).collect():
            sums[:, r["layer"]] = r["g0"], r["g1"], r["h0"], r["h1"], r["h2"]
        g0, g1, h0, h1, h2 = sums
        with np.errstate(divide="ignore", invalid="ignore"):
            det = h0 * h2 - h1 * h1
            det[det == 0] = np.nan
            a, b = a + (h2 * g0 - h1 * g1) / det, b + (h0 * g1 - h1 * g0) / det

    def number(x: float) -> float | None:
        return None if np.isnan(x) else float(x)

    return df.sparkSession.createDataFrame([(*(row[c] for c in (*by, fold)), int(o[0]), int(o[1]), number(a[i]), number(b[i])) for i, (row, o) in enumerate(zip(layers, outside, strict=True))], schema)


def _outside_sums(a: np.ndarray, b: np.ndarray):
    """Task function: gradient and curvature of every layer, at its parameters, over the rows of its group that are not its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, len(a)))
        for batch in batches:
            for (low, high), part in batch.groupby(["_low", "_high"]):
                width = max(1, CELLS // (high - low))
                for at in range(0, len(part), width):
                    few = part.iloc[at:at + width]
                    z, n, pos = (few[c].to_numpy()[:, None] for c in ("_z", "n", "pos"))
                    other = few["_own"].to_numpy()[:, None] != np.arange(low, high)
                    mu = 1.0 / (1.0 + np.exp(-(a[low:high] + z * b[low:high])))
                    miss, spread = np.where(other, pos - n * mu, 0.0), np.where(other, n * mu * (1.0 - mu), 0.0)
                    powers = np.concatenate([np.ones_like(z), z, z * z], axis=1).T
                    total[:2, low:high] += powers[:2] @ miss
                    total[2:, low:high] += powers @ spread
        yield pd.DataFrame({"layer": np.arange(len(a), dtype=np.int32), **dict(zip(("g0", "g1", "h0", "h1", "h2"), total, strict=True))})

    return run


def half_sample_recalibration(df: DataFrame, unit: Sequence[str], repeats: int = 20, y: str = "y", p: str = "p", seed: int = 42, bins: int = 10) -> DataFrame:
    """Per repeat: the layer of a random half (``a``, ``b``), and calibration error and Brier score of the other half under it.

    Rows become one per (repeat, half, score) on the map side; layers, bins and errors of all repeats are grouped jobs over that table.
    """
    halves = exact_halves(known_pairs(df, y, p).select(*unit, y, p), unit, repeats, seed)
    counts = stage(halves.groupBy("repeat", "half", y, p).agg(F.count("*").alias("_w")))
    layers = stage(fit_layer(counts.filter("half = 0"), y, p, ["repeat"], 1e-6, weight="_w").select("repeat", "a", "b"))
    other = stage(apply_layer(counts.filter("half = 1"), layers, p, ["repeat"], "_local", 1e-6).select("repeat", y, "_local", "_w"))
    errors = calibration_error(other, y, "_local", ["repeat"], bins, weight="_w").select("repeat", "ece")
    scores = brier(other, y, "_local", ["repeat"], "_w").select("repeat", "n", "brier")
    return join_on(join_on(layers, errors, ["repeat"]), scores, ["repeat"])


def leave_out_evaluation(df: DataFrame, site: str, y: str = "y", p: str = "p", transported: str = "p_tr", least_pos: int = 20, bins: int = 10) -> DataFrame:
    """Each site before and after it gets the layer of all other sites.

    For sites with ``least_pos`` positives or more: rows, positives, slope and unweighted calibration error of the transported score and of the score under the layer
    that was fitted on all other sites, and that layer's slope ``b``. All sites are worked on together, in jobs grouped by (site, version).
    """
    layers = held_out_layers(df, site, y, p)
    sized = known_pairs(df, y, p).groupBy(site).agg(F.count("*").alias("n"), F.sum(F.col(y)).cast("long").alias("n_pos")).filter(F.col("n_pos") >= least_pos)
    local = apply_layer(known_pairs(df, y, p), layers, p, [site], "_local")
    versions = F.array(F.struct(F.lit("transported").alias("version"), F.col(transported).alias("_score")), F.struct(F.lit("local").alias("version"), F.col("_local").alias("_score")))
    long = join_on(local, sized.select(site), [site], "left_semi").select(site, y, F.inline(versions))
    counts = stage(long.groupBy(site, "version", y, "_score").agg(F.count("*").alias("_w")))
    by = [site, "version"]
    slopes = fit_layer(counts, y, "_score", by, 1e-9, weight="_w").select(*by, F.col("b").alias("slope"))
    errors = calibration_error(counts, y, "_score", by, bins, weighted=False, weight="_w").select(*by, "ece")
    both = join_on(slopes, errors, by)
    wide = both.groupBy(site).agg(*[F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{c}_{v}") for c in ("slope", "ece") for v in ("transported", "local")])
    return join_on(join_on(sized, wide, [site]), layers.select(site, "b"), [site])


def leave_out_summary(sites: DataFrame, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """Over the sites of ``leave_out_evaluation``: number, and per version the median and quartiles of the slope, the slopes within bounds and the median error. One row per site is all that is sorted."""
    out = [F.count("*").alias("n_sites")]
    for v in ("transported", "local"):
        slope = F.col(f"slope_{v}")
        out += [F.percentile(slope, q).alias(f"slope_{v}_{n}") for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
        out += [F.count(F.when(slope.between(low, high), 1)).alias(f"inside_{v}"), F.percentile(f"ece_{v}", 0.5).alias(f"ece_{v}_median")]
    return sites.agg(*out)


def decision_curve(df: DataFrame, thresholds: Sequence[float], y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Net benefit of the score, of treating all and of treating none, with a flag where the score beats both."""
    counts = threshold_counts(df, thresholds, y, p, by)
    odds = F.col("threshold") / (1 - F.col("threshold"))
    n = F.col("n_pos") + F.col("n_neg")
    model = F.col("tp") / n - F.col("fp") / n * odds
    treat_all = F.col("n_pos") / n - F.col("n_neg") / n * odds
    out = counts.select(*by, "threshold", model.alias("net_benefit"), treat_all.alias("treat_all"),
                        F.lit(0.0).alias("treat_none"))
    best = F.greatest("treat_all", "treat_none")
    return out.withColumn("wins", F.when(F.col("net_benefit") > best, 1).otherwise(0))


def winning_range(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Range of thresholds in which the score beats both default strategies."""
    win = F.when(F.col("wins") == 1, F.col("threshold"))
    return curve.groupBy(*by).agg(F.sum("wins").alias("n_wins"), F.min(win).alias("from"), F.max(win).alias("to"))
