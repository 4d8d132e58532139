"""Ranking metrics of a score against a 0/1 label, computed for all groups in one job.

Every function takes ``by``: cohort, endpoint, site, subgroup, stratum or bootstrap replicate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import safe_divide
from tidemark.operators.ordered import PIECE, add_piece, cumulate, join_on, split_points
from tidemark.session import stage


def class_sums(y: str, weight: str | None = None) -> dict[str, Column]:
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    return {"pos": F.when(F.col(y) == 1, w).otherwise(w * 0), "neg": F.when(F.col(y) == 0, w).otherwise(w * 0)}


def known_pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows where both label and score are known; NaN counts as unknown."""
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))


def auroc(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), weight: str | None = None,
          points: Sequence[float] | None = None) -> DataFrame:
    """Tie-corrected area under the ROC curve; NULL for a group with one class.

    Pieces of the score axis contribute their inner area plus (their positives) x (negatives in lower pieces), so
    a single pass suffices and nothing has to be joined back.
    """
    sums = class_sums(y, weight)
    distinct = known_pairs(df, y, p).groupBy(*by, p).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return auroc_from_counts(distinct, p, by, points)


def auroc_from_counts(counts: DataFrame, p: str = "p", by: Sequence[str] = (),
                      points: Sequence[float] | None = None) -> DataFrame:
    """AUROC from one row per (``by``, score) with ``pos`` and ``neg`` weights."""
    by = list(by)
    if points is None:
        counts = stage(counts)
        points = split_points(counts, p)
    inside = Window.partitionBy(*by, PIECE).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    area = F.col("pos").cast("double") * (below + F.col("neg") / 2.0)
    pieces = (add_piece(counts, p, points).withColumn("area", area)
              .groupBy(*by, PIECE).agg(F.sum("area").alias("area"), F.sum("pos").alias("pos"),
                                       F.sum("neg").alias("neg")))
    return auroc_from_pieces(pieces, by)


def auroc_from_pieces(pieces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    across = Window.partitionBy(*by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(across), F.lit(0))
    total = pieces.withColumn("area", F.col("area") + F.col("pos").cast("double") * below)
    return total.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        safe_divide(F.sum("area"), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def curve(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), weight: str | None = None,
          points: Sequence[float] | None = None) -> DataFrame:
    """ROC and precision-recall points, one per distinct score taken as the threshold (score >= threshold)."""
    by = list(by)
    runs = cumulate(known_pairs(df, y, p), p, class_sums(y, weight), by, descending=True, points=points)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    return runs.select(
        *by, F.col(p).alias("threshold"), tp.alias("tp"), fp.alias("fp"), "pos", "neg",
        F.col("pos_total").alias("n_pos"), F.col("neg_total").alias("n_neg"),
        safe_divide(tp, F.col("pos_total")).alias("tpr"), safe_divide(fp, F.col("neg_total")).alias("fpr"),
        (tp / (tp + fp)).alias("precision"))


def discrimination(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), weight: str | None = None,
                   points: Sequence[float] | None = None) -> DataFrame:
    """AUROC, average precision, prevalence and lift of every group from one descending pass."""
    by = list(by)
    points_of = curve(df, y, p, by, weight, points)
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    area = F.col("pos").cast("double") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2.0)
    step = F.col("pos") * F.col("precision")
    out = points_of.groupBy(*by).agg(
        n_pos.alias("n_pos"), n_neg.alias("n_neg"),
        safe_divide(F.sum(area), n_pos.cast("double") * n_neg).alias("auroc"),
        safe_divide(F.sum(step), n_pos).alias("auprc"))
    prevalence = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    return (out.withColumn("prevalence", prevalence)
            .withColumn("lift", safe_divide(F.col("auprc"), prevalence)))


def auprc(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), **kw) -> DataFrame:
    """Average precision, step-wise, ties taken together."""
    return discrimination(df, y, p, by, **kw).select(*by, "n_pos", "n_neg", "auprc")


def thin_curve(points: DataFrame, keep: int, by: Sequence[str] = (), order: str = "threshold",
               descending: bool = True) -> DataFrame:
    """Evenly spaced subset of a curve that keeps both ends (positions ``round(i (n-1)/(keep-1))``)."""
    by = list(by)
    ranked = cumulate(points, order, {"_one": F.lit(1)}, by, descending=descending)
    at, last = F.col("_one_before"), F.col("_one_total") - 1
    # A position is kept when some i in 0..keep-1 rounds onto it.
    nearest = F.rint(at * F.lit(keep - 1) / F.greatest(last, F.lit(1)))
    hit = F.rint(nearest * last / F.lit(float(keep - 1)))
    kept = ranked.filter((F.col("_one_total") <= keep) | (hit == at)).select(*by, order, at.alias("position"))
    return join_on(points, kept, [*by, order])


def threshold_counts(df: DataFrame, thresholds: Sequence[float], y: str = "y", p: str = "p",
                     by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates at fixed thresholds (alert when score >= threshold).

    The thresholds are a handful of literals, so each row is summed into one small array per group before the
    shuffle instead of being repeated once per threshold.
    """
    by = list(by)
    cells = []
    for i, t in enumerate(thresholds):
        flag = F.col(p) >= F.lit(float(t))
        cells += [F.count_if(flag & (F.col(y) == 1)).alias(f"_tp{i}"), F.count_if(flag & (F.col(y) == 0)).alias(f"_fp{i}")]
    wide = known_pairs(df, y, p).groupBy(*by).agg(
        F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"), *cells)
    parts = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"),
                               F.col(f"_fp{i}").alias("fp")) for i, t in enumerate(thresholds)])
    return rates(wide.select(*by, "n_pos", "n_neg", F.inline(parts)))


def flag_counts(df: DataFrame, flag: Column, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of a rule; an unknown rule value is no alert."""
    on = F.coalesce(flag, F.lit(False))
    counts = df.groupBy(*by).agg(
        F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"),
        F.count_if(on & (F.col(y) == 1)).alias("tp"), F.count_if(on & (F.col(y) == 0)).alias("fp"))
    return rates(counts)


def rates(counts: DataFrame) -> DataFrame:
    """Sensitivity, specificity, PPV, number needed to evaluate and alert rate from tp, fp, n_pos, n_neg."""
    tp, fp, n_pos, n_neg = (F.col(c) for c in ("tp", "fp", "n_pos", "n_neg"))
    return counts.select(
        "*", (n_pos - tp).alias("fn"), (n_neg - fp).alias("tn"),
        safe_divide(tp, n_pos).alias("sensitivity"), safe_divide(n_neg - fp, n_neg).alias("specificity"),
        safe_divide(tp, tp + fp).alias("ppv"), safe_divide(tp + fp, tp).alias("nne"),
        safe_divide(tp + fp, n_pos + n_neg).alias("alert_rate"))


def matched_sensitivity(df: DataFrame, target: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                        points: Sequence[float] | None = None) -> DataFrame:
    """PPV and threshold of a score where its sensitivity equals ``target.sensitivity``.

    Every distinct score is a threshold; the two thresholds that bracket the target are interpolated linearly.
    ``target`` has one row per group. Outside the covered range the result is NULL.
    """
    by = list(by)
    steps = curve(df, y, p, by, points=points).select(*by, "threshold", "tpr", "precision")
    against = join_on(steps, target.select(*by, F.col("sensitivity").alias("_want")), by)
    want = F.col("_want")
    # Lower bracket: largest sensitivity not above the target; upper: smallest not below. Where several thresholds
    # share one sensitivity the highest of them, which has the best precision, represents the step.
    lower = F.struct("tpr", "precision", "threshold")
    upper = F.struct("tpr", (-F.col("precision")).alias("_minus"), "precision", "threshold")
    ends = against.groupBy(*by, "_want").agg(
        F.max(F.when(F.col("tpr") <= want, lower)).alias("lo"), F.min(F.when(F.col("tpr") >= want, upper)).alias("hi"))
    share = F.when(F.col("hi.tpr") == F.col("lo.tpr"), F.lit(0.0)).otherwise(
        (F.col("_want") - F.col("lo.tpr")) / (F.col("hi.tpr") - F.col("lo.tpr")))

    def between(field):
        return F.col(f"lo.{field}") + share * (F.col(f"hi.{field}") - F.col(f"lo.{field}"))

    return ends.select(*by, F.col("_want").alias("sensitivity"), between("precision").alias("ppv"),
                       between("threshold").alias("threshold"), safe_divide(F.lit(1.0), between("precision")).alias("nne"))


def site_spread(site_auroc: DataFrame, value: str = "auroc", low: float = 0.60, by: Sequence[str] = ()) -> DataFrame:
    """Distribution of one metric over sites (as many rows as there are sites)."""
    marks = F.percentile(value, [0.10, 0.25, 0.50, 0.75, 0.90])
    out = site_auroc.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_sites"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.stddev_samp(value).alias("sd"), F.count_if(F.col(value) < low).alias("n_below"), marks.alias("_m"))
    names = ["p10", "p25", "median", "p75", "p90"]
    return out.select(*by, "n_sites", "min", "max", "sd", "n_below",
                      *[F.element_at("_m", i + 1).alias(n) for i, n in enumerate(names)])


def delong(df: DataFrame, p1: str = "p1", p2: str = "p2", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Paired comparison of two AUROCs from their structural components.

    A positive's component is the share of negatives it outranks (ties one half), a negative's the share of
    positives that outrank it; the variance of the difference adds both classes:
    ``(s10_11 + s10_22 - 2 s10_12) / m + (s01_11 + s01_22 - 2 s01_12) / n``.
    """
    by = list(by)
    known = known_pairs(known_pairs(df, y, p1), y, p2)
    counts = stage(known.groupBy(*by, p1, p2, y).agg(F.count("*").alias("_w")))
    out = counts
    for i, p in ((1, p1), (2, p2)):
        steps = cumulate(counts, p, class_sums(y, "_w"), by).select(
            *by, p,
            safe_divide(F.col("neg_before") + F.col("neg") / 2.0, F.col("neg_total")).alias(f"_v{i}"),
            safe_divide(F.col("pos_total") - F.col("pos_before") - F.col("pos") / 2.0, F.col("pos_total")).alias(f"_u{i}"))
        out = join_on(out, steps, [*by, p])
    w, is_pos = F.col("_w"), F.col(y) == 1
    s1, s2 = F.when(is_pos, F.col("_v1")).otherwise(F.col("_u1")), F.when(is_pos, F.col("_v2")).otherwise(F.col("_u2"))
    diff = s1 - s2
    side = out.groupBy(*by, y).agg(
        F.sum(w).alias("n"), (F.sum(w * s1) / F.sum(w)).alias("auc1"), (F.sum(w * s2) / F.sum(w)).alias("auc2"),
        F.sum(w * diff).alias("_d"), F.sum(w * diff * diff).alias("_dd"))
    # Variance of the paired difference of components; the difference of two AUROCs lies near 0, so no cancellation.
    side = side.withColumn("_var", safe_divide(F.col("_dd") - F.col("_d") * F.col("_d") / F.col("n"), F.col("n") - 1))

    def of(label, c):
        return F.max(F.when(F.col(y) == label, F.col(c)))

    test = side.groupBy(*by).agg(
        of(1, "n").alias("n_pos"), of(0, "n").alias("n_neg"), of(1, "auc1").alias("auc1"), of(1, "auc2").alias("auc2"),
        (safe_divide(of(1, "_var"), of(1, "n")) + safe_divide(of(0, "_var"), of(0, "n"))).alias("var"))
    z = safe_divide(F.col("auc1") - F.col("auc2"), F.sqrt("var"))
    return test.withColumn("z", z).withColumn("p_value", normal_two_sided(F.col("z")))


# Coefficients of the rational complementary-error-function approximation (relative error < 1.2e-7).
ERFC_COEFFICIENTS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
                     -0.82215223, 0.17087277)


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail probability, ``erfc(|z| / sqrt 2)``."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = poly * t + F.lit(c)
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def hour_strata(hour, width: float = 24.0, start: float = 24.0, end: float = 168.0, right_closed: bool = True) -> Column:
    """Label of the hour stratum: its upper border when right-closed (the start hour itself is left out), else the number of
    whole widths up to the end of the bucket since ``start``."""
    h = F.col(hour) if isinstance(hour, str) else hour
    if right_closed:
        top = F.ceil((h - start) / width) * width + start
        return F.when((h > start) & (h <= end), top)
    return F.when(h >= start, (F.floor((h - start) / width) + 1) * width)


def concordance(strata: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Kendall trend over a few ordered strata: S, tau and the two-sided P, exact by permutations and by the normal approximation without ties.

    The input has one row per stratum (a report table). P counts orders of the values by the number of
    concordant pairs, which follows from a recurrence over the strata, so no permutation is listed.
    """
    by = list(by)
    listed = strata.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))),
                    lambda s: s["v"]).alias("_v"))
    v = F.col("_v")

    def pair_sum(x, i):
        later = F.slice(v, i + 2, F.greatest(F.size(v) - i - 1, F.lit(0)))
        return F.aggregate(later, F.lit(0), lambda a, e: a + F.signum(e - x).cast("int"))

    s_stat = F.aggregate(F.transform(v, pair_sum), F.lit(0), lambda a, e: a + e)
    out = listed.select(*by, F.size(v).alias("n_strata"), s_stat.alias("s"))
    n = F.col("n_strata")
    pairs = n * (n - 1) / 2
    # orders[c] = number of orders of k items with c concordant pairs; orders of k+1 items add 0..k pairs each.
    upper = F.expr("""
        aggregate(sequence(2, greatest(n_strata, 2)), array(1D),
          (acc, k) -> transform(sequence(0, size(acc) + k - 2),
            c -> aggregate(slice(acc, greatest(c - k + 2, 1), least(c + 1, size(acc)) - greatest(c - k + 2, 1) + 1),
                           0D, (a, e) -> a + e)))""")
    concordant = ((pairs + F.abs("s")) / 2).cast("int")
    tail = F.aggregate(F.slice(upper, concordant + 1, F.size(upper)), F.lit(0.0), lambda a, e: a + e)
    every = F.aggregate(upper, F.lit(0.0), lambda a, e: a + e)
    return (out.withColumn("tau", safe_divide(F.col("s"), pairs))
            .withColumn("p_exact", F.least(F.lit(1.0), F.lit(2.0) * tail / every))
            .withColumn("z", safe_divide(F.col("s").cast("double"), F.sqrt(n * (n - 1) * (2 * n + 5) / 18.0)))
            .withColumn("p_normal", normal_two_sided(F.col("z"))))
