"""Model tables: training, out-of-fold scores, selection, ablation, frozen application, batch scoring.

Training is Spark ML throughout. Fits run over folds, endpoints or settings (a fixed few), several at a time, never over data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import band, recalibrate, safe_divide, sigmoid
from tidemark.operators.checkpoints import align
from tidemark.operators.cleaning import small_table
from tidemark.operators.discrimination import auroc
from tidemark.operators.ordered import join_on, quantiles
from tidemark.operators.sampling import class_weights
from tidemark.operators.sketches import rank_sketches, sketched_quantiles
from tidemark.operators.summary import cumulative_cut
from tidemark.session import ROWS_PER_TASK

T = TypeVar("T")


@dataclass(frozen=True)
class TreeSettings:
    """Boosted trees. Depth 7 allows 128 leaves; the defaults are the full-size settings."""

    trees: int = 800
    rate: float = 0.02
    depth: int = 7
    seed: int = 42
    bins: int = 32
    sample: float = 1.0


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline with the ordered feature list it was fitted on."""

    model: PipelineModel
    features: tuple[str, ...]
    names: tuple[str, ...] = field(default=())


def with_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """0/1 column per feature that says whether it was missing (trees have no native missing value)."""
    return df.select("*", *[F.when(F.col(c).isNull(), 1.0).otherwise(0.0).alias(f"{c}__missing") for c in features])


def assembler_stages(features: Sequence[str]) -> list:
    filled = [f"{c}__filled" for c in features]
    return [Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=[*filled, *[f"{c}__missing" for c in features]], outputCol="_features")]


def train_trees(df: DataFrame, features: Sequence[str], y: str, settings: TreeSettings = TreeSettings(), balanced: bool = True) -> Trained:
    """Gradient-boosted trees with class weights, median fill and missing indicators."""
    rows = with_indicators(class_weights(df, y) if balanced else df.withColumn("class_weight", F.lit(1.0)), features)
    trees = GBTClassifier(featuresCol="_features", labelCol=y, weightCol="class_weight", maxIter=settings.trees, stepSize=settings.rate,
                          maxDepth=settings.depth, maxBins=settings.bins, subsamplingRate=settings.sample, seed=settings.seed)
    ready = Pipeline(stages=assembler_stages(features)).fit(rows)
    with kept(ready.transform(rows), "_features", y, "class_weight") as vectors:
        fitted = PipelineModel([*ready.stages, trees.fit(vectors)])
    return Trained(fitted, tuple(features), tuple([*features, *[f"{c}__missing" for c in features]]))


def fit_all(fits: Sequence[Callable[[], T]], at_once: int = 4) -> list[T]:
    """Independent fits, a few at a time: jobs of one fit fill the gaps that the driver's steps of another leave. Results come in the order of the fits."""
    with ThreadPool(max(1, min(at_once, len(fits)))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(SparkSession.active())(f) for f in fits])


def side_by_side(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows as several fits read them, and how many fits run at once. A small table's time goes to thousands of short jobs, so each of them is one task; a large one's rows are kept once more by each fit."""
    return (rows.coalesce(1), 16) if rows.count() <= ROWS_PER_TASK else (rows, 4)


@contextmanager
def kept(df: DataFrame, *columns: str) -> Iterator[DataFrame]:
    """Rows that several fits scan, kept in columns (spilled to disk where memory ends) while they run: a fit scans its rows half a dozen times, and a staged table gives them back one by one."""
    rows = df.select(*dict.fromkeys(columns)).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def train_logistic(df: DataFrame, features: Sequence[str], y: str, balanced: bool = True, penalty: float = 0.0) -> Trained:
    """Logistic regression on zero-filled covariates."""
    rows = (class_weights(df, y) if balanced else df.withColumn("class_weight", F.lit(1.0)))
    model = LogisticRegression(featuresCol="_features", labelCol=y, weightCol="class_weight", regParam=penalty, maxIter=100)
    stages = [VectorAssembler(inputCols=[f"{c}__filled" for c in features], outputCol="_features"), model]
    return Trained(Pipeline(stages=stages).fit(_zero_filled(rows, features)), tuple(features), tuple(features))


def _zero_filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{c}__filled") for c in features])


def apply_trees(df: DataFrame, trained: Trained, name: str = "p") -> DataFrame:
    """Frozen application: columns are aligned to the trained list, absent features are missing."""
    ready = with_indicators(align(df, trained.features), trained.features)
    return _scores(ready, trained, name, df.columns)


def apply_logistic(df: DataFrame, trained: Trained, name: str = "p") -> DataFrame:
    """Linear score as a plain column expression: stays in generated code, needs no model on the executors."""
    ready = _zero_filled(align(df, trained.features), trained.features)
    z = F.lit(float(trained.model.stages[-1].intercept))
    for f, w in coefficients(trained).items():
        z = z + F.lit(w) * F.col(f"{f}__filled")
    out = ready.withColumn(name, sigmoid(z))
    keep = [c for c in df.columns if c != name]
    return out.select(*keep, *[c for c in trained.features if c not in keep], name)


def _scores(ready: DataFrame, trained: Trained, name: str, columns: Sequence[str]) -> DataFrame:
    out = trained.model.transform(ready).withColumn(name, vector_to_array("probability")[1])
    keep = [c for c in columns if c in out.columns and c != name]
    return out.select(*keep, *[c for c in trained.features if c not in keep], name)


def endpoint_models(df: DataFrame, features: Sequence[str], endpoints: Sequence[str], settings: TreeSettings = TreeSettings(), fill_zero: bool = False) -> dict[str, Trained]:
    """One model per endpoint; ``fill_zero`` trains the arm in which missing values count as 0."""
    with kept(df.fillna(0.0, subset=list(features)) if fill_zero else df, *features, *endpoints) as rows:
        return dict(zip(endpoints, fit_all([lambda e=e: train_trees(rows, features, e, settings) for e in endpoints]), strict=True))


def fold_models(df: DataFrame, features: Sequence[str], y: str, fold: str, k: int, settings: TreeSettings = TreeSettings()) -> list[Trained]:
    """A model for each fold, fitted on the other folds."""
    with kept(df, *features, y, fold) as rows:
        read, at_once = side_by_side(rows)
        return fit_all([lambda i=i: train_trees(read.filter(F.col(fold) != i), features, y, settings) for i in range(k)], at_once)


def out_of_fold(df: DataFrame, features: Sequence[str], y: str, fold: str, k: int, settings: TreeSettings = TreeSettings(), name: str = "p") -> DataFrame:
    """Scores of each fold from a model fitted on the other folds."""
    models = fold_models(df, features, y, fold, k, settings)
    return reduce(DataFrame.unionByName, [apply_trees(df.filter(F.col(fold) == i), model, name) for i, model in enumerate(models)])


def importance_table(trained: Trained, df: DataFrame, fold: int = 0) -> DataFrame:
    """Normalised importance per feature; a missing indicator counts for its feature."""
    values = trained.model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = [(fold, n.removesuffix("__missing"), float(v) / total) for n, v in zip(trained.names, values)]
    return small_table(df.sparkSession, rows, "fold int, feature string, share double").groupBy("fold", "feature").agg(F.sum("share").alias("share"))


def select_features(df: DataFrame, features: Sequence[str], y: str, fold: str, k: int, settings: TreeSettings = TreeSettings(), cut: float = 0.99) -> DataFrame:
    """Grouped cross-validated importance: normalised per fold, averaged, cut at the cumulative share."""
    models = fold_models(df, features, y, fold, k, settings)
    parts = reduce(DataFrame.unionByName, [importance_table(model, df, i) for i, model in enumerate(models)])
    return cumulative_cut(parts.groupBy("feature").agg(F.avg("share").alias("share")), "feature", "share", cut)


def grid_search(train: DataFrame, select: DataFrame, features: Sequence[str], y: str, settings: Sequence[TreeSettings]) -> DataFrame:
    """AUROC of a few settings on the selection split, best first."""
    parts = None
    with kept(train, *features, y) as rows:
        models = fit_all([lambda s=s: train_trees(rows, features, y, s) for s in settings])
    for s, model in zip(settings, models, strict=True):
        scored = apply_trees(select, model)
        row = auroc(scored, y, "p").select(F.lit(s.trees).alias("trees"), F.lit(s.depth).alias("depth"), F.lit(s.rate).alias("rate"), "auroc")
        parts = row if parts is None else parts.unionByName(row)
    return parts.orderBy(F.desc("auroc"))


def ablation(train: DataFrame, test: DataFrame, features: Sequence[str], prefixes: Sequence[str], y: str, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """AUROC with each feature family left out, next to the full set."""
    parts, lists = None, [[f for f in features if not p or not f.startswith(p)] for p in ("", *prefixes)]
    with kept(train, *features, y) as rows:
        read, at_once = side_by_side(rows)
        models = fit_all([lambda some=some: train_trees(read, some, y, settings) for some in lists], at_once)
    with kept(test, *features, y) as rows:
        for p, some, model in zip(("", *prefixes), lists, models, strict=True):
            scored = apply_trees(rows, model)
            row = auroc(scored, y, "p").select(F.lit(p or "none").alias("left_out"), F.lit(len(some)).alias("n_features"), "n_pos", "n_neg", "auroc")
            parts = row if parts is None else parts.unionByName(row)
    return parts


def learning_curve(nested: DataFrame, test: DataFrame, features: Sequence[str], fractions: Sequence[float], y: str, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """AUROC on a fixed test side per training fraction (``nested`` comes from ``sample_fractions``)."""
    parts = None
    with kept(nested, *features, y, "fraction") as rows:
        models = fit_all([lambda f=f: train_trees(rows.filter(F.col("fraction") == float(f)), features, y, settings) for f in fractions])
    for f, model in zip(fractions, models, strict=True):
        row = auroc(apply_trees(test, model), y, "p").select(F.lit(float(f)).alias("fraction"), "n_pos", "n_neg", "auroc")
        parts = row if parts is None else parts.unionByName(row)
    return parts


# ---------------------------------------------------------------- catalogue, profiles, scoring


def feature_catalogue(df: DataFrame, features: Sequence[str], sketch_size: int | None = None) -> DataFrame:
    """Minimum, maximum, default (median), step and missing share of every feature.

    The features become rows, so all of it comes from one exact rank pass grouped by feature. With ``sketch_size`` the ranks come from sketches
    instead: minimum and maximum stay exact, the default is a value whose rank is off by ``sketches.rank_error`` at most, in 99 of 100 cases.
    """
    probs = {"min": 0.0, "default": 0.5, "max": 1.0}
    rows = melt(df, features)
    if sketch_size is None:
        ranks = quantiles(rows, "value", probs, ["feature"])
    else:
        ranks = sketched_quantiles(rank_sketches(rows, "value", ["feature"], sketch_size), probs, ["feature"])
    names = small_table(df.sparkSession, [(f,) for f in features], "feature string")
    out = names.join(ranks, "feature", "left").crossJoin(df.agg(F.count("*").alias("_rows")))
    step = F.when(F.col("max") - F.col("min") >= 20, 1.0).when(F.col("max") - F.col("min") >= 2, 0.1).otherwise(0.01)
    return out.select("feature", "min", "max", "default", step.alias("step"), safe_divide(F.col("_rows") - F.coalesce("n", F.lit(0)), F.col("_rows")).alias("missing_share"))


def melt(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide features to rows (feature, value)."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    return df.select(*keep, F.inline(parts))


def profile_row(catalogue: DataFrame, features: Sequence[str]) -> DataFrame:
    """Catalogue defaults as one wide row."""
    return catalogue.groupBy().pivot("feature", list(features)).agg(F.first("default"))


def fill_profile(inputs: DataFrame, defaults: DataFrame, features: Sequence[str], derived: Mapping[str, Column]) -> DataFrame:
    """Full feature vectors from a few inputs: derived expressions first, catalogue defaults for everything else.

    Expressions may use the inputs and the defaults (prefixed ``default_``).
    """
    one = defaults.select(*[F.col(f"`{f}`").alias(f"default_{f}") for f in features])
    wide = inputs.crossJoin(F.broadcast(one))
    return wide.select(*inputs.columns, *[
        (F.coalesce(derived[f].cast("double"), F.col(f"default_{f}")) if f in derived else F.col(f"default_{f}")).alias(f"x_{f}") for f in features])


def slope_of_points(points: Sequence[tuple[Column, Column]]) -> Column:
    """Least-squares slope through a few (time, value) expressions; points with a NULL time are left out."""
    arr = F.filter(F.array(*[F.struct(t.cast("double").alias("t"), v.cast("double").alias("v")) for t, v in points]), lambda s: s["t"].isNotNull())

    def total(f):
        return F.aggregate(arr, F.lit(0.0), lambda a, s: a + f(s))

    n = F.size(arr)
    t, v = total(lambda s: s["t"]), total(lambda s: s["v"])
    return safe_divide(n * total(lambda s: s["t"] * s["v"]) - t * v, n * total(lambda s: s["t"] * s["t"]) - t * t)


def deviation_of_points(values: Sequence[Column]) -> Column:
    """Sample deviation of a few value expressions, NULLs left out."""
    arr = F.filter(F.array(*[v.cast("double") for v in values]), lambda x: x.isNotNull())
    n = F.size(arr)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n >= 2, F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)))


def bedside_features(base: str, current: str, low: str, first: str, hour: str, prefix: str = "cr") -> dict[str, Column]:
    """Trend features of one analyte from four bedside values.

    Assumed timeline: first value at ``t - span`` with ``span = min(t, 48)`` (at least 6 h), the lowest value at ``t - 12``
    when the span is longer than 12 h, the current value at ``t``. Values below 0.1 count as 0.1.
    """
    c = {k: F.greatest(F.col(v).cast("double"), F.lit(0.1)) for k, v in (("base", base), ("now", current), ("low", low), ("first", first))}
    low24 = F.least(c["low"], c["now"])
    t = F.col(hour).cast("double")
    span = F.greatest(F.least(t, F.lit(48.0)), F.lit(6.0))
    mid = F.when(span > 12.0, t - 12.0)
    points = [(t - span, c["first"]), (mid, low24), (t, c["now"])]
    return {
        f"{prefix}_base": c["base"], f"{prefix}_last": c["now"], f"{prefix}_locf": c["now"], f"{prefix}_last48": c["now"],
        f"{prefix}_ratio_base": c["now"] / c["base"], f"{prefix}_delta_since_adm": c["now"] - c["base"], f"{prefix}_min": low24, f"{prefix}_max": c["now"],
        f"{prefix}_delta48": c["now"] - c["first"], f"{prefix}_slope48": slope_of_points(points),
        f"{prefix}_sd48": deviation_of_points([c["first"], F.when(mid.isNotNull(), low24), c["now"]]),
    }


def score_rows(df: DataFrame, any_model: Trained, severe_model: Trained, intercept: float, slope: float, cuts=(0.10, 0.15)) -> DataFrame:
    """Batch scoring: raw and recalibrated risk, severe score, band. Other columns pass through; text cells are coerced."""
    keys = [c for c in df.columns if c not in any_model.features]
    first = apply_trees(df, any_model, "p_raw")
    both = apply_trees(first, severe_model, "p_severe")
    return both.select(*keys, "p_raw", recalibrate("p_raw", intercept, slope).alias("p_rec"), "p_severe").withColumn("band", band("p_rec", cuts))


def missing_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [f for f in features if f not in df.columns]


def coefficients(trained: Trained) -> dict[str, float]:
    """Coefficients of a fitted linear model by feature."""
    return {f: float(w) for f, w in zip(trained.features, trained.model.stages[-1].coefficients.toArray())}


def linear_attributions(df: DataFrame, weights: Mapping[str, float], keep: Sequence[str]) -> DataFrame:
    """Attribution ``coefficient x (value - mean)`` per row and feature of a linear model, long form.

    The mean table has one row per feature, so it may be broadcast.
    """
    filled = df.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in weights])
    rows = melt(filled, list(weights), keep)
    table = small_table(df.sparkSession, [(f, float(w)) for f, w in weights.items()], "feature string, coefficient double")
    means = rows.groupBy("feature").agg(F.avg("value").alias("_mean")).join(F.broadcast(table), "feature")
    return rows.join(F.broadcast(means), "feature").select(*keep, "feature", "value", (F.col("coefficient") * (F.col("value") - F.col("_mean"))).alias("attribution"))


def save(trained: Trained, path: str, intercept: float = 0.0, slope: float = 1.0) -> None:
    """Model artefact: the fitted pipeline, the ordered feature list and the recalibration layer."""
    trained.model.write().overwrite().save(f"{path}/pipeline")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    config = small_table(spark, [(list(trained.features), list(trained.names), float(intercept), float(slope))],
                         "features array<string>, names array<string>, intercept double, slope double")
    config.write.mode("overwrite").json(f"{path}/config")


def load(spark, path: str) -> tuple[Trained, float, float]:
    config = spark.read.schema("features array<string>, names array<string>, intercept double, slope double").json(f"{path}/config").first()
    model = PipelineModel.load(f"{path}/pipeline")
    return Trained(model, tuple(config["features"]), tuple(config["names"])), config["intercept"], config["slope"]


def template(catalogue: DataFrame, features: Sequence[str]) -> DataFrame:
    """Batch input template: keys and one row of catalogue defaults."""
    row = profile_row(catalogue, features)
    return row.select(F.lit("example").alias("entity"), F.lit(24.0).alias("t_hr"), *[F.col(f"`{f}`") for f in features])


def attribution_ranking(attributions: DataFrame, k: int = 15) -> DataFrame:
    """Features by mean absolute attribution (a top-k report)."""
    return (attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(k))


def attribution_share(attributions: DataFrame, domain: Column) -> DataFrame:
    """Share of the absolute attribution per feature domain."""
    per = attributions.groupBy("feature").agg(F.sum(F.abs("attribution")).alias("_a")).withColumn("domain", domain)
    out = per.groupBy("domain").agg(F.count("*").alias("n_features"), F.sum("_a").alias("_d"))
    return join_on(out, out.agg(F.sum("_d").alias("_t")), []).select("domain", "n_features", safe_divide(F.col("_d"), F.col("_t")).alias("share"))


def attribution_dependence(attributions: DataFrame, bins: int = 10) -> DataFrame:
    """Mean attribution along the quantile bins of each feature's value."""
    from tidemark.operators.ordered import quantile_bins

    binned = quantile_bins(attributions.filter(F.col("value").isNotNull()), "value", bins, ["feature"])
    return binned.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.avg("attribution").alias("mean_attribution"))
