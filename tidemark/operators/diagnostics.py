"""Label diagnostics: which part of a score's discrimination is forecasting and which is definition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import safe_divide
from tidemark.operators.discrimination import auroc
from tidemark.operators.models import melt
from tidemark.operators.ordered import join_on


def in_subgroups(df: DataFrame, masks: Mapping[str, Column], name: str = "subgroup") -> DataFrame:
    """Each row once per subgroup it belongs to; subgroups may overlap."""
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in masks.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(tags))


def severity_classes(df: DataFrame, classes: Mapping[str, Column], y: str = "y", name: str = "class") -> DataFrame:
    """Positives of each class against all negatives: a positive enters its classes, a negative every class."""
    hits = F.filter(F.array(*[F.when((F.col(y) == 0) | c, F.lit(n)) for n, c in classes.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(hits))


def counts_per_group(df: DataFrame, by: Sequence[str], entity: str = "entity", y: str = "y") -> DataFrame:
    """Entities and event entities per group, counted from one row per (group, entity)."""
    per = df.groupBy(*by, entity).agg(F.max(y).alias("_y"))
    return per.groupBy(*by).agg(F.count("*").alias("n_entities"), F.count_if(F.col("_y") == 1).alias("n_event_entities"))


def gap(table: DataFrame, group: str, first: str, second: str, value: str = "auroc") -> DataFrame:
    """Difference of one metric between two subgroups of a report table."""
    def of(g):
        return F.max(F.when(F.col(group) == g, F.col(value)))

    return table.agg(of(first).alias("first"), of(second).alias("second"), (of(first) - of(second)).alias("gap"))


def univariate(df: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    """AUROC of every feature alone, in its better direction, with its missing count; one grouped job."""
    long = melt(df, features, [y])
    missing = long.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"))
    scores = auroc(long, y, "value", ["feature"])
    return join_on(missing, scores, ["feature"], "left").withColumn("strength", F.abs(F.col("auroc") - 0.5) + 0.5)


def decoupled(df: DataFrame, leads: Sequence[float], t: str = "t_hr", y: str = "y", onset: str = "onset_hr", name: str = "lead") -> DataFrame:
    """All negatives, and only the positives at least ``lead`` hours before their onset, once per lead."""
    spread = df.withColumn(name, F.explode(F.array(*[F.lit(float(x)) for x in leads])))
    return spread.filter((F.col(y) == 0) | (F.col(onset) - F.col(t) >= F.col(name)))


def already_met(ratio: str, rise: str, fold: float = 1.5, step: float = 0.3) -> Column:
    """Does the checkpoint already fulfil the criterion that defines the label? Unknown counts as no."""
    return F.coalesce(F.col(ratio) >= fold, F.lit(False)) | F.coalesce(F.col(rise) >= step, F.lit(False))


def definitional_share(df: DataFrame, met: Column, observed: str, y: str = "y") -> DataFrame:
    pos, seen = F.col(y) == 1, F.col(observed).isNotNull()
    out = df.agg(F.count("*").alias("n"), F.count_if(pos).alias("n_pos"), F.count_if(pos & seen).alias("n_observed"), F.count_if(pos & seen & met).alias("n_definitional"))
    return out.withColumn("share", safe_divide(F.col("n_definitional"), F.col("n_observed")))


def task_rows(df: DataFrame, met: Column, observed: str, t: str = "t_hr", y: str = "y", onset: str = "onset_hr", lead: float = 24.0) -> DataFrame:
    """Rows tagged with the tasks they belong to: all, forecast only, and forecast at least ``lead`` hours ahead."""
    neg = F.col(y) == 0
    forecast = neg | (F.col(observed).isNotNull() & ~met)
    early = forecast & (neg | F.coalesce(F.col(onset) - F.col(t) >= lead, F.lit(False)))
    return in_subgroups(df, {"all": F.lit(True), "forecast": forecast, "forecast_early": early}, "task")


def excess_share(df: DataFrame, feature: str, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """AUROC of the score and of one feature on the rows where the feature is known, and the feature's share of the excess."""
    by = list(by)
    rows = df.filter(F.col(feature).isNotNull())
    both = rows.select(*by, y, F.inline(F.array(F.struct(F.lit("score").alias("_who"), F.col(p).cast("double").alias("_v")),
                                                F.struct(F.lit("feature").alias("_who"), F.col(feature).cast("double").alias("_v")))))
    per = auroc(both, y, "_v", [*by, "_who"])

    def of(w, c):
        return F.max(F.when(F.col("_who") == w, F.col(c)))

    out = per.groupBy(*by).agg(of("score", "n_pos").alias("n_pos"), of("score", "n_neg").alias("n_neg"), of("score", "auroc").alias("auroc_score"), of("feature", "auroc").alias("auroc_feature"))
    return out.withColumn("share", safe_divide(F.col("auroc_feature") - 0.5, F.col("auroc_score") - 0.5))
