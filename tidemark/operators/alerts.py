"""Alert performance per entity and overall, and outcomes by capture status.

Every view reduces rows to one row per entity (and threshold) with a few conditional minima and maxima, which combine
on the map side; the report is a second, small aggregate. Lead times are multiples of the grid step, so exact
percentiles over them keep few distinct values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import safe_divide
from tidemark.operators.ordered import join_entities, join_on, quantile_bins, quantiles
from tidemark.operators.timeline import episodes
from tidemark.session import stage


LEAD_QUARTILES = {"lead_p25": 0.25, "lead_median": 0.5, "lead_p75": 0.75}


def at_thresholds(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Entity rows repeated for each of a handful of working points."""
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def entity_alerts(df: DataFrame, thresholds: Sequence[float], entity: Sequence[str] = ("entity",), t: str = "t_hr", y: str = "y",
                  p: str = "p", by: Sequence[str] = (), anchor: str | None = None) -> DataFrame:
    """Per entity and threshold: event, anchor, first alert, first alert before the anchor, captured, lead.

    The anchor is the last positive checkpoint, or the column ``anchor`` (for instance the first bin that meets a
    criterion). First and earliest-alert times per threshold need no sort: they are conditional minima.
    """
    keys = [*by, *entity]
    pos = F.col(y) == 1
    facts = df.groupBy(*keys).agg(
        F.max(F.when(pos, F.col(t))).alias("last_pos"), F.min(F.when(pos, F.col(t))).alias("first_pos"), F.max(t).alias("t_last"), F.min(t).alias("t_first"),
        F.count("*").alias("n_rows"), F.max(p).alias("max_p"), *([F.min(anchor).alias("_anchor")] if anchor else []),
        *[F.min(F.when(F.col(p) >= F.lit(float(th)), F.col(t))).alias(f"_a{i}") for i, th in enumerate(thresholds)])
    spread = facts.select(*[c for c in facts.columns if not c.startswith("_a") or c == "_anchor"], F.inline(F.array(*[
        F.struct(F.lit(float(th)).alias("threshold"), F.col(f"_a{i}").alias("first_alert")) for i, th in enumerate(thresholds)])))
    at = F.col("_anchor") if anchor else F.col("last_pos")
    out = spread.withColumn("anchor", at.cast("double")).drop("_anchor")
    event = F.col("anchor").isNotNull()
    # The earliest alert decides: it lies before the anchor or none does.
    hit = F.coalesce(F.col("first_alert") < F.col("anchor"), F.lit(False))
    return (out.withColumn("event", F.when(event, 1).otherwise(0)).withColumn("alerted", F.when(F.col("first_alert").isNotNull(), 1).otherwise(0))
            .withColumn("captured", F.when(hit, 1).otherwise(0)).withColumn("lead", F.when(hit, F.col("anchor") - F.col("first_alert"))))


def deployment(alerts: DataFrame, by: Sequence[str] = (), floor_hours: float = 6.0) -> DataFrame:
    """Capture, lead, number needed to evaluate, false alerts per 100 days and share alerted, per threshold."""
    keys = [*by, "threshold"]
    ev, free, al, cap = (F.col("event") == 1), (F.col("event") == 0), (F.col("alerted") == 1), (F.col("captured") == 1)
    days = F.when(free, F.greatest(F.col("t_last"), F.lit(floor_hours))).otherwise(F.greatest(F.coalesce("first_pos", "anchor"), F.lit(floor_hours))) / 24.0
    out = alerts.groupBy(*keys).agg(
        F.count("*").alias("n_entities"), F.count_if(ev).alias("n_event"), F.count_if(cap).alias("n_captured"), F.count_if(al).alias("n_alerted"),
        F.count_if(al & free).alias("n_false"), F.sum(days).alias("days"), F.percentile("lead", [0.25, 0.5, 0.75]).alias("_q"),
        F.count_if(F.col("lead") > 48).alias("n_lead_over_48"))
    return out.select(
        *keys, "n_entities", "n_event", "n_captured", "n_alerted", "n_false", "days",
        safe_divide(F.col("n_captured"), F.col("n_event")).alias("capture"), *[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(("lead_p25", "lead_median", "lead_p75"))],
        safe_divide(F.col("n_alerted"), F.col("n_captured")).alias("nne"), safe_divide(F.col("n_false") * 100.0, F.col("days")).alias("fa_per_100_days"),
        safe_divide(F.col("n_alerted") * 100.0, F.col("n_entities")).alias("pct_alerted"), safe_divide(F.col("n_lead_over_48"), F.col("n_captured")).alias("lead_over_48_share"))


def four_view(df: DataFrame, thresholds: Sequence[float], entity: Sequence[str] = ("entity",), t: str = "t_hr", p: str = "p", onset: str = "onset_hr",
              step: float = 6.0, by: Sequence[str] = ()) -> DataFrame:
    """Onset-anchored view: capture and lead for single and double alerts, episodes, false episodes per 100 days."""
    rows = at_thresholds(df.select(*by, *entity, t, p, onset), thresholds)
    per = episodes(rows, entity, t, F.col(p) >= F.col("threshold"), by=[*by, "threshold"])
    span = df.groupBy(*by, *entity).agg(F.min(onset).alias("_onset"), F.min(t).alias("_from"), F.max(t).alias("_to"))
    facts = join_entities(per, span, [*by, *entity])
    ev = F.col("_onset").isNotNull()
    one, two = F.col("first_alert") < F.col("_onset"), F.col("first_double") < F.col("_onset")
    facts = facts.withColumn("_lead", F.when(one, F.col("_onset") - F.col("first_alert")))
    facts = stage(facts)
    days = F.when(~ev, (F.col("_to") + step - F.col("_from")) / 24.0)
    keys = [*by, "threshold"]
    out = facts.groupBy(*keys).agg(
        F.count_if(ev).alias("n_event"), F.count_if(~ev).alias("n_free"), F.count("_lead").alias("captured"), F.count(F.when(two, 1)).alias("captured_double"),
        F.sum("episodes").alias("episodes"), F.sum("double_episodes").alias("double_episodes"),
        F.coalesce(F.sum(F.when(~ev, F.col("episodes"))), F.lit(0)).alias("false_episodes"), F.sum(days).alias("free_days"),
        F.count_if(F.col("_lead") >= 12).alias("captured_12h"))
    # Onsets are not on the grid, so leads take many values: quartiles by exact ranks.
    leads = quantiles(facts, "_lead", LEAD_QUARTILES, keys).drop("n")
    out = join_on(out, leads, keys, "left")
    c = F.col
    return out.select(*keys, "n_event", "n_free", "captured", "captured_double", "episodes", "double_episodes", "false_episodes",
                      safe_divide(c("captured"), c("n_event")).alias("capture"), safe_divide(c("captured_double"), c("n_event")).alias("capture_double"),
                      *LEAD_QUARTILES, safe_divide(c("episodes"), c("captured")).alias("nne_single"),
                      safe_divide(c("double_episodes"), c("captured_double")).alias("nne_double"),
                      safe_divide(c("false_episodes") * 100.0, c("free_days")).alias("false_per_100_days"),
                      safe_divide(c("captured_12h"), c("n_event")).alias("capture_12h"))


def capture_by(alerts: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Events, captures and lead by an entity attribute (event subtype, later stage)."""
    keys = [*by, "threshold", group]
    events = stage(alerts.filter(F.col("event") == 1).select(*keys, "captured", "lead"))
    out = events.groupBy(*keys).agg(F.count("*").alias("n_event"), F.sum("captured").alias("n_captured"))
    out = join_on(out, quantiles(events, "lead", LEAD_QUARTILES, keys).drop("n"), keys, "left")
    return out.select(*keys, "n_event", "n_captured", safe_divide(F.col("n_captured"), F.col("n_event")).alias("capture"), *LEAD_QUARTILES)


def false_alert_review(alerts: DataFrame, peaks: DataFrame, entity: Sequence[str] = ("entity",), fold: float = 1.3, rise: float = 0.2,
                       onset: str = "onset_hr", horizon: float = 48.0) -> DataFrame:
    """Alerted entities without a positive checkpoint: alerted too early (the event comes later than the horizon), near the
    criterion (peak fold or rise), or neither."""
    false = alerts.filter((F.col("alerted") == 1) & (F.col("event") == 0))
    joined = join_entities(false, peaks, entity, "left")
    early = F.coalesce(F.col(onset) - F.col("first_alert") > horizon, F.lit(False))
    near = F.coalesce((F.col("peak_fold") >= fold) | (F.col("peak_rise") >= rise), F.lit(False))
    return joined.groupBy("threshold").agg(F.count("*").alias("n_false"), F.count_if(early).alias("too_early"), F.count_if(~early & near).alias("near_criterion"),
                                           F.count_if(~early & ~near).alias("neither"))


def workload(df: DataFrame, thresholds: Sequence[float], entity: Sequence[str] = ("entity",), t: str = "t_hr", p: str = "p") -> DataFrame:
    """Share of entities ever alerted and share of entity-days with an alert."""
    ever = [F.max(F.when(F.col(p) >= F.lit(float(th)), 1).otherwise(0)).alias(f"_d{i}") for i, th in enumerate(thresholds)]
    daily = df.groupBy(*entity, F.floor(F.col(t) / 24.0).alias("_day")).agg(*ever)
    per = daily.groupBy(*entity).agg(F.count("*").alias("_days"), *[F.sum(f"_d{i}").alias(f"_n{i}") for i in range(len(thresholds))])
    wide = per.agg(F.count("*").alias("n_entities"), F.sum("_days").alias("n_days"), *[F.count_if(F.col(f"_n{i}") > 0).alias(f"_e{i}") for i in range(len(thresholds))],
                   *[F.sum(f"_n{i}").alias(f"_s{i}") for i in range(len(thresholds))])
    rows = F.array(*[F.struct(F.lit(float(th)).alias("threshold"), F.col(f"_e{i}").alias("entities_alerted"), F.col(f"_s{i}").alias("days_alerted")) for i, th in enumerate(thresholds)])
    out = wide.select("n_entities", "n_days", F.inline(rows))
    return (out.withColumn("pct_entities", safe_divide(F.col("entities_alerted") * 100.0, F.col("n_entities")))
            .withColumn("pct_days", safe_divide(F.col("days_alerted") * 100.0, F.col("n_days"))))


def rule_versus_score(df: DataFrame, threshold: float, rule: Column, entity: Sequence[str] = ("entity",), t: str = "t_hr", y: str = "y", p: str = "p") -> DataFrame:
    """On entities the score captures: how often the rule fires before the anchor, which is earlier, and by how much."""
    pos = F.col(y) == 1
    on = F.coalesce(rule, F.lit(False))
    per = df.groupBy(*entity).agg(F.max(F.when(pos, F.col(t))).alias("anchor"), F.min(F.when(F.col(p) >= F.lit(float(threshold)), F.col(t))).alias("_m"),
                                  F.min(F.when(on, F.col(t))).alias("_r"))
    per = per.filter(F.col("anchor").isNotNull())
    before_m, before_r = F.when(F.col("_m") < F.col("anchor"), F.col("_m")), F.when(F.col("_r") < F.col("anchor"), F.col("_r"))
    per = per.select("anchor", before_m.alias("m"), before_r.alias("r"))
    cap, both = F.col("m").isNotNull(), F.col("m").isNotNull() & F.col("r").isNotNull()
    out = per.agg(F.count("*").alias("n_event"), F.count_if(cap).alias("n_captured"), F.count_if(both).alias("n_rule_fired"),
                  F.count_if(both & (F.col("m") < F.col("r"))).alias("n_earlier"), F.percentile(F.when(cap, F.col("anchor") - F.col("m")), 0.5).alias("lead_median"),
                  F.percentile(F.when(both, F.col("anchor") - F.col("r")), 0.5).alias("rule_lead_median"),
                  F.percentile(F.when(both, F.col("r") - F.col("m")), [0.25, 0.5, 0.75]).alias("_g"))
    c = F.col
    return out.select("n_event", "n_captured", "n_rule_fired", "n_earlier", "lead_median", "rule_lead_median",
                      safe_divide(c("n_rule_fired") * 100.0, c("n_captured")).alias("rule_fired_pct"), safe_divide(c("n_earlier") * 100.0, c("n_rule_fired")).alias("earlier_pct"),
                      safe_divide((c("n_captured") - c("n_rule_fired")) * 100.0, c("n_captured")).alias("never_fired_pct"),
                      *[F.element_at("_g", i + 1).alias(n) for i, n in enumerate(("gain_p25", "gain_median", "gain_p75"))])


def rule_lead(df: DataFrame, rule: Column, entity: Sequence[str] = ("entity",), t: str = "t_hr", y: str = "y", onset: str = "onset_hr") -> DataFrame:
    """First alert of a rule on positive checkpoints and its lead to the onset, over event entities."""
    rows = df.filter((F.col(y) == 1) & F.col(onset).isNotNull())
    per = rows.groupBy(*entity).agg((F.min(onset) - F.min(F.when(F.coalesce(rule, F.lit(False)), F.col(t)))).alias("_lead"))
    per = stage(per)
    out = per.agg(F.count("*").alias("n_event"), F.count("_lead").alias("captured"))
    out = join_on(out, quantiles(per, "_lead", LEAD_QUARTILES).drop("n"), [])
    return out.select("n_event", "captured", safe_divide(F.col("captured"), F.col("n_event")).alias("capture"), *LEAD_QUARTILES)


def capture_status() -> Column:
    return F.when(F.col("event") == 0, "event_free").when(F.col("captured") == 1, "captured").otherwise("missed")


def outcome_gradient(alerts: DataFrame, outcomes: DataFrame, entity: Sequence[str] = ("entity",), death: str = "death", los: str = "los",
                     by: Sequence[str] = ()) -> DataFrame:
    """Deaths and median length of stay among captured, missed and event-free entities (median by exact ranks)."""
    joined = join_entities(alerts.withColumn("group", capture_status()), outcomes, entity)
    keys = [*by, "group"]
    joined = stage(joined.select(*keys, death, los))
    counts = joined.groupBy(*keys).agg(F.count("*").alias("n_entities"), F.sum(death).alias("deaths"), (F.avg(death) * 100.0).alias("death_pct"))
    return join_on(counts, quantiles(joined, los, {"los_median": 0.5}, keys).drop("n"), keys, "left")


def outcome_by_band(entities: DataFrame, score: str = "max_p", bins: int = 4, death: str = "death", los: str = "los") -> DataFrame:
    """Outcome by quantile band of the entity's largest score."""
    entities = stage(entities.select(score, death, los))
    banded = quantile_bins(entities, score, bins, name="band")
    counts = banded.groupBy("band").agg(F.count("*").alias("n_entities"), F.sum(death).alias("deaths"), (F.avg(death) * 100.0).alias("death_pct"))
    return join_on(counts, quantiles(banded, los, {"los_median": 0.5}, ["band"]).drop("n"), ["band"])


def exemplars(alerts: DataFrame, classes: Mapping[str, Column], per_class: int = 2, entity: str = "entity") -> DataFrame:
    """Longest trajectories within each lead class (a top-k report)."""
    tag = F.coalesce(*[F.when(c, F.lit(name)) for name, c in classes.items()])
    from tidemark.operators.cleaning import top_per_group

    rows = alerts.filter(F.col("captured") == 1).withColumn("class", tag).filter(F.col("class").isNotNull())
    return top_per_group(rows, ["class"], [F.desc("n_rows"), F.asc(entity)], per_class).select("class", "position", entity, "lead", "n_rows", "anchor")


def entity_summary(scored: DataFrame, entity: Sequence[str] = ("entity",), t: str = "t_hr", p: str = "p_rec", severe: str = "p_severe", threshold: float = 0.15) -> DataFrame:
    """Report row per entity: checkpoints, peak risk, first time at or above the threshold, peak severe score."""
    return scored.groupBy(*entity).agg(F.count("*").alias("n_checkpoints"), F.max(p).alias("peak"),
                                       F.min(F.when(F.col(p) >= F.lit(float(threshold)), F.col(t))).alias("first_at"), F.max(severe).alias("peak_severe"))
