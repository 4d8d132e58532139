"""From series to a checkpoint grid: baselines, event axis, grids, labels and trailing-window features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numeric import fold_of, hour_bin, safe_divide
from tidemark.operators.ordered import join_entities
from tidemark.operators.timeline import bin_rise, rise_over


@dataclass(frozen=True)
class Clock:
    """Hours that define a study. Defaults: 6-hourly checkpoints from 24 h to 168 h, 48 h horizon."""

    start: float = 24.0
    step: float = 6.0
    end: float = 168.0
    lead_out: float = 6.0
    horizon: float = 48.0
    fold: float = 1.5
    rise: float = 0.3
    back: float = 48.0
    carry: float = 96.0


def anchor_hours(series: DataFrame, cohort: DataFrame, entity: str, minutes: str, anchor: str) -> DataFrame:
    """Hours since the entity's anchor from minute offsets."""
    joined = series.join(cohort.select(entity, F.col(anchor).alias("_anchor")), entity)
    return joined.withColumn("hr", (F.col(minutes) - F.col("_anchor")) / 60.0).drop("_anchor")


def baseline(series: DataFrame, keys: Sequence[str], time: str = "hr", value: str = "val", clock: Clock = Clock(),
             earliest: float | None = None) -> DataFrame:
    """Lowest value in ``[0, start]``; without one, the lowest earlier value (optionally not before ``earliest``)."""
    v, t = F.col(value), F.col(time)
    before = t < 0 if earliest is None else (t < 0) & (t > earliest)
    out = series.groupBy(*keys).agg(F.min(F.when(t.between(0.0, clock.start), v)).alias("_in"), F.min(F.when(before, v)).alias("_pre"))
    branch = F.when(F.col("_in").isNotNull(), "window").when(F.col("_pre").isNotNull(), "before").otherwise("none")
    return out.select(*keys, F.coalesce("_in", "_pre").alias("base"), branch.alias("branch"))


def prevalent(series: DataFrame, base: DataFrame, keys: Sequence[str], time: str = "hr", value: str = "val", clock: Clock = Clock(),
              min_values: int = 1) -> DataFrame:
    """Entities that meet the criterion inside the baseline window itself; NULL when nothing can be judged."""
    early = rise_over(series.filter(F.col(time).between(0.0, clock.start) & F.col(value).isNotNull()), keys, time, value, clock.back)
    facts = early.groupBy(*keys).agg(F.max(value).alias("_max"), F.max("rise").alias("_rise"), F.count("*").alias("_n"))
    rose = (F.col("_rise") >= clock.rise) & (F.col("_n") >= min_values)
    hit = (fold_of("_max", "base") >= clock.fold) | rose
    return join_entities(base, facts, keys, "left").select(
        *keys, "base", "branch", F.when(F.col("base").isNotNull() & F.col("_n").isNotNull(), F.when(hit, 1).otherwise(0)).alias("prevalent"))


def _evidence(end: Column, time: str, value: str, clock: Clock, tag: str) -> list[Column]:
    """Aggregates that date the event of one follow-up end: evaluable, first event, evidence at the start only."""
    t, eff = F.col(time), F.greatest(F.col(time), F.lit(clock.start))
    open_window = F.col("base").isNotNull() & (end > clock.start)
    valid = open_window & (t + clock.carry > clock.start) & (t < end)
    by_fold = F.when(valid & (F.col(value) >= clock.fold * F.col("base")), eff)
    by_rise = F.when(open_window & (F.col("rise") >= clock.rise) & (eff > clock.start) & (eff < end), eff)
    return [F.max(F.when(valid, 1).otherwise(0)).alias(f"{tag}ok"),
            F.min(F.least(F.when(by_fold > clock.start, by_fold), by_rise)).alias(f"{tag}event"),
            F.max(F.when(by_fold == clock.start, 1).otherwise(0)).alias(f"{tag}at_start")]


def onset_raw(series: DataFrame, base: DataFrame, keys: Sequence[str], time: str = "hr", value: str = "val", clock: Clock = Clock(),
              cutoff: str | None = None) -> DataFrame:
    """Event time on raw values.

    Evidence at a value: it is at least ``fold`` times the baseline and still valid in the window (carried forward for
    ``carry`` hours), at ``max(hr, start)``; or it rose by ``rise`` within the look-back strictly inside the window.
    The event is the earliest evidence after ``start``; evidence only at ``start`` means carried in.
    Gives ``evaluable``, ``carried_in`` and ``event_hr``. ``cutoff`` names a column of ``base`` that may end follow-up
    earlier; then ``cut_evaluable``, ``cut_carried_in`` and ``cut_event_hr`` come from the same pass.
    """
    rows = rise_over(series.filter(F.col(value).isNotNull()), keys, time, value, clock.back)
    tags = {"": F.lit(clock.end)} | ({"cut_": F.coalesce(F.col(cutoff), F.lit(clock.end))} if cutoff else {})
    facts = join_entities(rows, base, keys).groupBy(*keys).agg(
        *[c for tag, end in tags.items() for c in _evidence(end, time, value, clock, f"_{tag}")])
    out = []
    for tag in tags:
        ok = F.col(f"_{tag}ok") == 1
        carried = ok & F.col(f"_{tag}event").isNull() & (F.col(f"_{tag}at_start") == 1)
        out += [F.col(f"_{tag}ok").alias(f"{tag}evaluable"), F.when(carried, 1).otherwise(0).alias(f"{tag}carried_in"),
                F.when(ok, F.col(f"_{tag}event")).alias(f"{tag}event_hr")]
    return facts.select(*keys, *out)


def onset_bin(series: DataFrame, base: DataFrame, keys: Sequence[str], time: str = "hr", value: str = "val", clock: Clock = Clock()) -> DataFrame:
    """First bin from ``start`` on whose maximum reaches the fold or rises by ``rise`` over the earlier bins. A value at ``end`` would open a bin after
    the follow-up and is left out."""
    rows = series.filter((F.col(time) >= 0) & (F.col(time) < clock.end))
    bins = join_entities(bin_rise(rows, keys, time, value, clock.step, clock.back), base.select(*keys, "base"), list(keys))
    hit = (fold_of("bin_max", "base") >= clock.fold) | (F.col("rise") >= clock.rise)
    return bins.groupBy(*keys).agg(F.min(F.when(hit & (F.col("bin_hr") >= clock.start), F.col("bin_hr"))).alias("onset_hr"))


def onset_rate(buckets: DataFrame, keys: Sequence[str], rate: Column, limit: float = 0.5, first_bucket: int = 4) -> DataFrame:
    """First evaluable bucket with a low rate, and whether one lies before the observation window."""
    low = (F.col("evaluable") == 1) & (rate < limit)
    return buckets.groupBy(*keys).agg(
        F.min(F.when(low & (F.col("bucket") >= first_bucket), F.col("t0_hr"))).cast("double").alias("rate_onset_hr"),
        F.max(F.when(low & (F.col("bucket") < first_bucket), 1).otherwise(0)).alias("rate_prevalent"))


def first_intervention(events: DataFrame, keys: Sequence[str], time: str = "hr", name: str = "stop_hr") -> DataFrame:
    return events.groupBy(*keys).agg(F.min(time).alias(name))


def event_axis(entities: DataFrame, series: DataFrame, keys: Sequence[str], interventions: DataFrame | None = None,
               rate_onset: DataFrame | None = None, time: str = "hr", value: str = "val", clock: Clock = Clock(),
               mark_truncated: bool = False) -> DataFrame:
    """One row per entity: baseline, status, event and combined onset.

    Status is the first failing rule: ``no_series``, ``prevalent_or_no_base``, ``no_evidence``, ``carried_in``,
    ``stopped_before``, ``stop_censored``; otherwise ``event`` or ``no_event`` (``truncated`` when an intervention cut
    an event-free follow-up and ``mark_truncated`` is set).
    """
    keys = list(keys)
    known = series.filter(F.col(value).isNotNull())
    base = prevalent(known, baseline(known, keys, time, value, clock), keys, time, value, clock)
    axis = entities
    if interventions is None:
        axis = axis.withColumn("stop_hr", F.lit(None).cast("double"))
    else:
        axis = join_entities(axis, first_intervention(interventions, keys, time), keys, "left")
    base = join_entities(base, axis.select(*keys, "stop_hr"), keys, "left")
    base = base.withColumn("_cut", F.when(F.col("stop_hr") <= clock.end, F.col("stop_hr"))).drop("stop_hr")
    # The uncut evidence decides evaluability and carry-in, the cut one the event.
    facts = join_entities(base, onset_raw(known, base, keys, time, value, clock, "_cut").drop("event_hr"), keys, "left")
    out = join_entities(axis, facts.withColumn("_has", F.lit(1)), keys, "left")
    status = (
        F.when(F.col("_has").isNull(), "no_series")
        .when(F.col("base").isNull() | F.col("prevalent").isNull() | (F.col("prevalent") == 1), "prevalent_or_no_base")
        .when(F.coalesce("evaluable", F.lit(0)) == 0, "no_evidence")
        .when(F.col("carried_in") == 1, "carried_in")
        .when(F.col("stop_hr") <= clock.start, "stopped_before")
        .when((F.col("cut_evaluable") == 0) | (F.col("cut_carried_in") == 1), "stop_censored")
        .when(F.col("cut_event_hr").isNotNull(), "event"))
    if mark_truncated:
        status = status.when(F.col("_cut").isNotNull(), "truncated")
    out = out.withColumn("status", status.otherwise("no_event"))
    kept = F.col("status").isin("event", "no_event", "truncated")
    out = out.withColumn("event_hr", F.when(kept, F.col("cut_event_hr")))
    if rate_onset is None:
        out = out.withColumn("rate_onset_hr", F.lit(None).cast("double")).withColumn("rate_prevalent", F.lit(0))
    else:
        out = join_entities(out, rate_onset, keys, "left").withColumn("rate_prevalent", F.coalesce("rate_prevalent", F.lit(0)))
    return out.select(*entities.columns, "base", "branch", "prevalent", "stop_hr", "status", "event_hr", "rate_onset_hr", "rate_prevalent",
                      F.least("event_hr", "rate_onset_hr").alias("onset_hr"))


def bin_axis(entities: DataFrame, series: DataFrame, keys: Sequence[str], interventions: DataFrame | None = None, earliest: float | None = -24.0,
             min_values: int = 2, time: str = "hr", value: str = "val", clock: Clock = Clock()) -> DataFrame:
    """One row per entity: baseline, status and the bin of the onset, for studies that date events on the bins of the grid.

    Values count after ``earliest`` and up to the end. Prevalence by a rise needs ``min_values`` values in the baseline window; a baseline from before it
    leaves prevalence unjudged, which excludes nobody. Status is the first that holds: ``no_series``, ``no_base``, ``prevalent``, ``stopped_before``;
    otherwise ``event`` or ``no_event``. The onset is kept for the last two only.
    """
    keys = list(keys)
    inside = F.col(time) <= clock.end if earliest is None else (F.col(time) > earliest) & (F.col(time) <= clock.end)
    known = series.filter(F.col(value).isNotNull() & inside)
    base = prevalent(known, baseline(known, keys, time, value, clock, earliest), keys, time, value, clock, min_values)
    onset = onset_bin(known, base, keys, time, value, clock)
    axis = entities.withColumn("stop_hr", F.lit(None).cast("double")) if interventions is None else join_entities(entities, first_intervention(interventions, keys, time), keys, "left")
    out = join_entities(join_entities(axis, base.withColumn("_has", F.lit(1)), keys, "left"), onset.withColumnRenamed("onset_hr", "_onset"), keys, "left")
    status = (F.when(F.col("_has").isNull(), "no_series").when(F.col("base").isNull(), "no_base").when(F.col("prevalent") == 1, "prevalent")
              .when(F.col("stop_hr") <= clock.start, "stopped_before").when(F.col("_onset").isNotNull(), "event").otherwise("no_event"))
    out = out.withColumn("status", status)
    return out.select(*entities.columns, "base", "branch", "prevalent", "stop_hr", "status", F.when(F.col("status") == "event", F.col("_onset")).alias("onset_hr"))


def at_risk(axis: DataFrame) -> DataFrame:
    return axis.filter(F.col("status").isin("event", "no_event", "truncated") & (F.col("rate_prevalent") == 0))


def grid(axis: DataFrame, los: str = "los_h", onset: str = "onset_hr", stop: str = "stop_hr", clock: Clock = Clock(),
         include_onset: bool = False) -> DataFrame:
    """Checkpoints from ``start`` to ``min(los - lead_out, end)``, stopping before (or at) the onset and before an
    intervention. Each entity gives at most ``(end - start) / step + 1`` rows."""
    last = F.least(F.col(los) - clock.lead_out, F.lit(clock.end))
    steps = F.floor((last - clock.start) / clock.step + 1e-9).cast("int")
    long_enough = axis.filter(last >= clock.start)
    rows = long_enough.withColumn("t_hr", F.explode(F.transform(F.sequence(F.lit(0), steps), lambda i: i * clock.step + clock.start)))
    before = F.col("t_hr") <= F.col(onset) if include_onset else F.col("t_hr") < F.col(onset)
    keep = F.col(onset).isNull() | before
    if stop is not None:
        keep = keep & (F.col(stop).isNull() | (F.col("t_hr") < F.col(stop)))
    return rows.filter(keep)


def horizon_label(t: str = "t_hr", onset: str = "onset_hr", horizon: float = 48.0) -> Column:
    ahead = F.col(onset) - F.col(t)
    return F.when((ahead > 0) & (ahead <= horizon), 1).otherwise(0)


def stage_labels(grid_rows: DataFrame, series: DataFrame, keys: Sequence[str], base: str = "base", t: str = "t_hr", time: str = "hr",
                 value: str = "val", clock: Clock = Clock(), rows: int = 8, include_current: bool = True, legacy: bool = False,
                 high: float = 4.0, floor: float = 0.1) -> DataFrame:
    """Graded forward label: stage 0-3 of the largest bin maximum on the current and following grid rows.

    ``legacy`` grades a value of at least ``high`` as stage 3 even without the stage 1 criterion;
    ``include_current=False`` looks strictly into the future.
    """
    keys = list(keys)
    maxima = (series.filter(F.col(value).isNotNull()).withColumn(t, hour_bin(time, clock.step)).groupBy(*keys, t).agg(F.max(value).alias("_v")))
    on_grid = join_entities(grid_rows, maxima, [*keys, t], "left")
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(0 if include_current else 1, rows)
    f = F.max("_v").over(w)
    out = on_grid.withColumn("forward", f)
    fold = F.col("forward") / F.greatest(F.col(base), F.lit(floor))
    first = F.coalesce((fold >= clock.fold) | (F.col("forward") - F.col(base) >= clock.rise), F.lit(False))
    third = (fold >= 3.0) | ((F.col("forward") >= high) if legacy else ((F.col("forward") >= high) & first))
    stage = F.when(F.col("forward").isNull(), 0).when(third, 3).when(fold >= 2.0, 2).when(first, 1).otherwise(0)
    out = out.withColumn("stage", stage)
    return out.select(*grid_rows.columns, "forward", "stage", *[F.when(F.col("stage") >= k, 1).otherwise(0).alias(f"ge{k}") for k in (1, 2, 3)])


# ---------------------------------------------------------------- features

STATS = ("last", "min", "max", "delta", "slope", "n", "h_last", "sd", "cv")
#: Statistics that are sums and extremes of bin summaries.
PLAIN = frozenset({"last", "min", "max", "n", "h_last"})


def one_place(line: DataFrame, entity: Sequence[str]) -> DataFrame:
    """One shuffle by entity for windows per family, the pivot and later joins per checkpoint.

    The rows are grid rows and bin summaries, a bounded number per entity, so no entity can overfill a task.
    """
    return line.repartition(*entity)


def bin_index(clock: Clock) -> Column:
    """Whole number of the checkpoint bin, so that window frames have whole borders."""
    return F.round(F.col("t_hr") / clock.step).cast("long")


def bin_summaries(series: DataFrame, keys: Sequence[str], clock: Clock, time: str = "hr", value: str = "val") -> DataFrame:
    """Mergeable summaries per (key, checkpoint bin ``(t - step, t]``), combined on the map side.

    Means and centred moments keep the slope and the spread accurate. First and last are ordered by (time, value), so values at one time
    give the same summary in any order of the rows.
    """
    step = clock.step
    t_bin = F.ceil(F.col(time) / step) * float(step)
    x, v = F.col(time) - F.col("t_hr"), F.col(value)
    order = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    ends = [F.min(order).alias("b_first"), F.max(order).alias("b_last")]
    rows = series.filter(v.isNotNull() & F.col(time).isNotNull()).withColumn("t_hr", t_bin.cast("double"))
    moments = {"b_n": F.count("*"), "b_min": F.min(v), "b_max": F.max(v), "b_mean": F.avg(v), "b_x": F.avg(x), "b_var": F.var_pop(v),
               "b_xvar": F.var_pop(x), "b_cov": F.covar_pop(x, v)}
    return rows.groupBy(*keys, "t_hr").agg(*[c.alias(n) for n, c in moments.items()], *ends)


def window_features(grid_rows: DataFrame, series: DataFrame, entity: Sequence[str], families: Sequence[str], width: float = 24.0,
                    clock: Clock = Clock(), fam: str = "fam", time: str = "hr", value: str = "val", wide_width: float | None = None,
                    locf: bool = True, stats: Sequence[str] = STATS) -> DataFrame:
    """Trailing-window statistics per checkpoint and family, long form.

    ``(t - width, t]``: last, min, max, delta, slope, n, h_last, sd, cv; with ``wide_width`` also last48, delta48,
    slope48 and sd48; with ``locf`` the last value ever seen and its age. Samples are first reduced to one summary row
    per checkpoint bin, so what is shuffled and windowed no longer depends on how many samples an entity has. Window
    widths must be whole multiples of the grid step; other widths go through ``window_features_exact``. Where the
    ``stats`` asked for are all in ``PLAIN`` (without ``wide_width`` and ``locf``), summaries carry no moments and windows no lists.
    """
    entity = list(entity)
    for w in (width, *([wide_width] if wide_width else [])):
        if abs(w / clock.step - round(w / clock.step)) > 1e-9:
            raise ValueError("window width must be a multiple of the grid step")
    keys = [*entity, fam]
    plain = wide_width is None and not locf and PLAIN.issuperset(stats)
    bins = bin_summaries(series.filter(F.col(fam).isin(list(families))), keys, clock, time, value)
    if plain:
        bins = bins.select(*keys, "t_hr", "b_n", "b_min", "b_max", "b_last")
    spine = grid_rows.select(*entity, F.col("t_hr").cast("double").alias("t_hr")).withColumn(
        fam, F.explode(F.array(*[F.lit(f) for f in families]))).withColumn("_grid", F.lit(True))
    line = one_place(spine.unionByName(bins.withColumn("_grid", F.lit(False)), allowMissingColumns=True), entity)
    part = Window.partitionBy(*keys).orderBy(bin_index(clock))
    if plain:
        over = part.rangeBetween(1 - round(width / clock.step), 0)
        last = F.max("b_last").over(over)
        table = {"last": last["v"], "min": F.min("b_min").over(over), "max": F.max("b_max").over(over), "n": F.sum("b_n").over(over), "h_last": F.col("t_hr") - last["t"]}
        return line.select(*keys, "t_hr", "_grid", *[table[s].alias(s) for s in stats]).filter("_grid").drop("_grid")
    cols = []
    for tag, w in (("a", width), ("b", wide_width)):
        if w is None:
            continue
        over = part.rangeBetween(1 - round(w / clock.step), 0)
        cols.append(F.collect_list(F.when(~F.col("_grid"), F.struct(
            "t_hr", "b_n", "b_min", "b_max", "b_first", "b_last", "b_mean", "b_x", "b_var", "b_xvar", "b_cov"))).over(over).alias(f"_{tag}"))
    if locf:
        cols.append(F.max("b_last").over(part.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("_ever"))
    framed = line.select("*", *cols).filter("_grid")
    # Counts and means become columns first, so the second moments do not recompute them per element.
    for tag in ("_a", "_b") if wide_width else ("_a",):
        framed = framed.withColumn(f"{tag}_n", _fold(tag, lambda b: b["b_n"]))
        framed = framed.withColumns({
            f"{tag}_m": safe_divide(_fold(tag, lambda b: b["b_n"] * b["b_mean"]), F.col(f"{tag}_n")),
            f"{tag}_x": safe_divide(_fold(tag, lambda b: b["b_n"] * (b["b_x"] + b["t_hr"])), F.col(f"{tag}_n")),
            f"{tag}_first": F.array_min(F.transform(tag, lambda b: b["b_first"])),
            f"{tag}_last": F.array_max(F.transform(tag, lambda b: b["b_last"]))})
    return framed.select(
        *keys, "t_hr", *_statistics("_a", "", stats), *(_statistics("_b", "48", ("last", "delta", "slope", "sd")) if wide_width else []),
        *([F.col("_ever.v").alias("locf"), (F.col("t_hr") - F.col("_ever.t")).alias("locf_age")] if locf else []))


def _fold(col: str, term) -> Column:
    return F.aggregate(F.col(col), F.lit(0.0), lambda s, b: s + term(b))


def _statistics(tag: str, suffix: str, stats: Sequence[str] = STATS) -> list[Column]:
    """Statistics of one window from its bin summaries: moments within bins plus moments between them."""
    n, mean, mean_x = F.col(f"{tag}_n"), F.col(f"{tag}_m"), F.col(f"{tag}_x")
    first, last = F.col(f"{tag}_first"), F.col(f"{tag}_last")

    def dx(b):
        return b["b_x"] + b["t_hr"] - mean_x

    def dv(b):
        return b["b_mean"] - mean

    ss = _fold(tag, lambda b: b["b_n"] * (b["b_var"] + dv(b) * dv(b)))
    sx = _fold(tag, lambda b: b["b_n"] * (b["b_xvar"] + dx(b) * dx(b)))
    sxy = _fold(tag, lambda b: b["b_n"] * (b["b_cov"] + dx(b) * dv(b)))
    sd = F.when(n >= 2, F.sqrt(ss / (n - 1)))
    some = n > 0
    table = {
        "last": last["v"], "min": F.array_min(F.transform(tag, lambda b: b["b_min"])), "max": F.array_max(F.transform(tag, lambda b: b["b_max"])),
        "delta": last["v"] - first["v"],
        "slope": F.when(some, F.when((n >= 2) & (last["t"] > first["t"]), safe_divide(sxy, sx)).otherwise(F.lit(0.0))),
        "n": F.when(some, n.cast("long")), "h_last": F.col("t_hr") - last["t"], "sd": sd, "cv": F.when(F.abs(mean) > 1e-9, sd / F.abs(mean)),
    }
    return [table[s].alias(f"{s}{suffix}") for s in stats]


def window_features_exact(grid_rows: DataFrame, series: DataFrame, entity: Sequence[str], width: float, fam: str = "fam", time: str = "hr",
                          value: str = "val") -> DataFrame:
    """The same statistics for any width and any point times, through the slotted range join.

    Gives rows only where the window holds a value. Fan-out is two slots per point.
    """
    from tidemark.operators.timeline import trailing_join

    keys = list(entity)
    hit = trailing_join(grid_rows.select(*keys, "t_hr"), series.filter(F.col(value).isNotNull()), keys, width, time=time)
    order = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    v, x = F.col(value), F.col(time)
    agg = hit.groupBy(*keys, fam, "t_hr").agg(
        F.max(order).alias("_l"), F.min(order).alias("_f"), F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("n"),
        F.regr_slope(v, x).alias("_s"), F.stddev_samp(v).alias("sd"), F.avg(v).alias("_m"))
    return agg.select(
        *keys, fam, "t_hr", F.col("_l.v").alias("last"), "min", "max", (F.col("_l.v") - F.col("_f.v")).alias("delta"),
        F.when((F.col("n") >= 2) & (F.col("_l.t") > F.col("_f.t")), F.col("_s")).otherwise(F.lit(0.0)).alias("slope"), "n",
        (F.col("t_hr") - F.col("_l.t")).alias("h_last"), "sd", F.when(F.abs("_m") > 1e-9, F.col("sd") / F.abs("_m")).alias("cv"))


def widen(long: DataFrame, entity: Sequence[str], families: Sequence[str], stats: Sequence[str], fam: str = "fam") -> DataFrame:
    """Wide feature table ``{fam}_{stat}`` with a declared schema: a family without data gives typed NULL columns."""
    pivot = long.groupBy(*entity, "t_hr").pivot(fam, list(families)).agg(*[F.first(s, ignorenulls=True).alias(s) for s in stats])
    if len(stats) == 1:
        pivot = pivot.select(*entity, "t_hr", *[F.col(f"`{f}`").alias(f"{f}_{stats[0]}") for f in families])
    return pivot


def versus_base(last: str, base: str, prefix: str) -> list[Column]:
    """Ratio and difference to the baseline where the window holds a value."""
    return [safe_divide(F.col(last), F.col(base)).alias(f"{prefix}_ratio_base"), (F.col(last) - F.col(base)).alias(f"{prefix}_delta_base")]


def event_counts(grid_rows: DataFrame, events: DataFrame, entity: Sequence[str], families: Sequence[str], width: float = 24.0,
                 clock: Clock = Clock(), fam: str = "fam", time: str = "hr", cumulative: bool = True) -> DataFrame:
    """Per checkpoint and family: events in ``(t - width, t]``, any in the window, ever before; zero-filled."""
    return windowed_sums(grid_rows, events, entity, families, (width,), clock, fam, time, None).select(
        *entity, "t_hr", fam, F.col(f"n_{int(width)}").alias("n"), F.when(F.col(f"n_{int(width)}") > 0, 1).otherwise(0).alias("any"),
        F.when(F.col("n_ever") > 0, 1).otherwise(0).alias("ever"))


def windowed_sums(grid_rows: DataFrame, events: DataFrame, entity: Sequence[str], families: Sequence[str], widths: Sequence[float],
                  clock: Clock = Clock(), fam: str = "fam", time: str = "hr", value: str | None = "val") -> DataFrame:
    """Counts and sums of a family over several trailing widths and since the start.

    ``n_{w}``, ``sum_{w}`` (NULL without a row in the window), ``n_ever``, ``sum_ever``. Widths are multiples of the step;
    samples are summed per bin before the shuffle.
    """
    entity = list(entity)
    keys = [*entity, fam]
    amount = F.lit(1.0) if value is None else F.col(value)
    rows = events.filter(F.col(fam).isin(list(families))).withColumn("t_hr", (F.ceil(F.col(time) / clock.step) * float(clock.step)).cast("double"))
    bins = rows.groupBy(*keys, "t_hr").agg(F.count("*").alias("_n"), F.sum(amount).alias("_v"))
    spine = grid_rows.select(*entity, F.col("t_hr").cast("double").alias("t_hr")).withColumn(
        fam, F.explode(F.array(*[F.lit(f) for f in families]))).withColumn("_grid", F.lit(True))
    line = one_place(spine.unionByName(bins.withColumn("_grid", F.lit(False)), allowMissingColumns=True), entity)
    part = Window.partitionBy(*keys).orderBy(bin_index(clock))
    cols = []
    for w in widths:
        over = part.rangeBetween(1 - round(w / clock.step), 0)
        cols += [F.coalesce(F.sum("_n").over(over), F.lit(0)).alias(f"n_{int(w)}"), F.sum("_v").over(over).alias(f"sum_{int(w)}")]
    ever = part.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cols += [F.coalesce(F.sum("_n").over(ever), F.lit(0)).alias("n_ever"), F.coalesce(F.sum("_v").over(ever), F.lit(0.0)).alias("sum_ever")]
    return line.select("*", *cols).filter("_grid").drop("_grid", "_n", "_v")


def rate_per_weight(total: str, hours: float, weight: str) -> Column:
    """Amount per weight and hour; NULL without rows in the window or with a weight that is not positive."""
    return F.when(F.col(weight) > 0, F.col(total) / (F.lit(float(hours)) * F.col(weight)))


def net_balance(inflow: str, outflow: str, weight: str) -> Column:
    return F.when(F.col(weight) > 0, (F.col(inflow) - F.col(outflow)) / F.col(weight))


def visibility(t: str = "t_hr", los: str = "los_h", clock: Clock = Clock()) -> Column:
    """How much of the label horizon can be observed: complete, cut by the length of stay, or cut by the window."""
    seen = F.col(t) + clock.horizon <= F.least(F.col(los), F.lit(clock.end))
    return F.when(seen, "complete").when(F.col(t) > F.col(los) - clock.horizon, "los_truncated").otherwise("window_capped")


def event_subtype(first: str, second: str) -> Column:
    a, b = F.col(first).isNotNull(), F.col(second).isNotNull()
    return F.when(a & b, "dual").when(a, "a_only").when(b, "b_only").otherwise("none")


def rebuild_mismatch(stored: DataFrame, rebuilt: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9, limit: float = 0.005) -> DataFrame:
    """Share of entities whose rebuilt value differs from the stored one, missing compared with missing."""
    pair = join_entities(stored.select(*keys, F.col(value).alias("_a")), rebuilt.select(*keys, F.col(value).alias("_b")), keys, "left")
    differs = (F.col("_a").isNull() != F.col("_b").isNull()) | F.coalesce(F.abs(F.col("_a") - F.col("_b")) > tolerance, F.lit(False))
    out = pair.agg(F.count("*").alias("n"), F.count_if(differs).alias("mismatches"))
    rate = safe_divide(F.col("mismatches"), F.col("n"))
    return out.withColumn("rate", rate).withColumn("ok", F.when(rate <= limit, 1).otherwise(0))


def evaluability(rows: DataFrame, entity: Sequence[str], observed: str, label: str) -> DataFrame:
    """Checkpoints without the analyte in their window, those labelled positive, and entities without it throughout."""
    missing = F.col(observed).isNull()
    per = rows.groupBy(*entity).agg(F.count("*").alias("_n"), F.count_if(missing).alias("_m"), F.count_if(missing & (F.col(label) == 1)).alias("_p"))
    return per.agg(F.sum("_n").alias("n"), F.sum("_m").alias("n_missing"), F.sum("_p").alias("n_missing_positive"),
                   F.count_if(F.col("_n") == F.col("_m")).alias("entities_without"))


def grid_audit(rows: DataFrame, entity: Sequence[str], label: str = "label", onset: str = "onset_hr", t: str = "t_hr", clock: Clock = Clock()) -> DataFrame:
    """Checkpoints per entity, distance of the last checkpoint to the onset in whole grid steps, positives at or after it.

    Both medians are over small whole numbers of grid steps, so the exact percentile keeps few distinct values.
    """
    per = rows.groupBy(*entity).agg(F.count("*").alias("_n"), F.max(t).alias("_last"), F.min(onset).alias("_onset"),
                                    F.count_if((F.col(label) == 1) & (F.col(t) >= F.col(onset))).alias("_after"))
    gap = F.floor((F.col("_onset") - F.col("_last")) / clock.step) * clock.step
    return per.agg(F.count("*").alias("entities"), F.sum("_n").alias("checkpoints"), F.min("_n").alias("min_n"), F.percentile("_n", 0.5).alias("median_n"),
                   F.max("_n").alias("max_n"), F.count("_onset").alias("with_onset"), F.percentile(gap, 0.5).alias("median_gap"),
                   F.sum("_after").alias("positive_after_onset"))


def coverage(features: DataFrame, wanted: Sequence[str], least: float = 0.5) -> DataFrame:
    """Wanted feature columns that are absent, or present with low coverage."""
    from tidemark.operators.cleaning import missing_shares, small_table

    have = [c for c in wanted if c in features.columns]
    table = missing_shares(features, have).select("column", (1 - F.col("share")).alias("coverage")) if have else None
    names = small_table(features.sparkSession, [(c,) for c in wanted], "column string")
    joined = names.join(table, "column", "left") if table is not None else names.withColumn("coverage", F.lit(None).cast("double"))
    status = F.when(F.col("coverage").isNull(), "missing").when(F.col("coverage") < least, "low").otherwise("ok")
    return joined.withColumn("status", status)


def align(features: DataFrame, wanted: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Cast to the declared feature list; absent features become typed NULL columns, text that is no number NULL."""
    names = list(wanted)
    others = [c for c in features.columns if c not in names]
    return features.select(*others, *[(F.col(c).try_cast("double") if c in features.columns else F.lit(None).cast("double")).alias(c) for c in names])
