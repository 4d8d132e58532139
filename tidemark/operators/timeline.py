"""Joins and windows along time: as-of, trailing ranges, intervals, look-back extremes, hourly buckets.

An entity may hold a very large share of the rows, so no operator here gives a whole entity to one task: time is
cut into slots, each (entity, slot) is handled on its own, and what must cross a slot border is carried over as one
value per slot or copied into the neighbouring slot. A slot that holds more rows than a task should take is cut
again, into pieces at quantiles of its own times, with carried values from piece to piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import stage

DAY = 24
ROWS_PER_SLOT = 1_000_000


def time_slot(col, width: float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(float(width))).cast("long")


def cut_busy(tables: Sequence[DataFrame], keys: Sequence[str], time: str = "_t", rows_per_slot: int | None = ROWS_PER_SLOT) -> tuple[list[DataFrame], list[str]]:
    """The tables with their place: ``_slot``, and ``_piece`` within it if some slot has more than ``rows_per_slot`` rows; and the names of the place.

    All tables count together and share the cuts. Equal times never part, so an instant is the smallest piece. Cuts are approximate quantiles of the
    times in a busy slot; they are staged, since every table must see the same ones, and decide how even the pieces are, never a result. There is
    one row of cuts per busy slot, of which there are at most rows / ``rows_per_slot``; the driver sees the largest count only.
    """
    tables, place = list(tables), [*keys, "_slot"]
    if rows_per_slot is None:
        return tables, ["_slot"]
    times = tables[0].select(*place, time)
    for t in tables[1:]:
        times = times.unionAll(t.select(*place, time))
    counts = times.groupBy(*place).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    if most <= rows_per_slot:
        return tables, ["_slot"]
    pieces = -(-most // rows_per_slot)
    busy = counts.filter(F.col("_n") > rows_per_slot).select(*[F.col(k).alias(f"_c_{k}") for k in place])
    same = F.lit(True)
    for k in place:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    fractions = [i / pieces for i in range(1, pieces)]
    borders = F.percentile_approx(time, fractions, max(1000, 4 * pieces))
    cuts = stage(times.join(busy, same, "left_semi").groupBy(*[F.col(k).alias(f"_c_{k}") for k in place]).agg(F.array_distinct(borders).alias("_cuts")))
    number = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(time))), F.lit(0))
    return [t.join(cuts, same, "left").withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(number)).drop("_cuts", *[f"_c_{k}" for k in place])
            for t in tables], ["_slot", "_piece"]


def as_of(points: DataFrame, series: DataFrame, keys: Sequence[str], at: str = "t_hr", time: str = "hr", value: str = "val",
          width: float = 24.0, name: str = "locf", tie: Sequence[str] = (), rows_per_slot: int | None = ROWS_PER_SLOT) -> DataFrame:
    """Last value at or before each point, with its age (``{name}``, ``{name}_age``).

    Points and series meet in one timeline per (key, slot). Inside a slot a window carries the last value forward;
    a slot that starts without one takes the last value of the nearest earlier slot, found on slot summaries.
    Equal times are ordered by ``tie`` and then by value. Busy slots are cut into pieces (``cut_busy``), which are then what is called a slot here.
    """
    keys = list(keys)
    obs = series.filter(F.col(value).isNotNull()).select(
        *keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(tie)],
                                                  F.col(value).alias("v")).alias("_obs"))
    obs = obs.withColumn("_slot", time_slot("_t", width))
    grid = points.withColumn("_t", F.col(at).cast("double")).withColumn("_slot", time_slot("_t", width))

    (obs, grid), place = cut_busy([obs, grid], keys, rows_per_slot=rows_per_slot)
    per_slot = obs.groupBy(*keys, *place).agg(F.max("_obs").alias("_last"))
    visited = grid.select(*keys, *place).distinct()
    summary = per_slot.unionByName(visited, allowMissingColumns=True).groupBy(*keys, *place).agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    # The value carried into a slot enters its timeline as the first observation.
    carried = summary.select(*keys, *place, (F.col("_slot") * F.lit(float(width))).alias("_t"), F.max("_last").over(earlier).alias("_obs"))
    line = obs.unionByName(carried).withColumn("_is_point", F.lit(False))

    # Struct order starts with time, so "last so far" is a running maximum and peers at the point's time are included.
    merged = grid.withColumn("_is_point", F.lit(True)).unionByName(line, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, *place).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = merged.withColumn("_best", F.max("_obs").over(inside)).filter("_is_point")
    return out.select(*points.columns, F.col("_best.v").alias(name), (F.col("_t") - F.col("_best.t")).alias(f"{name}_age"))


def trailing_join(points: DataFrame, series: DataFrame, keys: Sequence[str], width: float, at: str = "t_hr", time: str = "hr",
                  how: str = "inner") -> DataFrame:
    """Range join on ``at - width < time <= at``.

    Both sides are cut into slots of the window width, so a point needs its own slot and the one before; the join is
    an equi-join on (key, slot) and the range test filters what is left. Busy (key, slot) pairs are split by Spark's skew join.
    """
    keys = list(keys)
    sides = points.withColumn("_s", time_slot(at, width)).withColumn("_s", F.explode(F.array(F.col("_s"), F.col("_s") - 1)))
    right = series.withColumn("_s", time_slot(time, width))
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in [*keys, "_s"]], *[c for c in right.columns if c not in [*keys, "_s"]])
    cond = (F.col(time) > F.col(at) - width) & (F.col(time) <= F.col(at))
    for k in [*keys, "_s"]:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    joined = sides.join(renamed, cond, "inner").drop("_s", *[f"_r_{k}" for k in [*keys, "_s"]])
    if how == "inner":
        return joined
    point_cols = points.columns
    extra = [c for c in joined.columns if c not in point_cols]
    missing = points.join(joined.select(*point_cols).distinct(), point_cols, "left_anti") if extra else points
    return joined.unionByName(missing, allowMissingColumns=True)


def interval_active(points: DataFrame, intervals: DataFrame, keys: Sequence[str], start: str = "start_hr", end: str = "end_hr",
                    at: str = "t_hr", width: float = 24.0, name: str = "on") -> DataFrame:
    """1 when some interval with ``start <= at < end`` covers the point, else 0.

    Active intervals are counted, not matched: +1 at a start, -1 at an end, and a running sum in time order.
    """
    keys = list(keys)
    valid = intervals.filter(F.col(end) > F.col(start))
    edges = valid.select(*keys, F.inline(F.array(
        F.struct(F.col(start).alias("_t"), F.lit(1).alias("_d")), F.struct(F.col(end).alias("_t"), F.lit(-1).alias("_d")))))
    counted = running_total(points, edges, keys, at, "_t", {"_open": F.col("_d")}, width)
    return counted.withColumn(name, F.when(F.col("_open") > 0, 1).otherwise(0)).drop("_open")


def running_total(points: DataFrame, events: DataFrame, keys: Sequence[str], at: str, time: str, sums: dict, width: float = 24.0,
                  rows_per_slot: int | None = ROWS_PER_SLOT) -> DataFrame:
    """Sums over all events with ``time <= at`` for each point; 0 when there is none.

    Slot totals are accumulated per key; inside the point's own slot a window adds the events up to the point. Busy slots are cut into pieces
    (``cut_busy``).
    """
    keys = list(keys)
    ev = events.select(*keys, F.col(time).cast("double").alias("_time"), *[c.alias(n) for n, c in sums.items()])
    ev = ev.withColumn("_slot", time_slot("_time", width))
    # Events at one instant are combined first, so a burst of equal times is one row.
    ev = ev.groupBy(*keys, "_slot", "_time").agg(*[F.sum(n).alias(n) for n in sums])
    grid = points.withColumn("_time", F.col(at).cast("double")).withColumn("_slot", time_slot("_time", width))

    (ev, grid), place = cut_busy([ev, grid], keys, "_time", rows_per_slot)
    totals = ev.groupBy(*keys, *place).agg(*[F.sum(n).alias(n) for n in sums])
    slots = totals.unionByName(grid.select(*keys, *place).distinct(), allowMissingColumns=True)
    slots = slots.groupBy(*keys, *place).agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*keys, *place, (F.col("_slot") * F.lit(float(width))).alias("_time"),
                           *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])
    line = ev.unionByName(carried).withColumn("_is_point", F.lit(False))

    merged = grid.withColumn("_is_point", F.lit(True)).unionByName(line, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, *place).orderBy("_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = merged.select(*points.columns, "_is_point", *[F.sum(n).over(inside).alias(n) for n in sums])
    return seen.filter("_is_point").drop("_is_point")


MERGES = {"min": (F.min, F.least), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def look_back(df: DataFrame, keys: Sequence[str], time: str, columns: dict, back: float, rows_per_slot: int | None = ROWS_PER_SLOT) -> DataFrame:
    """Aggregates over ``[time - back, time]`` on raw rows, e.g. ``{"low": ("min", "val")}`` (min, max or sum).

    Slots have the width of the look-back, so a window is the end of one slot and the beginning of the next. Both parts
    are running aggregates, whatever the number of rows in a window: forwards over the row's own slot, backwards over
    the slot before, whose rows are copied one slot on. One entity is spread over as many tasks as it has slots, and a
    busy slot over several (``cut_busy``): what earlier pieces hold of the slot, and later pieces of the slot before, enters a piece as one row each.
    """
    keys = list(keys)
    slot = time_slot(time, back)
    t = F.col(time).cast("double")
    copies = F.array(F.struct(slot.alias("_slot"), t.alias("_t"), F.lit(True).alias("_own")),
                     F.struct((slot + 1).alias("_slot"), (t + float(back)).alias("_t"), F.lit(False).alias("_own")))
    spread = df.select("*", F.inline(copies))
    (spread,), place = cut_busy([spread], keys, rows_per_slot=rows_per_slot)
    values = {n: f"_v_{n}" for n in columns}
    spread = spread.withColumns({values[n]: F.col(col) for n, (_, col) in columns.items()}).withColumn("_row", F.lit(True))
    if len(place) > 1:
        spread = spread.unionByName(carried_pieces(spread, keys, values, columns), allowMissingColumns=True)
    part = Window.partitionBy(*keys, *place)
    to_here = part.orderBy(F.asc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = part.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = spread
    for name, (kind, _) in columns.items():
        agg, merge = MERGES[kind]
        out = out.withColumn(name, merge(agg(F.when(F.col("_own"), F.col(values[name]))).over(to_here), agg(F.when(~F.col("_own"), F.col(values[name]))).over(from_here)))
    return out.filter("_own AND _row").drop("_own", "_t", "_row", *place, *values.values())


def carried_pieces(spread: DataFrame, keys: Sequence[str], values: dict, columns: dict) -> DataFrame:
    """Two rows per piece of a slot: the slot's own rows in earlier pieces, placed before the piece, and the copied ones in later pieces, placed after it."""
    own, aggs = F.col("_own"), {n: MERGES[kind][0] for n, (kind, _) in columns.items()}
    each = spread.groupBy(*keys, "_slot", "_piece").agg(*[aggs[n](F.when(side, F.col(v))).alias(f"{tag}{v}") for n, v in values.items() for tag, side in (("o", own), ("c", ~own))])
    slot = Window.partitionBy(*keys, "_slot").orderBy("_piece")
    earlier, later = slot.rowsBetween(Window.unboundedPreceding, -1), slot.rowsBetween(1, Window.unboundedFollowing)

    def row(at, is_own, tag, over):
        return F.struct(F.lit(at).alias("_t"), F.lit(is_own).alias("_own"), F.lit(False).alias("_row"), *[aggs[n](f"{tag}{v}").over(over).alias(v) for n, v in values.items()])

    both = each.withColumns({"_before": row(float("-inf"), True, "o", earlier), "_after": row(float("inf"), False, "c", later)})
    return both.select(*keys, "_slot", "_piece", F.inline(F.array("_before", "_after")))


def rise_over(df: DataFrame, keys: Sequence[str], time: str = "hr", value: str = "val", back: float = 48.0, name: str = "rise") -> DataFrame:
    """Value minus the lowest value of the look-back window (the row itself included)."""
    return look_back(df, keys, time, {"_low": ("min", value)}, back).withColumn(name, F.col(value) - F.col("_low")).drop("_low")


def bin_rise(df: DataFrame, keys: Sequence[str], time: str = "hr", value: str = "val", width: float = 6.0, back: float = 48.0) -> DataFrame:
    """Bin maximum and its rise over the lowest bin maximum of the look-back; empty bins are skipped."""
    keys = list(keys)
    binned = df.filter(F.col(value).isNotNull()).withColumn("bin_hr", F.floor(F.col(time) / width) * float(width))
    maxima = binned.groupBy(*keys, "bin_hr").agg(F.max(value).alias("bin_max"))
    return rise_over(maxima.withColumn("bin_hr", F.col("bin_hr").cast("double")), keys, "bin_hr", "bin_max", back)


def forward_max(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int = 8, include_current: bool = True,
                name: str = "forward") -> DataFrame:
    """Largest value over the current and the next ``rows`` grid rows (or only the next ones).

    A grid has a fixed number of checkpoints per entity, so a partition by entity is bounded.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0 if include_current else 1, rows)
    return df.withColumn(name, F.max(value).over(w))


def spread_back(df: DataFrame, keys: Sequence[str], columns: dict) -> DataFrame:
    """Group aggregates on every row of the group: aggregate first (map-side combined), then join back."""
    keys = list(keys)
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()]), keys)


def covered_buckets(df: DataFrame, keys: Sequence[str], time: str = "hr", value: str = "val", tie: Sequence[str] = (), hours: int = 6,
                    min_cover: int | None = None, limit: int | None = None, combine: str = "last", clip: bool = True) -> DataFrame:
    """Hourly values (last one wins, or summed) gathered in buckets that count only when enough hours are covered.

    Gives ``bucket``, ``t0_hr``, ``total``, ``cover`` and ``evaluable``. Hours before 0, and from ``limit`` on where one is given, fall into the
    first and last hour when ``clip`` is set, and are left out otherwise.
    """
    keys = list(keys)
    h = F.floor(F.col(time)).cast("int")
    rows = df.filter(F.col(value).isNotNull())
    if clip:
        # The time is clipped before it is truncated.
        h = F.greatest(F.lit(0), h if limit is None else F.least(F.lit(limit - 1), h))
    else:
        rows = rows.filter((F.col(time) >= 0) & (F.lit(True) if limit is None else F.col(time) < limit))
    order = F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(tie)], F.col(value).alias("v"))
    pick = F.max_by(value, order) if combine == "last" else F.sum(value)
    hourly = rows.withColumn("hour", h).groupBy(*keys, "hour").agg(pick.alias("_v"))
    bucket = F.floor(F.col("hour") / hours).cast("int")
    out = hourly.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.sum("_v").alias("total"), F.count("*").cast("int").alias("cover"))
    need = hours if min_cover is None else min_cover
    return (out.withColumn("t0_hr", F.col("bucket") * hours)
            .withColumn("evaluable", F.when(F.col("cover") >= need, 1).otherwise(0)))


def hourly_slices(points: DataFrame, series: DataFrame, keys: Sequence[str], families: Sequence[str], back: int = 48, at: str = "t_hr",
                  time: str = "hr", value: str = "val", fam: str = "fam", summed: Sequence[str] = ()) -> DataFrame:
    """Trailing value and coverage arrays per point: ``values`` and ``mask``, one inner array per family.

    Hours ``t - back .. t - 1``; the last value of an hour wins, or the sum for volume families.
    """
    keys = list(keys)
    order = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    last, total = F.max_by(value, order), F.sum(value)
    rows = series.filter(F.col(fam).isin(list(families)) & F.col(value).isNotNull()).withColumn("hour", F.floor(time).cast("int"))
    hourly = rows.groupBy(*keys, fam, "hour").agg(F.when(F.first(fam).isin(list(summed)), total).otherwise(last).alias("v"))

    # One row per entity and day: for each family an array of its 24 hours.
    def hours(f):
        return F.array(*[F.max(F.when((F.col(fam) == f) & (F.pmod("hour", F.lit(DAY)) == i), F.col("v"))) for i in range(DAY)])

    days = hourly.groupBy(*keys, F.floor(F.col("hour") / DAY).alias("_slot")).agg(F.array(*[hours(f) for f in families]).alias("_hours"))
    # Points and days go to one place by entity; a point sees the days of its look-back through a window, so nothing is joined.
    begin = F.col(at).cast("int") - back
    span = (back + DAY - 2) // DAY
    line = points.withColumns({"_slot": F.floor(begin / DAY) + span, "_point": F.lit(True)}).unionByName(days, allowMissingColumns=True).repartition(*keys)
    near = Window.partitionBy(*keys).orderBy("_slot").rangeBetween(-span, 0)
    seen = line.withColumn("_near", F.collect_list(F.when(F.col("_hours").isNotNull(), F.struct("_slot", "_hours"))).over(near)).filter("_point")

    def day(back_days):
        return F.get(F.filter("_near", lambda d: d["_slot"] == F.col("_slot") - back_days), F.lit(0))["_hours"]

    dense = seen.withColumns({f"_d{k}": day(span - k) for k in range(span + 1)})
    empty = F.array_repeat(F.lit(None).cast(hourly.schema["v"].dataType), DAY)

    def channel(i):
        return F.slice(F.concat(*[F.coalesce(F.get(f"_d{k}", F.lit(i)), empty) for k in range(span + 1)]), F.pmod(begin, F.lit(DAY)) + 1, back)

    cut = dense.select(*points.columns, F.array(*[channel(i) for i in range(len(families))]).alias("_cells"))

    def each(pick):
        return F.transform("_cells", lambda c: F.transform(c, pick))

    return cut.select(*points.columns, each(lambda v: F.coalesce(v, F.lit(0.0)).cast("float")).alias("values"), each(lambda v: F.when(v.isNotNull(), 1).otherwise(0)).alias("mask"))


def episodes(df: DataFrame, keys: Sequence[str], order: str, flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """Alert episodes per entity: number of maximal runs of consecutive alerts, and of runs of double alerts.

    Works on grid rows, whose number per entity is fixed by the grid.
    """
    w = Window.partitionBy(*by, *keys).orderBy(order)
    on = F.when(flag, 1).otherwise(0)
    marked = df.withColumn("_on", on).withColumn("_prev", F.coalesce(F.lag("_on").over(w), F.lit(0)))
    marked = marked.withColumn("_next", F.coalesce(F.lead("_on").over(w), F.lit(0)))
    double = (F.col("_on") == 1) & (F.col("_next") == 1)
    return marked.groupBy(*by, *keys).agg(
        F.count_if((F.col("_on") == 1) & (F.col("_prev") == 0)).alias("episodes"),
        F.count_if(double & (F.col("_prev") == 0)).alias("double_episodes"),
        F.min(F.when(F.col("_on") == 1, F.col(order))).alias("first_alert"),
        F.min(F.when(double, F.col(order))).alias("first_double"))
