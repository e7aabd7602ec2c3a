"""Sequence operators on (episode, row) frames: increments, gradients, runs, gaps, fills, as-of."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import planar
from .blocks import BLOCK, FRAMES, Axis, attach, neighbourhood, number_rows, own_rows, quantile, running, shift
from .lineage import cut


def steps(df: DataFrame, values: Mapping[str, Column], axis: Axis = FRAMES, *, wrapped: Sequence[str] = ()) -> DataFrame:
    """Increments to the next row; the last row of a group has none and is dropped.

    Names in ``wrapped`` are angles: their increments are wrapped to [-pi, pi)."""
    out = shift(df, axis, {f"__next_{n}": (e, 1) for n, e in values.items()} | {"__more": (F.lit(1), 1)})
    out = out.where(F.col("__more") == 1)
    inc = {n: F.col(f"__next_{n}") - e for n, e in values.items()}
    inc = {n: planar.wrap(e) if n in wrapped else e for n, e in inc.items()}
    keep = [c for c in df.columns if c not in inc]
    return out.select(*keep, *[e.alias(n) for n, e in inc.items()])


def gradient(df: DataFrame, time: str, values: Mapping[str, Column], axis: Axis = FRAMES) -> DataFrame:
    """Second-order derivative on an uneven clock, one-sided at both ends; added as new columns."""
    t = F.col(time)
    near = {"__tp": (t, -1), "__tn": (t, 1)}
    for n, e in values.items():
        near |= {f"__p_{n}": (e, -1), f"__n_{n}": (e, 1)}
    out = shift(df, axis, near)
    hs, hd = t - F.col("__tp"), F.col("__tn") - t
    made = {}
    for n, e in values.items():
        before, after = F.col(f"__p_{n}"), F.col(f"__n_{n}")
        inner = (hs * hs * after + (hd * hd - hs * hs) * e - hd * hd * before) / (hs * hd * (F.col("__tn") - F.col("__tp")))
        made[n] = (F.when(F.col("__tp").isNull(), (after - e) / hd)
                   .when(F.col("__tn").isNull(), (e - before) / hs).otherwise(inner))
    return out.withColumns(made).drop(*near)


def central_difference(df: DataFrame, values: Mapping[str, Column], dt: float, axis: Axis = FRAMES) -> DataFrame:
    """Uniform-clock derivative: centred inside, one-sided at both ends."""
    near = {}
    for n, e in values.items():
        near |= {f"__p_{n}": (e, -1), f"__n_{n}": (e, 1)}
    out = shift(df, axis, near)
    made = {}
    for n, e in values.items():
        before, after = F.col(f"__p_{n}"), F.col(f"__n_{n}")
        made[n] = F.when(before.isNull(), (after - e) / dt).when(after.isNull(), (e - before) / dt) \
            .otherwise((after - before) / (2.0 * dt))
    return out.withColumns(made).drop(*near)


def clipped_pair(df: DataFrame, half: Column, values: Sequence[str], axis: Axis = FRAMES) -> DataFrame:
    """Each row with the values ``half`` rows earlier (``lo_*``) and later (``hi_*``), row numbers clipped to
    the group; ``half`` may differ per group. Equi-joins on (group, row): no window, no skew by group."""
    df = attach(df, axis.keys, {"__last": F.max(axis.order)})
    base = df.withColumn("__lo", F.greatest(F.col(axis.order) - half, F.lit(0)).cast("long")) \
             .withColumn("__hi", F.least(F.col(axis.order) + half, F.col("__last")).cast("long"))
    side = df.select(*axis.keys, F.col(axis.order).alias("__at"), *values)
    for tag in ("lo", "hi"):
        other = side.select(*axis.keys, F.col("__at").alias(f"__{tag}"), *[F.col(v).alias(f"{tag}_{v}") for v in values])
        base = base.join(other, [*axis.keys, f"__{tag}"])
    return base.drop("__lo", "__hi", "__last")


def mark_runs(df: DataFrame, label: Column, axis: Axis = FRAMES, name: str = "run") -> DataFrame:
    """Add the first row of the run each row belongs to: a maximal stretch of one non-null label."""
    out = neighbourhood(df.withColumn("__label", label), axis, before=1)
    previous = F.lag("__label").over(axis.window())
    out = own_rows(out.withColumn("__previous", previous), keep_block=True)
    opens = F.col("__label").isNotNull() & ~F.col("__label").eqNullSafe(F.col("__previous"))
    out = running(out.withColumn("__open", F.when(opens, F.col(axis.order))), axis,
                  {name: ("max", F.col("__open"))}, blocked=True)
    return out.withColumn(name, F.when(F.col("__label").isNotNull(), F.col(name))).drop("__label", "__previous", "__open")


def runs(df: DataFrame, label: Column, axis: Axis = FRAMES, aggregates: Mapping[str, Column] | None = None,
         name: str = "label") -> DataFrame:
    """One row per run: label, first row ``start``, end row ``stop`` (exclusive), and aggregates.

    Rows are pre-aggregated per task, so a run may be arbitrarily long."""
    extra = [e.alias(n) for n, e in (aggregates or {}).items()]
    marked = mark_runs(df.withColumn(name, label), F.col(name), axis, "start")
    return (marked.where(F.col("start").isNotNull()).groupBy(*axis.keys, name, "start")
            .agg((F.max(axis.order) + 1).alias("stop"), *extra))


def bridge(table: DataFrame, gap: Column, limit, axis: Axis, *, same: Sequence[str] = (), strict: bool = True,
           aggregates: Mapping[str, Column] | None = None, ok: Column | None = None) -> DataFrame:
    """Merge consecutive runs whose ``gap`` to the previous run is short.

    ``gap`` may use ``prev_<column>`` of the run before; ``same`` columns must agree for a merge, ``ok`` is an
    extra condition. ``strict``: shorter than the limit, else up to it."""
    columns = [c for c in table.columns if c not in axis.keys]
    at = replace(axis.by("start"), single=axis.single)  # runs of a group are no more than its rows
    out = running(table.withColumn("__run", F.struct(*columns)), at, {"__prev": ("last", F.col("__run"))}, exclusive=True)
    out = out.withColumns({f"prev_{c}": F.col(f"__prev.{c}") for c in columns})
    near = (gap < limit) if strict else (gap <= limit)
    for c in same:
        near = near & (F.col(c) == F.col(f"prev_{c}"))
    if ok is not None:
        near = near & ok
    opens = F.when(F.coalesce(near, F.lit(False)), F.lit(None)).otherwise(F.col("start"))
    out = running(out.withColumn("__open", opens), at, {"__group": ("max", F.col("__open"))})
    extra = [e.alias(n) for n, e in (aggregates or {}).items()]
    return (out.groupBy(*axis.keys, "__group", *same)
            .agg(F.max("stop").alias("stop"), F.count(F.lit(1)).alias("pieces"), *extra)
            .withColumnRenamed("__group", "start"))


def fill_forward(df: DataFrame, values: Mapping[str, Column], axis: Axis = FRAMES, *, lead_in: bool = True) -> DataFrame:
    """Carry the last non-null value; leading rows take the first one when ``lead_in``."""
    out = running(df, axis, {n: ("last", e) for n, e in values.items()})
    if not lead_in:
        return out
    firsts = df.groupBy(*axis.keys).agg(*[F.min_by(e, F.when(e.isNotNull(), axis.position())).alias(f"__first_{n}")
                                          for n, e in values.items()])
    out = out.join(firsts, list(axis.keys))
    return out.withColumns({n: F.coalesce(F.col(n), F.col(f"__first_{n}")) for n in values}) \
              .drop(*[f"__first_{n}" for n in values])


def next_value(df: DataFrame, name: str, value: Column, axis: Axis = FRAMES) -> DataFrame:
    """The next non-null value at or after each row."""
    return running(df, axis, {name: ("last", value)}, reverse=True)


def asof(probes: DataFrame, source: DataFrame, time: str, values: Sequence[str], axis: Axis, *,
         forward: bool = False, strict: bool = False, prefix: str = "") -> DataFrame:
    """Each probe with the values of the last source row at or before its time (first at or after: ``forward``);
    ``strict`` leaves out a source row at the probe's own time.

    Probes and source are merged on one clock and the values carried along it; no range join."""
    tagged = F.struct(*values)
    keys = list(axis.keys)
    side = int(forward != strict)
    a = source.select(*keys, F.col(time), F.lit(side).alias("__side"), tagged.alias("__src"))
    extra = [c for c in probes.columns if c not in (*keys, time)]
    kind = a.schema["__src"].dataType.simpleString()
    b = probes.select(*keys, F.col(time), F.lit(1 - side).alias("__side"),
                      F.lit(None).cast(kind).alias("__src"), F.struct(F.lit(1).alias("__p"), *extra).alias("__probe"))
    a = a.withColumn("__probe", F.lit(None).cast(b.schema["__probe"].dataType.simpleString()))
    merged = a.unionByName(b)
    out = running(merged, axis.by(time, axis.span, ("__side",)), {"__hit": ("last", F.col("__src"))}, reverse=forward)
    return out.where(F.col("__probe").isNotNull()).select(
        *keys, time, *[F.col(f"__probe.{c}").alias(c) for c in extra],
        *[F.col(f"__hit.{v}").alias(prefix + v) for v in values])


def median_step(df: DataFrame, time: str, axis: Axis = FRAMES, *, span: float, name: str = "median_dt") -> DataFrame:
    """Median positive time step per group."""
    inc = steps(df.select(*axis.keys, axis.order, time), {"__dt": F.col(time)}, axis)
    return quantile(inc.where(F.col("__dt") > 0), axis.keys, F.col("__dt"), 0.5, name=name, span=span, single=axis.single)


def sliding_max(df: DataFrame, value: str, half: str, axis: Axis = FRAMES, *, name: str) -> DataFrame:
    """Maximum over ``half`` rows to either side (truncated at the ends), ``half`` differing per group.

    A group is cut into stretches of a window's length. A window covers the end of one stretch and the start of the next, so
    it is the greater of two numbers: the stretch's maximum up to a row and that from a row on. Each row passes on two
    numbers whatever the width; nothing is multiplied."""
    keys, row = list(axis.keys), F.col(axis.order)
    wide = 2 * F.col(half) + 1
    rows = attach(df.select(*keys, axis.order, F.col(half).cast("long").alias(half), F.col(value).alias("__v")), keys, {"__last": F.max(axis.order)})
    rows = cut(rows.withColumn("__stretch", F.floor(row / wide)))
    inside = Window.partitionBy(*keys, "__stretch").orderBy(axis.order)
    upto = rows.withColumn("__m", F.max("__v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    onward = rows.withColumn("__m", F.max("__v").over(inside.rowsBetween(0, Window.unboundedFollowing)))
    # Where the window reaches past the end, its right part is the last stretch up to the last row.
    ends = upto.where(row == F.col("__last")).select(*keys, F.col("__m").alias("__tail"), (F.floor(row / wide) * wide).alias("__from"))
    right = upto.where(row >= F.col(half)).select(*keys, (row - F.col(half)).alias(axis.order), "__m")
    left = onward.where(row + F.col(half) <= F.col("__last")).select(*keys, (row + F.col(half)).alias(axis.order), "__m")
    best = left.unionByName(right).groupBy(*keys, axis.order).agg(F.max("__m").alias("__best"))
    out = rows.select(*keys, axis.order, half, "__last").join(ends, keys).join(best, [*keys, axis.order], "left")
    past = (row + F.col(half) > F.col("__last")) & ((row - F.col(half) < F.col("__from")) | (row <= F.col(half)))
    out = out.select(*keys, axis.order, F.greatest("__best", F.when(past, F.col("__tail"))).alias(name))
    return df.join(out, [*keys, axis.order])


def longest_run(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest run per group, the earliest among equals."""
    columns = [c for c in table.columns if c not in keys]
    best = F.max_by(F.struct(*columns), F.struct(F.col("stop") - F.col("start"), -F.col("start")))
    return table.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def first_run(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    columns = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col("start")).alias("__best")).select(*keys, "__best.*")


__all__ = ["BLOCK", "asof", "bridge", "central_difference", "clipped_pair", "fill_forward", "first_run", "gradient",
           "longest_run", "mark_runs", "median_step", "next_value", "runs", "sliding_max", "steps"]


def smooth(df: DataFrame, values: Mapping[str, Column], behind: str, ahead: str, axis: Axis = FRAMES, *, sigma: str | None = None,
           last: str = "last_row") -> DataFrame:
    """Weighted mean over ``behind`` rows before to ``ahead`` rows after each row, the end rows repeated outside.

    The widths (and the Gaussian ``sigma`` in rows, else uniform weights) are columns, so they may differ per
    group; ``last`` holds the group's last row number. A uniform mean is the difference of two running sums, whatever the
    width; a Gaussian one weighs the rows of its kernel, which a window over a block and its border gathers."""
    rows = cut(df.select(*axis.keys, axis.order, behind, ahead, last, *([sigma] if sigma else []), *[e.cast("double").alias(f"__v_{n}") for n, e in values.items()]))
    made = _kernel(rows, values, behind, ahead, sigma, last, axis) if sigma else _means(rows, values, behind, ahead, last, axis)
    return df.drop(*values).join(made, [*axis.keys, axis.order])


def _means(rows: DataFrame, values: Mapping[str, Column], behind: str, ahead: str, last: str, axis: Axis) -> DataFrame:
    keys, row = list(axis.keys), F.col(axis.order)
    b, a, end = F.col(behind).cast("long"), F.col(ahead).cast("long"), F.col(last)
    summed = cut(running(rows, axis, {f"__s_{n}": ("sum", F.col(f"__v_{n}")) for n in values}))
    high = summed.where(row >= a).select(*keys, (row - a).alias(axis.order), *[F.col(f"__s_{n}") for n in values])
    low = summed.where(row + b + 1 <= end).select(*keys, (row + b + 1).alias(axis.order), *[(-F.col(f"__s_{n}")).alias(f"__s_{n}") for n in values])
    # The first and last value of a group stand for the rows outside; the total for the sum past the end.
    edge = rows.groupBy(*keys).agg(*[F.max(F.when(row == 0, F.col(f"__v_{n}"))).alias(f"__a_{n}") for n in values],
                                   *[F.max(F.when(row == end, F.col(f"__v_{n}"))).alias(f"__z_{n}") for n in values])
    total = summed.where(row == end).select(*keys, *[F.col(f"__s_{n}").alias(f"__t_{n}") for n in values])
    parts = high.unionByName(low).groupBy(*keys, axis.order).agg(*[F.sum(f"__s_{n}").alias(f"__p_{n}") for n in values])
    out = rows.join(edge, keys).join(total, keys).join(parts, [*keys, axis.order], "left")
    before, after = F.greatest(b - row, F.lit(0)), F.greatest(row + a - end, F.lit(0))
    mean = lambda n: (F.coalesce(f"__p_{n}", F.lit(0.0)) + F.when(after > 0, F.col(f"__t_{n}")).otherwise(0.0) + before * F.col(f"__a_{n}") + after * F.col(f"__z_{n}")) / (a + b + 1)
    return out.select(*keys, axis.order, *[mean(n).alias(n) for n in values])


def _kernel(rows: DataFrame, values: Mapping[str, Column], behind: str, ahead: str, sigma: str, last: str, axis: Axis) -> DataFrame:
    keys, row = list(axis.keys), F.col(axis.order)
    b, a, end = F.col(behind).cast("long"), F.col(ahead).cast("long"), F.col(last)
    reach = int(rows.agg(F.greatest(F.max(b), F.max(a), F.lit(0)).alias("n")).first()["n"] or 0)
    weight = lambda j: F.exp(-0.5 * F.pow(j / F.col(sigma), F.lit(2.0)))
    sum_of = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    outside = lambda low, high: F.when(low <= high, sum_of(F.sequence(low, high), weight)).otherwise(0.0)
    seen = F.struct(row.cast("long").alias("row"), *[F.col(f"__v_{n}").alias(f"v{i}") for i, n in enumerate(values)])
    axis = axis.by(axis.order, max(axis.span, float(reach)), axis.ties)  # a border lies in the next block
    near = neighbourhood(rows, axis, before=reach, after=reach).withColumn("__near", F.collect_list(seen).over(axis.window().rowsBetween(-reach, reach)))
    near = own_rows(near).withColumn("__near", F.filter("__near", lambda x: (x.row >= row - b) & (x.row <= row + a)))
    head, tail = outside(-b, -row - 1), outside(end - row + 1, a)
    out = near.withColumns({"__head": head, "__tail": tail, "__all": outside(-b, a)})
    # With rows outside, the window begins at the group's first row and ends at its last: the edge values are its ends.
    mean = lambda i: (sum_of(F.col("__near"), lambda x: weight(x.row - row) * x[f"v{i}"]) + F.col("__head") * F.col("__near")[0][f"v{i}"]
                      + F.col("__tail") * F.element_at("__near", -1)[f"v{i}"]) / F.col("__all")
    return out.select(*keys, axis.order, *[mean(i).alias(n) for i, n in enumerate(values)])


def lookahead(df: DataFrame, path: str, length: float, values: Sequence[str], axis: Axis, span: float) -> DataFrame:
    """Each row with the values of the first row whose path length is at least ``length`` further on (null past the end)."""
    along = axis.by(path, span)
    probes = df.withColumn("__s", F.col(path)).withColumn(path, F.col(path) + F.lit(float(length)))
    out = asof(probes, df.select(*axis.keys, path, *values), path, values, along, forward=True, prefix="ahead_")
    return out.withColumn(path, F.col("__s")).drop("__s")


def evenly_spaced(df: DataFrame, keys: Sequence[str], row: str, picks: int, *, size: str = "n") -> DataFrame:
    """Rows at ``floor(i * n / picks)`` for i below ``picks`` of every group with ``n`` rows."""
    k = F.least(F.lit(picks), F.col(size))
    i = F.ceil(F.col(row) * k / F.col(size))
    return df.where((F.floor(i * F.col(size) / k) == F.col(row)) & (i < k))


def rank_ids(table: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Position of each distinct value in its group's sorted order, from 0.

    Values are spread over slots by their leading characters, so a group with very many values is not one task."""
    ids = table.select(*keys, value).distinct()
    slot = F.rpad(F.substring(F.col(value).cast("string"), 1, 2), 2, " ")
    return number_rows(ids, keys, [value], slot, name=name)
