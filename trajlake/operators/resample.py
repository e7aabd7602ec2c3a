"""Time scaling and resampling: slow a demonstration down to the robot's limits, then put it on a uniform clock.

Every source interval carries the values at both of its ends and yields the output rows that fall into it, with
their ``fraction`` of the way; values, poses, validity and labels are then expressions on one row.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rotation
from ..functions.vectors import Sheet
from .blocks import Axis, attach, running, shift
from .sequence import runs, sliding_max


def intervals(frames: DataFrame, time: str, carried: Sequence[str], axis: Axis) -> DataFrame:
    """Source intervals: each row with the values of the next one (``next_*``) and the step ``dt``."""
    near = {f"next_{c}": (F.col(c), 1) for c in (time, *carried)}
    out = shift(frames, axis, near).where(F.col(f"next_{time}").isNotNull())
    return out.withColumn("dt", F.col(f"next_{time}") - F.col(time))


def required_slowdown(iv: DataFrame, moved: Sequence[tuple[Column, float]], slides: Sequence[tuple[Column, float]] = (), *,
                      scale: float = 0.95) -> DataFrame:
    """How much slower each interval must run for every |increment| to respect its speed limit (at least 1)."""
    terms = [F.abs(c) / (limit * scale) for c, limit in moved]
    terms += [F.abs(c) / limit for c, limit in slides]
    return iv.withColumn("required", F.greatest(F.lit(1.0), F.greatest(*terms) / F.col("dt") if len(terms) > 1 else terms[0] / F.col("dt")))


def grasp_dwell(frames: DataFrame, held: Column, axis: Axis) -> DataFrame:
    """Intervals that lead into or out of a held run: (episode, row)."""
    r = runs(frames, F.when(held, F.lit(1)), axis)
    into = r.where(F.col("start") > 0).select(*axis.keys, (F.col("start") - 1).alias(axis.order))
    return into.unionByName(r.select(*axis.keys, F.col("stop").alias(axis.order))).distinct()


def dilate(iv: DataFrame, half: str, dwell_rows: DataFrame, dwell: float, axis: Axis) -> DataFrame:
    """Smooth the slow-down with a sliding maximum and give grasp intervals their least duration."""
    out = sliding_max(iv, "required", half, axis, name="dilation")
    marked = dwell_rows.withColumn("__dwell", F.lit(True))
    out = out.join(marked, [*axis.keys, axis.order], "left")
    floor = F.when(F.col("__dwell"), F.lit(float(dwell)) / F.col("dt"))
    return out.withColumn("dilation", F.greatest("dilation", floor)).drop("__dwell")


def warp(iv: DataFrame, axis: Axis) -> DataFrame:
    """Interval start and end on the slowed clock."""
    out = running(iv, axis, {"warp1": ("sum", F.col("dt") * F.col("dilation"))})
    out = shift(out, axis, {"__before": (F.col("warp1"), -1), "__after": (F.lit(1), 1)})
    return out.withColumns({"warp0": F.coalesce("__before", F.lit(0.0)), "ends": F.col("__after").isNull()}).drop("__before", "__after")


def clock(warped: DataFrame, time: str, step: float) -> DataFrame:
    """Rows of the uniform output clock: every source interval yields the ticks that fall into it, the last one also
    the tick that holds the end. Adds ``k``, ``time``, ``fraction`` and ``source_time`` to the interval's columns.

    No join is needed, and the ticks of a long episode are made by as many tasks as its intervals."""
    first = F.ceil(F.col("warp0") / step)
    last = F.when(F.col("ends"), F.ceil(F.col("warp1") / step - 1e-9)).otherwise(F.ceil(F.col("warp1") / step) - 1)
    out = warped.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    at = F.least(F.col("k") * F.lit(step), F.col("warp1"))
    u = F.greatest(F.least((at - F.col("warp0")) / (F.col("warp1") - F.col("warp0")), F.lit(1.0)), F.lit(0.0))
    out = out.withColumn("fraction", u)
    return out.withColumns({"time": F.col("k") * F.lit(step), "source_time": F.col(time) + F.col("fraction") * (F.col(f"next_{time}") - F.col(time))})


def uniform_ticks(groups: DataFrame, keys: Sequence[str], first: Column, last: Column, chunk: int = 4096) -> DataFrame:
    """Tick numbers ``first``..``last`` of every group, made chunk by chunk on all tasks."""
    named = groups.withColumns({"__first": first.cast("long"), "__last": last.cast("long")}).where(F.col("__last") >= F.col("__first"))
    chunks = named.withColumn("__chunk", F.explode(F.sequence(F.col("__first"), F.col("__last"), F.lit(chunk).cast("long")))).repartition(*keys, "__chunk")
    end = F.least(F.col("__chunk") + (chunk - 1), F.col("__last"))
    return chunks.withColumn("k", F.explode(F.sequence(F.col("__chunk"), end))).drop("__first", "__last", "__chunk")


def linear(a: Column, b: Column, fraction: Column) -> Column:
    return a + fraction * (b - a)


def both_valid(a: Column, b: Column, fraction: Column) -> Column:
    """Every source row an output row reads must be valid."""
    return (a | (fraction >= 1.0)) & (b | (fraction <= 0.0))


def agreed_label(a: Column, b: Column, fraction: Column) -> Column:
    """The label of an exact row, else the label both neighbours share, else none."""
    return F.when(fraction <= 0.0, a).when(fraction >= 1.0, b).when(a == b, a)


def geodesic(sheet: Sheet, name: str, a: Sequence[Column], b: Sequence[Column], fraction: Column):
    """Rotation at ``fraction`` between two orientations, with w >= 0."""
    rel0 = sheet.put(f"{name}_rel0", rotation.multiply(rotation.conjugate(a), b))
    rel = sheet.put(f"{name}_rel", rotation.canonical(rel0))
    w = sheet.put(f"{name}_log", rotation.log(rel))
    q = sheet.put(f"{name}_q", rotation.slerp(a, w, fraction))
    return sheet.put(f"{name}_out", rotation.canonical(q))


def servo_reference(frames: DataFrame, time: str, joints: Mapping[str, float], fingers: Sequence[str], step: float, axis: Axis,
                    chunk: int = 4096) -> DataFrame:
    """Servo targets at uniform step ends, each joint read its lead ahead (clamped to the episode), fingers the
    more closed of their led and current values.

    Every source interval yields the readings that fall into it, the last one also those at or past the end: no as-of
    join. Which readings may fall into it follows from its bounds within a rounding error, whether they do from their time.
    A reading in an interval without duration, at an end that several rows share, is not a number."""
    keys, (t, next_t) = list(axis.keys), (F.col(time), F.col(f"next_{time}"))
    rows = frames.select(*keys, axis.order, time, *joints)
    span = {"__t0": F.min(time), "__t1": F.max(time)}
    if axis.single:
        group = Window.partitionBy(*keys)
        rows = rows.withColumns({name: e.over(group) for name, e in span.items()})
    else:
        rows = attach(rows, keys, span)
    near = {f"next_{c}": (F.col(c), 1) for c in (time, *joints)} | {"__after": (F.lit(1), 2)}
    iv = shift(rows, axis, near).where(next_t.isNotNull()).withColumn("__n", F.round((F.col("__t1") - F.col("__t0")) / step).cast("long"))
    readings = [(name, name, lead) for name, lead in joints.items()] + [(f"{name}@now", name, 0.0) for name in fingers]

    def ticks(kind: str, lead: float) -> Column:
        low, high = ((c - F.col("__t0") - float(lead)) / step for c in (t, next_t))
        first = F.when(t <= F.col("__t0"), F.lit(1)).otherwise(F.ceil(low - (F.abs(low) + 1) * 1e-6))
        last = F.when(F.col("__after").isNull(), F.col("__n")).otherwise(F.floor(high + (F.abs(high) + 1) * 1e-6))
        return F.struct(F.lit(kind).alias("kind"), F.lit(float(lead)).alias("lead"), F.greatest(first, F.lit(1)).cast("long").alias("first"), F.least(last, F.col("__n")).cast("long").alias("last"))

    found = iv.withColumn("__r", F.explode(F.array(*[ticks(kind, lead) for kind, _, lead in readings]))).where(F.col("__r.last") >= F.col("__r.first"))
    found = found.withColumn("__k", F.explode(F.sequence("__r.first", "__r.last", F.lit(chunk).cast("long"))))
    found = found.withColumn("k", F.explode(F.sequence("__k", F.least(F.col("__k") + (chunk - 1), F.col("__r.last")))))
    at = F.least(F.greatest(F.col("__t0") + F.col("k") * step + F.col("__r.lead"), F.col("__t0")), F.col("__t1"))
    found = found.withColumn("__at", at).where((F.col("__at") >= t) & (F.col("__after").isNull() | (F.col("__at") < next_t)))
    length = next_t - t
    u = F.when(length != 0, (F.col("__at") - t) / length).otherwise(float("nan"))
    wide = found.groupBy(*keys, "k").agg(
        *[F.max(F.when(F.col("__r.kind") == kind, linear(F.col(name), F.col(f"next_{name}"), u))).alias(kind) for kind, name, _ in readings])
    return wide.select(*keys, "k", *[F.least(F.col(j), F.col(f"`{j}@now`")).alias(j) if j in fingers else F.col(j) for j in joints])


__all__ = ["agreed_label", "attach", "both_valid", "clock", "dilate", "geodesic", "grasp_dwell", "intervals", "linear",
           "required_slowdown", "servo_reference", "uniform_ticks", "warp"]
