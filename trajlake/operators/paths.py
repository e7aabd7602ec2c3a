"""Hand-path corrections around grasps: releases, offsets, object-centric carries, straight approaches, placed drops."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pose as P
from ..functions import rotation as R
from ..functions.pose import Pose
from ..functions.vectors import Sheet, add, clip, cols, norm, scale, sub
from .blocks import Axis, interval_join, running, shift
from .lineage import cut
from .sequence import asof, fill_forward, mark_runs, next_value


def first_exceeding(rows: DataFrame, probes: DataFrame, axis: Axis, value: str, *, small: int = 256, large: int = 65_536) -> DataFrame:
    """For every probe (keys, ``at``, ``need``) the first row at or after ``at`` whose value exceeds ``need``.

    Looked for in the probe's own small block, then among the maxima of the small blocks of its large block, then
    among the maxima of the large blocks; each step handles only what the one before left open."""
    keys, r, v = list(axis.keys), F.col(axis.order), F.col(value)
    fine = rows.select(*keys, r.alias("r"), v.alias("v"), F.floor(r / small).alias("s"), F.floor(r / large).alias("l"))
    maxima = fine.groupBy(*keys, "l", "s").agg(F.max("v").alias("m"))
    tops = maxima.groupBy(*keys, "l").agg(F.max("m").alias("m"))
    probes = probes.select(*keys, "at", "need")
    ask = probes.withColumns({"s": F.floor(F.col("at") / small), "l": F.floor(F.col("at") / large)})
    id_ = [*keys, "at"]

    def inside(blocks: DataFrame) -> DataFrame:
        """First exceeding row of the one small block each probe was narrowed to."""
        return blocks.join(fine.drop("l"), [*keys, "s"]).where((F.col("v") > F.col("need")) & (F.col("r") >= F.col("at"))).groupBy(*id_).agg(F.min("r").alias("first"))

    def narrowed(to: DataFrame, after: Column) -> DataFrame:
        hit = to.join(maxima, [*keys, "l"]).where((F.col("m") > F.col("need")) & after)
        return hit.groupBy(*id_, "need").agg(F.min("s").alias("s"))

    found = inside(ask.drop("l"))
    open_ = ask.join(found, id_, "left_anti")
    second = inside(narrowed(open_.withColumnRenamed("s", "own"), F.col("s") > F.col("own")))
    still = open_.join(second, id_, "left_anti").withColumnRenamed("l", "own").drop("s")
    later = still.join(tops, keys).where((F.col("l") > F.col("own")) & (F.col("m") > F.col("need"))).groupBy(*id_, "need").agg(F.min("l").alias("l"))
    third = inside(narrowed(later, F.lit(True)))
    return found.unionByName(second).unionByName(third)


def release_rows(frames: DataFrame, held: Column, angle: str, rise: float, axis: Axis, *, at_command: bool = False) -> DataFrame:
    """Per segment end: the row before the angle first exceeds its value there by ``rise`` (or the last held row);
    segments after which the hand never opens are left out."""
    out = shift(frames.withColumn("__held", held), axis, {"__before": (F.col("__held"), -1)})
    ends = out.where(F.coalesce(F.col("__before"), F.lit(False)) & ~F.col("__held"))
    probes = ends.select(*axis.keys, F.col(axis.order).alias("at"), (F.col(angle) + rise).alias("need"))
    first = first_exceeding(frames, probes, axis, angle)
    row = F.col("at") - 1 if at_command else F.col("first") - 1
    return first.select(*axis.keys, F.col("at").alias("stop"), row.alias("release"))


def offset_track(frames: DataFrame, segments: DataFrame, time: str, axis: Axis, clock: Axis, *, approach: float, retreat: float) -> DataFrame:
    """A per-segment offset held over its window, turned linearly into the next one in between.

    ``segments``: keys, start, ``t0``, ``t1``, ``offset``. Each row follows the latest transition that has begun."""
    keys = list(axis.keys)
    seg = running(segments, axis.by("start"), {"__p": ("last", F.struct("t1", "offset"))}, exclusive=True)
    lo, hi = F.col("__p.t1") + retreat, F.col("t0") - approach
    tight = hi <= lo
    turns = seg.where(F.col("__p").isNotNull()).select(
        *keys, F.when(tight, F.col("__p.t1")).otherwise(lo).alias(time), F.when(tight, F.col("t0")).otherwise(hi).alias("__hi"),
        F.col("__p.offset").alias("__from"), F.col("offset").alias("__to")).withColumn("__lo", F.col(time))
    first = segments.groupBy(*keys).agg(F.min_by("offset", "start").alias("__first"))
    out = asof(frames, turns, time, ["__lo", "__hi", "__from", "__to"], clock, strict=True).join(first, keys)
    s = clip((F.col(time) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-9)), 0.0, 1.0)
    turned = F.col("__from") + s * (F.col("__to") - F.col("__from"))
    return out.withColumn("offset", F.coalesce(turned, F.col("__first"))).drop("__lo", "__hi", "__from", "__to", "__first")


def object_centric(frames: DataFrame, hand: str, thing: str, held: Column, time: str, axis: Axis, clock: Axis, *, settle: int, max_shift: float,
                   max_turn: float, approach: float, retreat: float) -> DataFrame:
    """Hand path that carries each held object rigidly: object pose times the relative pose at the settle row, in
    segments where the source object moves in the hand by more than the limits.

    Outside, the correction at a segment's end decays to none over its window. ``hand`` and ``thing`` are column
    prefixes of poses (x y z qw qx qy qz). Adds ``out_*`` and ``carried``."""
    keys, row = list(axis.keys), F.col(axis.order)
    names = ("x", "y", "z", "qw", "qx", "qy", "qz")
    at = lambda prefix: Pose(cols(*(f"{prefix}{c}" for c in names[:3])), cols(*(f"{prefix}{c}" for c in names[3:])))
    marked = mark_runs(frames, F.when(held, F.lit(1)), axis, "__seg")
    run = [*keys, "__seg"]
    size = marked.where(F.col("__seg").isNotNull()).groupBy(*run).agg((F.max(row) - F.col("__seg")).alias("__len"), F.max(time).alias("__t1"), F.min(time).alias("__t0"))
    at_row = marked.select(*keys, F.col(axis.order).alias("__ref"), *[F.col(f"{hand}{c}").alias(f"__h{c}") for c in names], *[F.col(f"{thing}{c}").alias(f"__o{c}") for c in names])
    ref = size.withColumn("__ref", F.col("__seg") + F.least(F.lit(settle), F.col("__len"))).join(at_row, [*keys, "__ref"]).drop("__ref")
    s = Sheet(marked.join(ref, run))
    g = P.relative(at("__o"), at("__h"))
    gp, gq = s.put("gp", g.p), s.put("gq", g.q)
    target = P.compose(at(thing), Pose(gp, gq))
    tp, tq = s.put("tp", target.p), s.put("tq", R.canonical(s.put("tq0", target.q)))
    dev = P.relative(at(hand), Pose(tp, tq))
    s.put_one("shift", norm(dev.p))
    s.put_one("turn", R.angle(s.put("devq", dev.q)))
    inside = s.df
    worst = inside.groupBy(*run).agg(F.max("__shift_0").alias("__shift"), F.max("__turn_0").alias("__turn"))
    moved = worst.where((F.col("__shift") > max_shift) | (F.col("__turn") > max_turn)).select(*run)
    carried = inside.join(moved, run)
    seg = carried.select(*keys, axis.order, *[F.col(f"__tp_{i}").alias(f"__n{c}") for i, c in enumerate("xyz")], *[F.col(f"__tq_{i}").alias(f"__n{c}") for i, c in enumerate(names[3:])],
                         F.lit(True).alias("carried"))
    # world corrections at both ends of every carried segment: target * inverse(hand)
    c = Sheet(carried.where((row == F.col("__seg")) | (row == F.col("__seg") + F.col("__len"))))
    cq = c.put("cq", R.canonical(c.put("cq0", R.multiply(cols(*(f"__tq_{i}" for i in range(4))), R.conjugate(at(hand).q)))))
    cp = c.put("cp", sub(cols(*(f"__tp_{i}" for i in range(3))), R.rotate(cq, at(hand).p)))
    kept = [F.col(f"__cp_{i}") for i in range(3)] + [F.col(f"__cq_{i}") for i in range(4)]
    fix = F.struct(F.col(time).alias("t"), *[k.alias(n) for k, n in zip(kept, names)])
    ends = c.df.select(*keys, time, (row == F.col("__seg")).alias("opens"), (row == F.col("__seg") + F.col("__len")).alias("closes"), fix.alias("__fix"))
    free = marked.where(F.col("__seg").isNull()).drop("__seg")
    after = asof(free, ends.where("closes").select(*keys, time, "__fix"), time, ["__fix"], clock, strict=True, prefix="__a")
    both = asof(after, ends.where("opens").select(*keys, time, "__fix"), time, ["__fix"], clock, forward=True, strict=True, prefix="__b")
    out = Sheet(both.select(*[F.col(x) for x in both.columns if not x.startswith("__")], F.col("__a__fix").alias("after"), F.col("__b__fix").alias("before")))
    p, q = at(hand)
    for tag, window, gap in (("after", retreat, F.col(time) - F.col("after.t")), ("before", approach, F.col("before.t") - F.col(time))):
        w = F.when(gap < window, 1.0 - gap / window).otherwise(F.lit(0.0))
        w = out.put_one(f"w_{tag}", F.coalesce(w, F.lit(0.0)))
        fixed = [F.coalesce(F.col(f"{tag}.{n}"), F.lit(1.0 if n == "qw" else 0.0)) for n in names]
        turn = out.put(f"q_{tag}", R.exp(scale(out.put(f"l_{tag}", R.log(out.put(f"f_{tag}", fixed[3:]))), w)))
        p = out.put(f"p2_{tag}", add(scale(fixed[:3], w), R.rotate(turn, p)))
        q = out.put(f"q2_{tag}", R.multiply(turn, q))
    loose = out.df.select(*keys, axis.order, *[x.alias(f"__n{n}") for x, n in zip((*p, *R.canonical(q)), names)], F.lit(False).alias("carried"))
    fixed_rows = seg.unionByName(loose)
    joined = frames.join(fixed_rows, [*keys, axis.order], "left")
    return joined.withColumns({f"out_{n}": F.coalesce(F.col(f"__n{n}"), F.col(f"{hand}{n}")) for n in names} | {"carried": F.coalesce("carried", F.lit(False))}) \
                 .drop(*[f"__n{n}" for n in names])


def straight_approach(frames: DataFrame, held: Column, axis: Axis, *, height: float, blend: float) -> DataFrame:
    """Final approach to every segment along its approach axis: after the last row that was ``height + blend`` above
    the grasp, the sideways offset is scaled by how high the hand still is.

    Positions ``x y z`` and a hand turned by ``yaw`` about the (downward) approach axis; adds ``ox oy``."""
    keys, row = list(axis.keys), F.col(axis.order)
    out = mark_runs(frames, F.when(held, F.lit(1)), axis, "__seg")
    out = next_value(out, "__next", F.col("__seg"), axis)
    grasp = frames.select(*keys, F.col(axis.order).alias("__next"), F.col("x").alias("__ax"), F.col("y").alias("__ay"), F.col("z").alias("__az"))
    free = out.where(F.col("__seg").isNull()).join(grasp, [*keys, "__next"], "left")
    s = clip((F.col("z") - F.col("__az") - height) / blend, 0.0, 1.0)
    free = free.withColumn("__s", s)
    away = free.where(F.col("__next").isNotNull()).groupBy(*keys, "__next").agg(F.max(F.when(F.col("__s") >= 1.0, row)).alias("__away"))
    free = free.join(away, [*keys, "__next"], "left")
    k = F.when(F.col("__away").isNotNull() & (row > F.col("__away")), F.col("__s")).otherwise(F.lit(1.0))
    moved = free.select(*keys, axis.order, *[F.when(k < 1.0, F.col(f"__a{c}") + k * (F.col(c) - F.col(f"__a{c}"))).otherwise(F.col(c)).alias(f"o{c}") for c in "xy"])
    return frames.join(moved, [*keys, axis.order], "left").withColumns({f"o{c}": F.coalesce(F.col(f"o{c}"), F.col(c)) for c in "xy"})


def approach_width(frames: DataFrame, pairs: DataFrame, label: Column, axis: Axis, *, near: float, clearance: float) -> DataFrame:
    """Largest useful pad separation of a free hand near the next or the previous grasp's object (null elsewhere).

    ``pairs``: keys, object, row, ``dist``, ``extent``, ``off`` (centre offset along the closing axis)."""
    keys = list(axis.keys)
    out = next_value(frames.withColumn("__l", label), "__next", F.col("__l"), axis)
    out = fill_forward(out, {"__prev": F.col("__l")}, axis, lead_in=False)
    free = out.where(F.col("__l").isNull())
    want = free.select(*keys, axis.order, F.explode(F.array_distinct(F.array_compact(F.array("__next", "__prev")))).alias("object"))
    hit = want.join(pairs.where(F.col("dist") <= near), [*keys, axis.order, "object"])
    need = hit.groupBy(*keys, axis.order).agg(F.max(F.col("extent") + 2.0 * F.col("off") + 2.0 * clearance).alias("width"))
    return frames.select(*keys, axis.order).join(need, [*keys, axis.order], "left")


def placed_drops(frames: DataFrame, held: Column, time: str, axis: Axis, *, place: Sequence[str], inside: Sequence[str], turn: str, span: float, longest: float,
                 min_drop: float, max_drop: float, max_turn: float, rest_speed: float, rest_turn: float) -> DataFrame:
    """Segments after which the object falls a short way and comes to rest: the new end of the segment and the drop.

    ``place``: object position, ``inside``: its position in the hand, ``turn``: its rotation angle. Only the rows up to
    ``longest`` after a segment are looked at. Scene checks on the fingers are not part of this rule."""
    keys, row = list(axis.keys), F.col(axis.order)
    cols_ = [*place, *inside, turn, time, "valid"]
    out = shift(mark_runs(frames, F.when(held, F.lit(1)), axis, "__seg"), axis, {f"__n_{c}": (F.col(c), 1) for c in (*place, time, "valid")} | {f"__p_{c}": (F.col(c), -1) for c in (*place, time, "valid")}
                | {"__nseg": (F.col("__seg"), 1), "__more": (F.lit(1), 1)})
    gap = lambda t: F.sqrt(sum(((F.col(f"{t}{c}") - F.col(c)) * (F.col(f"{t}{c}") - F.col(c)) for c in place), F.lit(0.0))) / F.abs(F.col(f"{t}{time}") - F.col(time))
    still = lambda t: F.coalesce(~(F.col("valid") & F.col(f"{t}valid")) | (gap(t) < rest_speed), F.lit(True))
    out = cut(out.select(*keys, axis.order, *cols_, "__seg", "__nseg", "__more", (still("__p_") & still("__n_")).alias("__still")))
    last = out.where(F.col("__seg").isNotNull() & F.col("__nseg").isNull() & F.col("__more").isNotNull()).select(
        *keys, (row + 1).alias("stop"), F.col(time).alias("__lo"), (F.col(time) + longest + 1e-9).alias("__hi"), *[F.col(c).alias(f"__0_{c}") for c in (*inside, turn)])
    free = out.where(F.col("__seg").isNull()).select(*keys, axis.order, *cols_, "__still")
    rows = interval_join(free, last, keys, time, "__lo", "__hi", span).where(row >= F.col("stop"))
    # rows of this pause only: the pause ends at the first held or invalid row
    held_after = next_value(out.select(*keys, axis.order, "__seg"), "__h", F.when(F.col("__seg") == row, row), axis).select(*keys, F.col(axis.order).alias("stop"), F.col("__h").alias("__until"))
    rows = rows.join(held_after, [*keys, "stop"], "left").where(F.col("__until").isNull() | (row < F.col("__until")))
    id_ = [*keys, "stop"]
    rows = cut(rows)
    rows = rows.join(rows.groupBy(*id_).agg(F.min(F.when(~F.col("valid"), row)).alias("__bad")), id_).where(F.col("__bad").isNull() | (row < F.col("__bad")))
    fallen = F.sqrt(sum(((F.col(c) - F.col(f"__0_{c}")) * (F.col(c) - F.col(f"__0_{c}")) for c in inside), F.lit(0.0)))
    rest = rows.where((fallen > min_drop) & F.col("__still")).groupBy(*id_).agg(
        F.min_by(F.struct(row.alias("row"), fallen.alias("drop"), *place, F.col(turn).alias("turn")), row).alias("z"))
    near = rows.join(rest, id_).where(row <= F.col("z.row"))
    apart = F.sqrt(sum(((F.col(c) - F.col(f"z.{c}")) * (F.col(c) - F.col(f"z.{c}")) for c in place), F.lit(0.0)))
    settled = near.where((apart <= min_drop) & (F.abs(F.col(turn) - F.col("z.turn")) <= rest_turn)).groupBy(*id_, "z").agg(
        F.min_by(F.struct(row.alias("row"), F.abs(F.col(turn) - F.col(f"__0_{turn}")).alias("turn")), row).alias("e"))
    return settled.where((F.col("z.drop") <= max_drop) & (F.col("e.turn") <= max_turn)).select(*id_, (F.col("e.row") + 1).alias("new_stop"), F.col("z.drop").alias("drop"), F.col("e.turn").alias("turn"))
