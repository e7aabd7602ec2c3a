"""Kinematic gates: per-frame residuals, per-episode metrics, verdicts and their reasons.

Reasons are a long table (episode, place, reason) so that an episode with very many failing grasp
phases is not gathered into one array; a verdict counts them.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, sig3, significant
from .blocks import Axis, running
from .sequence import mark_runs

# Height band the hands can reach (m), tolerance of a navigation destination (m).
REACH_Z = (0.46, 1.87)
NAVIGATION_GOAL = 0.03


def joint_margin(q: Column, limits: Sequence[tuple[float, float]], first: int = 0) -> Column:
    """Smallest distance of any joint from its limits (negative outside)."""
    return F.least(*[F.least(q[first + i] - lo, hi - q[first + i]) for i, (lo, hi) in enumerate(limits)])


def speed_ratio(steps: Sequence[tuple[Column, float]], dt: Column) -> Column:
    """``struct<ratio, joint>`` of the joint closest to its speed limit; the first one among equals."""
    each = [F.struct((F.abs(d) / dt / limit).alias("ratio"), F.lit(-i).alias("rank"), F.lit(i).alias("joint")) for i, (d, limit) in enumerate(steps)]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    return F.struct(best["ratio"].alias("ratio"), best["joint"].alias("joint"))


def worst(value: Column, row: str, *extra: Column) -> Column:
    """The extreme row of a value: ``struct<value, row, ...>``, the earliest among equals."""
    return F.max_by(F.struct(value.alias("value"), F.col(row).alias("row"), *extra), F.struct(value, -F.col(row)))


def residual_reasons(frames: DataFrame, side: str, keys: Sequence[str], row: str, *, tol_pos: tuple[float, float], tol_rot: tuple[float, float]) -> DataFrame:
    """Reach-band and residual reasons of one hand; tolerances are (free, held)."""
    pos, rot, held, z = (F.col(f"{side}_{c}") for c in ("pos", "rot", "held", "z"))
    tp = F.when(held, F.lit(tol_pos[1])).otherwise(F.lit(tol_pos[0]))
    tr = F.when(held, F.lit(tol_rot[1])).otherwise(F.lit(tol_rot[0]))
    out_of = ((z < REACH_Z[0]) | (z > REACH_Z[1])) & ((pos > tp) | (rot > tr))
    miss = F.when(out_of, F.greatest(F.lit(REACH_Z[0]) - z, z - REACH_Z[1]))
    g = frames.where(pos.isNotNull()).groupBy(*keys).agg(
        F.count_if(out_of).alias("n_out"), F.max_by(F.struct(z.alias("z"), F.col(row).alias("row")), F.when(out_of, F.struct(miss, -F.col(row)))).alias("far"),
        F.count_if(pos > tp).alias("n_pos"), worst(pos - tp, row, pos.alias("err"), tp.alias("tol")).alias("p"),
        F.count_if(rot > tr).alias("n_rot"), worst(rot - tr, row, rot.alias("err"), tr.alias("tol")).alias("r"))
    n = lambda c: F.col(c).cast("string")
    reach = F.concat(F.lit(f"{side} TCP target outside the reach band: grasp center z "), fixed(F.col("far.z"), 2),
                     F.lit(f" m not in {REACH_Z[0]:.2f}-{REACH_Z[1]:.2f} m at frame "), n("far.row"), F.lit(" ("), n("n_out"), F.lit(" frames)"))

    def residual(name: str, c: str, unit: str, scale: float) -> Column:
        return F.concat(F.lit(f"{side} TCP {name} residual "), sig3(F.col(f"{c}.err") * scale), F.lit(f" {unit} > "), sig3(F.col(f"{c}.tol") * scale),
                        F.lit(f" {unit} at frame "), n(f"{c}.row"), F.lit(" ("), n("n_pos" if c == "p" else "n_rot"), F.lit(" frames)"))

    found = F.array(F.struct(F.lit(0).alias("place"), (F.col("n_out") > 0).alias("bad"), reach.alias("reason")),
                    F.struct(F.lit(1).alias("place"), (F.col("n_pos") > 0).alias("bad"), residual("position", "p", "mm", 1e3).alias("reason")),
                    F.struct(F.lit(2).alias("place"), (F.col("n_rot") > 0).alias("bad"), residual("rotation", "r", "rad", 1.0).alias("reason")))
    return g.select(*keys, F.explode(found).alias("f")).where("f.bad").select(*keys, "f.place", "f.reason")


def angle_reasons(frames: DataFrame, name: str, angle: str, keys: Sequence[str], row: str, *, tol: float, place: int) -> DataFrame:
    """Reason for an orientation (such as the head's) that leaves its tolerance."""
    g = frames.groupBy(*keys).agg(F.count_if(F.col(angle) > tol).alias("n"), worst(F.col(angle), row).alias("w"))
    text = F.concat(F.lit(f"{name} rotation residual "), sig3(F.col("w.value")), F.lit(" rad > "), sig3(F.lit(tol)), F.lit(" rad at frame "),
                    F.col("w.row").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(" frames)"))
    return g.where(F.col("n") > 0).select(*keys, F.lit(place).alias("place"), text.alias("reason"))


def limit_reasons(frames: DataFrame, keys: Sequence[str], row: str, *, clearance: float) -> DataFrame:
    """Joint-limit, speed and self-clearance reasons from ``margin``, ``speed`` (ratio, joint) and ``clearance``."""
    g = frames.groupBy(*keys).agg(worst(-F.col("margin"), row).alias("m"), worst(F.col("speed.ratio"), row, F.col("speed.joint").alias("joint")).alias("s"),
                                  worst(-F.col("clearance"), row).alias("c"))
    n = lambda c: F.col(c).cast("string")
    found = F.array(
        F.struct(F.lit(6).alias("place"), (F.col("m.value") > 1e-9).alias("bad"),
                 F.concat(F.lit("joint limit exceeded by "), significant(F.col("m.value"), 4), F.lit(" rad at frame "), n("m.row")).alias("reason")),
        F.struct(F.lit(7).alias("place"), (F.col("s.value") > 1 + 1e-6).alias("bad"),
                 F.concat(F.lit("speed limit exceeded: joint "), n("s.joint"), F.lit(" at "), sig3(F.col("s.value")), F.lit(" x limit (frame "), n("s.row"), F.lit(")")).alias("reason")),
        F.struct(F.lit(8).alias("place"), (-F.col("c.value") < clearance).alias("bad"),
                 F.concat(F.lit("self-clearance "), sig3(-F.col("c.value") * 1e3), F.lit(" mm < "), sig3(F.lit(clearance * 1e3)), F.lit(" mm at frame "), n("c.row")).alias("reason")))
    return g.select(*keys, F.explode(found).alias("f")).where("f.bad").select(*keys, "f.place", "f.reason")


def grasp_drift(rows: DataFrame, label: Column, position: Sequence[Column], turn: Column, axis: Axis) -> DataFrame:
    """Per held run: how far the object moves in the hand from where it was at the run's first row.

    ``turn`` is the rotation (rad) relative to a fixed reference of the run, or a scalar angle."""
    names = [f"__p{i}" for i in range(len(position))]
    out = mark_runs(rows.withColumns(dict(zip(names, position)) | {"__a": turn}), label, axis, "start").where(F.col("start").isNotNull())
    run = [*axis.keys, "start"]
    first = out.where(F.col(axis.order) == F.col("start")).select(*run, *[F.col(n).alias(f"{n}_0") for n in names], F.col("__a").alias("__a_0"))
    gone = F.sqrt(sum(((F.col(n) - F.col(f"{n}_0")) * (F.col(n) - F.col(f"{n}_0")) for n in names), F.lit(0.0)))
    return out.join(first, run).groupBy(*run).agg((F.max(axis.order) + 1).alias("stop"), F.max(gone).alias("drift"), F.max(F.abs(F.col("__a") - F.col("__a_0"))).alias("turn"))


def verdicts(episodes: DataFrame, keys: Sequence[str], *reasons: DataFrame) -> DataFrame:
    """Passed flag and reason count of every episode."""
    every = reduce(DataFrame.unionByName, reasons)
    counted = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return episodes.select(*keys).distinct().join(counted, list(keys), "left").select(*keys, (n == 0).alias("passed"), n.cast("long").alias("reasons"))


def polygon_edges(vertices: Column) -> Column:
    """Edges (start point and vector) of a convex counter-clockwise polygon (``array<struct<x, y>>``)."""
    n = F.size(vertices)
    follower = lambda i: F.element_at(vertices, F.pmod(i + 1, n) + 1)
    return F.transform(vertices, lambda v, i: F.struct(v["x"].alias("x"), v["y"].alias("y"), (follower(i)["x"] - v["x"]).alias("ex"), (follower(i)["y"] - v["y"]).alias("ey")))


def polygon_distance(x: Column, y: Column, edges: Column) -> Column:
    """Signed distance from a point to a convex polygon given by its edges, negative inside."""
    def apart(e: Column) -> Column:
        rx, ry = x - e["x"], y - e["y"]
        t = F.greatest(F.least((rx * e["ex"] + ry * e["ey"]) / F.greatest(e["ex"] * e["ex"] + e["ey"] * e["ey"], F.lit(1e-18)), F.lit(1.0)), F.lit(0.0))
        dx, dy = rx - t * e["ex"], ry - t * e["ey"]
        return dx * dx + dy * dy

    d = F.sqrt(F.array_min(F.transform(edges, apart)))
    inside = F.forall(edges, lambda e: e["ex"] * (y - e["y"]) - e["ey"] * (x - e["x"]) >= -1e-15)
    return F.when(inside, -d).otherwise(d)


def footprint_clearance(frames: DataFrame, obstacles: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """Distance of the base to its episode's nearest obstacle, less the body radius at the obstacle's height.

    ``obstacles``: keys, ``vertices``, ``radius`` (of the body band they overlap)."""
    shaped = obstacles.select(*keys, "radius", polygon_edges(F.col("vertices")).alias("edges"))
    d = polygon_distance(F.col("x"), F.col("y"), F.col("edges")) - F.col("radius")
    return frames.join(shaped, list(keys)).groupBy(*keys, row).agg(F.min(d).alias("clearance"))


def drop_enclosing(envelopes: DataFrame, scene: DataFrame, keys: Sequence[str], top_tol: float = 0.02) -> DataFrame:
    """Envelopes without those that a scene polygon resolves: its centroid inside, its top at the same height."""
    e, s = envelopes.withColumn("edges", polygon_edges(F.col("vertices"))).alias("e"), scene.alias("s")
    same = reduce(Column.__and__, [F.col(f"e.{k}") == F.col(f"s.{k}") for k in keys])
    inside = polygon_distance(F.col("s.cx"), F.col("s.cy"), F.col("e.edges")) <= 0
    return e.join(s, same & inside & (F.abs(F.col("s.top") - F.col("e.top")) <= top_tol), "left_anti")


def sphere_clearance(centres: Column, radii: Sequence[float], pairs: Sequence[tuple[int, int]]) -> Column:
    """``struct<clearance, i, j>`` of the closest allowed sphere pair of one row.

    The pair list is a constant of the robot, so distances are taken inside the row (no self-join)."""
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(radii[i] + radii[j]).alias("reach")) for i, j in pairs])

    def gap(p: Column) -> Column:
        d = [centres[p["i"] * 3 + k] - centres[p["j"] * 3 + k] for k in range(3)]
        return F.struct((F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) - p["reach"]).alias("clearance"), p["i"].alias("i"), p["j"].alias("j"))

    return F.array_min(F.transform(items, gap))


def failing_frame(**limits: tuple[Column, float]) -> Column:
    """Whether any diagnostic exceeds its tolerance (unknown values do not)."""
    return reduce(Column.__or__, [F.coalesce(c, F.lit(0.0)) > limit for c, limit in limits.values()])


def unreachable(heights: DataFrame, keys: Sequence[str], z: str, reach: str, longest: float = 0.665) -> DataFrame:
    """Pre-screen reasons per episode: grasp height outside the reach band, shoulder distance too long."""
    g = heights.groupBy(*keys).agg(F.min(z).alias("low"), F.max(z).alias("high"), F.max(reach).alias("far"))
    return g.select(*keys, (F.col("low") < REACH_Z[0]).alias("too_low"), (F.col("high") > REACH_Z[1]).alias("too_high"), (F.col("far") > longest).alias("too_far"))


def missing_poses(tracks: DataFrame, keys: Sequence[str], shown: int = 5) -> DataFrame:
    """Why an episode's object state is incomplete: its first gaps by object id, then ``(+N more)``."""
    per = tracks.groupBy(*keys, "object").agg(F.count_if(~F.col("valid")).alias("bad"), F.count(F.lit(1)).alias("n")).where(F.col("bad") > 0)
    text = F.concat(F.lit("object "), F.col("object"), F.lit(": pose missing at "), F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" steps"))
    from .sequence import rank_ids
    ranked = per.join(rank_ids(per, keys, "object", "__k"), [*keys, "object"])
    head = F.array_sort(F.collect_list(F.when(F.col("__k") < shown, F.struct(F.col("__k"), text.alias("text")))))
    more = F.count(F.lit(1)) - shown
    out = ranked.groupBy(*keys).agg(head.alias("head"), more.alias("more"))
    joined = F.array_join(F.transform("head", lambda h: h["text"]), "; ")
    tail = F.when(F.col("more") > 0, F.concat(F.lit(" (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return out.select(*keys, F.concat(joined, tail).alias("reason"))


__all__ = ["angle_reasons", "drop_enclosing", "failing_frame", "footprint_clearance", "grasp_drift", "joint_margin", "limit_reasons", "missing_poses",
           "polygon_distance", "polygon_edges", "residual_reasons", "running", "speed_ratio", "sphere_clearance", "unreachable", "verdicts", "worst"]
