"""Single smooth motions from a pose to one goal: base paths and hand strokes, timed by a minimum-jerk phase."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotation
from ..functions.gripper import move_duration
from ..functions.vectors import Vec, add, cross, norm, scale, sub
from .blocks import Axis, running, shift
from .folds import unwrapped
from .lineage import cut
from .sequence import asof

#: Knots of a curve (fixed value).
KNOTS = 400
LEAST_BASE, LEAST_HAND, LEAST_REACH = 0.5, 0.3, 0.4


def drive(start: Sequence[Column], distance: Column, direction: Column, turn: Column, s: Column) -> Vec:
    """Straight base move by ``distance`` along a body direction (0 ahead, pi/2 to the left) while the heading turns: x, y, yaw."""
    head = start[2] + direction
    return (start[0] + s * distance * F.cos(head), start[1] + s * distance * F.sin(head), start[2] + s * turn)


def circle(start: Sequence[Column], radius: Column, angle: Column, s: Column) -> Vec:
    """Base move along a circle, to the left for a positive radius, the heading tangent to it: x, y, yaw."""
    yaw = start[2] + F.when(radius < 0, -1.0).otherwise(1.0) * s * F.abs(angle)
    return (start[0] + radius * (F.sin(yaw) - F.sin(start[2])), start[1] - radius * (F.cos(yaw) - F.cos(start[2])), yaw)


def base_seconds(length: Column, turn: Column, speed: float, turn_rate: float) -> Column:
    return move_duration(F.abs(length), F.abs(turn), speed, turn_rate, LEAST_BASE)


def curve_knots(params: DataFrame, keys: Sequence[str], start: Sequence[str], goal: Sequence[str], knots: int = KNOTS) -> DataFrame:
    """Knots of a cubic curve that leaves along the start's heading and arrives along the goal's: keys, ``i``, ``x``, ``y``,
    ``yaw`` (the tangent's, unwrapped from the start's), ``along`` (way from the start), and the ``next_*`` of each."""
    x0, y0, w0, x3, y3, w3 = (F.col(c) for c in (*start, *goal))
    third = F.hypot(x3 - x0, y3 - y0) / 3.0
    rows = params.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(knots - 1).cast("long"))))
    u, v = F.col("i") / float(knots - 1), 1.0 - F.col("i") / float(knots - 1)

    def axis(p0: Column, p3: Column, lead: Column, trail: Column) -> tuple[Column, Column]:
        p1, p2 = p0 + lead * third, p3 - trail * third
        point = v * v * v * p0 + 3.0 * u * v * v * p1 + 3.0 * u * u * v * p2 + u * u * u * p3
        return point, 3.0 * v * v * (p1 - p0) + 6.0 * u * v * (p2 - p1) + 3.0 * u * u * (p3 - p2)

    (x, dx), (y, dy) = axis(x0, x3, F.cos(w0), F.cos(w3)), axis(y0, y3, F.sin(w0), F.sin(w3))
    line = Axis(tuple(keys), "i", float(knots))
    rows = cut(unwrapped(rows.select(*keys, "i", x.alias("x"), y.alias("y"), F.atan2(dy, dx).alias("__tangent"), w0.alias("__w0")), "__tangent", "__yaw", line))
    first = rows.where("i = 0").select(*keys, (F.rint((F.col("__w0") - F.col("__yaw")) / (2.0 * F.pi())) * 2.0 * F.pi()).alias("__turns"))
    rows = rows.join(first, list(keys)).select(*keys, "i", "x", "y", (F.col("__yaw") + F.col("__turns")).alias("yaw"))
    rows = shift(rows, line, {"__px": (F.col("x"), -1), "__py": (F.col("y"), -1)} | {f"next_{c}": (F.col(c), 1) for c in ("x", "y", "yaw")})
    rows = running(rows.withColumn("__d", F.coalesce(F.hypot(F.col("x") - F.col("__px"), F.col("y") - F.col("__py")), F.lit(0.0))), line, {"along": ("sum", F.col("__d"))})
    return cut(shift(rows.drop("__px", "__py", "__d"), line, {"next_along": (F.col("along"), 1)}))


def curve_totals(knots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length and turned angle of each curve."""
    return knots.groupBy(*keys).agg(F.max("along").alias("length"), F.coalesce(F.sum(F.abs(F.col("next_yaw") - F.col("yaw"))), F.lit(0.0)).alias("turned"))


def along_curve(samples: DataFrame, knots: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """``samples`` with ``x``, ``y``, ``yaw`` where the way along the curve is ``at``: the knot before it, and the share of the way to the next."""
    values = ["x", "y", "yaw", "along", *(f"next_{c}" for c in ("x", "y", "yaw", "along"))]
    source = knots.select(*keys, F.col("along").alias("__way"), *values)
    hit = asof(samples.withColumn("__way", F.col(at)), source, "__way", values, Axis(tuple(keys), "__way", 1e6), prefix="__k_")
    gap = F.col("__k_next_along") - F.col("__k_along")
    share = F.when(gap > 0, (F.col(at) - F.col("__k_along")) / gap).otherwise(0.0)
    made = {c: F.col(f"__k_{c}") + F.coalesce(share * (F.col(f"__k_next_{c}") - F.col(f"__k_{c}")), F.lit(0.0)) for c in ("x", "y", "yaw")}
    return hit.withColumns(made).drop("__way", *[f"__k_{v}" for v in values])


# ---- hand strokes: position and unit quaternion at phase s

def reach(p: Vec, q: Vec, p1: Vec, relative: Vec, s: Column) -> tuple[Vec, Vec]:
    """Straight to ``p1`` while the hand turns along the geodesic; ``relative`` is the rotation vector from q to the goal."""
    return add(p, scale(sub(p1, p), s)), rotation.slerp(q, relative, s)


def approach(p: Vec, q: Vec, depth: Column, s: Column) -> tuple[Vec, Vec]:
    """Along the fingers (the tool's -z), back for a negative depth; the orientation stays."""
    ahead = rotation.rotate(q, (F.lit(0.0), F.lit(0.0), F.lit(-1.0)))
    return add(p, scale(ahead, s * depth)), q


def twist(p: Vec, q: Vec, angle: Column, s: Column) -> tuple[Vec, Vec]:
    """About the tool's own z; the place stays."""
    return p, rotation.multiply(q, (F.cos(s * angle / 2.0), F.lit(0.0), F.lit(0.0), F.sin(s * angle / 2.0)))


def about(axis: Vec, angle: Column) -> Vec:
    """Unit quaternion of a turn about an axis of any length."""
    n = norm(axis)
    return (F.cos(angle / 2.0), *(c / n * F.sin(angle / 2.0) for c in axis))


def tilt(p: Vec, q: Vec, centre: Vec, turn: Vec) -> tuple[Vec, Vec]:
    """Rigidly by ``turn`` (see ``about``), in the world, around ``centre``: a door, a lid, or a tilt about the grasp centre."""
    return add(centre, rotation.rotate(turn, sub(p, centre))), rotation.multiply(turn, q)


def tilt_radius(p: Vec, centre: Vec, axis: Vec) -> Column:
    """Distance of the hand from the axis it is tilted about."""
    return norm(cross(axis, sub(p, centre))) / norm(axis)
