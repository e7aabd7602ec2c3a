"""Generated scenarios: stratified cells, weighted axes, sibling groups, motion samples, retries.

Draws come from a hash of (namespace, split, key, axis), so a scenario depends on its own key only: any
subset of indices can be generated anywhere, in any order, with the same result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gripper import min_jerk

# Stratification slots, categorical axes and their weights, retry factors.
CELLS = ("reach_target", "reach_target", "gaze_target", "gaze_target", "left", "right", "bimanual_independent", "navigation", "joint_move", "drive_target")
MOBILE = ("navigation", "drive_target")
KEEP_GRIPPERS = ("reach_target", "gaze_target", "joint_move", "drive_target", "navigation")
AXES = {
    "neck": (("off", "hold", "world_hold", "look_at_point", "look_at_hand", "look_ahead", "shift"), (0.25, 0.1, 0.1, 0.15, 0.15, 0.1, 0.15)),
    "extent": (("small", "medium", "large"), (0.35, 0.4, 0.25)),
    "speed": (("slow", "normal", "fast"), (0.3, 0.45, 0.25)),
    "start": (("home", "ready", "rest", "random"), (0.3, 0.2, 0.15, 0.35)),
    "gripper": (("keep_open", "keep_closed", "close", "open", "partial"), (0.25, 0.15, 0.25, 0.2, 0.15)),
    "base_motion": (("drive", "strafe", "turn", "arc", "curve"), (0.3, 0.15, 0.15, 0.2, 0.2)),
}
SHRINK, SLOWER = 0.75, 1.5


def uniform(*parts) -> Column:
    """Reproducible number in [0, 1) from text parts."""
    key = F.sha1(F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)


def choose(u: Column, options: Sequence[str], weights: Sequence[float]) -> Column:
    total, upto = sum(weights), 0.0
    pick = None
    for option, w in zip(options[:-1], weights[:-1]):
        upto += w
        test = u < round(upto / total, 9)
        pick = F.when(test, option) if pick is None else pick.when(test, option)
    return pick.otherwise(options[-1]) if pick is not None else F.lit(options[0])


def cell(namespace: str, split: str, unit: Column) -> Column:
    """The slot of an index: every block of ten indices is a permutation of the ten slots."""
    n = len(CELLS)
    block = F.floor(unit / n).cast("string")
    ranked = F.array_sort(F.array(*[F.struct(F.sha1(F.concat_ws("/", F.lit(namespace), F.lit(split), block, F.lit(str(i))).cast("binary")).alias("h"),
                                             F.lit(i).alias("slot")) for i in range(n)]))
    slot = F.get(ranked, F.pmod(unit, F.lit(n)).cast("int"))["slot"]
    return F.element_at(F.array(*[F.lit(c) for c in CELLS]), slot + 1)


def scenarios(indices: DataFrame, index: str, namespace: str, split: str, group_size: int = 1) -> DataFrame:
    """The scenario of every index; siblings of a group share everything their start depends on."""
    i = F.col(index)
    group = F.floor(i / group_size).cast("long") if group_size > 1 else F.lit(None).cast("long")
    member = F.pmod(i, F.lit(group_size)).cast("long") if group_size > 1 else F.lit(None).cast("long")
    unit = F.coalesce(group, i)
    key = F.concat(F.lit("g" if group_size > 1 else ""), F.format_string("%06d", unit))
    out = indices.select(index, group.alias("group"), member.alias("member"), key.alias("key"), cell(namespace, split, unit).alias("cell"))
    drawn = {a: choose(uniform(namespace, split, F.col("key"), a), *spec) for a, spec in AXES.items()}
    mobile, c = F.col("cell").isin(*MOBILE), F.col("cell")
    neck = (F.when(c == "gaze_target", "gaze_target").when(c == "joint_move", F.when(uniform(namespace, split, F.col("key"), "joint") < 0.25, "joint").otherwise("off"))
            .when(c.isin("reach_target", "drive_target"), "off").when((drawn["neck"] == "look_ahead") & ~mobile, "look_at_point").otherwise(drawn["neck"]))
    still = F.when(drawn["gripper"].isin("keep_open", "open"), "keep_open").otherwise("keep_closed")
    base = F.when(c == "drive_target", "drive_target").when(mobile, drawn["base_motion"])
    return out.select(index, "group", "member", "key", "cell", neck.alias("neck"), drawn["extent"].alias("extent"), drawn["speed"].alias("speed"), drawn["start"].alias("start"),
                      F.when(c.isin(*KEEP_GRIPPERS), still).otherwise(drawn["gripper"]).alias("gripper"), base.alias("base_motion"))


def sampled(params: DataFrame, keys: Sequence[str], seconds: Column, rate: float) -> DataFrame:
    """Parameter rows expanded to a uniform clock: ``k``, time and min-jerk phase ``s`` in [0, 1]."""
    n = F.ceil(seconds * rate - 1e-9)
    out = params.withColumn("__n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    t = F.col("k") / rate
    return out.withColumns({"time": t, "s": min_jerk(t / seconds)}).drop("__n")


def line(a: Sequence[Column], b: Sequence[Column], s: Column) -> list[Column]:
    return [p + s * (q - p) for p, q in zip(a, b)]


def bowed(a: Sequence[Column], b: Sequence[Column], bulge: Sequence[Column], s: Column) -> list[Column]:
    """Quadratic curve from a to b whose middle is off the chord's by ``bulge``."""
    out = []
    for p, q, h in zip(a, b, bulge):
        c = (p + q) / 2.0 + 2.0 * h
        out.append((1.0 - s) * (1.0 - s) * p + 2.0 * s * (1.0 - s) * c + s * s * q)
    return out


def hinge(start: Sequence[Column], centre: Sequence[Column], angle: Column, s: Column) -> list[Column]:
    """A point turned about a vertical line through ``centre``."""
    dx, dy = start[0] - centre[0], start[1] - centre[1]
    c, n = F.cos(angle * s), F.sin(angle * s)
    return [centre[0] + c * dx - n * dy, centre[1] + n * dx + c * dy]


def arc(radius: Column, angle: Column, s: Column) -> list[Column]:
    """Base pose along an arc from the origin: x, y, yaw."""
    a = angle * s
    return [radius * F.sin(a), radius * (1.0 - F.cos(a)), a]


def stretched(ratio: Column, fraction: float = 0.85) -> Column:
    """How much longer a base path must take so that its speed stays below a fraction of the limits."""
    return F.greatest(F.lit(1.0), ratio / fraction)


def next_attempt(attempts: DataFrame) -> DataFrame:
    """The size and time of the retry after each failed attempt: a failed pre-screen shrinks the motion; a saturated
    attempt that was not slowed yet is slowed; any other is made smaller."""
    slow = F.col("screened") & F.col("saturated") & (F.col("time") <= 1.0)
    return attempts.withColumns({"next_size": F.when(slow, F.col("size")).otherwise(F.col("size") * SHRINK),
                                 "next_time": F.when(slow, F.col("time") * SLOWER).otherwise(F.col("time"))})
