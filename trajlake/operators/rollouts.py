"""Tier-P verdicts on recorded rollouts: steps, contacts, pad intervals, object tracks and replays, reduced to seventeen named gates.

Every table is reduced where it lies: steps and contacts by partial aggregation, pad contacts by an interval join with the
rows of a hand, carries by runs of closed rows. Only one row per episode and gate is left for the verdict."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from .blocks import Axis, interval_join
from .lineage import cut
from .physics import depth_rule, rest_required
from .sequence import mark_runs


@dataclass(frozen=True)
class Limits:
    """Limits of the gates (fixed values, metres, radians and seconds)."""

    arm_speed: float = 1.001
    neck_speed: float = radians(30) + 0.001
    base_vx: float = 0.611
    base_vy: float = 0.611
    base_wz: float = radians(114) + 0.001
    joint_margin: float = 0.025
    self_clearance: float = 0.009
    hand_object: float = 0.001
    robot_environment: float = 0.002
    object_environment: float = 0.002
    object_environment_margin: float = 0.001
    robot_self: float = 0.002
    acquisition_lift: float = 0.015
    bilateral_fraction: float = 0.95
    grasp_translation: float = 0.003
    grasp_rotation: float = radians(3)
    still_linear: float = 0.02
    still_angular: float = 0.2
    tcp_position: float = 0.03
    tcp_rotation: float = 0.2
    replay: float = 1e-7
    object_position: float = 0.03
    articulation_angle: float = 0.05
    moved_slide: float = 0.01
    moved_hinge: float = 0.05
    rest_window: float = 0.1

    def scaled(self, **values: float) -> "Limits":
        return replace(self, **values)


#: Gates in the order of their reasons (fixed names).
GATES = ("rollout_complete", "robot_environment_penetration", "object_environment_penetration", "hand_object_penetration", "no_nonhand_object_contact", "robot_self_penetration",
         "self_clearance", "joint_margin", "arm_speed", "neck_speed", "base_speed", "tcp_tracking", "grasp_drift", "carry_contact", "task_final_pose", "objects_at_rest", "actuator_replay")
DEPTHS = ("robot_environment", "object_environment", "hand_object", "robot_self")


def step_metrics(steps: DataFrame, keys: Sequence[str], row: str, *, finite: Column, joints: Sequence[tuple[str, Column, float, float]], arm: Sequence[Column], neck: Sequence[Column],
                 base: Mapping[str, Column], tcp_position: Sequence[Column], tcp_rotation: Sequence[Column], clearance: Column) -> DataFrame:
    """Per episode: steps done, least joint margin and its joint, peak speeds, tracking errors, least clearance.

    ``joints``: name, measured position, lower and upper limit. A NULL measurement is left out of its extreme."""
    inside = [F.least(q - F.lit(low), F.lit(high) - q) for _, q, low, high in joints]
    margin = F.least(*inside) if len(inside) > 1 else inside[0]
    name = F.coalesce(*[F.when(m == margin, F.lit(n)) for (n, *_), m in zip(joints, inside)])
    top = lambda cs: F.max(F.greatest(*[F.abs(c) for c in cs]) if len(cs) > 1 else F.abs(cs[0]))
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.bool_and(F.coalesce(finite, F.lit(False))).alias("finite"), F.min(margin).alias("margin"), F.min_by(name, F.struct(margin, row)).alias("margin_joint"),
        top(arm).alias("arm"), top(neck).alias("neck"), *[F.max(F.abs(base[c])).alias(c) for c in ("vx", "vy", "wz")], top(tcp_position).alias("tcp_p"), top(tcp_rotation).alias("tcp_r"),
        F.min(clearance).alias("clearance"))


def contact_metrics(contacts: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """Deepest contact of each kind, contacts of objects with anything but a hand, and the first of those.

    ``contacts``: keys, row, kind, pair, depth, settling. What objects do among themselves while they settle is kept apart."""
    depth = lambda kind, when: F.coalesce(F.max(F.when((F.col("kind") == kind) & when, F.col("depth"))), F.lit(0.0))
    settling, stray = F.col("settling"), F.col("kind") == "nonhand_object"
    return contacts.groupBy(*keys).agg(
        *[depth(k, ~settling if k == "object_environment" else F.lit(True)).alias(k) for k in DEPTHS], depth("object_environment", settling).alias("settle_depth"),
        F.count_if(stray).alias("stray"), F.min_by("pair", F.when(stray, F.struct(row, "pair"))).alias("stray_first"))


def bilateral(rows: DataFrame, pads: DataFrame, keys: Sequence[str], row: str, span: float) -> DataFrame:
    """``rows`` with ``both``: whether both pads of the hand touch the object there.

    ``pads``: keys, pad, start, stop (exclusive): the intervals in which a pad touches."""
    touched = interval_join(rows.select(*keys, row), pads.select(*keys, "pad", "start", (F.col("stop") - 1).alias("__end")), list(keys), row, "start", "__end", span)
    both = touched.groupBy(*keys, row).agg((F.count_distinct("pad") == 2).alias("both"))
    return rows.join(both, [*keys, row], "left").withColumn("both", F.coalesce("both", F.lit(False)))


def grasp_carries(rows: DataFrame, axis: Axis, *, near: Column, opened: Column, lift: Column, place: Sequence[Column], turn: Sequence[Column], dt: float, limits: Limits) -> DataFrame:
    """Carries per (episode, side, object) of ``axis.keys``, from rows with ``both``.

    A hand is closed while ``near`` (commanded below the closing point, or labelled) and not ``opened`` (commanded wider than
    its pads touch). A phase begins at the first closed row with both pads on and the object lifted, and is measured against
    the object's pose in the hand there (``place``, and the quaternion ``turn``); it ends with its closed run. A phase that the
    command ended is told from one that the closing point ended."""
    keys, row = list(axis.keys), F.col(axis.order)
    p, q = [f"__p{i}" for i in range(len(place))], [f"__q{i}" for i in range(4)]
    closed = near & ~F.coalesce(opened, F.lit(False))
    marked = mark_runs(rows.withColumns(dict(zip([*p, *q], [*place, *turn])) | {"__lift": lift, "__near": near, "__closed": closed}), F.when(closed, F.lit(1)), axis, "run")
    held = cut(marked.where(F.col("run").isNotNull()).select(*keys, axis.order, "run", "both", "__lift", *p, *q))
    starts = F.when(F.col("both") & (F.col("__lift") > limits.acquisition_lift), row)
    anchor = held.groupBy(*keys, "run").agg(F.min_by(F.struct(row.alias("row"), *p, *q), starts).alias("a")).where(F.col("a").isNotNull())
    carried = held.join(anchor, [*keys, "run"]).where(row >= F.col("a.row"))
    gone = F.sqrt(sum(((F.col(c) - F.col(f"a.{c}")) * (F.col(c) - F.col(f"a.{c}")) for c in p), F.lit(0.0)))
    angle = 2.0 * F.acos(F.least(F.abs(sum((F.col(c) * F.col(f"a.{c}") for c in q), F.lit(0.0))), F.lit(1.0)))
    phases = carried.groupBy(*keys, "run").agg((F.max(row) + 1).alias(axis.order), F.count(F.lit(1)).alias("rows"), F.count_if("both").alias("pads"), F.max(gone).alias("moved"), F.max(angle).alias("turned"))
    after = marked.where(~F.col("__closed")).select(*keys, axis.order, F.col("__near").alias("__kept"))
    phases = phases.join(after, [*keys, axis.order], "left")
    return phases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("phases"), (F.sum("rows") * dt).alias("carry_s"), (F.sum("pads") * dt).alias("bilateral_s"), F.max("moved").alias("translation"), F.max("turned").alias("rotation"),
        F.count_if("__kept").alias("wide_releases"), F.count_if(~F.col("__kept")).alias("open_releases")).withColumn("fraction", F.col("bilateral_s") / F.col("carry_s"))


def source_ends(tracks: DataFrame, time: str, place: Sequence[str], turn: Sequence[str], axis: Axis, limits: Limits) -> DataFrame:
    """How source tracks end: last valid row and pose, speeds since the earliest valid row of the window before it, and rest.

    ``at_rest`` is NULL where no earlier row lies in the window."""
    keys = list(axis.keys)
    seen = F.struct(F.col(axis.order).alias("row"), F.col(time).alias("t"), *place, *turn)
    valid = tracks.where(F.col("valid"))
    last = valid.groupBy(*keys).agg(F.max_by(seen, axis.order).alias("e"))
    inside = valid.join(last, keys).where((F.col(time) >= F.col("e.t") - limits.rest_window - 1e-9) & (F.col(time) < F.col("e.t") - 1e-9))
    out = last.join(inside.groupBy(*keys).agg(F.min_by(seen, axis.order).alias("s")), keys, "left")
    dt = F.col("e.t") - F.col("s.t")
    linear = F.sqrt(sum(((F.col(f"e.{c}") - F.col(f"s.{c}")) * (F.col(f"e.{c}") - F.col(f"s.{c}")) for c in place), F.lit(0.0))) / dt
    angular = 2.0 * F.acos(F.least(F.abs(sum((F.col(f"e.{c}") * F.col(f"s.{c}") for c in turn), F.lit(0.0))), F.lit(1.0))) / dt
    rest = (linear < limits.still_linear) & (angular < limits.still_angular)
    return out.select(*keys, F.col("e.row").alias("source_row"), *[F.col(f"e.{c}").alias(f"source_{c}") for c in place], linear.alias("linear"), angular.alias("angular"), rest.alias("at_rest"))


def object_tasks(ends: DataFrame, rollout: DataFrame, place: Sequence[str], keys: Sequence[str], row: str, limits: Limits) -> DataFrame:
    """Task rows of manipulated objects: how far the rollout leaves each from where the source left it.

    After the hold (the rollout's last row) when the source was at rest at its end or that is unknown, else at the row that
    reaches the source's last one. ``rollout``: keys, object, row, place, ``last``."""
    group = [*keys, "object"]
    at = F.when(F.col("at_rest") == F.lit(False), F.least("source_row", "last")).otherwise(F.col("last"))
    wanted = rollout.select(*group, "last").distinct().join(ends, group).withColumn(row, at)
    met = wanted.join(rollout.select(*group, row, *place), [*group, row])
    error = F.sqrt(sum(((F.col(c) - F.col(f"source_{c}")) * (F.col(c) - F.col(f"source_{c}")) for c in place), F.lit(0.0)))
    rule = F.when(F.col("at_rest") == F.lit(False), "source_end").otherwise("after_hold")
    return met.select(*keys, F.col("object").alias("name"), rule.alias("rule"), F.lit("m").alias("unit"), error.alias("error"), F.lit(limits.object_position).alias("tolerance"))


def joint_tasks(tracks: DataFrame, keys: Sequence[str], row: str, limits: Limits) -> DataFrame:
    """Task rows of scene joints that the source moved: final position against the source's last. ``tracks``: keys, joint, row, slide, source, final."""
    g = tracks.groupBy(*keys, "joint", "slide").agg((F.max("source") - F.min("source")).alias("moved"), F.max_by("source", F.when(F.col("source").isNotNull(), F.col(row))).alias("target"),
                                                    F.max_by("final", row).alias("final"))
    least = F.when(F.col("slide"), limits.moved_slide).otherwise(limits.moved_hinge)
    return g.where(F.col("moved") >= least).select(
        *keys, F.col("joint").alias("name"), F.lit("articulation_final").alias("rule"), F.when(F.col("slide"), "m").otherwise("rad").alias("unit"), F.abs(F.col("final") - F.col("target")).alias("error"),
        F.when(F.col("slide"), limits.object_position).otherwise(limits.articulation_angle).alias("tolerance"))


def base_tasks(steps: DataFrame, keys: Sequence[str], row: str, place: Sequence[str], goal: Sequence[str], limits: Limits) -> DataFrame:
    """Task rows of navigation: the base's last place against the last one of its reference."""
    g = steps.groupBy(*keys).agg(F.max_by(F.struct(*place, *goal), row).alias("e"))
    error = F.sqrt(sum(((F.col(f"e.{a}") - F.col(f"e.{b}")) * (F.col(f"e.{a}") - F.col(f"e.{b}")) for a, b in zip(place, goal)), F.lit(0.0)))
    return g.select(*keys, F.lit("base").alias("name"), F.lit("navigation_destination").alias("rule"), F.lit("m").alias("unit"), error.alias("error"), F.lit(limits.object_position).alias("tolerance"))


def replay_difference(steps: DataFrame, again: DataFrame, keys: Sequence[str], row: str, columns: Sequence[str]) -> DataFrame:
    """Greatest absolute difference between a rollout and its replay; NULL where the replay has other rows."""
    a = steps.select(*keys, row, *columns)
    b = again.select(*keys, row, F.lit(True).alias("__there"), *[F.col(c).alias(f"__again_{c}") for c in columns])
    a = a.withColumn("__here", F.lit(True))
    gap = [F.abs(F.col(c) - F.col(f"__again_{c}")) for c in columns]
    g = a.join(b, [*keys, row], "full").groupBy(*keys).agg(F.max(F.greatest(*gap) if len(gap) > 1 else gap[0]).alias("d"), F.bool_and(F.col("__here").isNotNull() & F.col("__there").isNotNull()).alias("same"))
    return g.select(*keys, F.when(F.col("same"), F.col("d")).alias("replay"))


def _listed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column, checks: Mapping[str, Column], name: str) -> DataFrame:
    """Texts of an episode's few items joined in order, with whether all of them hold. Items are hands, objects or joints of one scene."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("__text")))).alias("__l"), *[F.bool_and(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    return g.select(*keys, *checks, F.array_join(F.transform("__l", lambda x: x["__text"]), "; ").alias(name))


def gates(rollouts: DataFrame, metrics: DataFrame, contacts: DataFrame, carries: DataFrame, tasks: DataFrame, bodies: DataFrame, replays: DataFrame, keys: Sequence[str], limits: Limits) -> DataFrame:
    """Seventeen rows per rollout: keys, ``position``, ``gate``, ``ok``, ``detail``.

    ``rollouts``: keys, expected (steps), warnings, reference (deepest source contact, or NULL), unmapped (objects without a
    body, as text, or NULL). ``bodies``: keys, body, object, at_rest, held_at_end, linear, angular. A rollout without
    steps fails what it has no measurement for; one without contacts, carries or bodies passes their gates."""
    ks, written = list(keys), lambda digits: lambda c: fixed(c, digits)
    four, three = written(4), written(3)
    grasp = _listed(carries.withColumn("__n", F.concat_ws("/", "side", "object")), ks, ["__n"], F.concat("__n", F.lit(": "), four(F.col("translation")), F.lit(" m, "), four(F.col("rotation")), F.lit(" rad")),
                    {"drift_ok": (F.col("translation") <= limits.grasp_translation) & (F.col("rotation") <= limits.grasp_rotation)}, "drift")
    pads = _listed(carries.withColumn("__n", F.concat_ws("/", "side", "object")), ks, ["__n"], F.concat("__n", F.lit(": "), four(F.col("fraction"))), {"pads_ok": F.col("fraction") >= limits.bilateral_fraction}, "pads")
    task = _listed(tasks, ks, ["name"], F.concat("name", F.lit(": "), four(F.col("error")), F.lit(" "), F.col("unit"), F.lit(" ("), F.col("rule"), F.lit(")")), {"task_ok": F.col("error") <= F.col("tolerance")}, "task")
    judged = rest_required(bodies)
    still = (F.col("linear") < limits.still_linear) & (F.col("angular") < limits.still_angular)
    rest = _listed(judged, ks, ["body"], F.concat("body", F.lit(": "), three(F.col("linear")), F.lit(" m/s "), three(F.col("angular")), F.lit(" rad/s"), F.when(F.col("required"), "").otherwise(" (reported only)")),
                   {"rest_ok": still | ~F.col("required")}, "rest")
    all_ = rollouts
    for part in (metrics, contacts, grasp, pads, task, rest, replays):
        all_ = all_.join(part, ks, "left")
    all_ = all_.fillna(0.0, [*DEPTHS, "settle_depth"]).fillna(0, ["stray", "steps"]).fillna(False, ["finite"])
    deep = depth_rule(F.col("object_environment"), F.col("reference"), absolute=limits.object_environment, margin=limits.object_environment_margin)
    all_ = all_.withColumns({"__deep_ok": deep[1], "__deep_rule": deep[3]})
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    depth = lambda k: (F.col(k) <= getattr(limits, k), F.concat(four(F.col(k)), F.lit(" m")))
    fine = lambda c: F.coalesce(F.col(c), F.lit(True))
    done = F.col("finite") & (F.col("steps") == F.col("expected")) & (F.col("warnings") == 0)
    unmapped = F.when(F.col("unmapped").isNotNull(), F.concat(F.lit("; unmapped objects "), F.col("unmapped"))).otherwise("")
    judged = {
        "rollout_complete": (done, F.concat(F.lit("steps "), text("steps"), F.lit("/"), text("expected"), F.lit(", finite="), text("finite"), F.lit(", warnings="), text("warnings"))),
        "robot_environment_penetration": depth("robot_environment"),
        "object_environment_penetration": (F.col("__deep_ok"), F.concat(four(F.col("object_environment")), F.lit(" m, "), F.col("__deep_rule"))),
        "hand_object_penetration": depth("hand_object"),
        "no_nonhand_object_contact": (F.col("stray") == 0, F.concat(text("stray"), F.lit(" contacts, first "), text("stray_first"))),
        "robot_self_penetration": depth("robot_self"),
        "self_clearance": (F.col("clearance") >= limits.self_clearance, F.concat(four(F.col("clearance")), F.lit(" m"))),
        "joint_margin": (F.col("margin") >= limits.joint_margin, F.concat(four(F.col("margin")), F.lit(" rad at "), text("margin_joint"))),
        "arm_speed": (F.col("arm") <= limits.arm_speed, F.concat(three(F.col("arm")), F.lit(" rad/s"))),
        "neck_speed": (F.col("neck") <= limits.neck_speed, F.concat(three(F.col("neck")), F.lit(" rad/s"))),
        "base_speed": ((F.col("vx") <= limits.base_vx) & (F.col("vy") <= limits.base_vy) & (F.col("wz") <= limits.base_wz),
                       F.concat(F.lit("body vx, vy, wz = "), F.concat_ws(", ", *[three(F.col(c)) for c in ("vx", "vy", "wz")]))),
        "tcp_tracking": ((F.col("tcp_p") <= limits.tcp_position) & (F.col("tcp_r") <= limits.tcp_rotation), F.concat(four(F.col("tcp_p")), F.lit(" m, "), four(F.col("tcp_r")), F.lit(" rad"))),
        "grasp_drift": (fine("drift_ok"), F.coalesce("drift", F.lit("no carry"))),
        "carry_contact": (fine("pads_ok"), F.coalesce("pads", F.lit("no carry"))),
        "task_final_pose": (F.coalesce("task_ok", F.lit(False)) & F.col("unmapped").isNull(), F.concat(F.coalesce("task", F.lit("no manipulated object with a scene body")), unmapped)),
        "objects_at_rest": (fine("rest_ok"), F.coalesce("rest", F.lit("no free body"))),
        "actuator_replay": (F.col("replay") <= limits.replay, F.concat(F.lit("max |diff| "), F.coalesce(written(6)(F.col("replay")), F.lit("none")))),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("gate"), F.coalesce(judged[n][0], F.lit(False)).alias("ok"), F.coalesce(judged[n][1], F.lit("not measured")).alias("detail")) for i, n in enumerate(GATES)])
    return all_.select(*ks, F.explode(rows).alias("g")).select(*ks, "g.*")


def verdicts(gated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per rollout: ``passed``, ``failures`` and the reasons ``name: detail`` of the failing gates in their order."""
    reason = F.struct("position", F.concat("gate", F.lit(": "), "detail").alias("text"))
    g = gated.groupBy(*keys).agg(F.bool_and("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failures"), F.array_sort(F.collect_list(F.when(~F.col("ok"), reason))).alias("r"))
    return g.select(*keys, "passed", "failures", F.transform("r", lambda x: x.text).alias("reasons"))
