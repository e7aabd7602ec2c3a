"""Control views: named action and state columns derived from the canonical robot state.

A view row at state row t targets row t + 1; the last row has no action. Views are Column expressions
on a frame that pairs every row with its successor, so asking for one view prunes the others away.

Input columns: ``x, y, yaw`` base pose; ``q, qd`` 22-joint arrays; TCP poses in the base frame
``a*`` (left) and ``b*`` (right) as ``x y z qw qx qy qz``; head orientation ``hqw..hqz``; openings
``open_l, open_r``.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar, pose, rotation
from ..functions.pose import Pose
from ..functions.vectors import Sheet, cols, scale, sub
from .blocks import Axis, shift

HZ = 50
DT = 1.0 / HZ
SIDES = {"left": "a", "right": "b"}
# Component names of rotations, increments and twists.
QUAT = ("qw", "qx", "qy", "qz")
ROT6D = ("r00", "r10", "r20", "r01", "r11", "r21")
DELTA = ("dx", "dy", "dz", "rx", "ry", "rz")
TWIST = ("vx", "vy", "vz", "wx", "wy", "wz")
_ARM = ("shoulder_pitch", "shoulder_roll", "elbow_yaw", "elbow_pitch", "wrist_roll", "wrist_pitch", "wrist_yaw")
# Joint order of the robot state.
JOINTS = ("base_x", "base_y", "base_yaw", *(f"l_{j}" for j in _ARM), *(f"r_{j}" for j in _ARM),
          "neck_roll", "neck_pitch", "neck_yaw", "l_hand_finger", "r_hand_finger")


class Pair:
    """A state row and its successor, with intermediates projected once and shared between views."""

    def __init__(self, df: DataFrame, axis: Axis):
        self.sheet = Sheet(shift(df, axis, {f"next_{c}": (F.col(c), 1) for c in df.columns if c not in (*axis.keys, axis.order)}))
        self._made: dict[str, tuple] = {}

    def once(self, name: str, make: Callable[[], Sequence[Column]]) -> tuple:
        if name not in self._made:
            self._made[name] = self.sheet.put(name, make())
        return self._made[name]

    def tcp(self, side: str, at: str = "") -> Pose:
        p = f"{at}{SIDES[side]}"
        return Pose(cols(*(p + c for c in "xyz")), cols(*(p + c for c in QUAT)))

    def head(self, at: str = "") -> tuple:
        return cols(*(f"{at}h{c}" for c in QUAT))

    def base(self, at: str = "") -> tuple:
        return cols(f"{at}x", f"{at}y", f"{at}yaw")

    def world(self, side: str, at: str) -> Pose:
        b = self.base(at)
        p, q = self.tcp(side, at)
        x, y = planar.to_world(p[0], p[1], b[2])
        zero = F.lit(0.0)
        spin = self.once(f"{at}spin", lambda: (F.cos(b[2] / 2.0), F.sin(b[2] / 2.0)))
        turned = self.once(f"{at}{side}_wq", lambda: rotation.multiply((spin[0], zero, zero, spin[1]), q))
        return Pose((b[0] + x, b[1] + y, p[2]), turned)

    def tool_step(self, side: str) -> Pose:
        """The next TCP pose seen from the current one; rotation with w >= 0."""
        now, then = self.tcp(side), self.tcp(side, "next_")
        p = self.once(f"{side}_dp", lambda: rotation.unrotate(now.q, sub(then.p, now.p)))
        raw = self.once(f"{side}_dq0", lambda: rotation.multiply(rotation.conjugate(now.q), then.q))
        return Pose(p, self.once(f"{side}_dq", lambda: rotation.canonical(raw)))

    def base_step(self) -> tuple:
        return self.once("base_step", lambda: planar.relative(self.base(), self.base("next_")))


    # Quantities the views are made of, each a sequence of columns; those of a hand take its side.

    def next_joints(self) -> Sequence[Column]:
        return [F.col("next_q")[i] for i in range(len(JOINTS))]

    def joint_steps(self) -> Sequence[Column]:
        steps = [F.col("next_q")[i] - F.col("q")[i] for i in range(len(JOINTS))]
        return [planar.wrap(c) if name == "base_yaw" else c for name, c in zip(JOINTS, steps)]

    def joint_speeds(self) -> Sequence[Column]:
        return [F.col("qd")[i] for i in range(len(JOINTS))]

    def hand_pose(self, side: str, at: str, frame: str, *, quaternion: bool) -> Sequence[Column]:
        p, q = self.world(side, at) if frame == "world" else self.tcp(side, at)
        six = self.once(f"{at}{side}_{frame}_six", lambda: rotation.six(q))
        return (*p, *six, *(rotation.canonical(q) if quaternion else ()))

    def step_in_tool(self, side: str) -> Sequence[Column]:
        step = self.tool_step(side)
        return (*step.p, *rotation.log(step.q))

    def step_in_base(self, side: str) -> Sequence[Column]:
        now, then = self.tcp(side), self.tcp(side, "next_")
        turn = self.once(f"{side}_lq0", lambda: rotation.multiply(then.q, rotation.conjugate(now.q)))
        return (*sub(then.p, now.p), *rotation.log(self.once(f"{side}_lq", lambda: rotation.canonical(turn))))

    def tool_twist(self, side: str) -> Sequence[Column]:
        step = self.tool_step(side)
        w = self.once(f"{side}_w", lambda: rotation.log(step.q))
        return scale(pose.log(step.p, w), 1.0 / DT)

    def head_turn(self) -> Sequence[Column]:
        return rotation.six(self.once("head_turn", lambda: rotation.multiply(rotation.conjugate(self.head()), self.head("next_"))))


#: Column names with the quantity that fills them; ``{side}`` stands for either hand.
Part = tuple[Sequence[str], Callable[..., Sequence[Column]]]
PLACE = ("x", "y", "z")


def _prefixed(prefix: str, *names: str) -> tuple[str, ...]:
    return tuple(prefix + n for n in names)


def _hands(at: str, frame: str = "base", quaternion: bool = True) -> Part:
    names = _prefixed("{side}_", *PLACE, *ROT6D, *(QUAT if quaternion else ()))
    return names, lambda p, side: p.hand_pose(side, at, frame, quaternion=quaternion)


def _head(at: str) -> Part:
    return _prefixed("head_", *ROT6D), lambda p: rotation.six(p.head(at))


BASE_STEP: Part = (_prefixed("base_", "dx", "dy", "dyaw"), lambda p: p.base_step())
OPEN_OR_NOT: Part = (("{side}_gripper_open",), lambda p, side: [(F.col(f"next_open_{side[0]}") >= 0.5).cast("double")])

#: The columns of every view: whole-robot joints, hands, head, base, grippers, and the agent's combination of them.
COLUMNS: dict[str, Sequence[Part]] = {
    "joint_pos_abs": [(JOINTS, Pair.next_joints)],
    "joint_pos_delta": [(JOINTS, Pair.joint_steps)],
    "joint_vel": [(JOINTS, Pair.joint_speeds)],
    "ee_abs_base": [_hands("next_")],
    "ee_abs_world": [_hands("next_", "world")],
    "ee_delta_base": [(_prefixed("{side}_tool_", *DELTA) + _prefixed("{side}_base_", *DELTA), lambda p, side: (*p.step_in_tool(side), *p.step_in_base(side)))],
    "ee_twist_tool": [(_prefixed("{side}_", *TWIST), Pair.tool_twist)],
    "head_rot_abs": [_head("next_")],
    "head_rot_delta": [(_prefixed("head_d", *ROT6D), Pair.head_turn)],
    "base_twist_body": [(_prefixed("base_", "vx", "vy", "wz"), lambda p: planar.log(p.base_step(), DT))],
    "base_se2_delta": [BASE_STEP],
    "gripper_continuous": [(("{side}_gripper_opening",), lambda p, side: [F.col(f"next_open_{side[0]}")])],
    "gripper_binary": [OPEN_OR_NOT],
    "agent_v8": [_hands("next_", quaternion=False), _head("next_"), BASE_STEP, OPEN_OR_NOT],
    "agent_v8_state": [_hands("", quaternion=False), _head(""), (_prefixed("base_world_", "x", "y", "sin_yaw", "cos_yaw"), lambda p: [F.col("x"), F.col("y"), F.sin("yaw"), F.cos("yaw")]),
                       (("{side}_gripper_opening",), lambda p, side: [F.col(f"open_{side[0]}")])],
}

#: What the numbers mean: frame, units, and the rule in words.
MEANING = {
    "joint_pos_abs": ("joints; base in world", "m, rad", "joint values of the next row"),
    "joint_pos_delta": ("joints; base in world", "m, rad", "joint increments to the next row, base yaw wrapped"),
    "joint_vel": ("joints; base in world", "m/s, rad/s", "joint velocities held until the next row"),
    "ee_abs_base": ("base at t+1", "m, rotation6d and wxyz", "TCP poses of the next row in its base frame"),
    "ee_abs_world": ("world", "m, rotation6d and wxyz", "TCP poses of the next row in the world"),
    "ee_delta_base": ("tool: current TCP; base: base link", "m, rad", "pose increments to the next row, body and base sided"),
    "ee_twist_tool": ("current TCP", "m/s, rad/s", "constant body twist that reaches the next TCP pose"),
    "head_rot_abs": ("base at t+1", "rotation6d", "head orientation of the next row"),
    "head_rot_delta": ("current head", "rotation6d", "head turn to the next row"),
    "base_twist_body": ("base at t", "m/s, rad/s", "constant body twist that reaches the next base pose"),
    "base_se2_delta": ("base at t", "m, rad", "base displacement to the next row"),
    "gripper_continuous": ("gripper", "opening in [0, 1]", "openings of the next row"),
    "gripper_binary": ("gripper", "0 or 1", "1 when the next row's opening is at least one half"),
    "agent_v8": ("TCP and head: base at t+1; base: base at t", "m, rotation6d, 0/1; float32", "29 action values: TCP poses, head, base displacement, binary grippers"),
    "agent_v8_state": ("TCP and head: base at t; base: world", "m, rotation6d, sin/cos; float32", "30 state values of every row, the last one included"),
}
MODES = tuple(COLUMNS)
#: Views whose values are single precision, and views that have a value in the last row too.
FLOAT_VIEWS, STATE_VIEWS = ("agent_v8", "agent_v8_state"), ("agent_v8_state",)


def _filled(pair: Pair, parts: Sequence[Part]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for names, quantity in parts:
        if "{side}" in names[0]:
            for side in SIDES:
                out.update(zip((n.format(side=side) for n in names), quantity(pair, side)))
        else:
            out.update(zip(names, quantity(pair)))
    return out


def view(df: DataFrame, name: str, axis: Axis) -> DataFrame:
    """One control view as a table: keys, row and the view's columns (units and meaning as column metadata)."""
    pair = Pair(df, axis)
    made = _filled(pair, COLUMNS[name])
    out = pair.sheet.df if name in STATE_VIEWS else pair.sheet.df.where(F.col("next_q").isNotNull())
    about = dict(zip(("mode", "frame", "units", "semantics"), (name, *MEANING[name])))
    cast = "float" if name in FLOAT_VIEWS else "double"
    return out.select(*axis.keys, axis.order, *[c.cast(cast).alias(n, metadata=about) for n, c in made.items()])
