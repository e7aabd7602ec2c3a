"""Control-view and rigid-motion queries on the pose table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pose as P
from ..functions import rotation as R
from ..functions.vectors import Sheet, cols, norm, sub
from ..operators import control_views as V
from ..sources import landing as L
from . import sqlkit as K
from .registry import query, r6
from .sqlbase import POSES, with_

SIDE = {"left": "a", "right": "b"}


def state(spark, d):
    """The pose table as robot state: the base pose comes from the first three joints."""
    p = L.poses(spark, d)
    q = F.col("q")
    return p.select("episode", "row", *[c for c in p.columns if c not in ("episode", "row", "vec_id")],
                    (q[0] * 3.0).alias("x"), (q[1] * 3.0).alias("y"), (q[2] * 12.0).alias("yaw"))


STATE_COLS = [f"{s}{c}" for s in "ab" for c in ("x", "y", "z", *K.Q)] + [f"h{c}" for c in K.Q] + ["q", "qd", "open_l", "open_r", "x", "y", "yaw"]
STATE = POSES + """,
state AS (SELECT *, q[1]*3.0::DOUBLE AS x, q[2]*3.0::DOUBLE AS y, q[3]*12.0::DOUBLE AS yaw FROM poses),
""" + f"""pair0 AS (SELECT *, {K.lead(STATE_COLS)} FROM state WINDOW w AS (PARTITION BY episode ORDER BY row)),
pair AS (SELECT * FROM pair0 WHERE n_q IS NOT NULL)"""


def add(name: str, mode: str, ids, sql: str, digits: int = 6):
    def build(spark, d):
        out = V.view(state(spark, d), mode, L.FRAMES)
        return out.select("episode", "row", *[r6(F.col(c).cast("double"), digits).alias(c) for c in out.columns[2:]])
    query(name, *ids, sql=sql)(build)


def stmt(*ctes: str, select: str, source: str) -> str:
    body = ",\n".join(ctes)
    return with_(STATE, (body + "\n" if body else "") + f"SELECT episode, row, {select} FROM {source}")


WRAP = "({0}) + pi() - 2*pi()*floor((({0}) + pi()) / (2*pi())) - pi()"
joints = [f'"{j}"' for j in V.JOINTS]
add("cm01_joint_pos_abs", "joint_pos_abs", ["CM1", "UX1"],
    stmt(select=K.alias([f"n_q[{i + 1}]" for i in range(22)], joints, 6), source="pair"))
add("cm02_joint_pos_delta", "joint_pos_delta", ["CM2"],
    stmt(select=K.alias([WRAP.format("n_q[3] - q[3]") if i == 2 else f"n_q[{i + 1}] - q[{i + 1}]" for i in range(22)], joints, 6), source="pair"))
add("cm03_joint_vel", "joint_vel", ["CM3"],
    stmt(select=K.alias([f"qd[{i + 1}]" for i in range(22)], joints, 6), source="pair"))


def ee_select(of) -> str:
    parts = []
    for side in SIDE:
        p, q = of(side)
        flip = f"(CASE WHEN {q[0]} < 0 THEN -1 ELSE 1 END)"
        parts += [K.alias(p, [f"{side}_{c}" for c in "xyz"], 6), K.alias(K.six(q), [f"{side}_{c}" for c in V.ROT6D], 6),
                  K.alias([f"{c}*{flip}" for c in q], [f"{side}_{c}" for c in K.Q], 6)]
    return ", ".join(parts)


add("cm04_ee_abs_base", "ee_abs_base", ["CM4"],
    stmt(select=ee_select(lambda s: (K.names(f"n_{SIDE[s]}", "xyz"), K.q_of(f"n_{SIDE[s]}"))), source="pair"))
world = []
for side, k in SIDE.items():
    spin = ["cos(n_yaw/2)", "0.0", "0.0", "sin(n_yaw/2)"]
    world += [f"n_x + cos(n_yaw)*n_{k}x - sin(n_yaw)*n_{k}y AS w{k}x", f"n_y + sin(n_yaw)*n_{k}x + cos(n_yaw)*n_{k}y AS w{k}y",
              f"n_{k}z AS w{k}z", K.alias(K.mul(spin, K.q_of(f"n_{k}")), K.q_of(f"w{k}"))]
add("cm05_ee_abs_world", "ee_abs_world", ["CM5", "FN-R9"],
    stmt(f"world AS (SELECT *, {', '.join(world)} FROM pair)",
         select=ee_select(lambda s: (K.names(f"w{SIDE[s]}", "xyz"), K.q_of(f"w{SIDE[s]}"))), source="world"))

steps = []
for side, k in SIDE.items():
    diff = K.minus(K.names(f"n_{k}", "xyz"), K.p_of(k))
    steps += [K.alias(K.apply(K.transpose(K.matrix(K.q_of(k))), diff), K.names(f"s{k}", "xyz")),
              K.alias(K.mul(K.conj(K.q_of(k)), K.q_of(f"n_{k}")), K.q_of(f"s{k}")),
              K.alias(K.mul(K.q_of(f"n_{k}"), K.conj(K.q_of(k))), K.q_of(f"l{k}")), K.alias(diff, K.names(f"d{k}", "xyz"))]
STEPS = f"steps AS (SELECT *, {', '.join(steps)} FROM pair)"
parts = []
for side, k in SIDE.items():
    parts += [K.alias([*K.names(f"s{k}", "xyz"), *K.log(K.q_of(f"s{k}"))], [f"{side}_tool_{c}" for c in V.DELTA], 6),
              K.alias([*K.names(f"d{k}", "xyz"), *K.log(K.q_of(f"l{k}"))], [f"{side}_base_{c}" for c in V.DELTA], 6)]
add("cm06_ee_delta_base", "ee_delta_base", ["CM6", "FN-R5", "FN-R7"], stmt(STEPS, select=", ".join(parts), source="steps"))

logs = [K.alias(K.log(K.q_of(f"s{k}")), K.names(f"w{k}", "xyz")) for k in "ab"]
more = [f"{K.length(K.names(f'w{k}', 'xyz'))} AS th{k}" for k in "ab"]
parts = []
for side, k in SIDE.items():
    p, w = K.names(f"s{k}", "xyz"), K.names(f"w{k}", "xyz")
    wp = K.cross(w, p)
    wwp = K.cross(w, wp)
    c = f"(CASE WHEN th{k} < 1e-6 THEN 1.0/12 ELSE (1 - th{k}*sin(th{k})/(2*(1 - cos(th{k}))))/(th{k}*th{k}) END)"
    parts.append(K.alias([*(f"({p[i]} - 0.5*{wp[i]} + {c}*{wwp[i]})/0.02" for i in range(3)), *(f"{x}/0.02" for x in w)],
                         [f"{side}_{n}" for n in V.TWIST], 4))
add("cm07_ee_twist_tool", "ee_twist_tool", ["CM7", "FN-R8"],
    stmt(STEPS, f"logs AS (SELECT *, {', '.join(logs)} FROM steps)", f"th AS (SELECT *, {', '.join(more)} FROM logs)",
         select=", ".join(parts), source="th"), digits=4)
add("cm08_head_rot_abs", "head_rot_abs", ["CM8"],
    stmt(select=K.alias(K.six(K.q_of("n_h")), [f"head_{c}" for c in V.ROT6D], 6), source="pair"))
add("cm09_head_rot_delta", "head_rot_delta", ["CM9", "FN-R4"],
    stmt(f"turn AS (SELECT *, {K.alias(K.mul(K.conj(K.q_of('h')), K.q_of('n_h')), K.q_of('t'))} FROM pair)",
         select=K.alias(K.six(K.q_of("t")), [f"head_d{c}" for c in V.ROT6D], 6), source="turn"))
BASE = f"""rel AS (SELECT *, cos(yaw)*(n_x-x) + sin(yaw)*(n_y-y) AS dx, cos(yaw)*(n_y-y) - sin(yaw)*(n_x-x) AS dy, {WRAP.format("n_yaw - yaw")} AS dyaw FROM pair)"""
ARC = """arc AS (SELECT *, CASE WHEN abs(dyaw) < 1e-12 THEN 1 ELSE sin(dyaw)/dyaw END AS a, CASE WHEN abs(dyaw) < 1e-12 THEN 0 ELSE (1 - cos(dyaw))/dyaw END AS b FROM rel)"""
add("cm10_base_twist_body", "base_twist_body", ["CM10", "FN-R11"],
    stmt(BASE, ARC, select=K.alias(["(a*dx + b*dy)/(a*a + b*b)/0.02", "(a*dy - b*dx)/(a*a + b*b)/0.02", "dyaw/0.02"], ["base_vx", "base_vy", "base_wz"], 4), source="arc"), digits=4)
add("cm11_base_se2_delta", "base_se2_delta", ["CM11", "FN-R10"],
    stmt(BASE, select=K.alias(["dx", "dy", "dyaw"], ["base_dx", "base_dy", "base_dyaw"], 6), source="rel"))
add("cm12_gripper_continuous", "gripper_continuous", ["CM12"],
    stmt(select=K.alias(["n_open_l", "n_open_r"], ["left_gripper_opening", "right_gripper_opening"], 6), source="pair"))
OPEN = [f"CASE WHEN n_open_{s} >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for s in "lr"]
add("cm13_gripper_binary", "gripper_binary", ["CM13"],
    stmt(select=K.alias(OPEN, ["left_gripper_open", "right_gripper_open"], 6), source="pair"))


def agent_select(at: str, tail) -> str:
    values, out = [], []
    for side, k in SIDE.items():
        values += [f'{at}{k}{c}' if at else f'"{k}{c}"' for c in "xyz"] + K.six(K.q_of(f"{at}{k}"))
        out += [f"{side}_{c}" for c in ("x", "y", "z", *V.ROT6D)]
    values += K.six(K.q_of(f"{at}h"))
    out += [f"head_{c}" for c in V.ROT6D]
    values += [e for e, _ in tail]
    out += [n for _, n in tail]
    return K.alias([f"CAST(CAST({v} AS FLOAT) AS DOUBLE)" for v in values], out, 5)


add("cm14_agent_action", "agent_v8", ["CM14"], digits=5, sql=stmt(BASE, source="rel", select=agent_select("n_", [
    ("dx", "base_dx"), ("dy", "base_dy"), ("dyaw", "base_dyaw"), (OPEN[0], "left_gripper_open"), (OPEN[1], "right_gripper_open")])))
add("cm14_agent_state", "agent_v8_state", ["CM14"], digits=5, sql=stmt(source="pair0", select=agent_select("", [
    ("x", "base_world_x"), ("y", "base_world_y"), ("sin(yaw)", "base_world_sin_yaw"), ("cos(yaw)", "base_world_cos_yaw"),
    ("open_l", "left_gripper_opening"), ("open_r", "right_gripper_opening")])))


@query("fn_r2_r3_matrix_round_trip", "FN-R2", "FN-R3", "FN-R4", "FN-R6", sql=with_(POSES, f"""
SELECT episode, row, {K.alias(sum(K.matrix(K.q_of("a")), []), [f"m{i}" for i in range(9)], 6)}, {K.alias(K.q_of("a"), K.q_of("back_"), 6)},
       {K.alias(K.q_of("a"), K.q_of("six_"), 6)} FROM poses"""))
def _(spark, d):
    s = Sheet(L.poses(spark, d))
    q = cols("aqw", "aqx", "aqy", "aqz")
    m = s.put("m", R.to_matrix(q))
    back = s.put("back", R.from_matrix(m))
    m6 = s.put("m6", R.six_to_matrix(s.put("six", [2.0 * c for c in R.six(q)])))
    again = s.put("again", R.from_matrix(m6))
    return s.select("episode", "row", *[r6(c).alias(f"m{i}") for i, c in enumerate(m)], *[r6(c).alias(f"back_{n}") for n, c in zip(K.Q, back)],
                    *[r6(c).alias(f"six_{n}") for n, c in zip(K.Q, again)])


@query("cm15_steps_integrate_back", "CM15", "FN-R8", "FN-R7", sql=with_(STATE, """
SELECT episode, row, 0.0::DOUBLE AS position_gap, 0.0::DOUBLE AS rotation_gap FROM pair"""))
def _(spark, d):
    """Exponentiating the tool twist of a row from its pose must give the next pose."""
    pair = V.Pair(state(spark, d).drop("qd"), L.FRAMES)
    step = pair.tool_step("left")
    w = pair.once("left_w", lambda: R.log(step.q))
    twist = pair.once("left_twist", lambda: P.log(step.p, w))
    moved = P.exp(twist)
    mp, mq = pair.once("mp", lambda: moved.p), pair.once("mq", lambda: moved.q)
    now, then = pair.tcp("left"), pair.tcp("left", "next_")
    far = P.compose(now, P.Pose(mp, mq))
    fp, fq = pair.once("fp", lambda: far.p), pair.once("fq", lambda: far.q)
    turn = pair.once("turn", lambda: R.multiply(R.conjugate(fq), then.q))
    out = pair.sheet.df.where(F.col("next_q").isNotNull())
    return out.select("episode", "row", r6(norm(sub(fp, then.p))).alias("position_gap"), r6(R.angle(turn)).alias("rotation_gap"))


@query("fn_r12_r14_blend", "FN-R12", "FN-R14", "RS5", sql=with_(POSES, f"""
b0 AS (SELECT *, {K.alias(K.mul(K.conj(K.q_of("a")), K.q_of("b")), K.q_of("r"))} FROM poses),
b1 AS (SELECT *, {K.alias([f"0.3*{c}" for c in K.log(K.q_of("r"))], ["lx", "ly", "lz"])} FROM b0),
b2 AS (SELECT *, {K.length(["lx", "ly", "lz"])} AS th FROM b1),
b3 AS (SELECT *, {K.alias(K.mul(K.q_of("a"), ["cos(th/2)", "lx*sin(th/2)/th", "ly*sin(th/2)/th", "lz*sin(th/2)/th"]), K.q_of("m"))} FROM b2)
SELECT episode, row, {K.alias([f'"a{c}" + 0.3*("b{c}" - "a{c}")' for c in "xyz"], ["px", "py", "pz"], 6)},
       {K.alias(K.six(K.q_of("m")), [f"c{i}" for i in range(6)], 6)}, round(2*acos(least(1, abs({" + ".join(f"a{c}*b{c}" for c in K.Q)}))), 6) + 0.0 AS angle FROM b3"""))
def _(spark, d):
    s = Sheet(L.poses(spark, d))
    a, b = cols(*(f"a{c}" for c in K.Q)), cols(*(f"b{c}" for c in K.Q))
    rel = s.put("rel", R.canonical(s.put("rel0", R.multiply(R.conjugate(a), b))))
    mid = s.put("mid", R.slerp(a, s.put("log", R.log(rel)), 0.3))
    at = [F.col(f"a{c}") + 0.3 * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz"]
    return s.select("episode", "row", *[r6(c).alias(f"p{n}") for n, c in zip("xyz", at)], *[r6(c).alias(f"c{i}") for i, c in enumerate(R.six(mid))],
                    r6(R.angle(rel)).alias("angle"))


@query("fn_r13_look_at", "FN-R13", "FN-G11", sql=with_(POSES, """
d AS (SELECT episode, row, "bx" - "ax" AS x, "by" - "ay" AS y, "bz" - "az" AS z, 1 - 2*(aqy*aqy + aqz*aqz) AS vx, 2*(aqx*aqy + aqw*aqz) AS vy, 2*(aqx*aqz - aqw*aqy) AS vz FROM poses),
n AS (SELECT *, sqrt(x*x + y*y + z*z) AS n, sqrt(x*x + y*y) AS f FROM d)
SELECT episode, row, round(x/n, 6) + 0.0 AS m0, round(-y/f, 6) + 0.0 AS m1, round(-x*z/(n*f), 6) + 0.0 AS m2, round(y/n, 6) + 0.0 AS m3, round(x/f, 6) + 0.0 AS m4,
       round(-y*z/(n*f), 6) + 0.0 AS m5, round(z/n, 6) + 0.0 AS m6, 0.0::DOUBLE AS m7, round(f/n, 6) + 0.0 AS m8, round(acos((vx*x + vy*y + vz*z)/n), 5) AS gaze_error FROM n"""))
def _(spark, d):
    s = Sheet(L.poses(spark, d))
    to = s.put("to", [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"])
    m = s.put("m", R.look_at(to))
    axis = s.put("axis", R.to_matrix(cols("aqw", "aqx", "aqy", "aqz"))[0::3])
    n = norm(to)
    cosine = (axis[0] * to[0] + axis[1] * to[1] + axis[2] * to[2]) / n
    error = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    return s.select("episode", "row", *[r6(c).alias(f"m{i}") for i, c in enumerate(m)], r6(error, 5).alias("gaze_error"))


@query("fn_g12_grasp_offset", "FN-G12", sql=with_(POSES, """
o AS (SELECT episode, row, row % 2 AS flip, "ax"*90 AS theta, "ay"*60 AS beta, abs("az")/10 AS lift FROM poses),
r AS (SELECT *, pi()*flip + radians(theta) AS a, radians(beta) AS b FROM o)
SELECT episode, row, round(cos(a)*cos(b), 6) + 0.0 AS m0, round(-sin(a), 6) + 0.0 AS m1, round(cos(a)*sin(b), 6) + 0.0 AS m2, round(sin(a)*cos(b), 6) + 0.0 AS m3,
       round(cos(a), 6) + 0.0 AS m4, round(sin(a)*sin(b), 6) + 0.0 AS m5, round(-sin(b), 6) + 0.0 AS m6, 0.0::DOUBLE AS m7, round(cos(b), 6) + 0.0 AS m8, round(-lift, 6) + 0.0 AS z FROM r"""))
def _(spark, d):
    from ..functions.grasp import offset
    p = L.poses(spark, d)
    m, z = offset(F.col("row") % 2 == 1, F.col("ax") * 90.0, F.col("ay") * 60.0, F.abs("az") / 10.0)
    return p.select("episode", "row", *[r6(c).alias(f"m{i}") for i, c in enumerate(m)], r6(z).alias("z"))
