"""Queries on single motions: base paths of every kind, and hand strokes as poses."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rotation
from ..functions.gripper import move_duration
from ..functions.vectors import Sheet, cols, norm, sub
from ..operators import motions as M
from ..operators.lineage import cut
from ..operators.scenarios import sampled
from ..sources import landing as L
from . import sqlkit as K
from .registry import query, r6
from .sequences import WRAP
from .sqlbase import POSES, with_

KINDS = ("drive", "strafe", "turn", "arc", "curve")
CASES = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
BASE = f"""
pm AS (SELECT vec_id, CASE vec_id % 5 {CASES} END AS kind, ax AS x0, ay AS y0, az * 2 AS w0, ax + bx * 2 + 0.5 AS gx, ay + bz * 2 AS gy, "by" * 3 AS gw, abs(bx) * 2 + 0.1 AS dist, "by" * 3 AS turn, CASE WHEN abs(bz) < 0.1 THEN 0.3::DOUBLE ELSE bz END AS radius FROM poses),
kn0 AS (SELECT vec_id, w0, i, u, v, x0, y0, gx, gy, gw, h FROM (SELECT *, i / 399.0::DOUBLE AS u, 1 - i / 399.0::DOUBLE AS v, sqrt(pow(gx - x0, 2) + pow(gy - y0, 2)) / 3 AS h FROM (SELECT *, unnest(range(0, 400)) AS i FROM pm WHERE kind = 'curve'))),
kn1 AS (SELECT vec_id, w0, i, v*v*v*x0 + 3*u*v*v*(x0 + cos(w0)*h) + 3*u*u*v*(gx - cos(gw)*h) + u*u*u*gx AS x, v*v*v*y0 + 3*u*v*v*(y0 + sin(w0)*h) + 3*u*u*v*(gy - sin(gw)*h) + u*u*u*gy AS y,
  atan2(3*v*v*sin(w0)*h + 6*u*v*(gy - sin(gw)*h - y0 - sin(w0)*h) + 3*u*u*sin(gw)*h, 3*v*v*cos(w0)*h + 6*u*v*(gx - cos(gw)*h - x0 - cos(w0)*h) + 3*u*u*cos(gw)*h) AS tangent FROM kn0),
kn2 AS (SELECT *, tangent - lag(tangent) OVER w AS d, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS seg FROM kn1 WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
kn3 AS (SELECT *, sum(coalesce({WRAP.format("d")}, tangent)) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS yaw1, sum(seg) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS along FROM kn2),
kn4 AS (SELECT vec_id, i, x, y, along, yaw1 + round_even((w0 - first_value(yaw1) OVER (PARTITION BY vec_id ORDER BY i)) / (2 * pi()), 0) * 2 * pi() AS yaw FROM kn3),
kn AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(yaw) OVER w AS nyaw, lead(along) OVER w AS nalong FROM kn4 WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
tot AS (SELECT vec_id, max(along) AS len, sum(abs(nyaw - yaw)) AS turned FROM kn GROUP BY vec_id),
sec AS (SELECT p.*, greatest(0.5::DOUBLE, 1.875::DOUBLE * greatest(CASE kind WHEN 'turn' THEN 0 WHEN 'arc' THEN abs(radius * turn) WHEN 'curve' THEN len ELSE dist END / 0.4::DOUBLE, CASE kind WHEN 'curve' THEN turned ELSE abs(turn) END / 0.8::DOUBLE)) AS seconds, len FROM pm p LEFT JOIN tot USING (vec_id)),
smp AS (SELECT *, k / 2.0::DOUBLE / seconds AS u FROM (SELECT *, unnest(range(0, CAST(ceil(seconds * 2.0::DOUBLE - 1e-9) AS BIGINT) + 1)) AS k FROM sec)),
ph AS (SELECT *, u1*u1*u1*(10 - 15*u1 + 6*u1*u1) AS s FROM (SELECT *, least(greatest(u, 0), 1) AS u1 FROM smp)),
cv AS (SELECT p.vec_id, p.k, p.seconds, n.x + coalesce(f*(nx - n.x), 0) AS x, n.y + coalesce(f*(ny - n.y), 0) AS y, n.yaw + coalesce(f*(nyaw - n.yaw), 0) AS yaw
  FROM (SELECT p.*, n.*, CASE WHEN nalong - along > 0 THEN (p.s * p.len - along) / (nalong - along) ELSE 0 END AS f FROM (SELECT vec_id AS vid, k, seconds, s, len, s * len AS way FROM ph WHERE kind = 'curve') p ASOF JOIN kn n ON p.vid = n.vec_id AND p.way >= n.along) n JOIN ph p ON p.vec_id = n.vec_id AND p.k = n.k),
pth AS (SELECT vec_id, kind, k, seconds, CASE kind WHEN 'arc' THEN x0 + radius*(sin(w0 + sg*s*abs(turn)) - sin(w0)) WHEN 'turn' THEN x0 ELSE x0 + s*dist*cos(w0 + dir) END AS x, CASE kind WHEN 'arc' THEN y0 - radius*(cos(w0 + sg*s*abs(turn)) - cos(w0)) WHEN 'turn' THEN y0 ELSE y0 + s*dist*sin(w0 + dir) END AS y,
  CASE kind WHEN 'arc' THEN w0 + sg*s*abs(turn) ELSE w0 + s*turn END AS yaw FROM (SELECT *, CASE WHEN radius < 0 THEN -1 ELSE 1 END AS sg, CASE WHEN kind = 'strafe' THEN pi()/2 ELSE 0 END AS dir FROM ph WHERE kind <> 'curve')
  UNION ALL SELECT vec_id, 'curve', k, seconds, x, y, yaw FROM cv)"""


@query("sy05_base_motions", "SY5", sql=with_(POSES, BASE + " SELECT vec_id, kind, k, round(seconds, 5) AS seconds, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(yaw, 5) + 0.0 AS yaw FROM pth"))
def _(spark, d):
    """Drive, strafe, turn, arc and curve from every pose, sampled twice a second."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("vec_id") % 5 + 1).cast("int"))
    p = L.poses(spark, d).select("vec_id", kind.alias("kind"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), (F.col("az") * 2).alias("w0"), (F.col("ax") + F.col("bx") * 2 + 0.5).alias("gx"), (F.col("ay") + F.col("bz") * 2).alias("gy"),
                                 (F.col("by") * 3).alias("gw"), (F.abs("bx") * 2 + 0.1).alias("dist"), (F.col("by") * 3).alias("turn"), F.when(F.abs("bz") < 0.1, 0.3).otherwise(F.col("bz")).alias("radius"))
    p = cut(p)
    knots = M.curve_knots(p.where("kind = 'curve'"), ["vec_id"], ["x0", "y0", "w0"], ["gx", "gy", "gw"])
    p = p.join(M.curve_totals(knots, ["vec_id"]), "vec_id", "left")
    way = F.when(F.col("kind") == "turn", 0.0).when(F.col("kind") == "arc", F.col("radius") * F.col("turn")).when(F.col("kind") == "curve", F.col("length")).otherwise(F.col("dist"))
    p = p.withColumn("seconds", M.base_seconds(way, F.when(F.col("kind") == "curve", F.col("turned")).otherwise(F.col("turn")), 0.4, 0.8))
    m = cut(sampled(p, ["vec_id"], F.col("seconds"), 2.0))
    start, s = cols("x0", "y0", "w0"), F.col("s")
    straight = M.drive(start, F.when(F.col("kind") == "turn", 0.0).otherwise(F.col("dist")), F.when(F.col("kind") == "strafe", F.pi() / 2).otherwise(0.0), F.col("turn"), s)
    round_ = M.circle(start, F.col("radius"), F.col("turn"), s)
    plain = m.where("kind <> 'curve'").select("vec_id", "kind", "k", "seconds", *[F.when(F.col("kind") == "arc", a).otherwise(b).alias(n) for n, a, b in zip(("x", "y", "yaw"), round_, straight)])
    bent = M.along_curve(m.where("kind = 'curve'").select("vec_id", "kind", "k", "seconds", (s * F.col("length")).alias("way")), knots, ["vec_id"], "way")
    out = plain.unionByName(bent.select("vec_id", "kind", "k", "seconds", "x", "y", "yaw"))
    return out.select("vec_id", "kind", F.col("k").cast("long").alias("k"), *[r6(c, 5).alias(c) for c in ("seconds", "x", "y", "yaw")])


A, B, P, P1 = K.q_of("a"), K.q_of("b"), K.p_of("a"), K.p_of("b")
REL, CENTRE, AXIS = [f"r{c}" for c in K.Q], [f"({c} + {o})" for c, o in zip(P, (0.1, -0.05, 0.2))], ["bx", '"by"', "(bz + 0.2)"]


def _hand_sql() -> str:
    log = K.log(REL)
    theta = f"({K.length(['l0', 'l1', 'l2'])} * s)"
    share = f"(CASE WHEN {theta} < 1e-12 THEN 0.5 ELSE sin({theta}/2)/{theta} END * s)"
    reach = K.mul(A, [f"cos({theta}/2)", *(f"(l{i}*{share})" for i in range(3))])
    twist = K.mul(A, ["cos(s*ang/2)", "0", "0", "sin(s*ang/2)"])
    n = K.length(AXIS)
    turn = ["cos(s*ang/2)", *(f"({c}/{n}*sin(s*ang/2))" for c in AXIS)]
    tilted = [f"({c} + {v})" for c, v in zip(CENTRE, K.apply(K.matrix(turn), K.minus(P, CENTRE)))]
    ahead = [f"({r[2]} * -1)" for r in K.matrix(A)]
    radius = f"({K.length(K.cross(AXIS, K.minus(P, CENTRE)))} / {n})"
    pick = lambda *cases: "CASE kind " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(cases[:-1])) + f" ELSE {cases[-1]} END"
    places = [pick(f"{p} + s*({g} - {p})", f"{p} + s*depth*{h}", p, t) for p, g, h, t in zip(P, P1, ahead, tilted)]
    turns = [pick(r, a, t, q) for r, a, t, q in zip(reach, A, twist, K.mul(turn, A))]
    ways = pick(K.length(K.minus(P1, P)), "abs(depth)", "0", f"{radius}*abs(ang)")
    spins = pick(K.length(["l0", "l1", "l2"]), "0", "abs(ang)", "abs(ang)")
    return f"""
h0 AS (SELECT *, vec_id % 4 AS kind, bx*0.3 + 0.01 AS depth, bz*2 AS ang, {K.alias(K.mul(K.conj(A), B), REL)} FROM poses),
h1 AS (SELECT *, {K.alias(log, ['l0', 'l1', 'l2'])} FROM h0),
h2 AS (SELECT *, greatest(CASE WHEN kind = 0 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END, 1.875::DOUBLE * greatest({ways}/0.3::DOUBLE, {spins}/1.2::DOUBLE)) AS seconds FROM h1),
h3 AS (SELECT *, k / 2.0::DOUBLE / seconds AS u FROM (SELECT *, unnest(range(0, CAST(ceil(seconds * 2.0::DOUBLE - 1e-9) AS BIGINT) + 1)) AS k FROM h2)),
h4 AS (SELECT *, u1*u1*u1*(10 - 15*u1 + 6*u1*u1) AS s FROM (SELECT *, least(greatest(u, 0), 1) AS u1 FROM h3)),
h5 AS (SELECT vec_id, kind, k, seconds, {K.alias(places, ['px', 'py', 'pz'])}, {K.alias(turns, ['w', 'x', 'y', 'z'])} FROM h4)
SELECT vec_id, ['reach', 'approach', 'twist', 'tilt'][kind + 1] AS kind, k, round(seconds, 5) AS seconds, {K.alias(['px', 'py', 'pz'], ['px', 'py', 'pz'], 5)},
  {K.alias([f"{c} * CASE WHEN w < 0 THEN -1 ELSE 1 END" for c in ('w', 'x', 'y', 'z')], ['qw', 'qx', 'qy', 'qz'], 5)} FROM h5"""


@query("sy04_hand_strokes", "SY4", "FN-R14", sql=with_(POSES, _hand_sql()))
def _(spark, d):
    """Reach, approach, twist and tilt from every hand pose, sampled twice a second."""
    p, q = cols("ax", "ay", "az"), cols(*K.names("a", K.Q))
    p1, q1 = cols("bx", "by", "bz"), cols(*K.names("b", K.Q))
    h = L.poses(spark, d).select("vec_id", *[f"{t}{c}" for t in "ab" for c in ("x", "y", "z", *K.Q)]).withColumns({"kind": F.col("vec_id") % 4, "depth": F.col("bx") * 0.3 + 0.01, "ang": F.col("bz") * 2.0})
    kind, depth, ang = F.col("kind"), F.col("depth"), F.col("ang")
    centre = tuple(c + o for c, o in zip(p, (0.1, -0.05, 0.2)))
    axis = (p1[0], p1[1], p1[2] + 0.2)
    pick = lambda *cases: F.when(kind == 0, cases[0]).when(kind == 1, cases[1]).when(kind == 2, cases[2]).otherwise(cases[3])
    sheet = Sheet(h)
    relative = sheet.put("rel", rotation.canonical(rotation.multiply(rotation.conjugate(q), q1)))
    relative = sheet.put("log", rotation.log(relative))
    way = pick(norm(sub(p1, p)), F.abs(depth), F.lit(0.0), M.tilt_radius(p, centre, axis) * F.abs(ang))
    spin = pick(norm(relative), F.lit(0.0), F.abs(ang), F.abs(ang))
    h = sheet.df.withColumn("seconds", F.when(kind == 0, move_duration(way, spin, 0.3, 1.2, M.LEAST_REACH)).otherwise(move_duration(way, spin, 0.3, 1.2, M.LEAST_HAND)))
    s = F.col("s")
    sheet = Sheet(cut(sampled(h, ["vec_id"], F.col("seconds"), 2.0)))
    turn = sheet.put("turn", M.about(axis, s * ang))
    made = [M.reach(p, q, p1, relative, s), M.approach(p, q, depth, s), M.twist(p, q, ang, s), M.tilt(p, q, centre, turn)]
    strokes = [(sheet.put(f"p{i}", place), sheet.put(f"q{i}", orient)) for i, (place, orient) in enumerate(made)]
    m = sheet.df
    names = F.element_at(F.array(*[F.lit(n) for n in ("reach", "approach", "twist", "tilt")]), (kind + 1).cast("int"))
    out = m.select("vec_id", names.alias("kind"), F.col("k").cast("long").alias("k"), "seconds", *[pick(*(t[0][i] for t in strokes)).alias(f"p{c}") for i, c in enumerate("xyz")], *[pick(*(t[1][i] for t in strokes)).alias(c) for i, c in enumerate(K.Q)])
    sign = F.when(F.col("qw") < 0, -1.0).otherwise(1.0)
    return out.select("vec_id", "kind", "k", r6("seconds", 5).alias("seconds"), *[r6(f"p{c}", 5).alias(f"p{c}") for c in "xyz"], *[r6(F.col(c) * sign, 5).alias(c) for c in K.Q])
