"""Gate queries: residuals, kinematic verdicts, clearances, completeness."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import planar
from ..functions import rotation as R
from ..functions.vectors import Sheet, cols, norm
from ..operators import gates as A
from ..operators.blocks import shift
from ..operators.lineage import cut
from ..sources import landing as L
from . import sqlkit as K
from .registry import long, query, r6
from .sequences import islands
from .sqlbase import FRAMES, OBJECT_FRAMES, OBJECTS, POSES, with_

LIMIT = 0.45


def residuals(spark, d):
    """Pose frames with hand residuals, joint margin, speed ratio and clearance."""
    p = shift(L.poses(spark, d), L.FRAMES, {"nq": (F.col("q"), 1)})
    s = Sheet(p)
    gap = s.put("gap", [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"])
    turn = s.put("turn", R.multiply(R.conjugate(cols(*(f"a{c}" for c in K.Q))), cols(*(f"b{c}" for c in K.Q))))
    q = F.col("q")
    turned = planar.wrap(F.coalesce(F.col("nq")[2] - q[2], F.lit(0.0)))
    along, across = planar.to_body(*(F.coalesce(F.col("nq")[i] - q[i], F.lit(0.0)) for i in (0, 1)), q[2] + turned / 2.0)
    base = (along, across, turned)  # base steps along the body's axes, at the yaw halfway
    step = lambda i: base[i] if i < 3 else F.coalesce(F.col("nq")[i] - q[i], F.lit(0.0))
    return s.select("episode", "row", norm(gap).alias("left_pos"), R.angle(turn).alias("left_rot"), (F.col("row") % 3 == 0).alias("left_held"),
                    (F.col("az") * 4.0 + 1.0).alias("left_z"), A.joint_margin(q, [(-LIMIT, LIMIT)] * 19, first=3).alias("margin"),
                    A.speed_ratio([(step(i), 0.61 if i < 3 else 1.0) for i in range(22)], F.lit(0.4)).alias("speed"),
                    F.col("open_l").alias("clearance"))


RES = f"""
turn AS (SELECT *, lead(q) OVER (PARTITION BY episode ORDER BY row) AS nq, {K.alias(K.mul(K.conj(K.q_of("a")), K.q_of("b")), K.q_of("r"))} FROM poses),
res AS (SELECT episode, row, sqrt(pow("bx"-"ax", 2) + pow("by"-"ay", 2) + pow("bz"-"az", 2)) AS left_pos, 2*atan2(sqrt(rqx*rqx + rqy*rqy + rqz*rqz), abs(rqw)) AS left_rot, row % 3 = 0 AS held,
  "az"*4 + 1 AS z, least({", ".join(f"q[{i + 1}] + {LIMIT}, {LIMIT} - q[{i + 1}]" for i in range(3, 22))}) AS margin,
  [{", ".join(f"abs({('sx', 'sy', 'bw')[i]})/0.4::DOUBLE/0.61::DOUBLE" if i < 3 else f"coalesce(abs(nq[{i + 1}] - q[{i + 1}]), 0)/0.4::DOUBLE" for i in range(22))}] AS ratios, open_l AS clearance
  FROM (SELECT *, cos(my)*dx + sin(my)*dy AS sx, cos(my)*dy - sin(my)*dx AS sy FROM (SELECT *, coalesce(nq[1] - q[1], 0) AS dx, coalesce(nq[2] - q[2], 0) AS dy, q[3] + bw/2 AS my FROM (SELECT *, atan2(sin(coalesce(nq[3] - q[3], 0)), cos(coalesce(nq[3] - q[3], 0))) AS bw FROM turn)))),
tol AS (SELECT *, CASE WHEN held THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS tp, CASE WHEN held THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS tr, list_max(ratios) AS ratio, list_position(ratios, list_max(ratios)) - 1 AS joint FROM res)"""


@query("gt01_frame_residuals", "GT1", "AG10", sql=with_(POSES, RES + """
SELECT episode, row, round(left_pos, 6) AS left_pos, round(left_rot, 6) AS left_rot, round(margin, 6) + 0.0 AS margin, round(ratio, 5) AS ratio, CAST(joint AS BIGINT) AS joint FROM tol"""))
def _(spark, d):
    return residuals(spark, d).select("episode", "row", r6("left_pos").alias("left_pos"), r6("left_rot").alias("left_rot"), r6("margin").alias("margin"),
                                      r6(F.col("speed.ratio"), 5).alias("ratio"), long("speed.joint").alias("joint"))


def kinematic_reasons(spark, d):
    f = cut(residuals(spark, d))
    hand = A.residual_reasons(f, "left", ["episode"], "row", tol_pos=(0.2, 0.1), tol_rot=(1.0, 0.5))
    return f, hand.unionByName(A.limit_reasons(f, ["episode"], "row", clearance=0.009))


REASONS = RES + """,
far AS (SELECT episode, count(*) AS n, arg_max(z, (greatest(0.46 - z, z - 1.87), -row)) AS z, arg_max(row, (greatest(0.46 - z, z - 1.87), -row)) AS row FROM tol
  WHERE (z < 0.46 OR z > 1.87) AND (left_pos > tp OR left_rot > tr) GROUP BY episode),
pos AS (SELECT episode, arg_max({'e': left_pos, 't': tp, 'r': row}, (left_pos - tp, -row)) AS w, count(*) FILTER (WHERE left_pos > tp) AS n FROM tol GROUP BY episode),
rot AS (SELECT episode, arg_max({'e': left_rot, 't': tr, 'r': row}, (left_rot - tr, -row)) AS w, count(*) FILTER (WHERE left_rot > tr) AS n FROM tol GROUP BY episode),
lim AS (SELECT episode, min(margin) AS m, arg_min(row, (margin, row)) AS mr, max(ratio) AS s, arg_max(joint, (ratio, -row)) AS sj, arg_max(row, (ratio, -row)) AS sr, min(clearance) AS c, arg_min(row, (clearance, row)) AS cr FROM tol GROUP BY episode),
reasons AS (
  SELECT episode, 0 AS place, 'left TCP target outside the reach band: grasp center z ' || printf('%.2f', z) || ' m not in 0.46-1.87 m at frame ' || row || ' (' || n || ' frames)' AS reason FROM far
  UNION ALL SELECT episode, 1, 'left TCP position residual ' || printf('%.3g', w.e*1e3) || ' mm > ' || printf('%.3g', w.t*1e3) || ' mm at frame ' || w.r || ' (' || n || ' frames)' FROM pos WHERE n > 0
  UNION ALL SELECT episode, 2, 'left TCP rotation residual ' || printf('%.3g', w.e) || ' rad > ' || printf('%.3g', w.t) || ' rad at frame ' || w.r || ' (' || n || ' frames)' FROM rot WHERE n > 0
  UNION ALL SELECT episode, 6, 'joint limit exceeded by ' || printf('%.4g', -m) || ' rad at frame ' || mr FROM lim WHERE m < -1e-9
  UNION ALL SELECT episode, 7, 'speed limit exceeded: joint ' || sj || ' at ' || printf('%.3g', s) || ' x limit (frame ' || sr || ')' FROM lim WHERE s > 1 + 1e-6
  UNION ALL SELECT episode, 8, 'self-clearance ' || printf('%.3g', c*1e3) || ' mm < ' || printf('%.3g', 9.0::DOUBLE) || ' mm at frame ' || cr FROM lim WHERE c < 0.009)"""


@query("gt02_kinematic_reasons", "GT2", "AG10", "GT3", sql=with_(POSES, REASONS + " SELECT episode, CAST(place AS BIGINT) AS place, reason FROM reasons"))
def _(spark, d):
    return kinematic_reasons(spark, d)[1].select("episode", long("place").alias("place"), "reason")


@query("gt02_kinematic_verdicts", "GT2", "GT3", sql=with_(POSES, REASONS + """
SELECT p.episode, count(r.reason) = 0 AS passed, count(r.reason) AS reasons FROM (SELECT DISTINCT episode FROM poses) p LEFT JOIN reasons r USING (episode) GROUP BY p.episode"""))
def _(spark, d):
    f, reasons = kinematic_reasons(spark, d)
    return A.verdicts(f, ["episode"], reasons)


@query("ag11_grasp_drift", "AG11", "WN9", sql=with_(FRAMES, islands("frames", "label", name="hd") + """,
p0 AS (SELECT episode, g, row AS start, cos(yaw)*x + sin(yaw)*y AS px, cos(yaw)*y - sin(yaw)*x AS py, z AS pz, yaw AS a FROM hd_g WHERE lab IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode, g ORDER BY row) = 1)
SELECT h.episode, p.start, max(h.row) + 1 AS stop, round(max(sqrt(pow(cos(yaw)*x + sin(yaw)*y - px, 2) + pow(cos(yaw)*y - sin(yaw)*x - py, 2) + pow(z - pz, 2))), 6) AS drift, round(max(abs(yaw - a)), 6) AS turn
FROM hd_g h JOIN p0 p ON p.episode = h.episode AND p.g = h.g WHERE h.lab IS NOT NULL GROUP BY h.episode, p.start"""))
def _(spark, d):
    from ..functions.planar import to_body
    f = L.frames(spark, d).select("episode", "row", "label", "x", "y", "z", "yaw")
    px, py = to_body(F.col("x"), F.col("y"), F.col("yaw"))
    out = A.grasp_drift(f, F.col("label"), [px, py, F.col("z")], F.col("yaw"), L.FRAMES)
    return out.select("episode", "start", "stop", r6("drift").alias("drift"), r6("turn").alias("turn"))


def _boxes(o):
    corner = lambda sx, sy: F.struct((F.col("ox") + sx * F.col("hx")).alias("x"), (F.col("oy") + sy * F.col("hy")).alias("y"))
    return o.withColumns({"vertices": F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)), "low": F.col("oz") - F.col("hz"), "top": F.col("oz") + F.col("hz")})


@query("jn17_footprint_clearance", "JN17", "FN-G7", "FN-G8", sql=with_(FRAMES + "," + OBJECTS, """
ob AS (SELECT *, greatest(CASE WHEN oz - hz < 0.30 THEN 0.25 ELSE 0 END, CASE WHEN oz - hz < 0.95 AND oz + hz > 0.30 THEN 0.14 ELSE 0 END, CASE WHEN oz - hz < 1.45 AND oz + hz > 0.95 THEN 0.19 ELSE 0 END) AS radius
       FROM objects0 WHERE role IN ('support', 'fixture')),
dd AS (SELECT f.episode, f.row, abs(f.x - ox) - hx AS ax, abs(f.y - oy) - hy AS ay, radius FROM frames f JOIN ob USING (episode))
SELECT episode, row, round(min(CASE WHEN ax <= 0 AND ay <= 0 THEN greatest(ax, ay) ELSE sqrt(pow(greatest(ax, 0), 2) + pow(greatest(ay, 0), 2)) END - radius), 6) + 0.0 AS clearance FROM dd GROUP BY episode, row"""))
def _(spark, d):
    o = _boxes(L.objects(spark, d).where(F.col("role").isin("support", "fixture")))
    o = o.select("episode", "vertices", G.body_radius(F.col("low"), F.col("top")).alias("radius"))
    out = A.footprint_clearance(L.frames(spark, d).select("episode", "row", "x", "y"), o, ["episode"], "row")
    return out.select("episode", "row", r6("clearance").alias("clearance"))


@query("jn21_envelopes_replaced", "JN21", sql=with_(OBJECTS, """
e AS (SELECT episode, object, ox - 2*hx AS x0, ox + 2*hx AS x1, oy - 2*hy AS y0, oy + 2*hy AS y1, oz + hz AS top FROM objects0 WHERE role IN ('support', 'fixture')),
s AS (SELECT episode, ox AS cx, oy AS cy, oz + hz AS top FROM objects0 WHERE role = 'receptacle')
SELECT episode, object FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.episode = e.episode AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 AND abs(s.top - e.top) <= 0.02)"""))
def _(spark, d):
    o = L.objects(spark, d)
    wide = _boxes(o.where(F.col("role").isin("support", "fixture")).withColumns({"hx": F.col("hx") * 2.0, "hy": F.col("hy") * 2.0}))
    scene = o.where(F.col("role") == "receptacle").select("episode", F.col("ox").alias("cx"), F.col("oy").alias("cy"), (F.col("oz") + F.col("hz")).alias("top"))
    return A.drop_enclosing(wide, scene, ["episode"]).select("e.episode", "e.object")


PAIRS = [(i, j) for i in range(20) for j in range(i + 2, 20) if (i, j) not in {(0, 2), (1, 3), (5, 9)}]


@query("jn18_sphere_pair_clearance", "JN18", sql="""
WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, i, e[3*i + 1] AS x, e[3*i + 2] AS y, e[3*i + 3] AS z FROM (SELECT *, unnest(range(0, 20)) AS i FROM c)),
p AS (SELECT a.vec_id, a.i, b.i AS j, sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2)) - (0.02::DOUBLE + a.i*0.001::DOUBLE + (0.02::DOUBLE + b.i*0.001::DOUBLE)) AS clearance
  FROM s a JOIN s b ON b.vec_id = a.vec_id AND b.i >= a.i + 2 WHERE NOT (a.i = 0 AND b.i = 2) AND NOT (a.i = 1 AND b.i = 3) AND NOT (a.i = 5 AND b.i = 9))
SELECT vec_id, round(clearance, 6) + 0.0 AS clearance, i, j FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY clearance, i, j) = 1""")
def _(spark, d):
    e = L.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    best = A.sphere_clearance(F.col("e"), [0.02 + i * 0.001 for i in range(20)], PAIRS)
    return e.select("vec_id", best.alias("b")).select("vec_id", r6("b.clearance").alias("clearance"), long("b.i").alias("i"), long("b.j").alias("j"))


@query("gt07_failing_frames", "GT7", sql=with_(POSES, RES + """
SELECT episode, row, left_pos > 0.3 OR left_rot > 2.0 OR clearance < 0.02 AS failing FROM tol"""))
def _(spark, d):
    f = residuals(spark, d)
    bad = A.failing_frame(position=(F.col("left_pos"), 0.3), rotation=(F.col("left_rot"), 2.0), clearance=(-F.col("clearance"), -0.02))
    return f.select("episode", "row", bad.alias("failing"))


@query("gt08_reach_prescreen", "GT8", sql=with_(FRAMES, """
SELECT episode, min(z*3) < 0.46 AS too_low, max(z*3) > 1.87 AS too_high, max(sqrt(x*x + y*y + z*z)) > 0.665 AS too_far FROM frames GROUP BY episode"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", (F.col("z") * 3.0).alias("height"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("far"))
    return A.unreachable(f, ["episode"], "height", "far")


@query("ag25_missing_object_poses", "AG25", "GT6", "FN-S6", sql=with_(OBJECT_FRAMES, """
g AS (SELECT episode, object, count(*) FILTER (WHERE NOT valid) AS bad, count(*) AS n FROM object_frames GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY object) AS k, count(*) OVER (PARTITION BY episode) AS total FROM g WHERE bad > 0)
SELECT episode, string_agg('object ' || object || ': pose missing at ' || bad || ' of ' || n || ' steps', '; ' ORDER BY object) FILTER (WHERE k <= 3) || CASE WHEN max(total) > 3 THEN ' (+' || (max(total) - 3) || ' more)' ELSE '' END AS reason
FROM r GROUP BY episode"""))
def _(spark, d):
    return A.missing_poses(L.object_frames(spark, d).select("episode", "object", "valid"), ["episode"], shown=3)


@query("gt06_exclusion_gate", "GT6", sql=with_(OBJECT_FRAMES, """
g AS (SELECT episode, count(*) FILTER (WHERE NOT valid) AS bad, bool_or(event_type = 'signup') AS scene FROM object_frames GROUP BY episode)
SELECT episode, CASE WHEN NOT scene THEN 'no_meshes' WHEN bad > 0 THEN 'no_object_poses' ELSE 'keep' END AS status FROM g"""))
def _(spark, d):
    g = L.object_frames(spark, d).groupBy("episode").agg(F.count_if(~F.col("valid")).alias("bad"), F.bool_or(F.col("event_type") == "signup").alias("scene"))
    return g.select("episode", F.when(~F.col("scene"), "no_meshes").when(F.col("bad") > 0, "no_object_poses").otherwise("keep").alias("status"))


@query("gt05_depth_threshold", "GT5", sql=with_(OBJECTS, """
r AS (SELECT episode, object, hx/10 AS depth, CASE WHEN n % 3 <> 0 THEN hy/10 END AS ref FROM objects0),
t AS (SELECT *, greatest(0.002::DOUBLE, coalesce(ref + 0.001::DOUBLE, 0)) AS th FROM r)
SELECT episode, object, round(th, 6) AS threshold, depth <= th AS passed, depth <= 0.002 AS passed_absolute, CASE WHEN ref IS NULL THEN 'absolute threshold 0.0020 m (no source reference)'
  ELSE 'source-relative threshold ' || printf('%.4f', th) || ' m = max(absolute 0.0020 m, source reference ' || printf('%.4f', ref) || ' m + 0.0010 m)' END AS rule FROM t"""))
def _(spark, d):
    from ..operators.physics import depth_rule
    o = L.objects(spark, d).select("episode", "object", (F.col("hx") / 10.0).alias("depth"), F.when(F.col("n") % 3 != 0, F.col("hy") / 10.0).alias("ref"))
    return o.select("episode", "object", *depth_rule(F.col("depth"), F.col("ref"), absolute=0.002, margin=0.001)).withColumn("threshold", r6("threshold"))


@query("gt03_head_residual", "GT3", sql=with_(POSES, f"""
hd AS (SELECT episode, row, {K.alias(K.mul(K.conj(K.q_of("h")), K.q_of("b")), K.q_of("r"))} FROM poses), an AS (SELECT episode, row, 2*atan2(sqrt(rqx*rqx + rqy*rqy + rqz*rqz), abs(rqw)) AS a FROM hd),
g AS (SELECT episode, count(*) FILTER (WHERE a > 2.2) AS n, max(a) AS w, arg_max(row, (a, -row)) AS r FROM an GROUP BY episode)
SELECT episode, 'head rotation residual ' || printf('%.3g', w) || ' rad > ' || printf('%.3g', 2.2::DOUBLE) || ' rad at frame ' || r || ' (' || n || ' frames)' AS reason FROM g WHERE n > 0"""))
def _(spark, d):
    s = Sheet(L.poses(spark, d))
    turn = s.put("turn", R.multiply(R.conjugate(cols(*(f"h{c}" for c in K.Q))), cols(*(f"b{c}" for c in K.Q))))
    f = s.select("episode", "row", R.angle(turn).alias("head"))
    return A.angle_reasons(f, "head", "head", ["episode"], "row", tol=2.2, place=9).select("episode", "reason")
