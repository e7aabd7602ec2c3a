"""Queries over recorded rollouts: all gates of tier P, one row per gate, and the verdicts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollouts as R
from ..operators import sequence as S
from ..operators.blocks import shift
from ..operators.lineage import cut
from ..sources import landing as L
from .registry import query
from .sequences import islands
from .sqlbase import OBJECT_FRAMES, with_

LIMITS = R.Limits().scaled(rest_window=0.5, still_linear=0.2, object_position=0.06)
PADS = {("left", "a"): "opening > 0.02", ("left", "b"): "opening < 0.95", ("right", "a"): "opening > 0.03", ("right", "b"): "opening < 0.9"}


def _pads_sql() -> str:
    runs = ",".join(islands("frames", f"CASE WHEN {cond} THEN 1 END", name=f"{side}_{pad}") for (side, pad), cond in PADS.items())
    return runs + ", pads AS (" + " UNION ALL ".join(f"SELECT episode, '{side}' AS side, '{pad}' AS pad, start, stop FROM {side}_{pad}" for side, pad in PADS) + ")"


GATED = f"""
st AS (SELECT *, greatest(t - lag(t) OVER w, 0.05::DOUBLE) AS dt, opening - lag(opening) OVER w AS d_o, z - lag(z) OVER w AS d_z, x - lag(x) OVER w AS d_x, y - lag(y) OVER w AS d_y, yaw - lag(yaw) OVER w AS d_w,
  least(opening + 0.02::DOUBLE, 1.03::DOUBLE - opening) AS m1, least(yaw + 3.16::DOUBLE, 17.0::DOUBLE - yaw) AS m2 FROM frames WINDOW w AS (PARTITION BY episode ORDER BY row)),
ro AS (SELECT episode, count(*) + CASE WHEN episode % 11 = 0 THEN 1 ELSE 0 END AS expected, CASE WHEN episode % 13 = 0 THEN 1 ELSE 0 END AS warnings, CASE WHEN episode % 3 = 0 THEN (episode % 10) / 5000.0::DOUBLE END AS reference,
  CASE WHEN episode % 17 = 0 THEN 'lost' END AS unmapped, max(row) AS last FROM frames GROUP BY episode),
me AS (SELECT episode, count(*) AS steps, bool_and(value < 240) AS finite, min(least(m1, m2)) AS margin, arg_min(CASE WHEN m1 <= m2 THEN 'j1' ELSE 'j2' END, (least(m1, m2), row)) AS margin_joint,
  max(abs(d_o / dt / 4)) AS arm, max(abs(d_z / dt / 10)) AS neck, max(abs(d_x / dt / 30)) AS vx, max(abs(d_y / dt / 30)) AS vy, max(abs(d_w / dt / 60)) AS wz,
  max(greatest(opening * 0.08::DOUBLE, z * 0.06::DOUBLE)) AS tcp_p, max(greatest(opening * 0.2::DOUBLE, abs(yaw / 40))) AS tcp_r, min(0.0089::DOUBLE + z / 5) AS clearance FROM st GROUP BY episode),
ct AS (SELECT episode, row, CASE event_type WHEN 'view' THEN 'robot_environment' WHEN 'purchase' THEN 'object_environment' WHEN 'click' THEN 'hand_object' WHEN 'error' THEN 'robot_self' ELSE CASE WHEN value > 190 THEN 'nonhand_object' ELSE 'robot_self' END END AS kind,
  value / 180 * CASE WHEN event_type = 'click' THEN 0.00104::DOUBLE ELSE 0.00208::DOUBLE END AS depth, 'p' || (event_id % 9) AS pair FROM frames),
cm AS (SELECT episode, coalesce(max(depth) FILTER (kind = 'robot_environment'), 0) AS re, coalesce(max(depth) FILTER (kind = 'object_environment' AND row >= 5), 0) AS oe, coalesce(max(depth) FILTER (kind = 'hand_object'), 0) AS ho,
  coalesce(max(depth) FILTER (kind = 'robot_self'), 0) AS rs, count(*) FILTER (kind = 'nonhand_object') AS stray, arg_min(pair, row) FILTER (kind = 'nonhand_object') AS stray_first FROM ct GROUP BY episode),
{_pads_sql()},
bi AS (SELECT f.episode, p.side, f.row FROM frames f JOIN pads p ON p.episode = f.episode AND f.row >= p.start AND f.row < p.stop GROUP BY ALL HAVING count(DISTINCT p.pad) = 2),
hr AS (SELECT o.episode, s.side, o.object, o.row, b.row IS NOT NULL AS pads_on, o.z AS lift, (o.px - o.x) / 400 AS p0, (o.py - o.y) / 400 AS p1, (o.pz - o.z) / 400 AS p2, cos(o.yaw / 200) AS q0, sin(o.yaw / 200) AS q3,
  CASE WHEN s.side = 'left' THEN o.closed ELSE o.event_type IN ('view', 'click', 'purchase') END AS near, o.opening > 0.3 AS wide
  FROM object_frames o CROSS JOIN (SELECT unnest(['left', 'right']) AS side) s LEFT JOIN bi b ON b.episode = o.episode AND b.side = s.side AND b.row = o.row WHERE o.role = 'manipulated'),
{islands("hr", "CASE WHEN near AND NOT wide THEN 1 END", name="gr", keys="episode, side, object")},
an AS (SELECT episode, side, object, g, min(CASE WHEN pads_on AND lift > 0.015 THEN row END) AS a FROM gr_g WHERE lab IS NOT NULL GROUP BY ALL),
ca AS (SELECT g.*, a.a, b.p0 AS a0, b.p1 AS a1, b.p2 AS a2, b.q0 AS b0, b.q3 AS b3 FROM gr_g g JOIN an a ON a.episode = g.episode AND a.side = g.side AND a.object = g.object AND a.g = g.g AND g.lab IS NOT NULL AND g.row >= a.a
  JOIN hr b ON b.episode = g.episode AND b.side = g.side AND b.object = g.object AND b.row = a.a),
cr AS (SELECT episode, side || '/' || object AS n, count(*) * 0.02::DOUBLE AS carry_s, count(*) FILTER (pads_on) * 0.02::DOUBLE AS bilateral_s, max(sqrt(pow(p0 - a0, 2) + pow(p1 - a1, 2) + pow(p2 - a2, 2))) AS moved,
  max(2.0::DOUBLE * acos(least(abs(q0 * b0 + q3 * b3), 1.0::DOUBLE))) AS turned FROM ca GROUP BY episode, side, object),
gc AS (SELECT episode, bool_and(moved <= 0.003 AND turned <= radians(3)) AS drift_ok, string_agg(n || ': ' || printf('%.4f', moved) || ' m, ' || printf('%.4f', turned) || ' rad', '; ' ORDER BY n) AS drift,
  bool_and(bilateral_s / carry_s >= 0.95) AS pads_ok, string_agg(n || ': ' || printf('%.4f', bilateral_s / carry_s), '; ' ORDER BY n) AS pads FROM cr GROUP BY episode),
tr AS (SELECT *, cos(row / 40.0::DOUBLE) AS w0, sin(row / 40.0::DOUBLE) AS w3 FROM object_frames WHERE role = 'manipulated' AND episode % 7 > 1),
le AS (SELECT * FROM tr WHERE valid QUALIFY row_number() OVER (PARTITION BY episode, object ORDER BY row DESC) = 1),
ea AS (SELECT t.* FROM tr t JOIN le ON le.episode = t.episode AND le.object = t.object AND t.valid AND t.t >= le.t - 0.5 - 1e-9 AND t.t < le.t - 1e-9 QUALIFY row_number() OVER (PARTITION BY t.episode, t.object ORDER BY t.row) = 1),
en AS (SELECT l.episode, l.object, l.row AS source_row, l.px, l.py, l.pz, sqrt(pow(l.px - e.px, 2) + pow(l.py - e.py, 2) + pow(l.pz - e.pz, 2)) / (l.t - e.t) < 0.2 AND 2.0::DOUBLE * acos(least(abs(l.w0 * e.w0 + l.w3 * e.w3), 1.0::DOUBLE)) / (l.t - e.t) < 0.2 AS at_rest
  FROM le l LEFT JOIN ea e ON e.episode = l.episode AND e.object = l.object),
tk AS (SELECT n.episode, n.object AS name, CASE WHEN at_rest = false THEN 'source_end' ELSE 'after_hold' END AS rule, 'm' AS unit, sqrt(pow(o.px - n.px, 2) + pow(o.py - n.py, 2) + pow(o.pz - n.pz, 2)) AS error, 0.06::DOUBLE AS tolerance
  FROM en n JOIN ro USING (episode) JOIN tr o ON o.episode = n.episode AND o.object = n.object AND o.row = CASE WHEN at_rest = false THEN least(source_row, last) ELSE last END
  UNION ALL SELECT episode, 'drawer', 'articulation_final', 'm', abs(arg_max(opening * 0.05::DOUBLE + (row % 2) * 0.02::DOUBLE, row) - arg_max(opening * 0.05::DOUBLE, row) FILTER (row % 5 <> 0)), 0.06 FROM frames WHERE episode % 7 = 1 GROUP BY episode
    HAVING max(opening * 0.05::DOUBLE) FILTER (row % 5 <> 0) - min(opening * 0.05::DOUBLE) FILTER (row % 5 <> 0) >= 0.01
  UNION ALL SELECT episode, 'door', 'articulation_final', 'rad', abs(arg_max(yaw / 50 + (episode % 2) * 0.06::DOUBLE, row) - arg_max(yaw / 50, row)), 0.05 FROM frames WHERE episode % 7 = 1 GROUP BY episode HAVING max(yaw / 50) - min(yaw / 50) >= 0.05
  UNION ALL SELECT f.episode, 'base', 'navigation_destination', 'm', sqrt(pow(x - (x + (f.episode % 4) * 0.025::DOUBLE), 2)), 0.06 FROM frames f JOIN ro ON ro.episode = f.episode AND f.row = ro.last WHERE f.episode % 7 = 0),
ta AS (SELECT episode, bool_and(coalesce(error <= tolerance, true)) AS task_ok, string_agg(name || ': ' || printf('%.4f', error) || ' ' || unit || ' (' || rule || ')', '; ' ORDER BY name) AS task FROM tk GROUP BY episode),
bo AS (SELECT o.episode, o.object AS body, CASE WHEN o.n % 7 <> 0 THEN o.object END AS object, e.at_rest, f.closed AS held, f.opening * 3 * o.hx AS linear, f.z AS angular FROM objects0 o JOIN ro ON ro.episode = o.episode
  JOIN frames f ON f.episode = o.episode AND f.row = ro.last LEFT JOIN en e ON e.episode = o.episode AND e.object = o.object WHERE o.role = 'manipulated'),
bj AS (SELECT *, object IS NULL OR at_rest IS NULL OR held OR at_rest AS required, linear < 0.2 AND angular < 0.2 AS still FROM bo),
bs AS (SELECT episode, bool_and(still OR NOT required) AS rest_ok, string_agg(body || ': ' || printf('%.3f', linear) || ' m/s ' || printf('%.3f', angular) || ' rad/s' || CASE WHEN required THEN '' ELSE ' (reported only)' END, '; ' ORDER BY body) AS rest FROM bj GROUP BY episode),
rp AS (SELECT episode, CASE WHEN episode % 19 <> 0 THEN max(abs(x - CASE WHEN episode % 5 = 0 THEN x + 0.000002::DOUBLE ELSE x END)) END AS replay FROM frames GROUP BY episode),
al AS (SELECT *, greatest(0.002::DOUBLE, coalesce(reference + 0.001::DOUBLE, 0.002::DOUBLE)) AS thr FROM ro LEFT JOIN me USING (episode) LEFT JOIN cm USING (episode) LEFT JOIN gc USING (episode) LEFT JOIN ta USING (episode) LEFT JOIN bs USING (episode) LEFT JOIN rp USING (episode)),
gt AS (SELECT episode, unnest([
  {{'position': 0, 'gate': 'rollout_complete', 'ok': finite AND steps = expected AND warnings = 0, 'detail': 'steps ' || steps || '/' || expected || ', finite=' || CAST(finite AS VARCHAR) || ', warnings=' || warnings}},
  {{'position': 1, 'gate': 'robot_environment_penetration', 'ok': re <= 0.002, 'detail': printf('%.4f', re) || ' m'}},
  {{'position': 2, 'gate': 'object_environment_penetration', 'ok': oe <= thr, 'detail': printf('%.4f', oe) || ' m, ' || CASE WHEN reference IS NULL THEN 'absolute threshold 0.0020 m (no source reference)' ELSE 'source-relative threshold ' || printf('%.4f', thr) || ' m = max(absolute 0.0020 m, source reference ' || printf('%.4f', reference) || ' m + 0.0010 m)' END}},
  {{'position': 3, 'gate': 'hand_object_penetration', 'ok': ho <= 0.001, 'detail': printf('%.4f', ho) || ' m'}},
  {{'position': 4, 'gate': 'no_nonhand_object_contact', 'ok': stray = 0, 'detail': stray || ' contacts, first ' || coalesce(stray_first, 'none')}},
  {{'position': 5, 'gate': 'robot_self_penetration', 'ok': rs <= 0.002, 'detail': printf('%.4f', rs) || ' m'}},
  {{'position': 6, 'gate': 'self_clearance', 'ok': clearance >= 0.009, 'detail': printf('%.4f', clearance) || ' m'}},
  {{'position': 7, 'gate': 'joint_margin', 'ok': margin >= 0.025, 'detail': printf('%.4f', margin) || ' rad at ' || margin_joint}},
  {{'position': 8, 'gate': 'arm_speed', 'ok': arm <= 1.001, 'detail': printf('%.3f', arm) || ' rad/s'}},
  {{'position': 9, 'gate': 'neck_speed', 'ok': neck <= radians(30) + 0.001, 'detail': printf('%.3f', neck) || ' rad/s'}},
  {{'position': 10, 'gate': 'base_speed', 'ok': vx <= 0.611 AND vy <= 0.611 AND wz <= radians(114) + 0.001, 'detail': 'body vx, vy, wz = ' || printf('%.3f', vx) || ', ' || printf('%.3f', vy) || ', ' || printf('%.3f', wz)}},
  {{'position': 11, 'gate': 'tcp_tracking', 'ok': tcp_p <= 0.03 AND tcp_r <= 0.2, 'detail': printf('%.4f', tcp_p) || ' m, ' || printf('%.4f', tcp_r) || ' rad'}},
  {{'position': 12, 'gate': 'grasp_drift', 'ok': coalesce(drift_ok, true), 'detail': coalesce(drift, 'no carry')}},
  {{'position': 13, 'gate': 'carry_contact', 'ok': coalesce(pads_ok, true), 'detail': coalesce(pads, 'no carry')}},
  {{'position': 14, 'gate': 'task_final_pose', 'ok': coalesce(task_ok, false) AND unmapped IS NULL, 'detail': coalesce(task, 'no manipulated object with a scene body') || coalesce('; unmapped objects ' || unmapped, '')}},
  {{'position': 15, 'gate': 'objects_at_rest', 'ok': coalesce(rest_ok, true), 'detail': coalesce(rest, 'no free body')}},
  {{'position': 16, 'gate': 'actuator_replay', 'ok': coalesce(replay <= 1e-7, false), 'detail': 'max |diff| ' || coalesce(printf('%.6f', replay), 'none')}}], recursive := true) FROM al)"""


def _recorded(spark, d):
    """Rollout tables from the landed frames and object tracks, and the gates over them."""
    ep, f = F.col("episode"), cut(L.frames(spark, d).select("episode", "row", "t", "event_id", "event_type", "value", "opening", "closed", "yaw", "x", "y", "z"))
    o = cut(L.object_frames(spark, d, "n").where(F.col("role") == "manipulated").select("episode", "object", "row", "t", "valid", "opening", "closed", "event_type", "yaw", "x", "y", "z", "px", "py", "pz", "n", "hx"))
    near = shift(f, L.FRAMES, {f"p_{c}": (F.col(c), -1) for c in ("t", "opening", "z", "x", "y", "yaw")})
    rate = lambda c, k: (F.col(c) - F.col(f"p_{c}")) / F.greatest(F.col("t") - F.col("p_t"), F.lit(0.05)) / k
    metrics = R.step_metrics(near, ["episode"], "row", finite=F.col("value") < 240, joints=[("j1", F.col("opening"), -0.02, 1.03), ("j2", F.col("yaw"), -3.16, 17.0)], arm=[rate("opening", 4.0)], neck=[rate("z", 10.0)],
                             base={"vx": rate("x", 30.0), "vy": rate("y", 30.0), "wz": rate("yaw", 60.0)}, tcp_position=[F.col("opening") * 0.08, F.col("z") * 0.06],
                             tcp_rotation=[F.col("opening") * 0.2, F.col("yaw") / 40.0], clearance=0.0089 + F.col("z") / 5.0)
    kind = F.when(F.col("event_type") == "view", "robot_environment").when(F.col("event_type") == "purchase", "object_environment").when(F.col("event_type") == "click", "hand_object") \
        .when((F.col("event_type") == "error") | (F.col("value") <= 190), "robot_self").otherwise("nonhand_object")
    depth = F.col("value") / 180.0 * F.when(F.col("event_type") == "click", 0.00104).otherwise(0.00208)
    contacts = R.contact_metrics(f.select("episode", "row", kind.alias("kind"), depth.alias("depth"), F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string")).alias("pair"), (F.col("row") < 5).alias("settling")), ["episode"], "row")
    both_hands = F.explode(F.array(F.lit("left"), F.lit("right")))
    pads = None
    for (side, pad), cond in PADS.items():
        found = S.runs(f.select("episode", "row", "opening"), F.when(F.expr(cond), F.lit(1)), L.FRAMES).select("episode", F.lit(side).alias("side"), F.explode(F.array(F.lit("click"), F.lit("purchase"))).alias("object"), F.lit(pad).alias("pad"), "start", "stop")
        pads = found if pads is None else pads.unionByName(found)
    hands = o.withColumn("side", both_hands)
    axis = L.FRAMES.within("side", "object")
    hands = R.bilateral(hands, pads, list(axis.keys), "row", L.FRAMES.span)
    grip = F.when(F.col("side") == "left", F.col("closed")).otherwise(F.col("event_type").isin("view", "click", "purchase"))
    half = F.col("yaw") / 200.0
    carries = R.grasp_carries(hands, axis, near=grip, opened=F.col("opening") > 0.3, lift=F.col("z"), place=[(F.col(f"p{c}") - F.col(c)) / 400.0 for c in "xyz"],
                              turn=[F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)], dt=0.02, limits=LIMITS)
    last = f.groupBy("episode").agg(F.max("row").alias("last"), F.count(F.lit(1)).alias("n"))
    carried = o.where(ep % 7 > 1).withColumns({"w0": F.cos(F.col("row") / 40.0), "w3": F.sin(F.col("row") / 40.0)})
    ends = cut(R.source_ends(carried, "t", ["px", "py", "pz"], ["w0", "w3"], L.FRAMES.within("object"), LIMITS))
    tasks = R.object_tasks(ends, carried.join(last.select("episode", "last"), "episode"), ["px", "py", "pz"], ["episode"], "row", LIMITS)
    j = f.where(ep % 7 == 1)
    drawer = j.select("episode", "row", F.lit("drawer").alias("joint"), F.lit(True).alias("slide"), F.when(F.col("row") % 5 != 0, F.col("opening") * 0.05).alias("source"), (F.col("opening") * 0.05 + (F.col("row") % 2) * 0.02).alias("final"))
    door = j.select("episode", "row", F.lit("door").alias("joint"), F.lit(False).alias("slide"), (F.col("yaw") / 50.0).alias("source"), (F.col("yaw") / 50.0 + (ep % 2) * 0.06).alias("final"))
    tasks = tasks.unionByName(R.joint_tasks(drawer.unionByName(door), ["episode"], "row", LIMITS))
    tasks = tasks.unionByName(R.base_tasks(f.where(ep % 7 == 0).select("episode", "row", "x", "y", (F.col("x") + (ep % 4) * 0.025).alias("gx"), F.col("y").alias("gy")), ["episode"], "row", ["x", "y"], ["gx", "gy"], LIMITS))
    final = o.join(last.select("episode", F.col("last").alias("row")), ["episode", "row"]).join(ends.select("episode", "object", "at_rest"), ["episode", "object"], "left")
    bodies = final.select("episode", F.col("object").alias("body"), F.when(F.col("n") % 7 != 0, F.col("object")).alias("object"), "at_rest", F.col("closed").alias("held_at_end"), (F.col("opening") * 3.0 * F.col("hx")).alias("linear"), F.col("z").alias("angular"))
    again = f.where((ep % 19 != 0) | (F.col("row") > 0)).select("episode", "row", F.when(ep % 5 == 0, F.col("x") + 0.000002).otherwise(F.col("x")).alias("x"))
    replays = R.replay_difference(f, again, ["episode"], "row", ["x"])
    rollouts = last.select("episode", (F.col("n") + F.when(ep % 11 == 0, 1).otherwise(0)).alias("expected"), F.when(ep % 13 == 0, 1).otherwise(0).alias("warnings"), F.when(ep % 3 == 0, (ep % 10) / 5000.0).alias("reference"), F.when(ep % 17 == 0, "lost").alias("unmapped"))
    return R.gates(rollouts, metrics, contacts, cut(carries), cut(tasks), bodies, replays, ["episode"], LIMITS)


@query("gt04_rollout_gates", "GT4", "AG33", "AG12", "AG24", "AG31", "AG32", "WN21", sql=with_(OBJECT_FRAMES, GATED + " SELECT episode, position, gate, ok, detail FROM gt"))
def _(spark, d):
    return _recorded(spark, d).select("episode", "position", "gate", "ok", "detail")


@query("gt04_rollout_verdicts", "GT4", sql=with_(OBJECT_FRAMES, GATED + """
SELECT episode, bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS failures, coalesce(string_agg(gate || ': ' || detail, ' | ' ORDER BY position) FILTER (NOT ok), '') AS reasons FROM gt GROUP BY episode"""))
def _(spark, d):
    out = R.verdicts(_recorded(spark, d), ["episode"])
    return out.select("episode", "passed", "failures", F.array_join("reasons", " | ").alias("reasons"))
