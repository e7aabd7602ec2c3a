"""Labelling queries: closed hands, grasps, pushes, carries, weights, gaze."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planar
from ..operators import labels as B
from ..operators import sequence as S
from ..operators.blocks import attach, quantile, running, shift
from ..operators.lineage import cut
from ..sources import landing as L
from .registry import query, r6
from .sequences import STEP, W, islands
from .sqlbase import FRAMES, OBJECT_FRAMES, with_

CONTACT, WIDTH_SCALE = 0.08, 0.3
GRAD = f"""
gr0 AS (SELECT *, lag(t) OVER w AS tp, lead(t) OVER w AS tn, lag(opening) OVER w AS p, lead(opening) OVER w AS q FROM frames {W}),
gr AS (SELECT *, CASE WHEN tp IS NULL THEN (q - opening)/(tn - t) WHEN tn IS NULL THEN (opening - p)/(t - tp)
  ELSE ((t-tp)*(t-tp)*q + ((tn-t)*(tn-t) - (t-tp)*(t-tp))*opening - (tn-t)*(tn-t)*p) / ((t-tp)*(tn-t)*(tn-tp)) END AS rate FROM gr0),
lev AS (SELECT episode, quantile_cont(opening, 0.95) AS lev FROM frames GROUP BY episode)"""


@query("lb01_closed_by_opening", "LB1", "AG28", sql=with_(FRAMES, GRAD + """
SELECT episode, row, (opening < 0.05 OR (opening < lev - 0.05 AND abs(rate) <= 0.2)) AND rate <= 0.2 AS is_closed FROM gr JOIN lev USING (episode)"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t", "opening")
    return B.closed_by_opening(f, "t", L.FRAMES, closed_opening=0.05, drop=0.05, rate=0.2).select("episode", "row", "is_closed")


@query("lb01_closed_by_command", "LB1", sql=with_(FRAMES, GRAD + """,
cmd0 AS (SELECT *, rate < -0.05 AS closing, opening < lev - 0.05 AS low FROM gr JOIN lev USING (episode)),
""" + islands("cmd0", "CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 1 END", name="cmd") + """,
mv AS (SELECT episode, g, min(row) AS a, min(CASE WHEN closing THEN row END) AS m0 FROM cmd_g WHERE lab IS NOT NULL GROUP BY ALL),
st AS (SELECT c.episode, c.g, min(CASE WHEN NOT closing AND low THEN row END) AS s1, min(CASE WHEN NOT closing THEN row END) AS s2
       FROM cmd_g c JOIN mv USING (episode, g) WHERE c.lab IS NOT NULL AND c.row >= m0 GROUP BY ALL)
SELECT c.episode, c.row, coalesce(c.lab IS NOT NULL AND c.row >= CASE WHEN m0 IS NULL THEN a ELSE coalesce(s1, s2) END, false) AS is_closed
FROM cmd_g c LEFT JOIN mv USING (episode, g) LEFT JOIN st USING (episode, g)"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t", "opening", F.col("event_type").isin("click", "purchase", "view").cast("double").alias("command"))
    return B.closed_by_command(f, "t", L.FRAMES, drop=0.05, rate=0.05).select("episode", "row", "is_closed")


PAIRS = """pairs AS (SELECT *, CASE WHEN valid THEN sqrt(pow(greatest(abs(x - px) - hx, 0), 2) + pow(greatest(abs(y - py) - hy, 0), 2) + pow(greatest(abs(z - pz) - hz, 0), 2)) END AS dist,
    CASE WHEN object = 'purchase' THEN 2*least(hx, hy, hz) ELSE 2*(abs(sin(yaw))*hx + abs(cos(yaw))*hy) END AS extent, opening * 0.3::DOUBLE AS width FROM object_frames)"""
NEAR = PAIRS + """,
near AS (SELECT * FROM pairs WHERE role = 'manipulated' QUALIFY row_number() OVER (PARTITION BY episode, row ORDER BY coalesce(dist, 'inf'::DOUBLE), object) = 1)"""


def pairs(spark, d, axis=L.FRAMES):
    """Hand-object pairs: box distance, extent of the object along the closing axis, pad width."""
    o = L.object_frames(spark, d, axis=axis)
    over = [F.greatest(F.abs(F.col(c) - F.col(f"p{c}")) - F.col(f"h{c}"), F.lit(0.0)) for c in "xyz"]
    dist = F.sqrt(over[0] * over[0] + over[1] * over[1] + over[2] * over[2])
    envelope = F.col("object") == "purchase"
    extent = F.when(envelope, 2.0 * F.least("hx", "hy", "hz")).otherwise(
        2.0 * (F.abs(F.sin("yaw")) * F.col("hx") + F.abs(F.cos("yaw")) * F.col("hy")))
    return o.withColumns({"dist": F.when(F.col("valid"), dist), "extent": extent, "width": F.col("opening") * WIDTH_SCALE, "envelope": envelope})


def hand(spark, d):
    """Frames with the nearest manipulated object."""
    p = pairs(spark, d).where(F.col("role") == "manipulated")
    near = B.nearest(p, ["episode", "row"], F.col("dist"), ["extent", "width", "t", "closed"])
    return near.withColumnRenamed("closed", "is_closed")


@query("jn16_nearest_object", "JN16", "FN-G5", "FN-G6", sql=with_(OBJECT_FRAMES, NEAR + """
SELECT episode, row, object AS nearest, round(CASE WHEN dist IS NULL THEN -1 ELSE dist END, 6) + 0.0 AS distance, round(extent, 6) AS extent FROM near"""))
def _(spark, d):
    dist = F.when(F.col("distance") == float("inf"), F.lit(-1.0)).otherwise(F.col("distance"))
    return hand(spark, d).select("episode", "row", "nearest", r6(dist).alias("distance"), r6("extent").alias("extent"))


@query("jn19_label_to_object", "JN19", sql=with_(OBJECT_FRAMES, """
ids AS (SELECT episode, object, dense_rank() OVER (PARTITION BY episode ORDER BY object) - 1 AS k FROM (SELECT DISTINCT episode, object FROM objects0 WHERE role = 'manipulated'))
SELECT f.episode, f.row, i.object FROM frames f JOIN ids i ON i.episode = f.episode AND i.k = f.label"""))
def _(spark, d):
    ids = L.objects(spark, d).where(F.col("role") == "manipulated").select("episode", "object")
    ids = S.rank_ids(ids, ["episode"], "object", "label")
    f = L.frames(spark, d).select("episode", "row", "label")
    return f.join(ids, ["episode", "label"]).select("episode", "row", "object")


HIT = NEAR + ",\n" + islands("near", f"CASE WHEN closed AND coalesce(dist, 'inf'::DOUBLE) <= {CONTACT} THEN object END", name="hc") + f""",
hcr AS (SELECT *, cos(yaw)*(px-x) + sin(yaw)*(py-y) AS rx, cos(yaw)*(py-y) - sin(yaw)*(px-x) AS ry, pz - z AS rz FROM hc_g),
hcm AS (SELECT episode, g, count(*) AS n, quantile_cont(rx, 0.5) AS mx, quantile_cont(ry, 0.5) AS my, quantile_cont(rz, 0.5) AS mz,
   sqrt(pow(max(px)-min(px), 2) + pow(max(py)-min(py), 2) + pow(max(pz)-min(pz), 2)) AS travel FROM hcr WHERE lab IS NOT NULL GROUP BY ALL),
hcs AS (SELECT r.episode, r.g, max(sqrt(pow(rx-mx, 2) + pow(ry-my, 2) + pow(rz-mz, 2))) AS slip, any_value(n) AS n, any_value(travel) AS travel FROM hcr r JOIN hcm m ON m.episode = r.episode AND m.g = r.g WHERE lab IS NOT NULL GROUP BY ALL),
hit AS (SELECT h.episode, row, t, closed, object, coalesce(dist, 'inf'::DOUBLE) AS dist, extent, width,
   CASE WHEN lab IS NOT NULL AND NOT (width < 0.5 * extent AND NOT (object = 'purchase' AND coalesce(s.n >= 2 AND s.travel > 0.03 AND s.slip <= 0.1, false))) THEN object END AS lab0
   FROM hc_g h LEFT JOIN hcs s ON s.episode = h.episode AND s.g = h.g AND h.lab IS NOT NULL)"""
BRIDGED = HIT + f""",
br0 AS (SELECT *, last_value(CASE WHEN lab0 IS NOT NULL THEN {{'l': lab0, 'r': row, 't': t}} END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
   first_value(CASE WHEN lab0 IS NOT NULL THEN {{'l': lab0, 'r': row, 't': t}} END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM hit),
br1 AS (SELECT *, CASE WHEN lab0 IS NULL AND pv.l = nx.l AND nx.t - pv.t <= 1.5 + 1e-9 THEN pv.r END AS gap FROM br0),
brok AS (SELECT episode, gap, bool_and(dist <= {CONTACT} AND object = pv.l) AS ok FROM br1 WHERE gap IS NOT NULL GROUP BY ALL),
br AS (SELECT b.* , CASE WHEN lab0 IS NOT NULL THEN lab0 WHEN k.ok THEN pv.l END AS lab1, coalesce(lead(t) OVER (PARTITION BY b.episode ORDER BY b.row), t + t - lag(t) OVER (PARTITION BY b.episode ORDER BY b.row), t) AS row_end
   FROM br1 b LEFT JOIN brok k ON k.episode = b.episode AND k.gap = b.gap),
""" + islands("br", "CASE WHEN lab1 IS NOT NULL THEN 1 END", name="gr") + """,
sp AS (SELECT episode, g, max(row_end) - min(t) AS span FROM gr_g WHERE lab IS NOT NULL GROUP BY ALL),
grasp AS (SELECT x.*, CASE WHEN x.lab IS NOT NULL AND s.span >= 0.6 - 1e-9 THEN lab1 END AS grasp FROM gr_g x LEFT JOIN sp s USING (episode, g))"""


def grasped(spark, d):
    """Frames with their grasp labels; an envelope-shaped object that the hand carries rigidly is held whatever the width."""
    axis = L.frame_axis(spark, d)
    p = pairs(spark, d, axis).where(F.col("role") == "manipulated")
    h = B.nearest(p, ["episode", "row"], F.col("dist"), ["extent", "width", "t", "closed", "envelope", "x", "y", "z", "yaw", "px", "py", "pz"]).withColumnRenamed("closed", "is_closed")
    rx, ry, rz = _in_hand()
    h = cut(h.withColumns({"rx": rx, "ry": ry, "rz": rz, "valid": F.lit(True)}))
    h = B.carried_rows(h, F.col("is_closed") & (F.col("distance") <= CONTACT), {c: F.col(c) for c in ("px", "py", "pz")}, {c: F.col(c) for c in ("rx", "ry", "rz")},
                       axis, slip=0.1, label=F.col("nearest"))
    h = cut(h.withColumn("carried", F.col("carried") & F.col("envelope")).select("episode", "row", "t", "is_closed", "nearest", "distance", "extent", "width", "carried"))
    return B.grasp_labels(B.row_end(h, "t", axis), "t", axis, contact=CONTACT, gap=1.5, least=0.6)


@query("lb02_grasp_labels", "LB2", "WN10", "WN11", sql=with_(OBJECT_FRAMES, BRIDGED + " SELECT episode, row, grasp FROM grasp"))
def _(spark, d):
    return grasped(spark, d).select("episode", "row", "grasp")


@query("lb04_touch_labels", "LB4", sql=with_(OBJECT_FRAMES, BRIDGED + f"""
SELECT episode, row, CASE WHEN grasp IS NULL AND closed AND dist <= {CONTACT} THEN object ELSE grasp END AS touch FROM grasp"""))
def _(spark, d):
    return B.touch_labels(grasped(spark, d), CONTACT).select("episode", "row", "touch")


def _in_hand():
    """Object position in the hand frame, which is turned by the yaw."""
    bx, by = planar.to_body(F.col("px") - F.col("x"), F.col("py") - F.col("y"), F.col("yaw"))
    return bx, by, F.col("pz") - F.col("z")


REL = """rel AS (SELECT *, cos(yaw)*(px-x) + sin(yaw)*(py-y) AS rx, cos(yaw)*(py-y) - sin(yaw)*(px-x) AS ry, pz - z AS rz FROM object_frames)"""


@query("lb03_carried_runs", "LB3", sql=with_(OBJECT_FRAMES, REL + ",\n" + islands("rel", "CASE WHEN closed THEN 1 END", name="cl", keys="episode, object") + """,
med AS (SELECT episode, object, g, count(*) AS n, quantile_cont(rx, 0.5) AS mx, quantile_cont(ry, 0.5) AS my, quantile_cont(rz, 0.5) AS mz,
   sqrt(pow(max(px)-min(px), 2) + pow(max(py)-min(py), 2) + pow(max(pz)-min(pz), 2)) AS travel FROM cl_g WHERE lab IS NOT NULL AND valid GROUP BY ALL),
sl AS (SELECT episode, object, g, max(sqrt(pow(rx-mx, 2) + pow(ry-my, 2) + pow(rz-mz, 2))) AS slip FROM cl_g JOIN med USING (episode, object, g) WHERE lab IS NOT NULL AND valid GROUP BY ALL)
SELECT c.episode, c.object, c.row, coalesce(m.n >= 2 AND m.travel > 0.03 AND s.slip <= 0.1, false) AS carried FROM cl_g c
LEFT JOIN med m ON m.episode = c.episode AND m.object = c.object AND m.g = c.g AND c.lab IS NOT NULL
LEFT JOIN sl s ON s.episode = c.episode AND s.object = c.object AND s.g = c.g AND c.lab IS NOT NULL"""))
def _(spark, d):
    axis = L.frame_axis(spark, d)
    p = L.object_frames(spark, d, axis=axis).select("episode", "object", "row", "closed", "valid", "px", "py", "pz", "x", "y", "z", "yaw")
    rx, ry, rz = _in_hand()
    p = cut(p.select("episode", "object", "row", "closed", "valid", "px", "py", "pz", rx.alias("rx"), ry.alias("ry"), rz.alias("rz")))
    out = B.carried_rows(p, F.col("closed"), {c: F.col(c) for c in ("px", "py", "pz")}, {c: F.col(c) for c in ("rx", "ry", "rz")},
                         axis.within("object"), slip=0.1)
    return out.select("episode", "object", "row", "carried")


@query("lb05_push_labels", "LB5", sql=with_(OBJECT_FRAMES, PAIRS + """,
v0 AS (SELECT *, lag(t) OVER o AS tp, lead(t) OVER o AS tn, """ + ", ".join(f"lag({c}) OVER o AS p_{c}, lead({c}) OVER o AS n_{c}" for c in ("x", "y", "z", "px", "py", "pz")) + """
  FROM pairs WHERE role = 'manipulated' WINDOW o AS (PARTITION BY episode, object ORDER BY row)),
v AS (SELECT *, """ + ", ".join(f"CASE WHEN tp IS NULL THEN (n_{c} - {c})/(tn - t) WHEN tn IS NULL THEN ({c} - p_{c})/(t - tp) ELSE ((t-tp)*(t-tp)*n_{c} + ((tn-t)*(tn-t) - (t-tp)*(t-tp))*{c} - (tn-t)*(tn-t)*p_{c})/((t-tp)*(tn-t)*(tn-tp)) END AS v_{c}"
                                 for c in ("x", "y", "z", "px", "py", "pz")) + """ FROM v0),
s AS (SELECT *, sqrt(v_px*v_px + v_py*v_py + v_pz*v_pz) AS speed, sqrt(pow(v_px-v_x, 2) + pow(v_py-v_y, 2) + pow(v_pz-v_z, 2)) AS slide FROM v)
SELECT episode, row, object AS push FROM s WHERE valid AND closed AND dist <= 0.3 AND speed >= 0.02 AND slide <= 0.9*speed
QUALIFY row_number() OVER (PARTITION BY episode, row ORDER BY dist, object) = 1"""))
def _(spark, d):
    p = pairs(spark, d).where(F.col("role") == "manipulated")
    p = p.select("episode", "object", "row", "t", "x", "y", "z", "px", "py", "pz", (F.col("valid") & F.col("closed")).alias("valid"), "dist")
    return B.push_candidates(p, "t", L.FRAMES, contact=0.3, ratio=0.9)


@query("lb06_carry_intervals", "LB6", "WN6", sql=with_(OBJECT_FRAMES, REL + "," + STEP + """,
wd AS (SELECT r.*, CAST(greatest(1, round(1.2::DOUBLE / med / 2)) AS BIGINT) AS k, 1.4::DOUBLE / med AS n_min, max(row) OVER (PARTITION BY r.episode) AS last FROM rel r JOIN med USING (episode) WHERE role = 'manipulated'),
sp AS (SELECT a.episode, a.object, a.row, a.n_min, a.valid AND l.valid AND h.valid AND sqrt(pow(h.px-l.px, 2) + pow(h.py-l.py, 2) + pow(h.pz-l.pz, 2))/(h.t - l.t) > 0.003
   AND sqrt(pow(h.rx-l.rx, 2) + pow(h.ry-l.ry, 2) + pow(h.rz-l.rz, 2))/(h.t - l.t) < 0.1 AND sqrt(a.rx*a.rx + a.ry*a.ry + a.rz*a.rz) < 0.4 AND a.opening < 0.97 AS ok
   FROM wd a JOIN wd l ON l.episode = a.episode AND l.object = a.object AND l.row = greatest(a.row - a.k, 0)
   JOIN wd h ON h.episode = a.episode AND h.object = a.object AND h.row = least(a.row + a.k, a.last)),
""" + islands("sp", "CASE WHEN ok THEN 1 END", "min(n_min) AS n_min", name="ca", keys="episode, object") + """,
cb AS (SELECT *, CASE WHEN start - lag(stop) OVER v < n_min THEN 0 ELSE 1 END AS opens FROM ca WINDOW v AS (PARTITION BY episode, object ORDER BY start)),
cg AS (SELECT *, sum(opens) OVER (PARTITION BY episode, object ORDER BY start) AS g FROM cb)
SELECT episode, object, min(start) AS start, max(stop) AS stop FROM cg GROUP BY episode, object, g HAVING max(stop) - min(start) >= min(n_min)"""))
def _(spark, d):
    frames = L.frame_axis(spark, d)
    o = L.object_frames(spark, d, axis=frames).where(F.col("role") == "manipulated")
    rx, ry, rz = _in_hand()
    o = cut(o.select("episode", "object", "row", "t", "valid", "opening", "px", "py", "pz", rx.alias("rx"), ry.alias("ry"), rz.alias("rz")))
    med = S.median_step(L.frames(spark, d, frames).select("episode", "row", "t"), "t", frames, span=0.25)
    o = cut(o.join(med, "episode").withColumns({"k": F.greatest(F.round(1.2 / F.col("median_dt") / 2.0), F.lit(1)).cast("long"),
                                                "n_min": 1.4 / F.col("median_dt")}).drop("median_dt"))
    axis = frames.within("object")
    o = S.clipped_pair(o, F.col("k"), ["t", "valid", "px", "py", "pz", "rx", "ry", "rz"], axis)
    dt = F.col("hi_t") - F.col("lo_t")
    size = lambda names: F.sqrt(sum((n * n for n in names), F.lit(0.0)))
    moved = size([F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in ("px", "py", "pz")]) / dt
    slid = size([F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in ("rx", "ry", "rz")]) / dt
    ok = F.col("valid") & F.col("lo_valid") & F.col("hi_valid") & (moved > 0.003) & (slid < 0.1) \
        & (size([F.col("rx"), F.col("ry"), F.col("rz")]) < 0.4) & (F.col("opening") < 0.97)
    found = cut(S.runs(o.select("episode", "object", "row", "n_min", ok.alias("ok")), F.when(F.col("ok"), F.lit(1)), axis, {"n_min": F.min("n_min")}))
    joined = S.bridge(found, F.col("start") - F.col("prev_stop"), F.col("n_min"), axis, aggregates={"n_min": F.min("n_min")})
    return joined.where(F.col("stop") - F.col("start") >= F.col("n_min")).select("episode", "object", "start", "stop")


@query("lb07_grasp_events", "LB7", sql=with_(FRAMES, islands("frames", "CASE WHEN label IS NOT NULL THEN 1 END", name="held") + """,
n AS (SELECT episode, count(*) AS n FROM frames GROUP BY episode)
SELECT episode, 'start' AS event, start AS row FROM held WHERE start > 0
UNION ALL SELECT episode, 'end', stop FROM held JOIN n USING (episode) WHERE stop < n"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "label")
    r = S.runs(f, F.when(F.col("label").isNotNull(), F.lit(1)), L.FRAMES)
    r = r.join(f.groupBy("episode").agg(F.count(F.lit(1)).alias("n")), "episode")
    both = F.explode(F.array(F.struct(F.lit("start").alias("event"), F.col("start").alias("row"), (F.col("start") > 0).alias("ok")),
                             F.struct(F.lit("end").alias("event"), F.col("stop").alias("row"), (F.col("stop") < F.col("n")).alias("ok"))))
    return r.select("episode", both.alias("e")).where("e.ok").select("episode", "e.event", "e.row")


@query("lb07_held_masks", "LB7", sql=with_(OBJECT_FRAMES, """
SELECT episode, object, row, bool_or(label = CASE object WHEN 'click' THEN 0 ELSE 1 END) AS held FROM object_frames WHERE role = 'manipulated' AND label IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    o = L.object_frames(spark, d).where((F.col("role") == "manipulated") & F.col("label").isNotNull())
    mine = F.when(F.col("object") == "click", 0).otherwise(1)
    return o.groupBy("episode", "object", "row").agg(F.bool_or(F.col("label") == mine).alias("held"))


SEG = islands("frames", "CASE WHEN label IS NOT NULL THEN 1 END", "min(t) AS t0, max(t) AS t1", name="seg")
WEIGHT = SEG + """,
gap AS (SELECT f.episode, f.row, min(greatest(0, s.t0 - 0.2::DOUBLE - f.t, f.t - s.t1 - 0.1::DOUBLE)) AS apart FROM frames f JOIN seg s USING (episode) GROUP BY ALL),
wt AS (SELECT f.*, CASE WHEN g.apart IS NULL THEN 1.0 ELSE least(greatest(1 - g.apart / 0.5::DOUBLE, 0.05), 1) END AS w FROM frames f LEFT JOIN gap g USING (episode, row))"""


def _weighted(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t", "label", "opening")
    seg = S.runs(f, F.when(F.col("label").isNotNull(), F.lit(1)), L.FRAMES, {"t0": F.min("t"), "t1": F.max("t")})
    return B.window_weight(f, seg, "t", L.FRAMES, approach=0.2, retreat=0.1, blend=0.5, low=0.05, span=1.0)


@query("lb10_orientation_weight", "LB10", "JN14", sql=with_(FRAMES, WEIGHT + """
SELECT episode, row, round(CASE WHEN label IS NOT NULL THEN 1 ELSE least(w, least(greatest((0.12 - opening)/(0.12 - 0.05), 0.05), 1)) END, 5) AS weight FROM wt"""))
def _(spark, d):
    out = _weighted(spark, d)
    w = B.proximity_cap(F.col("weight"), F.col("label").isNotNull(), F.col("opening"), strict=0.05, free=0.12, low=0.05)
    return out.select("episode", "row", r6(w, 5).alias("weight"))


@query("lb11_hand_object_distance", "LB11", sql=with_(OBJECT_FRAMES, PAIRS + """,
fx AS (SELECT *, abs(value - 25) < 15 AS moving FROM pairs WHERE role = 'fixture' ),
""" + islands("fx", "CASE WHEN moving THEN 1 END", name="mv") + """,
b AS (SELECT *, lag(coalesce(dist, 9)) OVER (PARTITION BY episode ORDER BY row) AS dp FROM mv_g),
st AS (SELECT episode, g, bool_or(least(coalesce(dist, 9), coalesce(dp, dist, 9)) <= 0.1) AS near FROM b WHERE lab IS NOT NULL AND (prev_lab IS NULL) GROUP BY ALL),
fd AS (SELECT b.episode, b.row, CASE WHEN b.lab IS NOT NULL AND s.near THEN 0 ELSE coalesce(dist, 9) END AS dist FROM b LEFT JOIN st s USING (episode, g)),
al AS (SELECT episode, row, coalesce(dist, 9) AS dist FROM pairs WHERE role = 'manipulated' UNION ALL SELECT * FROM fd)
SELECT episode, row, round(min(dist), 6) + 0.0 AS distance FROM al GROUP BY episode, row"""))
def _(spark, d):
    p = cut(pairs(spark, d).select("episode", "object", "row", "role", "value", F.coalesce("dist", F.lit(9.0)).alias("dist")))
    fixtures = B.follow_articulation(p.where(F.col("role") == "fixture"), F.abs(F.col("value") - 25.0) < 15.0, "dist", L.FRAMES, reach=0.1)
    both = p.where(F.col("role") == "manipulated").select("episode", "row", "dist").unionByName(fixtures.select("episode", "row", "dist"))
    return both.groupBy("episode", "row").agg(r6(F.min("dist")).alias("distance"))


@query("lb12_idle_distance", "LB12", "WN13", sql=with_(OBJECT_FRAMES, """
k AS (SELECT *, """ + ", ".join(f"""coalesce(last_value(CASE WHEN valid THEN {c} END IGNORE NULLS) OVER (PARTITION BY episode, object ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(CASE WHEN valid THEN {c} END IGNORE NULLS) OVER (PARTITION BY episode, object ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS c{c}""" for c in ("px", "py", "pz")) + """
  FROM object_frames WHERE role IN ('manipulated', 'receptacle')),
o AS (SELECT *, abs(x - CASE WHEN role = 'manipulated' THEN px ELSE cpx END) AS ax, abs(y - CASE WHEN role = 'manipulated' THEN py ELSE cpy END) AS ay,
  abs(z - CASE WHEN role = 'manipulated' THEN pz ELSE cpz END) AS az FROM k)
SELECT episode, row, round(min(CASE WHEN role = 'manipulated' AND NOT valid THEN 0 WHEN object <> 'signup' THEN sqrt(pow(greatest(ax-hx, 0), 2) + pow(greatest(ay-hy, 0), 2) + pow(greatest(az-hz, 0), 2))
  ELSE sqrt(ax*ax + ay*ay + az*az) - 0.15 END), 6) + 0.0 AS idle FROM o GROUP BY episode, row"""))
def _(spark, d):
    o = L.object_frames(spark, d).withColumn("has_box", F.col("object") != "signup")
    return B.idle_distance(o, L.FRAMES).select("episode", "row", r6("idle").alias("idle"))


@query("lb19_gaze_rule", "LB19", "WN12", "AG17", sql=with_(FRAMES, """
g AS (SELECT episode, row, label, first_value(label IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM frames),
r AS (SELECT episode, CASE WHEN label IS NOT NULL THEN 0 WHEN nxt IS NOT NULL THEN 1 ELSE 2 END AS rule FROM g)
SELECT episode, CAST(rule AS BIGINT) AS rule, count(*) AS frames FROM r GROUP BY ALL"""))
def _(spark, d):
    return B.gaze(L.frames(spark, d).select("episode", "row", "label"), F.col("label"), L.FRAMES).groupBy("episode", "rule").agg(F.count(F.lit(1)).alias("frames"))


@query("lb21_held_finger_width", "LB21", "FN-G2", sql=with_(FRAMES, islands("frames", "CASE WHEN closed THEN 1 END", name="hd") + """,
w AS (SELECT *, opening * 0.1::DOUBLE AS width, 0.02::DOUBLE + (row % 3) * 0.005::DOUBLE AS contact FROM hd_g),
n AS (SELECT *, CASE WHEN closed THEN least(width, min(width) OVER (PARTITION BY episode, g, lab ORDER BY row) + 0.002, contact) ELSE width END AS held FROM w),
a AS (SELECT *, (asin((0.0254::DOUBLE - least(greatest(held, 0), 2*(0.0254::DOUBLE - 0.05*sin(0.554 - 0.4689*2.27)))/2) / 0.05) - 0.554) / -0.4689 AS angle FROM n)
SELECT episode, row, round(CASE WHEN closed THEN greatest(angle - 0.05, -0.0803) ELSE angle END, 5) + 0.0 AS angle FROM a"""))
def _(spark, d):
    from ..functions.gripper import LOWER, angle_of_width
    f = L.frames(spark, d).select("episode", "row", "closed", (F.col("opening") * 0.1).alias("width"))
    f = S.mark_runs(f, F.when(F.col("closed"), F.lit(1)), L.FRAMES).withColumn("run", F.coalesce("run", F.lit(-1)))
    f = running(f, L.FRAMES.within("run"), {"low": ("min", F.col("width"))})
    contact = 0.02 + (F.col("row") % 3) * 0.005
    held = F.when(F.col("closed"), F.least(F.col("width"), F.col("low") + 0.002, contact)).otherwise(F.col("width"))
    angle = angle_of_width(held)
    return f.select("episode", "row", r6(F.when(F.col("closed"), F.greatest(angle - 0.05, F.lit(LOWER))).otherwise(angle), 5).alias("angle"))


@query("ag24_track_end_motion", "AG24", "JN12", sql=with_(OBJECT_FRAMES, """
e AS (SELECT episode, object, max(row) AS last FROM object_frames WHERE valid GROUP BY ALL),
l AS (SELECT o.* FROM object_frames o JOIN e ON e.episode = o.episode AND e.object = o.object AND e.last = o.row),
f AS (SELECT o.episode, o.object, min(o.row) AS first FROM object_frames o JOIN l ON l.episode = o.episode AND l.object = o.object WHERE o.valid AND o.t >= l.t - 1.0 - 1e-9 AND o.t < l.t - 1e-9 GROUP BY ALL)
SELECT l.episode, l.object, l.row AS source_row, round(l.t - o.t, 6) AS window_d, round(sqrt(pow(l.px-o.px, 2) + pow(l.py-o.py, 2) + pow(l.pz-o.pz, 2))/(l.t - o.t), 5) AS speed,
  sqrt(pow(l.px-o.px, 2) + pow(l.py-o.py, 2) + pow(l.pz-o.pz, 2))/(l.t - o.t) < 0.05 AS at_rest
FROM l LEFT JOIN f ON f.episode = l.episode AND f.object = l.object LEFT JOIN object_frames o ON o.episode = f.episode AND o.object = f.object AND o.row = f.first"""))
def _(spark, d):
    from ..operators.physics import end_motion
    o = L.object_frames(spark, d).select("episode", "object", "row", "t", "valid", "px", "py", "pz")
    out = end_motion(o, "t", ["px", "py", "pz"], L.FRAMES.within("object"), window=1.0, still=0.05)
    return out.select("episode", "object", "source_row", r6("window").alias("window_d"), r6("speed", 5).alias("speed"), "at_rest")
