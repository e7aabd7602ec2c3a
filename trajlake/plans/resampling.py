"""Time scaling and resampling queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planar
from ..functions.vectors import Sheet, cols
from ..operators import resample as Z
from ..operators.lineage import cut
from ..operators.sequence import median_step
from ..sources import landing as L
from . import sqlkit as K
from .registry import query, r6
from .sequences import STEP, islands
from .sqlbase import FRAMES, POSES, with_

STEP_DAYS = 0.5
LIMITS = {"bx": 4.0, "by": 4.0, "yaw": 40.0}
SLIDE = 2.0


def slowed(spark, d, axis=L.FRAMES):
    """Source intervals of every episode with their slow-down."""
    f = cut(L.frames(spark, d, axis).select("episode", "row", "t", "x", "y", "yaw", "opening", "closed", "label"))
    iv = Z.intervals(f, "t", ["x", "y", "yaw", "opening", "label", "closed"], axis)
    bx, by = planar.to_body(F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y"), (F.col("yaw") + F.col("next_yaw")) / 2.0)
    moved = [(bx, LIMITS["bx"]), (by, LIMITS["by"]), (F.col("next_yaw") - F.col("yaw"), LIMITS["yaw"])]
    return f, Z.required_slowdown(iv, moved, [(F.col("next_opening") - F.col("opening"), SLIDE)])


SLOWED = f"""
iv AS (SELECT *, lead(t) OVER w AS nt, lead(t) OVER w - t AS dt, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, (yaw + lead(yaw) OVER w)/2 AS mid,
         lead(yaw) OVER w - yaw AS dyaw, lead(opening) OVER w AS nopening, lead(label) OVER w AS nlabel, lead(closed) OVER w AS nclosed
       FROM frames WINDOW w AS (PARTITION BY episode ORDER BY row) QUALIFY lead(row) OVER w IS NOT NULL),
req AS (SELECT *, greatest(1, greatest(abs(cos(mid)*dx + sin(mid)*dy)/({LIMITS["bx"]}*0.95::DOUBLE), abs(cos(mid)*dy - sin(mid)*dx)/({LIMITS["by"]}*0.95::DOUBLE),
         abs(dyaw)/({LIMITS["yaw"]}*0.95::DOUBLE), abs(nopening - opening)/{SLIDE}::DOUBLE)/dt) AS required FROM iv)"""


@query("rs01_required_slowdown", "RS1", sql=with_(FRAMES, SLOWED + " SELECT episode, row, round(required, 4) AS required FROM req"))
def _(spark, d):
    return slowed(spark, d)[1].select("episode", "row", r6("required", 4).alias("required"))


DILATED = SLOWED + "," + STEP + """,
wid AS (SELECT episode, CAST(greatest(1, round(1.0::DOUBLE / med)) AS BIGINT) AS k FROM med),
smooth AS (SELECT a.episode, a.row, max(b.required) AS m FROM req a JOIN wid USING (episode) JOIN req b ON b.episode = a.episode AND b.row BETWEEN a.row - k AND a.row + k GROUP BY ALL),
""" + islands("frames", "CASE WHEN closed THEN 1 END", name="held") + """,
dwell AS (SELECT DISTINCT episode, row FROM (SELECT episode, start - 1 AS row FROM held WHERE start > 0 UNION ALL SELECT episode, stop FROM held)),
dil AS (SELECT r.*, CASE WHEN w.row IS NULL THEN s.m ELSE greatest(s.m, 0.6::DOUBLE / r.dt) END AS dilation FROM req r JOIN smooth s USING (episode, row) LEFT JOIN dwell w USING (episode, row)),
warp AS (SELECT *, sum(dt*dilation) OVER (PARTITION BY episode ORDER BY row) AS warp1, sum(dt*dilation) OVER (PARTITION BY episode ORDER BY row) - dt*dilation AS warp0 FROM dil)"""


def dilated(spark, d, axis=L.FRAMES):
    f, iv = slowed(spark, d, axis)
    med = median_step(f.select("episode", "row", "t"), "t", axis, span=0.25)
    half = F.greatest(F.round(1.0 / F.col("median_dt")), F.lit(1)).cast("long")
    iv = iv.join(med.select("episode", half.alias("half")), "episode")
    return Z.dilate(iv, "half", Z.grasp_dwell(f.select("episode", "row", "closed"), F.col("closed"), axis), 0.6, axis)


@query("rs02_dilation", "RS2", "WN7", "LB7", sql=with_(FRAMES, DILATED + " SELECT episode, row, round(dilation, 4) AS dilation FROM dil"))
def _(spark, d):
    return dilated(spark, d).select("episode", "row", r6("dilation", 4).alias("dilation"))


def resampled(spark, d, step: float = STEP_DAYS):
    """Output rows with both ends of their source interval. The slowed intervals are read by the running sum and by
    its carry, so they are written once before it."""
    axis = L.frame_axis(spark, d)
    return Z.clock(Z.warp(cut(dilated(spark, d, axis)), axis), "t", step)


TICKS = DILATED + f""",
ends AS (SELECT episode, max(warp1) AS warp_end FROM warp GROUP BY episode),
ticks AS (SELECT episode, k, least(k * {STEP_DAYS}::DOUBLE, warp_end) AS w FROM (SELECT episode, warp_end, unnest(range(0, CAST(ceil(warp_end / {STEP_DAYS} - 1e-9) AS BIGINT) + 1)) AS k FROM ends)),
hit AS (SELECT t.k, t.w, s.* FROM ticks t ASOF JOIN warp s ON t.episode = s.episode AND t.w >= s.warp0),
clk AS (SELECT *, greatest(least((w - warp0)/(warp1 - warp0), 1), 0) AS u FROM hit)"""


@query("rs03_output_clock", "RS3", "JN11", "WN14", "WN15", sql=with_(FRAMES, TICKS + f"""
SELECT episode, k, round(k * {STEP_DAYS}::DOUBLE, 6) AS time, row AS left_row, round(u, 5) AS fraction, round(t + u*dt, 5) AS source_time FROM clk"""))
def _(spark, d):
    o = resampled(spark, d)
    return o.select("episode", "k", r6("time").alias("time"), F.col("row").alias("left_row"), r6("fraction", 5).alias("fraction"), r6("source_time", 5).alias("source_time"))


@query("rs04_rs07_resampled_frames", "RS4", "RS6", "RS7", sql=with_(FRAMES, TICKS + """
SELECT episode, k, round(opening + u*(nopening - opening), 5) AS opening, (closed OR u >= 1) AND (nclosed OR u <= 0) AS valid,
       CASE WHEN u <= 0 THEN label WHEN u >= 1 THEN nlabel WHEN label = nlabel THEN label END AS label FROM clk"""))
def _(spark, d):
    o, u = resampled(spark, d), F.col("fraction")
    return o.select("episode", "k", r6(Z.linear(F.col("opening"), F.col("next_opening"), u), 5).alias("opening"),
                    Z.both_valid(F.col("closed"), F.col("next_closed"), u).alias("valid"), Z.agreed_label(F.col("label"), F.col("next_label"), u).alias("label"))


PART = ["x", "y", "z", *K.Q]
TRACK = f"""
iv AS (SELECT *, {K.lead([f"a{c}" for c in PART])}, row % 5 <> 2 AS ok, lead(row % 5 <> 2) OVER w AS n_ok, "bx" AS hinge, lead("bx") OVER w AS n_hinge FROM poses WINDOW w AS (PARTITION BY episode ORDER BY row)
       QUALIFY lead(row) OVER w IS NOT NULL),
ticks AS (SELECT *, unnest([0, 1, 2]) AS sub FROM iv), tk AS (SELECT *, sub / 3.0::DOUBLE AS u, row * 3 + sub AS k FROM ticks),
rel AS (SELECT *, {K.alias(K.mul(K.conj(K.q_of("a")), K.q_of("n_a")), K.q_of("r"))} FROM tk),
lg AS (SELECT *, {K.alias([f"u*{c}" for c in K.log(K.q_of("r"))], ["lx", "ly", "lz"])} FROM rel),
th AS (SELECT *, {K.length(["lx", "ly", "lz"])} AS th FROM lg), sc AS (SELECT *, CASE WHEN th < 1e-12 THEN 0.5 ELSE sin(th/2)/th END AS s FROM th),
mix AS (SELECT *, {K.alias(K.mul(K.q_of("a"), ["cos(th/2)", "lx*s", "ly*s", "lz*s"]), K.q_of("m"))} FROM sc),
val AS (SELECT *, (ok OR u >= 1) AND (n_ok OR u <= 0) AS valid FROM mix)"""


def _track(spark, d):
    p = L.poses(spark, d)
    p = p.select("episode", "row", *[f"a{c}" for c in PART], F.col("bx").alias("hinge"), (F.col("row") % 5 != 2).alias("ok"), F.col("row").cast("double").alias("t"))
    iv = Z.intervals(p, "t", [*(f"a{c}" for c in PART), "hinge", "ok"], L.FRAMES)
    ticks = iv.withColumn("sub", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    s = Sheet(ticks.withColumns({"u": F.col("sub") / 3.0, "k": F.col("row") * 3 + F.col("sub")}))
    q = Z.geodesic(s, "a", cols(*(f"a{c}" for c in K.Q)), cols(*(f"next_a{c}" for c in K.Q)), F.col("u"))
    at = [Z.linear(F.col(f"a{c}"), F.col(f"next_a{c}"), F.col("u")) for c in "xyz"]
    return s, at, q


@query("rs08_object_track", "RS8", "RS5", "RS6", sql=with_(POSES, TRACK + f"""
SELECT episode, k, valid, {K.alias([f'CASE WHEN valid THEN "a{c}" + u*(n_a{c} - "a{c}") END' for c in "xyz"], ["px", "py", "pz"], 6)},
       {K.alias([f"CASE WHEN valid THEN {e} END" for e in K.six(K.q_of("m"))], [f"c{i}" for i in range(6)], 6)} FROM val"""))
def _(spark, d):
    from ..functions import rotation
    s, at, q = _track(spark, d)
    ok = Z.both_valid(F.col("ok"), F.col("next_ok"), F.col("u"))
    return s.select("episode", "k", ok.alias("valid"), *[r6(F.when(ok, c)).alias(f"p{n}") for n, c in zip("xyz", at)],
                    *[r6(F.when(ok, c)).alias(f"c{i}") for i, c in enumerate(rotation.six(q))])


@query("rs09_scene_state", "RS9", sql=with_(POSES, TRACK + f"""
SELECT episode, k, round(hinge + u*(n_hinge - hinge), 6) + 0.0 AS hinge, {K.alias([f'"a{c}" + u*(n_a{c} - "a{c}")' for c in "xyz"], ["px", "py", "pz"], 6)},
       {K.alias(K.six(K.q_of("m")), [f"c{i}" for i in range(6)], 6)} FROM val"""))
def _(spark, d):
    from ..functions import rotation
    s, at, q = _track(spark, d)
    return s.select("episode", "k", r6(Z.linear(F.col("hinge"), F.col("next_hinge"), F.col("u"))).alias("hinge"),
                    *[r6(c).alias(f"p{n}") for n, c in zip("xyz", at)], *[r6(c).alias(f"c{i}") for i, c in enumerate(rotation.six(q))])


@query("rs10_servo_reference", "RS10", sql=with_(FRAMES, """
iv AS (SELECT episode, t, lead(t) OVER w - t AS dt, yaw, lead(yaw) OVER w AS nyaw, opening, lead(opening) OVER w AS nopening FROM frames WINDOW w AS (PARTITION BY episode ORDER BY row) QUALIFY lead(row) OVER w IS NOT NULL),
ends AS (SELECT episode, min(t) AS t0, max(t) AS t1 FROM frames GROUP BY episode),
k AS (SELECT episode, t0, t1, unnest(range(1, CAST(round((t1 - t0)/0.5) AS BIGINT) + 1)) AS k FROM ends),
pr AS (SELECT episode, k, unnest(['yaw', 'opening', 'now']) AS j, least(greatest(t0 + k*0.5::DOUBLE + unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.0::DOUBLE]), t0), t1) AS at FROM k),
hit AS (SELECT p.*, i.t, i.dt, i.yaw, i.nyaw, i.opening, i.nopening, (p.at - i.t)/i.dt AS u FROM pr p ASOF JOIN iv i ON p.episode = i.episode AND p.at >= i.t)
SELECT episode, k, round(max(CASE WHEN j = 'yaw' THEN yaw + u*(nyaw - yaw) END), 5) + 0.0 AS yaw, round(min(CASE WHEN j <> 'yaw' THEN opening + u*(nopening - opening) END), 5) + 0.0 AS opening
FROM hit GROUP BY episode, k"""))
def _(spark, d):
    axis = L.frame_axis(spark, d)
    f = L.frames(spark, d, axis, dealt=True)
    out = Z.servo_reference(f, "t", {"yaw": 0.2, "opening": 0.3}, ["opening"], 0.5, axis)
    return out.select("episode", "k", r6("yaw", 5).alias("yaw"), r6("opening", 5).alias("opening"))
