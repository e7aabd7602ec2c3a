"""Queries on hand-path corrections around grasps."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths as T
from ..operators import sequence as S
from ..operators.blocks import Axis
from ..operators.lineage import cut
from ..sources import landing as L
from . import sqlkit as K
from .labelling import PAIRS, pairs
from .registry import query, r6
from .sequences import islands
from .sqlbase import FRAMES, OBJECT_FRAMES, with_

#: The frames of every object of an episode.
OBJECT_ROWS = Axis(("episode", "object"), L.FRAMES.order, L.FRAMES.span)
HELD = islands("frames", "CASE WHEN closed THEN 1 END", "min(t) AS t0, max(t) AS t1", name="hd")


@query("lb16_release_rows", "LB16", sql=with_(FRAMES, HELD + """,
e AS (SELECT h.episode, h.stop, f.opening + 0.02::DOUBLE AS need FROM hd h JOIN frames f ON f.episode = h.episode AND f.row = h.stop)
SELECT e.episode, e.stop, min(f.row) - 1 AS release FROM e JOIN frames f ON f.episode = e.episode AND f.row >= e.stop AND f.opening > e.need GROUP BY e.episode, e.stop"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "closed", "opening")
    return T.release_rows(f, F.col("closed"), "opening", 0.02, L.FRAMES)


@query("lb15_offset_track", "LB15", sql=with_(FRAMES, HELD + """,
sg AS (SELECT episode, t0, (start % 5)*0.3::DOUBLE AS off, start, lag(t1) OVER v AS pt1, lag((start % 5)*0.3::DOUBLE) OVER v AS poff FROM hd WINDOW v AS (PARTITION BY episode ORDER BY start)),
tr AS (SELECT episode, CASE WHEN t0 - 0.2 <= pt1 + 0.1 THEN pt1 ELSE pt1 + 0.1 END AS lo, CASE WHEN t0 - 0.2 <= pt1 + 0.1 THEN t0 ELSE t0 - 0.2 END AS hi, poff, off FROM sg WHERE pt1 IS NOT NULL),
fi AS (SELECT episode, arg_min(off, start) AS first FROM sg GROUP BY episode),
h AS (SELECT f.episode, f.row, f.t, r.lo, r.hi, r.poff, r.off, fi.first FROM frames f JOIN fi USING (episode) ASOF LEFT JOIN tr r ON f.episode = r.episode AND f.t > r.lo)
SELECT episode, row, round(coalesce(poff + least(greatest((t - lo)/greatest(hi - lo, 1e-9), 0), 1)*(off - poff), first), 6) + 0.0 AS "offset" FROM h"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t", "closed")
    seg = S.runs(f, F.when(F.col("closed"), F.lit(1)), L.FRAMES, {"t0": F.min("t"), "t1": F.max("t")}).withColumn("offset", (F.col("start") % 5) * 0.3)
    out = T.offset_track(f.select("episode", "row", "t"), seg, "t", L.FRAMES, L.CLOCK, approach=0.2, retreat=0.1)
    return out.select("episode", "row", r6("offset").alias("offset"))


@query("lb14_straight_approach", "LB14", sql=with_(FRAMES, islands("frames", "CASE WHEN closed THEN 1 END", name="sg") + """,
nx AS (SELECT *, first_value(CASE WHEN lab IS NOT NULL AND prev_lab IS NULL THEN row END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM sg_g),
fr AS (SELECT n.*, a.x AS ax, a.y AS ay, least(greatest((n.z - a.z - 0.01)/0.03, 0), 1) AS s FROM nx n LEFT JOIN frames a ON a.episode = n.episode AND a.row = n.nxt WHERE n.lab IS NULL),
aw AS (SELECT episode, nxt, max(CASE WHEN s >= 1 THEN row END) AS away FROM fr WHERE nxt IS NOT NULL GROUP BY ALL),
k AS (SELECT f.*, CASE WHEN a.away IS NOT NULL AND f.row > a.away THEN f.s ELSE 1 END AS k FROM fr f LEFT JOIN aw a USING (episode, nxt))
SELECT f.episode, f.row, round(CASE WHEN k.k < 1 THEN k.ax + k.k*(f.x - k.ax) ELSE f.x END, 6) + 0.0 AS ox, round(CASE WHEN k.k < 1 THEN k.ay + k.k*(f.y - k.ay) ELSE f.y END, 6) + 0.0 AS oy FROM frames f LEFT JOIN k USING (episode, row)"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "closed", "x", "y", "z")
    return T.straight_approach(f, F.col("closed"), L.FRAMES, height=0.01, blend=0.03).select("episode", "row", r6("ox").alias("ox"), r6("oy").alias("oy"))


@query("lb17_approach_width", "LB17", "FN-G10", sql=with_(OBJECT_FRAMES, PAIRS + """,
lb AS (SELECT episode, row, CASE WHEN closed THEN CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'purchase' END END AS l FROM frames),
np AS (SELECT *, first_value(l IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx, last_value(l IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv FROM lb),
nd AS (SELECT n.episode, n.row, max(p.extent + 2*abs(-sin(p.yaw)*(p.px - p.x) + cos(p.yaw)*(p.py - p.y)) + 2*0.008) AS width FROM np n JOIN pairs p ON p.episode = n.episode AND p.row = n.row AND p.object IN (n.nx, n.pv) WHERE n.l IS NULL AND p.dist <= 0.12 GROUP BY ALL)
SELECT f.episode, f.row, round(width, 6) AS width FROM frames f LEFT JOIN nd USING (episode, row)"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", F.when(F.col("closed"), F.when(F.col("event_id") % 2 == 0, "click").otherwise("purchase")).alias("label"))
    p = pairs(spark, d)
    off = F.abs(-F.sin("yaw") * (F.col("px") - F.col("x")) + F.cos("yaw") * (F.col("py") - F.col("y")))
    p = p.select("episode", "object", "row", "dist", "extent", off.alias("off"))
    return T.approach_width(cut(f), p, F.col("label"), L.FRAMES, near=0.12, clearance=0.008).select("episode", "row", r6("width").alias("width"))


def _still(near: str) -> str:
    gap = " + ".join(f"({near}({c}) OVER v - {c})*({near}({c}) OVER v - {c})" for c in ("px", "py", "pz"))
    return f"coalesce(NOT (valid AND {near}(valid) OVER v) OR sqrt({gap}) / nullif(abs({near}(t) OVER v - t), 0) < 0.2, true)"


@query("lb18_placed_drops", "LB18", sql=with_(OBJECT_FRAMES, HELD + f""",
o AS (SELECT episode, object, row, t, closed, valid, px, py, pz, px - x AS rx, py - y AS ry, row / 40.0::DOUBLE AS angle, {_still("lag")} AND {_still("lead")} AS still
   FROM object_frames WINDOW v AS (PARTITION BY episode, object ORDER BY row)),
sg AS (SELECT episode, stop, lead(start) OVER (PARTITION BY episode ORDER BY start) AS until FROM hd),
ls AS (SELECT o.episode, o.object, s.stop, s.until, o.t AS lo, o.t + 2.0 + 1e-9 AS hi, o.rx AS rx0, o.ry AS ry0, o.angle AS angle0 FROM sg s JOIN o ON o.episode = s.episode AND o.row = s.stop - 1),
rw AS (SELECT o.*, l.stop, sqrt((rx - rx0)*(rx - rx0) + (ry - ry0)*(ry - ry0)) AS fallen, abs(angle - angle0) AS turn, min(CASE WHEN NOT valid THEN row END) OVER (PARTITION BY l.episode, l.object, l.stop) AS bad
   FROM ls l JOIN o ON o.episode = l.episode AND o.object = l.object AND o.row >= l.stop AND o.t BETWEEN l.lo AND l.hi AND o.closed IS NOT TRUE AND (l.until IS NULL OR o.row < l.until)),
ok AS (SELECT * FROM rw WHERE bad IS NULL OR row < bad),
z AS (SELECT * FROM ok WHERE fallen > 0.02 AND still QUALIFY row_number() OVER (PARTITION BY episode, object, stop ORDER BY row) = 1),
e AS (SELECT k.episode, k.object, k.stop, k.row, k.turn, z.fallen AS "drop" FROM ok k JOIN z ON z.episode = k.episode AND z.object = k.object AND z.stop = k.stop AND k.row <= z.row
   WHERE sqrt((k.px - z.px)*(k.px - z.px) + (k.py - z.py)*(k.py - z.py) + (k.pz - z.pz)*(k.pz - z.pz)) <= 0.02 AND abs(k.angle - z.angle) <= 0.1
   QUALIFY row_number() OVER (PARTITION BY k.episode, k.object, k.stop ORDER BY k.row) = 1)
SELECT episode, object, stop, row + 1 AS new_stop, round("drop", 6) + 0.0 AS "drop", round(turn, 6) + 0.0 AS turn FROM e WHERE "drop" <= 0.4 AND turn <= 0.35"""))
def _(spark, d):
    axis = L.frame_axis(spark, d)
    o = L.object_frames(spark, d, axis=axis)
    o = cut(o.select("episode", "object", "row", "t", "closed", "valid", "px", "py", "pz", (F.col("px") - F.col("x")).alias("rx"), (F.col("py") - F.col("y")).alias("ry"), (F.col("row") / 40.0).alias("angle")))
    out = T.placed_drops(o, F.col("closed"), "t", axis.within("object"), place=["px", "py", "pz"], inside=["rx", "ry"], turn="angle", span=1.0, longest=2.0, min_drop=0.02, max_drop=0.4,
                         max_turn=0.35, rest_speed=0.2, rest_turn=0.1)
    return out.select("episode", "object", "stop", "new_stop", r6("drop").alias("drop"), r6("turn").alias("turn"))


@query("lb13_object_centric_path", "LB13", "FN-R7", "FN-R14")
def _(spark, d):
    p = L.poses(spark, d)
    p = cut(p.select("episode", "row", (F.col("row") * 0.1).alias("t"), *[f"{s}{c}" for s in "ab" for c in ("x", "y", "z", *K.Q)]))
    out = T.object_centric(p, "a", "b", F.col("row") % 9 < 4, "t", L.FRAMES, L.CLOCK, settle=2, max_shift=0.005, max_turn=0.05, approach=0.25, retreat=0.15)
    return out.select("episode", "row", "carried", *[r6(f"out_{c}").alias(f"out_{c}") for c in ("x", "y", "z", *K.Q)])
