"""The flagship query: slow down and resample every demonstration, and judge its base speed."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planar
from ..functions.vectors import cols
from ..operators import resample as Z
from ..operators.blocks import shift
from ..operators.sequence import runs
from ..sources import landing as L
from .registry import query, r6
from .resampling import LIMITS, STEP_DAYS, TICKS, resampled
from .sequences import islands
from .sqlbase import FRAMES, with_


@query("flagship_verdicts", "RS3", "RS4", "LB7", "CM11", sql=with_(FRAMES, TICKS + f""",
o AS (SELECT episode, k, x + u*dx AS x, y + u*dy AS y, yaw + u*dyaw AS yaw, (closed OR u >= 1) AND (nclosed OR u <= 0) AS held FROM clk),
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(yaw) OVER w AS nyaw FROM o WINDOW w AS (PARTITION BY episode ORDER BY k)),
r AS (SELECT *, abs(cos(yaw)*(nx-x) + sin(yaw)*(ny-y))/{STEP_DAYS}/{LIMITS["bx"]} AS rx, abs(cos(yaw)*(ny-y) - sin(yaw)*(nx-x))/{STEP_DAYS}/{LIMITS["by"]} AS ry FROM n),
v AS (SELECT episode, count(*) AS rows, count(*) FILTER (WHERE held) AS held_rows, max(greatest(rx, ry)) AS worst, max(abs(opening_gap)) AS gap FROM (SELECT *, 0 AS opening_gap FROM r) GROUP BY episode),
""" + islands("frames", "label", name="lr") + """,
c AS (SELECT episode, count(*) AS segments FROM lr GROUP BY episode)
SELECT v.episode, v.rows, v.held_rows, coalesce(c.segments, 0) AS segments, round(worst, 4) AS worst_speed, worst <= 0.9 AND held_rows > 0 AS passed FROM v LEFT JOIN c USING (episode)"""))
def _(spark, d):
    o, u = resampled(spark, d), F.col("fraction")
    mid = lambda c: Z.linear(F.col(c), F.col(f"next_{c}"), u)
    o = o.select("episode", "k", mid("x").alias("x"), mid("y").alias("y"), mid("yaw").alias("yaw"), Z.both_valid(F.col("closed"), F.col("next_closed"), u).alias("held"))
    o = shift(o, L.FRAMES.by("k"), {f"n{c}": (F.col(c), 1) for c in ("x", "y", "yaw")})
    dx, dy, _ = planar.relative(cols("x", "y", "yaw"), cols("nx", "ny", "nyaw"))
    worst = F.max(F.greatest(F.abs(dx) / STEP_DAYS / LIMITS["bx"], F.abs(dy) / STEP_DAYS / LIMITS["by"]))
    v = o.groupBy("episode").agg(F.count(F.lit(1)).alias("rows"), F.count_if("held").alias("held_rows"), worst.alias("worst"))
    seg = runs(L.frames(spark, d).select("episode", "row", "label"), F.col("label"), L.FRAMES).groupBy("episode").agg(F.count(F.lit(1)).alias("segments"))
    return v.join(seg, "episode", "left").select("episode", "rows", "held_rows", F.coalesce("segments", F.lit(0)).alias("segments"), r6("worst", 4).alias("worst_speed"),
                                                 ((F.col("worst") <= 0.9) & (F.col("held_rows") > 0)).alias("passed"))
