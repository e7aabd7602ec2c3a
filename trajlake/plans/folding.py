"""Queries with sequential rules: rate limits, movements, stages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as D
from ..operators import sequence as S
from ..operators.blocks import attach, running
from ..operators.lineage import cut
from ..sources import landing as L
from .registry import query, r6
from .sequences import islands
from .sqlbase import FRAMES, with_


def limiter(source: str, value: str, step: str, name: str, order: str = "row", sign: str = "+", first: str = "0") -> str:
    """SQL for one pass of a rate limiter, as a recursive table expression."""
    return f"""{name} AS (WITH RECURSIVE r AS (SELECT episode, {order}, {value} AS y FROM {source} WHERE {order} = {first}
  UNION ALL SELECT s.episode, s.{order}, least(greatest(s.{value}, r.y - s.{step}), r.y + s.{step}) FROM r JOIN {source} s ON s.episode = r.episode AND s.{order} = r.{order} {sign} 1) SELECT * FROM r)"""


@query("wn20_ramped_levels", "WN20", sql=with_(FRAMES, """
l AS (SELECT episode, row, CASE WHEN closed THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS level, coalesce((t - lag(t) OVER (PARTITION BY episode ORDER BY row))*0.7::DOUBLE, 0) AS step FROM frames),
""" + limiter("l", "level", "step", "f") + " SELECT episode, row, round(y, 6) + 0.0 AS level FROM f"))
def _(spark, d):
    from ..operators.blocks import shift
    f = shift(L.frames(spark, d).select("episode", "row", "t", "closed"), L.FRAMES, {"tp": (F.col("t"), -1)})
    f = cut(f.select("episode", "row", F.when(F.col("closed"), F.lit(0.0)).otherwise(F.lit(1.0)).alias("goal"), F.coalesce((F.col("t") - F.col("tp")) * 0.7, F.lit(0.0)).alias("step")))
    return D.limited(f, L.FRAMES, "goal", "step", "level").select("episode", "row", r6("level").alias("level"))


@query("wn19_rate_limited_path", "WN19", sql=with_(FRAMES, """
l AS (SELECT episode, row, max(row) OVER (PARTITION BY episode) - row AS back, opening AS x, coalesce((t - lag(t) OVER w)*0.05::DOUBLE, 0) AS i, coalesce((lead(t) OVER w - t)*0.05::DOUBLE, 0) AS o FROM frames WINDOW w AS (PARTITION BY episode ORDER BY row)),
""" + limiter("l", "x", "i", "f") + """,
l2 AS (SELECT l.episode, l.row, l.back, l.i, l.o, f.y AS x FROM l JOIN f USING (episode, row)),
""" + limiter("l2", "x", "o", "b", order="back") + """,
l3 AS (SELECT l2.episode, l2.row, l2.i, CASE WHEN l2.row = 0 THEN l2.x ELSE b.y END AS x FROM l2 JOIN b ON b.episode = l2.episode AND b.back = l2.back),
""" + limiter("l3", "x", "i", "g") + " SELECT episode, row, round(y, 6) + 0.0 AS path FROM g"))
def _(spark, d):
    f = cut(L.frames(spark, d).select("episode", "row", "t", "opening"))
    return D.rate_limit(f, L.FRAMES, "opening", "t", 0.05, "path").select("episode", "row", r6("path").alias("path"))


TH = D.Thresholds(speed=0.05, travel=0.02, join=1.2, min_duration=0.5, min_travel=0.05, turn_speed=0.6, turn_angle=90.0, lead=2.0, tail=0.5)
RATED = """
gr AS (SELECT *, CASE WHEN tp IS NULL THEN (q - opening)/(tn - t) WHEN tn IS NULL THEN (opening - p)/(t - tp) ELSE ((t-tp)*(t-tp)*q + ((tn-t)*(tn-t) - (t-tp)*(t-tp))*opening - (tn-t)*(tn-t)*p)/((t-tp)*(tn-t)*(tn-tp)) END AS raw
  FROM (SELECT *, lag(t) OVER w AS tp, lead(t) OVER w AS tn, lag(opening) OVER w AS p, lead(opening) OVER w AS q, max(row) OVER (PARTITION BY episode) AS last FROM frames WINDOW w AS (PARTITION BY episode ORDER BY row))),
tap AS (SELECT episode, row, last, unnest([-1, 0, 1]) AS j FROM gr),
rt AS (SELECT a.episode, a.row, avg(b.raw) AS rate FROM tap a JOIN gr b ON b.episode = a.episode AND b.row = least(greatest(a.row + a.j, 0), a.last) GROUP BY ALL),
sp AS (SELECT f.episode, f.row, f.t, f.opening, rt.rate FROM frames f JOIN rt USING (episode, row)),
"""


def moving(spark, d):
    f = attach(L.frames(spark, d).select("episode", "row", "t", "opening"), ["episode"], {"last_row": F.max("row")})
    f = cut(f.withColumns({"behind": F.lit(1), "ahead": F.lit(1)}))
    moves, rated = D.scalar_movements(f, "opening", "t", L.FRAMES, TH)
    return cut(moves), cut(rated)


MOVED = RATED + islands("sp", "CASE WHEN abs(rate) > 0.05 THEN 1 END", "min(t) AS t0, max(t) AS t1", name="mv") + """,
jo AS (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY episode ORDER BY start) < 1.2 THEN 0 ELSE 1 END AS opens FROM mv), jg AS (SELECT *, sum(opens) OVER (PARTITION BY episode ORDER BY start) AS g FROM jo),
mg AS (SELECT episode, min(start) AS start, max(stop) AS stop, min(t0) AS t0, max(t1) AS t1 FROM jg GROUP BY episode, g),
en AS (SELECT m.*, max(f.opening) - min(f.opening) AS reach, abs(arg_max(f.opening, f.row) - arg_min(f.opening, f.row)) AS net FROM mg m JOIN frames f ON f.episode = m.episode AND f.row >= m.start AND f.row < m.stop GROUP BY ALL),
moved AS MATERIALIZED (SELECT episode, start, stop, t0, t1 FROM en WHERE (t1 - t0 >= 0.5 OR net >= 0.05) AND reach >= 0.02)"""


@query("lb08_scalar_movements", "LB8", "WN8", "WN10", "WN11", sql=with_(FRAMES, MOVED + " SELECT episode, start, stop FROM moved"))
def _(spark, d):
    return moving(spark, d)[0].select("episode", "start", "stop")


@query("wn17_turn_split_movements", "WN17", "LB8", sql=with_(FRAMES, MOVED + """,
cm AS (SELECT episode, row, t, rate, abs(rate) AS s, lag(abs(rate)) OVER w AS sp, lead(abs(rate)) OVER w AS sn, sum(rate) OVER (PARTITION BY episode ORDER BY row ROWS UNBOUNDED PRECEDING) AS c FROM sp WINDOW w AS (PARTITION BY episode ORDER BY row)),
mr AS (SELECT m.*, f.row AS k, f.t AS tk, f.s, f.sp, f.sn, max(f.s) OVER (PARTITION BY m.episode, m.start) AS peak FROM moved m JOIN cm f ON f.episode = m.episode AND f.row >= m.start AND f.row < m.stop),
cd AS (SELECT episode, start AS a, stop AS b, t1, k, tk, greatest(start, k - 2) AS m0, least(stop, k + 3) AS n1, row_number() OVER (PARTITION BY episode, start ORDER BY k) AS n FROM mr WHERE k > start AND k < stop - 1 AND s <= sp AND s <= sn AND s < 0.6 * peak),
cq AS (SELECT d.*, coalesce(h.c, 0) AS here, coalesce(m.c, 0) AS back, p.c - o.c AS aft FROM cd d LEFT JOIN cm h ON h.episode = d.episode AND h.row = d.k - 1 LEFT JOIN cm m ON m.episode = d.episode AND m.row = d.m0 - 1
  JOIN cm o ON o.episode = d.episode AND o.row = d.k JOIN cm p ON p.episode = d.episode AND p.row = d.n1 - 1),
st AS (WITH RECURSIVE r AS (SELECT episode, start AS a, 0::BIGINT AS n, start AS pos, t0 AS since, NULL::DOUBLE AS base, []::BIGINT[] AS cuts FROM moved
  UNION ALL SELECT episode, a, n, CASE WHEN ok THEN k ELSE pos END, CASE WHEN ok THEN tk ELSE since END, CASE WHEN ok THEN here ELSE base END, CASE WHEN ok THEN list_append(cuts, k) ELSE cuts END
  FROM (SELECT *, k > org AND n1 > k + 1 AND abs(v) >= 1e-9*(k - org) AND abs(aft) >= 1e-9*(n1 - k - 1) AND v*aft < 0 AND tk - since >= 0.5 AND t1 - tk >= 0.5 AS ok
    FROM (SELECT *, CASE WHEN late THEN pos ELSE m0 END AS org, here - CASE WHEN late THEN base ELSE back END AS v
      FROM (SELECT x.episode, x.a, x.n, x.k, x.tk, x.m0, x.n1, x.t1, x.here, x.back, x.aft, r.pos, r.since, r.base, r.cuts, r.base IS NOT NULL AND r.pos > x.m0 AS late FROM r JOIN cq x ON x.episode = r.episode AND x.a = r.a AND x.n = r.n + 1)))) SELECT * FROM r),
ct AS (SELECT episode, a, arg_max(cuts, n) AS cuts FROM st GROUP BY episode, a),
pc AS (SELECT m.episode, m.stop, unnest(list_concat([m.start], cuts)) AS start, unnest(list_concat(cuts, [m.stop])) AS until FROM moved m JOIN ct ON ct.episode = m.episode AND ct.a = m.start)
SELECT episode, start, until AS stop FROM pc"""))
def _(spark, d):
    moves, rated = moving(spark, d)
    return D.split_turns(moves, rated.withColumn("window", F.lit(2)), ["rate"], "t", "window", L.FRAMES, TH)


STAGED = """ls AS (SELECT episode, max(row) AS last FROM frames GROUP BY episode),
ev AS (SELECT e.*, a.t AS ta, b.t AS tb, ls.last FROM (EVENTS) e JOIN ls USING (episode)
  JOIN frames a ON a.episode = e.episode AND a.row = e.start JOIN frames b ON b.episode = e.episode AND b.row = least(e.stop - 1, ls.last)),
nr AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY start, stop, part) AS n FROM (SELECT e.episode, e.part, e.start, e.stop, e.tb, list(struct_pack(row := f.row, t := f.t, activity := ACTIVITY) ORDER BY f.row) AS near
  FROM ev e JOIN sp f ON f.episode = e.episode AND f.t BETWEEN e.ta - 2.0 AND e.ta GROUP BY ALL)),
st AS (WITH RECURSIVE r AS (SELECT episode, last, 0::BIGINT AS n, [0]::BIGINT[] AS cuts, []::STRUCT(part VARCHAR, stop BIGINT, tb DOUBLE)[] AS moved_ FROM ls
  UNION ALL SELECT episode, last, n, CASE WHEN again THEN list_append(cuts, cut.row) ELSE cuts END,
    list_append(CASE WHEN again THEN list_filter(others, lambda u: u.stop > cut.row AND u.tb - cut.t > 0.5) ELSE others END, struct_pack(part := part, stop := stop, tb := tb))
  FROM (SELECT *, list_last(list_filter(rows_, lambda x: x.activity <= lo + 0.2*(hi - lo) + 1e-9)) AS cut
    FROM (SELECT *, list_min(list_transform(rows_, lambda x: x.activity)) AS lo, list_max(list_transform(rows_, lambda x: x.activity)) AS hi
      FROM (SELECT *, list_filter(near, lambda x: x.row >= low AND x.row <= start) AS rows_
        FROM (SELECT *, len(mine) > 0 AND start > cuts[-1] AS again, least(greatest(coalesce(mine[1].stop, 0) - 1, cuts[-1] + 1), start) AS low
          FROM (SELECT x.*, r.last, r.cuts, list_filter(r.moved_, lambda u: u.part = x.part) AS mine, list_filter(r.moved_, lambda u: u.part <> x.part) AS others FROM r JOIN nr x ON x.episode = r.episode AND x.n = r.n + 1)))))) SELECT * FROM r),
bd AS (SELECT episode, list_sort(list_distinct(list_append(arg_max(cuts, n), any_value(last)))) AS b FROM st GROUP BY episode)
SELECT episode, i - 1 AS stage, b[i] AS start, b[i + 1] AS stop FROM (SELECT episode, b, unnest(range(1, len(b))) AS i FROM bd)"""


def staged_sql(events: str, activity: str) -> str:
    """SQL for stage cuts over ``events`` (episode, part, start, stop) and the activity of the rows of ``sp``."""
    return STAGED.replace("EVENTS", events).replace("ACTIVITY", activity)


@query("wn18_lb09_stages", "WN18", "LB9", "JN15", sql=with_(FRAMES, MOVED + "," + islands("frames", "CASE WHEN closed THEN 1 END", name="hr") + "," + staged_sql(
    "SELECT episode, 'opening' AS part, start, stop FROM moved UNION ALL SELECT episode, 'hand', start, stop FROM hr", "abs(f.rate)/0.5::DOUBLE")))
def _(spark, d):
    """Stages of every episode: movements of the opening, and closed runs as a second part."""
    moves, rated = moving(spark, d)
    closed = S.runs(L.frames(spark, d).select("episode", "row", "closed"), F.when(F.col("closed"), F.lit(1)), L.FRAMES)
    events = moves.select("episode", F.lit("opening").alias("part"), "start", "stop").unionByName(closed.select("episode", F.lit("hand").alias("part"), "start", "stop"))
    activity = rated.select("episode", "row", "t", (F.abs("rate") / 0.5).alias("activity"))
    return D.stage_cuts(events, activity, "t", L.FRAMES, TH)


@query("lb23_one_action", "LB23", "WN24", "WN19", sql=with_(FRAMES, islands("frames", "CASE WHEN opening > 0.05 THEN 1 END", "min(t) AS t0, max(t) AS t1") + """,
mc AS (SELECT episode, CAST(sum(n) AS BIGINT) AS n FROM (SELECT episode, CASE WHEN lag(t1) OVER v IS NULL OR t0 - lag(t1) OVER v > 1.5 THEN 1 ELSE 0 END AS n FROM runs WINDOW v AS (PARTITION BY episode ORDER BY start)) GROUP BY episode),
en AS (SELECT episode, arg_min(opening, row) AS v0, arg_max(opening, row) AS v1, min(t) AS t0, max(t) AS t1 FROM frames GROUP BY episode),
u AS (SELECT f.*, v0, v1, coalesce(n, 0) AS n, least(greatest((t - e.t0)/(e.t1 - e.t0), 0), 1) AS u FROM frames f JOIN en e USING (episode) LEFT JOIN mc USING (episode)),
l AS (SELECT episode, row, max(row) OVER (PARTITION BY episode) - row AS back, CASE WHEN n > 4 THEN v0 + (v1 - v0)*(u*u*u*(10 - 15*u + 6*u*u)) ELSE opening END AS x, coalesce((t - lag(t) OVER w)*0.1::DOUBLE, 0) AS i, coalesce((lead(t) OVER w - t)*0.1::DOUBLE, 0) AS o FROM u WINDOW w AS (PARTITION BY episode ORDER BY row)),
""" + limiter("l", "x", "i", "f") + """,
l2 AS (SELECT l.episode, l.row, l.back, l.i, l.o, f.y AS x FROM l JOIN f USING (episode, row)),
""" + limiter("l2", "x", "o", "b", order="back") + """,
l3 AS (SELECT l2.episode, l2.row, l2.i, CASE WHEN l2.row = 0 THEN l2.x ELSE b.y END AS x FROM l2 JOIN b ON b.episode = l2.episode AND b.back = l2.back),
""" + limiter("l3", "x", "i", "g") + " SELECT episode, row, round(y, 6) + 0.0 AS path FROM g"))
def _(spark, d):
    f = cut(L.frames(spark, d).select("episode", "row", "t", "opening"))
    found = S.runs(f, F.when(F.col("opening") > 0.05, F.lit(1)), L.FRAMES, {"t0": F.min("t"), "t1": F.max("t")})
    found = running(found, L.FRAMES.by("start"), {"before": ("max", F.col("t1"))}, exclusive=True)
    n = found.groupBy("episode").agg(F.count_if(F.col("before").isNull() | (F.col("t0") - F.col("before") > 1.5)).alias("n"))
    n = n.select("episode", F.when(F.col("n") > 4, 2).otherwise(1).alias("movements"))
    return D.one_action(f, L.FRAMES, "opening", "t", n, 0.1, "path").select("episode", "row", r6("path").alias("path"))
