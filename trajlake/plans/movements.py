"""Queries on the movements of the base and of the hands, and the stages of a whole body."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as D
from ..operators import sequence as S
from ..operators.blocks import Axis, attach
from ..operators.lineage import cut
from ..sources import landing as L
from .folding import MOVED, TH, moving, staged_sql
from .registry import query
from .sequences import WRAP, islands
from .sqlbase import FRAMES, POSES, with_

BASE = TH.__class__(lin=0.5, base_ang=4.0, join=1.2, min_duration=0.5, min_travel=0.3, turn_speed=0.6, lead=2.0, tail=0.5)
HAND = TH.__class__(lin=6.0, ang=6.0, join=0.15, min_duration=0.15, min_travel=0.5, turn_speed=0.7)


def _rated_sql(source: str, velocity: dict[str, str], turning: str, tag: str) -> str:
    """SQL: derivatives on an uneven clock, smoothed over three rows with the end rows repeated. ``turning``: the raw turning rate."""
    names = ", ".join(f"lag({e}) OVER w AS p_{n}, lead({e}) OVER w AS q_{n}, {e} AS c_{n}" for n, e in velocity.items())
    slope = lambda n: f"(CASE WHEN tp IS NULL THEN (q_{n} - c_{n})/(tn - t) WHEN tn IS NULL THEN (c_{n} - p_{n})/(t - tp) ELSE ((t-tp)*(t-tp)*q_{n} + ((tn-t)*(tn-t) - (t-tp)*(t-tp))*c_{n} - (tn-t)*(tn-t)*p_{n})/((t-tp)*(tn-t)*(tn-tp)) END)"
    return f"""{tag}_n AS (SELECT *, {names}, lag(t) OVER w AS tp, lead(t) OVER w AS tn, max(row) OVER (PARTITION BY episode) AS last FROM {source} WINDOW w AS (PARTITION BY episode ORDER BY row)),
{tag}_r AS (SELECT episode, row, last, {", ".join(f"{slope(n)} AS raw_{n}" for n in velocity)}, {turning.replace("SLOPE_W", slope("w") if "w" in velocity else "0")} AS raw_turn FROM {tag}_n),
{tag}_t AS (SELECT episode, row, last, unnest([-1, 0, 1]) AS j FROM {tag}_r),
{tag}_s AS (SELECT a.episode, a.row, {", ".join(f"avg(b.raw_{n}) AS v{n}" for n in velocity)}, avg(b.raw_turn) AS turn FROM {tag}_t a JOIN {tag}_r b ON b.episode = a.episode AND b.row = least(greatest(a.row + a.j, 0), a.last) GROUP BY a.episode, a.row),
{tag} AS (SELECT f.*, {", ".join(f"s.v{n}" for n in velocity)}, s.turn FROM {source} f JOIN {tag}_s s USING (episode, row))"""


def _moved_sql(rated: str, moving: str, travel: str, th: D.Thresholds, tag: str) -> str:
    """SQL: runs of ``moving`` joined over pauses that last or travel (``travel`` between rows a and b) far enough."""
    return islands(rated, f"CASE WHEN {moving} THEN 1 END", "min(t) AS t0, max(t) AS t1", name=f"{tag}_u") + f""",
{tag}_j AS (SELECT *, sum(opens) OVER (PARTITION BY episode ORDER BY start) AS grp FROM (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY episode ORDER BY start) < {th.join} THEN 0 ELSE 1 END AS opens FROM {tag}_u)),
{tag}_m AS (SELECT episode, min(start) AS start, max(stop) AS stop, min(t0) AS t0, max(t1) AS t1 FROM {tag}_j GROUP BY episode, grp),
{tag} AS (SELECT m.* FROM {tag}_m m JOIN {rated} a ON a.episode = m.episode AND a.row = m.start JOIN {rated} b ON b.episode = m.episode AND b.row = m.stop - 1 WHERE m.t1 - m.t0 >= {th.min_duration} OR {travel} >= {th.min_travel})"""


def _split_sql(rated: str, moved: str, velocity: list[str], th: D.Thresholds, tag: str) -> str:
    """SQL: movements split at speed minima where the mean velocities of two rows before and after turn more than a right angle apart."""
    size = lambda e: f"sqrt({' + '.join(f'{e(v)}*{e(v)}' for v in velocity)})"
    dot = lambda a, b: "(" + " + ".join(f"{a(v)}*{b(v)}" for v in velocity) + ")"
    each = lambda f: ", ".join(f(v) for v in velocity)
    way, aft = (lambda v: f"w_{v}"), (lambda v: f"f_{v}")
    return f"""{tag}_c AS (SELECT *, lag(s) OVER w AS sp, lead(s) OVER w AS sn, {each(lambda v: f"sum({v}) OVER (PARTITION BY episode ORDER BY row ROWS UNBOUNDED PRECEDING) AS c_{v}")} FROM (SELECT *, {size(lambda v: v)} AS s FROM {rated}) WINDOW w AS (PARTITION BY episode ORDER BY row)),
{tag}_r AS (SELECT m.*, f.row AS k, f.t AS tk, f.s, f.sp, f.sn, max(f.s) OVER (PARTITION BY m.episode, m.start) AS peak FROM {moved} m JOIN {tag}_c f ON f.episode = m.episode AND f.row >= m.start AND f.row < m.stop),
{tag}_d AS (SELECT episode, start AS a, t1, k, tk, greatest(start, k - 2) AS m0, least(stop, k + 3) AS n1, row_number() OVER (PARTITION BY episode, start ORDER BY k) AS n FROM {tag}_r WHERE k > start AND k < stop - 1 AND s <= sp AND s <= sn AND s < {th.turn_speed} * peak),
{tag}_q AS (SELECT d.*, {each(lambda v: f"coalesce(h.c_{v}, 0) AS h_{v}, coalesce(m.c_{v}, 0) AS b_{v}, p.c_{v} - o.c_{v} AS f_{v}")} FROM {tag}_d d LEFT JOIN {tag}_c h ON h.episode = d.episode AND h.row = d.k - 1 LEFT JOIN {tag}_c m ON m.episode = d.episode AND m.row = d.m0 - 1
  JOIN {tag}_c o ON o.episode = d.episode AND o.row = d.k JOIN {tag}_c p ON p.episode = d.episode AND p.row = d.n1 - 1),
{tag}_s AS (WITH RECURSIVE r AS (SELECT episode, start AS a, 0::BIGINT AS n, start AS pos, t0 AS since, {each(lambda v: f"NULL::DOUBLE AS l_{v}")}, false AS turned, []::BIGINT[] AS cuts FROM {moved}
  UNION ALL SELECT episode, a, n, CASE WHEN ok THEN k ELSE pos END, CASE WHEN ok THEN tk ELSE since END, {each(lambda v: f"CASE WHEN ok THEN h_{v} ELSE l_{v} END")}, turned OR ok, CASE WHEN ok THEN list_append(cuts, k) ELSE cuts END
  FROM (SELECT *, k > org AND n1 > k + 1 AND {size(way)} >= 1e-9*(k - org) AND {size(aft)} >= 1e-9*(n1 - k - 1) AND {dot(way, aft)} < cos(radians({th.turn_angle})) * {size(way)} * {size(aft)} AND tk - since >= {th.min_duration} AND t1 - tk >= {th.min_duration} AS ok
    FROM (SELECT *, CASE WHEN late THEN pos ELSE m0 END AS org, {each(lambda v: f"h_{v} - CASE WHEN late THEN l_{v} ELSE b_{v} END AS w_{v}")}
      FROM (SELECT x.*, r.pos, r.since, {each(lambda v: f"r.l_{v}")}, r.turned, r.cuts, r.turned AND r.pos > x.m0 AS late FROM r JOIN {tag}_q x ON x.episode = r.episode AND x.a = r.a AND x.n = r.n + 1)))) SELECT * FROM r),
{tag}_k AS (SELECT episode, a, arg_max(cuts, n) AS cuts FROM {tag}_s GROUP BY episode, a),
{tag} AS MATERIALIZED (SELECT m.episode, unnest(list_concat([m.start], cuts)) AS start, unnest(list_concat(cuts, [m.stop])) AS stop FROM {moved} m JOIN {tag}_k k ON k.episode = m.episode AND k.a = m.start)"""


UNWRAPPED = f"""
stp AS (SELECT episode, row, t, x, y, yaw - lag(yaw) OVER w AS d, yaw FROM frames WINDOW w AS (PARTITION BY episode ORDER BY row)),
uw AS (SELECT episode, row, t, x, y, sum(coalesce({WRAP.format("d")}, yaw)) OVER (PARTITION BY episode ORDER BY row ROWS UNBOUNDED PRECEDING) AS w FROM stp)"""
BASE_SQL = UNWRAPPED + "," + _rated_sql("uw", {"x": "x", "y": "y", "w": "w"}, "abs(SLOPE_W)", "br") + "," + _moved_sql(
    "br", f"sqrt(vx*vx + vy*vy) > {BASE.lin} OR turn > {BASE.base_ang}", "greatest(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), abs(b.w - a.w))", BASE, "bm") + "," + _split_sql("br", "bm", ["vx", "vy"], BASE, "bs")


def _base(spark, d):
    f = attach(L.frames(spark, d).select("episode", "row", "t", "x", "y", "yaw"), ["episode"], {"last_row": F.max("row")}).withColumns({"behind": F.lit(1), "ahead": F.lit(1)})
    moves, rated = D.planar_movements(f, ("x", "y"), "yaw", "t", L.FRAMES, BASE)
    return D.split_turns(moves, rated.withColumn("window", F.lit(2)), ["vx", "vy"], "t", "window", L.FRAMES, BASE)


@query("lb08_base_movements", "LB8", "WN17", sql=with_(FRAMES, BASE_SQL + " SELECT episode, start, stop FROM bs"))
def _(spark, d):
    return _base(spark, d)


TURN = "abs(" + " + ".join(f"a{c}*lead(a{c}) OVER w" for c in ("qw", "qx", "qy", "qz")) + ")"
BETWEEN = " + ".join(f"a.a{c}*b.a{c}" for c in ("qw", "qx", "qy", "qz"))
HAND_SQL = f"""
ps AS (SELECT episode, row, row * 0.1::DOUBLE AS t, ax, ay, az, aqw, aqx, aqy, aqz FROM poses),
pg AS (SELECT *, coalesce(2.0::DOUBLE * acos(least({TURN}, 1.0::DOUBLE)) / (lead(t) OVER w - t), 0) AS rate FROM ps WINDOW w AS (PARTITION BY episode ORDER BY row)),
""" + _rated_sql("pg", {"x": "ax", "y": "ay", "z": "az"}, "rate", "hr") + "," + _moved_sql(
    "hr", f"sqrt(vx*vx + vy*vy + vz*vz) > {HAND.lin} OR turn > {HAND.ang}", f"greatest(sqrt(pow(b.ax - a.ax, 2) + pow(b.ay - a.ay, 2) + pow(b.az - a.az, 2)), 2.0::DOUBLE * acos(least(abs({BETWEEN}), 1.0::DOUBLE)))", HAND, "hm") + "," + _split_sql(
    "hr", "hm", ["vx", "vy", "vz"], HAND, "hs")


@query("lb08_hand_movements", "LB8", "WN17", sql=with_(POSES, HAND_SQL + " SELECT episode, start, stop FROM hs"))
def _(spark, d):
    """Movements of the first pose track, split where it turns back."""
    p = L.poses(spark, d).select("episode", "row", (F.col("row") * 0.1).alias("t"), "ax", "ay", "az", "aqw", "aqx", "aqy", "aqz")
    p = attach(p, ["episode"], {"last_row": F.max("row")}).withColumns({"behind": F.lit(1), "ahead": F.lit(1)})
    moves, rated = D.pose_movements(p, ["ax", "ay", "az"], ["aqw", "aqx", "aqy", "aqz"], "t", Axis(), HAND)
    return D.split_turns(moves, rated.withColumn("window", F.lit(2)), ["vx", "vy", "vz"], "t", "window", Axis(), HAND)


@query("lb09_body_stages", "LB9", "WN18", "LB8", sql=with_(FRAMES, MOVED + "," + islands("frames", "CASE WHEN closed THEN 1 END", name="hr") + "," + BASE_SQL + "," + staged_sql(
    "SELECT episode, 'base' AS part, start, stop FROM bs UNION ALL SELECT episode, 'hand', start, stop FROM hr UNION ALL SELECT episode, 'opening', start, stop FROM moved", "abs(rate)/0.5::DOUBLE")))
def _(spark, d):
    """Stages of the whole body: base, hand and opening make at most one movement each."""
    moves, rated = moving(spark, d)
    closed = S.runs(L.frames(spark, d).select("episode", "row", "closed"), F.when(F.col("closed"), F.lit(1)), L.FRAMES)
    parts = {"opening": moves, "hand": closed, "base": _base(spark, d)}
    events = None
    for name, found in parts.items():
        found = found.select("episode", F.lit(name).alias("part"), "start", "stop")
        events = found if events is None else events.unionByName(found)
    return D.stage_cuts(cut(events), rated.select("episode", "row", "t", (F.abs("rate") / 0.5).alias("activity")), "t", L.FRAMES, TH)
