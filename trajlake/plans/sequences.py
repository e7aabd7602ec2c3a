"""Sequence queries on frames: increments, derivatives, windows, runs, fills and as-of joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planar
from ..operators import sequence as S
from ..operators.blocks import attach, interval_join, quantile, running, shift
from ..operators.resample import uniform_ticks
from ..sources import landing as L
from .registry import long, query, r6
from .sqlbase import FRAMES, with_

W = "WINDOW w AS (PARTITION BY episode ORDER BY row)"
WRAP = "({0}) + pi() - 2*pi()*floor((({0}) + pi()) / (2*pi())) - pi()"


def islands(source: str, label: str, extra: str = "", name: str = "runs", keys: str = "episode") -> str:
    """SQL table expressions for the runs of a label: gaps and islands."""
    extra = "," + extra if extra else ""
    return f"""{name}_m AS (SELECT *, {label} AS lab, lag({label}) OVER (PARTITION BY {keys} ORDER BY row) AS prev_lab FROM {source}),
{name}_g AS (SELECT *, sum(CASE WHEN lab IS NOT NULL AND lab IS DISTINCT FROM prev_lab THEN 1 ELSE 0 END)
               OVER (PARTITION BY {keys} ORDER BY row) AS g FROM {name}_m),
{name} AS (SELECT {keys}, lab AS label, min(row) AS start, max(row) + 1 AS stop{extra} FROM {name}_g WHERE lab IS NOT NULL
           GROUP BY {keys}, g, lab)"""


def merged(source: str, limit: str, same: bool = True, name: str = "merged", ok: str = "true", extra: str = "") -> str:
    """SQL for merging consecutive runs with a short gap; the source has start, stop, t0 (first) and t1 (last)."""
    agree = "label = lag(label) OVER v AND" if same else ""
    label = "label, " if same else ""
    extra = "," + extra if extra else ""
    return f"""{name}_o AS (SELECT *, CASE WHEN {agree} t0 - lag(t1) OVER v {limit} AND ({ok}) THEN 0 ELSE 1 END AS opens
  FROM {source} WINDOW v AS (PARTITION BY episode ORDER BY start)),
{name}_g AS (SELECT *, sum(opens) OVER (PARTITION BY episode ORDER BY start) AS g FROM {name}_o),
{name} AS (SELECT episode, {label}min(start) AS start, max(stop) AS stop, count(*) AS pieces, min(t0) AS t0, max(t1) AS t1{extra}
  FROM {name}_g GROUP BY ALL HAVING true)""".replace("GROUP BY ALL", f"GROUP BY episode, {label}g")


@query("wn01_next_row_targets", "WN1", sql=with_(FRAMES, f"""
SELECT episode, row, round(lead(opening) OVER w, 6) AS target FROM frames {W} QUALIFY lead(row) OVER w IS NOT NULL"""))
def _(spark, d):
    out = shift(L.frames(spark, d).select("episode", "row", "opening"), L.FRAMES, {"target": (F.col("opening"), 1)})
    return out.where(F.col("target").isNotNull()).select("episode", "row", r6("target").alias("target"))


@query("wn02_row_increments", "WN2", "FN-R1", sql=with_(FRAMES, f"""
inc AS (SELECT episode, row, lead(opening) OVER w - opening AS d, lead(yaw) OVER w - yaw AS y FROM frames {W} QUALIFY lead(row) OVER w IS NOT NULL)
SELECT episode, row, round(d, 6) + 0.0 AS d_opening, round({WRAP.format("y")}, 6) + 0.0 AS d_yaw FROM inc"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "opening", "yaw")
    out = S.steps(f, {"d_opening": F.col("opening"), "d_yaw": F.col("yaw")}, L.FRAMES, wrapped=["d_yaw"])
    return out.select("episode", "row", r6("d_opening").alias("d_opening"), r6("d_yaw").alias("d_yaw"))


@query("wn03_body_increments", "WN3", sql=with_(FRAMES, f"""
inc AS (SELECT episode, row, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, (yaw + lead(yaw) OVER w) / 2 AS mid
        FROM frames {W} QUALIFY lead(row) OVER w IS NOT NULL)
SELECT episode, row, round(cos(mid)*dx + sin(mid)*dy, 6) + 0.0 AS bx, round(cos(mid)*dy - sin(mid)*dx, 6) + 0.0 AS "by" FROM inc"""))
def _(spark, d):
    f = shift(L.frames(spark, d).select("episode", "row", "x", "y", "yaw"), L.FRAMES,
              {n: (F.col(c), 1) for n, c in (("nx", "x"), ("ny", "y"), ("nyaw", "yaw"))})
    f = f.where(F.col("nx").isNotNull())
    bx, by = planar.to_body(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), (F.col("yaw") + F.col("nyaw")) / 2.0)
    return f.select("episode", "row", r6(bx).alias("bx"), r6(by).alias("by"))


@query("wn04_uneven_gradient", "WN4", sql=with_(FRAMES, f"""
n AS (SELECT *, lag(t) OVER w AS tp, lead(t) OVER w AS tn, lag(opening) OVER w AS p, lead(opening) OVER w AS q FROM frames {W}),
h AS (SELECT *, t - tp AS hs, tn - t AS hd FROM n)
SELECT episode, row, round(CASE WHEN tp IS NULL THEN (q - opening) / hd WHEN tn IS NULL THEN (opening - p) / hs
  ELSE (hs*hs*q + (hd*hd - hs*hs)*opening - hd*hd*p) / (hs*hd*(hd + hs)) END, 5) + 0.0 AS rate FROM h"""))
def _(spark, d):
    g = S.gradient(L.frames(spark, d).select("episode", "row", "t", "opening"), "t", {"rate": F.col("opening")}, L.FRAMES)
    return g.select("episode", "row", r6("rate", 5).alias("rate"))


@query("wn05_central_difference", "WN5", "RS4", sql=with_(FRAMES, f"""
n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM frames {W})
SELECT episode, row, round(CASE WHEN p IS NULL THEN (q - value) / 0.02 WHEN q IS NULL THEN (value - p) / 0.02
  ELSE (q - p) / 0.04 END, 4) + 0.0 AS velocity FROM n"""))
def _(spark, d):
    g = S.central_difference(L.frames(spark, d).select("episode", "row", "value"), {"velocity": F.col("value")}, 0.02, L.FRAMES)
    return g.select("episode", "row", r6("velocity", 4).alias("velocity"))


STEP = f"""
steps AS (SELECT episode, lead(t) OVER w - t AS dt FROM frames {W}),
med AS (SELECT episode, quantile_cont(dt, 0.5) AS med FROM steps WHERE dt > 0 GROUP BY episode)"""


@query("ag29_median_step", "AG29", sql=with_(FRAMES, STEP + " SELECT episode, round(med, 9) AS median_dt FROM med"))
def _(spark, d):
    m = S.median_step(L.frames(spark, d).select("episode", "row", "t"), "t", L.FRAMES, span=0.25)
    return m.select("episode", F.round("median_dt", 9).alias("median_dt"))


@query("ag28_open_level", "AG28", sql=with_(FRAMES, """
SELECT episode, round(quantile_cont(opening, 0.95), 6) AS open_level FROM frames GROUP BY episode"""))
def _(spark, d):
    q = quantile(L.frames(spark, d), ["episode"], F.col("opening"), 0.95, name="open_level", span=0.01)
    return q.select("episode", r6("open_level").alias("open_level"))


def _with_width(spark, d, seconds: float, *columns: str):
    """Frames with a per-episode row count ``k`` covering a time, from the median step."""
    f = L.frames(spark, d).select("episode", "row", "t", *columns)
    med = S.median_step(f.select("episode", "row", "t"), "t", L.FRAMES, span=0.25)
    k = F.greatest(F.round(F.lit(seconds) / F.col("median_dt")), F.lit(1)).cast("long")
    return f.join(med.select("episode", k.alias("k")), "episode")


WIDTH = STEP + ",\nwide AS (SELECT f.*, CAST(greatest(1, round({0} / med)) AS BIGINT) AS k, max(row) OVER (PARTITION BY episode) AS last FROM frames f JOIN med USING (episode))"


@query("wn06_symmetric_difference", "WN6", sql=with_(FRAMES, WIDTH.format("1.1::DOUBLE") + """
SELECT a.episode, a.row, round((h.opening - l.opening) / (h.t - l.t), 5) + 0.0 AS speed FROM wide a
JOIN frames l ON l.episode = a.episode AND l.row = greatest(a.row - a.k, 0)
JOIN frames h ON h.episode = a.episode AND h.row = least(a.row + a.k, a.last)"""))
def _(spark, d):
    f = S.clipped_pair(_with_width(spark, d, 1.1, "opening"), F.col("k"), ["t", "opening"], L.FRAMES)
    speed = (F.col("hi_opening") - F.col("lo_opening")) / (F.col("hi_t") - F.col("lo_t"))
    return f.select("episode", "row", r6(speed, 5).alias("speed"))


@query("wn07_sliding_maximum", "WN7", sql=with_(FRAMES, WIDTH.format("1.3::DOUBLE") + """
SELECT a.episode, a.row, round(max(b.opening), 6) AS peak FROM wide a
JOIN frames b ON b.episode = a.episode AND b.row BETWEEN a.row - a.k AND a.row + a.k GROUP BY a.episode, a.row"""))
def _(spark, d):
    f = S.sliding_max(_with_width(spark, d, 1.3, "opening"), "opening", "k", L.FRAMES, name="peak")
    return f.select("episode", "row", r6("peak").alias("peak"))


@query("wn08_moving_average", "WN8", sql=with_(FRAMES, WIDTH.format("2.2::DOUBLE") + """
, taps AS (SELECT episode, row, k, last, unnest(range(-(k // 2), k - k // 2)) AS j FROM wide)
SELECT a.episode, a.row, round(avg(b.opening), 9) AS mean FROM taps a
JOIN frames b ON b.episode = a.episode AND b.row = least(greatest(a.row + a.j, 0), a.last) GROUP BY a.episode, a.row"""))
def _(spark, d):
    f = attach(_with_width(spark, d, 2.2, "opening"), ["episode"], {"last_row": F.max("row")})
    half = F.floor(F.col("k") / 2)
    f = f.withColumns({"behind": half, "ahead": F.col("k") - half - 1})
    return S.smooth(f, {"mean": F.col("opening")}, "behind", "ahead", L.FRAMES).select("episode", "row", r6("mean", 9).alias("mean"))


@query("wn08_gaussian", "WN8", sql=with_(FRAMES, STEP + """,
wide AS (SELECT f.*, 0.6::DOUBLE / med AS sigma, CAST(floor(4 * (0.6::DOUBLE / med) + 0.5::DOUBLE) AS BIGINT) AS k, max(row) OVER (PARTITION BY episode) AS last
  FROM frames f JOIN med USING (episode)),
taps AS (SELECT episode, row, last, sigma, unnest(range(-k, k + 1)) AS j FROM wide)
SELECT a.episode, a.row, round(sum(exp(-0.5 * pow(j / sigma, 2)) * b.opening) / sum(exp(-0.5 * pow(j / sigma, 2))), 6) AS mean FROM taps a
JOIN frames b ON b.episode = a.episode AND b.row = least(greatest(a.row + a.j, 0), a.last) GROUP BY a.episode, a.row"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t", "opening")
    med = S.median_step(f.select("episode", "row", "t"), "t", L.FRAMES, span=0.25)
    sigma = F.lit(0.6) / F.col("median_dt")
    reach = F.floor(4.0 * sigma + 0.5)
    f = f.join(med.select("episode", sigma.alias("sigma"), reach.alias("behind"), reach.alias("ahead")), "episode")
    f = attach(f, ["episode"], {"last_row": F.max("row")})
    return S.smooth(f, {"mean": F.col("opening")}, "behind", "ahead", L.FRAMES, sigma="sigma").select(
        "episode", "row", r6("mean").alias("mean"))


@query("wn09_held_runs", "WN9", "LB7", sql=with_(FRAMES, islands("frames", "CASE WHEN closed THEN 1 END", "max(value) AS peak") + """
SELECT episode, start, stop, peak FROM runs"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "closed", "value")
    return S.runs(f, F.when(F.col("closed"), F.lit(1)), L.FRAMES, {"peak": F.max("value")}).select("episode", "start", "stop", "peak")


LABEL_RUNS = islands("frames", "label", "min(t) AS t0, max(t) AS t1, max(opening) - min(opening) AS travel")


def _label_runs(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t", "label", "opening")
    return S.runs(f, F.col("label"), L.FRAMES, {"t0": F.min("t"), "t1": F.max("t"), "travel": F.max("opening") - F.min("opening")})


@query("wn09_label_runs", "WN9", "LB7", sql=with_(FRAMES, LABEL_RUNS + """
SELECT episode, label, start, stop, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM runs"""))
def _(spark, d):
    return _label_runs(spark, d).select("episode", "label", "start", "stop", r6("t0").alias("t0"), r6("t1").alias("t1"))


@query("wn10_bridged_runs", "WN10", sql=with_(FRAMES, LABEL_RUNS + "," + merged("runs", "<= 2.5") + """
SELECT episode, label, start, stop, pieces FROM merged"""))
def _(spark, d):
    out = S.bridge(_label_runs(spark, d), F.col("t0") - F.col("prev_t1"), 2.5, L.FRAMES, same=["label"], strict=False)
    return out.select("episode", "label", "start", "stop", "pieces")


@query("wn11_runs_without_short", "WN11", sql=with_(FRAMES, LABEL_RUNS + """
SELECT episode, label, start, stop FROM runs WHERE t1 - t0 >= 0.4 OR travel >= 0.3"""))
def _(spark, d):
    keep = (F.col("t1") - F.col("t0") >= 0.4) | (F.col("travel") >= 0.3)
    return _label_runs(spark, d).where(keep).select("episode", "label", "start", "stop")


@query("wn12_next_label", "WN12", sql=with_(FRAMES, """
SELECT episode, row, first_value(label IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_label
FROM frames"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "label")
    return S.next_value(f, "next_label", F.col("label"), L.FRAMES).select("episode", "row", "next_label")


@query("wn13_carried_value", "WN13", sql=with_(FRAMES, """
SELECT episode, row, coalesce(
  last_value(CASE WHEN closed THEN value END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(CASE WHEN closed THEN value END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS carried
FROM frames"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", F.when(F.col("closed"), F.col("value")).alias("v"))
    return S.fill_forward(f, {"carried": F.col("v")}, L.FRAMES).select("episode", "row", "carried")


@query("wn14_running_extremes", "WN14", "LB21", sql=with_(FRAMES, islands("frames", "label", name="runs") + """
SELECT episode, row, round(max(value) OVER (PARTITION BY episode ORDER BY row), 6) AS top,
       round(CASE WHEN label IS NOT NULL THEN least(opening, min(opening) OVER (PARTITION BY episode, g, lab ORDER BY row) + 0.002) ELSE opening END, 6) AS width
FROM runs_g"""))
def _(spark, d):
    f = S.mark_runs(L.frames(spark, d).select("episode", "row", "label", "value", "opening"), F.col("label"), L.FRAMES)
    f = running(f, L.FRAMES, {"top": ("max", F.col("value"))})
    f = running(f.withColumn("run", F.coalesce("run", F.lit(-1))), L.FRAMES.within("run"), {"low": ("min", F.col("opening"))})
    width = F.when(F.col("run") >= 0, F.least(F.col("opening"), F.col("low") + 0.002)).otherwise(F.col("opening"))
    return f.select("episode", "row", r6("top").alias("top"), r6(width).alias("width"))


@query("wn15_cumulative_warp", "WN15", sql=with_(FRAMES, f"""
s AS (SELECT episode, row, (t - lag(t) OVER w) * (1 + lag(opening) OVER w) AS step FROM frames {W})
SELECT episode, row, round(coalesce(sum(step) OVER (PARTITION BY episode ORDER BY row), 0), 6) AS warped FROM s"""))
def _(spark, d):
    f = shift(L.frames(spark, d).select("episode", "row", "t", "opening"), L.FRAMES, {"tp": (F.col("t"), -1), "op": (F.col("opening"), -1)})
    step = F.coalesce((F.col("t") - F.col("tp")) * (1.0 + F.col("op")), F.lit(0.0))
    return running(f.withColumn("step", step), L.FRAMES, {"warped": ("sum", F.col("step"))}).select("episode", "row", r6("warped").alias("warped"))


@query("wn16_look_ahead_by_arc_length", "WN16", sql=with_(FRAMES, f"""
s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM frames {W}),
path AS (SELECT episode, row, x, y, yaw, coalesce(sum(step) OVER (PARTITION BY episode ORDER BY row), 0) AS s FROM s),
hit AS (SELECT p.*, a.row AS ahead_row, a.x - p.x AS dx, a.y - p.y AS dy FROM path p ASOF LEFT JOIN path a ON p.episode = a.episode AND p.s + 1.0 <= a.s),
n AS (SELECT *, sqrt(dx*dx + dy*dy) AS n FROM hit)
SELECT episode, row, ahead_row, round(CASE WHEN n > 0.5 THEN dx / n ELSE cos(yaw) END, 5) + 0.0 AS gx,
       round(CASE WHEN n > 0.5 THEN dy / n ELSE sin(yaw) END, 5) + 0.0 AS gy FROM n"""))
def _(spark, d):
    f = shift(L.frames(spark, d).select("episode", "row", "x", "y", "yaw"), L.FRAMES, {"px": (F.col("x"), -1), "py": (F.col("y"), -1)})
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    f = running(f.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))), L.FRAMES, {"s": ("sum", F.col("step"))})
    f = S.lookahead(f.select("episode", "row", "x", "y", "yaw", "s"), "s", 1.0, ["row", "x", "y"], L.FRAMES, span=1024.0)
    dx, dy = F.col("ahead_x") - F.col("x"), F.col("ahead_y") - F.col("y")
    n = F.sqrt(dx * dx + dy * dy)
    return f.select("episode", "row", "ahead_row", r6(F.when(n > 0.5, dx / n).otherwise(F.cos("yaw")), 5).alias("gx"),
                    r6(F.when(n > 0.5, dy / n).otherwise(F.sin("yaw")), 5).alias("gy"))


@query("wn23_longest_and_first_run", "WN23", sql=with_(FRAMES, LABEL_RUNS + """,
l AS (SELECT episode, start, stop FROM runs QUALIFY row_number() OVER (PARTITION BY episode ORDER BY stop - start DESC, start) = 1),
f AS (SELECT episode, start, stop FROM runs QUALIFY row_number() OVER (PARTITION BY episode ORDER BY start) = 1)
SELECT episode, l.start AS long_start, l.stop AS long_stop, f.start AS first_start, f.stop AS first_stop FROM l JOIN f USING (episode)"""))
def _(spark, d):
    runs = _label_runs(spark, d).select("episode", "start", "stop")
    a = S.longest_run(runs, ["episode"]).select("episode", F.col("start").alias("long_start"), F.col("stop").alias("long_stop"))
    b = S.first_run(runs, ["episode"]).select("episode", F.col("start").alias("first_start"), F.col("stop").alias("first_stop"))
    return a.join(b, "episode")


@query("wn24_separated_movements", "WN24", sql=with_(FRAMES, islands("frames", "CASE WHEN opening > 0.05 THEN 1 END", "min(t) AS t0, max(t) AS t1") + """
, g AS (SELECT episode, CASE WHEN lag(t1) OVER (PARTITION BY episode ORDER BY start) IS NULL OR t0 - lag(t1) OVER (PARTITION BY episode ORDER BY start) > 1.5
        THEN 1 ELSE 0 END AS n FROM runs)
SELECT episode, CAST(sum(n) AS BIGINT) AS movements FROM g GROUP BY episode"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t", "opening")
    runs = S.runs(f, F.when(F.col("opening") > 0.05, F.lit(1)), L.FRAMES, {"t0": F.min("t"), "t1": F.max("t")})
    runs = running(runs, L.FRAMES.by("start"), {"before": ("max", F.col("t1"))}, exclusive=True)
    apart = F.col("before").isNull() | (F.col("t0") - F.col("before") > 1.5)
    return runs.groupBy("episode").agg(F.count_if(apart).alias("movements"))


@query("wn25_onset_window_peak", "WN25", sql=with_(FRAMES, islands("frames", "CASE WHEN event_type = 'error' THEN 1 END") + """
SELECT r.episode, r.start, round(max(f.opening), 6) AS peak FROM runs r
JOIN frames f ON f.episode = r.episode AND f.row BETWEEN greatest(r.start - 5, 0) AND r.start GROUP BY r.episode, r.start"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "event_type", "opening")
    onsets = S.runs(f.select("episode", "row", "event_type"), F.when(F.col("event_type") == "error", F.lit(1)), L.FRAMES)
    windows = onsets.select("episode", "start", (F.col("start") - 5).alias("low"), F.col("start").alias("high"))
    hits = interval_join(f.select("episode", "row", "opening"), windows, ["episode"], "row", "low", "high", span=64)
    return hits.groupBy("episode", "start").agg(r6(F.max("opening")).alias("peak"))


@query("wn26_evenly_spaced_picks", "WN26", sql=with_(FRAMES, """
n AS (SELECT episode, count(*) AS n, least(count(*), 12) AS k FROM frames GROUP BY episode),
p AS (SELECT episode, unnest(range(0, k)) AS i, n, k FROM n)
SELECT episode, CAST((i * n) // k AS BIGINT) AS row FROM p"""))
def _(spark, d):
    f = attach(L.frames(spark, d).select("episode", "row"), ["episode"], {"n": F.count(F.lit(1))})
    return S.evenly_spaced(f, ["episode"], "row", 12).select("episode", "row")


GRID = """
ends AS (SELECT episode, max(t) AS t_end FROM frames GROUP BY episode),
grid AS (SELECT episode, k * 0.5::DOUBLE AS t FROM (SELECT episode, unnest(range(0, CAST(floor(t_end / 0.5) AS BIGINT) + 1)) AS k FROM ends))"""


def _grid(f):
    """A uniform clock of half a day over every episode."""
    ends = f.groupBy("episode").agg(F.max("t").alias("t_end"))
    ticks = uniform_ticks(ends, ["episode"], F.lit(0), F.floor(F.col("t_end") / 0.5))
    return ticks.select("episode", (F.col("k") * 0.5).alias("t"))


@query("jn11_asof_backward", "JN11", "RS3", sql=with_(FRAMES, GRID + """
SELECT g.episode, g.t, f.row AS left_row, round(f.opening, 6) AS opening FROM grid g ASOF JOIN frames f ON g.episode = f.episode AND g.t >= f.t"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t", "opening")
    out = S.asof(_grid(f), f, "t", ["row", "opening"], L.CLOCK)
    return out.select("episode", "t", F.col("row").alias("left_row"), r6("opening").alias("opening"))


@query("jn12_asof_forward", "JN12", sql=with_(FRAMES, GRID + """
SELECT g.episode, g.t, f.row AS right_row FROM grid g ASOF LEFT JOIN frames f ON g.episode = f.episode AND g.t <= f.t"""))
def _(spark, d):
    f = L.frames(spark, d).select("episode", "row", "t")
    return S.asof(_grid(f), f, "t", ["row"], L.CLOCK, forward=True).select("episode", "t", F.col("row").alias("right_row"))


@query("jn14_frames_in_windows", "JN14", sql=with_(FRAMES, LABEL_RUNS + """
SELECT f.episode, f.row, count(*) AS windows, min(r.start) AS first_start FROM frames f
JOIN runs r ON r.episode = f.episode AND f.t BETWEEN r.t0 - 0.5 AND r.t1 + 0.3 GROUP BY f.episode, f.row"""))
def _(spark, d):
    f = L.frames(spark, d)
    w = _label_runs(spark, d).select("episode", "start", (F.col("t0") - 0.5).alias("low"), (F.col("t1") + 0.3).alias("high"))
    hits = interval_join(f.select("episode", "row", "t"), w, ["episode"], "t", "low", "high", span=1.0)
    return hits.groupBy("episode", "row").agg(F.count(F.lit(1)).alias("windows"), F.min("start").alias("first_start"))


@query("jn15_overlapping_intervals", "JN15", sql=with_(FRAMES, LABEL_RUNS + """,
stages AS (SELECT episode, k AS stage, k * 16 AS a, k * 16 + 16 AS b FROM (SELECT episode, unnest(range(0, CAST(max(row) // 16 + 1 AS BIGINT))) AS k FROM frames GROUP BY episode))
SELECT s.episode, s.stage, count(*) AS movements, CAST(sum(r.stop - r.start) AS BIGINT) AS rows FROM stages s
JOIN runs r ON r.episode = s.episode AND r.start < s.b AND r.stop > s.a GROUP BY s.episode, s.stage"""))
def _(spark, d):
    runs = _label_runs(spark, d).select("episode", "start", "stop")
    touched = F.sequence(F.floor(F.col("start") / 16), F.floor((F.col("stop") - 1) / 16))
    return runs.withColumn("stage", F.explode(touched)).groupBy("episode", "stage").agg(
        F.count(F.lit(1)).alias("movements"), F.sum(F.col("stop") - F.col("start")).alias("rows"))


@query("jn13_timeline_sampling", "JN13", "FN-G3", sql=with_(FRAMES, GRID + f""",
seg AS (SELECT episode, row, t AS t0, lead(t) OVER w AS t1, opening AS a, lead(opening) OVER w AS b FROM frames {W}),
hit AS (SELECT g.episode, g.t, s.* EXCLUDE (episode) FROM grid g ASOF JOIN seg s ON g.episode = s.episode AND g.t >= s.t0),
u AS (SELECT *, CASE WHEN t1 IS NULL OR t1 <= t0 THEN 1.0 ELSE least(greatest((t - t0) / (t1 - t0), 0), 1) END AS u FROM hit)
SELECT episode, t, round(a + (coalesce(b, a) - a) * (u*u*u*(10 - 15*u + 6*u*u)), 6) AS value FROM u"""))
def _(spark, d):
    from ..functions.gripper import min_jerk
    f = L.frames(spark, d).select("episode", "row", "t", "opening")
    seg = shift(f, L.FRAMES, {"t1": (F.col("t"), 1), "b": (F.col("opening"), 1)})
    seg = seg.withColumn("t0", F.col("t")).withColumn("a", F.col("opening"))
    hit = S.asof(_grid(f), seg, "t", ["t0", "t1", "a", "b"], L.CLOCK)
    u = F.when(F.col("t1").isNull() | (F.col("t1") <= F.col("t0")), F.lit(1.0)).otherwise((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    value = F.col("a") + (F.coalesce("b", "a") - F.col("a")) * min_jerk(u)
    return hit.select("episode", "t", r6(value).alias("value"))


@query("ag16_clock_diagnostics", "AG16", sql=with_(FRAMES, f"""
s AS (SELECT episode, lead(t) OVER w - t AS dt, greatest(1, abs(lead(opening) OVER w - opening) / 0.05) AS dil FROM frames {W} QUALIFY lead(row) OVER w IS NOT NULL)
SELECT episode, round(sum(dt), 6) AS source_duration, round(sum(dt * dil), 5) AS duration, round(sum(dt * dil) / sum(dt), 5) AS duration_ratio,
       round(max(dil), 6) AS max_dilation, count(*) FILTER (WHERE dil > 1 + 1e-9) AS dilated_intervals FROM s GROUP BY episode"""))
def _(spark, d):
    f = S.steps(L.frames(spark, d).select("episode", "row", "t", "opening"), {"dt": F.col("t"), "do": F.col("opening")}, L.FRAMES)
    dil = F.greatest(F.lit(1.0), F.abs("do") / 0.05)
    f = f.select("episode", "dt", dil.alias("dil"))
    total, warped = F.sum("dt"), F.sum(F.col("dt") * F.col("dil"))
    return f.groupBy("episode").agg(r6(total).alias("source_duration"), r6(warped, 5).alias("duration"), r6(warped / total, 5).alias("duration_ratio"),
                                    r6(F.max("dil")).alias("max_dilation"), F.count_if(F.col("dil") > 1 + 1e-9).alias("dilated_intervals"))


@query("fn_r1_r10_r11_planar_motion", "FN-R1", "FN-R10", "FN-R11", "CM10", "CM11", sql=with_(FRAMES, f"""
p AS (SELECT episode, row, x, y, yaw, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(yaw) OVER w AS nyaw FROM frames {W} QUALIFY lead(row) OVER w IS NOT NULL),
rel AS (SELECT *, cos(yaw)*(nx-x) + sin(yaw)*(ny-y) AS dx, cos(yaw)*(ny-y) - sin(yaw)*(nx-x) AS dy, {WRAP.format("nyaw - yaw")} AS dyaw FROM p),
arc AS (SELECT *, CASE WHEN abs(dyaw) < 1e-12 THEN 1 ELSE sin(dyaw)/dyaw END AS a, CASE WHEN abs(dyaw) < 1e-12 THEN 0 ELSE (1 - cos(dyaw))/dyaw END AS b FROM rel)
SELECT episode, row, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(dyaw, 6) + 0.0 AS dyaw, round((a*dx + b*dy)/(a*a + b*b)/0.02, 4) + 0.0 AS vx,
       round((a*dy - b*dx)/(a*a + b*b)/0.02, 4) + 0.0 AS vy, round(dyaw/0.02, 4) + 0.0 AS wz,
       round(abs(x + cos(yaw)*dx - sin(yaw)*dy - nx) + abs(y + sin(yaw)*dx + cos(yaw)*dy - ny), 6) AS closure FROM arc"""))
def _(spark, d):
    from ..functions.vectors import Sheet, cols
    f = shift(L.frames(spark, d).select("episode", "row", "x", "y", "yaw"), L.FRAMES,
              {"nx": (F.col("x"), 1), "ny": (F.col("y"), 1), "nyaw": (F.col("yaw"), 1)}).where(F.col("nx").isNotNull())
    s = Sheet(f)
    here = cols("x", "y", "yaw")
    rel = s.put("rel", planar.relative(here, cols("nx", "ny", "nyaw")))
    twist = s.put("twist", planar.log(rel, 0.02))
    back = s.put("back", planar.compose(here, planar.exp(twist, 0.02)))
    closure = F.abs(back[0] - F.col("nx")) + F.abs(back[1] - F.col("ny"))
    return s.select("episode", "row", *[r6(c).alias(n) for n, c in zip(("dx", "dy", "dyaw"), rel)],
                    *[r6(c, 4).alias(n) for n, c in zip(("vx", "vy", "wz"), twist)], r6(closure).alias("closure"))
