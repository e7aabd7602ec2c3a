"""Scenario queries, and the record and annotation rules of single rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cols
from ..operators import constraints as V
from ..operators import scenarios as G
from ..operators import sequence as S
from ..operators.blocks import Axis
from ..sources import landing as L
from ..sources.files import layout
from . import sqlkit as K
from .registry import query, r6
from .sqlbase import FRAMES, POSES, RECORDS, with_


def _u(*parts: str) -> str:
    return "CAST('0x' || substr(sha1(concat_ws('/', " + ", ".join(parts) + ")), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _pick(u: str, options, weights) -> str:
    upto, out = 0.0, "CASE"
    for o, w in zip(options[:-1], weights[:-1]):
        upto += w
        out += f" WHEN {u} < {round(upto / sum(weights), 9)} THEN '{o}'"
    return out + f" ELSE '{options[-1]}' END"


SLOTS = "[" + ", ".join(f"'{c}'" for c in G.CELLS) + "]"
SCEN = f"""
WITH i AS (SELECT o_orderkey AS idx, o_orderkey // 4 AS grp, o_orderkey % 4 AS member FROM orders), p AS (SELECT b, row_number() OVER (PARTITION BY b ORDER BY sha1(concat_ws('/', 'ns', 'train', b, s))) - 1 AS pos, s FROM (SELECT b, unnest(range(0, 10)) AS s FROM (SELECT DISTINCT grp // 10 AS b FROM i))),
k AS (SELECT i.*, 'g' || printf('%06d', grp) AS key, {SLOTS}[s + 1] AS cell FROM i JOIN p ON p.b = grp // 10 AND p.pos = grp % 10),
d AS (SELECT *, {", ".join(f"{_pick(_u(chr(39) + 'ns' + chr(39), chr(39) + 'train' + chr(39), 'key', chr(39) + a + chr(39)), *spec)} AS {a}_0" for a, spec in G.AXES.items())}, {_u("'ns'", "'train'", "key", "'joint'")} AS uj FROM k)"""


@query("sy01_sy02_sy03_scenarios", "SY1", "SY2", "SY3", sql=SCEN + """
SELECT idx, grp AS "group", member, cell, CASE WHEN cell = 'gaze_target' THEN 'gaze_target' WHEN cell = 'joint_move' THEN CASE WHEN uj < 0.25 THEN 'joint' ELSE 'off' END WHEN cell IN ('reach_target', 'drive_target') THEN 'off'
  WHEN neck_0 = 'look_ahead' AND cell NOT IN ('navigation', 'drive_target') THEN 'look_at_point' ELSE neck_0 END AS neck, extent_0 AS extent, speed_0 AS speed, start_0 AS start,
  CASE WHEN cell IN ('reach_target', 'gaze_target', 'joint_move', 'drive_target', 'navigation') THEN CASE WHEN gripper_0 IN ('keep_open', 'open') THEN 'keep_open' ELSE 'keep_closed' END ELSE gripper_0 END AS gripper,
  CASE WHEN cell = 'drive_target' THEN 'drive_target' WHEN cell = 'navigation' THEN base_motion_0 END AS base_motion FROM d""")
def _(spark, d):
    i = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    return G.scenarios(i, "idx", "ns", "train", 4).drop("key")


@query("sy01_cell_balance", "SY1", sql="""SELECT blocks, count(*) AS slots FROM (SELECT slot, count(*) AS blocks FROM (SELECT o_orderkey % 10 AS slot FROM orders) GROUP BY slot) GROUP BY blocks""")
def _(spark, d):
    """Counting scenario cells per slot share must give what counting indices modulo ten gives."""
    i = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    per = G.scenarios(i, "idx", "ns", "val").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("cell").isin("reach_target", "gaze_target"), 2).otherwise(1)
    split = per.select(F.explode(F.array_repeat((F.col("n") / share).cast("long"), share)).alias("blocks"))
    return split.groupBy("blocks").agg(F.count(F.lit(1)).alias("slots"))


@query("sy04_hand_motions", "SY4", "FN-G3", "FN-G4", sql=with_(POSES, """
p AS (SELECT vec_id, "ax" AS a0, "ay" AS a1, "bx" AS b0, "by" AS b1, greatest(0.4, 1.875*sqrt(pow("bx"-"ax", 2) + pow("by"-"ay", 2))/0.2) AS sec FROM poses),
k AS (SELECT *, unnest(range(0, CAST(ceil(sec*10 - 1e-9) AS BIGINT) + 1)) AS k FROM p), u AS (SELECT *, least(k/10.0::DOUBLE/sec, 1) AS u FROM k), s AS (SELECT *, u*u*u*(10 - 15*u + 6*u*u) AS s FROM u)
SELECT vec_id, k, round(a0 + s*(b0-a0), 6) + 0.0 AS lx, round((1-s)*(1-s)*a0 + 2*s*(1-s)*((a0+b0)/2 + 2*0.05) + s*s*b0, 6) + 0.0 AS cx, round((1-s)*(1-s)*a1 + 2*s*(1-s)*((a1+b1)/2 - 2*0.02) + s*s*b1, 6) + 0.0 AS cy,
  round(0.1 + cos(0.8*s)*(a0-0.1) - sin(0.8*s)*(a1-0.2), 6) + 0.0 AS hx, round(0.2 + sin(0.8*s)*(a0-0.1) + cos(0.8*s)*(a1-0.2), 6) + 0.0 AS hy FROM s"""))
def _(spark, d):
    from ..functions.gripper import move_duration
    from ..functions.vectors import norm, sub
    p = L.poses(spark, d).select("vec_id", *[F.col(f"{t}{c}").alias(f"{t}{i}") for t in "ab" for i, c in enumerate("xy")])
    a, b = cols("a0", "a1"), cols("b0", "b1")
    p = p.withColumn("sec", move_duration(norm(sub(b, a)), F.lit(0.0), 0.2, 1.0, 0.4))
    m, s = G.sampled(p, ["vec_id"], F.col("sec"), 10.0), F.col("s")
    bow = G.bowed(a, b, (F.lit(0.05), F.lit(-0.02)), s)
    turn = G.hinge(a, (F.lit(0.1), F.lit(0.2)), F.lit(0.8), s)
    return m.select("vec_id", "k", r6(G.line(a, b, s)[0]).alias("lx"), r6(bow[0]).alias("cx"), r6(bow[1]).alias("cy"), r6(turn[0]).alias("hx"), r6(turn[1]).alias("hy"))


@query("sy05_base_paths", "SY5", sql=with_(POSES, """
p AS (SELECT vec_id, abs("ax") + 0.5 AS r, "ay"*8 AS ang FROM poses), k AS (SELECT *, unnest(range(0, 21)) AS k FROM p), u AS (SELECT *, k/10.0::DOUBLE/2.0::DOUBLE AS u FROM k), s AS (SELECT *, u*u*u*(10 - 15*u + 6*u*u) AS s FROM u),
w AS (SELECT *, r*sin(ang*s) AS x, r*(1 - cos(ang*s)) AS y, ang*s AS yaw FROM s), l AS (SELECT *, sqrt(pow(x - lag(x) OVER v, 2) + pow(y - lag(y) OVER v, 2))/0.1/0.61 AS ratio FROM w WINDOW v AS (PARTITION BY vec_id ORDER BY k))
SELECT vec_id, round(max(ratio), 5) AS peak, round(greatest(1, max(ratio)/0.85), 5) AS stretch, round(sum(ratio)*0.061, 5) AS length FROM l GROUP BY vec_id"""))
def _(spark, d):
    p = L.poses(spark, d).select("vec_id", (F.abs("ax") + 0.5).alias("r"), (F.col("ay") * 8.0).alias("ang"))
    m = G.sampled(p, ["vec_id"], F.lit(2.0), 10.0)
    x, y, _ = G.arc(F.col("r"), F.col("ang"), F.col("s"))
    m = S.steps(m.select("vec_id", "k", x.alias("x"), y.alias("y")), {"x": F.col("x"), "y": F.col("y")}, Axis(("vec_id",), "k"))
    ratio = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 0.1 / 0.61
    g = m.groupBy("vec_id").agg(F.max(ratio).alias("peak"), F.sum(ratio).alias("total"))
    return g.select("vec_id", r6("peak", 5).alias("peak"), r6(G.stretched(F.col("peak")), 5).alias("stretch"), r6(F.col("total") * 0.061, 5).alias("length"))


@query("sy06_retry_policy", "SY6", sql="""
WITH a AS (SELECT o_orderkey AS uid, 1 - (o_orderkey % 3)*0.25::DOUBLE AS size, 1 + (o_orderkey % 2)*0.5::DOUBLE AS time, o_orderkey % 5 <> 0 AS screened, o_orderkey % 7 < 4 AS saturated FROM orders)
SELECT uid, CASE WHEN screened AND saturated AND time <= 1 THEN size ELSE size*0.75::DOUBLE END AS next_size, CASE WHEN screened AND saturated AND time <= 1 THEN time*1.5::DOUBLE ELSE time END AS next_time FROM a""")
def _(spark, d):
    k = F.col("o_orderkey")
    a = L.table(spark, d, "orders").select(k.alias("uid"), (1.0 - (k % 3) * 0.25).alias("size"), (1.0 + (k % 2) * 0.5).alias("time"), (k % 5 != 0).alias("screened"), (k % 7 < 4).alias("saturated"))
    return G.next_attempt(a).select("uid", "next_size", "next_time")


@query("pj23_frame_violations", "PJ23", sql=with_(FRAMES, """
v AS (SELECT episode, row, unnest(list_filter([CASE WHEN opening > 0.9 THEN 'opening must lie in [0, 0.9]' END, CASE WHEN event_type = 'error' THEN 'label must be known' END, CASE WHEN abs(yaw) > 16 THEN 'yaw out of range' END], lambda m: m IS NOT NULL)) AS rule FROM frames),
c AS (SELECT episode, row, 'time must be uniform' AS rule FROM frames WINDOW w AS (PARTITION BY episode ORDER BY row) QUALIFY lead(t) OVER w - t > 1.5)
SELECT episode, row, rule FROM v UNION ALL SELECT * FROM c"""))
def _(spark, d):
    f = L.frames(spark, d)
    rules = [("opening must lie in [0, 0.9]", F.col("opening").between(0.0, 0.9)), ("label must be known", F.col("event_type") != "error"), ("yaw out of range", F.abs("yaw") <= 16.0)]
    rows = V.violations(f.select("episode", "row", "opening", "event_type", "yaw"), ["episode", "row"], rules)
    clock = V.clock_violations(f.select("episode", "row", "t"), "t", L.FRAMES, step=0.0, tol=1.5).where(F.col("rule") == "time must be uniform")
    return rows.unionByName(clock)


@query("pj23_rigid_poses", "PJ23", sql=with_(POSES, "SELECT count(*) AS poses, count(*) FILTER (WHERE abs(aqw*aqw + aqx*aqx + aqy*aqy + aqz*aqz - 1) <= 1e-6) AS unit FROM poses"))
def _(spark, d):
    p = L.poses(spark, d)
    return p.agg(F.count(F.lit(1)).alias("poses"), F.count_if(V.unit_quaternion(cols(*(f"a{c}" for c in K.Q)))).alias("unit"))


@query("pj18_roles_by_evidence", "PJ18", sql="""
WITH e AS (SELECT user_id AS episode, event_type AS object, bool_or(value > 200) AS grasped, bool_or(value BETWEEN 150 AND 200) AS inside, bool_or(value BETWEEN 120 AND 150) AS on_, count(*) % 4 = 0 AS fixed, bool_or(value > 100) AS moved FROM events GROUP BY ALL)
SELECT episode, object, CASE WHEN grasped THEN 'manipulated' WHEN inside THEN 'receptacle' WHEN on_ THEN 'support' WHEN fixed THEN 'fixture' WHEN moved THEN 'manipulated' ELSE 'fixture' END AS role FROM e""")
def _(spark, d):
    from ..operators.annotations import role_by_evidence
    v = F.col("value")
    e = L.table(spark, d, "events").groupBy(F.col("user_id").alias("episode"), F.col("event_type").alias("object")).agg(
        F.bool_or(v > 200).alias("grasped"), F.bool_or(v.between(150, 200)).alias("inside"), F.bool_or(v.between(120, 150)).alias("on"), (F.count(F.lit(1)) % 4 == 0).alias("fixed"), F.bool_or(v > 100).alias("moved"))
    return e.select("episode", "object", role_by_evidence().alias("role"))


@query("pj19_pj09_names", "PJ19", "PJ9", sql="""
SELECT p_partkey, regexp_replace(p_name || '_' || p_size, '_[0-9]+$', '') AS synset, regexp_extract(p_brand, '#([0-9]+)$', 1) AS task, 'put the ' || split_part(p_name, ' ', 2) || ' on the ' || lower(p_type) AS instruction, CASE WHEN starts_with(p_type, 'S') THEN 'human' ELSE 'generated' END AS source FROM part""")
def _(spark, d):
    from ..operators import annotations as N
    p = L.table(spark, d, "part")
    name = F.concat("p_name", F.lit("_"), F.col("p_size").cast("string"))
    said = N.instruction("put the {} on the {}", F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_type"))
    return p.select("p_partkey", N.synset(name).alias("synset"), F.regexp_extract("p_brand", "#([0-9]+)$", 1).alias("task"), said.alias("instruction"),
                    F.when(F.col("p_type").startswith("S"), "human").otherwise("generated").alias("source"))


@query("pj20_pj21_commands_and_success", "PJ20", "PJ21", "SC11", sql="""
SELECT l_orderkey AS episode, bool_and(l_linenumber IN (1, 2)) AS binary, CASE WHEN bool_and(l_linenumber IN (1, 2)) THEN max(l_linenumber) = 2 END AS success, CASE WHEN bool_and(l_linenumber IN (1, 2)) THEN avg(l_linenumber - 1) END AS closed_share FROM lineitem GROUP BY 1""")
def _(spark, d):
    from ..operators import annotations as N
    li = L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), (F.col("l_linenumber") * 2.0 - 3.0).alias("action"), (F.col("l_linenumber") - 1).alias("reward"))
    g = li.groupBy("episode").agg(N.binary_command("action").alias("binary"), N.sparse_success("reward").alias("success"), F.avg(N.command("action")).alias("share"))
    return g.select("episode", "binary", "success", F.when(F.col("binary"), F.col("share")).alias("closed_share"))


@query("pj22_cylinder_fit", "PJ22", sql="""
WITH h AS (SELECT p_partkey, 1 + p_size % 5 AS x, 1 + p_partkey % 4 AS y, 1 + p_size % 3 AS z FROM part), g AS (SELECT *, [abs(y-z), abs(x-z), abs(x-y)] AS gap FROM h)
SELECT p_partkey, CASE WHEN list_min(gap) <= 0 THEN ['x','y','z'][list_position(gap, list_min(gap))] END AS axis FROM g""")
def _(spark, d):
    from ..operators.annotations import cylinder_axis
    h = F.array(1 + F.col("p_size") % 5, 1 + F.col("p_partkey") % 4, 1 + F.col("p_size") % 3)
    return L.table(spark, d, "part").select("p_partkey", cylinder_axis(h, 0).alias("axis"))


@query("pj27_observation_layout", "PJ27", "SC8", sql="""
SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])[1:7]), 5) + 0.0 AS pose_sum, round(list_sum(CAST(embedding AS DOUBLE[])[8:10]), 5) + 0.0 AS base_sum, round(list_sum(CAST(embedding AS DOUBLE[])[11:32]), 5) + 0.0 AS joint_sum FROM embeddings""")
def _(spark, d):
    parts = layout([("pose", 7), ("base", 3), ("joint", 22)], F.col("e"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    e = L.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", *[r6(total(a), 5).alias(f"{n}_sum") for n, a in parts.items()])


@query("fn_s7_finite_values", "FN-S7", sql=with_(RECORDS, "SELECT uid, CASE WHEN k % 9 <> 0 AND k % 9 <> 1 THEN round(price, 2) END AS price FROM records"))
def _(spark, d):
    from ..functions.text import finite_or_null
    k = F.col("o_orderkey")
    x = F.when(k % 9 == 0, F.lit(float("nan"))).when(k % 9 == 1, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return L.table(spark, d, "orders").select(k.alias("uid"), r6(finite_or_null(x), 2).alias("price"))


@query("wn22_last_attempt_by_turn", "WN22", sql="""
SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS final, CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN conv_id END AS variant_of FROM conversations""")
def _(spark, d):
    from ..operators.blocks import attach
    c = attach(L.table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], {"last": F.max("turn")})
    final = F.col("turn") == F.col("last")
    return c.select("conv_id", "turn", final.alias("final"), F.when(~final, F.col("conv_id")).alias("variant_of"))


