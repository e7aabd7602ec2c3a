"""SQL twins of the landing projections, as common table expressions."""
from __future__ import annotations

import re

FRAMES = """
frames0 AS (
  SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000.0::DOUBLE AS t,
         event_id, event_type, value, value / 500.0::DOUBLE AS opening, event_type IN ('click', 'purchase') AS closed,
         value / 25.0::DOUBLE - pi() AS yaw
  FROM events),
frames AS (
  SELECT *, opening * cos(row / 10.0::DOUBLE) AS x, opening * sin(row / 10.0::DOUBLE) AS y, value / 1000.0::DOUBLE AS z,
         CASE WHEN closed THEN event_id % 3 END AS label FROM frames0)"""

OBJECTS = """
objects0 AS (
  SELECT user_id AS episode, event_type AS object, avg(value) / 500 AS ox, min(value) / 500 AS oy, max(value) / 2000 AS oz,
         0.01::DOUBLE + (count(*) % 5) / 100.0::DOUBLE AS hx, 0.01::DOUBLE + (count(*) % 7) / 100.0::DOUBLE AS hy,
         0.01::DOUBLE + (count(*) % 3) / 100.0::DOUBLE AS hz, count(*) AS n,
         CASE event_type WHEN 'click' THEN 'manipulated' WHEN 'purchase' THEN 'manipulated' WHEN 'signup' THEN 'receptacle'
              WHEN 'view' THEN 'support' WHEN 'error' THEN 'fixture' END AS role
  FROM events GROUP BY user_id, event_type)"""

OBJECT_FRAMES = FRAMES + "," + OBJECTS + """,
object_frames AS (
  SELECT f.*, o.object, o.role, o.hx, o.hy, o.hz, o.ox + 0.05::DOUBLE * sin(f.row * o.n / 20.0::DOUBLE) AS px,
         o.oy + 0.05::DOUBLE * cos(f.row * o.n / 20.0::DOUBLE) AS py, o.oz AS pz, (f.row + o.n) % 7 <> 0 AS valid
  FROM frames f JOIN objects0 o USING (episode))"""


def _unit(prefix: str, first: int) -> str:
    raw = [f"e[{first + i}]" for i in range(4)]
    n = "sqrt(" + " + ".join(f"{c}*{c}" for c in raw) + ")"
    sign = f"(CASE WHEN {raw[0]} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"
    return ", ".join(f"{c} / {n} * {sign} AS {prefix}{k}" for c, k in zip(raw, ("qw", "qx", "qy", "qz")))


POSES = f"""
poses0 AS (
  SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, vec_id,
         CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
poses AS (
  SELECT episode, row, vec_id, e[5] AS ax, e[6] AS ay, e[7] AS az, {_unit("a", 1)},
         e[12] AS bx, e[13] AS "by", e[14] AS bz, {_unit("b", 8)}, {_unit("h", 26)}, e[15:36] AS q, e[37:58] AS qd,
         abs(e[59]) AS open_l, abs(e[60]) AS open_r FROM poses0)"""

RECORDS = """
records0 AS (
  SELECT o_orderkey AS uid, o_orderstatus AS family, o_orderpriority AS dataset, o_orderkey AS k, o_totalprice AS price,
         CAST(floor(o_totalprice) AS BIGINT) AS whole, 'task-' || (o_orderkey % 6) AS task, o_custkey AS worker,
         epoch_us(o_orderdate) AS at_us,
         CASE o_orderkey % 7 WHEN 0 THEN 'excluded' WHEN 1 THEN 'error' WHEN 2 THEN 'read_error' ELSE 'ok' END AS status
  FROM orders),
records1 AS (
  SELECT *, status NOT IN ('error', 'read_error') AND NOT (k % 7 = 0 AND k % 2 = 0) AS k_known, k % 3 <> 0 AS k_ok,
         k % 4 = 1 AS p_ok, whole % 997 AS pieces, status = 'ok' AND k % 11 <> 0 AS written,
         CASE WHEN status = 'excluded' THEN CASE WHEN k % 4 < 2 THEN 'no_meshes' ELSE 'no_object_poses' END END AS excluded,
         CASE WHEN status = 'excluded' THEN 'episode ' || (k % 50) || ' lacks part ' || (k % 3) || ' of the scene' END AS reason
  FROM records0),
records AS (
  SELECT *, k_known AND k % 5 <> 0 AS p_known,
         CASE WHEN NOT k_known OR k_ok THEN []::VARCHAR[]
              WHEN k % 2 = 0 THEN ['left TCP rotation residual ' || whole || ' rad > 0.05 rad at frame ' || k || ' (3 frames)',
                                   'speed limit exceeded: joint 5 at ' || whole || ' x limit']
              ELSE ['right hand-Nut' || k || ' relative pose drifts ' || whole || ' mm / 0.3 rad during frames 3-9'] END AS k_reasons,
         CASE WHEN NOT (k_known AND k % 5 <> 0) OR p_ok THEN []::VARCHAR[]
              WHEN k % 3 = 0 THEN ['grasp_drift: right/cube: ' || whole || ' m', 'tcp_tracking: left ' || whole || ' m']
              ELSE ['tcp_tracking: left ' || whole || ' m'] END AS p_reasons,
         CASE k % 4 WHEN 0 THEN ['right_arm', 'left_arm'] WHEN 1 THEN ['left_arm'] WHEN 2 THEN ['head', 'base', 'left_arm'] END AS body_parts,
         CASE k % 4 WHEN 0 THEN 'tabletop' WHEN 1 THEN 'mobile_manipulation' WHEN 2 THEN 'navigation' END AS regime,
         CASE WHEN written THEN 'out/episodes/' || dataset || '/' || k || '.h5' END AS file,
         written AND k % 13 <> 0 AS has_scene, price / 1000 AS seconds, price / 5000 AS duration,
         CAST(200 + pieces AS DOUBLE) AS rss_mb
  FROM records1)"""

CATALOG = """
catalog0 AS (
  SELECT p_partkey AS key, lower(replace(p_brand, '#', '')) AS family, p_size,
         lower(p_type) || '/' || replace(p_name, ' ', '/') || '/f' || p_partkey ||
         CASE p_partkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.json' ELSE '.h5' END AS path,
         CASE WHEN p_partkey % 10 <> 0 THEN sha256(CAST(p_partkey AS VARCHAR)) END AS sha256,
         CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS BIGINT) * 10000000 + p_partkey END AS size,
         CASE p_partkey % 6 WHEN 0 THEN 'range_package' WHEN 1 THEN 'range_member' WHEN 2 THEN 'file_images_embedded'
              WHEN 3 THEN 'tar_stream' ELSE 'file' END AS kind,
         CASE p_partkey % 3 WHEN 0 THEN 'assets' WHEN 1 THEN 'low_dim' END AS content,
         'license-' || (p_partkey % 4) AS license, p_partkey % 9 <> 0 AS usable, CAST(p_size AS BIGINT) * 4000000 AS stored_size,
         CASE WHEN p_partkey % 12 <> 0 THEN CAST(p_size AS BIGINT) * 9000000 END AS inflated_size, p_retailprice AS price
  FROM part),
catalog AS (SELECT *, family || '/' || path AS id FROM catalog0)"""

LEDGER = CATALOG + """,
sold AS (SELECT l_partkey AS key, count(*) AS n, max(epoch_us(l_shipdate)) AS fetched_us FROM lineitem GROUP BY l_partkey),
ledger AS (
  SELECT c.key, c.id, c.family, c.kind, 'raw/' || c.id AS local_path, coalesce(c.size, 0) AS bytes, s.n, s.fetched_us,
         sha256(c.key || CASE WHEN s.n % 13 = 0 THEN 'x' ELSE '' END) AS sha256_verified
  FROM catalog c JOIN sold s USING (key) WHERE s.n % 4 <> 3),
listing AS (
  SELECT local_path AS path, bytes AS size,
         CASE WHEN n % 11 = 0 THEN sha256('changed' || key) ELSE sha256_verified END AS sha256
  FROM ledger WHERE n % 17 <> 0)"""


def with_(base: str, select: str) -> str:
    """A statement over a base projection; ``select`` may start with further table expressions."""
    select = select.strip()
    if re.match(r"^\w+ AS (MATERIALIZED )?\(", select):
        return f"WITH {base.strip()},\n{select}"
    return f"WITH {base.strip()}\n{select}"


def reason_kind(text: str) -> str:
    """SQL for the bucket of a failure reason."""
    words = f"split_part(trim({text}), ':', 1)"
    words = f"regexp_replace({words}, '\\b(left|right)\\b\\s*', '', 'g')"
    words = f"regexp_replace({words}, '\\bhand-\\S+', 'hand-object', 'g')"
    words = f"(' ' || trim(regexp_replace({words}, '\\s+', ' ', 'g')))"
    words = f"regexp_replace({words}, ' (\\S*[0-9]\\S*|<|>|=|<=|>=|/|\\(\\S*)( .*)?$', '')"
    stop = "by|at|of|is|to|for|in|with|during|from|on|x"
    words = f"trim(regexp_replace({words}, '(?i)( ({stop}))+$', ''))"
    return (f"(CASE WHEN regexp_matches(trim({text}), '^[a-z][a-z0-9_]*:') THEN split_part(trim({text}), ':', 1) "
            f"WHEN {words} = '' THEN 'other' ELSE {words} END)")
