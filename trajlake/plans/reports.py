"""Record reports: stage counts, reasons, storage, tracking axes, evaluation, index."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import reports as R
from ..operators.blocks import number_rows
from ..sources import landing as L
from .registry import long, query, r6
from .sqlbase import RECORDS, reason_kind, with_

FLAGS = """flags AS (
  SELECT uid, family, dataset, true AS source, status = 'excluded' AS excluded,
         status = 'ok' OR (status = 'excluded' AND k_known) AS retargeted, k_known AND k_ok AS "K", p_known AS "P_tested",
         p_known AND p_ok AS "P", k_known AND k_ok AND p_known AND p_ok AS "K_and_P", written, status IN ('error', 'read_error') AS errors
  FROM records)"""
SUMS = ", ".join(f'CAST(sum(CAST("{s}" AS BIGINT)) AS BIGINT) AS "{s}"' for s in R.STAGES)


@query("pj11_stage_flags", "PJ11", sql=with_(RECORDS, FLAGS + ' SELECT uid, ' + ", ".join(f'"{s}"' for s in R.STAGES) + ' FROM flags'))
def _(spark, d):
    return L.records(spark, d).select("uid", *[c.alias(n) for n, c in R.stage_flags().items()])


@query("ag01_stage_counts", "AG1", "SC5", sql=with_(RECORDS, FLAGS + f"""
SELECT 'family' AS level, family AS name, {SUMS} FROM flags GROUP BY family
UNION ALL SELECT 'dataset', dataset, {SUMS} FROM flags GROUP BY dataset
UNION ALL SELECT 'total', 'total', {SUMS} FROM flags"""))
def _(spark, d):
    return R.stage_counts(L.records(spark, d))


@query("ag02_body_parts_and_regimes", "AG2", sql=with_(RECORDS, """
SELECT 'body_parts' AS what, array_to_string(list_sort(coalesce(body_parts, [])), ' + ') AS name, count(*) AS episodes
FROM records WHERE k_known AND k_ok GROUP BY ALL
UNION ALL SELECT 'regime', coalesce(regime, 'unknown'), count(*) FROM records WHERE k_known AND k_ok GROUP BY ALL"""))
def _(spark, d):
    rec = L.records(spark, d)
    a = R.body_part_counts(rec).select(F.lit("body_parts").alias("what"), F.col("body_parts").alias("name"), "episodes")
    return a.unionByName(R.regime_counts(rec).select(F.lit("regime").alias("what"), F.col("regime").alias("name"), "episodes"))


@query("ag03_exclusion_reasons", "AG3", "TK1", "FN-S6", sql=with_(RECORDS, """
SELECT excluded || ': ' || substr(regexp_replace(reason, '\\d+', '#', 'g'), 1, 120) AS reason, count(*) AS episodes
FROM records WHERE status = 'excluded' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"""))
def _(spark, d):
    return R.exclusion_reasons(L.records(spark, d))


@query("ag04_storage_per_episode", "AG4", sql=with_(RECORDS, """
SELECT dataset, count(*) AS episodes, round(sum(pieces * 1000) / count(*) / 1e6, 4) AS episode_only,
       round((sum(pieces * 1000) + sum((pieces % 10) * 7000)) / count(*) / 1e6, 4) AS with_library_share,
       round((sum(pieces * 1000) + sum(pieces * 3000)) / count(*) / 1e6, 4) AS with_own_assets
FROM records WHERE has_scene GROUP BY dataset"""))
def _(spark, d):
    out = R.storage_per_episode(L.records(spark, d))
    return out.select("dataset", "episodes", *[r6(c, 4).alias(c) for c in ("episode_only", "with_library_share", "with_own_assets")])


REASONS = f"""reasons AS (
  SELECT uid, task, tier, i, {reason_kind("r[i]")} AS kind FROM (
    SELECT uid, task, tier, r, unnest(range(1, len(r) + 1)) AS i FROM (
      SELECT uid, task, 'K' AS tier, k_reasons AS r FROM records UNION ALL SELECT uid, task, 'P', p_reasons FROM records)))"""


@query("ag05_failure_reasons", "AG5", "PJ12", sql=with_(RECORDS, REASONS + """,
counts AS (SELECT tier, kind, count(*) FILTER (WHERE i = 1) AS first, count(*) AS anywhere
  FROM (SELECT uid, tier, kind, min(i) AS i FROM reasons GROUP BY ALL) GROUP BY ALL),
ranked AS (SELECT tier, kind, unnest(['first', 'anywhere']) AS ranking, unnest([first, anywhere]) AS episodes FROM counts)
SELECT tier, ranking, kind, episodes FROM ranked WHERE episodes > 0
QUALIFY row_number() OVER (PARTITION BY tier, ranking ORDER BY episodes DESC, kind) <= 25"""))
def _(spark, d):
    return R.failure_reasons(L.records(spark, d))


@query("ag07_failed_only_reasons", "AG7", sql=with_(RECORDS, REASONS + """
SELECT tier, kind, count(*) FILTER (WHERE i = 1) AS first, count(*) AS anywhere
FROM (SELECT uid, tier, kind, min(i) AS i FROM reasons GROUP BY ALL) GROUP BY ALL"""))
def _(spark, d):
    return R.reason_counts(L.records(spark, d), failed_only=True)


@query("fns1_reason_buckets_of_texts", "FN-S1", "PJ12", sql=f"""
SELECT doc_id, md5({reason_kind("text")}) AS kind_md5, length({reason_kind("text")}) AS kind_length FROM documents""")
def _(spark, d):
    kind = text.reason_kind(F.col("text"))
    return (L.table(spark, d, "documents").select("doc_id", kind.alias("kind"))
            .select("doc_id", F.md5(F.col("kind").cast("binary")).alias("kind_md5"), long(F.length("kind")).alias("kind_length")))


def lines(spark, d):
    """Attempts of tracking records before they are numbered: one line item of an order is one attempt."""
    return L.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("uid"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("n"),
        F.col("l_suppkey").alias("supp"), (F.col("l_quantity") > 25).alias("passed"), (F.col("l_linenumber") > 2).alias("prescreen"))


def attempts(spark, d):
    """Attempts of tracking records in long form, in the order of their part."""
    li = lines(spark, d)
    li = number_rows(li, ["uid"], ["part", "n", "supp", "passed"], F.floor(F.col("part") / 64), name="attempt")
    file = F.concat(F.lit("e/"), F.col("part").cast("string"), F.lit("-"), F.col("n").cast("string"))
    return li.select("uid", "attempt", "passed", F.when(F.col("n") % 4 != 0, file).alias("file"), "prescreen")


def tracking_records(spark, d):
    """Tracking records: build records with scenario axes."""
    k = F.col("uid")
    scenario = F.struct((k % 10).cast("string").alias("cell"), (k % 4).cast("string").alias("neck"),
                        F.when(k % 3 == 0, "small").otherwise("large").alias("extent"),
                        (k % 5).cast("string").alias("speed"), F.when(k % 2 == 0, "rest").alias("start"),
                        (k % 6).cast("string").alias("base_motion"))
    return L.records(spark, d).select(
        "uid", "status", "K", "seconds", "duration", "task", "file", F.when(k % 9 != 0, scenario).alias("scenario"),
        F.concat(F.lit("src-"), (k % 3).cast("string")).alias("source_family"))


TRACK = RECORDS + """,
lines AS (SELECT l_orderkey AS uid, count(*) AS n, count(*) FILTER (WHERE l_linenumber > 2) AS pre FROM lineitem GROUP BY 1),
track AS (SELECT r.*, l.n, l.pre, r.uid % 9 <> 0 AS has_scenario FROM records r LEFT JOIN lines l USING (uid))"""


@query("ag06_tracking_axes", "AG6", "SC6", sql=with_(TRACK, """
axes AS (
  SELECT k_known AND k_ok AS ok, unnest(['cell', 'neck', 'extent', 'speed', 'start', 'base_motion']) AS axis,
         unnest([CAST(uid % 10 AS VARCHAR), CAST(uid % 4 AS VARCHAR), CASE WHEN uid % 3 = 0 THEN 'small' ELSE 'large' END,
                 CAST(uid % 5 AS VARCHAR), CASE WHEN uid % 2 = 0 THEN 'rest' END, CAST(uid % 6 AS VARCHAR)]) AS value
  FROM track WHERE has_scenario
  UNION ALL SELECT k_known AND k_ok, 'source', 'src-' || (uid % 3) FROM track WHERE NOT has_scenario)
SELECT axis, value, count(*) AS n, CAST(sum(CAST(ok AS BIGINT)) AS BIGINT) AS k FROM axes WHERE value IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    return R.axis_counts(tracking_records(spark, d))


@query("ag07_attempts_histogram", "AG7", sql=with_(TRACK, """
SELECT CAST(coalesce(n, 1) AS BIGINT) AS attempts, count(*) AS episodes FROM track GROUP BY 1"""))
def _(spark, d):
    return R.attempt_histogram(tracking_records(spark, d), lines(spark, d))


@query("ag07_tracking_totals", "AG7", sql=with_(TRACK, """
SELECT count(*) AS total, count(*) FILTER (WHERE k_known AND k_ok) AS k_passed,
       count(*) FILTER (WHERE status IN ('error', 'read_error')) AS errors, CAST(coalesce(sum(pre), 0) AS BIGINT) AS prescreen,
       round(sum(seconds), 3) AS seconds, round(sum(duration), 3) AS duration_s,
       round(sum(CASE WHEN k_known AND k_ok THEN duration ELSE 0 END), 3) AS k_duration_s FROM track"""))
def _(spark, d):
    t = R.tracking_totals(tracking_records(spark, d), lines(spark, d))
    return t.select("total", "k_passed", "errors", "prescreen", *[r6(c, 3).alias(c) for c in ("seconds", "duration_s", "k_duration_s")])


@query("ag08_evaluation_table", "AG8", sql=with_(RECORDS, """
SELECT task, count(*) AS n, count(*) FILTER (WHERE k_known AND k_ok) AS k, count(*) FILTER (WHERE p_known AND p_ok) AS p,
       count(*) FILTER (WHERE k_known AND k_ok AND p_known AND p_ok) AS k_and_p, round(avg(seconds), 4) AS seconds
FROM records GROUP BY task"""))
def _(spark, d):
    t = R.evaluation_table(L.records(spark, d))
    return t.withColumn("seconds", r6("seconds", 4))


@query("ag08_task_reasons", "AG8", sql=with_(RECORDS, REASONS + """,
counts AS (SELECT task, tier, kind, count(DISTINCT uid) AS episodes FROM reasons GROUP BY ALL)
SELECT task, tier, kind, episodes FROM counts
QUALIFY row_number() OVER (PARTITION BY task, tier ORDER BY episodes DESC, kind) <= CASE tier WHEN 'K' THEN 6 ELSE 8 END"""))
def _(spark, d):
    return R.task_reasons(L.records(spark, d))


@query("ag09_build_counters", "AG9", sql=with_(RECORDS, """
SELECT count(*) FILTER (WHERE status <> 'read_error') AS episodes, count(*) FILTER (WHERE status IN ('error', 'read_error')) AS errors,
       count(*) FILTER (WHERE status = 'excluded') AS excluded, count(*) FILTER (WHERE written) AS written,
       count(*) FILTER (WHERE k_known AND k_ok) AS k, count(*) FILTER (WHERE p_known) AS p_tested,
       count(*) FILTER (WHERE p_known AND p_ok) AS p, max(rss_mb) AS max_rss_mb FROM records"""))
def _(spark, d):
    return R.build_counters(L.records(spark, d))


def _index_records(spark, d):
    """Records with their index entries: the order's own row, and one per line item with an odd number."""
    rec = L.records(spark, d)
    row = lambda uid, file: F.struct(uid.alias("uid"), file.alias("file"), F.col("family"), F.col("dataset"),
                                     F.col("K.passed").alias("tier_k_passed"), F.col("P.passed").alias("tier_p_passed"),
                                     F.col("duration"))
    li = L.table(spark, d, "lineitem").where(F.col("l_linenumber") % 2 == 1).groupBy(F.col("l_orderkey").alias("uid")).agg(
        F.collect_set("l_linenumber").alias("n"))
    file = F.concat_ws("/", "dataset", F.col("uid").cast("string"))
    tries = F.transform("n", lambda x: row(F.concat_ws("-try", F.col("uid").cast("string"), x.cast("string")),
                                           F.concat(file, F.lit("-"), x.cast("string"))))
    return rec.join(li, "uid", "left").select(
        F.when(F.col("file").isNotNull(), row(F.col("uid").cast("string"), file)).alias("index_row"), tries.alias("index_rows"))


INDEX = RECORDS + """,
tries AS (SELECT DISTINCT l_orderkey AS uid, l_linenumber AS n FROM lineitem WHERE l_linenumber % 2 = 1),
index_rows AS (
  SELECT CAST(uid AS VARCHAR) AS uid, dataset || '/' || uid AS file, family, dataset, CASE WHEN k_known THEN k_ok END AS tier_k_passed,
         CASE WHEN p_known THEN p_ok END AS tier_p_passed, duration FROM records WHERE file IS NOT NULL
  UNION ALL
  SELECT uid || '-try' || n, dataset || '/' || uid || '-' || n, family, dataset, CASE WHEN k_known THEN k_ok END,
         CASE WHEN p_known THEN p_ok END, duration FROM records JOIN tries USING (uid)),
files AS (
  SELECT CASE WHEN k % 3 = 0 THEN 'episodes/' ELSE '' END || dataset || '/' || uid AS path FROM records WHERE k % 5 <> 0
  UNION ALL SELECT dataset || '/' || uid || '-' || n FROM records JOIN tries USING (uid) WHERE (k + n) % 3 <> 0)"""


@query("sk02_index_from_records", "SK2", "SK1", "JN7", "SO1", sql=with_(INDEX, """
SELECT uid, coalesce(a.path, b.path) AS file, family, dataset, tier_k_passed, tier_p_passed, round(duration, 6) AS duration
FROM index_rows LEFT JOIN files a ON a.path = file LEFT JOIN files b ON b.path = 'episodes/' || file
WHERE a.path IS NOT NULL OR b.path IS NOT NULL"""))
def _(spark, d):
    rec = L.records(spark, d)
    own = F.concat_ws("/", "dataset", F.col("uid").cast("string"))
    files = rec.where(F.col("uid") % 5 != 0).select(
        F.concat(F.when(F.col("uid") % 3 == 0, "episodes/").otherwise(""), own).alias("path"))
    li = L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("n"))
    li = li.where((F.col("n") % 2 == 1) & ((F.col("uid") + F.col("n")) % 3 != 0)).distinct()
    tries = rec.join(li, "uid").select(F.concat(own, F.lit("-"), F.col("n").cast("string")).alias("path"))
    out = R.resolve_files(R.index_rows(_index_records(spark, d)), files.unionByName(tries))
    return out.withColumn("duration", r6("duration"))


@query("sc14_index_scan", "SC14", sql=with_(INDEX, """
SELECT uid, file FROM index_rows WHERE family = 'F' AND tier_k_passed AND coalesce(tier_p_passed, false)"""))
def _(spark, d):
    rows = R.index_rows(_index_records(spark, d))
    return rows.where((F.col("family") == "F") & F.col("tier_k_passed") & F.coalesce("tier_p_passed", F.lit(False))).select("uid", "file")


@query("sc15_written_episodes", "SC15", "WN22", "SO1", sql=with_(TRACK, """
tries AS (SELECT l_orderkey AS uid, l_linenumber AS n, l_partkey AS part,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_quantity > 25) AS pos,
            count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem)
SELECT t.uid, CAST(r.pos - 1 AS BIGINT) AS attempt, r.pos = r.size AS final, CASE WHEN r.pos < r.size THEN t.uid END AS variant_of,
       'e/' || r.part || '-' || r.n AS file FROM track t JOIN tries r USING (uid) WHERE r.n % 4 <> 0
UNION ALL SELECT uid, 0, true, NULL, file FROM track WHERE n IS NULL AND file IS NOT NULL"""))
def _(spark, d):
    return R.written_episodes(tracking_records(spark, d), attempts(spark, d))
