"""Streaming queries, run to the end of what is there and compared with their batch result."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sequence as S
from ..operators.blocks import number_rows
from ..operators.lineage import shared_folder
from ..sources import landing as L
from ..streaming import incremental as I
from .registry import query, r6
from .sequences import islands
from .sqlbase import FRAMES, with_


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"


@query("st01_running_counters", "ST1", "AG9", sql="""
WITH r AS (SELECT o_orderstatus AS family, CASE o_orderkey % 7 WHEN 0 THEN 'excluded' WHEN 1 THEN 'error' WHEN 2 THEN 'read_error' ELSE 'ok' END AS status, o_orderkey % 3 <> 0 AS k, o_orderkey % 5 <> 0 AS pt, o_orderkey % 4 = 1 AS p FROM orders)
SELECT family, count(*) AS episodes, count(*) FILTER (WHERE status = 'excluded') AS excluded, count(*) FILTER (WHERE k) AS "K", count(*) FILTER (WHERE pt) AS "P_tested", count(*) FILTER (WHERE k AND pt AND p) AS "K_and_P", count(*) FILTER (WHERE status IN ('error', 'read_error')) AS errors FROM r GROUP BY family""")
def _(spark, d):
    k = F.col("o_orderkey")
    stream = I.watch_table(spark, d, "orders.parquet")
    none = F.array().cast("array<string>")
    status = F.when(k % 7 == 0, "excluded").when(k % 7 == 1, "error").when(k % 7 == 2, "read_error").otherwise("ok")
    rec = stream.select(F.col("o_orderstatus").alias("family"), status.alias("status"), F.lit(None).cast("string").alias("file"),
                        F.struct((k % 3 != 0).alias("passed"), none.alias("reasons")).alias("K"),
                        F.when(k % 5 != 0, F.struct((k % 4 == 1).alias("passed"), none.alias("reasons"))).alias("P"))
    out = _folder(spark, "counters")
    I.run_available(I.running_counters(rec, ["family"]), I.replace_result(f"{out}/result"), f"{out}/checkpoint", "complete")
    return spark.read.parquet(f"{out}/result").select("family", "episodes", "excluded", "K", "P_tested", "K_and_P", "errors")


@query("st02_published_once", "ST2", "SK10", sql="SELECT DISTINCT 'f/' || l_partkey AS path FROM lineitem")
def _(spark, d):
    stream = I.watch_table(spark, d, "lineitem.parquet").select(F.concat(F.lit("f/"), F.col("l_partkey").cast("string")).alias("path"))
    out = _folder(spark, "published")
    I.run_available(stream, I.publish_once(f"{out}/result", "path"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/result").select("path")


@query("st03_incremental_index", "ST3", sql="""
SELECT user_id AS uid, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type, round(arg_max(value, (epoch_us(ts), event_id)), 4) AS value FROM events GROUP BY user_id""")
def _(spark, d):
    stream = I.watch_table(spark, d, "events.parquet").select(F.col("user_id").alias("uid"), "event_type", "value", L.micros("ts").alias("us"), "event_id")
    out = _folder(spark, "index")
    I.run_available(stream, I.append_changes(f"{out}/result"), f"{out}/checkpoint")
    return I.current_index(spark, f"{out}/result", "uid", ["us", "event_id"]).select("uid", "event_type", r6("value", 4).alias("value"))


@query("st04_live_runs", "ST4", "WN9", sql=with_(FRAMES, islands("frames", "event_type") + " SELECT episode, label, start, stop FROM runs"))
def _(spark, d):
    stream = I.watch_table(spark, d, "events.parquet").select(F.col("user_id").alias("episode"), L.micros("ts").alias("us"), "event_id", F.col("event_type").alias("label"))

    def find(frames):
        rows = number_rows(frames, ["episode"], ["us", "event_id"], F.floor(F.col("us") / L.DAY_US))
        return S.runs(rows.select("episode", "row", "label"), F.col("label"), L.FRAMES).select("episode", "label", "start", "stop")

    out = _folder(spark, "runs")
    I.run_available(stream, I.keep_runs(f"{out}/frames", f"{out}/result", "episode", find), f"{out}/checkpoint")
    return I.current_runs(spark, f"{out}/result", "episode").select("episode", "label", "start", "stop")
