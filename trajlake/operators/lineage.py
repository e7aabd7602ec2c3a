"""Intermediates that several branches of one query read, and the folder all machines share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; an own one only in local mode, where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-trajlake-")
    return _OWN[app]


def cut(df: DataFrame) -> DataFrame:
    """An intermediate that several later branches read: written once below the shared folder and read back.

    Plans behind it start from a scan, so neither their size nor their analysis grows with what led there, nothing stays
    cached in the session, and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/part-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
