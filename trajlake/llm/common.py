"""Helpers the training-data operators share: tables written between jobs, and folds of the rows."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: ASCII white space, the only white space the text contracts know.
BLANK = r"[\t-\r ]"
#: Runs of white space other than one single space: all that a replacement by one space changes.
BLANK_RUN = r"[\t-\r][\t-\r ]*| [\t-\r ]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``. An own one only in local mode, where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: several later branches read it, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def one_space(text: str | Column) -> Column:
    """Every run of white space becomes one space; null becomes the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")
