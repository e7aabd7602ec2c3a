"""Streams of records, published files, index rows and live frames.

Every sink is idempotent per micro-batch: a batch writes below its own epoch folder, so a batch that is
repeated after a lost driver or executor replaces what it wrote before.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import STAGES, stage_flags

#: Hash partitions of the tables a sink looks into again.
BUCKETS = 64


def watch_json(spark: SparkSession, path: str, schema, *, files_per_batch: int = 1000) -> DataFrame:
    """Record files as they arrive (declared schema, bounded batches)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def watch_table(spark: SparkSession, folder: str, file: str, *, files_per_batch: int = 1000) -> DataFrame:
    """A landed Parquet file read as a stream, in bounded batches."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there now, in order, and stop; a later call continues after it."""
    query: StreamingQuery = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()


def running_counters(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stage counters over all records so far (complete mode; the state is one row per group)."""
    flags = stage_flags()
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("episodes"), *[F.sum(flags[s].cast("long")).alias(s) for s in STAGES if s != "source"])


def replace_result(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps the latest complete result."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return write


def publish_once(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Sink that publishes each key once over the life of the stream: keys of earlier epochs are left out.

    The published table is partitioned by a hash of the key; a batch reads the partitions its own keys fall into. No
    watermark is involved, so a key that arrives late is published like any other."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates([key]).withColumn("bucket", bucket)
        if epoch > 0:
            own = [r["bucket"] for r in new.select("bucket").distinct().collect()]
            earlier = batch.sparkSession.read.parquet(path).where((F.col("epoch") < epoch) & F.col("bucket").isin(own)).select(key)
            new = new.join(earlier, key, "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")
    return write


def append_changes(path: str) -> Callable[[DataFrame, int], None]:
    """Sink of an incremental index: each epoch's rows are appended as they are, nothing is rewritten."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def current_index(spark: SparkSession, path: str, key: str, order: Sequence[str]) -> DataFrame:
    """The latest row of every key over all epochs (last write wins)."""
    changes = spark.read.parquet(path)
    columns = [c for c in changes.columns if c not in (key, "epoch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("epoch", *order)).alias("r")).select(key, "r.*")


def compact(spark: SparkSession, path: str, target: str, key: str, order: Sequence[str]) -> None:
    """Rewrite an incremental index as its current rows."""
    current_index(spark, path, key, order).write.mode("overwrite").parquet(f"{target}/epoch=0")


def keep_runs(frames_path: str, runs_path: str, episode: str, find: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Sink that keeps the runs of every episode right as frames arrive, in any order.

    Each epoch's frames are appended as they are. The episodes it touches get their runs anew from all their frames so far,
    by ``find``: a late frame changes the runs it belongs to, and the run at the end of an episode is there while it is
    still growing. Frames are partitioned by a hash of the episode, so a batch reads the partitions of its own episodes."""
    bucket = F.pmod(F.xxhash64(episode), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{frames_path}/epoch={epoch}")
        stored = batch.sparkSession.read.parquet(frames_path).where(F.col("epoch") <= epoch)
        touched = stored.where(F.col("epoch") == epoch).select(episode, "bucket").distinct()
        own = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
        frames = stored.where(F.col("bucket").isin(own)).drop("epoch", "bucket").join(touched.select(episode), episode, "left_semi")
        find(frames).write.mode("overwrite").parquet(f"{runs_path}/epoch={epoch}")
    return write


def current_runs(spark: SparkSession, path: str, episode: str) -> DataFrame:
    """The runs of every episode as of the last epoch that touched it."""
    every = spark.read.parquet(path)
    last = every.groupBy(episode).agg(F.max("epoch").alias("epoch"))
    return every.join(last, [episode, "epoch"]).drop("epoch")
