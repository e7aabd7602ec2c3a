"""Writers: every table is written by all tasks, into a staging folder that is renamed when complete."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.control_views import MODES, view
from ..schema import EPISODE_INDEX, struct
from ..operators.blocks import Axis

#: Files a large family spreads over.
CATALOG_FILES = 64


def _publish(df: DataFrame, path: str, write) -> None:
    """Write beside the target and rename: a reader sees a whole table, the old or the new one, or for the moment between
    the two renames none; never part of one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    write(df, staging)
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = system.exists(target)
    if had:
        system.rename(target, old)
    system.rename(jvm.org.apache.hadoop.fs.Path(staging), target)
    if had:
        system.delete(old, True)


def index_table(rows: DataFrame) -> DataFrame:
    """Index rows in the fixed column order and types; a missing or extra column is refused."""
    schema = struct(EPISODE_INDEX)
    names = [f.name for f in schema.fields]
    if set(rows.columns) != set(names):
        raise ValueError(f"index columns {sorted(rows.columns)} != {sorted(names)}")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_index(rows: DataFrame, path: str) -> None:
    """Episode index sorted by file: range partitions keep the order without one big task."""
    _publish(index_table(rows).sort("file"), path, lambda df, p: df.write.parquet(p))


def write_episodes(frames: DataFrame, path: str, *, dataset: str = "dataset", keys: Sequence[str] = ("episode", "row")) -> None:
    """Canonical frames by dataset. Rows are ranged over (dataset, keys), so a huge episode becomes several files and
    the files of a dataset hold contiguous rows."""
    placed = frames.repartitionByRange(dataset, *keys).sortWithinPartitions(dataset, *keys)
    _publish(placed, path, lambda df, p: df.write.partitionBy(dataset).parquet(p))


def write_views(state: DataFrame, path: str, axis: Axis, modes: Sequence[str] = tuple(MODES)) -> None:
    """Materialised control views, one folder per mode (column metadata holds frame, units and meaning)."""
    for mode in modes:
        _publish(view(state, mode, axis), f"{path.rstrip('/')}/mode={mode}", lambda df, p: df.write.parquet(p))


def append_records(records: DataFrame, path: str, by: str = "family") -> None:
    """Records as JSON lines, errors included, one folder per family."""
    records.write.mode("append").partitionBy(by).json(path)


def bad_cells(rows: DataFrame) -> DataFrame:
    """Cells a tab-separated table cannot hold."""
    text = [c for c, t in rows.dtypes if t == "string"]
    hits = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").rlike("[\t\n]"), F.lit(c)) for c in text]))
    return rows.select(F.explode(hits).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("cells"))


def write_typed_tsv(rows: DataFrame, path: str, order: Sequence[str], ints: Sequence[str] = ()) -> None:
    """Gzip tab-separated table, sorted; integer columns are typed in the header. A tab or line feed in a cell is refused."""
    broken = sorted(r["column"] for r in bad_cells(rows).select("column").collect())
    if broken:
        raise ValueError(f"cells with a tab or a line feed in {', '.join(broken)}")
    named = rows.sort(*order).select(*[F.col(c).alias(f"{c}:int" if c in ints else c) for c in rows.columns])
    options = {"sep": "\t", "header": True, "compression": "gzip", "nullValue": "", "emptyValue": "", "quote": ""}
    _publish(named, path, lambda df, p: df.write.options(**options).csv(p))


def write_catalog(entries: DataFrame, path: str) -> None:
    """Catalogue entries by ``family`` and ``origin`` (``inline``, or ``table`` for the rows of member tables): readers of one family,
    or of inline entries, open no other files."""
    placed = entries.repartition("family", "origin", F.pmod(F.xxhash64("id"), F.lit(CATALOG_FILES))).sortWithinPartitions("family", "origin", "id")
    _publish(placed, path, lambda df, p: df.write.partitionBy("family", "origin").parquet(p))


def write_job_manifest(jobs: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Job lines without their planning statistics."""
    _publish(jobs.select(*columns), path, lambda df, p: df.write.json(p))


def write_checksums(files: DataFrame, path: str) -> None:
    """``<sha256>  ./<path>`` lines sorted by path."""
    lines = files.sort("path").select(F.format_string("%s  ./%s", "sha256", "path").alias("value"))
    _publish(lines, path, lambda df, p: df.write.text(p))


def new_assets(assets: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content-addressed merge without overwriting: assets not stored yet, and names stored with other content."""
    distinct = assets.groupBy("name").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("__hi"))
    have = existing.groupBy("name").agg(F.min("sha256").alias("__have"))
    joined = distinct.join(have, "name", "left")
    clash = (F.col("sha256") != F.col("__hi")) | (F.col("__have") != F.col("sha256"))
    bad = joined.where(F.coalesce(clash, F.col("sha256") != F.col("__hi"))).select("name")
    fresh = joined.where((F.col("sha256") == F.col("__hi")) & F.col("__have").isNull()).select("name", "sha256")
    return fresh, bad
