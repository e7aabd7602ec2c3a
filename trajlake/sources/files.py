"""Readers of the landed file formats. All are lazy and push projections and filters into the scan."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INT_COLUMNS, struct

Tables = dict[str, DataFrame]
SOURCES: dict[str, Callable[..., Tables]] = {}


def register_source(name: str):
    """Register a reader ``(spark, path, **options) -> {canonical table: DataFrame}`` for a source family."""
    def register(reader: Callable[..., Tables]):
        SOURCES[name] = reader
        return reader
    return register


def read_source(spark: SparkSession, name: str, path: str, **options) -> Tables:
    if name not in SOURCES:
        raise KeyError(f"unknown source family {name!r} (one of {sorted(SOURCES)})")
    return SOURCES[name](spark, path, **options)


def read_typed_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated table (gzip or plain) whose header may type a column as ``name:int``; empty cells are null."""
    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", "").option("quote", "").csv(path)
    out = []
    for name in raw.columns:
        base, _, kind = name.partition(":")
        cell = F.col(f"`{name}`")
        if kind == "int" or base in INT_COLUMNS:
            cell = cell.cast("long")
        elif base == "usable":
            cell = F.lower(cell).isin("1", "true", "yes")
        out.append(cell.alias(base))
    return raw.select(*out)


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines under a declared schema (no inference pass), with the file each row came from."""
    names = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(struct(schema)).json(names).withColumn("source_file", F.col("_metadata.file_path"))


def read_records(spark: SparkSession, roots: Sequence[str], schema: str, family: str = "*") -> DataFrame:
    """Build records of several output roots: ``<root>/records/<family>/*.jsonl``."""
    return read_json_lines(spark, [f"{r.rstrip('/')}/records/{family}/*.jsonl" for r in roots], schema)


def read_ledger(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One JSON record per verified file below ``root``; the last file by path wins for an id."""
    raw = spark.read.schema(struct(schema)).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(root)
    columns = raw.columns
    keyed = raw.select("*", F.col("_metadata.file_path").alias("__file"))
    best = F.max_by(F.struct(*[c for c in columns if c != "id"]), "__file")
    return keyed.groupBy("id").agg(best.alias("r")).select("id", "r.*")


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Text lines with a position that follows file order and place."""
    raw = spark.read.text(list(paths))
    return raw.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).alias("line"))


def read_trajectories(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One Parquet file per episode: the named columns only, the episode taken from the file name."""
    raw = spark.read.parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet$", 1)
    return raw.select(*[F.col(f"`{c}`") for c in columns], name.alias("episode"))


def layout(keys: Sequence[tuple[str, int]], array: Column) -> dict[str, Column]:
    """Named slices of a wide observation array, in key order."""
    out, start = {}, 1
    for name, width in keys:
        out[name] = F.slice(array, start, width)
        start += width
    return out


def read_task_names(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, "task_index int, task_name string, task string").select("task_index", "task_name")


def read_trajectory_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of trajectory metadata documents: environment, seed, success."""
    schema = ("env_info struct<env_id:string,max_episode_steps:int>, source_type string, "
              "episodes array<struct<episode_id:int,episode_seed:bigint,control_mode:string,elapsed_steps:int,success:boolean>>")
    raw = spark.read.schema(struct(schema)).option("multiLine", True).json(path)
    return raw.select("env_info.env_id", "source_type", F.explode("episodes").alias("e")).select("env_id", "source_type", "e.*")


def read_manifest(spark: SparkSession, path: str, robot: str) -> DataFrame:
    """Rows of a publisher manifest for one robot (the filter reaches the scan)."""
    return read_json_lines(spark, path, "robot string, task string, object string, path string").where(F.col("robot") == robot)


def small_file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Digests of files that fit a row (under 2 GB each)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    blob = F.concat(F.concat(F.lit("blob "), F.col("length").cast("string")).cast("binary"), F.unhex(F.lit("00")), F.col("content"))
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"), F.sha1(blob).alias("git_blob_sha1"))


def file_digests(spark: SparkSession, path: str, glob: str = "*", chunk: int = 1 << 20) -> DataFrame:
    """Digests of files of any size: paths and lengths come from the listing, each task streams its files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("bytes"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for name, size in zip(pdf["path"], pdf["bytes"]):
                system, local = fs.FileSystem.from_uri(name)
                sums = [hashlib.sha256(), hashlib.sha1(), hashlib.sha1(b"blob %d\0" % size)]
                with system.open_input_stream(local) as stream:
                    while block := stream.read(chunk):
                        for s in sums:
                            s.update(block)
                rows.append((name, size, *(s.hexdigest() for s in sums)))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256", "sha1", "git_blob_sha1"])

    return listed.repartition(F.col("path")).mapInPandas(digest, "path string, bytes long, sha256 string, sha1 string, git_blob_sha1 string")


@register_source("trajectory_parquet")
def _trajectory_parquet(spark: SparkSession, path: str, *, select: Column | None = None, columns: Sequence[str] = ("timestamp", "observation.state")) -> Tables:
    """Per-episode Parquet; ``select`` filters episodes by name before anything else is read."""
    frames = read_trajectories(spark, path, columns)
    return {"frames": frames if select is None else frames.where(select)}


def read_catalog(spark: SparkSession, path: str, *, family: str | None = None, tables: bool = True) -> DataFrame:
    """A written catalogue: all of it, one family, or without the rows of member tables. Both choices name partitions, so
    the other files are not opened. A family that was never written is refused."""
    found = spark.read.parquet(path)
    if family is not None:
        if found.where(F.col("family") == family).limit(1).isEmpty():
            raise KeyError(f"no catalogue for family {family!r}")
        found = found.where(F.col("family") == family)
    return found if tables else found.where(F.col("origin") == "inline")
