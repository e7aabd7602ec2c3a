"""Batch assignment: prefix cover, greedy packing, budgets, samples."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, OWN, Axis, neighbourhood, number_rows, running


def prefix_cover(catalog: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """The selector of each chosen entry: the shortest folder whose usable entries are all chosen, that holds more
    than one entry and at most ``most`` bytes; else its own id.

    ``chosen``: id, transfer, scratch. Folder totals are pre-aggregated per task before they meet."""
    def folders(df: DataFrame) -> DataFrame:
        parts = F.split("id", "/")
        made = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
        return df.where(F.size(parts) > 1).withColumn("folder", F.explode(made))

    usable = folders(catalog.where("usable").select("id")).groupBy("folder").agg(F.count(F.lit(1)).alias("__usable"))
    inside = folders(chosen).groupBy("folder").agg(F.count(F.lit(1)).alias("__n"), F.sum("transfer").alias("__bytes"))
    whole = inside.join(usable, "folder").where((F.col("__n") == F.col("__usable")) & (F.col("__n") > 1) & (F.col("__bytes") <= most)).select("folder")
    best = folders(chosen.select("id")).join(whole, "folder").groupBy("id").agg(F.min_by("folder", F.length("folder")).alias("__best"))
    return chosen.join(best, "id", "left").withColumn("selector", F.coalesce("__best", "id")).drop("__best")


@dataclass(frozen=True)
class Limits:
    """When a batch closes: before an item that would exceed ``most`` (or ``scratch``), once ``target`` is reached, or
    at ``count`` items."""

    most: float
    target: float = float("inf")
    scratch: float = float("inf")
    count: int = 200


def _next_start(size: np.ndarray, scratch: np.ndarray, segment: np.ndarray, lim: Limits) -> np.ndarray:
    """For every item, where the next batch starts if one starts here (within the items given)."""
    n = len(size)
    i = np.arange(n)
    total, before = np.cumsum(size), np.cumsum(size) - size
    used, used_before = np.cumsum(scratch), np.cumsum(scratch) - scratch
    end = np.minimum(i + lim.count, n)
    end = np.minimum(end, np.searchsorted(total, before + lim.most, side="right"))
    if np.isfinite(lim.scratch):
        end = np.minimum(end, np.searchsorted(used, used_before + lim.scratch, side="right"))
    if np.isfinite(lim.target):
        end = np.minimum(end, np.searchsorted(total, before + lim.target, side="left") + 1)
    change = np.flatnonzero(segment[1:] != segment[:-1]) + 1
    if len(change):
        bound = np.append(change, n)
        end = np.minimum(end, bound[np.searchsorted(change, i, side="right")])
    return np.maximum(end, i + 1)


def pack(items: DataFrame, axis: Axis, lim: Limits, *, size: str, scratch: str | None = None, segment: str | None = None) -> DataFrame:
    """Greedy consecutive packing: adds ``batch`` (from 0 per group) to items numbered without gaps.

    Packing is sequential, but where a batch may start depends only on a bounded stretch, because a batch
    holds at most ``lim.count`` items. So each block of items is turned into a small table "entered at offset e,
    left at offset x of the next block", those tables are chained per group (one row per block), and each
    block then marks its own starts. No task ever holds more than one block or one row per block."""
    reach = lim.count
    if axis.span < 2 * reach:
        raise ValueError("blocks must be longer than two batches")
    work = items.select(*axis.keys, axis.order, F.col(size).cast("double").alias("__s"),
                        (F.col(scratch) if scratch else F.lit(0)).cast("double").alias("__c"),
                        (F.col(segment).cast("string") if segment else F.lit("")).alias("__g"))
    blocks = neighbourhood(work, axis, after=reach)
    keys = list(axis.keys)
    spec = items.select(*keys, axis.order).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.fields if f.name in keys)
    order, width = axis.order, int(axis.span)

    def steps_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        pdf = pdf.sort_values(order, kind="stable")
        step = _next_start(pdf["__s"].to_numpy(), pdf["__c"].to_numpy(), pdf["__g"].to_numpy(), lim)
        return pdf, step, int(pdf[OWN].sum())

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, step, own = steps_of(pdf)
        leave = np.arange(len(step) + 1)
        for i in range(own - 1, -1, -1):
            leave[i] = leave[step[i]] if step[i] < own else step[i]
        out = [int(leave[e]) - own if e < own else e - own for e in range(min(reach, own))]
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, BLOCK: [pdf[BLOCK].iloc[0]], "__exits": [out]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK, kind="stable")
        at, entries = 0, []
        for row in pdf["__exits"]:
            entries.append(at)
            at = int(row[at]) if at < len(row) else at - len(row)
        return pdf[[*keys, BLOCK]].assign(__entry=entries)

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = int(pdf["__entry"].iloc[0])
        pdf, step, own = steps_of(pdf)
        marks = np.zeros(len(step), dtype="int64")
        at = entry
        while at < own:
            marks[at] = 1
            at = int(step[at])
        return pdf.assign(__open=marks)[[*keys, order, "__open"]][pdf[OWN].to_numpy()]

    grouped = blocks.groupBy(*keys, BLOCK).applyInPandas(exits, f"{kinds}, {BLOCK} long, __exits array<long>")
    entered = grouped.groupBy(*keys).applyInPandas(chain, f"{kinds}, {BLOCK} long, __entry long")
    order_kind = spec[order].dataType.simpleString()
    marked = blocks.join(entered, [*keys, BLOCK]).groupBy(*keys, BLOCK).applyInPandas(starts, f"{kinds}, `{order}` {order_kind}, __open long")
    counted = running(items.join(marked, [*keys, order]), axis, {"batch": ("sum", F.col("__open"))})
    return counted.withColumn("batch", (F.col("batch") - 1).cast("long")).drop("__open")


def merge_small_tail(batches: DataFrame, keys: Sequence[str], small: float, lim: Limits) -> DataFrame:
    """Renumber a group's last batch into the one before when it is small and both fit one batch.

    ``batches``: keys, batch, transfer, scratch, units (one row each). Adds ``job``."""
    last = batches.groupBy(*keys).agg(F.max("batch").alias("__last"))
    tail = batches.join(last, list(keys))
    tail = tail.where(F.col("batch") >= F.col("__last") - 1).groupBy(*keys, "__last").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("transfer").alias("__t"), F.sum("scratch").alias("__c"), F.sum("units").alias("__u"),
        F.max_by("transfer", "batch").alias("__lt"))
    joins = (F.col("__n") == 2) & (F.col("__lt") < small) & (F.col("__t") <= lim.most) & (F.col("__c") <= lim.scratch) & (F.col("__u") <= lim.count)
    verdict = tail.select(*keys, "__last", joins.alias("__join"))
    return batches.join(verdict, list(keys)).withColumn("job", F.when(F.col("__join") & (F.col("batch") == F.col("__last")), F.col("batch") - 1).otherwise(F.col("batch"))) \
                  .drop("__last", "__join")


def shards(units: DataFrame, target: int) -> DataFrame:
    """Shards of large units: n = ceil(episodes / target) of them, shard k with every n-th episode."""
    n = F.ceil(F.col("episodes") / target)
    out = units.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return out.withColumn("shard_episodes", F.ceil((F.col("episodes") - F.col("k")) / F.col("n")))


def upper_median(values: DataFrame, keys: Sequence[str], value: str, name: str, span: float) -> DataFrame:
    """``sorted[n // 2]`` per group, from counts of distinct values (no sorted list is gathered)."""
    counts = values.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running(counts, Axis(tuple(keys), "__v", span), {"__upto": ("sum", F.col("__c"))})
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    mid = F.floor(F.col("__n") / 2)
    inside = (F.col("__upto") - F.col("__c") <= mid) & (mid < F.col("__upto"))
    return ranked.join(sizes, list(keys)).groupBy(*keys).agg(F.max(F.when(inside, F.col("__v"))).alias(name))


def budgeted(candidates: DataFrame, keys: Sequence[str], order: Column, estimate: str, want: Column, slots: int = 256) -> DataFrame:
    """Candidates in hash order while the running estimate before them is below the budget.

    The hex order key's leading digits slice a large group into evenly filled blocks."""
    ordered = candidates.withColumns({"__key": order, "__slot": F.conv(F.substring(order, 1, 2), 16, 10).cast("double")})
    out = running(ordered, Axis(tuple(keys), "__slot", 256.0 / slots, ("__key",)), {"__got": ("sum", F.col(estimate))})
    return out.where(F.col("__got") - F.col(estimate) < want).drop("__key", "__slot", "__got")


def stratified(records: DataFrame, cell: str, passed: str, key: str, seed: int, per_cell: int, failed: int, slots: int = 256) -> DataFrame:
    """Up to ``per_cell`` passes and ``failed`` failures per cell, drawn by a seeded hash of the key.

    First the best of each (cell, verdict, slot), then the best of those few: no cell is ranked in one task."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    limit = F.when(F.col(passed), F.lit(per_cell)).otherwise(F.lit(failed))
    rows = records.withColumns({"__h": h, "__slot": F.pmod(h, F.lit(slots))})
    first = Window.partitionBy(cell, passed, "__slot").orderBy("__h", key)
    few = rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= limit)
    second = Window.partitionBy(cell, passed).orderBy("__h", key)
    return few.withColumn("__r", F.row_number().over(second)).where(F.col("__r") <= limit).drop("__h", "__slot", "__r")


def one_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key by ``order`` (pre-aggregated)."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__b")).select(key, "__b.*")


def hash_order(*parts: Column) -> Column:
    """Reproducible pseudo-random order key."""
    return F.sha1(F.concat_ws("/", *parts).cast("binary"))


def shard_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, k: int, n: int) -> DataFrame:
    """Every n-th row of a group, starting at the k-th."""
    return number_rows(df, keys, order, bucket, name="__pos").where(F.pmod(F.col("__pos"), F.lit(n)) == k).drop("__pos")


def demo_ranges(text: str) -> list[tuple[int, int]]:
    """``"0-9,25"`` as inclusive ranges."""
    made = []
    for part in text.split(","):
        first, _, last = part.partition("-")
        made.append((int(first), int(last or first)))
    return made


def in_ranges(value: Column, text: str) -> Column:
    test = F.lit(False)
    for first, last in demo_ranges(text):
        test = test | value.between(first, last)
    return test


__all__ = ["Limits", "budgeted", "hash_order", "in_ranges", "merge_small_tail", "one_per_key", "pack", "prefix_cover",
           "shard_rows", "shards", "stratified", "upper_median"]
