"""Ordered operators over per-episode rows that stay balanced when one episode is huge.

A plain ``Window.partitionBy("episode")`` sends a whole episode to one task. Recordings are short,
but nothing in a table enforces that, so every ordered operator here works on *blocks*: fixed-width
slices of an episode along its order column. Within a block an ordinary window runs; across blocks

* ``neighbourhood`` copies the few border rows a lag/lead needs into the adjacent block, and
* ``running`` adds the carry of the earlier blocks, computed from one row per block.

An episode shorter than a block is exactly one block, so the usual case costs no extra rows.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK, OWN = "__block", "__own"


@dataclass(frozen=True)
class Axis:
    """Row order inside a group: ``keys`` name the group, ``order`` the position, ``span`` the block width.

    ``single``: every group was found to be one block (``largest_group``), so no border is copied and no carry computed."""

    keys: tuple[str, ...] = ("episode",)
    order: str = "row"
    span: float = 65536.0
    ties: tuple[str, ...] = ()
    single: bool = False

    def by(self, order: str, span: float | None = None, ties: Sequence[str] = ()) -> "Axis":
        return replace(self, order=order, span=span or self.span, ties=tuple(ties), single=False)

    def within(self, *keys: str) -> "Axis":
        return replace(self, keys=(*self.keys, *keys))

    def block(self) -> Column:
        return F.floor(F.col(self.order) / F.lit(float(self.span))).cast("long")

    def window(self, reverse: bool = False) -> WindowSpec:
        names = [self.order, *self.ties]
        order = [F.col(n).desc() if reverse else F.col(n).asc() for n in names]
        return Window.partitionBy(*self.keys, *([] if self.single else [BLOCK])).orderBy(*order)

    def position(self) -> Column:
        return F.struct(self.order, *self.ties) if self.ties else F.col(self.order)


FRAMES = Axis()


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group, counted."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def neighbourhood(df: DataFrame, axis: Axis, before: float = 0, after: float = 0) -> DataFrame:
    """``df`` with a block column, where each block also holds the rows up to ``before`` earlier and
    ``after`` later than its own (in units of the order column). Copied rows have ``__own`` = false."""
    here = axis.block()
    df = df.withColumn(BLOCK, here)
    if axis.single or not before and not after:
        return df.withColumn(OWN, F.lit(True))
    offset = F.col(axis.order) - F.col(BLOCK) * F.lit(float(axis.span))
    places = [F.struct(F.col(BLOCK).alias("b"), F.lit(True).alias("own"))]
    if before:
        places.append(F.when(offset >= F.lit(float(axis.span - before)),
                             F.struct((F.col(BLOCK) + 1).alias("b"), F.lit(False).alias("own"))))
    if after:
        places.append(F.when(offset < F.lit(float(after)),
                             F.struct((F.col(BLOCK) - 1).alias("b"), F.lit(False).alias("own"))))
    return (df.withColumn("__place", F.explode(F.array_compact(F.array(*places))))
            .withColumn(BLOCK, F.col("__place.b")).withColumn(OWN, F.col("__place.own")).drop("__place"))


def own_rows(df: DataFrame, keep_block: bool = False) -> DataFrame:
    df = df.where(F.col(OWN)).drop(OWN)
    return df if keep_block else df.drop(BLOCK)


def shift(df: DataFrame, axis: Axis, values: Mapping[str, tuple[Column, int]], *, keep_block: bool = False) -> DataFrame:
    """Values of other rows of the group: ``{name: (expression, rows later)}`` (negative = earlier).

    The order column must number the rows of a group without gaps."""
    ahead = max([0, *(k for _, k in values.values())])
    behind = max([0, *(-k for _, k in values.values())])
    w = axis.window()
    out = neighbourhood(df, axis, before=behind, after=ahead)
    out = out.withColumns({name: F.lead(e, k).over(w) if k > 0 else F.lag(e, -k).over(w)
                           for name, (e, k) in values.items()})
    return own_rows(out, keep_block)


_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, axis: Axis, values: Mapping[str, tuple[str, Column]], *, reverse: bool = False,
            exclusive: bool = False, blocked: bool = False) -> DataFrame:
    """Running aggregates along the order: ``{name: (kind, expression)}``.

    Kinds are ``sum``, ``max``, ``min`` and ``last`` (the latest non-null value). ``reverse`` runs from
    the end, ``exclusive`` leaves out the row itself. ``blocked``: the block column is already there."""
    if axis.single:
        inside = axis.window(reverse).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        out = df.drop(BLOCK) if blocked else df
        return out.withColumns({name: F.last(value, ignorenulls=True).over(inside) if kind == "last" else _TOTAL[kind](value).over(inside)
                                for name, (kind, value) in values.items()})
    source = df if blocked else df.withColumn(BLOCK, axis.block())
    parts, carries, local = {}, {}, {}
    over = Window.partitionBy(*axis.keys).orderBy(F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    inside = axis.window(reverse).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    for name, (kind, value) in values.items():
        total, carry = f"__total_{name}", f"__carry_{name}"
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            parts[total] = pick(value, F.when(value.isNotNull(), axis.position()))
            carries[carry] = F.last(F.col(total), ignorenulls=True).over(over)
            local[name] = F.last(value, ignorenulls=True).over(inside)
        else:
            agg = _TOTAL[kind]
            parts[total] = agg(value)
            carries[carry] = agg(F.col(total)).over(over)
            local[name] = agg(value).over(inside)
    blocks = source.groupBy(*axis.keys, BLOCK).agg(*[e.alias(n) for n, e in parts.items()])
    blocks = blocks.select(*axis.keys, BLOCK, *[e.alias(n) for n, e in carries.items()])
    out = source.withColumns(local).join(blocks, [*axis.keys, BLOCK])
    merged = {}
    for name, (kind, _) in values.items():
        mine, carry = F.col(name), F.col(f"__carry_{name}")
        merged[name] = {"sum": lambda: F.when(carry.isNull(), mine).otherwise(carry + F.coalesce(mine, F.lit(0))),
                        "max": lambda: F.greatest(carry, mine), "min": lambda: F.least(carry, mine),
                        "last": lambda: F.coalesce(mine, carry)}[kind]()
    return out.withColumns(merged).drop(BLOCK, *carries)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, *, name: str = "row",
                firsts: Mapping[str, Column] | None = None, single: bool = False) -> DataFrame:
    """Number the rows of each group from 0 in ``order``.

    ``bucket`` is a coarse non-decreasing function of the first order column; rows are ranked inside
    (group, bucket) and offset by the counts of the earlier buckets. ``firsts`` adds group minima up to the row.
    ``single``: no group is larger than a block, and each is numbered at once."""
    firsts = dict(firsts or {})
    if single:
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: (F.row_number().over(w) - F.lit(1)).cast("long")} | {k: F.min(e).over(upto) for k, e in firsts.items()})
    source = df.withColumn("__bucket", bucket)
    counts = source.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"),
                                                   *[F.min(e).alias(f"__min_{k}") for k, e in firsts.items()])
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
                            *[F.min(f"__min_{k}").over(through).alias(k) for k in firsts])
    rank = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    out = source.withColumn(name, rank - F.lit(1)).join(offsets, [*keys, "__bucket"])
    return out.withColumn(name, (F.col(name) + F.col("__offset")).cast("long")).drop("__bucket", "__offset")


def spread(df: DataFrame, keys: Sequence[str], rows: int = 250_000) -> DataFrame:
    """``df`` dealt by ``keys`` over so many tasks that each gets about ``rows`` rows, however large the table is.

    The number follows from a count: a fixed number of shuffle partitions, or one that adaptive execution takes from
    compressed sizes, leaves a task as many keys to hold as the table has grown."""
    return deal(df, keys, df.count(), rows)


def deal(df: DataFrame, keys: Sequence[str], count: int, rows: int = 250_000) -> DataFrame:
    """``spread`` where the number of rows is known or bounded without running ``df``."""
    return df.repartition(max(1, math.ceil(count / rows)), *keys)


def attach(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], *, how: str = "inner") -> DataFrame:
    """Group aggregates joined back to the rows (pre-aggregated per task; no per-group window)."""
    totals = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return df.join(totals, list(keys), how)


def quantile(df: DataFrame, keys: Sequence[str], value: Column, q: float, *, name: str, span: float, single: bool = False) -> DataFrame:
    """Exact linearly interpolated quantile of a value per group.

    Equal values are counted together first; the running count is blocked by value, so neither a hot
    group nor a hot value is gathered in one task. ``single``: no group is larger than a block, and each is sorted at once."""
    if single:
        lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__vs")).where(F.size("__vs") > 0)
        return lists.select(*keys, sorted_quantile(F.col("__vs"), q).alias(name))
    counts = (df.select(*keys, value.alias("__v")).where(F.col("__v").isNotNull())
              .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")))
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    ranked = running(counts, Axis(tuple(keys), "__v", span), {"__upto": ("sum", F.col("__c"))})
    at = (F.col("__n") - 1) * F.lit(float(q))

    def holding(index: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__c") <= index) & (index < F.col("__upto")), F.col("__v")))

    low, high = holding(F.floor(at)), holding(F.ceil(at))
    part = F.max(at - F.floor(at))
    out = ranked.join(sizes, list(keys)).groupBy(*keys).agg(low.cast("double").alias("__low"), high.cast("double").alias("__high"), part.alias("__part"))
    return out.select(*keys, _between(F.col("__low"), F.col("__high"), F.col("__part")).alias(name))


def sorted_quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array without nulls."""
    at = (F.size(values) - 1) * F.lit(float(q))
    pick = lambda i: F.element_at(values, (i + 1).cast("int")).cast("double")
    return _between(pick(F.floor(at)), pick(F.ceil(at)), at - F.floor(at))


def _between(low: Column, high: Column, part: Column) -> Column:
    """``low * (1 - part) + high * part`` with the first product unrounded, as a fused multiply-add gives it (and SQL's
    ``quantile_cont``): a level decides comparisons with the very values it lies between."""
    rest, weighted = 1.0 - part, high * part
    halves = lambda x: (x * 134217729.0 - (x * 134217729.0 - x), x - (x * 134217729.0 - (x * 134217729.0 - x)))
    (a, b), (c, d) = halves(low), halves(rest)
    product = low * rest
    lost = ((a * c - product) + a * d + b * c) + b * d
    total = product + weighted
    back = total - product
    exact = total + (((product - (total - back)) + (weighted - back)) + lost)
    # the halves of huge or non-finite numbers are not finite
    return F.when(F.abs(low) < 1e290, exact).otherwise(total)


def interval_join(points: DataFrame, windows: DataFrame, keys: Sequence[str], at: str, low: str, high: str,
                  span: float, how: str = "inner") -> DataFrame:
    """Points joined to the windows of their group with ``low <= at <= high``.

    Both sides carry a time bucket, so the join key is (group, bucket) and a long group spreads out."""
    p = points.withColumn("__slot", F.floor(F.col(at) / F.lit(float(span))).cast("long"))
    first, last = (F.floor(F.col(c) / F.lit(float(span))).cast("long") for c in (low, high))
    w = windows.where(F.col(low) <= F.col(high)).withColumn("__slot", F.explode(F.sequence(first, last)))
    p, w = p.alias("p"), w.alias("w")
    on = F.expr(" and ".join(f"p.`{k}` = w.`{k}`" for k in (*keys, "__slot"))) & F.col(f"p.{at}").between(
        F.col(f"w.{low}"), F.col(f"w.{high}"))
    joined = p.join(w, on, how)
    kept = [F.col(f"w.`{c}`") for c in windows.columns if c not in keys] if how not in ("left_semi", "left_anti") else []
    return joined.select(*[F.col(f"p.`{c}`") for c in points.columns], *kept)
