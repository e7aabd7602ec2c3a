"""Connected components by alternating large-star and small-star steps on an edge table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every end of the edges ``a, b``; nulls and loops link nothing.

    Each step is a minimum per node (partially aggregated) joined back, so a hub is one row on the small side of a join that
    adaptive execution splits. Edge tables are written between the steps; only their counts reach the driver."""
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        best = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(best, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(rest.unionByName(best.select("a", F.col("m").alias("b"))).distinct(), "edges")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def residual_pairs(buckets: DataFrame, parts: DataFrame, profiles: DataFrame, fits: Callable[[str, str], Column]) -> DataFrame:
    """``a < b, total``: pairs of a bucket whose ends are still in different components, and the sum of their sizes, for ``buckets(bucket, node)``.

    ``fits(x, y)`` says of the columns of ``profiles(node, size, ...)``, with ``x`` and ``y`` behind their names, whether two nodes may
    be linked. It is a condition of the join itself: members are compared where they meet, and only those that fit become rows.
    One side of a pair is always outside the largest component of its bucket, so a bucket that one component fills costs
    only its few other members times its size, and a settled bucket nothing."""
    placed = staged(buckets.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = (sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("top")).filter("parts > 1")
             .select("bucket", F.col("top.component").alias("top")))
    rows = staged(placed.join(open_, "bucket").join(profiles, "node"), "open")
    side = lambda df, end: df.select("bucket", *(F.col(c).alias(c + end) for c in ["node", "component", *profiles.columns[1:]]))
    pairs = side(rows.filter("component <> top"), "_x").join(side(rows, "_y"), "bucket").filter((F.col("component_x") != F.col("component_y")) & fits("_x", "_y"))
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), (F.col("size_x") + F.col("size_y")).alias("total")).distinct()


def leader_pairs(buckets: DataFrame) -> DataFrame:
    """``a < b``: every member of a bucket with three leaders of it, never member with member."""
    lead = buckets.groupBy("bucket").agg(F.min("node").alias("l1"), F.max("node").alias("l2"), F.min(F.struct(F.xxhash64("node", "bucket"), "node")).alias("l3"))
    pairs = buckets.join(lead, "bucket").select("node", F.explode(F.array("l1", "l2", "l3.node")).alias("leader")).filter("node <> leader")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def asking_pairs(buckets: DataFrame, parts: DataFrame, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What must still be compared among nodes of ``buckets(bucket, node)``: ``(asks, members, crowd)``.

    ``asks(node, mine, component, n)``: nodes of a component that share a bucket with a larger one of ``n`` > ``small`` nodes,
    listed by ``members(component, node)``. ``crowd(bucket, node, component, m)``: the ``m`` nodes of smaller components in a
    bucket that holds several, which must be held against each other. A bucket that one component fills costs only its few
    other members, not its pairs."""
    placed = staged(buckets.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    members = placed.select("component", "node").distinct()
    totals = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sizes = placed.select("bucket", "component").distinct()
    open_ = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("bucket")
    sizes = sizes.join(open_, "bucket").join(totals, "component")
    rows = staged(placed.join(sizes.select("bucket", "component", F.col("n").alias("own")), ["bucket", "component"]).select("bucket", "node", F.col("component").alias("mine"), "own"), "open")
    large = rows.filter(F.col("own") > small).select("bucket", F.col("mine").alias("component"), F.col("own").alias("n")).distinct()
    asks = rows.join(large, "bucket").filter("n > own OR (n = own AND component > mine)").select("node", "mine", "component", "n").distinct()
    few = rows.filter(F.col("own") <= small)
    counts = few.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("mine").alias("low"), F.max("mine").alias("high")).filter("low < high").select("bucket", "m")
    return staged(asks, "asks"), members, staged(few.select("bucket", "node", F.col("mine").alias("component")).join(counts, "bucket"), "crowd")
