"""Projections of the star-schema tables into the canonical demonstration tables.

Each function reads only the columns it needs and is lazy. An *episode* is one user's event history,
a *frame* one event of it, time is in days since the episode's first event.
"""
from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rotation
from ..functions.vectors import Sheet
from ..operators.blocks import Axis, largest_group, number_rows, spread

DAY_US = 86_400_000_000
#: Frames are cut into blocks of this many rows, times into blocks of this many days.
FRAMES = Axis(("episode",), "row", 65_536)
CLOCK = Axis(("episode",), "t", 64.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, from its own fields: the session zone plays no part."""
    return F.expr(f"unix_date(cast({ts} as date)) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L "
                  f"+ cast(extract(SECOND FROM {ts}) * 1000000 as bigint)")


def frame_axis(spark: SparkSession, sf_dir: str) -> Axis:
    """The axis of the frames; the events of each user are counted to see whether every episode is one block."""
    return replace(FRAMES, single=largest_group(table(spark, sf_dir, "events"), ["user_id"]) <= FRAMES.span)


def frames(spark: SparkSession, sf_dir: str, axis: Axis = FRAMES, dealt: bool = False) -> DataFrame:
    """``dealt``: episodes of one block go to as many tasks as their frames ask for; what follows keeps that order."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"), micros("ts").alias("us"), "event_id", "event_type", "value")
    if dealt and axis.single:
        ev = spread(ev, ["episode"], 50_000)
    ev = number_rows(ev, ["episode"], ["us", "event_id"], F.floor(F.col("us") / DAY_US), firsts={"us0": F.col("us")}, single=axis.single)
    opening = F.col("value") / 500.0
    turn = F.col("row") / 10.0
    closed = F.col("event_type").isin("click", "purchase")
    return ev.select(
        "episode", "row", ((F.col("us") - F.col("us0")) / float(DAY_US)).alias("t"), "event_id", "event_type", "value",
        opening.alias("opening"), closed.alias("closed"), (F.col("value") / 25.0 - math.pi).alias("yaw"),
        (opening * F.cos(turn)).alias("x"), (opening * F.sin(turn)).alias("y"), (F.col("value") / 1000.0).alias("z"),
        F.when(closed, F.col("event_id") % 3).alias("label"))


ROLES = {"click": "manipulated", "purchase": "manipulated", "signup": "receptacle", "view": "support", "error": "fixture"}


def role(event_type: Column) -> Column:
    pick = F.lit(None).cast("string")
    for name, value in ROLES.items():
        pick = F.when(event_type == name, value).otherwise(pick)
    return pick


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (episode, object): role, resting place and half extents."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.col("event_type").alias("object"), "value")
    n = F.count(F.lit(1))
    return ev.groupBy("episode", "object").agg(
        (F.avg("value") / 500.0).alias("ox"), (F.min("value") / 500.0).alias("oy"), (F.max("value") / 2000.0).alias("oz"),
        (0.01 + (n % 5) / 100.0).alias("hx"), (0.01 + (n % 7) / 100.0).alias("hy"), (0.01 + (n % 3) / 100.0).alias("hz"),
        n.alias("n")).withColumn("role", role(F.col("object")))


def object_frames(spark: SparkSession, sf_dir: str, *columns: str, axis: Axis = FRAMES) -> DataFrame:
    """Every object's place and validity at every frame of its episode."""
    f = frames(spark, sf_dir, axis)
    o = objects(spark, sf_dir)
    joined = f.join(o, "episode")
    swing = F.col("row") * F.col("n") / 20.0
    return joined.select(*[c for c in f.columns], "object", "role", "hx", "hy", "hz",
                         (F.col("ox") + 0.05 * F.sin(swing)).alias("px"), (F.col("oy") + 0.05 * F.cos(swing)).alias("py"),
                         F.col("oz").alias("pz"), ((F.col("row") + F.col("n")) % 7 != 0).alias("valid"), *columns)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pose tracks and a 22-joint posture per embedding: episode = label, row = rank by id."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("episode"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = number_rows(e, ["episode"], ["vec_id"], F.floor(F.col("vec_id") / 65_536))
    s = Sheet(e)

    def unit(name: str, first: int):
        raw = s.put(f"{name}raw", [F.col("e")[first + i] for i in range(4)])
        return s.put(name, rotation.canonical(rotation.normalize(raw)))

    a, b, h = unit("a", 0), unit("b", 7), unit("h", 25)
    return s.df.select("episode", "row", "vec_id",
                       *[F.col("e")[4 + i].alias(f"a{n}") for i, n in enumerate("xyz")],
                       *[c.alias(f"a{n}") for n, c in zip(("qw", "qx", "qy", "qz"), a)],
                       *[F.col("e")[11 + i].alias(f"b{n}") for i, n in enumerate("xyz")],
                       *[c.alias(f"b{n}") for n, c in zip(("qw", "qx", "qy", "qz"), b)],
                       *[c.alias(f"h{n}") for n, c in zip(("qw", "qx", "qy", "qz"), h)],
                       F.slice("e", 15, 22).alias("q"), F.slice("e", 37, 22).alias("qd"),
                       F.abs(F.col("e")[58]).alias("open_l"), F.abs(F.col("e")[59]).alias("open_r"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build records: one order is one built episode."""
    o = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    whole = F.floor(price).cast("string")
    status = F.when(k % 7 == 0, "excluded").when(k % 7 == 1, "error").when(k % 7 == 2, "read_error").otherwise("ok")
    k_known = ~status.isin("error", "read_error") & ~((k % 7 == 0) & (k % 2 == 0))
    k_passed = k % 3 != 0
    p_known = k_known & (k % 5 != 0)
    p_passed = k % 4 == 1
    k_reasons = F.when(~k_passed, F.when(k % 2 == 0, F.array(
        _text("left TCP rotation residual ", whole, " rad > 0.05 rad at frame ", k.cast("string"), " (3 frames)"),
        _text("speed limit exceeded: joint 5 at ", whole, " x limit"))).otherwise(F.array(
            _text("right hand-Nut", k.cast("string"), " relative pose drifts ", whole, " mm / 0.3 rad during frames 3-9"))))
    p_reasons = F.when(~p_passed, F.when(k % 3 == 0, F.array(
        _text("grasp_drift: right/cube: ", whole, " m"), _text("tcp_tracking: left ", whole, " m"))).otherwise(
            F.array(_text("tcp_tracking: left ", whole, " m"))))
    written = (status == "ok") & (k % 11 != 0)
    pieces = F.floor(price) % 997
    return o.select(
        k.alias("uid"), F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("dataset"),
        F.concat(F.lit("task-"), (k % 6).cast("string")).alias("task"), status.alias("status"),
        F.when(status == "excluded", F.when(k % 4 < 2, "no_meshes").otherwise("no_object_poses")).alias("excluded"),
        F.when(status == "excluded", _text("episode ", (k % 50).cast("string"), " lacks part ", (k % 3).cast("string"),
                                           " of the scene")).alias("reason"),
        F.when(k_known, F.struct(k_passed.alias("passed"),
                                 F.coalesce(k_reasons, F.array().cast("array<string>")).alias("reasons"))).alias("K"),
        F.when(p_known, F.struct(p_passed.alias("passed"),
                                 F.coalesce(p_reasons, F.array().cast("array<string>")).alias("reasons"))).alias("P"),
        F.when(k % 4 == 0, F.array(F.lit("right_arm"), F.lit("left_arm"))).when(k % 4 == 1, F.array(F.lit("left_arm")))
         .when(k % 4 == 2, F.array(F.lit("head"), F.lit("base"), F.lit("left_arm"))).alias("body_parts"),
        F.when(k % 4 == 0, "tabletop").when(k % 4 == 1, "mobile_manipulation").when(k % 4 == 2, "navigation").alias("regime"),
        F.when(written, _text("out/episodes/", F.col("o_orderpriority"), "/", k.cast("string"), ".h5")).alias("file"),
        F.when(written & (k % 13 != 0), F.struct(
            (pieces * 1000).alias("episode_bytes"), (pieces * 3000).alias("assets_referenced_bytes"),
            ((pieces % 10) * 7000).alias("assets_new_bytes"))).alias("scene"),
        (price / 1000.0).alias("seconds"), (price / 5000.0).alias("duration"), (200 + pieces).cast("double").alias("rss_mb"),
        F.col("o_custkey").alias("worker"), micros("o_orderdate").alias("at_us"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries: one part is one pinned source file."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    family = F.lower(F.regexp_replace("p_brand", "#", ""))
    path = _text(F.lower("p_type"), "/", F.regexp_replace("p_name", " ", "/"), "/f", k.cast("string"),
                 F.when(k % 5 == 0, ".png").when(k % 5 == 1, ".json").otherwise(".h5"))
    kind = F.when(k % 6 == 0, "range_package").when(k % 6 == 1, "range_member").when(k % 6 == 2, "file_images_embedded") \
        .when(k % 6 == 3, "tar_stream").otherwise("file")
    size = F.when(k % 17 != 0, F.col("p_size") * 10_000_000 + k)
    return p.select(
        k.alias("key"), _text(family, "/", path).alias("id"), family.alias("family"), path.alias("path"),
        F.when(k % 10 != 0, F.sha2(k.cast("string").cast("binary"), 256)).alias("sha256"), size.cast("long").alias("size"),
        kind.alias("kind"), F.when(k % 3 == 0, "assets").when(k % 3 == 1, "low_dim").alias("content"),
        _text("license-", (k % 4).cast("string")).alias("license"), (k % 9 != 0).alias("usable"),
        (F.col("p_size") * 4_000_000).cast("long").alias("stored_size"),
        F.when(k % 12 != 0, (F.col("p_size") * 9_000_000).cast("long")).alias("inflated_size"), F.col("p_retailprice").alias("price"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified local files: catalogue entries that at least one line item ordered, with their digests."""
    c = catalog(spark, sf_dir)
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max(micros("l_shipdate")).alias("fetched_us"))
    got = F.sha2(F.when(F.col("n") % 13 == 0, _text(F.col("key").cast("string"), "x")).otherwise(F.col("key").cast("string"))
                 .cast("binary"), 256)
    return c.join(sold.hint("merge"), "key").where(F.col("n") % 4 != 3).select(
        "key", "id", "family", "kind", _text("raw/", F.col("id")).alias("local_path"), got.alias("sha256_verified"),
        F.coalesce("size", F.lit(0)).alias("bytes"), "n", "fetched_us")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found on disk: path, size and digest."""
    led = ledger(spark, sf_dir)
    digest = F.when(F.col("n") % 11 == 0, F.sha2(_text("changed", F.col("key").cast("string")).cast("binary"), 256)) \
        .otherwise(F.col("sha256_verified"))
    return led.where(F.col("n") % 17 != 0).select(F.col("local_path").alias("path"), F.col("bytes").alias("size"),
                                                  digest.alias("sha256"))
