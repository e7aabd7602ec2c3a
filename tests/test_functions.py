"""Scalar functions: literal cases and round trips."""
from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from trajlake.functions import geometry, gripper, planar, pose, rotation, text
from trajlake.functions.vectors import Sheet, cols, norm, sub

REASONS = [
    ("grasp_drift: right/cubeA: 0.0148 m, 0.0490 rad", "grasp_drift"),
    ("left TCP rotation residual 0.115 rad > 0.05 rad at frame 12 (3 frames)", "TCP rotation residual"),
    ("right hand-SquareNut relative pose drifts 18 mm / 0.3 rad during frames 3-9", "hand-object relative pose drifts"),
    ("speed limit exceeded: joint 5 at 1.2 x limit (frame 3)", "speed limit exceeded"),
    ("self-clearance 3.2 mm < 9 mm at frame 7", "self-clearance"),
    ("base footprint overlaps static scene geometry by 12 mm at frame 3", "base footprint overlaps static scene geometry"),
    ("scene: missing assets", "scene"), ("error: ValueError", "error"), ("12 of 30", "other"), ("", "other"), ("  of  ", "other"),
]


def test_reason_kinds(spark):
    df = spark.createDataFrame(REASONS, "reason string, want string").withColumn("kind", text.reason_kind(F.col("reason")))
    assert [(r.reason, r.kind) for r in df.collect() if r.kind != r.want] == []


def test_seed_is_little_endian(spark):
    for key in ("ns/train/000001", "x"):
        want = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "little")
        assert int(spark.range(1).select(text.numeric_seed(F.lit(key)).alias("s")).first().s) == want


@pytest.mark.parametrize("value", [0.0148, 0.05, 5.0, 12.345, 123.4, 1234.5, 0.00012345, 0.9996, 99.96, -3.14159, 0.0])
def test_sig3_is_the_c_format(spark, value):
    got = spark.range(1).select(text.sig3(F.lit(value)).alias("s")).first().s
    want = "%.3g" % value
    assert got == want or (abs(value) >= 1000 and float(got) == float(want))


def test_wrap_angle(spark):
    df = spark.createDataFrame([(math.pi + 0.1,), (-math.pi - 0.1,), (0.3,), (math.pi,)], "a double").select(planar.wrap(F.col("a")).alias("w"))
    got = [r.w for r in df.collect()]
    assert got == pytest.approx([-math.pi + 0.1, math.pi - 0.1, 0.3, -math.pi])


def test_rotation_logs_round_trip(spark):
    rows = [(0.0, 0.0, 0.0), (1e-9, 0.0, 0.0), (math.pi - 1e-4, 0.0, 0.0), (0.3, -0.7, 1.1), (-2.0, 1.0, 0.5)]
    s = Sheet(spark.createDataFrame(rows, "x double, y double, z double"))
    q = s.put("q", rotation.canonical(s.put("q0", rotation.exp(cols("x", "y", "z")))))
    back = s.put("back", rotation.log(q))
    m = s.put("m", rotation.from_matrix(s.put("mat", rotation.to_matrix(q))))
    out = s.select(norm(sub(back, cols("x", "y", "z"))).alias("gap"), norm(sub(m, q)).alias("qgap")).collect()
    assert max(r.gap for r in out) < 1e-9 and max(r.qgap for r in out) < 1e-9


def test_identity_six_values(spark):
    one, zero = F.lit(1.0), F.lit(0.0)
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(rotation.six((one, zero, zero, zero)))]).first()
    assert list(row) == [1, 0, 0, 0, 1, 0]


def test_degenerate_six_values_are_null(spark):
    z = F.lit(0.0)
    row = spark.range(1).select(rotation.six_to_matrix((z, z, z, F.lit(1.0), z, z))[0].alias("a")).first()
    assert row.a is None


def test_twist_round_trip(spark):
    rows = [(0.1, 0.2, 0.3, 0.4, -0.5, 0.6), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.1, 0.1, 0.1, 1e-8, 0.0, 0.0)]
    s = Sheet(spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double"))
    xi = cols(*"abcdef")
    moved = pose.exp(xi)
    p, q = s.put("p", moved.p), s.put("q", rotation.canonical(s.put("q0", moved.q)))
    w = s.put("w", rotation.log(q))
    gap = norm(sub(pose.log(p, w), xi))
    assert max(r.gap for r in s.select(gap.alias("gap")).collect()) < 1e-9


def test_planar_twist_round_trip(spark):
    df = spark.createDataFrame([(0.3, -0.2, 0.9), (0.1, 0.0, 0.0), (0.0, 0.0, -3.0)], "x double, y double, t double")
    d = cols("x", "y", "t")
    back = planar.exp(planar.log(d, 0.02), 0.02)
    assert max(r.gap for r in df.select(norm(sub(back, d)).alias("gap")).collect()) < 1e-9


def test_gripper_scales_invert(spark):
    df = spark.createDataFrame([(i / 10.0,) for i in range(11)], "o double")
    angle = gripper.angle_of_opening(F.col("o"))
    width = gripper.width_of_angle(angle)
    back = gripper.angle_of_width(width)
    rows = df.select("o", gripper.opening_of_angle(angle).alias("o2"), angle.alias("a"), width.alias("w"), back.alias("b")).collect()
    assert all(abs(r.o - r.o2) < 1e-9 for r in rows)
    assert all(abs(r.a - r.b) < 1e-5 for r in rows if r.w > 1e-9) and rows[0].w == 0.0


def test_look_at_straight_up_keeps_an_orthonormal_frame(spark):
    m = rotation.look_at((F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    row = list(spark.range(1).select(*[c.alias(f"m{i}") for i, c in enumerate(m)]).first())
    assert row == pytest.approx([0, 0, -1, 0, 1, 0, 1, 0, 0])


def test_box_parts_of_geometries(spark):
    from trajlake.schema import GEOMETRY
    rows = [("box", ("box", "body", None, [0.1, 0.2, 0.3], None, None, None, None)), ("short", ("box", "body", None, [0.1], None, None, None, None)),
            ("can", ("cylinder", "body", None, None, 0.05, 0.1, "x", None)), ("world", ("box", "world", None, [1.0, 1.0, 1.0], None, None, None, None)),
            ("two", ("boxes", None, None, None, None, None, None, [([0.0, 0.0, 0.0], [0.1, 0.1, 0.1]), ([0.2, 0.0, 0.0], [0.1, 0.1, 0.1])]))]
    df = spark.createDataFrame(rows, f"name string, g {GEOMETRY}").withColumn("parts", geometry.box_parts(F.col("g")))
    got = {r.name: r for r in df.select("name", "parts", geometry.enclosing_box(F.col("parts")).alias("hull"),
                                        geometry.box_distance((F.lit(0.5), F.lit(0.0), F.lit(0.0)), F.col("parts")).alias("d")).collect()}
    assert got["short"].parts is None and got["world"].parts is None
    assert list(got["can"].parts[0].half) == [0.1, 0.05, 0.05]
    assert list(got["two"].hull.half) == pytest.approx([0.2, 0.1, 0.1]) and got["two"].d == pytest.approx(0.2)
    assert got["box"].d == pytest.approx(0.4)


def test_effective_colour(spark):
    grey, red, blue = [0.5, 0.5, 0.5, 1.0], [1.0, 0.0, 0.0, 1.0], [0.0, 0.0, 1.0, 1.0]
    df = spark.createDataFrame([(grey, blue), (red, blue), (grey, None)], "p array<double>, m array<double>")
    assert [r.c for r in df.select(geometry.effective_colour(F.col("p"), F.col("m")).alias("c")).collect()] == [blue, red, grey]


@pytest.mark.parametrize("digits", [1, 3, 4, 6])
def test_fixed_is_the_c_format(spark, digits):
    """Decimals follow the binary value, exact ties go to the even digit."""
    values = [0.32425, 0.30595, 0.31015, 2.1435, 3.7295, 1.6095, 12.25, 12.35, 12.75, 10.05, 0.0005, -0.0005, 5e-5, 5e-7, 0.05, 0.96, -0.04, 0.0, 999.95, 123456789.125]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.fixed(F.col("x"), digits).alias("s"))
    assert [(r.x, r.s) for r in df.collect()] == [(v, f"%.{digits}f" % v) for v in values]


def test_fixed_of_odd_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(text.fixed(F.col("x"), 2).alias("s"))
    assert [r.s for r in df.collect()] == ["nan", "inf", "-inf", None]


def test_jerk_polynomial_goes_on_beyond_one(spark):
    df = spark.createDataFrame([(-0.1,), (0.5,), (1.1,)], "u double")
    got = df.select(gripper.jerk_polynomial(F.col("u")).alias("a"), gripper.min_jerk(F.col("u")).alias("b")).collect()
    assert [r.a for r in got] == pytest.approx([-0.01156, 0.5, 1.01156])
    assert [r.b for r in got] == [0.0, 0.5, 1.0]


def test_reason_kind_of_endless_stop_words(spark):
    """Tens of thousands of stop words, at the end or before another word, neither overflow nor take quadratic time."""
    run = " in AT x" * 20000
    rows = [("grip" + run, "grip"), ("grip" + run + " cup", "grip" + run + " cup"), ("grip into" + run + " inx", "grip into" + run + " inx"), (run, "other"), ("within of to", "within")]
    df = spark.createDataFrame(rows, "reason string, want string").withColumn("kind", text.reason_kind(F.col("reason")))
    assert [r.want[:20] for r in df.collect() if r.kind != r.want] == []
