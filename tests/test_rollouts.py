"""Tier-P gates on literal rollouts."""
from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trajlake.operators import rollouts as R
from trajlake.operators.blocks import Axis

KEYS = ["episode"]


def gated(spark, **changed):
    """A clean rollout 1 of ten steps that lifts and carries one object, with one table replaced; and a rollout 2 without any rows."""
    limits = R.Limits()
    t = {
        "rollouts": ([(1, 10, 0, None, None), (2, 10, 0, None, None)], "episode long, expected long, warnings long, reference double, unmapped string"),
        "steps": ([(1, i, 0.5, 0.2) for i in range(10)], "episode long, row long, q double, v double"),
        "contacts": ([(1, 2, "hand_object", "a-b", 0.0005, False), (1, 1, "object_environment", "a-t", 0.5, True)], "episode long, row long, kind string, pair string, depth double, settling boolean"),
        "pads": ([(1, "left", "cup", p, 2, 9) for p in "ab"], "episode long, side string, object string, pad string, start long, stop long"),
        "hands": ([(1, "left", "cup", i, 2 <= i < 8, 0.02 * (i > 2), 0.0) for i in range(10)], "episode long, side string, object string, row long, near boolean, lift double, slip double"),
        "tasks": ([(1, "cup", "after_hold", "m", 0.01, 0.03)], "episode long, name string, rule string, unit string, error double, tolerance double"),
        "bodies": ([(1, "cup", "cup", True, False, 0.0, 0.0)], "episode long, body string, object string, at_rest boolean, held_at_end boolean, linear double, angular double"),
        "again": ([(1, i, 0.5) for i in range(10)], "episode long, row long, q double"),
    } | changed
    df = {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in t.items()}
    metrics = R.step_metrics(df["steps"], KEYS, "row", finite=F.col("q").isNotNull(), joints=[("one", F.col("q"), 0.0, 1.0)], arm=[F.col("v")], neck=[F.col("v")], base={"vx": F.col("v"), "vy": F.col("v"), "wz": F.col("v")},
                             tcp_position=[F.lit(0.0)], tcp_rotation=[F.lit(0.0)], clearance=F.lit(0.02))
    axis = Axis(("episode", "side", "object"), "row", 4)
    hands = R.bilateral(df["hands"], df["pads"], list(axis.keys), "row", 4.0)
    carries = R.grasp_carries(hands, axis, near=F.col("near"), opened=F.lit(False), lift=F.col("lift"), place=[F.col("slip")], turn=[F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], dt=0.5, limits=limits)
    replays = R.replay_difference(df["steps"], df["again"], KEYS, "row", ["q"])
    return R.gates(df["rollouts"], metrics, R.contact_metrics(df["contacts"], KEYS, "row"), carries, df["tasks"], df["bodies"], replays, KEYS, limits)


def failing(df, episode=1):
    return {r.gate: r.detail for r in df.collect() if r.episode == episode and not r.ok}


def test_clean_rollout_passes_and_a_missing_one_fails(spark):
    out = gated(spark)
    rows = out.collect()
    assert [r.gate for r in sorted(rows, key=lambda r: (r.episode, r.position))] == list(R.GATES) * 2
    assert failing(out) == {}
    assert {r.gate: r.detail for r in rows if r.episode == 1}["carry_contact"] == "left/cup: 1.0000"
    assert set(failing(out, 2)) == {"rollout_complete", "self_clearance", "joint_margin", "arm_speed", "neck_speed", "base_speed", "tcp_tracking", "task_final_pose", "actuator_replay"}
    got = {r.episode: r for r in R.verdicts(out, KEYS).collect()}
    assert got[1].passed and got[1].reasons == [] and got[2].failures == 9 and got[2].reasons[0] == "rollout_complete: steps 0/10, finite=false, warnings=0"


@pytest.mark.parametrize("table, rows, expected", [
    ("steps", [(1, i, 0.5, 2.0 if i == 3 else 0.2) for i in range(10)], {"arm_speed": "2.000 rad/s", "neck_speed": "2.000 rad/s", "base_speed": "body vx, vy, wz = 2.000, 2.000, 2.000"}),
    ("contacts", [(1, 5, "object_environment", "a-t", 0.0021, False), (1, 7, "nonhand_object", "x-y", 0.0, False), (1, 6, "nonhand_object", "x-z", 0.0, False)],
     {"object_environment_penetration": "0.0021 m, absolute threshold 0.0020 m (no source reference)", "no_nonhand_object_contact": "2 contacts, first x-z"}),
    ("pads", [(1, "left", "cup", "a", 2, 9), (1, "left", "cup", "b", 3, 6)], {"carry_contact": "left/cup: 0.6000"}),
    ("hands", [(1, "left", "cup", i, 2 <= i < 8, 0.02 * (i > 2), 0.004 * (i > 5)) for i in range(10)], {"grasp_drift": "left/cup: 0.0040 m, 0.0000 rad"}),
    ("tasks", [(1, "door", "articulation_final", "rad", 0.2, 0.05)], {"task_final_pose": "door: 0.2000 rad (articulation_final)"}),
    ("bodies", [(1, "cup", "cup", True, False, 0.5, 0.0), (1, "ball", "ball", False, False, 9.0, 0.0)], {"objects_at_rest": "ball: 9.000 m/s 0.000 rad/s (reported only); cup: 0.500 m/s 0.000 rad/s"}),
    ("again", [(1, i, 0.5) for i in range(9)], {"actuator_replay": "max |diff| none"}),
    ("rollouts", [(1, 11, 0, None, "spoon")], {"rollout_complete": "steps 10/11, finite=true, warnings=0", "task_final_pose": "cup: 0.0100 m (after_hold); unmapped objects spoon"}),
])
def test_each_gate_fails_with_its_detail(spark, table, rows, expected):
    schemas = {"steps": "episode long, row long, q double, v double", "contacts": "episode long, row long, kind string, pair string, depth double, settling boolean", "pads": "episode long, side string, object string, pad string, start long, stop long",
               "hands": "episode long, side string, object string, row long, near boolean, lift double, slip double", "tasks": "episode long, name string, rule string, unit string, error double, tolerance double",
               "bodies": "episode long, body string, object string, at_rest boolean, held_at_end boolean, linear double, angular double", "again": "episode long, row long, q double",
               "rollouts": "episode long, expected long, warnings long, reference double, unmapped string"}
    assert failing(gated(spark, **{table: (rows, schemas[table])})) == expected


def test_source_ends(spark):
    """Rest is judged on place and turn, and unknown without an earlier row in the window."""
    rows = [(1, "a", i, i * 0.05, True, 0.0, math.cos(i / 2), math.sin(i / 2)) for i in range(5)] + [(1, "b", i, i * 0.05, i < 4, 0.0, 1.0, 0.0) for i in range(5)] + [(1, "c", 0, 0.0, True, 0.0, 1.0, 0.0), (1, "c", 1, 5.0, True, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "episode long, object string, row long, t double, valid boolean, p double, w double, z double")
    got = {r.object: (r.source_row, r.at_rest) for r in R.source_ends(df, "t", ["p"], ["w", "z"], Axis(("episode", "object"), "row", 3), R.Limits()).collect()}
    assert got == {"a": (4, False), "b": (3, True), "c": (1, None)}
