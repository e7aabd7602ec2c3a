"""Domain operators on literal cases."""
from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import catalog as K
from trajlake.operators import folds as D
from trajlake.operators import gates as A
from trajlake.operators import labels as B
from trajlake.operators import planning as P
from trajlake.operators import reports as R
from trajlake.operators import scenarios as G
from trajlake.operators import scene as C
from trajlake.operators.blocks import Axis
from trajlake.schema import BUILD_RECORDS

AXIS = Axis(("episode",), "row", 64)


def records(spark, rows):
    names = ["family", "dataset", "task", "uid", "status", "excluded", "reason", "K", "P", "file", "scene", "regime", "body_parts"]
    full = spark.createDataFrame([], BUILD_RECORDS)
    types = {f.name: f.dataType.simpleString() for f in full.schema}
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {types[n]}" for n in names))


def test_failure_reasons_per_tier(spark):
    df = records(spark, [
        {"uid": "a", "K": (False, ["left TCP rotation residual 0.1 rad > 0.05 rad at frame 1 (2 frames)"]), "P": (False, ["grasp_drift: right: 0.01 m", "tcp_tracking: 0.1 m"])},
        {"uid": "b", "K": (False, ["right TCP rotation residual 0.2 rad > 0.05 rad at frame 3 (2 frames)"]), "P": (False, ["tcp_tracking: 0.2 m"])}])
    got = {(r.tier, r.kind): (r["first"], r.anywhere) for r in R.reason_counts(df).collect()}
    assert got == {("K", "TCP rotation residual"): (2, 2), ("P", "grasp_drift"): (1, 1), ("P", "tcp_tracking"): (1, 2)}


def test_failure_reasons_are_ranked_twice_and_counted_without_a_cap(spark):
    many = [{"uid": f"u{i}", "K": (True, []), "P": (False, [f"kind_{chr(97 + i // 26)}{chr(97 + i % 26)}: 0.1 m"])} for i in range(60)]
    rare = [{"uid": f"v{i}", "K": (True, []), "P": (False, ["common: 1 m", *(f"other_{chr(97 + j)}: 1 m" for j in range(26))])} for i in range(3)]
    df = records(spark, many + rare)
    assert R.reason_counts(df, failed_only=True).count() == 60 + 27
    got = [tuple(r) for r in R.failure_reasons(df).collect()]
    assert {(t, r) for t, r, *_ in got} == {("P", "first"), ("P", "anywhere")} and len(got) == 50
    assert sum(k.startswith("kind_") for _, r, k, _ in got if r == "first") == 24 and sum(k.startswith("other_") for _, r, k, _ in got if r == "anywhere") == 24


def test_storage_and_exclusion(spark):
    df = records(spark, [
        {"uid": "a", "dataset": "d", "status": "excluded", "excluded": "no_meshes", "reason": "scene lacks 12 files"},
        {"uid": "b", "dataset": "d", "status": "ok", "file": "x.h5", "K": (True, []), "scene": (2_000_000, 10_000_000, 4_000_000)}])
    s = R.storage_per_episode(df).first()
    assert (s.episode_only, s.with_library_share, s.with_own_assets) == (2.0, 6.0, 12.0)
    assert R.exclusion_reasons(df).first().reason == "no_meshes: scene lacks # files"
    total = [r for r in R.stage_counts(df).collect() if r.level == "total"][0]
    assert (total.source, total.excluded, total.retargeted, total.written, total.K, total.P_tested) == (2, 1, 1, 1, 1, 0)
    assert "| total | total | 2 | 1 | 1 |" in R.markdown_stages(R.stage_counts(df))


def greedy(items, most, target, scratch, count):
    out, used, cut, n, batch = [], 0, 0, 0, -1
    for size, extra, seg in items:
        if n == 0 or used + size > most or used >= target or cut + extra > scratch or n >= count or seg != last:
            batch, used, cut, n = batch + 1, 0, 0, 0
        used, cut, n, last = used + size, cut + extra, n + 1, seg
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_packing_equals_the_sequential_fold(spark, seed):
    rng = random.Random(seed)
    groups = {g: [(rng.randint(0, 9), rng.randint(0, 5), rng.choice("xxxy")) for _ in range(n)] for g, n in (("a", 400), ("b", 1), ("c", 33), ("d", 64))}
    rows = [(g, i, s, c, seg) for g, items in groups.items() for i, (s, c, seg) in enumerate(items)]
    df = spark.createDataFrame(rows, "episode string, row long, size long, extra long, seg string")
    lim = P.Limits(most=20, target=14, scratch=11, count=6)
    got = {(r.episode, r.row): r.batch for r in P.pack(df, Axis(("episode",), "row", 16), lim, size="size", scratch="extra", segment="seg").collect()}
    for g, items in groups.items():
        assert [got[(g, i)] for i in range(len(items))] == greedy(items, 20, 14, 11, 6)


def test_consecutive_batches(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate((5, 5, 20, 1))], "episode string, row long, size long")
    got = P.pack(df, AXIS, P.Limits(most=10, count=8), size="size").orderBy("row").collect()
    assert [r.batch for r in got] == [0, 0, 1, 2]


def test_prefix_cover_is_exact(spark):
    ids = ["fam/a/1", "fam/a/2", "fam/b/1", "fam/b/2", "fam/mixed/1", "fam/mixed/2", "fam/solo/1"]
    cat = spark.createDataFrame([(i, True) for i in ids], "id string, usable boolean")
    chosen = spark.createDataFrame([(i, 2 if "/b/" not in i else 100) for i in ids if i != "fam/mixed/2"], "id string, transfer long")
    got = {r.id: r.selector for r in P.prefix_cover(cat, chosen, 50).collect()}
    assert got == {"fam/a/1": "fam/a/", "fam/a/2": "fam/a/", "fam/b/1": "fam/b/1", "fam/b/2": "fam/b/2", "fam/mixed/1": "fam/mixed/1", "fam/solo/1": "fam/solo/1"}


def test_shards_cover_every_episode_once(spark):
    u = spark.createDataFrame([("u", 200), ("v", 37)], "unit string, episodes long")
    rows = P.shards(u, 30).collect()
    assert {r.unit: sum(x.shard_episodes for x in rows if x.unit == r.unit) for r in rows} == {"u": 200, "v": 37}
    assert max(r.n for r in rows if r.unit == "u") == 7


def test_stratified_sample_is_deterministic(spark):
    rows = [(c, i % 3 != 0, f"{c}{i}") for c, n in (("a", 20), ("b", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "cell string, passed boolean, key string")
    draw = lambda seed: sorted(r.key for r in P.stratified(df, "cell", "passed", "key", seed, 4, 2, slots=3).collect())
    assert draw(1) == draw(1) and len(draw(1)) == 4 + 2 + 3 + 2
    assert len({tuple(draw(s)) for s in range(6)}) > 1


def test_budget_keeps_the_crossing_item(spark):
    df = spark.createDataFrame([("g", f"{i:02x}", 3) for i in range(40)], "g string, h string, est long")
    kept = sorted(r.h for r in P.budgeted(df, ["g"], F.col("h"), "est", F.lit(10)).collect())
    assert kept == ["00", "01", "02", "03"]


def test_demo_ranges():
    assert P.demo_ranges("0-19,25") == [(0, 19), (25, 25)]


def test_listing_lines(spark):
    lines = spark.createDataFrame([(0, "12 /data/raw/a"), (1, "raw/b"), (2, "./raw/c"), (3, "7 d"), (4, "9 raw/a"), (5, ""), (6, "3 /other/x")], "line long, value string")
    got = {r.path: r.size for r in K.parse_listing(lines, "/data").collect()}
    assert got == {"raw/a": 9, "raw/b": 0, "raw/c": 0, "raw/d": 7, None: 3}


def test_ledger_verification_first_rule_wins(spark):
    led = spark.createDataFrame([("a", "raw/a", "1"), ("b", "raw/b", "2"), ("c", "raw/c", "3"), ("d", "raw/d", "4")], "id string, local_path string, sha256_verified string")
    files = spark.createDataFrame([("raw/b", "x"), ("raw/c", "3"), ("raw/d", "4")], "path string, sha256 string")
    cat = spark.createDataFrame([("c", "9"), ("d", None)], "id string, sha256 string")
    assert {r.id: r.problem for r in K.verify(led, files, cat).collect()} == {"a": "missing", "b": "sha256 mismatch", "c": "ledger differs from catalog"}


def test_closed_state_waits_for_the_stall(spark):
    opening = [1.0] * 10 + [1.0 - 0.05 * (i + 1) for i in range(8)] + [0.6] * 16 + [0.65 + 0.06 * i for i in range(6)]
    df = spark.createDataFrame([(1, i, i * 0.05, o) for i, o in enumerate(opening)], "episode long, row long, t double, opening double")
    got = [r.is_closed for r in B.closed_by_opening(df, "t", AXIS).orderBy("row").collect()]
    assert all(got[20:33]) and not any(got[:17]) and not any(got[36:])


def test_grasp_labels_bridge_and_drop(spark):
    held = [0] * 3 + [1] * 8 + [0] * 2 + [1] * 6 + [0] * 8 + [1] + [0] * 4
    rows = [(1, i, i * 0.1, bool(h), "cube", 0.01, 0.04, 0.03, False) for i, h in enumerate(held)]
    df = spark.createDataFrame(rows, "episode long, row long, t double, is_closed boolean, nearest string, distance double, extent double, width double, carried boolean")
    got = [r.grasp for r in B.grasp_labels(B.row_end(df, "t", AXIS), "t", AXIS, gap=0.31).orderBy("row").collect()]
    assert got == [None] * 3 + ["cube"] * 16 + [None] * 13


def test_empty_fingers_hold_nothing(spark):
    rows = [(1, i, i * 0.1, True, "cube", 0.01, 0.04, 0.0, False) for i in range(10)]
    df = spark.createDataFrame(rows, "episode long, row long, t double, is_closed boolean, nearest string, distance double, extent double, width double, carried boolean")
    assert {r.grasp for r in B.grasp_labels(B.row_end(df, "t", AXIS), "t", AXIS).collect()} == {None}


def test_table_footprint(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2))])
    square = A.polygon_edges(square)
    row = spark.range(1).select(A.polygon_distance(F.lit(1.0), F.lit(0.0), square).alias("out"), A.polygon_distance(F.lit(0.0), F.lit(0.05), square).alias("inside")).first()
    assert (row.out, row.inside) == (pytest.approx(0.8), pytest.approx(-0.15))


def test_held_tolerance_is_stricter(spark):
    rows = [(1, i, 0.004, 0.0, False, 1.0) for i in range(5)] + [(2, i, 0.004, 0.0, True, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "episode long, row long, left_pos double, left_rot double, left_held boolean, left_z double")
    got = [(r.episode, r.reason) for r in A.residual_reasons(df, "left", ["episode"], "row", tol_pos=(0.005, 0.003), tol_rot=(0.05, 0.03)).collect()]
    assert got == [(2, "left TCP position residual 4 mm > 3 mm at frame 0 (5 frames)")]


def test_slip_is_reported(spark):
    rows = [(1, i, "cube" if 2 <= i < 8 else None, 0.03 if i >= 5 else 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "episode long, row long, label string, p double")
    got = A.grasp_drift(df, F.col("label"), [F.col("p")], F.lit(0.0), AXIS).first()
    assert (got.start, got.stop, got.drift) == (2, 8, pytest.approx(0.03))


def test_missing_pose_text(spark):
    df = spark.createDataFrame([(1, "box", i == 0) for i in range(10)], "episode long, object string, valid boolean")
    assert A.missing_poses(df, ["episode"]).first().reason == "object box: pose missing at 9 of 10 steps"
    many = spark.createDataFrame([(1, f"o{i}", False) for i in range(8)], "episode long, object string, valid boolean")
    assert A.missing_poses(many, ["episode"]).first().reason.endswith("(+3 more)")


def test_cells_are_stratified_and_siblings_share(spark):
    got = G.scenarios(spark.range(40).withColumnRenamed("id", "i"), "i", "ns", "train").collect()
    for block in range(4):
        cells = sorted(r.cell for r in got if r.i // 10 == block)
        assert cells == sorted(G.CELLS)
    sib = G.scenarios(spark.range(8).withColumnRenamed("id", "i"), "i", "ns", "train", 4).collect()
    assert len({(r.group, r.cell, r.start, r.speed) for r in sib}) == 2 and {r.member for r in sib} == {0, 1, 2, 3}


def test_sides(spark):
    rows = [(1, "a", 0.3, None), (1, "b", -0.2, None), (2, "a", 0.3, "right"), (2, "b", -0.3, "left"), (3, "a", 0.1, "left"), (4, "a", 0.1, None)]
    df = spark.createDataFrame(rows, "episode long, hand string, lat double, side_hint string")
    got = {(r.episode, r.hand): r.side for r in C.sides_by_rank(df, ["episode"], "hand", F.col("lat")).collect()}
    assert got == {(1, "a"): "left", (1, "b"): "right", (2, "a"): "right", (2, "b"): "left", (3, "a"): "left", (4, "a"): "right"}


def test_new_asset_bytes_are_counted_once(spark):
    df = spark.createDataFrame([(1, "x", 10), (1, "y", 5), (2, "x", 10), (2, "x", 10), (2, "z", 7)], "episode long, sha256 string, bytes long")
    got = {r.episode: (r.assets_referenced, r.referenced_bytes, r.new_bytes) for r in C.asset_statistics(df).collect()}
    assert got == {1: (2, 15, 15), 2: (2, 17, 7)}


def test_first_exceeding_across_blocks(spark):
    from trajlake.operators.paths import first_exceeding
    rng = random.Random(4)
    values = {e: [rng.random() * (1 + i / 300) for i in range(n)] for e, n in ((1, 600), (2, 9))}
    df = spark.createDataFrame([(e, i, v) for e, vs in values.items() for i, v in enumerate(vs)], "episode long, row long, v double")
    asks = [(e, a, vs[a] + rng.random()) for e, vs in values.items() for a in range(0, len(vs), 3)]
    got = {(r.episode, r.at): r["first"] for r in first_exceeding(df, spark.createDataFrame(asks, "episode long, at long, need double"), AXIS, "v", small=4, large=32).collect()}
    for e, a, need in asks:
        assert got.get((e, a)) == next((i for i in range(a, len(values[e])) if values[e][i] > need), None)


@pytest.mark.parametrize("reverse", [False, True])
def test_rate_limit_over_blocks_is_the_sequential_clamp(spark, reverse):
    from trajlake.operators.folds import limited
    rng = random.Random(6)
    rows = [(e, i, rng.uniform(-1, 1) * 5, rng.random()) for e, n in ((1, 50), (2, 1), (3, 17)) for i in range(n)]
    got = {(r.episode, r.row): r.y for r in limited(spark.createDataFrame(rows, "episode long, row long, x double, s double"), Axis(("episode",), "row", 8), "x", "s", "y", reverse=reverse).collect()}
    for e in (1, 2, 3):
        path = sorted((r for r in rows if r[0] == e), key=lambda r: r[1], reverse=reverse)
        y = None
        for _, i, x, s in path:
            y = x if y is None else min(max(x, y - s), y + s)
            assert got[(e, i)] == pytest.approx(y)


def _stages(spark, events, rows=100, tail=0.35):
    from trajlake.operators.folds import Thresholds, stage_cuts
    events = spark.createDataFrame([(1, *e) for e in events], "episode long, part string, start long, stop long")
    activity = spark.range(rows).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("episode"), F.col("id").alias("row"), (F.col("id") * 0.1).alias("t"), F.lit(0.0).alias("activity"))
    got = stage_cuts(events, activity, "t", AXIS, Thresholds(tail=tail)).orderBy("episode", "stage").collect()
    return [[r.stop for r in got if r.episode == e] for e in (1, 2)]


def test_a_settling_part_is_judged_at_its_last_row_and_quiet_episodes_are_one_stage(spark):
    assert _stages(spark, [("hand", 0, 20), ("hand", 40, 60), ("grip", 15, 44), ("grip", 50, 55)]) == [[40, 99], [99]]
    assert _stages(spark, [("hand", 0, 20), ("hand", 40, 60), ("grip", 15, 46), ("grip", 50, 55)]) == [[40, 50, 99], [99]]
    assert _stages(spark, [("hand", 10, 100), ("grip", 20, 30)]) == [[99], [99]]


def test_scenario_keys_do_not_collide(spark):
    from trajlake.operators.scenarios import scenarios
    got = scenarios(spark.createDataFrame([(400_000,), (4_000_000,), (4_000_004,), (8,)], "i long"), "i", "ns", "train", 4).collect()
    assert sorted(r.key for r in got) == ["g000002", "g100000", "g1000000", "g1000001"]


def test_late_keys_and_frames_are_kept(spark, tmp_path):
    from trajlake.operators import sequence as S
    from trajlake.operators.blocks import number_rows
    from trajlake.streaming import incremental as I
    publish = I.publish_once(f"{tmp_path}/published", "path")
    for epoch, keys in enumerate((["p1", "p2", "p1"], ["p3", "p2", "p4"], ["p4", "p0"])):
        publish(spark.createDataFrame([(k,) for k in keys], "path string"), epoch)
    assert sorted(r.path for r in spark.read.parquet(f"{tmp_path}/published").collect()) == ["p0", "p1", "p2", "p3", "p4"]

    def find(frames):
        rows = number_rows(frames, ["episode"], ["us"], F.floor(F.col("us") / 100))
        return S.runs(rows, F.col("label"), AXIS).select("episode", "label", "start", "stop")

    keep = I.keep_runs(f"{tmp_path}/frames", f"{tmp_path}/runs", "episode", find)
    for epoch, rows in enumerate(([(1, 0, "a"), (1, 10, "a"), (1, 40, "b")], [(1, 30, "c"), (1, 20, "c"), (2, 0, "z")], [(1, 50, "b")])):
        keep(spark.createDataFrame(rows, "episode long, us long, label string"), epoch)
    got = sorted((r.episode, r.label, r.start, r.stop) for r in I.current_runs(spark, f"{tmp_path}/runs", "episode").collect())
    assert got == [(1, "a", 0, 2), (1, "b", 4, 6), (1, "c", 2, 4), (2, "z", 0, 1)]


def test_intermediates_are_written_and_plans_stay_small(spark, small):
    """Deep queries read written tables: their plan text is short, and nothing stays cached in the session."""
    import __spark_entry__ as entry
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("wn19_rate_limited_path", "lb02_grasp_labels", "lb23_one_action", "wn28_greedy_packing", "gt02_kinematic_verdicts"):
        df = entry.queries()[name](spark, small)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 200_000 and "InMemoryRelation" not in plan, name
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_a_reversal_splits_a_movement(spark):
    from trajlake.operators.folds import Thresholds, split_turns
    speed = [1.0] * 10 + [0.05] + [-1.0] * 10
    rated = spark.createDataFrame([(1, i, i * 0.1, v, 2) for i, v in enumerate(speed)], "episode long, row long, t double, rate double, window long")
    moves = spark.createDataFrame([(1, 0, 21, 0.0, 2.0)], "episode long, start long, stop long, t0 double, t1 double")
    got = sorted((r.start, r.stop) for r in split_turns(moves, rated, ["rate"], "t", "window", AXIS, Thresholds()).collect())
    assert got == [(0, 10), (10, 21)]


def test_object_centric_segments_keep_the_object_still_in_the_hand(spark):
    from trajlake.operators.paths import object_centric
    rows = [(1, i, i * 0.1, 0.02 * i + (0.01 * i if 5 <= i < 12 else 0.0), 0.02 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "episode long, row long, t double, ax double, bx double")
    zero = F.lit(0.0)
    for s in "ab":
        df = df.withColumns({f"{s}y": zero, f"{s}z": zero, f"{s}qw": F.lit(1.0), f"{s}qx": zero, f"{s}qy": zero, f"{s}qz": zero})
    out = object_centric(df, "a", "b", F.col("row").between(5, 11), "t", AXIS, Axis(("episode",), "t", 64.0), settle=2, max_shift=0.005, max_turn=0.05, approach=0.25, retreat=0.15)
    got = {r.row: (r.out_x, r.bx, r.ax, r.carried) for r in out.collect()}
    assert {round(got[i][0] - got[i][1], 9) for i in range(5, 12)} == {0.07} and all(got[i][3] for i in range(5, 12))
    assert all(got[i][0] == pytest.approx(got[i][2]) for i in (0, 1, 2, 14, 19))
    assert got[4][0] == pytest.approx(got[4][2] + 0.6 * (got[5][0] - got[5][2]))


def test_a_short_drop_extends_the_grasp(spark):
    from trajlake.operators.paths import placed_drops
    z = [0.5] * 6 + [0.49, 0.47, 0.46, 0.46, 0.46, 0.46]
    rows = [(1, i, i * 0.1, i < 6, True, 0.0, 0.0, v, 0.0, v - 0.5, 0.0) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "episode long, row long, t double, held boolean, valid boolean, px double, py double, pz double, rx double, rz double, a double")
    got = placed_drops(df, F.col("held"), "t", AXIS, place=["px", "py", "pz"], inside=["rx", "rz"], turn="a", span=1.0, longest=0.6, min_drop=0.003, max_drop=0.05,
                       max_turn=0.35, rest_speed=0.02, rest_turn=0.05).collect()
    assert [(r.stop, r.new_stop, round(r.drop, 3)) for r in got] == [(6, 9, 0.04)]


def test_command_of_a_two_row_episode(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, 1.0), (1, 1, 1.0, 0.4, 1.0), (2, 0, 0.0, 1.0, 0.0), (2, 1, 1.0, 0.4, 1.0)], "episode long, row long, t double, opening double, command double")
    got = {(r.episode, r.row): r.is_closed for r in B.closed_by_command(df, "t", AXIS).collect()}
    assert got == {(1, 0): True, (1, 1): True, (2, 0): False, (2, 1): True}


def test_carried_runs_end_where_the_object_changes(spark):
    """Object a travels rigidly in the hand and b does not; their runs adjoin."""
    rows = [(1, i, "a" if i < 4 else "b", True, 0.1 * i, 0.0 if i < 4 else 0.2 * i) for i in range(8)]
    df = spark.createDataFrame(rows, "episode long, row long, object string, valid boolean, p double, r double")
    got = {r.row: r.carried for r in B.carried_rows(df, F.lit(True), {"p": F.col("p")}, {"r": F.col("r")}, AXIS, label=F.col("object")).collect()}
    assert got == {i: i < 4 for i in range(8)}


def test_stages_and_turns_in_blocks(spark):
    """Random events and velocities: blocks of a few rows give what one block gives."""
    rng = np.random.default_rng(12)
    frames, events = [], []
    for e in range(12):
        n = int(rng.integers(20, 60))
        frames += [(e, i, 0.1 * i, float(rng.random())) for i in range(n)]
        for part in ("arm", "base", "grip"):
            at = int(rng.integers(0, 5))
            while at < n - 3:
                stop = min(at + int(rng.integers(1, 12)), n)
                events.append((e, part, at, stop))
                at = stop + int(rng.integers(1, 5))
    f = spark.createDataFrame(frames, "episode long, row long, t double, activity double")
    ev = spark.createDataFrame(events, "episode long, part string, start long, stop long")
    th = D.Thresholds(lead=0.5, tail=0.3)
    cuts = [sorted(map(tuple, D.stage_cuts(ev, f, "t", D.Axis(("episode",), "row", span), th).collect())) for span in (65536.0, 7.0, 2.0)]
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) > 40
    rated = spark.createDataFrame([(e, i, 0.1 * i, float(v), float(w), 2) for e in range(8) for i, (v, w) in enumerate(rng.normal(size=(50, 2)))], "episode long, row long, t double, vx double, vy double, window int")
    moves = spark.createDataFrame([(e, a, a + 22, 0.1 * a, 0.1 * (a + 21)) for e in range(8) for a in (0, 24)], "episode long, start long, stop long, t0 double, t1 double")
    th = D.Thresholds(turn_speed=0.9, min_duration=0.25)
    turns = [sorted(map(tuple, D.split_turns(moves, rated, ["vx", "vy"], "t", "window", D.Axis(("episode",), "row", span), th).collect())) for span in (65536.0, 5.0, 2.0)]
    assert turns[0] == turns[1] == turns[2] and len(turns[0]) > 16
