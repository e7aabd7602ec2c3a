"""What keeps a task's memory and the passes over a table from growing with it."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trajlake.operators import catalog, folds, labels, resample, scene
from trajlake.operators.blocks import Axis, number_rows, quantile, running, shift, spread
from trajlake.operators.sequence import mark_runs
from trajlake.sources import landing


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_follows_the_rows(spark):
    assert spread(spark.range(10), ["id"], rows=3).rdd.getNumPartitions() == 4
    assert spread(spark.range(0), ["id"], rows=3).count() == 0


def test_same_sets_spread_their_items_and_ignore_repeats(spark, small):
    a = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7), (3, None), (4, 8)], "uid int, k int")
    b = spark.createDataFrame([(1, 6), (1, 5), (2, 7), (2, 9), (3, None), (5, 8)], "uid int, k int")
    assert dict(scene.same_sets(a, b, ["uid"], ["k"]).collect()) == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert "REPARTITION_BY_NUM" in plan(entry.queries()["jn23_digest_sets_equal"](spark, small))


def test_one_block_per_group_gives_the_same_rows_without_borders_and_carries(spark):
    rows = spark.sql("""SELECT id % 3 AS episode, CAST(id DIV 3 AS BIGINT) AS row, CASE WHEN hash(id) % 3 <> 0 THEN hash(id) % 5 END AS v,
                        CASE WHEN hash(id, 1) % 4 <> 0 THEN 1 END AS label, hash(id, 2) % 50 / 7.0D AS x FROM range(200)""")
    tiny, one = Axis(("episode",), "row", 8.0), Axis(("episode",), "row", 65536.0, single=True)

    def made(axis):
        out = running(rows, axis, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))})
        out = running(out, axis, {"n": ("last", F.col("v"))}, reverse=True, exclusive=True)
        out = mark_runs(shift(out, axis, {"p": (F.col("v"), -2), "q": (F.col("v"), 3)}), F.col("label"), axis)
        out = out.join(quantile(rows, ["episode"], F.col("x"), 0.95, name="level", span=0.5, single=axis.single), "episode")
        return number_rows(out, ["episode"], ["x", "row"], F.floor("x"), name="k", firsts={"x0": F.col("x")}, single=axis.single)

    assert sorted(map(tuple, made(tiny).select(sorted(made(one).columns)).collect()), key=str) == sorted(
        map(tuple, made(one).select(sorted(made(one).columns)).collect()), key=str)
    assert "__carry" not in plan(made(one)) and "Generate" not in plan(made(one))


def test_placed_drops_sort_their_rows_once(spark, small):
    text = plan(entry.queries()["lb18_placed_drops"](spark, small))
    assert text.count("Window") <= 4 and "__carry" not in text


def test_a_long_episode_is_cut_into_blocks(spark, tmp_path):
    spark.range(65_537).selectExpr("1L AS user_id", "id AS event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert not landing.frame_axis(spark, str(tmp_path)).single
    spark.range(65_536).selectExpr("1L AS user_id", "id AS event_id").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert landing.frame_axis(spark, str(tmp_path)).single


def test_labels_of_short_episodes_need_no_carries(spark, small):
    for name in ("lb03_carried_runs", "lb06_carry_intervals", "lb04_touch_labels", "rs03_output_clock", "rs04_rs07_resampled_frames"):
        text = plan(entry.queries()[name](spark, small))
        assert "__carry" not in text and "__offset" not in text, name


def test_carried_runs_at_once_equal_those_in_blocks(spark):
    rows = spark.sql("""SELECT id % 4 AS episode, CAST(id DIV 4 AS BIGINT) AS row, hash(id DIV 28, id % 4) % 3 <> 0 AS closed, hash(id, 1) % 5 <> 0 AS valid,
                        hash(id, 2) % 9 / 90.0D AS px, hash(id, 3) % 9 / 900.0D AS rx FROM range(400)""")
    made = [labels.carried_rows(rows, F.col("closed"), {"px": F.col("px")}, {"rx": F.col("rx")}, axis, slip=0.012, travel=0.08).select("episode", "row", "carried")
            for axis in (Axis(("episode",), "row", 8.0), Axis(("episode",), "row", 65536.0, single=True))]
    assert sorted(map(tuple, made[0].collect())) == sorted(map(tuple, made[1].collect()))
    assert {r.carried for r in made[1].collect()} == {True, False}


def test_attempts_are_counted_without_being_numbered(spark, small):
    for name in ("ag07_attempts_histogram", "ag07_tracking_totals"):
        assert "Window" not in plan(entry.queries()[name](spark, small)), name


def test_servo_readings_come_from_their_intervals(spark, small):
    rows = spark.sql("SELECT 0 AS episode, id AS row, id * id * 0.07D AS t, hash(id) % 9 / 3.0D AS yaw, hash(id, 1) % 7 / 7.0D AS opening FROM range(40)")
    got = {}
    for axis, chunk in ((Axis(single=True), 4096), (Axis(span=4.0), 3)):
        out = resample.servo_reference(rows, "t", {"yaw": 0.2, "opening": -0.3}, ["opening"], 0.5, axis, chunk)
        got[chunk] = {r["k"]: (r["yaw"], r["opening"]) for r in out.collect()}
    t, yaw, opening = ([r[c] for r in rows.orderBy("row").collect()] for c in ("t", "yaw", "opening"))

    def read(values, at):
        at = min(max(at, t[0]), t[-1])
        i = max(i for i in range(len(t) - 1) if t[i] <= at)
        return values[i] + (at - t[i]) / (t[i + 1] - t[i]) * (values[i + 1] - values[i])

    want = {k: (read(yaw, k * 0.5 + 0.2), min(read(opening, k * 0.5 - 0.3), read(opening, k * 0.5))) for k in range(1, round((t[-1] - t[0]) / 0.5) + 1)}
    for rows_ in got.values():
        assert rows_.keys() == want.keys()
        assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(rows_[k], want[k]))
    assert "REPARTITION_BY_NUM" in plan(entry.queries()["rs10_servo_reference"](spark, small))


def test_rows_that_share_the_end_give_no_servo_reading_there(spark):
    rows = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 0.0, 2.0), (0, 2, 1.0, 3.0), (0, 3, 1.0, 4.0)], "episode int, row long, t double, yaw double")
    for axis in (Axis(single=True), Axis(span=2.0)):
        out = dict(resample.servo_reference(rows, "t", {"yaw": 0.0}, [], 0.5, axis).select("k", "yaw").collect())
        assert out[1] == 2.5 and out[2] != out[2] and len(out) == 2


def test_entry_selection_sends_no_catalogue_through_the_driver(spark, small):
    entries = spark.createDataFrame([("a/b/c", "a", True), ("a/b/d", "a", False), ("a", "a", True), ("e/red", "e", True), ("e/red", "e", True), ("f/x", "f", True)], "id string, family string, usable boolean")
    patterns = spark.createDataFrame([("a/b/d", 7), ("a/b/d", 5), ("a/b/", 3), ("a/", 4), ("gone", 1), ("e/red", 9), (None, 2)], "pattern string, position long")
    out = sorted(map(tuple, catalog.select_entries(entries, patterns, ["e", "f"], "red").collect()))
    assert out == [("a/b/c", 3), ("a/b/d", 5), ("e/red", 9)]
    text = plan(entry.queries()["pj03_entry_selection"](spark, small))
    assert "BroadcastExchange" not in text and "REPARTITION_BY_NUM" in text


@pytest.fixture
def late_broadcasts(spark):
    """Large tables, whose small side is known to be small only when it has been made."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_streams_of_a_rate_limited_path_ask_for_whole_groups(spark):
    rows = spark.sql("SELECT id % 3 AS episode, id DIV 3 AS row, 1.0D AS x, 0.5D AS s FROM range(30)")
    lines = plan(folds.limited(rows, Axis(), "x", "s", "y")).splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "MapInArrow" in line or "MapInPandas" in line]
    assert len(below) == 3 and all("Window" in line for line in below)


def test_stages_of_scattered_events(spark, late_broadcasts):
    rows = spark.range(3000).selectExpr("id % 30 AS episode", "id DIV 30 AS row", "id DIV 30 / 4.0D AS t", "abs(hash(id DIV 30)) % 50 / 50.0D AS activity")
    events = rows.where("hash(row) % 3 = 0").selectExpr("episode", "IF(hash(row, 1) % 2 = 0, 'a', 'b') AS part", "row AS start", "row + 1 AS stop").repartition(6, "start")
    cuts = {}
    for r in folds.stage_cuts(events, rows, "t", Axis(), folds.Thresholds(lead=1.0, tail=0.5)).collect():
        cuts.setdefault(r.episode, set()).add(r.start)
    alone = {r.start for r in folds.stage_cuts(events.where("episode = 7").coalesce(1), rows.where("episode = 7"), "t", Axis(), folds.Thresholds(lead=1.0, tail=0.5)).collect()}
    assert len(alone) > 10 and cuts == {e: alone for e in range(30)}
