"""Blocked sequence operators against plain Python, with blocks far shorter than the episodes."""
from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import sequence as S
from trajlake.operators.blocks import Axis, interval_join, number_rows, quantile, running, shift

AXIS = Axis(("episode",), "row", 7)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for episode, n in ((1, 200), (2, 3), (3, 1), (4, 40)):
        t = 0.0
        for row in range(n):
            t += rng.choice([0.1, 0.2, 0.35])
            rows.append((episode, row, round(t, 3), rng.random(), rng.choice([None, None, "a", "b"])))
    return rows


@pytest.fixture(scope="module")
def frames(spark, data):
    rows = list(data)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "episode long, row long, t double, v double, label string").repartition(5)


def episodes(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def collected(df, *names):
    return {tuple(r[n] for n in ("episode", "row")): tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_shift_crosses_blocks(frames, data):
    got = collected(shift(frames, AXIS, {"n3": (F.col("v"), 3), "p2": (F.col("v"), -2)}), "n3", "p2")
    for e, rows in episodes(data).items():
        for i, r in enumerate(rows):
            want = (rows[i + 3][3] if i + 3 < len(rows) else None, rows[i - 2][3] if i >= 2 else None)
            assert got[(e, i)] == want


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_values(frames, data, reverse, exclusive):
    specs = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "l": ("last", F.col("label"))}
    got = collected(running(frames, AXIS, specs, reverse=reverse, exclusive=exclusive), "s", "hi", "lo", "l")
    for e, rows in episodes(data).items():
        order = rows[::-1] if reverse else rows
        for i, r in enumerate(order):
            seen = order[: i if exclusive else i + 1]
            s, hi, lo, last = got[(e, r[1])]
            if not seen:
                assert hi is None and lo is None and last is None
                continue
            assert s == pytest.approx(sum(x[3] for x in seen))
            assert (hi, lo) == (max(x[3] for x in seen), min(x[3] for x in seen))
            assert last == next((x[4] for x in reversed(seen) if x[4] is not None), None)


def test_number_rows(spark, data):
    rng = random.Random(5)
    rows = [(e, rng.random() * 100, i) for e, n in ((1, 300), (2, 4)) for i in range(n)]
    df = number_rows(spark.createDataFrame(rows, "episode long, x double, id long"), ["episode"], ["x", "id"], F.floor(F.col("x") / 3), firsts={"x0": F.col("x")})
    for e in (1, 2):
        want = sorted((x, i) for ee, x, i in rows if ee == e)
        got = sorted((r.row, r.x, r.id) for r in df.collect() if r.episode == e)
        assert [(x, i) for _, x, i in got] == want and [k for k, *_ in got] == list(range(len(want)))
        assert {r.x0 for r in df.collect() if r.episode == e} == {want[0][0]}


def python_runs(labels):
    out, start = [], 0
    for i in range(1, len(labels) + 1):
        if i == len(labels) or labels[i] != labels[start]:
            if labels[start] is not None:
                out.append((labels[start], start, i))
            start = i
    return out


def test_runs(frames, data):
    got = sorted((r.episode, r.label, r.start, r.stop) for r in S.runs(frames, F.col("label"), AXIS).collect())
    want = sorted((e, *run) for e, rows in episodes(data).items() for run in python_runs([r[4] for r in rows]))
    assert got == want


def test_one_run_over_many_blocks(spark):
    df = spark.range(500).select(F.lit(1).alias("episode"), F.col("id").alias("row"), F.lit("x").alias("label"))
    assert [(r.start, r.stop) for r in S.runs(df, F.col("label"), AXIS).collect()] == [(0, 500)]


def test_bridge(frames, data):
    table = S.runs(frames, F.col("label"), AXIS, {"t0": F.min("t"), "t1": F.max("t")})
    got = sorted((r.episode, r.label, r.start, r.stop, r.pieces) for r in
                 S.bridge(table, F.col("t0") - F.col("prev_t1"), 0.6, AXIS, same=["label"]).collect())
    want = []
    for e, rows in episodes(data).items():
        merged = []
        for label, a, b in python_runs([r[4] for r in rows]):
            if merged and merged[-1][0] == label and rows[a][2] - rows[merged[-1][2] - 1][2] < 0.6:
                merged[-1] = (label, merged[-1][1], b, merged[-1][3] + 1)
            else:
                merged.append((label, a, b, 1))
        want += [(e, *m) for m in merged]
    assert got == sorted(want)


def test_gradient_is_numpys(frames, data):
    got = collected(S.gradient(frames, "t", {"g": F.col("v")}, AXIS), "g")
    for e, rows in episodes(data).items():
        if len(rows) < 2:
            continue
        want = np.gradient([r[3] for r in rows], [r[2] for r in rows])
        assert [got[(e, i)] for i in range(len(rows))] == pytest.approx(list(want))


def test_asof_both_ways(spark, frames, data):
    probes = spark.createDataFrame([(e, x / 4) for e in (1, 2, 3, 4) for x in range(0, 60, 3)], "episode long, t double")
    clock = Axis(("episode",), "t", 1.5)
    back = {(r.episode, r.t): r.row for r in S.asof(probes, frames, "t", ["row"], clock).collect()}
    ahead = {(r.episode, r.t): r.row for r in S.asof(probes, frames, "t", ["row"], clock, forward=True).collect()}
    for e, rows in episodes(data).items():
        times = [r[2] for r in rows]
        for x in range(0, 60, 3):
            i, j = np.searchsorted(times, x / 4, side="right") - 1, np.searchsorted(times, x / 4, side="left")
            assert back[(e, x / 4)] == (i if i >= 0 else None)
            assert ahead[(e, x / 4)] == (j if j < len(times) else None)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantile_is_numpys(frames, data, q):
    got = {r.episode: r.q for r in quantile(frames, ["episode"], F.col("v"), q, name="q", span=0.05).collect()}
    for e, rows in episodes(data).items():
        assert got[e] == pytest.approx(np.quantile([r[3] for r in rows], q))


def test_fill_forward_and_next(frames, data):
    filled = collected(S.fill_forward(frames, {"f": F.col("label")}, AXIS), "f")
    ahead = collected(S.next_value(frames, "n", F.col("label"), AXIS), "n")
    for e, rows in episodes(data).items():
        labels = [r[4] for r in rows]
        first = next((x for x in labels if x is not None), None)
        last = None
        for i, x in enumerate(labels):
            last = x if x is not None else last
            assert filled[(e, i)] == (last if last is not None else first)
            assert ahead[(e, i)] == next((y for y in labels[i:] if y is not None), None)


def test_interval_join(spark, frames, data):
    windows = spark.createDataFrame([(1, "w1", 2.0, 9.5), (1, "w2", 9.0, 9.1), (4, "w3", -1.0, 100.0), (2, "w4", 5.0, 4.0)], "episode long, name string, low double, high double")
    got = sorted((r.episode, r.row, r.name) for r in interval_join(frames, windows, ["episode"], "t", "low", "high", 0.7).collect())
    want = sorted((r[0], r[1], w[1]) for r in data for w in [(1, "w1", 2.0, 9.5), (1, "w2", 9.0, 9.1), (4, "w3", -1.0, 100.0)] if w[0] == r[0] and w[2] <= r[2] <= w[3])
    assert got == want


def test_moving_average_repeats_the_ends(spark):
    values = [1.0, 5.0, 2.0, 8.0, 3.0]
    df = spark.createDataFrame([(1, i, v, 1, 2, 4) for i, v in enumerate(values)], "episode long, row long, v double, b long, a long, last_row long")
    got = collected(S.smooth(df, {"m": F.col("v")}, "b", "a", AXIS), "m")
    for i in range(5):
        want = np.mean([values[min(max(i + j, 0), 4)] for j in range(-1, 3)])
        assert got[(1, i)] == pytest.approx(want)


def test_sliding_max_truncates(frames, data):
    df = frames.withColumn("k", F.when(F.col("episode") == 1, 3).otherwise(1))
    got = collected(S.sliding_max(df, "v", "k", AXIS, name="m"), "m")
    for e, rows in episodes(data).items():
        k = 3 if e == 1 else 1
        for i in range(len(rows)):
            assert got[(e, i)] == max(r[3] for r in rows[max(0, i - k): i + k + 1])


@pytest.mark.parametrize("span", [4.0, 65536.0])
def test_sliding_windows_of_every_width(spark, span):
    """Windows narrower and wider than their group, against the plain definition; blocks of four rows and one block."""
    rng = np.random.default_rng(3)
    rows, axis = [], S.FRAMES.by("row", span)
    for e in range(40):
        n, half, b, a = int(rng.integers(1, 14)), int(rng.integers(0, 9)), int(rng.integers(0, 6)), int(rng.integers(0, 6))
        rows += [(e, i, float(v), half, b, a, n - 1, 1.7) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "episode long, row long, v double, k long, b long, a long, last_row long, s double")
    top = collected(S.sliding_max(df, "v", "k", axis, name="m"), "m")
    mean, bell = collected(S.smooth(df, {"m": F.col("v")}, "b", "a", axis), "m"), collected(S.smooth(df, {"m": F.col("v")}, "b", "a", axis, sigma="s"), "m")
    of = {}
    for e, _, v, *_ in rows:
        of.setdefault(e, []).append(v)
    for e, i, _, k, b, a, last, s in rows:
        taps = [of[e][min(max(i + j, 0), last)] for j in range(-b, a + 1)]
        weights = np.exp(-0.5 * (np.arange(-b, a + 1) / s) ** 2)
        assert top[(e, i)] == max(of[e][max(0, i - k): i + k + 1])
        assert mean[(e, i)] == pytest.approx(np.mean(taps)) and bell[(e, i)] == pytest.approx(np.average(taps, weights=weights))


def test_quantile_has_one_rounding(spark):
    """Levels between two values are those of a fused multiply-add, to the last bit."""
    from fractions import Fraction
    import math
    import random
    draw = random.Random(7)
    rows = [(e, round(draw.uniform(0, 500), 2) / 500.0) for e in range(60) for _ in range(40 + e)]
    got = {r.episode: r.q for r in quantile(spark.createDataFrame(rows, "episode long, v double"), ["episode"], F.col("v"), 0.95, name="q", span=0.05).collect()}
    for e in range(60):
        vs = sorted(v for k, v in rows if k == e)
        at = (len(vs) - 1) * 0.95
        part, low, high = at - math.floor(at), vs[math.floor(at)], vs[math.ceil(at)]
        assert got[e] == float(Fraction(low) * Fraction(1.0 - part) + Fraction(high * part))


def test_short_episodes_cost_no_frame_each(spark):
    """Blocks come by in a stream of batches, not as one pandas frame per episode; one batch may cut a block anywhere."""
    from trajlake.operators import folds
    from trajlake.operators.blocks import Axis
    import random
    draw = random.Random(3)
    rows = [(e, r, draw.uniform(-1, 1), draw.uniform(0, 0.4)) for e in range(12) for r in range(1 + 3 * e)]
    df = spark.createDataFrame(rows, "episode long, row long, x double, s double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for span, batch in ((65536, 4), (5, 3), (4, 10000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            for reverse in (False, True):
                out = folds.limited(df, Axis(("episode",), "row", span), "x", "s", "y", reverse=reverse)
                assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
                got = {(r.episode, r.row): r.y for r in out.collect()}
                assert len(got) == len(rows)
                for e in range(12):
                    y = None
                    for _, r, x, s in sorted((t for t in rows if t[0] == e), reverse=reverse):
                        y = x if y is None else min(max(x, y - s), y + s)
                        assert got[e, r] == pytest.approx(y, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
