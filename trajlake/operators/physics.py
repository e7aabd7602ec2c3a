"""Gates on recorded physics rollouts: end motion, contacts, carries, task outcome, verdicts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from .blocks import Axis


def end_motion(tracks: DataFrame, time: str, place: Sequence[str], axis: Axis, *, window: float, still: float) -> DataFrame:
    """How a track ends: its last valid row, and its speed since the earliest valid row inside the window before
    that (null when there is none)."""
    keys = list(axis.keys)
    seen = F.struct(F.col(axis.order).alias("row"), F.col(time).alias("t"), *place)
    valid = tracks.where(F.col("valid"))
    last = valid.groupBy(*keys).agg(F.max_by(seen, axis.order).alias("e"))
    inside = valid.join(last, keys).where((F.col(time) >= F.col("e.t") - window - 1e-9) & (F.col(time) < F.col("e.t") - 1e-9))
    first = inside.groupBy(*keys).agg(F.min_by(seen, axis.order).alias("s"))
    out = last.join(first, keys, "left")
    gone = F.sqrt(sum(((F.col(f"e.{c}") - F.col(f"s.{c}")) * (F.col(f"e.{c}") - F.col(f"s.{c}")) for c in place), F.lit(0.0)))
    dt = F.col("e.t") - F.col("s.t")
    return out.select(*keys, F.col("e.row").alias("source_row"), F.col("e.t").alias("source_time"), dt.alias("window"),
                      (gone / dt).alias("speed"), (gone / dt < still).alias("at_rest"))


def failing(gates: Sequence[tuple[str, Column, Column]]) -> Column:
    """Reasons ``name: detail`` of the gates that do not hold, in gate order."""
    made = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail")) for n, ok, detail in gates])
    return F.transform(F.filter(made, lambda g: ~g["ok"]), lambda g: F.concat(g["name"], F.lit(": "), g["detail"]))


def depth_rule(depth: Column, reference: Column, *, absolute: float, margin: float) -> list[Column]:
    """Penetration gate relative to the source: threshold, verdicts and the rule in words."""
    threshold = F.greatest(F.lit(absolute), reference + margin)
    four = lambda c: fixed(c, 4)
    rule = F.when(reference.isNull(), F.concat(F.lit("absolute threshold "), four(F.lit(absolute)), F.lit(" m (no source reference)"))).otherwise(
        F.concat(F.lit("source-relative threshold "), four(threshold), F.lit(" m = max(absolute "), four(F.lit(absolute)),
                 F.lit(" m, source reference "), four(reference), F.lit(" m + "), four(F.lit(margin)), F.lit(" m)")))
    return [threshold.alias("threshold"), (depth <= threshold).alias("passed"), (depth <= absolute).alias("passed_absolute"), rule.alias("rule")]


def deepest_contacts(contacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deepest contact of every object with every other body, robots and its own body excluded.

    A contact between two objects counts for both. Ties go to the earliest frame."""
    kept = contacts.where(~F.col("is_robot_a") & ~F.col("is_robot_b") & (F.col("depth") > 0) & (F.col("body_a") != F.col("body_b")))
    ends = F.explode(F.array(*[F.struct(F.col(f"body_{s}").alias("object"), F.col(f"body_{o}").alias("other"), F.col(f"is_object_{s}").alias("ok"))
                               for s, o in (("a", "b"), ("b", "a"))]))
    rows = kept.select(*keys, "frame", "depth", ends.alias("e")).where("e.ok")
    best = F.max_by(F.struct("depth", "frame"), F.struct(F.col("depth"), -F.col("frame")))
    return rows.groupBy(*keys, "e.object", "e.other").agg(best.alias("b")).select(*keys, "object", "other", "b.depth", "b.frame")


def carries(rows: DataFrame, closed: Column, lift: Column, bilateral: Column, place: Sequence[Column], axis: Axis, *, acquisition: float, dt: float) -> DataFrame:
    """Carry phases: inside a closed run, from the first row with both pads on and the object lifted.

    Per phase: rows carried, share with both pads on, and how far the object moved in the hand."""
    from .sequence import mark_runs
    names = [f"__p{i}" for i in range(len(place))]
    out = mark_runs(rows.withColumns(dict(zip(names, place)) | {"__lift": lift, "__both": bilateral}), F.when(closed, F.lit(1)), axis, "run")
    run = [*axis.keys, "run"]
    row = F.col(axis.order)
    held = out.where(F.col("run").isNotNull())
    got = held.groupBy(*run).agg(F.min_by(F.struct(row.alias("row"), *names), F.when(F.col("__both") & (F.col("__lift") > acquisition), row)).alias("a"))
    # min_by ignores rows whose ordering is null: only acquiring rows compete, none leaves null
    held = held.join(got.where(F.col("a").isNotNull()), run).where(row >= F.col("a.row"))
    gone = F.sqrt(sum(((F.col(n) - F.col(f"a.{n}")) * (F.col(n) - F.col(f"a.{n}")) for n in names), F.lit(0.0)))
    return held.groupBy(*run).agg(F.min(row).alias("acquired"), (F.max(row) + 1).alias("released"), (F.count(F.lit(1)) * dt).alias("carry_s"),
                                  (F.count_if("__both") * dt).alias("bilateral_s"), F.max(gone).alias("translation"))


def rest_required(bodies: DataFrame) -> DataFrame:
    """Whether a free body must be motionless at the end, and why."""
    reason = (F.when(F.col("object").isNull(), "no source track").when(F.col("at_rest").isNull(), "source end speed unknown")
              .when(F.col("held_at_end"), "held by a hand at the episode end")
              .when(F.col("at_rest"), "source at rest at its end").otherwise("source moving at its end"))
    required = F.col("object").isNull() | F.col("at_rest").isNull() | F.col("held_at_end") | F.col("at_rest")
    return bodies.withColumns({"required": F.coalesce(required, F.lit(True)), "reason": reason})


def parked(bodies: DataFrame, workspace: DataFrame, keys: Sequence[str], far: float) -> DataFrame:
    """Free bodies farther than ``far`` from every workspace point of their episode."""
    d = F.sqrt(sum(((F.col(f"b{c}") - F.col(f"w{c}")) * (F.col(f"b{c}") - F.col(f"w{c}")) for c in "xyz"), F.lit(0.0)))
    near = bodies.join(workspace, list(keys)).groupBy(*keys, "object").agg(F.min(d).alias("distance"))
    return near.where(F.col("distance") > far)
