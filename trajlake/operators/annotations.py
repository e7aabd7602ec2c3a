"""Row rules of source annotations: roles, names, instructions, commands, success."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def role_by_evidence() -> Column:
    """Object role from evidence flags, the strongest first."""
    return (F.when(F.col("grasped"), "manipulated").when(F.col("inside"), "receptacle").when(F.col("on"), "support")
            .when(F.col("fixed"), "fixture").when(F.col("moved"), "manipulated").otherwise("fixture"))


def synset(instance: Column) -> Column:
    """Object class of an instance name: without its trailing number."""
    return F.regexp_replace(instance, "_[0-9]+$", "")


def instruction(template: str, *words: Column) -> Column:
    return F.format_string(template.replace("{}", "%s"), *words)


def command(action: str) -> Column:
    """Gripper command 0..1 (1 = close) of a recorded action in [-1, 1]."""
    return (F.col(action) + 1.0) / 2.0


def binary_command(action: str) -> Column:
    """Aggregate: whether every action is fully open or fully closed (else the command is unusable)."""
    return F.bool_and(F.abs(F.abs(F.col(action)) - 1.0) < 1e-6)


def sparse_success(reward: str) -> Column:
    """Aggregate: whether a 0/1 reward reached 1; null for shaped or missing rewards."""
    return F.when(F.bool_and(F.coalesce(F.col(reward).isin(0, 1), F.lit(False))), F.max(reward) >= 1)


def cylinder_axis(half: Column, tol: float) -> Column:
    """Axis of the cylinder a box may stand for: the one whose two other half extents agree best; null above ``tol``."""
    gaps = F.array(F.abs(half[1] - half[2]), F.abs(half[0] - half[2]), F.abs(half[0] - half[1]))
    best = F.array_min(gaps)
    return F.when(best <= tol, F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array_position(gaps, best).cast("int")))
