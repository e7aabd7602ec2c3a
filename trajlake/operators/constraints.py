"""Schema constraints as violation tables: one row per broken rule, nothing raised inside a job."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Axis, shift


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that break a row rule: ``(message, condition that must hold)``; an unknown condition passes."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(message)) for message, ok in rules]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def finite(*columns: Column) -> Column:
    return reduce(Column.__and__, [~F.isnan(c) & (F.abs(c) != float("inf")) for c in columns])


def clock_violations(df: DataFrame, time: str, axis: Axis, *, step: float | None = None, tol: float = 1e-6) -> DataFrame:
    """Rows at which a clock does not increase, or is not uniform when ``step`` is given."""
    out = shift(df.select(*axis.keys, axis.order, time), axis, {"__next": (F.col(time), 1)})
    gap = F.col("__next") - F.col(time)
    rules = [("time must increase", gap > 0)]
    if step is not None:
        rules.append(("time must be uniform", F.abs(gap - step) <= tol))
    return violations(out.where(F.col("__next").isNotNull()), [*axis.keys, axis.order], rules)


def unit_quaternion(q: Sequence[Column], tol: float = 1e-6) -> Column:
    return F.abs(sum((c * c for c in q), F.lit(0.0)) - 1.0) <= tol


def every(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
