"""Angles and planar (x, y, yaw) motion."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec


def wrap(a: Column) -> Column:
    """Angle in [-pi, pi). ``pmod`` is the floor modulo; ``%`` would keep the sign of the dividend."""
    return F.pmod(a + math.pi, F.lit(2.0 * math.pi)) - math.pi


def to_body(dx: Column, dy: Column, yaw: Column) -> Vec:
    c, s = F.cos(yaw), F.sin(yaw)
    return (c * dx + s * dy, c * dy - s * dx)


def to_world(dx: Column, dy: Column, yaw: Column) -> Vec:
    c, s = F.cos(yaw), F.sin(yaw)
    return (c * dx - s * dy, s * dx + c * dy)


def relative(a: Vec, b: Vec) -> Vec:
    """Displacement from a to b in a's frame, turn wrapped."""
    return (*to_body(b[0] - a[0], b[1] - a[1], a[2]), wrap(b[2] - a[2]))


def compose(a: Vec, d: Vec) -> Vec:
    x, y = to_world(d[0], d[1], a[2])
    return (a[0] + x, a[1] + y, a[2] + d[2])


def _arc(t: Column) -> tuple[Column, Column]:
    """(sin t / t, (1 - cos t) / t) with their limits at 0."""
    zero = F.abs(t) < 1e-12
    safe = F.when(zero, F.lit(1.0)).otherwise(t)
    half = F.sin(safe / 2.0)
    return (F.when(zero, F.lit(1.0)).otherwise(F.sin(safe) / safe),
            F.when(zero, F.lit(0.0)).otherwise(2.0 * half * half / safe))


def log(d: Vec, dt: float) -> Vec:
    """Constant body twist that reaches displacement d after dt."""
    t = wrap(d[2])
    a, b = _arc(t)
    n = a * a + b * b
    return ((a * d[0] + b * d[1]) / n / dt, (a * d[1] - b * d[0]) / n / dt, t / dt)


def exp(twist: Vec, dt: float) -> Vec:
    x, y, t = (c * dt for c in twist)
    a, b = _arc(t)
    return (a * x - b * y, b * x + a * y, t)
