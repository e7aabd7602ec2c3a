"""Rigid poses as (position, quaternion) pairs of Column tuples, and the ``pose7`` struct."""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rotation
from .vectors import Vec, add, cross, norm, scale, sub

FIELDS = ("x", "y", "z", "qw", "qx", "qy", "qz")
POSE7 = "struct<" + ",".join(f"{f}:double" for f in FIELDS) + ">"


class Pose(NamedTuple):
    p: Vec
    q: Vec


def pose(column: str) -> Pose:
    """The parts of a ``pose7`` struct column."""
    c = F.col(column)
    return Pose(tuple(c[f] for f in FIELDS[:3]), tuple(c[f] for f in FIELDS[3:]))


def pose7(value: Pose) -> Column:
    return F.struct(*[c.alias(n) for n, c in zip(FIELDS, (*value.p, *value.q))])


def planar(x: Column, y: Column, yaw: Column) -> Pose:
    zero = F.lit(0.0)
    return Pose((x, y, zero), (F.cos(yaw / 2.0), zero, zero, F.sin(yaw / 2.0)))


def inverse(a: Pose) -> Pose:
    q = rotation.conjugate(a.q)
    return Pose(scale(rotation.rotate(q, a.p), -1.0), q)


def compose(a: Pose, b: Pose) -> Pose:
    return Pose(add(a.p, rotation.rotate(a.q, b.p)), rotation.multiply(a.q, b.q))


def relative(a: Pose, b: Pose) -> Pose:
    """b seen from a."""
    return Pose(rotation.unrotate(a.q, sub(b.p, a.p)), rotation.multiply(rotation.conjugate(a.q), b.q))


def log(position: Sequence[Column], w: Sequence[Column]) -> Vec:
    """Twist (v, w) of a pose with translation ``position`` and rotation vector ``w``."""
    theta = norm(w)
    small = theta < 1e-6
    safe = F.when(small, F.lit(1.0)).otherwise(theta)
    c = F.when(small, F.lit(1.0 / 12.0)).otherwise(
        (1.0 - safe * F.sin(safe) / (2.0 * (1.0 - F.cos(safe)))) / (safe * safe))
    wp = cross(w, position)
    wwp = cross(w, wp)
    return (*(position[i] - 0.5 * wp[i] + c * wwp[i] for i in range(3)), *w)


def exp(twist: Sequence[Column]) -> Pose:
    v, w = twist[:3], twist[3:]
    theta = norm(w)
    small = theta < 1e-6
    safe = F.when(small, F.lit(1.0)).otherwise(theta)
    a = F.when(small, F.lit(0.5)).otherwise((1.0 - F.cos(safe)) / (safe * safe))
    b = F.when(small, F.lit(1.0 / 6.0)).otherwise((safe - F.sin(safe)) / (safe * safe * safe))
    wv = cross(w, v)
    wwv = cross(w, wv)
    return Pose(tuple(v[i] + a * wv[i] + b * wwv[i] for i in range(3)), rotation.exp(w))
