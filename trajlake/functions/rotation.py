"""Unit quaternions (w, x, y, z) as tuples of four Columns, plus the 9- and 6-value forms."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec, cross, dot, norm, scale, sub

TINY = 1e-12


def normalize(q: Sequence[Column]) -> Vec:
    n = norm(q)
    return tuple(c / n for c in q)


def canonical(q: Sequence[Column]) -> Vec:
    """The one of the two equal quaternions with w >= 0."""
    sign = F.when(q[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(c * sign for c in q)


def conjugate(q: Sequence[Column]) -> Vec:
    return (q[0], -q[1], -q[2], -q[3])


def multiply(a: Sequence[Column], b: Sequence[Column]) -> Vec:
    v = tuple(a[0] * b[i + 1] + b[0] * a[i + 1] + c for i, c in enumerate(cross(a[1:], b[1:])))
    return (a[0] * b[0] - dot(a[1:], b[1:]), *v)


def rotate(q: Sequence[Column], v: Sequence[Column]) -> Vec:
    """v turned by q."""
    t = scale(cross(q[1:], v), 2.0)
    return tuple(v[i] + q[0] * t[i] + c for i, c in enumerate(cross(q[1:], t)))


def unrotate(q: Sequence[Column], v: Sequence[Column]) -> Vec:
    """v expressed in the frame whose axes are turned by q."""
    return rotate(conjugate(q), v)


def angle(q: Sequence[Column]) -> Column:
    """Rotation angle in [0, pi]; the atan2 form keeps full precision near 0 and pi."""
    return 2.0 * F.atan2(norm(q[1:]), F.abs(q[0]))


def log(q: Sequence[Column]) -> Vec:
    """Rotation vector of a quaternion with w >= 0."""
    n = norm(q[1:])
    factor = F.when(n < TINY, F.lit(2.0)).otherwise(2.0 * F.atan2(n, q[0]) / n)
    return scale(q[1:], factor)


def exp(w: Sequence[Column]) -> Vec:
    """Quaternion of a rotation vector."""
    theta = norm(w)
    factor = F.when(theta < TINY, F.lit(0.5)).otherwise(F.sin(theta / 2.0) / theta)
    return (F.cos(theta / 2.0), *scale(w, factor))


def to_matrix(q: Sequence[Column]) -> Vec:
    """Row-major 3 x 3 matrix of a unit quaternion."""
    w, x, y, z = q
    return (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def from_matrix(m: Sequence[Column]) -> Vec:
    """Unit quaternion with w >= 0 of a row-major rotation matrix (largest component first)."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    four = {"w": 1 + m00 + m11 + m22, "x": 1 + m00 - m11 - m22, "y": 1 - m00 + m11 - m22, "z": 1 - m00 - m11 + m22}
    top = F.greatest(*four.values())
    lead = F.sqrt(top) / 2.0
    by = {"w": (top / 4.0, (m21 - m12) / 4.0, (m02 - m20) / 4.0, (m10 - m01) / 4.0),
          "x": ((m21 - m12) / 4.0, top / 4.0, (m01 + m10) / 4.0, (m02 + m20) / 4.0),
          "y": ((m02 - m20) / 4.0, (m01 + m10) / 4.0, top / 4.0, (m12 + m21) / 4.0),
          "z": ((m10 - m01) / 4.0, (m02 + m20) / 4.0, (m12 + m21) / 4.0, top / 4.0)}

    def component(i: int) -> Column:
        pick = F.when(four["w"] == top, by["w"][i]).when(four["x"] == top, by["x"][i]) \
                .when(four["y"] == top, by["y"][i]).otherwise(by["z"][i])
        return pick / lead

    return canonical(tuple(component(i) for i in range(4)))


def six(q: Sequence[Column]) -> Vec:
    """First two matrix columns, one after the other."""
    m = to_matrix(q)
    return (m[0], m[3], m[6], m[1], m[4], m[7])


def six_to_matrix(v: Sequence[Column]) -> Vec:
    """Row-major matrix of a 6-value rotation (orthonormalised); null when either axis is degenerate."""
    x, y = v[:3], v[3:]
    nx = norm(x)
    ux = tuple(c / nx for c in x)
    y = sub(y, scale(ux, dot(ux, y)))
    ny = norm(y)
    uy = tuple(c / ny for c in y)
    uz = cross(ux, uy)
    ok = (nx >= 1e-6) & (ny >= 1e-6)
    return tuple(F.when(ok, c) for i in range(3) for c in (ux[i], uy[i], uz[i]))


def slerp(a: Sequence[Column], relative_log: Sequence[Column], s) -> Vec:
    """Geodesic from a by the fraction s of ``relative_log`` = log(conj(a) b)."""
    return multiply(a, exp(scale(relative_log, s)))


def look_at(direction: Sequence[Column]) -> Vec:
    """Row-major matrix with +X along ``direction`` and +Y horizontal.

    Near the vertical +Y is the world's, made orthogonal to +X; a zero direction looks along +X."""
    n = norm(direction)
    still = n <= 1e-9
    x = tuple(F.when(still, F.lit(d)).otherwise(c / n) for c, d in zip(direction, (1.0, 0.0, 0.0)))
    flat = F.sqrt(x[0] * x[0] + x[1] * x[1])
    level = (-x[1], x[0], F.lit(0.0))
    hint = (-x[0] * x[1], 1.0 - x[1] * x[1], -x[2] * x[1])
    y = tuple(F.when(flat > 1e-5, a).otherwise(b) for a, b in zip(level, hint))
    ny = norm(y)
    y = tuple(c / ny for c in y)
    z = cross(x, y)
    return tuple(c for i in range(3) for c in (x[i], y[i], z[i]))
