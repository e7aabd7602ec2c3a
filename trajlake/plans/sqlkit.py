"""Rigid-motion formulas as SQL text, for the checks of the pose queries."""
from __future__ import annotations

Q = ("qw", "qx", "qy", "qz")


def names(prefix: str, parts) -> list[str]:
    return [f"{prefix}{p}" for p in parts]


def q_of(prefix: str) -> list[str]:
    return names(prefix, Q)


def p_of(prefix: str) -> list[str]:
    return [f'"{prefix}{c}"' for c in "xyz"]


def conj(q) -> list[str]:
    return [q[0], *(f"(-{c})" for c in q[1:])]


def mul(a, b) -> list[str]:
    (w, x, y, z), (W, X, Y, Z) = a, b
    return [f"({w}*{W} - {x}*{X} - {y}*{Y} - {z}*{Z})", f"({w}*{X} + {x}*{W} + {y}*{Z} - {z}*{Y})",
            f"({w}*{Y} - {x}*{Z} + {y}*{W} + {z}*{X})", f"({w}*{Z} + {x}*{Y} - {y}*{X} + {z}*{W})"]


def matrix(q) -> list[list[str]]:
    w, x, y, z = q
    return [[f"(1 - 2*({y}*{y} + {z}*{z}))", f"(2*({x}*{y} - {w}*{z}))", f"(2*({x}*{z} + {w}*{y}))"],
            [f"(2*({x}*{y} + {w}*{z}))", f"(1 - 2*({x}*{x} + {z}*{z}))", f"(2*({y}*{z} - {w}*{x}))"],
            [f"(2*({x}*{z} - {w}*{y}))", f"(2*({y}*{z} + {w}*{x}))", f"(1 - 2*({x}*{x} + {y}*{y}))"]]


def six(q) -> list[str]:
    m = matrix(q)
    return [m[r][c] for c in (0, 1) for r in range(3)]


def apply(m, v) -> list[str]:
    return ["(" + " + ".join(f"{m[r][c]}*({v[c]})" for c in range(3)) + ")" for r in range(3)]


def transpose(m):
    return [list(r) for r in zip(*m)]


def minus(a, b) -> list[str]:
    return [f"({x} - {y})" for x, y in zip(a, b)]


def cross(a, b) -> list[str]:
    return [f"({a[1]}*{b[2]} - {a[2]}*{b[1]})", f"({a[2]}*{b[0]} - {a[0]}*{b[2]})", f"({a[0]}*{b[1]} - {a[1]}*{b[0]})"]


def length(v) -> str:
    return "sqrt(" + " + ".join(f"{c}*{c}" for c in v) + ")"


def log(q) -> list[str]:
    """Rotation vector of a unit quaternion of either sign."""
    n = length(q[1:])
    s = f"(CASE WHEN {q[0]} < 0 THEN -1 ELSE 1 END)"
    f = f"(CASE WHEN {n} < 1e-12 THEN 2.0 ELSE 2*atan2({n}, abs({q[0]}))/{n} END)"
    return [f"({c}*{s}*{f})" for c in q[1:]]


def alias(exprs, out, digits: int | None = None) -> str:
    if digits is None:
        return ", ".join(f"{e} AS {n}" for e, n in zip(exprs, out))
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for e, n in zip(exprs, out))


def lead(columns, prefix: str = "n_", window: str = "w") -> str:
    return ", ".join(f'lead("{c}") OVER {window} AS {prefix}{c}' for c in columns)
