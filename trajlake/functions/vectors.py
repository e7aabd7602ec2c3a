"""Small fixed-size vectors as tuples of Columns, and projection staging for them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def cols(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def add(a: Sequence[Column], b: Sequence[Column]) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Sequence[Column], b: Sequence[Column]) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Sequence[Column], s) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Sequence[Column], b: Sequence[Column]) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, _lit(high)), _lit(low))


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


class Sheet:
    """A frame under construction.

    Rigid-motion formulas use each input many times. ``put`` projects an intermediate vector
    once and hands back plain column references, so the expression tree of the next formula
    stays small and every stage compiles into the same code-generation span.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    def put(self, name: str, vec: Sequence[Column]) -> Vec:
        names = [f"__{name}_{i}" for i in range(len(vec))]
        self.df = self.df.withColumns(dict(zip(names, vec)))
        return tuple(F.col(n) for n in names)

    def put_one(self, name: str, value: Column) -> Column:
        return self.put(name, [value])[0]

    def select(self, *columns) -> DataFrame:
        return self.df.select(*columns)

    def finish(self, **columns: Column) -> DataFrame:
        """The input columns plus ``columns``, without the staged intermediates."""
        kept = [c for c in self.df.columns if not c.startswith("__") and c not in columns]
        return self.df.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in columns.items()])
