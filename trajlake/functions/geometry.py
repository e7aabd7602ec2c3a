"""Object shapes: boxes, cylinders and unions of boxes in the object frame.

A geometry column is a struct with the fields ``kind``, ``frame``, ``center``, ``half_extents``,
``radius``, ``half_length``, ``axis`` and ``boxes`` (see ``trajlake.schema``).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec

# Fixed values: (z low, z high, radius) of the robot body around its base axis, in metres.
BODY_BANDS = ((-10.0, 0.30, 0.25), (0.30, 0.95, 0.14), (0.95, 1.45, 0.19))


def _triple(a: Column) -> Column:
    return F.size(F.coalesce(a, F.array().cast("array<double>"))) == 3


def _zero3() -> Column:
    return F.array(*[F.lit(0.0)] * 3)


def box_parts(g: Column) -> Column:
    """``array<struct<center, half>>`` of the solid boxes of a geometry; null when it has none.

    A union of boxes gives its parts (null if any part is malformed); a cylinder its bounding box."""
    in_body = F.coalesce(g["frame"], F.lit("body")) == "body"
    center = F.coalesce(g["center"], _zero3())
    part = F.struct(center.alias("center"), g["half_extents"].alias("half"))
    axis = F.when(g["axis"] == "x", 0).when(g["axis"] == "y", 1).when(F.coalesce(g["axis"], F.lit("z")) == "z", 2)
    halves = F.array(*[F.when(axis == i, g["half_length"]).otherwise(g["radius"]) for i in range(3)])
    cylinder = F.struct(center.alias("center"), halves.alias("half"))
    union = F.transform(g["boxes"], lambda b: F.struct(F.coalesce(b["center"], _zero3()).alias("center"),
                                                       b["half_extents"].alias("half")))
    sound = F.forall(union, lambda b: _triple(b["center"]) & _triple(b["half"])) & (F.size(union) > 0)
    return (F.when(in_body & (g["kind"] == "boxes"), F.when(sound, union))
            .when(in_body & g["kind"].isin("box", "aabb"), F.when(_triple(g["half_extents"]) & _triple(center), F.array(part)))
            .when(in_body & (g["kind"] == "cylinder"),
                  F.when(axis.isNotNull() & g["radius"].isNotNull() & g["half_length"].isNotNull() & _triple(center),
                         F.array(cylinder))))


def enclosing_box(parts: Column) -> Column:
    """``struct<center, half>`` around a list of boxes."""
    def edge(i: int, sign: int) -> Column:
        values = F.transform(parts, lambda b: b["center"][i] + sign * b["half"][i])
        return F.array_max(values) if sign > 0 else F.array_min(values)

    low, high = [edge(i, -1) for i in range(3)], [edge(i, 1) for i in range(3)]
    return F.when(parts.isNotNull(), F.struct(F.array(*[(a + b) / 2 for a, b in zip(low, high)]).alias("center"),
                                              F.array(*[(b - a) / 2 for a, b in zip(low, high)]).alias("half")))


def box_distance(rel: Vec, parts: Column) -> Column:
    """Distance from an object-frame point to the nearest box of a list; 0 inside."""
    def one(b: Column) -> Column:
        over = [F.greatest(F.abs(rel[i] - b["center"][i]) - b["half"][i], F.lit(0.0)) for i in range(3)]
        return F.sqrt(over[0] * over[0] + over[1] * over[1] + over[2] * over[2])
    return F.array_min(F.transform(parts, one))


def box_depth(rel: Vec, parts: Column) -> Column:
    """How deep an object-frame point lies inside the deepest box of a list; 0 outside."""
    def one(b: Column) -> Column:
        return F.least(*[b["half"][i] - F.abs(rel[i] - b["center"][i]) for i in range(3)])
    return F.greatest(F.array_max(F.transform(parts, one)), F.lit(0.0))


def cylinder_distance(radial: Column, axial: Column, radius: Column, half_length: Column) -> Column:
    a = F.greatest(radial - radius, F.lit(0.0))
    b = F.greatest(F.abs(axial) - half_length, F.lit(0.0))
    return F.sqrt(a * a + b * b)


def box_extent(direction: Vec, half: Vec) -> Column:
    """Extent of a box along an object-frame unit direction."""
    return 2.0 * (F.abs(direction[0]) * half[0] + F.abs(direction[1]) * half[1] + F.abs(direction[2]) * half[2])


def cylinder_extent(along: Column, radius: Column, half_length: Column) -> Column:
    """Extent of a cylinder along a unit direction whose axial component is ``along``."""
    c = F.least(F.abs(along), F.lit(1.0))
    return 2.0 * (radius * F.sqrt(1.0 - c * c) + half_length * c)


def thinnest_extent(parts: Column) -> Column:
    return 2.0 * F.array_min(F.transform(parts, lambda b: F.array_min(b["half"])))


def body_radius(low: Column, high: Column, bands=BODY_BANDS) -> Column:
    """Largest body radius among the bands that overlap [low, high]; 0 where none does."""
    radius = F.lit(0.0)
    for lo, hi, r in bands:
        radius = F.greatest(radius, F.when((low < hi) & (high > lo), F.lit(r)).otherwise(F.lit(0.0)))
    return radius


def effective_colour(part: Column, material: Column) -> Column:
    """A part's own colour unless it is the default grey, else its material's when there is one."""
    default = (0.5, 0.5, 0.5, 1.0)
    grey = F.lit(True)
    for i, v in enumerate(default):
        grey = grey & (F.abs(part[i] - v) <= 1e-8 + 1e-5 * v)
    return F.when(grey & material.isNotNull(), material).otherwise(part)
