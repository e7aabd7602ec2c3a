"""Gripper scales and motion profiles."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clip

# Finger joint range (rad), and the linkage that turns a finger angle into a pad gap:
# proximal link angle p = LINK_OFFSET + LINK_SLOPE * angle, pivots PIVOT_HALF apart from the centre
# line, link LINK_LENGTH, pad face PAD_INSET inside the distal link.
LOWER, UPPER = -0.0803, 2.27
LINK_OFFSET, LINK_SLOPE = 0.554, -0.4689
PIVOT_HALF, LINK_LENGTH, PAD_INSET = 0.0379, 0.05, 0.0125
KNOTS = 2001


def opening_of_angle(angle: Column) -> Column:
    return clip((angle - LOWER) / (UPPER - LOWER), 0.0, 1.0)


def angle_of_opening(opening: Column) -> Column:
    return LOWER + clip(opening, 0.0, 1.0) * (UPPER - LOWER)


def _gap(angle: Column) -> Column:
    """Pad gap of the parallel linkage, negative once the pads would overlap."""
    return 2.0 * (PIVOT_HALF - PAD_INSET - LINK_LENGTH * F.sin(LINK_OFFSET + LINK_SLOPE * angle))


def _gap_value(angle: float) -> float:
    return 2.0 * (PIVOT_HALF - PAD_INSET - LINK_LENGTH * math.sin(LINK_OFFSET + LINK_SLOPE * angle))


#: Angle at which the pads meet, and the widest gap.
CONTACT_ANGLE = (math.asin((PIVOT_HALF - PAD_INSET) / LINK_LENGTH) - LINK_OFFSET) / LINK_SLOPE
MAX_WIDTH = _gap_value(UPPER)


def width_of_angle(angle: Column) -> Column:
    """Pad separation (m), 0 below contact; linear between the knots of the angle grid."""
    step = (UPPER - LOWER) / (KNOTS - 1)
    at = (clip(angle, LOWER, UPPER) - LOWER) / step
    k = F.least(F.floor(at), F.lit(KNOTS - 2))
    low, high = _gap(LOWER + k * step), _gap(LOWER + (k + 1) * step)
    return F.greatest(low + (at - k) * (high - low), F.lit(0.0))


def angle_of_width(width: Column) -> Column:
    """Finger angle of a pad separation (clipped to the stroke): the closed-form inverse of the linkage."""
    w = clip(width, 0.0, MAX_WIDTH)
    return (F.asin((PIVOT_HALF - PAD_INSET - w / 2.0) / LINK_LENGTH) - LINK_OFFSET) / LINK_SLOPE


def jerk_polynomial(s: Column) -> Column:
    """The quintic of a minimum-jerk move, also beyond its two ends."""
    return s * s * s * (10.0 - 15.0 * s + 6.0 * s * s)


def min_jerk(u: Column) -> Column:
    """Position along a minimum-jerk move at phase u."""
    return jerk_polynomial(clip(u, 0.0, 1.0))


def move_duration(distance: Column, turn: Column, speed: float, turn_rate: float, least: float) -> Column:
    """Shortest minimum-jerk duration whose peak speeds stay within the limits."""
    return F.greatest(F.lit(float(least)), 1.875 * F.greatest(distance / speed, turn / turn_rate))
