"""Grasp-frame offsets."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rotation
from .vectors import Vec


def offset(flip: Column, theta_deg: Column, beta_deg: Column, lift: Column) -> tuple[Vec, Column]:
    """Row-major rotation and z of a grasp offset: pulled back by ``lift`` along the approach axis, turned
    about it by ``theta`` (plus half a turn when flipped), then tilted about the closing axis by ``beta``."""
    half_a = (F.when(flip, F.lit(math.pi)).otherwise(F.lit(0.0)) + F.radians(theta_deg)) / 2.0
    half_b = F.radians(beta_deg) / 2.0
    zero = F.lit(0.0)
    q = rotation.multiply((F.cos(half_a), zero, zero, F.sin(half_a)), (F.cos(half_b), zero, F.sin(half_b), zero))
    return rotation.to_matrix(q), -lift
