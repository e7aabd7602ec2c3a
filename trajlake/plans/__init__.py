"""Named queries over the landed tables, with the SQL each one is checked against."""
from __future__ import annotations

from .registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    """Every registered query, by name."""
    from . import catalogue, flagship, folding, gating, generated, grasp_paths, labelling, motions, movements, reports, resampling, rollouts, scenes, sequences, streams, views  # noqa: F401
    return QUERIES
