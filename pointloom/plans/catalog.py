"""All queries of the engine and their DuckDB texts."""

from __future__ import annotations

from pointloom.plans import assembly, clouds, elements, plan_cells, recognition, relations, spatial, structure  # noqa: F401
from pointloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "crop_voxel_levels"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
