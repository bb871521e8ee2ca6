"""Thresholds that define results, by area. Lengths in metres, angles in degrees."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Defaults of the reconstruction operators (fixed values); ``checked`` rejects nonsense."""

    grid: float = 0.02
    contour_tolerance: float = 0.04
    minimum_wall_length: float = 0.5
    minimum_thickness: float = 0.08
    maximum_thickness: float = 0.6
    assumed_thickness: float = 0.2
    exterior_thickness: float = 0.3
    level_bin: float = 0.05
    minimum_storey_height: float = 2.0
    minimum_footprint: float = 1.0
    maximum_grid_cells: int = 20_000_000
    voxel: float = 0.02
    point_budget: int = 5_000_000
    region_neighbours: int = 24
    region_radius: float = 0.2
    normal_radius: float = 0.1
    region_minimum_points: int = 30
    region_angle: float = 15.0
    plane_distance: float = 0.025
    curvature: float = 0.04
    opening_edge: float = 0.65
    opening_recess: float = 0.03
    headroom: float = 2.0
    void_margin: float = 0.1
    merge_angle: float = 2.0
    merge_lateral: float = 0.08
    merge_gap: float = 0.35
    corner_snap: float = 0.3
    t_snap: float = 0.2
    t_snap_angle: float = 25.0
    slab_raster: float = 0.08
    slab_gap: float = 0.16
    slab_minimum_thickness: float = 0.08
    slab_maximum_thickness: float = 0.60
    slab_overlap: float = 0.45
    slab_spacing: float = 5.5

    def checked(self) -> Settings:
        for f in fields(self):
            if not getattr(self, f.name) > 0:
                raise ValueError(f"{f.name} must be positive")
        if self.minimum_thickness >= self.maximum_thickness or self.slab_minimum_thickness >= self.slab_maximum_thickness:
            raise ValueError("minimum thickness must be below the maximum")
        return self


#: Opening classifier: least and most width and height, least vacancy.
OPENING_WIDTH, OPENING_HEIGHT, OPENING_VACANCY = (0.5, 3.2), (0.55, 2.8), 0.8
#: Tread lattice: rise, going, their tolerances, least number of treads, largest share that may be missing.
TREAD_RISE, TREAD_GOING, TREAD_TOLERANCES, TREAD_LEAST, TREAD_MISSING = (0.10, 0.24), (0.18, 0.45), (0.025, 0.045, 0.10), 4, 0.40
