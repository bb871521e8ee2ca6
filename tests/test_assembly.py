"""Composed steps against planted buildings and plain reimplementations."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pointloom.operators import assembly as A
from pointloom.operators import raster as M


def wall(spark, holes, width=40, height=27, wall_id=1, planes=(0,), lost=()):
    rows = [(wall_id, p, x, y) for p in planes for x in range(width) for y in range(height) if (x, y) not in lost and not any(a <= x <= b and c <= y <= d for a, b, c, d in holes)]
    return spark.createDataFrame(rows, "wall long, plane long, ix long, iy long"), spark.createDataFrame([(wall_id, width / 10, height / 10)], "wall long, length double, height double")


def found(mask, sizes):
    return sorted(tuple(r) for r in A.detected_openings(mask, sizes, 0.1).select("kind", "x0", "x1", "y0", "y1").collect())


def test_openings_are_found_once_and_small_or_open_gaps_are_none(spark):
    mask, sizes = wall(spark, [(4, 12, 0, 20), (20, 30, 9, 19), (35, 36, 10, 12), (39, 39, 0, 26)], planes=(0, 1), lost={(1, 1), (15, 22), (25, 3)})
    assert found(mask, sizes) == [("door", 4, 12, 0, 20), ("window", 20, 30, 9, 19)]


def test_no_returns_no_openings(spark):
    mask, sizes = wall(spark, [])
    assert found(mask, sizes) == [] and found(mask.limit(0), sizes) == []


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_flood_fill(spark, seed):
    rnd = random.Random(seed)
    cells = {(rnd.randrange(2), rnd.randrange(-4, 12), rnd.randrange(-70, 80)) for _ in range(900)}
    cells |= {(0, x, y) for x in (20, 22) for y in range(200)} | {(0, 21, 150)}
    label, todo = {}, sorted(cells)
    for c0 in todo:
        if c0 in label:
            continue
        label[c0], queue = c0, deque([c0])
        while queue:
            g, x, y = queue.popleft()
            for n in ((g, x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if n in cells and n not in label:
                    label[n] = c0
                    queue.append(n)
    df = spark.createDataFrame([*cells, *list(cells)[:9]], "grp long, ix long, iy long")
    got = {(r.grp, r.ix, r.iy): r.component for r in M.labelled(df).collect()}
    assert got == {k: (g * 2**20 + x) * 2**20 + y for k, (g, x, y) in label.items()}


def test_ends_meet_in_corners_and_junctions_and_short_walls_stay(spark):
    rows = [(0, 1, 0.0, 0.0, 4.0, 0.0), (0, 2, 4.04, 0.02, 4.0, 3.0), (0, 3, 2.0, 0.1, 2.0, 3.0), (0, 4, 0.0, 2.0, 0.5, 2.0), (1, 5, 2.0, 0.1, 2.0, 3.0), (0, 6, 3.0, 5.0, 3.1, 5.0)]
    walls = spark.createDataFrame(rows, "storey long, id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: r for r in A.snapped_topology(walls, 0.15, 0.3).collect()}
    assert (got[1].x1_mm, got[1].y1_mm) == (got[2].x0_mm, got[2].y0_mm) == (4020, 10) and got[1].end == got[2].start == "corner"
    assert (got[3].x0_mm, got[3].y0_mm, got[3].start, got[3].end) == (2000, 0, "junction", "free")
    assert (got[5].y0_mm, got[5].start) == (100, "free")  # the wall below is of another storey
    assert got[6].restored and (got[6].x0_mm, got[6].x1_mm) == (3000, 3100)
    assert not got[4].restored


def test_faces_with_one_row_of_openings_are_a_wall(spark):
    faces = spark.createDataFrame([(0, 1, 0.0, 0.0, 6.0), (0, 2, 0.2, 1.0, 7.0), (0, 3, 0.4, 0.0, 6.0), (0, 4, 3.0, 0.0, 6.0), (1, 5, 0.2, 0.0, 6.0)], "storey long, id long, offset double, a0 double, a1 double")
    openings = spark.createDataFrame([(1, "door", 2.0), (2, "door", 2.05), (1, "window", 4.0), (2, "window", 4.0), (3, "door", 2.0), (4, "door", 2.0), (5, "door", 2.0)], "face long, kind string, centre double")
    assert [(r.a, r.b, r.matches, r.thickness_mm, r.lo, r.hi) for r in A.faces_by_openings(faces, openings, (0.06, 0.6), 0.1).collect()] == [(1, 2, 2, 200, 1.0, 6.0)]


def test_aligned_frames_are_a_facade(spark):
    frames = [(1, k, k * 1.1, k * 1.1 + 1.0, 0.5, 1.5, 0.9) for k in range(4)] + [(1, 9, 4.4, 5.4, 0.5, 1.5, 0.4), (1, 10, 5.5, 6.5, 0.5, 1.5, 0.9)] + [(2, 20 + k, k * 1.5, k * 1.5 + 1.0, 0.5, 1.5, 0.9) for k in range(6)]
    got = A.facade_groups(spark.createDataFrame(frames, "host long, id long, lo double, hi double, sill double, height double, rail double")).collect()
    assert sorted((r.host, r.grp, r.id) for r in got) == [(1, 0, k) for k in range(4)]


def test_outline_of_a_frame_has_one_hole(spark):
    ring = [(0, x, y, 1) for x in range(5) for y in range(4) if x in (0, 4) or y in (0, 3)] + [(0, 10, 10, 2), (0, 11, 11, 2)]
    got = {r.component: (r.area, r.border, r.holes) for r in A.outlines(spark.createDataFrame(ring, "grp long, ix long, iy long, component long")).collect()}
    assert got == {1: (14, 28, 1), 2: (2, 8, 0)}


def test_a_leaning_slab_has_its_slope(spark):
    rows = [(0, x / 10, y / 10, 1.0 + 0.02 * x / 10 - 0.01 * y / 10, 1.0, 0.0) for x in range(20) for y in range(20)] + [(0, 0.0, 0.0, k / 10, 0.0, 0.0) for k in range(30)]
    r = A.horizontal_surfaces(spark.createDataFrame(rows, "grp long, x double, y double, z double, nz double, curvature double"), "grp", 0.1, 20, 0.5).collect()
    assert len(r) == 1 and r[0].points == 400 and r[0].cells == 16 and abs(r[0].slope_x - 20000) < 400 and abs(r[0].slope_y + 10000) < 400


def test_seed_planes_take_the_pair_with_most_neighbours(spark):
    near = [(1, 0, 1), (0, 0, 1), (1, 0, 0), (0, 1, 0), (1, 1, 0), (-1, 0, 0)]
    points = spark.createDataFrame([(7, 0.0, 0.0, 0.0), (8, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    rows = [(7, k + 1, *map(float, p)) for k, p in enumerate(near)] + [(8, 1, 1.0, 0.0, 0.0)]
    got = A.seed_planes(points, spark.createDataFrame(rows, "id long, rank int, nx double, ny double, nz double"), 0.01).collect()
    assert [r.id for r in got] == [7]
    planes = []
    for a, b in ((0, 1), (2, 3), (4, 5)):
        (ax, ay, az), (bx, by, bz) = near[a], near[b]
        n = (ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)
        planes.append(sum(abs(sum(p * q for p, q in zip(n, v))) <= 0.01 * math.sqrt(sum(p * p for p in n)) for v in near))
    assert got[0].inliers == max(planes) and got[0].pair == planes.index(max(planes)) + 1


def test_model_of_a_room_has_its_walls_and_its_door(spark, sf):
    from pointloom.plans.assembly import doored_rooms

    rows = A.reconstructed(doored_rooms(spark, sf).where("storey = 0"), "storey", 0.2, 2.8, 3.0).collect()
    walls, holes = [r for r in rows if r.kind == "wall"], [r for r in rows if r.kind != "wall"]
    assert len(walls) == 5 and sum(r.label == "paired_faces" for r in walls) == 1
    (door,) = holes
    host = next(r for r in walls if r.wall == door.wall)
    ends = sorted(host.y0_mm + math.copysign(v, host.y1_mm - host.y0_mm) for v in (door.x0_mm, door.x1_mm))
    assert host.label == "paired_faces" and door.kind == "door" and door.y0_mm == 0 and abs(door.y1_mm - 2050) <= 100
    assert abs(ends[0] - 1000) <= 150 and abs(ends[1] - 1875) <= 150


def test_profiles_that_change_their_area_are_refused(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    r = spark.range(1).select(A.clean_profile(ring((0, 0), (2, 0), (4, 0), (4, 0), (4, 3)), 1e-6).alias("a"), A.clean_profile(ring((0, 0), (2, 0), (4, 0)), 1e-6).alias("b")).first()
    assert [(p.x, p.y) for p in r.a] == [(0, 0), (4, 0), (4, 3)] and r.b is None
