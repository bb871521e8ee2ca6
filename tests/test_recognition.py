"""Recognition on a generated room whose faces and levels are known."""

import math

from pyspark.sql import functions as F

from pointloom.operators import recognise as R
from pointloom.plans.recognition import room


def test_levels_and_storey(spark):
    cloud = room(spark)
    assert R.level_peaks(cloud) == [0, 60]
    (s,) = R.detected_storeys(cloud).collect()
    assert abs(s.elevation) < 1e-9 and abs(s.ceiling - 3) < 1e-9 and abs(s.hull_area - 24) < 2
    kept = R.streaming_levels(cloud, 0.05, 0.25, 4000)
    assert {r.peak for r in kept.select("peak").distinct().collect()} == {0, 60}


def test_every_face_is_found_and_no_other(spark):
    cloud = room(spark).withColumn("storey", F.lit(0).cast("long"))
    got = R.multi_slice_walls(cloud, "storey", 0.2, 2.8).collect()
    truth = [(0, 0, 6, 0), (0, 4, 6, 4), (0, 0, 0, 4), (6, 0, 6, 4), (2.9, 0, 2.9, 4), (3.1, 0, 3.1, 4)]

    def on(f, t):
        d, n = ((1, 0), (0, 1)) if t[1] == t[3] else ((0, 1), (1, 0))
        off = max(abs((f.x0 - t[0]) * n[0] + (f.y0 - t[1]) * n[1]), abs((f.x1 - t[0]) * n[0] + (f.y1 - t[1]) * n[1]))
        return off <= 0.08 and math.dist((f.x0, f.y0), (f.x1, f.y1)) >= 0.5

    assert all(any(on(f, t) for f in got) for t in truth)
    assert all(any(on(f, t) for t in truth) for f in got)


def test_normals_of_planes(spark):
    floor = room(spark).where("z = 0 AND x < 1 AND y < 1")
    for r in R.point_normals(floor, 0.12).collect():
        assert abs(r.nz - 1) < 1e-6 and r.curvature < 1e-9


def test_flights_of_the_query(spark, sf):
    from pointloom.plans.recognition import tread_sequences

    rows = tread_sequences(spark, sf).collect()
    assert {r.steps for r in rows} == {8} and all(r.missing == (r.grp % 3 == 0) for r in rows)


def test_walls_of_the_room(spark, sf):
    from pointloom.plans.recognition import reconstructed_walls

    rows = reconstructed_walls(spark, sf).where("storey = 0").collect()
    (pair,) = [r for r in rows if r.label == "paired_faces"]
    assert abs(pair.thickness_mm - 200) <= 60 and abs((pair.x0_mm + pair.x1_mm) / 2 - 3000) <= 60 and abs(abs(pair.y1_mm - pair.y0_mm) - 4000) <= 200
    outside = [r for r in rows if r.label == "exterior_candidate"]
    assert len(outside) == 4 and {r.thickness_mm for r in outside} == {300} and len(rows) <= 6
