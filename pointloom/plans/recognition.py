"""Queries whose core is a bounded kernel; sequential by definition, so rows only (tests hold them against known buildings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import ordered as O
from pointloom.operators import recognise as R
from pointloom.operators.cloud import num
from pointloom.plans.registry import query
from pointloom.sources.tables import generated_room, orders_cloud, read


def room(spark):
    return O.numbered(generated_room(spark), (), "x", "y", "z", name="rid").withColumn("rid", F.col("rid").cast("long"))


def rooms(spark, d):
    """The room once for every hundred suppliers (at least once), as storeys of their own."""
    number = (read(spark, d, "supplier").count() + 99) // 100
    return room(spark).crossJoin(F.broadcast(spark.range(max(1, number)).withColumnRenamed("id", "storey")))


@query()
def level_peaks(spark, d):
    """Peaks of the room's heights: floor and ceiling."""
    return spark.createDataFrame([(b,) for b in R.level_peaks(room(spark))], "bin long")


@query()
def streaming_levels(spark, d):
    return R.streaming_levels(room(spark), 0.05, 0.25, 4000)


@query()
def detected_storeys(spark, d):
    return R.detected_storeys(room(spark))


@query()
def point_normals(spark, d):
    n = R.point_normals(orders_cloud(spark, d), 0.5)
    return n.select("rid", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz", "curvature")])


@query()
def grown_regions(spark, d):
    """Planar regions of the room."""
    return R.grown_regions(R.point_normals(room(spark), 0.12).withColumn("storey", F.lit(0).cast("long")), "storey").groupBy("storey", "region").agg(F.count(F.lit(1)).alias("points"))


@query()
def multi_slice_walls(spark, d):
    """Faces of the walls and partitions of a building: a room for every hundred suppliers, one storey each."""
    return R.multi_slice_walls(rooms(spark, d), "storey", 0.2, 2.8)


@query()
def reconstructed_walls(spark, d):
    """From a cloud to walls: storeys' outlines, faces by slices, faces paired to walls, in millimetres."""
    cloud = rooms(spark, d)
    walls = R.walls_from_faces(R.multi_slice_walls(cloud, "storey", 0.2, 2.8), R.footprints(cloud, "storey"), "storey")
    mm = lambda c: F.round(F.col(c) * num(1e3)).cast("long").alias(f"{c}_mm")
    return walls.select("storey", "wall", "label", "faces", *map(mm, ("x0", "y0", "x1", "y1", "thickness")))


@query()
def tread_sequences(spark, d):
    """Flights among tread patches: eight treads for each supplier, some missing, with unrelated patches."""
    k, n = F.col("s_suppkey"), F.col("n")
    t = read(spark, d, "supplier").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9))))
    x = F.when(n < 8, n * num(0.28)).otherwise(num(5) + n)
    treads = t.where(~((k % 3 == 0) & (n == 3))).select(k.alias("grp"), n.cast("long").alias("id"), (x + k % 5).alias("x"), (k % 7).cast("double").alias("y"), (F.when(n < 8, n * num(0.17)).otherwise(num(0.4))).alias("z"), num(0).alias("ax"), num(1).alias("ay"), num(1.1).alias("width"))
    return R.flights(treads, "grp").select("grp", "flight", "ids", "steps", "missing", F.round("rise", 6).alias("rise"), F.round("going", 6).alias("going"))


@query()
def slab_sequence(spark, d):
    z = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("long").alias("building"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7) % 90 / num(10)).alias("bottom"), (F.col("p_size") / num(50)).alias("score"))
    return R.slab_sequence(z.withColumn("top", F.col("bottom") + num(0.3)), "building")
