"""Queries with spatial joins, wall evidence, rasters, components and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import cluster as K
from pointloom.operators import evidence as E
from pointloom.operators import graph as H
from pointloom.operators import grid as G
from pointloom.operators import raster as R
from pointloom.operators.cloud import num
from pointloom.plans.registry import query
from pointloom.sources.tables import CLOUD_SQL, orders_cloud, read

RADIUS, MARGIN = 0.3, 0.1
FACES_SQL = """f0 AS (SELECT s_suppkey AS face, ((s_suppkey * 7) % 100) / 10e0 AS x0, ((s_suppkey * 13) % 80) / 10e0 AS y0, CASE s_suppkey % 4 WHEN 0 THEN 3e0 WHEN 1 THEN 0e0 WHEN 2 THEN 1.5e0 ELSE -2e0 END AS dx, CASE s_suppkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 2e0 WHEN 2 THEN 2e0 ELSE 1.5e0 END AS dy FROM supplier),
f1 AS (SELECT face, face % 10 AS wall, x0, y0, x0 + dx AS x1, y0 + dy AS y1, 0.2e0 AS z0, 2.6e0 AS z1 FROM f0),
f2 AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM f1),
faces AS (SELECT *, (x1 - x0) / length AS ux, (y1 - y0) / length AS uy FROM f2)"""
NEAR_SQL = f"""{CLOUD_SQL}, {FACES_SQL},
j AS (SELECT *, (x - x0) * ux + (y - y0) * uy AS along, (y - y0) * ux - (x - x0) * uy AS resid FROM cloud, faces),
near AS (SELECT * FROM j WHERE z BETWEEN z0 - {MARGIN}e0 AND z1 + {MARGIN}e0 AND abs(resid) <= {RADIUS}e0 AND along BETWEEN -{MARGIN}e0 AND length + {MARGIN}e0)"""


def faces(spark, d):
    """Vertical faces: a segment in the plan and a height range."""
    k = F.col("s_suppkey")
    step = lambda *v: F.element_at(F.array(*[num(a) for a in v]), (k % 4 + 1).cast("int"))
    x0, y0 = ((k * 7) % 100) / num(10), ((k * 13) % 80) / num(10)
    out = read(spark, d, "supplier").select(k.alias("face"), (k % 10).alias("wall"), x0.alias("x0"), y0.alias("y0"), (x0 + step(3, 0, 1.5, -2)).alias("x1"), (y0 + step(0, 2, 2, 1.5)).alias("y1"), num(0.2).alias("z0"), num(2.6).alias("z1"))
    return G.with_frame(out)


def near_shapes(spark, d):
    """Points near each shape of a face, as rows of its first face, and the faces of the shapes."""
    shapes, members = G.face_shapes(faces(spark, d))
    return G.points_near_faces(orders_cloud(spark, d), shapes, RADIUS, MARGIN), members


def each_face(spark, d, use):
    """What ``use`` makes of the points near a shape, for each of its faces."""
    near, members = near_shapes(spark, d)
    return G.each_face(use(near), members)


@query(f"WITH {NEAR_SQL} SELECT face, rid, CAST(round(along * 1e6) AS BIGINT) AS along_micro, CAST(round(resid * 1e6) AS BIGINT) AS resid_micro FROM near")
def face_selection(spark, d):
    """Points within buffered faces, by the cell join."""
    shapes, members = G.face_shapes(faces(spark, d))
    near = G.points_near_faces(G.dealt(orders_cloud(spark, d)), shapes, RADIUS, MARGIN)
    return G.all_faces(near.select("face", "rid", E.micro(F.col("along")).alias("along_micro"), E.micro(F.col("resid")).alias("resid_micro")), members)


@query(f"WITH {NEAR_SQL} SELECT count(*) AS pairs, CAST(sum(rid * face) AS BIGINT) AS checksum FROM near")
def face_index_equivalence(spark, d):
    """The cell join finds exactly the pairs of a nested loop.

    The checksum is a BIGINT where that holds it; a larger one, where the SQL's cast fails, is a DECIMAL(38,0) with all its digits.
    """
    near, members = near_shapes(spark, d)
    exact = lambda v: F.sum(F.col(v).cast("decimal(38,0)"))
    found = near.groupBy("face").agg(F.count(F.lit(1)).alias("points"), exact("rid").cast("decimal(24,0)").alias("rids"))
    own = members.groupBy("shape").agg(F.count(F.lit(1)).alias("faces"), exact("face").cast("decimal(13,0)").alias("ids"))
    each = found.join(own, F.col("face") == F.col("shape"))
    row = each.agg(F.sum(F.col("points") * F.col("faces")).alias("pairs"), F.sum(F.col("rids") * F.col("ids")).alias("checksum")).first()
    kind = "long" if row.checksum is None or -(2**63) <= row.checksum < 2**63 else "decimal(38,0)"
    return spark.range(1, numPartitions=1).select(F.lit(row.pairs or 0).cast("long").alias("pairs"), F.lit(row.checksum).cast(kind).alias("checksum"))


@query(f"WITH {NEAR_SQL}, s AS (SELECT face, scan, count(DISTINCT rid) AS n FROM near GROUP BY ALL) SELECT face, scan, n FROM s")
def scan_evidence_counts(spark, d):
    return each_face(spark, d, lambda near: E.scan_counts(near))


@query(f"""WITH {NEAR_SQL}, e AS (SELECT wall, rid, min(abs(resid)) AS d FROM near GROUP BY ALL)
SELECT wall, count(*) AS n, CAST(round(sqrt(CAST(sum(CAST(round(d * d * 1e9) AS BIGINT)) AS BIGINT) / 1e9 / count(*)) * 1e6) AS BIGINT) AS rmse_micro, CAST(round(max(d) * 1e6) AS BIGINT) AS max_micro FROM e GROUP BY wall""")
def face_evidence(spark, d):
    """Points, RMSE and largest distance per wall, each point with the nearest of the wall's faces."""
    near, members = near_shapes(spark, d)
    walls = members.select("shape", "wall").distinct()
    return E.fit_quality(near.join(G.small(walls), F.col("face") == F.col("shape")), "wall")


@query(f"""WITH {NEAR_SQL}, b AS (SELECT *, CAST(floor(resid / 0.02e0) AS BIGINT) AS bin FROM near), h AS (SELECT face, bin, count(*) AS n FROM b GROUP BY ALL),
md AS (SELECT face, min(bin) AS median_bin FROM (SELECT *, sum(n) OVER (PARTITION BY face ORDER BY bin) AS c, sum(n) OVER (PARTITION BY face) AS t FROM h) WHERE c * 2 >= t + 1 GROUP BY face),
dv AS (SELECT face, abs(bin - median_bin) AS dev, sum(n) AS n FROM h JOIN md USING (face) GROUP BY ALL),
mad AS (SELECT face, min(dev) AS mad_bin FROM (SELECT *, sum(n) OVER (PARTITION BY face ORDER BY dev) AS c, sum(n) OVER (PARTITION BY face) AS t FROM dv) WHERE c * 2 >= t + 1 GROUP BY face),
k AS (SELECT face, median_bin, mad_bin, CAST(round(along * 1e4) AS BIGINT) AS a, CAST(round(resid * 1e4) AS BIGINT) AS r FROM b JOIN md USING (face) JOIN mad USING (face) WHERE abs(bin - median_bin) <= greatest(1, 3 * mad_bin)),
s AS (SELECT face, median_bin, mad_bin, count(*) AS n, CAST(sum(a) AS BIGINT) AS sa, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(a * a) AS BIGINT) AS saa, CAST(sum(a * r) AS BIGINT) AS sar FROM k GROUP BY ALL)
SELECT face, median_bin, mad_bin, n, CASE WHEN n * saa - sa * sa <> 0 THEN CAST(round((n * sar - sa * sr)::DOUBLE / (n * saa - sa * sa)::DOUBLE * 1e6) AS BIGINT) END AS slope_micro, CAST(round(sr::DOUBLE / n / 1e4 * 1e6) AS BIGINT) AS offset_micro FROM s""")
def face_refit(spark, d):
    """Robust refit of every face on the original points."""
    return each_face(spark, d, lambda near: E.refit(near, 0.02))


@query(f"""WITH {NEAR_SQL}, c AS (SELECT face, least(11, greatest(0, CAST(floor((z - z0) / (z1 - z0) * 12e0) AS BIGINT))) AS band, count(*) AS n FROM near GROUP BY ALL), t AS (SELECT face, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY face)
SELECT face, total, count(*) FILTER (n >= greatest(6e0, 0.005e0 * total)) AS bands FROM c JOIN t USING (face) GROUP BY ALL""")
def height_support(spark, d):
    return each_face(spark, d, lambda near: E.height_support(near))


SLICE_SQL = "sl AS (SELECT DISTINCT face, CAST(floor(along / 0.1e0) AS BIGINT) AS col, CAST(floor(z / 0.4e0) AS BIGINT) AS slice FROM near)"


@query(f"WITH {NEAR_SQL}, {SLICE_SQL} SELECT face, col, slice FROM sl")
def slice_occupancy(spark, d):
    return each_face(spark, d, lambda near: near.select("face", F.floor(F.col("along") / num(0.1)).cast("long").alias("col"), F.floor(F.col("z") / num(0.4)).cast("long").alias("slice")).distinct())


@query(f"""WITH {NEAR_SQL}, {SLICE_SQL}, c AS (SELECT face, col FROM sl GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT *, CASE WHEN col - lag(col) OVER (PARTITION BY face ORDER BY col) <= 2 THEN 0 ELSE 1 END AS new FROM c), s AS (SELECT *, sum(new) OVER (PARTITION BY face ORDER BY col) AS run FROM g)
SELECT face, min(col) AS start, max(col) AS "end", count(*) AS cells FROM s GROUP BY face, run""")
def supported_extents(spark, d):
    return each_face(spark, d, lambda near: E.supported_extents(near, 0.1, 0.4))


@query(f"WITH {NEAR_SQL} SELECT face, CAST(floor(along / 0.25e0) AS BIGINT) AS px, CAST(floor(z / 0.25e0) AS BIGINT) AS pz, count(*) AS n, CAST(sum(CAST(round(resid * 1e6) AS BIGINT)) AS BIGINT) AS sum_micro, min(abs(resid)) AS least FROM near GROUP BY ALL")
def raster_stats(spark, d):
    return each_face(spark, d, lambda near: E.raster_stats(near, 0.25))


@query(f"""WITH {NEAR_SQL}, p AS (SELECT *, CAST(floor(along / 0.25e0) AS BIGINT) AS px, CAST(floor(z / 0.25e0) AS BIGINT) AS pz FROM near), r AS (SELECT *, row_number() OVER (PARTITION BY face, px, pz ORDER BY abs(resid), resid) AS kd, row_number() OVER (PARTITION BY face, px, pz ORDER BY abs(resid), scan, rid) AS kr FROM p)
SELECT face, px, pz, count(*) FILTER (abs(resid) <= 0.1e0) AS face_n, count(*) FILTER (abs(resid) > 0.1e0) AS return_n, max(resid) FILTER (kd = 1) AS depth, max(rid) FILTER (kr = 1) AS nearest_rid FROM r GROUP BY ALL""")
def wall_image(spark, d):
    return each_face(spark, d, lambda near: E.wall_image(near, 0.25, 0.1))


@query(f"WITH {NEAR_SQL}, h AS (SELECT face, CAST(floor(resid / 0.05e0) AS BIGINT) AS bin, count(*) AS n FROM near GROUP BY ALL) SELECT face, bin AS top_bin FROM (SELECT *, row_number() OVER (PARTITION BY face ORDER BY n DESC, bin) AS k FROM h) WHERE k = 1")
def dominant_offset(spark, d):
    """Fullest offset bin of each face, first on ties."""
    bin_ = F.floor(F.col("resid") / num(0.05)).cast("long").alias("bin")
    return each_face(spark, d, lambda near: E.most_common_bin(near.groupBy("face", bin_).agg(F.count(F.lit(1)).alias("n")), "face"))


@query(f"""WITH {CLOUD_SQL}, {FACES_SQL}, j AS (SELECT face, rid, z, (x - x0) * ux + (y - y0) * uy AS a, (y - y0) * ux - (x - x0) * uy AS r, length FROM cloud, faces)
SELECT face, rid FROM j WHERE sqrt(r * r + greatest(-a, a - length, 0e0) * greatest(-a, a - length, 0e0)) <= 0.25e0""")
def near_segments(spark, d):
    """Points of a low slice within 0.25 m of a face's segment."""
    size, reach = 0.5, 0.25
    shapes, members = G.face_shapes(faces(spark, d))
    cells = G.small(G.face_cells(shapes, size, reach))
    cloud = G.dealt(orders_cloud(spark, d)).withColumn("cx", G.cell(F.col("x"), size)).withColumn("cy", G.cell(F.col("y"), size))
    return G.all_faces(cloud.join(cells, ["cx", "cy"]).where(G.segment_distance(F.col("x"), F.col("y")) <= num(reach)).select("face", "rid"), members)


LOW_SQL = f"{CLOUD_SQL}, low AS (SELECT * FROM cloud)"


@query(f"WITH {LOW_SQL} SELECT a.rid, count(*) AS n FROM low a JOIN low b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0625e0 AND abs(a.x - b.x) <= 0.25e0 GROUP BY a.rid")
def radius_neighbours(spark, d):
    return G.neighbour_counts(orders_cloud(spark, d), 0.25)


@query(f"""WITH {LOW_SQL}, p AS (SELECT a.rid, b.rid AS neighbour, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM low a JOIN low b ON a.rid <> b.rid AND abs(a.x - b.x) <= 0.3e0)
SELECT rid, CAST(k AS INTEGER) AS k, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d2, neighbour) AS k FROM p WHERE d2 <= 0.3e0 * 0.3e0) WHERE k <= 6""")
def knn(spark, d):
    """Six nearest others within 0.3 m."""
    return G.nearest_k(orders_cloud(spark, d), 6, 0.3)


@query(f"WITH {CLOUD_SQL} SELECT rid, z FROM cloud a WHERE z > 2.8e0 AND EXISTS (SELECT 1 FROM cloud b WHERE b.z < 0.2e0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.15e0 * 0.15e0)")
def near_support_semijoin(spark, d):
    """High points with a low point beneath them."""
    cloud = orders_cloud(spark, d)
    return G.near_support(cloud.where("z > 2.8D"), cloud.where("z < 0.2D"), 0.15).select("rid", "z")


@query(f"""WITH {CLOUD_SQL}, t AS (SELECT rid, scan, x, y, unnest(generate_series(CAST(floor((x - 0.4e0) / 2e0) AS BIGINT), CAST(floor((x + 0.4e0) / 2e0) AS BIGINT))) AS tx FROM cloud), u AS (SELECT *, unnest(generate_series(CAST(floor((y - 0.4e0) / 2e0) AS BIGINT), CAST(floor((y + 0.4e0) / 2e0) AS BIGINT))) AS ty FROM t)
SELECT tx, ty, count(*) AS points, count(*) FILTER (tx = floor(x / 2e0) AND ty = floor(y / 2e0)) AS core FROM u GROUP BY ALL""")
def tile_halo(spark, d):
    out = G.tiles_with_halo(orders_cloud(spark, d), 2.0, 0.4)
    return out.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("points"), F.count_if("core").alias("core"))


# --- rasters ---------------------------------------------------------------------------------------

MASK_SQL = f"{CLOUD_SQL}, mask AS (SELECT DISTINCT scan AS grp, CAST(floor(x / 0.25e0 + 1e-9) AS BIGINT) AS ix, CAST(floor(y / 0.25e0 + 1e-9) AS BIGINT) AS iy FROM cloud)"
OFFSETS_SQL = "o AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b))"
DILATED_SQL = f"{OFFSETS_SQL}, dl AS (SELECT DISTINCT grp, ix + a AS ix, iy + b AS iy FROM mask, o)"


def mask(spark, d):
    bin_ = lambda c: F.floor(F.col(c) / num(0.25) + num(1e-9)).cast("long")
    return orders_cloud(spark, d).select(F.col("scan").alias("grp"), bin_("x").alias("ix"), bin_("y").alias("iy")).distinct()


@query(f"WITH {MASK_SQL} SELECT grp, count(*) AS cells FROM mask GROUP BY grp")
def footprint_cells(spark, d):
    return mask(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {MASK_SQL} SELECT grp, count(*) AS cells, CAST(round(count(*) * 1e6 / ((max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1))) AS BIGINT) AS coverage_micro FROM mask GROUP BY grp")
def cell_coverage(spark, d):
    """Distinct cells over the cells of the bounding box."""
    box = (F.max("ix") - F.min("ix") + 1) * (F.max("iy") - F.min("iy") + 1)
    return mask(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("cells"), F.round(F.count(F.lit(1)) * num(1e6) / box).cast("long").alias("coverage_micro"))


@query(f"WITH {MASK_SQL}, {DILATED_SQL} SELECT grp, ix, iy FROM dl")
def dilate(spark, d):
    return R.dilated(mask(spark, d))


@query(f"WITH {MASK_SQL}, {OFFSETS_SQL} SELECT grp, ix + a AS ix, iy + b AS iy FROM (SELECT grp, ix // 2 AS ix, iy // 2 AS iy FROM mask GROUP BY ALL), o GROUP BY ALL HAVING count(*) = 9")
def erode(spark, d):
    coarse = mask(spark, d).select("grp", F.expr("ix div 2").alias("ix"), F.expr("iy div 2").alias("iy")).distinct()
    return R.eroded(coarse)


@query(f"WITH {MASK_SQL}, {DILATED_SQL} SELECT grp, ix + a AS ix, iy + b AS iy FROM dl, o GROUP BY ALL HAVING count(*) = 9")
def close_mask(spark, d):
    return R.closed(mask(spark, d))


COMPONENTS_SQL = """RECURSIVE reach(grp, ix, iy, k) AS (SELECT grp, ix, iy, (grp * 1048576 + ix) * 1048576 + iy FROM small UNION SELECT s.grp, s.ix, s.iy, r.k FROM reach r JOIN small s ON s.grp = r.grp AND abs(s.ix - r.ix) <= 1 AND abs(s.iy - r.iy) <= 1)"""
SMALL_SQL = f"{CLOUD_SQL}, small AS (SELECT DISTINCT scan AS grp, CAST(floor(x / 0.1e0 + 1e-9) AS BIGINT) AS ix, CAST(floor(y / 0.1e0 + 1e-9) AS BIGINT) AS iy FROM cloud)"


def small_mask(spark, d):
    bin_ = lambda c: F.floor(F.col(c) / num(0.1) + num(1e-9)).cast("long")
    return orders_cloud(spark, d).select(F.col("scan").alias("grp"), bin_("x").alias("ix"), bin_("y").alias("iy")).distinct()


def layered_mask(spark, d):
    bin_ = lambda c: F.floor(F.col(c) / num(0.25) + num(1e-9)).cast("long")
    return orders_cloud(spark, d).select((F.col("scan") * 8 + F.floor(F.col("z") / num(0.4))).cast("long").alias("grp"), bin_("x").alias("ix"), bin_("y").alias("iy")).distinct()


@query(f"WITH RECURSIVE {SMALL_SQL}, {COMPONENTS_SQL.removeprefix('RECURSIVE ')} SELECT grp, ix, iy, min(k) AS component FROM reach GROUP BY ALL")
def mask_components(spark, d):
    return R.labelled(small_mask(spark, d))


@query(f"WITH RECURSIVE {SMALL_SQL}, {COMPONENTS_SQL.removeprefix('RECURSIVE ')}, l AS (SELECT grp, ix, iy, min(k) AS component FROM reach GROUP BY ALL) SELECT grp, component, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1, count(*) AS area FROM l GROUP BY ALL")
def component_boxes(spark, d):
    return R.boxes(R.labelled(small_mask(spark, d)))


@query(f"WITH {MASK_SQL}, g AS (SELECT *, ix - row_number() OVER (PARTITION BY grp, iy ORDER BY ix) AS island FROM mask) SELECT grp, iy, min(ix) AS x0, max(ix) AS x1 FROM g GROUP BY grp, iy, island")
def mask_rectangles(spark, d):
    """Disjoint row runs that make up the mask."""
    return R.row_runs(mask(spark, d))


STRIPS_SQL = "strips AS (SELECT p_partkey AS id, p_partkey % 17 AS grp, (p_partkey * 3) % 36 AS x0, (p_partkey * 3) % 36 + p_size % 5 AS x1, (p_partkey * 5) % 28 AS y0, (p_partkey * 5) % 28 + p_size % 3 AS y1 FROM part)"


def strips(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return read(spark, d, "part").select(k.alias("id"), (k % 17).alias("grp"), ((k * 3) % 36).alias("x0"), ((k * 3) % 36 + s % 5).alias("x1"), ((k * 5) % 28).alias("y0"), ((k * 5) % 28 + s % 3).alias("y1"))


@query(f"WITH {MASK_SQL}, {STRIPS_SQL} SELECT id, count(mask.ix) AS n, any_value((x1 - x0 + 1) * (y1 - y0 + 1)) AS area, count(mask.ix)::DOUBLE / any_value((x1 - x0 + 1) * (y1 - y0 + 1)) AS support FROM strips LEFT JOIN mask ON strips.grp = mask.grp AND ix BETWEEN x0 AND x1 AND iy BETWEEN y0 AND y1 GROUP BY id")
def strip_support(spark, d):
    """Share of each frame strip's cells that are set."""
    return R.strip_support(strips(spark, d), mask(spark, d))


@query()
def void_candidates(spark, d):
    """Bounded empty components of the rasters of each scan, a raster for every 0.4 m of height."""
    m = layered_mask(spark, d)
    steps = F.sequence(F.lit(-2), F.lit(2))
    filled = m.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps)).select("grp", (F.col("ix") + F.col("a")).alias("ix"), (F.col("iy") + F.col("b")).alias("iy")).distinct()
    frames = m.select("grp").distinct().select("grp", F.lit(0).cast("long").alias("x0"), F.lit(39).cast("long").alias("x1"), F.lit(0).cast("long").alias("y0"), F.lit(31).cast("long").alias("y1"))
    b = R.boxes(R.labelled(R.complement(filled, frames)))
    size = lambda a, z: (F.col(z) - F.col(a) + 1).between(2, 12)
    return b.where(size("x0", "x1") & size("y0", "y1") & (F.col("x0") > 0) & (F.col("x1") < 39) & (F.col("y1") < 31))


CLASS_SQL = "v AS (SELECT p_partkey AS id, (p_size % 40) * 0.1e0 AS w, ((p_partkey * 7) % 32) * 0.1e0 AS h, ((p_partkey * 11) % 25) * 0.05e0 AS sill, 2.6e0 + (p_partkey % 5) * 0.2e0 AS top, 0.75e0 + (p_partkey % 6) * 0.05e0 AS vac, ((p_partkey * 3) % 10) * 0.05e0 AS sup FROM part)"


@query(f"""WITH {CLASS_SQL} SELECT id, CASE WHEN sill <= 0.075e0 AND sup < 0.15e0 AND top - sill - h >= 0.35e0 AND w BETWEEN 0.65e0 AND 3.2e0 AND h >= 1.65e0 THEN 'door' WHEN (sill <= 0.2e0 AND top - sill - h <= 0.25e0) OR sill BETWEEN 0.05e0 AND 1.8e0 THEN 'window' ELSE 'unknown' END AS kind
FROM v WHERE w BETWEEN 0.5e0 AND 3.2e0 AND h BETWEEN 0.55e0 AND 2.8e0 AND vac >= 0.8e0""")
def opening_classes(spark, d):
    """Door, window or unknown by size, sill, clearance and support."""
    k, n = F.col("p_partkey"), num
    w, h, sill = (F.col("p_size").cast("long") % 40) * n(0.1), ((k * 7) % 32) * n(0.1), ((k * 11) % 25) * n(0.05)
    kind = R.opening_kind(w, h, sill, n(2.6) + (k % 5) * n(0.2), n(0.75) + (k % 6) * n(0.05), ((k * 3) % 10) * n(0.05), 0.05)
    return read(spark, d, "part").select(k.alias("id"), kind.alias("kind")).where("kind IS NOT NULL")


@query(f"""WITH {MASK_SQL}, c AS (SELECT grp, ix, count(*) / 33e0 AS support FROM mask GROUP BY ALL), e AS (SELECT grp, ix, coalesce(support, 0e0) AS support FROM (SELECT g.grp, unnest(generate_series(0, 40)) AS ix FROM (SELECT DISTINCT grp FROM mask) g) LEFT JOIN c USING (grp, ix)),
w AS (SELECT *, ix - row_number() OVER (PARTITION BY grp ORDER BY ix) AS island FROM e WHERE support < 0.25e0) SELECT grp, min(ix) AS start, max(ix) AS "end", count(*) AS cells FROM w GROUP BY grp, island HAVING count(*) >= 2""")
def mullion_parts(spark, d):
    """Parts of a wide void between supported columns."""
    m = mask(spark, d)
    c = m.groupBy("grp", "ix").agg((F.count(F.lit(1)) / num(33)).alias("support"))
    every = m.select("grp").distinct().withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))))
    return R.split_columns(every.join(c, ["grp", "ix"], "left").select("grp", "ix", F.coalesce("support", num(0)).alias("support")), 0.25, 2)


# --- clusters and graphs -----------------------------------------------------------------------------

DB_SQL = f"""{CLOUD_SQL}, p AS (SELECT rid, x, y FROM cloud), n AS (SELECT a.rid AS a, b.rid AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02e0 * 0.02e0 AND abs(a.x - b.x) <= 0.02e0),
core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 3), ce AS (SELECT n.a, n.b FROM n WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach(a, k) AS (SELECT a, a FROM core UNION SELECT ce.b, r.k FROM reach r JOIN ce ON ce.a = r.a), cc AS (SELECT a, min(k) AS cluster FROM reach GROUP BY a),
bd AS (SELECT n.a, min(cc.cluster) AS cluster FROM n JOIN cc ON n.b = cc.a WHERE n.a NOT IN (SELECT a FROM core) GROUP BY n.a), al AS (SELECT a AS rid, cluster, true AS core FROM cc UNION ALL SELECT a, cluster, false FROM bd)"""


@query(f"WITH RECURSIVE {DB_SQL} SELECT rid, cluster, core FROM al WHERE cluster IN (SELECT cluster FROM al GROUP BY cluster HAVING count(*) >= 3)")
def dbscan(spark, d):
    return K.dbscan(orders_cloud(spark, d), 0.02, 3)


@query("""WITH RECURSIVE l AS (SELECT DISTINCT c_custkey AS stair, (c_custkey * 7 + c_nationkey) % 400 AS landing FROM customer), e AS (SELECT DISTINCT a.stair AS a, b.stair AS b FROM l a JOIN l b USING (landing)),
reach(a, k) AS (SELECT a, a FROM e UNION SELECT e.b, r.k FROM reach r JOIN e ON e.a = r.a), s AS (SELECT a AS stair, min(k) AS system FROM reach GROUP BY a), h AS (SELECT system, count(DISTINCT landing) AS hubs FROM s JOIN l USING (stair) GROUP BY system)
SELECT stair, system, hubs FROM s JOIN h USING (system)""")
def stair_systems(spark, d):
    """Flights joined through shared landings."""
    c = F.col("c_custkey")
    links = read(spark, d, "customer").select(c.alias("stair"), ((c * 7 + F.col("c_nationkey")) % 400).alias("landing")).distinct()
    return K.systems(links, "stair", "landing")


DUP_SQL = "b AS (SELECT c_custkey AS id, c_nationkey AS cls, c_acctbal / 10e0 AS lo, c_acctbal / 10e0 + 40e0 AS hi FROM customer), pr AS (SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.cls = b.cls AND a.id < b.id AND (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) >= 0.9e0)"


@query(f"WITH RECURSIVE {DUP_SQL}, e AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), reach(a, k) AS (SELECT a, a FROM e UNION SELECT e.b, r.k FROM reach r JOIN e ON e.a = r.a), s AS (SELECT a, min(k) AS component FROM reach GROUP BY a) SELECT component, count(*) AS members, count(*) - 1 AS excess FROM s GROUP BY component")
def duplicate_groups(spark, d):
    """Elements of one class whose intervals overlap to 90 %: excess members of each group."""
    c = F.col("c_acctbal") / num(10)
    b = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cls"), c.alias("lo"), (c + num(40)).alias("hi"))
    # Intervals that overlap so far start within 4.3 of each other: equal or neighbouring cells.
    a = b.select(*[F.col(n).alias(f"a_{n}") for n in b.columns]).withColumn("cell", F.explode(F.sequence(G.cell(F.col("a_lo"), 5.0) - 1, G.cell(F.col("a_lo"), 5.0) + 1)))
    j = a.join(b.withColumn("cell", G.cell(F.col("lo"), 5.0)), (F.col("a_cls") == F.col("cls")) & (a["cell"] == G.cell(F.col("lo"), 5.0)) & (F.col("a_id") < F.col("id")))
    iou = (F.least("a_hi", "hi") - F.greatest("a_lo", "lo")) / (F.greatest("a_hi", "hi") - F.least("a_lo", "lo"))
    return K.duplicate_excess(j.where(iou >= num(0.9)).select(F.col("a_id").alias("a"), F.col("id").alias("b")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 3 + s_nationkey) % 100 AS b FROM supplier), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT DISTINCT a AS n FROM r WHERE a = b)
SELECT a, b FROM e WHERE EXISTS (SELECT 1 FROM c WHERE c.n = e.a OR EXISTS (SELECT 1 FROM r WHERE r.a = c.n AND r.b = e.a)) AND EXISTS (SELECT 1 FROM c WHERE c.n = e.b OR EXISTS (SELECT 1 FROM r WHERE r.a = e.b AND r.b = c.n))""")
def graph_cycles(spark, d):
    """Relations that peeling cannot remove: on a cycle or between cycles."""
    s = F.col("s_suppkey")
    return H.on_cycles(read(spark, d, "supplier").select(s.alias("a"), ((s * 3 + F.col("s_nationkey")) % 100).alias("b")))
