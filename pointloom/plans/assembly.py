"""Queries over whole steps: openings of walls, topology, faces by openings, facades, slabs, voids, and a model from a cloud."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import assembly as A
from pointloom.operators import raster as M
from pointloom.operators.cloud import num
from pointloom.plans.recognition import rooms
from pointloom.plans.registry import query
from pointloom.plans.relations import WALL_SQL, walls
from pointloom.plans.spatial import COMPONENTS_SQL, SMALL_SQL, small_mask
from pointloom.sources.tables import CLOUD_SQL, orders_cloud, read

c = F.col


def planted_walls(spark, d):
    """A wall of 5.0 x 2.7 m for each supplier in cells of 0.1 m, on two planes: the first has a door and a window, the second the
    window alone. Every 97th cell of it has no return."""
    k = c("s_suppkey")
    wall = read(spark, d, "supplier").select(k.alias("wall"), (3 + k % 5).alias("door"), (20 + k % 7).alias("window"), (7 + k % 4).alias("sill"))
    wall = wall.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "wall")  # a few rows become many cells
    cells = wall.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")))).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(26).cast("long")))).withColumn("plane", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    door = c("ix").between(c("door"), c("door") + 8) & (c("iy") <= 20) & (c("plane") == 0)
    window = c("ix").between(c("window"), c("window") + 11) & c("iy").between(c("sill"), c("sill") + 9)
    return cells.where(~door & ~window & ((c("wall") + c("ix") * 31 + c("iy") * 17) % 97 != 0)).select("wall", "plane", "ix", "iy")


@query("""SELECT s_suppkey AS wall, unnest(['door', 'window']) AS kind, unnest([3 + s_suppkey % 5, 20 + s_suppkey % 7]) AS x0, unnest([11 + s_suppkey % 5, 31 + s_suppkey % 7]) AS x1, unnest([0, 7 + s_suppkey % 4]) AS y0, unnest([20, 16 + s_suppkey % 4]) AS y1 FROM supplier""")
def detected_openings(spark, d):
    """The doors and windows planted in the walls, each once, whatever planes show them."""
    sizes = read(spark, d, "supplier").select(c("s_suppkey").alias("wall"), num(5).alias("length"), num(2.7).alias("height"))
    return A.detected_openings(planted_walls(spark, d), sizes, 0.1).select("wall", "kind", "x0", "x1", "y0", "y1")


TOPOLOGY_SQL = f"""{WALL_SQL}, n AS (SELECT storey, id AS wall, 0 AS e, id * 2 AS n, x0 AS x, y0 AS y FROM w UNION ALL SELECT storey, id, 1, id * 2 + 1, x1, y1 FROM w),
ed AS (SELECT a.n AS a, b.n AS b FROM n a JOIN n b ON a.storey = b.storey AND a.n <> b.n AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 0.15e0),
r(n, k) AS (SELECT a, a FROM ed UNION SELECT ed.b, r.k FROM r JOIN ed ON ed.a = r.n), g AS (SELECT n, min(k) AS corner FROM r GROUP BY n),
cm AS (SELECT corner, CAST(round(sum(CAST(round(x * 1e3) AS BIGINT))::DOUBLE / count(*)) AS BIGINT) AS cx, CAST(round(sum(CAST(round(y * 1e3) AS BIGINT))::DOUBLE / count(*)) AS BIGINT) AS cy FROM g JOIN n USING (n) GROUP BY corner),
u AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS l FROM w), v AS (SELECT *, (x1 - x0) / l AS ux, (y1 - y0) / l AS uy FROM u),
t AS (SELECT n.n, v.id AS host, v.l, (n.x - v.x0) * v.ux + (n.y - v.y0) * v.uy AS along, abs((n.y - v.y0) * v.ux - (n.x - v.x0) * v.uy) AS off, v.x0, v.y0, v.ux, v.uy FROM n JOIN v ON v.storey = n.storey AND v.id <> n.wall),
f AS (SELECT n, x0 + along * ux AS x, y0 + along * uy AS y FROM t WHERE off <= 0.15e0 AND along > 0.15e0 AND along < l - 0.15e0 QUALIFY row_number() OVER (PARTITION BY n ORDER BY CAST(round(off * 1e6) AS BIGINT), host) = 1),
m AS (SELECT n.storey, n.wall, n.e, CAST(round(n.x * 1e3) AS BIGINT) AS x, CAST(round(n.y * 1e3) AS BIGINT) AS y, coalesce(cx, CAST(round(f.x * 1e3) AS BIGINT), CAST(round(n.x * 1e3) AS BIGINT)) AS nx, coalesce(cy, CAST(round(f.y * 1e3) AS BIGINT), CAST(round(n.y * 1e3) AS BIGINT)) AS ny,
  CASE WHEN cx IS NOT NULL THEN 'corner' WHEN f.x IS NOT NULL THEN 'junction' ELSE 'free' END AS kind FROM n LEFT JOIN g USING (n) LEFT JOIN cm USING (corner) LEFT JOIN f USING (n)),
z AS (SELECT a.storey, a.wall, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, a.nx AS nx0, a.ny AS ny0, b.nx AS nx1, b.ny AS ny1, a.kind AS k0, b.kind AS k1, (b.nx - a.nx) * (b.nx - a.nx) + (b.ny - a.ny) * (b.ny - a.ny) < 360000 AS lost FROM m a JOIN m b ON a.wall = b.wall AND a.e = 0 AND b.e = 1)"""


@query(f"""WITH RECURSIVE {TOPOLOGY_SQL} SELECT storey, wall AS id, CASE WHEN lost THEN x0 ELSE nx0 END AS x0_mm, CASE WHEN lost THEN y0 ELSE ny0 END AS y0_mm, CASE WHEN lost THEN x1 ELSE nx1 END AS x1_mm, CASE WHEN lost THEN y1 ELSE ny1 END AS y1_mm,
CASE WHEN lost THEN 'free' ELSE k0 END AS "start", CASE WHEN lost THEN 'free' ELSE k1 END AS "end", lost AS restored FROM z""")
def snapped_topology(spark, d):
    """Walls whose ends meet in corners and T-junctions."""
    return A.snapped_topology(walls(spark, d), 0.15, 0.6)


FACES_SQL = """fc AS (SELECT p_partkey AS id, p_partkey // 10 AS storey, (p_partkey % 10) * 0.2e0 AS "offset", (p_partkey % 3) * 0.4e0 AS a0, 6e0 + (p_partkey % 4) * 0.3e0 AS a1 FROM part),
op AS (SELECT id AS face, CASE WHEN (id // 2 + j) % 3 = 0 THEN 'door' ELSE 'window' END AS kind, 1e0 + j * 1.7e0 + ((id // 2) % 5) * 0.3e0 + (id % 2) * 0.05e0 AS centre FROM fc, (SELECT unnest([0, 1, 2]) AS j))"""


def faces(spark, d):
    k = c("p_partkey")
    return read(spark, d, "part").select(k.alias("id"), F.floor(k / 10).cast("long").alias("storey"), ((k % 10) * num(0.2)).alias("offset"), ((k % 3) * num(0.4)).alias("a0"), (num(6) + (k % 4) * num(0.3)).alias("a1"))


@query(f"""WITH {FACES_SQL}, p AS (SELECT op.*, fc.storey, fc."offset", fc.a0, fc.a1 FROM op JOIN fc ON fc.id = op.face),
j AS (SELECT l.face AS a, r.face AS b, l.centre, abs(l."offset" - r."offset") AS gap, greatest(l.a0, r.a0) AS lo, least(l.a1, r.a1) AS hi FROM p l JOIN p r ON l.storey = r.storey AND l.kind = r.kind AND l.face < r.face AND abs(l.centre - r.centre) <= 0.1e0 AND abs(l."offset" - r."offset") BETWEEN 0.1e0 AND 0.5e0),
q AS (SELECT a, b, count(DISTINCT centre) AS matches, min(CAST(round(gap * 1e3) AS BIGINT)) AS thickness_mm, min(lo) AS lo, max(hi) AS hi FROM j WHERE hi > lo GROUP BY a, b),
s AS (SELECT a AS me, b AS you, matches, thickness_mm FROM q UNION ALL SELECT b, a, matches, thickness_mm FROM q), k AS (SELECT me, you FROM s QUALIFY row_number() OVER (PARTITION BY me ORDER BY matches DESC, thickness_mm, you) = 1)
SELECT q.* FROM q JOIN k x ON x.me = a AND x.you = b JOIN k y ON y.me = b AND y.you = a""")
def faces_by_openings(spark, d):
    """Pairs of faces that show the same openings, as walls."""
    f = faces(spark, d)
    j = F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 1, 2)]))
    half = F.floor(c("id") / 2).cast("long")
    o = f.select("id", j.alias("j")).select(c("id").alias("face"), F.when((half + c("j")) % 3 == 0, "door").otherwise("window").alias("kind"), (num(1) + c("j") * num(1.7) + (half % 5) * num(0.3) + (c("id") % 2) * num(0.05)).alias("centre"))
    return A.faces_by_openings(f, o, (0.1, 0.5), 0.1)


@query("""WITH f AS (SELECT o_custkey AS host, o_orderkey AS id, (o_orderkey % 24) * 0.5e0 AS lo, (o_orderkey % 24) * 0.5e0 + 0.36e0 + (o_orderkey % 5) * 0.02e0 AS hi, CAST(round((o_custkey % 2) * 0.4e0 * 20) AS BIGINT) AS "row", CAST(round(1.2e0 * 20) AS BIGINT) AS "rows" FROM orders WHERE 0.6e0 + (o_orderkey % 9) * 0.05e0 >= 0.75e0),
m AS (SELECT *, CASE WHEN lo - max(hi) OVER (PARTITION BY host, "row", "rows" ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.16e0 THEN 0 ELSE 1 END AS nw FROM f),
r AS (SELECT *, sum(nw) OVER (PARTITION BY host, "row", "rows" ORDER BY lo, id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT host, min(id) OVER w AS grp, id FROM r WINDOW w AS (PARTITION BY host, "row", "rows", run) QUALIFY count(*) OVER w >= 4""")
def facade_groups(spark, d):
    """Aligned rows of frames that make a curtain wall."""
    k = c("o_orderkey")
    lo = (k % 24) * num(0.5)
    f = read(spark, d, "orders").select(c("o_custkey").alias("host"), k.alias("id"), lo.alias("lo"), (lo + num(0.36) + (k % 5) * num(0.02)).alias("hi"), ((c("o_custkey") % 2) * num(0.4)).alias("sill"), num(1.2).alias("height"), (num(0.6) + (k % 9) * num(0.05)).alias("rail"))
    return A.facade_groups(f)


@query(f"""WITH {CLOUD_SQL}, f AS (SELECT scan, x, y, z + 0.01e0 * x AS z FROM cloud WHERE 0.96e0 + (rid % 5) * 0.01e0 >= 0.97e0 AND (rid % 7) * 0.005e0 <= 0.025e0), b AS (SELECT *, CAST(floor(z / 0.1e0 + 1e-9) AS BIGINT) AS bin FROM f),
h AS (SELECT scan, bin FROM b GROUP BY ALL HAVING count(*) >= 8), r AS (SELECT scan, bin, bin - row_number() OVER (PARTITION BY scan ORDER BY bin) AS island FROM h), q AS (SELECT scan, island, min(bin) AS from_bin, max(bin) AS to_bin FROM r GROUP BY ALL),
p AS (SELECT q.scan, q.from_bin, q.to_bin, CAST(round(x * 1e3) AS BIGINT) AS x, CAST(round(y * 1e3) AS BIGINT) AS y, CAST(round(z * 1e3) AS BIGINT) AS z, CAST(floor(x / 0.25e0 + 1e-9) AS BIGINT) AS ix, CAST(floor(y / 0.25e0 + 1e-9) AS BIGINT) AS iy FROM b JOIN q ON q.scan = b.scan AND bin BETWEEN from_bin AND to_bin),
s AS (SELECT scan, from_bin, to_bin, count(*) AS points, count(DISTINCT (ix, iy)) AS cells, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y, sum(z)::DOUBLE AS z, sum(x * x)::DOUBLE AS xx, sum(x * y)::DOUBLE AS xy, sum(y * y)::DOUBLE AS yy, sum(x * z)::DOUBLE AS xz, sum(y * z)::DOUBLE AS yz FROM p GROUP BY ALL),
t AS (SELECT *, xx - x * x / n AS sxx, xy - x * y / n AS sxy, yy - y * y / n AS syy, xz - x * z / n AS sxz, yz - y * z / n AS syz FROM s), w AS (SELECT *, sxx * syy - sxy * sxy AS det FROM t)
SELECT scan, from_bin, to_bin, points, cells, CAST(round(z / n) AS BIGINT) AS mean_mm, CASE WHEN abs(det) > 1e-6 * sxx * syy THEN CAST(round((sxz * syy - syz * sxy) / det * 1e6) AS BIGINT) END AS slope_x, CASE WHEN abs(det) > 1e-6 * sxx * syy THEN CAST(round((syz * sxx - sxz * sxy) / det * 1e6) AS BIGINT) END AS slope_y FROM w""")
def horizontal_surfaces(spark, d):
    """Flat surfaces of each scan with their planes; the cloud leans by a hundredth along x."""
    p = orders_cloud(spark, d).select("scan", "x", "y", (c("z") + num(0.01) * c("x")).alias("z"), (num(0.96) + (c("rid") % 5) * num(0.01)).alias("nz"), ((c("rid") % 7) * num(0.005)).alias("curvature"))
    return A.horizontal_surfaces(p, "scan", 0.1, 8, 0.25)


@query(f"""WITH {COMPONENTS_SQL.replace('RECURSIVE', 'RECURSIVE ' + SMALL_SQL + ',')}, l AS (SELECT grp, ix, iy, min(k) AS component FROM reach GROUP BY ALL),
s AS (SELECT grp, component, unnest([0, 0, 1, 1]) AS d, unnest([ix, ix, ix, ix + 1]) AS x, unnest([iy, iy + 1, iy, iy]) AS y FROM l), e AS (SELECT grp, component, count(*) AS n FROM s GROUP BY grp, component, d, x, y), e2 AS (SELECT grp, component, count(*) AS sides, count(*) FILTER (n = 1) AS border FROM e GROUP BY ALL),
v AS (SELECT DISTINCT grp, component, unnest([ix, ix, ix + 1, ix + 1]) AS x, unnest([iy, iy + 1, iy, iy + 1]) AS y FROM l), v2 AS (SELECT grp, component, count(*) AS corners FROM v GROUP BY ALL), a AS (SELECT grp, component, count(*) AS area FROM l GROUP BY ALL)
SELECT grp, component, area, border, 1 - corners + sides - area AS holes FROM a JOIN e2 USING (grp, component) JOIN v2 USING (grp, component)""")
def occupancy_outlines(spark, d):
    """Occupied areas of each scan as polygons of cells, with their holes."""
    return A.outlines(M.labelled(small_mask(spark, d)))


@query("""SELECT s_suppkey AS grp, (s_suppkey * 1048576 + unnest([3, 10])) * 1048576 + unnest([4, 2 + s_suppkey % 3]) AS component, unnest([12, 20]) AS area, unnest([12, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 5 END]) AS seen, unnest(['open', CASE WHEN s_suppkey % 2 = 0 THEN 'unseen' ELSE 'partly' END]) AS kind FROM supplier""")
def slab_holes(spark, d):
    """The holes planted in the slab of each supplier, by what shows below them."""
    k, zero = c("s_suppkey"), F.lit(0).cast("long")
    own = read(spark, d, "supplier").select(k.alias("grp"), (2 + k % 3).alias("at"))
    cells = own.withColumn("ix", F.explode(F.sequence(zero, F.lit(19).cast("long")))).withColumn("iy", F.explode(F.sequence(zero, F.lit(11).cast("long"))))
    first = c("ix").between(3, 5) & c("iy").between(4, 7)
    second = c("ix").between(10, 13) & c("iy").between(c("at"), c("at") + 4)
    frames = own.select("grp", zero.alias("x0"), F.lit(19).cast("long").alias("x1"), zero.alias("y0"), F.lit(11).cast("long").alias("y1"))
    return A.hole_evidence(cells.where(~first & ~second).select("grp", "ix", "iy"), cells.where(first | (second & (c("ix") == 10) & (c("grp") % 2 == 1))).select("grp", "ix", "iy"), frames, 6)


VOID_SQL = """k AS (SELECT s_suppkey AS host, unnest(generate_series(0, 13)) AS n FROM supplier), tr AS (SELECT host, CAST(round((2e0 + n * 0.3e0) * 10) AS BIGINT) AS x0, CAST(round((2e0 + n * 0.3e0) * 10) AS BIGINT) + 3 AS x1, 10 + host % 4 AS y0, 20 + host % 4 AS y1, (n + 1) * 0.2e0 AS top FROM k)"""


@query(f"""WITH {VOID_SQL}, need AS (SELECT DISTINCT host, x, y FROM (SELECT host, unnest(generate_series(x0, x1 - 1)) AS x, y0, y1 FROM tr WHERE 2.6e0 - top < 2e0 AND top <= 2.8e0 + 1e-9), (SELECT unnest(generate_series(0, 40)) AS y) WHERE y >= y0 AND y < y1),
hit AS (SELECT DISTINCT host, x, y FROM (SELECT host, unnest(generate_series(x0, x1 - 1)) AS x, y0, y1 FROM tr WHERE 2.6e0 - top < 2e0 AND top <= 2.8e0 + 1e-9 AND top > 2.6e0), (SELECT unnest(generate_series(0, 40)) AS y) WHERE y >= y0 AND y < y1),
slab AS (SELECT s_suppkey AS host, x, y FROM supplier, (SELECT unnest(generate_series(0, 59)) AS x), (SELECT unnest(generate_series(0, 39)) AS y)), cut AS (SELECT host, x, y FROM slab WHERE x BETWEEN 25 AND 49 AND y BETWEEN 10 AND 19)
SELECT s.host, count(*) AS slab, count(n.x) AS needed, count(u.x) AS cut, count(n.x) FILTER (u.x IS NULL) AS missing, count(h.x) FILTER (u.x IS NULL) AS physical, count(u.x) FILTER (n.x IS NULL) AS spare
FROM slab s LEFT JOIN need n USING (host, x, y) LEFT JOIN hit h USING (host, x, y) LEFT JOIN cut u USING (host, x, y) GROUP BY s.host""")
def stair_voids(spark, d):
    """What the stairs of each supplier's storey need cut out of the slab above, against its cut."""
    host = read(spark, d, "supplier").select(c("s_suppkey").alias("host"))
    n = host.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(13).cast("long"))))
    tread = n.select("host", (num(2) + c("n") * num(0.3)).alias("x0"), (num(2) + c("n") * num(0.3) + num(0.3)).alias("x1"), (num(1) + (c("host") % 4) * num(0.1)).alias("y0"), (num(2) + (c("host") % 4) * num(0.1)).alias("y1"), ((c("n") + 1) * num(0.2)).alias("top"))
    box = lambda *v: [num(a).alias(k) for k, a in zip(("x0", "x1", "y0", "y1"), v)]
    return A.stair_voids(tread, host.select("host", *box(0, 6, 0, 4), num(2.6).alias("underside"), num(2.8).alias("top")), host.select("host", *box(2.5, 5, 1, 2)), 0.1)


@query("""WITH f AS (SELECT l_suppkey AS storey, ((CAST(round((l_partkey % 12) * 15e0 / 5) AS BIGINT)) % 36 + 36) % 36 AS turn, (l_orderkey % 80) * 0.05e0 AS "offset", CAST(round(CAST(l_quantity AS DOUBLE) * 1e3) AS BIGINT) AS lo, CAST(round((CAST(l_quantity AS DOUBLE) + 0.5e0 + l_linenumber * 0.25e0) * 1e3) AS BIGINT) + 300 AS hi FROM lineitem),
n AS (SELECT *, CASE WHEN "offset" - lag("offset") OVER (PARTITION BY storey, turn ORDER BY "offset") > 0.12e0 THEN 1 ELSE 0 END AS nw FROM f), g AS (SELECT *, sum(nw) OVER (PARTITION BY storey, turn ORDER BY "offset" RANGE UNBOUNDED PRECEDING) AS line FROM n),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY storey, turn, line ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nr FROM g), r AS (SELECT *, sum(nr) OVER (PARTITION BY storey, turn, line ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT storey, turn, line::BIGINT AS line, min(lo) AS lo_mm, max(hi) - 300 AS hi_mm, count(*) AS faces FROM r GROUP BY storey, turn, line, run""")
def coalesced_faces(spark, d):
    """Collinear faces merged over short gaps."""
    q = c("l_quantity").cast("double")
    f = read(spark, d, "lineitem").select(c("l_suppkey").alias("storey"), ((c("l_partkey") % 12) * num(15)).alias("angle"), ((c("l_orderkey") % 80) * num(0.05)).alias("offset"), q.alias("lo"), (q + num(0.5) + c("l_linenumber") * num(0.25)).alias("hi"))
    return A.coalesced_faces(f, 5.0, 0.12, 0.3)


@query(f"""WITH {CLOUD_SQL}, s AS (SELECT unnest([0, 1, 2]) AS storey, unnest([0e0, 1.1e0, 2e0]) AS b, unnest([1.1e0, 2.1e0, 3e0]) AS t) SELECT rid, scan, storey FROM cloud JOIN s ON z >= b AND z < t""")
def storey_points(spark, d):
    """Points of each storey's interval; the last two overlap."""
    s = spark.sql("SELECT * FROM VALUES (0, 0D, 1.1D), (1, 1.1D, 2.1D), (2, 2D, 3D) AS s(storey, bottom, top)")
    return A.storey_points(orders_cloud(spark, d), s).select("rid", "scan", "storey")


@query("""SELECT o_orderkey AS id, greatest(30, least(o_custkey * 1000, CAST(floor(o_totalprice * 0.5e0 / 48) AS BIGINT))) AS "limit" FROM orders""")
def point_limits(spark, d):
    """Points that a share of the memory allows."""
    return read(spark, d, "orders").select(c("o_orderkey").alias("id"), A.point_limit(c("o_custkey") * 1000, c("o_totalprice").cast("double"), 0.5, 48).alias("limit"))


@query("""WITH e AS (SELECT p_partkey AS id, ['wall', 'door', 'window', 'slab', 'column'][1 + p_partkey % 5] AS kind, (p_size % 10) * 0.5e0 AS b, 0.5e0 + (p_partkey % 6) * 0.25e0 AS h, (p_partkey % 4) * 0.25e0 AS s, 0.125e0 + (p_size % 3) * 0.0625e0 AS t FROM part)
SELECT id, CASE WHEN kind IN ('door', 'window') THEN 'opening' ELSE kind END AS family, CASE WHEN kind IN ('door', 'window') THEN b + s WHEN kind = 'slab' THEN b - t ELSE b END AS lo, CASE WHEN kind IN ('door', 'window') THEN b + s + h WHEN kind = 'slab' THEN b ELSE b + h END AS hi FROM e""")
def vertical_intervals(spark, d):
    """Family and vertical interval of elements."""
    k, s = c("p_partkey"), c("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("wall", "door", "window", "slab", "column"))), (1 + k % 5).cast("int"))
    each = read(spark, d, "part").select(k.alias("id"), kind.alias("kind"), A.vertical_interval(kind, (s % 10) * num(0.5), num(0.5) + (k % 6) * num(0.25), (k % 4) * num(0.25), num(0.125) + (s % 3) * num(0.0625)).alias("v"))
    return each.select("id", A.family(c("kind")).alias("family"), "v.lo", "v.hi")


@query("""WITH e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'slab' ELSE 'space' END AS kind FROM supplier WHERE s_suppkey % 7 <> 0), p AS (SELECT s_suppkey AS id, j, j * 5000 AS x0, j * 5000 + 4000 AS x1, 0 AS y0, 3000 + s_suppkey % 100 AS y1 FROM supplier, (SELECT unnest([0, 1, 2]) AS j) WHERE j <= s_suppkey % 3),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x0) AS part, count(*) OVER (PARTITION BY id) AS o FROM p)
SELECT CASE WHEN o > 1 THEN n.id::VARCHAR || '#' || part::VARCHAR ELSE n.id::VARCHAR END AS id, kind, CAST((x1 - x0) * (y1 - y0) - CASE WHEN n.id % 2 = 0 AND j = 0 THEN 1000 * 500 ELSE 0 END AS BIGINT) AS area_mm2 FROM n JOIN e ON e.id = n.id""")
def model_snapshot(spark, d):
    """A model as annotation rows: live elements, part by part, less their cuts."""
    k = c("s_suppkey")
    s = read(spark, d, "supplier")
    e = s.select(k.alias("id"), F.when(k % 3 == 0, "slab").otherwise("space").alias("kind"), F.when(k % 7 == 0, "rejected").when(k % 2 == 0, "accepted").alias("review_state"))
    p = s.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), k % 3))).select(k.alias("id"), (c("j") * 5000).alias("x0"), (c("j") * 5000 + 4000).alias("x1"), F.lit(0).cast("long").alias("y0"), (3000 + k % 100).alias("y1"))
    n = lambda v: F.lit(v).cast("long")
    cuts = s.where(k % 2 == 0).select(k.alias("id"), n(3000).alias("x0"), n(4500).alias("x1"), n(-200).alias("y0"), n(500).alias("y1"))
    return A.snapshot(e, p, cuts)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 4 END AS corners FROM part""")
def clean_profiles(spark, d):
    """Corners of rings after the repair: a repeated point and one on a side go; a ring that would lose its area is refused."""
    k = c("p_partkey")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h = (k % 7 + 2), F.when(k % 4 == 0, num(0)).otherwise(k % 5 + 1)
    zero = F.lit(0)
    ring = F.array(pt(zero, zero), pt(w / 2, zero), pt(w, zero), pt(w, zero), pt(w, h), pt(zero, h))
    return read(spark, d, "part").select(k.alias("id"), F.size(A.clean_profile(ring, 1e-6)).alias("corners")).select("id", F.nullif(c("corners"), F.lit(-1)).alias("corners"))


@query(f"""WITH {CLOUD_SQL} SELECT rid, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM cloud""")
def preview_points(spark, d):
    """Single-precision coordinates for display."""
    return orders_cloud(spark, d).select("rid", *[c(v).cast("float").alias(v) for v in "xyz"])


def doored_rooms(spark, d):
    """The rooms with a door of 0.9 x 2.05 m through both faces of the partition, from y = 1 m."""
    hole = c("x").between(2.85, 3.15) & (c("y") >= num(1.0)) & (c("y") < num(1.875)) & (c("z") > num(0.01)) & (c("z") < num(2.05))
    return rooms(spark, d).where(~hole)


@query()
def reconstructed_model(spark, d):
    """From a cloud to a model: walls of each storey from its slices and outline, and the openings of each wall's rasters."""
    return A.reconstructed(doored_rooms(spark, d), "storey", 0.2, 2.8, 3.0)
