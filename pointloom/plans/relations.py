"""Queries over walls in pairs, corners, cascades, annotation and manifest rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import relations as R
from pointloom.operators.cloud import num
from pointloom.operators.evidence import micro
from pointloom.plans.registry import query
from pointloom.sources.tables import CLOUD_SQL, orders_cloud, read

c = F.col


@query(f"""WITH {CLOUD_SQL}, f AS (SELECT *, 0.5e0 AS x0, 1e0 AS y0, 3.5e0 AS x1, 1e0 + scan * 0.25e0 AS y1 FROM cloud), u AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS l FROM f)
SELECT rid FROM u WHERE abs((y - y0) * ((x1 - x0) / l) - (x - x0) * ((y1 - y0) / l)) <= 0.25e0 AND (x - x0) * ((x1 - x0) / l) + (y - y0) * ((y1 - y0) / l) BETWEEN -0.25e0 AND l + 0.25e0""")
def face_prefilter(spark, d):
    """Points near the face of their scan, or just beyond its ends."""
    return orders_cloud(spark, d).where(R.face_band(c("x"), c("y"), num(0.5), num(1), num(3.5), num(1) + c("scan") * num(0.25), 0.25)).select("rid")


@query("""SELECT o_orderkey AS id, CASE WHEN abs(n) <= 0.17e0 THEN 'vertical' WHEN abs(n) >= 0.97e0 THEN 'horizontal' WHEN n IS NOT NULL THEN 'oblique' END AS facing FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 201 - 100) / 100e0 END AS n FROM orders)""")
def surface_facing(spark, d):
    """Vertical, horizontal and oblique surfaces by their normals."""
    n = F.when(c("o_orderkey") % 11 != 0, (c("o_orderkey") % 201 - 100) / num(100))
    return read(spark, d, "orders").select(c("o_orderkey").alias("id"), R.facing(n, 0.17, 0.97).alias("facing"))


@query("""SELECT p_partkey AS id, o >= -1e-6 AND o + w <= 4e0 + 1e-6 AND s >= -1e-6 AND s + h <= 3e0 + 1e-6 AS inside FROM (SELECT p_partkey, (p_partkey % 50) * 0.1e0 - 0.3e0 AS o, (p_size % 20) * 0.1e0 AS w, (p_partkey % 7) * 0.25e0 AS s, (p_size % 13) * 0.25e0 AS h FROM part)""")
def openings_inside(spark, d):
    """Openings that lie within their host."""
    k, s = c("p_partkey"), c("p_size")
    inside = R.inside_host((k % 50) * num(0.1) - num(0.3), (s % 20) * num(0.1), (k % 7) * num(0.25), (s % 13) * num(0.25), num(4), num(3))
    return read(spark, d, "part").select(k.alias("id"), inside.alias("inside"))


@query(f"""WITH {CLOUD_SQL}, s AS (SELECT scan, floor(z / 0.4e0) AS slice, min(x) AS a, max(x) AS b FROM cloud GROUP BY ALL) SELECT scan, count(*) AS slices, CAST(round(median(a) * 1e6) AS BIGINT) AS start_micro, CAST(round(median(b) * 1e6) AS BIGINT) AS end_micro FROM s GROUP BY scan""")
def slice_ends(spark, d):
    """Median first and last place over the height slices of each scan."""
    return R.median_ends(orders_cloud(spark, d).withColumn("slice", F.floor(c("z") / num(0.4))), "scan", "slice", "x")


@query(f"""WITH {CLOUD_SQL} SELECT scan, CAST(round(quantile_cont(y, 0.75) * 1e6) AS BIGINT) AS limit_micro FROM cloud GROUP BY scan""")
def adaptive_deviation(spark, d):
    """Upper quartile of each scan's deviations."""
    return R.adaptive_limit(orders_cloud(spark, d), "scan", "y")


@query(f"""WITH {CLOUD_SQL}, h AS (SELECT scan, CAST(floor(y / 0.05e0 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY ALL),
m AS (SELECT *, n > CASE WHEN lag(bin) OVER w = bin - 1 THEN lag(n) OVER w ELSE 0 END AND n > CASE WHEN lead(bin) OVER w = bin + 1 THEN lead(n) OVER w ELSE 0 END AS peak FROM h WINDOW w AS (PARTITION BY scan ORDER BY bin)),
r AS (SELECT *, bool_or(peak) OVER (PARTITION BY scan) AS any_peak, row_number() OVER (PARTITION BY scan ORDER BY peak DESC, n DESC, bin) AS rank FROM m)
SELECT scan, bin, n, rank::INTEGER AS rank FROM r WHERE (peak AND rank <= 8) OR (NOT any_peak AND rank <= 4)""")
def strongest_peaks(spark, d):
    """The strongest local maxima of each scan's histogram, or its fullest bins."""
    h = orders_cloud(spark, d).groupBy("scan", F.floor(c("y") / num(0.05) + num(1e-9)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return R.strongest_bins(h, "scan", 8, 4)


WALL_SQL = """w AS (SELECT c_custkey AS id, c_nationkey AS storey, (c_custkey % 3) * 0.04e0 AS base, 2.5e0 + (c_custkey % 2) * 0.03e0 AS height, 0.1e0 + (c_custkey % 4) * 0.05e0 AS thickness,
((c_custkey * 7) % 40) * 0.5e0 AS x0, (c_custkey % 12) * 0.5e0 AS y0, ((c_custkey * 7) % 40) * 0.5e0 + CASE WHEN c_custkey % 5 = 0 THEN 0e0 ELSE 2e0 END AS x1, (c_custkey % 12) * 0.5e0 + CASE WHEN c_custkey % 5 = 0 THEN 2e0 ELSE (c_custkey % 3) * 0.02e0 END AS y1 FROM customer)"""
PAIR_SQL = """u AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS l FROM w), v AS (SELECT *, (x1 - x0) / l AS ux, (y1 - y0) / l AS uy FROM u),
j AS (SELECT a.id AS a, b.id AS b, a.l AS l, a.ux, a.uy, b.ux AS vx, b.uy AS vy, (b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2 AS dx, (b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2 AS dy, (b.x0 - a.x0) * a.ux + (b.y0 - a.y0) * a.uy AS p, (b.x1 - a.x0) * a.ux + (b.y1 - a.y0) * a.uy AS q
  FROM v a JOIN v b ON a.storey = b.storey AND a.id < b.id AND abs(a.base - b.base) <= 0.05e0 AND abs(a.base + a.height - b.base - b.height) <= 0.05e0 AND abs(a.thickness - b.thickness) <= 0.06e0),
pairs AS (SELECT a, b FROM j WHERE degrees(acos(least(1e0, abs(ux * vx + uy * vy)))) <= 2e0 AND abs(dy * ux - dx * uy) <= 0.08e0 AND greatest(0e0, least(p, q) - l, -greatest(p, q)) <= 0.35e0)"""


def walls(spark, d):
    k = c("c_custkey")
    x, y = ((k * 7) % 40) * num(0.5), (k % 12) * num(0.5)
    return read(spark, d, "customer").select(
        k.alias("id"), c("c_nationkey").alias("storey"), ((k % 3) * num(0.04)).alias("base"), (num(2.5) + (k % 2) * num(0.03)).alias("height"), (num(0.1) + (k % 4) * num(0.05)).alias("thickness"),
        x.alias("x0"), y.alias("y0"), (x + F.when(k % 5 == 0, num(0)).otherwise(num(2))).alias("x1"), (y + F.when(k % 5 == 0, num(2)).otherwise((k % 3) * num(0.02))).alias("y1"),
    )


LIMITS = (2.0, 0.08, 0.35, 0.06)


@query(f"WITH {WALL_SQL}, {PAIR_SQL} SELECT a, b FROM pairs")
def wall_pairs(spark, d):
    """Walls of one storey that may be parts of one."""
    return R.wall_pairs(walls(spark, d), *LIMITS)


@query(f"""WITH RECURSIVE {WALL_SQL}, {PAIR_SQL}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), r(n, k) AS (SELECT id, id FROM w UNION SELECT e.b, r.k FROM r JOIN e ON e.a = r.n), g AS (SELECT n, min(k) AS grp FROM r GROUP BY n),
m AS (SELECT g.grp, t.storey, CAST(round(((t.x0 - f.x0) * f.ux + (t.y0 - f.y0) * f.uy) * 1e3) AS BIGINT) AS p, CAST(round(((t.x1 - f.x0) * f.ux + (t.y1 - f.y0) * f.uy) * 1e3) AS BIGINT) AS q FROM g JOIN w t ON t.id = g.n JOIN v f ON f.id = g.grp)
SELECT grp AS id, min(storey) AS storey, count(*) AS members, min(least(p, q)) AS from_mm, max(greatest(p, q)) AS to_mm FROM m GROUP BY grp""")
def merged_walls(spark, d):
    """Connected fragments as one wall along its first."""
    return R.merged_walls(*R.whole_shapes(walls(spark, d), *LIMITS))


@query(f"""WITH RECURSIVE {WALL_SQL}, n AS (SELECT storey, id * 2 AS n, x0 AS x, y0 AS y FROM w UNION ALL SELECT storey, id * 2 + 1, x1, y1 FROM w), e AS (SELECT a.n AS a, b.n AS b FROM n a JOIN n b ON a.storey = b.storey AND a.n <> b.n AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 0.05e0),
r(n, k) AS (SELECT a, a FROM e UNION SELECT e.b, r.k FROM r JOIN e ON e.a = r.n), g AS (SELECT n, min(k) AS corner FROM r GROUP BY n), m AS (SELECT storey, corner, CAST(round(x * 1e3) AS BIGINT) AS x, CAST(round(y * 1e3) AS BIGINT) AS y FROM g JOIN n USING (n)),
t AS (SELECT storey, corner, count(*) AS ends, CAST(round(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x_mm, CAST(round(sum(y)::DOUBLE / count(*)) AS BIGINT) AS y_mm FROM m GROUP BY ALL)
SELECT t.*, (SELECT max(CAST(round(sqrt((m.x - x_mm) * (m.x - x_mm) + (m.y - y_mm) * (m.y - y_mm))) AS BIGINT)) FROM m WHERE m.corner = t.corner) AS moved_mm FROM t""")
def wall_corners(spark, d):
    """Ends that meet, as one corner each, and how far the farthest end moves."""
    w = walls(spark, d)
    ends = w.select("storey", c("id").alias("wall"), F.lit(0).alias("end"), c("x0").alias("x"), c("y0").alias("y")).unionByName(w.select("storey", c("id").alias("wall"), F.lit(1).alias("end"), c("x1").alias("x"), c("y1").alias("y")))
    return R.corner_clusters(ends, 0.05)


@query("""WITH p AS (SELECT o_orderkey AS id, (o_orderkey % 30) * 1e0 AS a0, (o_orderkey % 30) * 1e0 + 6e0 AS a1, (o_custkey % 30) * 1e0 AS b0, (o_custkey % 30) * 1e0 + 4e0 AS b1 FROM orders), t AS (SELECT id, unnest(['before', 'after']) AS side, unnest([a0, least(a1, b1)]) AS lo, unnest([greatest(a0, b0), a1]) AS hi FROM p WHERE least(a1, b1) > greatest(a0, b0)) SELECT * FROM t WHERE hi - lo >= 0.5e0""")
def face_tails(spark, d):
    """What faces have outside their overlap with a parallel one."""
    a, b = (c("o_orderkey") % 30) * num(1), (c("o_custkey") % 30) * num(1)
    return R.face_tails(read(spark, d, "orders").select(c("o_orderkey").alias("id"), a.alias("a0"), (a + num(6)).alias("a1"), b.alias("b0"), (b + num(4)).alias("b1")), 0.5)


HOST_SQL = "e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 4 + o_orderkey % 4 - 1 END AS host FROM orders)"


@query(f"""WITH RECURSIVE {HOST_SQL}, g(id) AS (SELECT id FROM e WHERE id % 9 = 0 UNION SELECT e.id FROM e JOIN g ON e.host = g.id) SELECT id FROM e WHERE id NOT IN (SELECT id FROM g)""")
def cascaded_deletes(spark, d):
    """Elements that are left after a cascade of deletes along hosts."""
    k = c("o_orderkey")
    e = read(spark, d, "orders").select(k.alias("id"), F.when(k % 4 != 0, k - 1).alias("host"))
    return R.without(e, "host", e.where("id % 9 = 0")).select("id")


@query("""WITH k AS (SELECT o_orderkey AS id, ['wall', 'opening', 'slab', 'space'][o_orderkey % 4 + 1] AS kind, unnest(['height', 'thickness', 'offset']) AS field, o_custkey % 100 AS value, 'measured' AS provenance FROM orders),
x AS (SELECT o_orderkey AS id, unnest(['height', 'height', 'thickness']) AS field, unnest([1, 2, 1]) AS seq, unnest([7, 8, o_orderkey % 3]) AS value FROM orders WHERE o_orderkey % 5 = 0),
l AS (SELECT id, field, value AS new FROM (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) AS r FROM x) WHERE r = 1),
j AS (SELECT k.*, new, new IS NOT NULL AND CASE kind WHEN 'wall' THEN field IN ('height', 'thickness') WHEN 'opening' THEN field IN ('offset', 'sill', 'width', 'height') WHEN 'slab' THEN field = 'thickness' ELSE false END AS done FROM k LEFT JOIN l USING (id, field))
SELECT id, kind, field, CASE WHEN done THEN new ELSE value END AS value, CASE WHEN done THEN 'user_supplied' ELSE provenance END AS provenance, bool_or(done) OVER (PARTITION BY id) AND NOT done AS stale FROM j""")
def edited_elements(spark, d):
    """Element fields after edits of the fields that are open to them."""
    o, k = read(spark, d, "orders"), c("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("wall", "opening", "slab", "space"))), (k % 4 + 1).cast("int"))
    rows = o.select(k.alias("id"), kind.alias("kind"), F.explode(F.array(*map(F.lit, ("height", "thickness", "offset")))).alias("field"), (c("o_custkey") % 100).alias("value"), F.lit("measured").alias("provenance"))
    entry = lambda f, s, v: F.struct(F.lit(f).alias("field"), F.lit(s).alias("seq"), v.cast("long").alias("value"))
    edits = o.where("o_orderkey % 5 = 0").select(k.alias("id"), F.inline(F.array(entry("height", 1, F.lit(7)), entry("height", 2, F.lit(8)), entry("thickness", 1, k % 3))))
    return R.edited(rows, edits)


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS grp, c_custkey % 23 AS n FROM customer WHERE c_custkey % 23 >= 1), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n) AS k FROM s), a AS (SELECT DISTINCT c_nationkey AS grp FROM customer)
SELECT grp, coalesce((SELECT count(*) FILTER (n = k) FROM k WHERE k.grp = a.grp), 0) + 1 AS free FROM a""")
def first_free_numbers(spark, d):
    """The first number that a group's elements leave free."""
    rows = read(spark, d, "customer").select(c("c_nationkey").alias("grp"), (c("c_custkey") % 23).alias("n"))
    return R.first_free(rows, "grp", "n")


@query("""WITH m AS (SELECT o_custkey AS grp, o_orderkey AS id FROM orders) SELECT grp, id FROM m WHERE grp NOT IN (SELECT grp FROM m WHERE id % 37 = 0)""")
def intact_window_groups(spark, d):
    """Groups without a failed member."""
    m = read(spark, d, "orders").select(c("o_custkey").alias("grp"), c("o_orderkey").alias("id"))
    return R.intact_groups(m, m.where("id % 37 = 0").select("id"))


@query("""WITH a AS (SELECT o_orderkey AS id, unnest([o_orderkey % 5000, o_custkey, o_orderkey % 13]) AS r FROM orders), b AS (SELECT s_suppkey AS wall, unnest([s_suppkey * 3, s_suppkey * 5 + 20]) AS r FROM supplier) SELECT DISTINCT id, wall FROM a JOIN b USING (r)""")
def column_sources(spark, d):
    """Column components and walls that rest on a common record."""
    k, s = c("o_orderkey"), c("s_suppkey")
    a = read(spark, d, "orders").select(k.alias("id"), F.array(k % 5000, c("o_custkey"), k % 13).alias("rows"))
    return R.shared_sources(a, read(spark, d, "supplier").select(s.alias("wall"), F.array(s * 3, s * 5 + 20).alias("rows")))


@query("""WITH v AS (SELECT o_orderkey AS id, o_custkey % 50 AS host, (o_orderkey % 90) * 0.1e0 AS x0, (o_orderkey % 90) * 0.1e0 + 1.5e0 AS x1, (o_custkey % 70) * 0.1e0 AS y0, (o_custkey % 70) * 0.1e0 + 1e0 AS y1 FROM orders), s AS (SELECT s_suppkey AS host, 1e0 AS x0, 8e0 AS x1, 1e0 AS y0, 6e0 AS y1 FROM supplier),
j AS (SELECT id, host, greatest(0e0, least(v.x1, s.x1) - greatest(v.x0, s.x0)) * greatest(0e0, least(v.y1, s.y1) - greatest(v.y0, s.y0)) AS area, v.x0 >= s.x0 AND v.x1 <= s.x1 AND v.y0 >= s.y0 AND v.y1 <= s.y1 AS inside FROM v JOIN s USING (host)) SELECT id, host, CAST(round(area * 1e6) AS BIGINT) AS area_micro, inside FROM j WHERE area > 0""")
def void_overlaps(spark, d):
    """What voids cut out of their host slabs."""
    k, h = c("o_orderkey"), c("o_custkey")
    x, y = (k % 90) * num(0.1), (h % 70) * num(0.1)
    v = read(spark, d, "orders").select(k.alias("id"), (h % 50).alias("host"), x.alias("x0"), (x + num(1.5)).alias("x1"), y.alias("y0"), (y + num(1)).alias("y1"))
    s = read(spark, d, "supplier").select(c("s_suppkey").alias("id"), num(1).alias("x0"), num(8).alias("x1"), num(1).alias("y0"), num(6).alias("y1"))
    return R.void_overlaps(v, s).select("id", "host", micro(c("area")).alias("area_micro"), "inside")


ELEMENT_SQL = """e AS (SELECT o_custkey AS "case", o_orderkey % 9 AS id, ['wall', 'door', 'slab', 'window'][o_orderkey % 4 + 1] AS class, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 7 END AS host, CASE WHEN o_orderkey % 31 = 0 THEN 'out_of_scope' ELSE 'present' END AS state, [o_orderkey % 6, o_orderkey % 9 + o_orderkey % 2] AS links FROM orders)"""


def elements(spark, d):
    k = c("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("wall", "door", "slab", "window"))), (k % 4 + 1).cast("int"))
    return read(spark, d, "orders").select(c("o_custkey").alias("case"), (k % 9).alias("id"), kind.alias("class"), F.when(k % 5 < 3, k % 7).alias("host"), F.when(k % 31 == 0, "out_of_scope").otherwise("present").alias("state"), F.array(k % 6, k % 9 + k % 2).alias("connections"))


@query(f"""WITH {ELEMENT_SQL}, o AS (SELECT DISTINCT "case", id, class FROM e), l AS (SELECT "case", id, unnest(links) AS t FROM e)
SELECT "case", id, 'duplicate id' AS rule FROM e GROUP BY "case", id HAVING count(*) > 1
UNION SELECT "case", id, 'no host' FROM e WHERE class IN ('door', 'window') AND host IS NULL UNION SELECT "case", id, 'needless host' FROM e WHERE class IN ('wall', 'slab') AND host IS NOT NULL
UNION SELECT "case", id, 'host is no wall' FROM e WHERE class IN ('door', 'window') AND host IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o."case" = e."case" AND o.id = e.host AND o.class = 'wall')
UNION SELECT "case", id, 'lost connection' FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o."case" = l."case" AND o.id = l.t) UNION SELECT "case", id, 'connected to itself' FROM l WHERE t = id UNION SELECT "case", id, 'out of scope' FROM e WHERE state = 'out_of_scope'""")
def annotation_violations(spark, d):
    """Breaches of the rules between annotated elements."""
    return R.annotation_violations(elements(spark, d))


GEOMETRY_SQL = """g AS (SELECT p_partkey AS id, ['wall', 'opening', 'stair', 'column', 'ramp'][p_partkey % 5 + 1] AS type, CASE WHEN p_size % 9 <> 0 THEN p_size * 0.1e0 - 0.2e0 END AS length, (p_partkey % 6) * 0.5e0 AS height, (p_size % 7) * 0.1e0 AS thickness, CASE WHEN p_partkey % 8 = 0 THEN 'NaN'::DOUBLE ELSE 1e0 END AS width, (p_size % 4) * 0.06e0 AS rise, 0.28e0 AS going, 8e0 AS steps, 2.24e0 + (p_partkey % 3) * 1e-5 AS run FROM part)"""


@query(f"""WITH {GEOMETRY_SQL}, u AS (SELECT id, type, unnest(['length', 'height', 'thickness', 'width', 'rise', 'going']) AS f, unnest([length, height, thickness, width, rise, going]) AS v FROM g)
SELECT id, f || ' is not positive' AS rule FROM u WHERE CASE type WHEN 'wall' THEN f IN ('length', 'height', 'thickness') WHEN 'opening' THEN f IN ('width', 'height') WHEN 'stair' THEN f IN ('width', 'rise', 'going') WHEN 'column' THEN f IN ('width', 'height') ELSE false END AND NOT coalesce(v > 0 AND NOT isnan(v), false)
UNION ALL SELECT id, 'run is not steps times going' FROM g WHERE type = 'stair' AND NOT abs(run - steps * going) <= 1e-6 UNION ALL SELECT id, 'unknown type' FROM g WHERE type = 'ramp'""")
def geometry_violations(spark, d):
    """Geometries without the numbers that their type needs."""
    k, s = c("p_partkey"), c("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("wall", "opening", "stair", "column", "ramp"))), (k % 5 + 1).cast("int"))
    g = read(spark, d, "part").select(
        k.alias("id"), kind.alias("type"), F.when(s % 9 != 0, s * num(0.1) - num(0.2)).alias("length"), ((k % 6) * num(0.5)).alias("height"), ((s % 7) * num(0.1)).alias("thickness"), F.when(k % 8 == 0, num(float("nan"))).otherwise(num(1)).alias("width"),
        ((s % 4) * num(0.06)).alias("rise"), num(0.28).alias("going"), num(8).alias("steps"), (num(2.24) + (k % 3) * num(1e-5)).alias("run"),
    )
    return R.geometry_violations(g)


MANIFEST_SQL = """k AS (SELECT c_custkey - c_custkey % 2 * (CASE WHEN c_custkey % 20 = 1 THEN 1 ELSE 0 END) AS "case", ['development', 'held_out', 'other'][CASE WHEN c_custkey % 17 = 0 THEN 3 ELSE c_custkey % 2 + 1 END] AS split, c_custkey % 400 AS truth, CASE WHEN c_custkey % 13 = 0 THEN 'none' ELSE repeat(md5(c_custkey::VARCHAR), 2) END AS digest FROM customer),
g AS (SELECT o_custkey AS "case", 'recall' AS metric, ['<=', '>=', '='][o_orderkey % 3 + 1] AS operator, CASE WHEN o_orderkey % 41 = 0 THEN 'Infinity'::DOUBLE ELSE o_orderkey / 10e0 END AS value FROM orders)"""


@query(f"""WITH {MANIFEST_SQL} SELECT "case", 'duplicate case' AS rule FROM k GROUP BY "case" HAVING count(*) > 1 UNION SELECT "case", 'unknown split' FROM k WHERE split NOT IN ('development', 'held_out') UNION SELECT "case", 'bad digest' FROM k WHERE NOT regexp_matches(digest, '^[0-9a-f]{{64}}$')
UNION SELECT "case", 'truth in two splits' FROM k WHERE truth IN (SELECT truth FROM k GROUP BY truth HAVING count(DISTINCT split) > 1) UNION SELECT "case", 'no gates' FROM k WHERE "case" NOT IN (SELECT "case" FROM g) UNION SELECT "case", 'unknown operator' FROM g WHERE operator = '='
UNION SELECT "case", 'bad value' FROM g WHERE isinf(value) UNION SELECT "case", 'duplicate gate' FROM g GROUP BY "case", metric, operator HAVING count(*) > 1 UNION SELECT "case", 'gate without case' FROM g WHERE "case" NOT IN (SELECT "case" FROM k)""")
def manifest_violations(spark, d):
    """Breaches of the benchmark manifest's rules."""
    k, o = c("c_custkey"), c("o_orderkey")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
    cases = read(spark, d, "customer").select((k - F.when(k % 20 == 1, k % 2).otherwise(0)).alias("case"), pick(("development", "held_out", "other"), F.when(k % 17 == 0, 3).otherwise(k % 2 + 1)).alias("split"), (k % 400).alias("truth"), F.when(k % 13 == 0, "none").otherwise(F.repeat(F.md5(k.cast("string")), 2)).alias("truth_digest"))
    gates = read(spark, d, "orders").select(c("o_custkey").alias("case"), F.lit("recall").alias("metric"), pick(("<=", ">=", "="), o % 3 + 1).alias("operator"), F.when(o % 41 == 0, num(float("inf"))).otherwise(o / num(10)).alias("value"))
    return R.manifest_violations(cases, gates)


@query("""WITH j AS (SELECT o_orderkey AS "case", list_filter([CASE WHEN o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END THEN 'source' END, CASE WHEN o_custkey % 10 IS DISTINCT FROM o_orderkey % 10 THEN 'crop' END], lambda x: x IS NOT NULL) AS f FROM orders) SELECT "case", array_to_string(f, ',') AS fields FROM j WHERE len(f) > 0""")
def identity_mismatches(spark, d):
    """Models whose source or crop is not their case's."""
    o, k = read(spark, d, "orders"), c("o_orderkey")
    return R.identity_mismatches(o.select(k.alias("case"), c("o_orderstatus").alias("source"), (c("o_custkey") % 10).alias("crop")), o.select(k.alias("case"), F.when(k % 7 != 0, c("o_orderstatus")).alias("source"), (k % 10).alias("crop")), ("source", "crop"))


@query("""WITH n AS (SELECT s AS wall, count(DISTINCT (scan, rec)) AS found FROM (SELECT l_suppkey AS s, l_linenumber AS scan, l_partkey AS rec FROM lineitem) GROUP BY s) SELECT s_suppkey AS id, 500 + s_suppkey % 90 AS evidence_count, coalesce(found, 0) AS found FROM supplier LEFT JOIN n ON wall = s_suppkey WHERE 500 + s_suppkey % 90 <> coalesce(found, 0)""")
def evidence_violations(spark, d):
    """Walls that state another number of records than they rest on."""
    s = c("s_suppkey")
    rows = read(spark, d, "lineitem").select(c("l_suppkey").alias("wall"), c("l_linenumber").alias("scan"), c("l_partkey").alias("record"))
    return R.evidence_violations(read(spark, d, "supplier").select(s.alias("id"), (F.lit(500) + s % 90).alias("evidence_count")), rows)


@query("""SELECT user_id AS tile, event_id AS row, event_id % 6 - 1 AS label, CAST(round(value * 1e3) AS BIGINT) AS score FROM events WHERE event_id % 3 <> 0 AND user_id % 4 <> 1""")
def vote_rows(spark, d):
    """Votes of points in a tile's core and in the crop."""
    e = read(spark, d, "events").select(c("user_id").alias("tile"), c("event_id").alias("row"), (c("event_id") % 6 - 1).alias("label"), F.round(c("value") * num(1e3)).cast("long").alias("score"), (c("event_id") % 3 != 0).alias("core"), (c("user_id") % 4 != 1).alias("selected"))
    return R.vote_rows(e)


@query(f"""WITH {CLOUD_SQL} SELECT scan, rid, coalesce(z BETWEEN 0.5e0 AND 2e0 AND x BETWEEN 1e0 AND 4e0, false) AS selected FROM cloud""")
def selected_sources(spark, d):
    """Every source record with the crop's selection."""
    return R.selected_sources(orders_cloud(spark, d), c("z").between(num(0.5), num(2)) & c("x").between(num(1), num(4)))


@query("""WITH s AS (SELECT event_type AS stage, value FROM events) SELECT stage, count(*) AS samples, CAST(round(max(value) * 1e3) AS BIGINT) AS peak, sum(CAST(round(value * 1e3) AS BIGINT))::BIGINT AS total, CAST(floor(sum(CAST(round(value * 1e3) AS BIGINT)) / count(*)) AS BIGINT) AS mean FROM s GROUP BY stage""")
def budget_rollup(spark, d):
    """Peak, sum and mean of each stage's samples."""
    return R.rolled_up(read(spark, d, "events").select(c("event_type").alias("stage"), "value"), "stage")


@query("""WITH a AS (SELECT o_orderkey AS id, [o_custkey % 5, o_orderkey % 3, o_custkey % 2, o_orderkey % 5] AS v FROM orders) SELECT id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS once FROM a""")
def warnings_once(spark, d):
    """Values in order of first appearance, each once."""
    k, h = c("o_orderkey"), c("o_custkey")
    return read(spark, d, "orders").select(k.alias("id"), F.array_join(R.in_order_once(F.array(h % 5, k % 3, h % 2, k % 5)).cast("array<string>"), ",").alias("once"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'user_supplied' ELSE 'measured' END AS height, CASE WHEN o_orderkey % 5 = 0 THEN 'inferred' END AS thickness FROM orders""")
def updated_provenance(spark, d):
    """Provenance maps with later entries put over earlier ones."""
    k = c("o_orderkey")
    changes = F.when(k % 3 == 0, F.create_map(F.lit("height"), F.lit("user_supplied"))).when(k % 7 != 0, F.create_map(F.lit("axis"), F.lit("measured")))
    base = F.when(k % 5 == 0, F.create_map(F.lit("height"), F.lit("measured"), F.lit("thickness"), F.lit("inferred"))).otherwise(F.create_map(F.lit("height"), F.lit("measured")))
    m = R.updated(base, changes)
    return read(spark, d, "orders").select(k.alias("id"), F.try_element_at(m, F.lit("height")).alias("height"), F.try_element_at(m, F.lit("thickness")).alias("thickness"))
