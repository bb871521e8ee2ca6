"""Queries over relations of elements: hosting, coverage, metrics, convergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.operators import structure as T
from pointloom.operators.cloud import num
from pointloom.operators.evidence import micro
from pointloom.plans.registry import query
from pointloom.plans.spatial import NEAR_SQL, each_face
from pointloom.sources.tables import CLOUD_SQL, orders_cloud, read

c = F.col

BOX_SQL = "bx AS (SELECT p_partkey AS id, p_size % 4 AS class, ((p_partkey * 37) % 400) / 10e0 AS x0, ((p_partkey * 37) % 400) / 10e0 + 1.5e0 AS x1, ((p_partkey * 53) % 300) / 10e0 AS y0, ((p_partkey * 53) % 300) / 10e0 + 1.2e0 AS y1, (p_size % 6) * 0.5e0 AS z0, (p_size % 6) * 0.5e0 + 1e0 AS z1 FROM part)"


def boxes(spark, d):
    k, s = c("p_partkey"), c("p_size").cast("long")
    x, y, z = ((k * 37) % 400) / num(10), ((k * 53) % 300) / num(10), (s % 6) * num(0.5)
    return read(spark, d, "part").select(k.alias("id"), (c("p_size") % 4).alias("class"), x.alias("x0"), (x + num(1.5)).alias("x1"), y.alias("y0"), (y + num(1.2)).alias("y1"), z.alias("z0"), (z + num(1)).alias("z1"))


@query(f"WITH {BOX_SQL} SELECT id FROM bx a WHERE id % 50 <> 0 AND NOT EXISTS (SELECT 1 FROM bx r WHERE r.id % 50 = 0 AND r.class = a.class AND a.z0 < r.z1 AND a.z1 > r.z0 AND a.x0 < r.x1 AND a.x1 > r.x0 AND a.y0 < r.y1 AND a.y1 > r.y0)")
def excluded_elements(spark, d):
    """Elements outside all excluded regions of their class."""
    b = boxes(spark, d)
    return T.without_excluded(b.where("id % 50 <> 0"), b.where("id % 50 = 0")).select("id")


@query(f"WITH {BOX_SQL}, st AS (SELECT unnest([0, 1, 2])::INTEGER AS class, unnest(['present', 'uncertain', 'present']) AS state) SELECT id FROM bx WHERE class IN (SELECT class FROM st WHERE state NOT IN ('uncertain', 'out_of_scope'))")
def scoped_elements(spark, d):
    return T.in_scope(boxes(spark, d), spark.createDataFrame([(0, "present"), (1, "uncertain"), (2, "present")], "class int, state string")).select("id")


@query("""SELECT p_partkey AS id, coalesce(p_size % 9 >= 4 AND p_partkey % 15 >= 6 AND p_partkey % 5 <= 0.4e0 * (p_size % 13) AND CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'proposed' ELSE 'confirmed' END = 'confirmed', false) AS confirmed FROM part""")
def confirmed_stairs(spark, d):
    k, s = c("p_partkey"), c("p_size")
    state = F.when(k % 4 == 1, "proposed").when(k % 4 != 0, "confirmed")
    rows = read(spark, d, "part").select(k.alias("id"), (s % 9).alias("observed"), (k % 15).alias("least_support"), (k % 5).alias("inferred"), (s % 13).alias("steps"), state.alias("state"))
    return T.confirmed_stairs(rows).select("id", "confirmed")


@query("""WITH k AS (SELECT o_custkey % 17 AS scan, o_orderkey + 300 AS rid FROM orders WHERE o_orderkey % 7 = 0), p AS (SELECT o_custkey % 17 AS scan, o_orderkey AS rid, o_orderkey % 3 <> 0 AS selected, o_orderkey % 5 - 1 AS label FROM orders), j AS (SELECT k.*, p.rid IS NOT NULL AS there, selected, label FROM k LEFT JOIN p ON p.scan = k.scan AND p.rid = k.rid)
SELECT count(*) AS requested, count(*) FILTER (NOT there) AS missing, count(*) FILTER (there AND NOT selected) AS outside, count(*) FILTER (there AND selected AND label < 0) AS unsupported, count(*) FILTER (there AND selected AND label >= 0) AS usable FROM j""")
def semantic_sample_keys(spark, d):
    """Requested records: missing, outside the crop, unsupported, usable."""
    o = read(spark, d, "orders")
    k = o.where("o_orderkey % 7 = 0").select((c("o_custkey") % 17).alias("scan"), (c("o_orderkey") + 300).alias("rid"))
    p = o.select((c("o_custkey") % 17).alias("scan"), c("o_orderkey").alias("rid"), (c("o_orderkey") % 3 != 0).alias("selected"), (c("o_orderkey") % 5 - 1).alias("label"))
    return T.sample_keys(k, p)


SUPPORT_SQL = """e AS (SELECT c_custkey AS id, c_nationkey AS grp, (c_custkey % 40) * 0.05e0 AS z, (c_custkey % 12) * 0.5e0 AS x0, (c_custkey % 12) * 0.5e0 + 1e0 AS x1, (c_custkey % 9) * 0.5e0 AS y0, (c_custkey % 9) * 0.5e0 + 0.5e0 AS y1 FROM customer),
p AS (SELECT s_suppkey AS id, s_nationkey AS grp, (s_suppkey % 40) * 0.05e0 AS z, (s_suppkey % 7) * 0.5e0 AS x0, (s_suppkey % 7) * 0.5e0 + 4e0 AS x1, 0e0 AS y0, 3.25e0 AS y1, s_suppkey % 3 = 0 AS observed FROM supplier),
f AS (SELECT e.id, p.id AS plate, abs(e.z - p.z) AS d, observed FROM e JOIN p ON e.grp = p.grp AND abs(e.z - p.z) <= 0.4e0 AND greatest(0e0, least(e.x1, p.x1) - greatest(e.x0, p.x0)) * greatest(0e0, least(e.y1, p.y1) - greatest(e.y0, p.y0)) / ((e.x1 - e.x0) * (e.y1 - e.y0)) >= 0.2e0),
b AS (SELECT id, plate FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT observed, d, plate) AS k FROM f) WHERE k = 1)"""


def supports(spark, d):
    k, s = c("c_custkey"), c("s_suppkey")
    e = read(spark, d, "customer").select(k.alias("id"), c("c_nationkey").alias("grp"), ((k % 40) * num(0.05)).alias("z"), ((k % 12) * num(0.5)).alias("x0"), ((k % 12) * num(0.5) + num(1)).alias("x1"), ((k % 9) * num(0.5)).alias("y0"), ((k % 9) * num(0.5) + num(0.5)).alias("y1"))
    p = read(spark, d, "supplier").select(s.alias("id"), c("s_nationkey").alias("grp"), ((s % 40) * num(0.05)).alias("z"), ((s % 7) * num(0.5)).alias("x0"), ((s % 7) * num(0.5) + num(4)).alias("x1"), num(0).alias("y0"), num(3.25).alias("y1"), (s % 3 == 0).alias("observed"))
    return T.nearest_support(e, p, 0.4, 0.2)


@query(f"WITH {SUPPORT_SQL} SELECT e.id, plate FROM e LEFT JOIN b USING (id)")
def stair_supports(spark, d):
    """Slab or landing under each stair end: height, share of area, observed first, nearest."""
    return supports(spark, d)


@query(f"WITH {SUPPORT_SQL}, s AS (SELECT e.id // 2 AS stair, count(plate) AS ends, count(*) AS n FROM e LEFT JOIN b USING (id) GROUP BY 1) SELECT stair, CASE WHEN ends = n THEN 'connected' WHEN ends > 0 THEN 'partial' ELSE 'unresolved' END AS status FROM s")
def stair_status(spark, d):
    """Connected, partial or unresolved, by both ends."""
    s = supports(spark, d).groupBy(F.expr("id div 2").alias("stair")).agg(F.count("plate").alias("ends"), F.count(F.lit(1)).alias("n"))
    return s.select("stair", F.when(c("ends") == c("n"), "connected").when(c("ends") > 0, "partial").otherwise("unresolved").alias("status"))


@query("""WITH i AS (SELECT c_custkey AS id, c_custkey % 120 AS host, CASE c_custkey % 3 WHEN 0 THEN 'wall' ELSE 'slab' END AS needs FROM customer), h AS (SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN 'wall' ELSE 'slab' END AS type FROM supplier)
SELECT i.id, CASE WHEN h.id IS NULL THEN 'unknown_host' ELSE 'wrong_type' END AS rule FROM i LEFT JOIN h ON h.id = i.host WHERE h.id IS NULL OR type <> needs""")
def host_violations(spark, d):
    k, s = c("c_custkey"), c("s_suppkey")
    i = read(spark, d, "customer").select(k.alias("id"), (k % 120).alias("host"), F.when(k % 3 == 0, "wall").otherwise("slab").alias("needs"))
    return T.host_violations(i, read(spark, d, "supplier").select(s.alias("id"), F.when(s % 2 == 0, "wall").otherwise("slab").alias("type")))


@query("""WITH k AS (SELECT p_size % 6 AS slab, CASE WHEN p_partkey % 3 = 0 THEN 'measured' WHEN p_partkey % 5 < 2 THEN 'justified' ELSE 'unsupported' END AS kind, count(*) AS cells FROM part GROUP BY ALL)
SELECT slab, kind, cells, cells * 0.0064e0 AS area, cells * 100e0 / sum(cells) OVER (PARTITION BY slab) AS percent FROM k""")
def slab_coverage(spark, d):
    """Measured, justified and unsupported area of each slab."""
    k = c("p_partkey")
    return T.coverage_classes(read(spark, d, "part").select((c("p_size") % 6).alias("slab"), F.when(k % 3 == 0, 1).otherwise(0).alias("n"), (k % 5 < 2).alias("bridged")), 0.0064)


@query("""WITH t AS (SELECT s_suppkey AS id, 2e0 AS a, 9e0 AS b FROM supplier), f AS (SELECT c_custkey % 101 AS id, (c_custkey % 23) * 0.5e0 AS lo, (c_custkey % 23) * 0.5e0 + (c_custkey % 7) * 0.25e0 AS hi FROM customer),
i AS (SELECT id, greatest(a, lo) AS lo, least(b, hi) AS hi FROM t JOIN f USING (id) WHERE least(b, hi) > greatest(a, lo)), m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m), u AS (SELECT id, run, CAST(round((max(hi) - min(lo)) * 1e6) AS BIGINT) AS len FROM r GROUP BY id, run)
SELECT t.id, CAST(coalesce(sum(len), 0) AS BIGINT) AS covered_micro, 7000000::BIGINT AS length_micro FROM t LEFT JOIN u USING (id) GROUP BY t.id""")
def face_coverage(spark, d):
    """Covered length of truth faces, overlaps counted once."""
    k = c("c_custkey")
    truth = read(spark, d, "supplier").select(c("s_suppkey").alias("id"), num(2).alias("a"), num(9).alias("b"))
    found = read(spark, d, "customer").select((k % 101).alias("id"), ((k % 23) * num(0.5)).alias("lo"), ((k % 23) * num(0.5) + (k % 7) * num(0.25)).alias("hi"))
    return T.interval_coverage(truth, found)


@query("""WITH w AS (SELECT s_suppkey AS id, (s_suppkey % 10) * 1e0 AS x0, 0e0 AS y0, (s_suppkey % 10) * 1e0 + 3e0 AS x1, 4e0 AS y1, (s_suppkey % 10) * 1e0 + 3.1e0 AS p0, 4.05e0 AS q0, (s_suppkey % 10) * 1e0 + 0.02e0 AS p1, -0.03e0 AS q1 FROM supplier)
SELECT id, CAST(round(least(greatest(sqrt((p0 - x0) * (p0 - x0) + (q0 - y0) * (q0 - y0)), sqrt((p1 - x1) * (p1 - x1) + (q1 - y1) * (q1 - y1))), greatest(sqrt((p1 - x0) * (p1 - x0) + (q1 - y0) * (q1 - y0)), sqrt((p0 - x1) * (p0 - x1) + (q0 - y1) * (q0 - y1)))) * 1e6) AS BIGINT) AS end_micro,
 CAST(round(greatest(abs((q0 - y0) * 0.6e0 - (p0 - x0) * 0.8e0), abs((q1 - y0) * 0.6e0 - (p1 - x0) * 0.8e0)) * 1e6) AS BIGINT) AS offset_micro, CAST(round(abs((0.2e0 + id % 3 * 0.01e0) - 0.2e0) * 1e6) AS BIGINT) AS thickness_micro FROM w""")
def wall_errors(spark, d):
    """Errors of matched walls, whichever way they run."""
    k = c("s_suppkey")
    x = (k % 10) * num(1)
    pairs = read(spark, d, "supplier").select(k.alias("id"), x.alias("t_x0"), num(0).alias("t_y0"), (x + num(3)).alias("t_x1"), num(4).alias("t_y1"), (x + num(3.1)).alias("p_x0"), num(4.05).alias("p_y0"), (x + num(0.02)).alias("p_x1"), num(-0.03).alias("p_y1"), num(0.2).alias("t_thickness"), (num(0.2) + k % 3 * num(0.01)).alias("p_thickness"))
    return T.wall_errors(pairs).select("id", micro(c("end_error")).alias("end_micro"), micro(c("offset_error")).alias("offset_micro"), micro(c("thickness_error")).alias("thickness_micro"))


@query("""WITH g AS (SELECT s_nationkey AS "case", s_suppkey AS run, (s_suppkey * 7) % 20 / 1000e0 AS change FROM supplier), t AS (SELECT *, change <= 0.01e0 AND coalesce(lag(change <= 0.01e0) OVER (PARTITION BY "case" ORDER BY run), false) AS two FROM g) SELECT "case", min(CASE WHEN two THEN run END) AS run FROM t GROUP BY "case" """)
def convergence(spark, d):
    """First run after two stable comparisons."""
    k = c("s_suppkey")
    return T.converged(read(spark, d, "supplier").select(c("s_nationkey").alias("case"), k.alias("run"), ((k * 7) % 20 / num(1000)).alias("change")), 0.01)


@query("""WITH f AS (SELECT p_partkey AS id, p_size % 8 AS grp, ((p_partkey * 7) % 100) * 0.1e0 AS z, (p_partkey % 5) * 1e0 AS x0, (p_partkey % 5) * 1e0 + 4e0 AS x1, 0e0 AS y0, 3e0 AS y1 FROM part)
SELECT a.id AS lower, b.id AS upper FROM f a JOIN f b ON a.grp = b.grp AND b.z - a.z BETWEEN 0.08e0 AND 0.6e0 AND greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.45e0""")
def slab_zone_pairs(spark, d):
    """Lower and upper faces that may bound one slab."""
    k = c("p_partkey")
    f = read(spark, d, "part").select(k.alias("id"), (c("p_size") % 8).alias("grp"), (((k * 7) % 100) * num(0.1)).alias("z"), ((k % 5) * num(1)).alias("x0"), ((k % 5) * num(1) + num(4)).alias("x1"), num(0).alias("y0"), num(3).alias("y1"))
    return T.zone_pairs(f, 0.08, 0.6, 0.45)


@query(f"""WITH {NEAR_SQL}, k AS (SELECT face, CAST(floor(along / 0.2e0) AS BIGINT) AS col, CAST(round(min(z) * 1e3) AS BIGINT) AS lo, CAST(round(max(z) * 1e3) AS BIGINT) AS hi FROM near GROUP BY ALL),
g AS (SELECT *, lead(col) OVER w AS nx, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2 FROM k WINDOW w AS (PARTITION BY face ORDER BY col)),
s AS (SELECT *, count(*) OVER f AS n, max(col) OVER f - min(col) OVER f + 1 AS span, max(nx - col - 1) OVER f AS widest FROM g WINDOW f AS (PARTITION BY face)),
e AS (SELECT *, unnest(generate_series(0, coalesce(nx - col - 1, 0))) AS j FROM s WHERE n >= 0.6e0 * span AND coalesce(widest, 0) <= 2)
SELECT face, col + j AS col, CASE WHEN j = 0 THEN lo ELSE CAST(round(lo + j * (lo2 - lo) / (nx - col)::DOUBLE) AS BIGINT) END AS lo, CASE WHEN j = 0 THEN hi ELSE CAST(round(hi + j * (hi2 - hi) / (nx - col)::DOUBLE) AS BIGINT) END AS hi, j = 0 AS measured FROM e""")
def wall_profiles(spark, d):
    """Lower and upper envelope of each wall that is supported well enough, short gaps filled."""
    return each_face(spark, d, lambda near: T.profile_envelope(near, 0.2, 2, 0.6))


@query(f"""WITH {CLOUD_SQL}, q AS (SELECT scan, z, CAST(round(x * 1e3) AS BIGINT) AS x, CAST(round(y * 1e3) AS BIGINT) AS y FROM cloud), s AS (SELECT scan, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS sxx, sum(x * y)::BIGINT AS sxy, sum(y * y)::BIGINT AS syy, max(z) - min(z) AS h FROM q GROUP BY scan),
v AS (SELECT scan, n, h, sxx / n::DOUBLE - (sx / n::DOUBLE) * (sx / n::DOUBLE) AS a, sxy / n::DOUBLE - (sx / n::DOUBLE) * (sy / n::DOUBLE) AS b, syy / n::DOUBLE - (sy / n::DOUBLE) * (sy / n::DOUBLE) AS c FROM s)
SELECT scan, n, CASE WHEN h >= 0.4e0 THEN CAST(round(sqrt(greatest((a + c) / 2e0 + sqrt((a - c) * (a - c) / 4e0 + b * b), 0e0))) AS BIGINT) END AS long_mm, CASE WHEN h >= 0.4e0 THEN CAST(round(sqrt(greatest((a + c) / 2e0 - sqrt((a - c) * (a - c) / 4e0 + b * b), 0e0))) AS BIGINT) END AS short_mm FROM v""")
def column_envelopes(spark, d):
    """Principal spread of each component in the plan."""
    return T.column_envelopes(orders_cloud(spark, d), "scan", 0.4)


@query("""WITH w AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 0.1e0 END AS l, CASE WHEN s_suppkey % 2 = 0 THEN -0.12e0 END AS r, 0.25e0 AS t FROM supplier), v AS (SELECT id, unnest([1, -1]) AS side, unnest([l, r]) AS own, unnest([r, l]) AS opp, t FROM w)
SELECT id, side, coalesce(own, opp + side * t, side * t / 2) AS plane, CASE WHEN own IS NOT NULL THEN 'measured' WHEN opp IS NOT NULL THEN 'opposite' ELSE 'inferred' END AS basis FROM v""")
def wall_views(spark, d):
    """Two views of each wall and where their planes come from."""
    k = c("s_suppkey")
    return T.wall_views(read(spark, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, num(0.1)).alias("left_offset"), F.when(k % 2 == 0, num(-0.12)).alias("right_offset"), num(0.25).alias("thickness")))


@query(f"""WITH {CLOUD_SQL}, p AS (SELECT rid % 200 AS grp, rid, x, y FROM cloud), j AS (SELECT grp, a.rid AS a, b.rid AS b, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM p a JOIN p b USING (grp) WHERE a.rid < b.rid) SELECT grp, a, b FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY d DESC, a, b) AS k FROM j) WHERE k = 1""")
def farthest_pairs(spark, d):
    return T.farthest_pairs(orders_cloud(spark, d).select((c("rid") % 200).alias("grp"), "rid", "x", "y"), "grp")


@query("""WITH f AS (SELECT c_custkey AS id, 4e0 AS length, (c_custkey % 30) * 0.2e0 - 1e0 AS lo, (c_custkey % 17) * 0.3e0 AS hi FROM customer) SELECT id, CAST(round(greatest(0e0, lo) * 1e6) AS BIGINT) AS from_micro, CAST(round(least(length, hi) * 1e6) AS BIGINT) AS to_micro FROM f WHERE least(length, hi) - greatest(0e0, lo) > 1e-9""")
def clipped_faces(spark, d):
    """Faces cut to an interval along themselves."""
    k = c("c_custkey")
    f = read(spark, d, "customer").select(k.alias("id"), num(4).alias("length"), ((k % 30) * num(0.2) - num(1)).alias("lo"), ((k % 17) * num(0.3)).alias("hi"))
    return T.clipped_faces(f).select("id", micro(c("from_")).alias("from_micro"), micro(c("to_")).alias("to_micro"))


@query("""WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 9) * 1e0 AS ax, 0e0 AS ay, (s_suppkey % 9) * 1e0 + 2e0 AS bx, (s_suppkey % 5) * 0.5e0 AS by_, 0e0 AS cx, (s_suppkey % 4) * 1e0 AS cy, 3e0 AS dx, (s_suppkey % 4) * 1e0 + 0.75e0 AS dy FROM supplier), t AS (SELECT *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS det FROM s)
SELECT id, CAST(round((ax + ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det * (bx - ax)) * 1e6) AS BIGINT) AS x_micro, CAST(round((ay + ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det * (by_ - ay)) * 1e6) AS BIGINT) AS y_micro FROM t WHERE abs(det) > 1e-12""")
def line_crossings(spark, d):
    """Where axes meet; parallel ones do not."""
    k = c("s_suppkey")
    a = (k % 9) * num(1)
    at = X.crossing(a, num(0), a + num(2), (k % 5) * num(0.5), num(0), (k % 4) * num(1), num(3), (k % 4) * num(1) + num(0.75))
    return read(spark, d, "supplier").select(k.alias("id"), micro(at[0]).alias("x_micro"), micro(at[1]).alias("y_micro")).where("x_micro IS NOT NULL")


@query("SELECT o_orderkey AS id, (o_orderpriority IS DISTINCT FROM CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END) OR NOT (o_custkey % 5 IS NOT DISTINCT FROM o_orderkey % 5) AS stale FROM orders")
def stale_models(spark, d):
    """A model is stale when crop or options differ from those it was made with, nulls included."""
    k = c("o_orderkey")
    same = c("o_orderpriority").eqNullSafe(F.when(k % 9 != 0, c("o_orderstatus"))) & (c("o_custkey") % 5).eqNullSafe(k % 5)
    return read(spark, d, "orders").select(k.alias("id"), (~same).alias("stale"))
