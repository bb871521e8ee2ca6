"""Queries of plan algebra on cells: areas, rooms, strips, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import raster as R
from pointloom.operators.cloud import num
from pointloom.plans.registry import query
from pointloom.plans.spatial import SMALL_SQL, small_mask
from pointloom.sources.tables import read

c = F.col

RECT_SQL = """ra AS (SELECT s_nationkey AS grp, (s_suppkey % 11) * 0.37e0 AS x0, (s_suppkey % 11) * 0.37e0 + 2.1e0 AS x1, (s_suppkey % 7) * 0.41e0 AS y0, (s_suppkey % 7) * 0.41e0 + 1.3e0 AS y1 FROM supplier),
rb AS (SELECT n_nationkey AS grp, 1.03e0 AS x0, 3.27e0 AS x1, 0.55e0 AS y0, 2.6e0 AS y1 FROM nation)"""


def cells_sql(name: str) -> str:
    ends = ", ".join(f"CAST(ceil({v} / 0.08e0 - 0.5e0) AS BIGINT) AS {a}" for v, a in (("x0", "i0"), ("x1", "i1"), ("y0", "j0"), ("y1", "j1")))
    return f"(SELECT DISTINCT grp, ix, iy FROM (SELECT grp, ix, j0, j1, unnest(generate_series(j0, j1 - 1)) AS iy FROM (SELECT grp, j0, j1, unnest(generate_series(i0, i1 - 1)) AS ix FROM (SELECT grp, {ends} FROM {name}))))"


@query(f"""WITH {RECT_SQL}, k AS (SELECT grp, ix, iy, max(a) AS a, max(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM {cells_sql('ra')} UNION ALL SELECT *, 0, 1 FROM {cells_sql('rb')}) GROUP BY ALL)
SELECT grp, count(*) AS "union", CAST(sum(a * b) AS BIGINT) AS intersection, CAST(sum(a * (1 - b)) AS BIGINT) AS a_only, CAST(sum((1 - a) * b) AS BIGINT) AS b_only, CAST(sum(abs(a - b)) AS BIGINT) AS symmetric FROM k GROUP BY grp""")
def plan_algebra(spark, d):
    """Union, intersection and differences of two plans per storey, in cells of 8 cm."""
    s = c("s_suppkey")
    x0, y0 = (s % 11) * num(0.37), (s % 7) * num(0.41)
    a = read(spark, d, "supplier").select(c("s_nationkey").alias("grp"), x0.alias("x0"), (x0 + num(2.1)).alias("x1"), y0.alias("y0"), (y0 + num(1.3)).alias("y1"))
    b = read(spark, d, "nation").select(c("n_nationkey").alias("grp"), num(1.03).alias("x0"), num(3.27).alias("x1"), num(0.55).alias("y0"), num(2.6).alias("y1"))
    return R.plan_algebra(R.rasterised(a, 0.08), R.rasterised(b, 0.08))


def wall_cells(spark, d):
    n = read(spark, d, "nation").select(c("n_nationkey").alias("grp"), (c("n_nationkey") % 5).alias("m"))
    span = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
    pick = lambda *v: F.explode(F.array(*[x if not isinstance(x, int) else F.lit(x).cast("long") for x in v]))
    h = n.select("grp", "m", span(2, 40).alias("ix")).select("grp", "ix", pick(3, 14 + c("m"), 27).alias("iy"))
    v = n.select("grp", "m", span(3, 27).alias("iy")).select("grp", pick(2, 20 + c("m"), 40).alias("ix"), "iy")
    return h.unionByName(v).distinct().where(~((c("grp") % 4 == 0) & (c("ix") == 2) & (c("iy") == 8)))


@query("""WITH k AS (SELECT n_nationkey AS grp, n_nationkey % 5 AS m FROM nation), z AS (SELECT grp, m, a, b FROM k, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
rm AS (SELECT grp, (CASE a WHEN 0 THEN 3 ELSE 21 + m END)::BIGINT AS x0, (CASE a WHEN 0 THEN 19 + m ELSE 39 END)::BIGINT AS x1, (CASE b WHEN 0 THEN 4 ELSE 15 + m END)::BIGINT AS y0, (CASE b WHEN 0 THEN 13 + m ELSE 26 END)::BIGINT AS y1, a, b FROM z)
SELECT grp, x0, x1, y0, y1, (x1 - x0 + 1) * (y1 - y0 + 1) AS area FROM rm WHERE NOT (grp % 4 = 0 AND a = 0 AND b = 0)""")
def spaces(spark, d):
    """Rooms between walls; a room with a gap in its outer wall is outside."""
    walls = wall_cells(spark, d)
    l = lambda v: F.lit(v).cast("long")
    frames = walls.select("grp").distinct().select("grp", l(0).alias("x0"), l(43).alias("x1"), l(0).alias("y0"), l(30).alias("y1"))
    return R.spaces(walls, frames, 20).select("grp", "x0", "x1", "y0", "y1", "area")


REACH_SQL = "reach(grp, ix, iy, k) AS (SELECT grp, ix, iy, (grp * 1048576 + ix) * 1048576 + iy FROM small UNION SELECT s.grp, s.ix, s.iy, r.k FROM reach r JOIN small s ON s.grp = r.grp AND abs(s.ix - r.ix) <= 1 AND abs(s.iy - r.iy) <= 1), l AS (SELECT grp, ix, iy, min(k) AS component FROM reach GROUP BY ALL)"


@query(f"WITH RECURSIVE {SMALL_SQL}, {REACH_SQL}, b AS (SELECT grp, component, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1, count(*) AS area FROM l GROUP BY ALL) SELECT grp, component, area FROM b WHERE (x1 - x0 + 1) * 0.25e0 BETWEEN 0.08e0 AND 1.2e0 AND (y1 - y0 + 1) * 0.25e0 >= 0.5e0 AND area >= 0.4e0 * (x1 - x0 + 1) * (y1 - y0 + 1)")
def protruding_strips(spark, d):
    """Narrow, tall, filled components of deep cells: column hypotheses."""
    return R.protruding(R.boxes(R.labelled(small_mask(spark, d))), 0.25, tall=0.5).select("grp", "component", "area")


@query(f"WITH RECURSIVE {SMALL_SQL}, {REACH_SQL} SELECT grp, component, count(*) AS cells, count(*) FILTER ((ix + iy) % 3 = 0) AS in_void FROM l GROUP BY grp, component HAVING count(*) >= 3 AND count(*) FILTER ((ix + iy) % 3 = 0) <= 0.5e0 * count(*)")
def semantic_regions(spark, d):
    """Labelled components large enough and not already explained by voids."""
    m = small_mask(spark, d)
    return R.semantic_regions(R.labelled(m), m.where((c("ix") + c("iy")) % 3 == 0), least=3)
