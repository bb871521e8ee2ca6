"""Relations among slabs, stairs, landings, walls and their truth: hosting, coverage, metrics, convergence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.functions import geometry as K
from pointloom.functions.shipping import ship
from pointloom.operators import ordered as O
from pointloom.operators.cloud import num

#: Ids in one list of members of a shape; longer lists are several rows.
MEMBERS = 1024


def without_excluded(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Elements (id, class, z0, z1, x0 .. y1) that no excluded region of their class meets in height and footprint."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in regions.columns])
    apart = (F.col("r_class") == F.col("class")) & (F.col("z0") < F.col("r_z1")) & (F.col("z1") > F.col("r_z0")) & (F.col("x0") < F.col("r_x1")) & (F.col("x1") > F.col("r_x0")) & (F.col("y0") < F.col("r_y1")) & (F.col("y1") > F.col("r_y0"))
    return elements.join(r, apart, "left_anti")


def in_scope(elements: DataFrame, states: DataFrame) -> DataFrame:
    """Elements whose class is neither uncertain nor out of scope."""
    return elements.join(states.where(~F.col("state").isin("uncertain", "out_of_scope")), "class", "left_semi")


def confirmed_stairs(stairs: DataFrame) -> DataFrame:
    """Stairs whose geometry observation or a person has confirmed: enough observed treads, support, few inferred ones."""
    rule = (F.col("observed") >= 4) & (F.col("least_support") >= 6) & (F.col("inferred") <= num(0.4) * F.col("steps")) & F.coalesce(F.col("state") == "confirmed", F.lit(False))
    return stairs.withColumn("confirmed", F.coalesce(rule, F.lit(False)))


def sample_keys(keys: DataFrame, points: DataFrame) -> DataFrame:
    """How many requested records are missing, outside the crop, unsupported and usable."""
    j = keys.join(points.withColumn("_there", F.lit(True)), ["scan", "rid"], "left")
    return j.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("_there").isNull()).alias("missing"),
        F.count_if(F.col("_there") & ~F.col("selected")).alias("outside"),
        F.count_if(F.col("_there") & F.col("selected") & (F.col("label") < 0)).alias("unsupported"),
        F.count_if(F.col("_there") & F.col("selected") & (F.col("label") >= 0)).alias("usable"),
    )


def nearest_support(ends: DataFrame, plates: DataFrame, height: float, share: float) -> DataFrame:
    """Best plate of each stair end: within ``height``, covering ``share`` of it, observed ones first, then the nearest."""
    j = ends.select(*[F.col(c).alias(f"e_{c}") for c in ends.columns]).join(plates.select(*[F.col(c).alias(f"p_{c}") for c in plates.columns]), F.col("e_grp") == F.col("p_grp"))
    d, part = F.abs(F.col("e_z") - F.col("p_z")), X.box_overlap("e_", "p_") / X.box_area(*[F.col(f"e_{c}") for c in ("x0", "x1", "y0", "y1")])
    fits = j.withColumn("d", d).where((F.col("d") <= num(height)) & (part >= num(share)))
    best = fits.groupBy(F.col("e_id").alias("id")).agg(F.min(F.struct((~F.col("p_observed")).alias("o"), "d", F.col("p_id").alias("plate"))).alias("b"))
    return ends.select("id").join(best, "id", "left").select("id", F.col("b.plate").alias("plate"))


def host_violations(instances: DataFrame, hosts: DataFrame) -> DataFrame:
    """Instances whose host is unknown or of a type that cannot host them."""
    j = instances.join(hosts.select(F.col("id").alias("host"), F.col("type").alias("host_type")), "host", "left")
    rule = F.when(F.col("host_type").isNull(), "unknown_host").when(F.col("host_type") != F.col("needs"), "wrong_type")
    return j.withColumn("rule", rule).where("rule IS NOT NULL").select("id", "rule")


def coverage_classes(cells: DataFrame, cell_area: float) -> DataFrame:
    """Area and share of measured, justified and unsupported cells per slab; measured wins over justified."""
    kind = F.when(F.col("n") > 0, "measured").when(F.col("bridged"), "justified").otherwise("unsupported")
    each = cells.groupBy("slab", kind.alias("kind")).agg(F.count(F.lit(1)).alias("cells"))
    total = F.sum("cells").over(Window.partitionBy("slab"))
    return each.select("slab", "kind", "cells", (F.col("cells") * num(cell_area)).alias("area"), (F.col("cells") * num(100) / total).alias("percent"))


def interval_coverage(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Covered part of each truth interval (id, a, b) by found intervals (id, lo, hi), overlaps counted once."""
    inside = truth.join(found, "id").select("id", F.greatest("a", "lo").alias("lo"), F.least("b", "hi").alias("hi")).where("hi > lo")
    covered = O.interval_union(inside, ["id"]).groupBy("id").agg(F.sum(F.round((F.col("hi") - F.col("lo")) * num(1e6)).cast("long")).alias("covered_micro"))
    return truth.join(covered, "id", "left").select("id", F.coalesce("covered_micro", F.lit(0).cast("long")).alias("covered_micro"), F.round((F.col("b") - F.col("a")) * num(1e6)).cast("long").alias("length_micro"))


def wall_errors(pairs: DataFrame) -> DataFrame:
    """Errors of matched walls (t_*, p_*): ends (the better of both directions), offset, cosine, thickness."""
    t, p = [F.col(f"t_{c}") for c in ("x0", "y0", "x1", "y1")], [F.col(f"p_{c}") for c in ("x0", "y0", "x1", "y1")]
    straight = F.greatest(X.length(t[0], t[1], p[0], p[1]), X.length(t[2], t[3], p[2], p[3]))
    turned = F.greatest(X.length(t[0], t[1], p[2], p[3]), X.length(t[2], t[3], p[0], p[1]))
    ux, uy = X.unit(*t)
    vx, vy = X.unit(*p)
    off = F.greatest(*[F.abs((p[k + 1] - t[1]) * ux - (p[k] - t[0]) * uy) for k in (0, 2)])
    return pairs.select("id", F.least(straight, turned).alias("end_error"), off.alias("offset_error"), X.cosine(ux, uy, vx, vy).alias("cosine"), F.abs(F.col("t_thickness") - F.col("p_thickness")).alias("thickness_error"))


def converged(changes: DataFrame, tolerance: float) -> DataFrame:
    """First run of each case after two consecutive changes within tolerance; null where there is none."""
    w = O.over(["case"], "run")
    stable = F.col("change") <= num(tolerance)
    two = changes.withColumn("two", stable & F.coalesce(F.lag(stable).over(w), F.lit(False)))
    return two.groupBy("case").agg(F.min(F.when(F.col("two"), F.col("run"))).alias("run"))


def zone_pairs(faces: DataFrame, low: float, high: float, share: float) -> DataFrame:
    """Lower and upper horizontal faces of one group that may bound a slab: thickness in range, footprints overlap enough.

    The upper face spreads over thickness cells, so the pairing is an equi-join. Faces of one group and place meet as one; their
    members, in lists of at most ``MEMBERS``, are paired afterwards in all tasks.
    """
    size, place = high, ["grp", "z", "x0", "x1", "y0", "y1"]
    shapes = faces.select(*place).distinct()
    part_of = F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("id")) - 1) / MEMBERS)
    members = faces.withColumn("list", part_of).groupBy(*place, "list").agg(F.collect_list("id").alias("ids"))
    a = shapes.select(*[F.col(c).alias(f"a_{c}") for c in shapes.columns]).withColumn("cell", F.explode(F.array(F.floor(F.col("a_z") / num(size)).cast("long"), F.floor(F.col("a_z") / num(size)).cast("long") + 1)))
    b = shapes.select(*[F.col(c).alias(f"b_{c}") for c in shapes.columns]).withColumn("cell", F.floor(F.col("b_z") / num(size)).cast("long"))
    j = a.join(b, (F.col("a_grp") == F.col("b_grp")) & (a["cell"] == b["cell"])).where((F.col("b_z") - F.col("a_z")).between(num(low), num(high)))
    part = X.box_overlap("a_", "b_") / F.least(X.box_area(*[F.col(f"a_{c}") for c in ("x0", "x1", "y0", "y1")]), X.box_area(*[F.col(f"b_{c}") for c in ("x0", "x1", "y0", "y1")]))
    out = j.where(part >= num(share))
    for p in "ab":
        out = out.join(members.select(*[F.col(n).alias(f"{p}_{n}") for n in [*place, "list", "ids"]]).hint("merge"), [f"{p}_{n}" for n in place])
    tasks = int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(tasks, *[f"{p}_{n}" for p in "ab" for n in [*place, "list"]])
    return out.select(F.explode("a_ids").alias("lower"), "b_ids").select("lower", F.explode("b_ids").alias("upper"))


def profile_envelope(near: DataFrame, width: float, most_gap: int, share: float, owner: str = "face") -> DataFrame:
    """Lowest and highest point of each column of a wall, in millimetres: (owner, col, lo, hi, measured).

    Walls with too few measured columns, or a gap of more than ``most_gap``, have no envelope; shorter gaps lie on
    the straight line between their neighbours.
    """
    mm = lambda c: F.round(c * num(1e3)).cast("long")
    cols = near.groupBy(owner, F.floor(F.col("along") / num(width)).cast("long").alias("col")).agg(mm(F.min("z")).alias("lo"), mm(F.max("z")).alias("hi"))
    w, whole = O.over([owner], "col"), Window.partitionBy(owner)
    after = cols.withColumns({"next": F.lead("col").over(w), "lo2": F.lead("lo").over(w), "hi2": F.lead("hi").over(w)})
    shape = after.withColumns({"n": F.count(F.lit(1)).over(whole), "span": F.max("col").over(whole) - F.min("col").over(whole) + 1, "widest": F.max(F.col("next") - F.col("col") - 1).over(whole)})
    good = shape.where((F.col("n") >= num(share) * F.col("span")) & (F.coalesce("widest", F.lit(0)) <= most_gap))
    each = good.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("next") - F.col("col") - 1, F.lit(0).cast("long")))))
    between = lambda a, b: F.when(F.col("k") == 0, F.col(a)).otherwise(F.round(F.col(a) + F.col("k") * (F.col(b) - F.col(a)) / (F.col("next") - F.col("col"))).cast("long"))
    return each.select(owner, (F.col("col") + F.col("k")).alias("col"), between("lo", "lo2").alias("lo"), between("hi", "hi2").alias("hi"), (F.col("k") == 0).alias("measured"))


def column_envelopes(points: DataFrame, owner: str, least_height: float) -> DataFrame:
    """Height and principal spread of each component in the plan; too low ones have no geometry."""
    q = lambda c: F.round(F.col(c) * num(1e3)).cast("long")
    s = points.groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.sum(q("x")).alias("sx"), F.sum(q("y")).alias("sy"), F.sum(q("x") * q("x")).alias("sxx"), F.sum(q("x") * q("y")).alias("sxy"), F.sum(q("y") * q("y")).alias("syy"), (F.max("z") - F.min("z")).alias("height"))
    n = F.col("n").cast("double")
    cov = lambda ab, a, b: F.col(ab) / n - (F.col(a) / n) * (F.col(b) / n)
    big, small = X.principal_axis(cov("sxx", "sx", "sx"), cov("sxy", "sx", "sy"), cov("syy", "sy", "sy"))
    tall = F.col("height") >= num(least_height)
    return s.select(owner, "n", F.when(tall, F.round(F.sqrt(F.greatest(big, num(0))))).cast("long").alias("long_mm"), F.when(tall, F.round(F.sqrt(F.greatest(small, num(0))))).cast("long").alias("short_mm"))


def wall_views(walls: DataFrame) -> DataFrame:
    """Two canonical views of each wall, with the plane basis: measured where its own faces were seen, opposite, or inferred."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(own).alias("offset"), F.col(other).alias("opposite")) for s, own, other in ((1, "left_offset", "right_offset"), (-1, "right_offset", "left_offset"))])
    v = walls.withColumn("v", F.explode(sides))
    plane = F.coalesce(F.col("v.offset"), F.when(F.col("v.opposite").isNotNull(), F.col("v.opposite") + F.col("v.side") * F.col("thickness")), F.col("v.side") * F.col("thickness") / num(2))
    basis = F.when(F.col("v.offset").isNotNull(), "measured").when(F.col("v.opposite").isNotNull(), "opposite").otherwise("inferred")
    return v.select("id", F.col("v.side").alias("side"), plane.alias("plane"), basis.alias("basis"))


def farthest_pairs(points: DataFrame, owner: str) -> DataFrame:
    """The two points (a < b) of each group that lie farthest apart; ties go to the smallest ids.

    They are corners of the group's convex hull, so each batch of rows first gives up all but the corners of its own hulls.
    """

    def corners(batches):
        for pdf in batches:
            yield pd.concat([part[part[["x", "y"]].apply(tuple, axis=1).isin(set(map(tuple, K.hull(part[["x", "y"]].to_numpy()))))] for _, part in pdf.groupby(owner)]) if len(pdf) else pdf

    places = points.groupBy(owner, "x", "y").agg(F.min("rid").alias("rid")).select(owner, "rid", "x", "y")
    few = places.repartition(owner).mapInPandas(corners, places.schema)
    a, b = few.select(owner, F.col("rid").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), few.select(owner, F.col("rid").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    j = a.join(b, owner).where("a < b").withColumn("d", X.length(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return j.groupBy(owner).agg(F.max(F.struct("d", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("m")).select(owner, (-F.col("m.na")).alias("a"), (-F.col("m.nb")).alias("b"))


def clipped_faces(faces: DataFrame) -> DataFrame:
    """Each face cut to its interval [lo, hi] along itself; dropped where 1e-9 or less is left."""
    lo, hi = F.greatest(num(0), F.col("lo")), F.least(F.col("length"), F.col("hi"))
    return faces.withColumn("from_", lo).withColumn("to_", hi).where(hi - lo > num(1e-9))


ship(__name__)
