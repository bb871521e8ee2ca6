"""Whole steps put together from parts: openings on wall rasters, topology, faces by openings, facades, slabs and voids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.operators import ordered as O
from pointloom.operators import raster as M
from pointloom.operators import recognise
from pointloom.operators.cloud import num
from pointloom.operators.elements import accepted
from pointloom.operators.grid import small
from pointloom.operators.relations import corner_places
from pointloom.sources.tables import kept

c = F.col
mm = lambda v: F.round(v * num(1e3)).cast("long")

#: Walls that a storey may have when a model is reconstructed.
MOST_WALLS = 4096
#: Height above the floor from which returns count as a wall's (metres).
SKIRT = 0.05
#: Cells along or up a wall raster; a wall is shorter than 1.6 km in cells of 10 cm.
RASTER = 1 << 14


def detected_openings(mask: DataFrame, walls: DataFrame, cell: float) -> DataFrame:
    """Openings on wall rasters: (wall, kind, x0, x1, y0, y1, vacancy, sides) in cells, corners included.

    ``mask`` (wall, plane, ix, iy) are cells with returns on each observed plane of a wall, ``walls`` (wall, length, height) in
    metres. Empty components that touch neither the ends nor the top of the wall are candidates; single missing
    cells are closed first. A candidate is judged by its vacancy and the support of the strips at its sill, jambs and head; at
    least two of the jambs and head must be supported. Candidates of several planes that overlap are one opening: the best
    supported stays, ties go to the lower plane and then to the place.
    """
    last = lambda v: F.floor(c(v) / num(cell) + num(1e-9)).cast("long") - 1
    cells = kept(M.words(mask.select((c("wall") * 16 + c("plane")).alias("grp"), "ix", "iy")).repartition("grp"))  # neighbours lie together
    planes = cells.select("grp").distinct().select("grp", F.shiftright("grp", 4).alias("wall"), c("grp").bitwiseAND(F.lit(15)).alias("plane"))
    frames = planes.join(walls, "wall").select("grp", "wall", "plane", "height", F.lit(0).cast("long").alias("x0"), last("length").alias("x1"), F.lit(0).cast("long").alias("y0"), last("height").alias("y1"))
    empty = M.labelled_runs(kept(M.empty_runs(cells, frames)), RASTER).groupBy("grp", "component").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("start").alias("y0"), F.max("end").alias("y1"))
    f = frames.select("grp", "wall", "plane", "height", c("x1").alias("fx"), c("y1").alias("fy"))
    found = empty.join(f, "grp").where((c("x0") > 0) & (c("x1") < c("fx")) & (c("y1") < c("fy")))
    found = found.select("grp", "wall", "plane", "height", "component", (c("x0") - 1).alias("x0"), (c("x1") + 1).alias("x1"), F.greatest(c("y0") - 1, F.lit(0)).alias("y0"), (c("y1") + 1).alias("y1"))
    found = kept(found)  # few rows, read several times below
    edge = lambda part, *at: F.struct(F.lit(part).alias("part"), *[v.cast("long").alias(n) for n, v in zip(("x0", "x1", "y0", "y1"), at)])
    strips = F.array(
        edge("self", c("x0"), c("x1"), c("y0"), c("y1")), edge("sill", c("x0"), c("x1"), c("y0") - 1, c("y0") - 1), edge("head", c("x0"), c("x1"), c("y1") + 1, c("y1") + 1),
        edge("left", c("x0") - 1, c("x0") - 1, c("y0"), c("y1")), edge("right", c("x1") + 1, c("x1") + 1, c("y0"), c("y1")),
    )
    named = found.select("grp", "component", F.explode(strips).alias("s")).select("grp", "component", "s.*")
    hits = M.words_set(named, cells, ["component", "part"]).groupBy("component").agg(*[F.sum(F.when(c("part") == p, c("n"))).alias(p) for p in ("self", "sill", "head", "left", "right")])
    wide, tall = c("x1") - c("x0") + 1, c("y1") - c("y0") + 1
    share = {"self": wide * tall, "sill": wide, "head": wide, "left": tall, "right": tall}
    j = found.join(hits, "component", "left").withColumns({p: F.coalesce(p, F.lit(0).cast("long")) / area for p, area in share.items()})
    side = lambda v: (c(v) >= num(0.5)).cast("long")
    size = lambda a, z: (c(z) - c(a) + 1) * num(cell)
    kind = M.opening_kind(size("x0", "x1"), size("y0", "y1"), c("y0") * num(cell), c("height"), num(1) - c("self"), c("sill"), cell)
    judged = j.withColumn("sides", side("head") + side("left") + side("right")).withColumn("vacancy", num(1) - c("self")).withColumn("kind", kind).where(c("kind").isNotNull() & (c("sides") >= 2))
    order = Window.partitionBy("wall").orderBy(F.desc("sides"), F.desc("vacancy"), "plane", "x0", "y0", "component")
    ranked = kept(judged.withColumn("rank", F.row_number().over(order)).withColumn("opening", c("component")))
    upper = lambda v: (c(v) + 1).alias(v)
    best = accepted(ranked.select(c("wall").alias("host"), "opening", "rank", "x0", upper("x1"), "y0", upper("y1")))
    return ranked.join(best.select(c("host").alias("wall"), "opening"), ["wall", "opening"], "left_semi").select("wall", "kind", "x0", "x1", "y0", "y1", F.round("vacancy", 6).alias("vacancy"), "sides")


def wall_cells(cloud: DataFrame, walls: DataFrame, by: str, cell: float, depth: float) -> DataFrame:
    """Raster cells (wall, plane, ix, iy) of the points near each wall: plane 0 holds the points on the left of its axis, 1 those on the right.

    Points meet the walls of their own storey; ``walls`` is (by, wall, x0, y0, x1, y1, thickness, base).
    """
    ux, uy = X.unit(c("x0"), c("y0"), c("x1"), c("y1"))
    j = cloud.select(by, "x", "y", "z").join(small(walls), by)
    along, off = (c("x") - c("x0")) * ux + (c("y") - c("y0")) * uy, (c("y") - c("y0")) * ux - (c("x") - c("x0")) * uy
    near = j.where((F.abs(off) <= c("thickness") / 2 + num(depth)) & along.between(num(0), X.length(c("x0"), c("y0"), c("x1"), c("y1"))) & (c("z") >= c("base")))
    at = lambda v: F.floor(v / num(cell) + num(1e-9)).cast("long")
    return near.select("wall", F.when(off >= 0, 0).otherwise(1).cast("long").alias("plane"), at(along).alias("ix"), at(c("z") - c("base")).alias("iy")).distinct()


def uncovered(walls: DataFrame, by: str, slack: float) -> DataFrame:
    """Walls without those of a single face that lie inside a wall of paired faces: both ends within its body, but for ``slack``."""
    names = ["x0", "y0", "x1", "y1", "thickness"]
    paired = walls.where("label = 'paired_faces'").select(c(by).alias("_by"), *[c(n).alias(f"p_{n}") for n in names])
    p = [c(f"p_{n}") for n in names[:4]]
    ux, uy = X.unit(*p)

    def inside(x, y):
        along, off = (x - p[0]) * ux + (y - p[1]) * uy, (y - p[1]) * ux - (x - p[0]) * uy
        return (F.abs(off) <= c("p_thickness") / 2 + num(slack)) & along.between(num(-slack), X.length(*p) + num(slack))

    held = (c(by) == c("_by")) & (c("label") == "single_face_candidate") & inside(c("x0"), c("y0")) & inside(c("x1"), c("y1"))
    return walls.join(paired, held, "left_anti")


def reconstructed(cloud: DataFrame, by: str, bottom: float, top: float, height: float, cell: float = 0.1, depth: float = 0.03) -> DataFrame:
    """A model of each storey from its points: (by, kind, wall, label, x0_mm, x1_mm, y0_mm, y1_mm, thickness_mm).

    Walls come from faces of several height slices, paired over the storey's outline, and are rows of kind ``wall`` with their ends;
    faces inside a paired wall go. Each wall's points make a raster for either side, whose bounded voids are its openings, in place
    and height along the wall; heights count from the floor. A storey has at most ``MOST_WALLS`` walls.
    Only outlines, faces and walls of a storey reach Python; points stay in Spark.
    """
    found = kept(uncovered(recognise.walls_from_faces(recognise.multi_slice_walls(cloud, by, bottom, top), recognise.footprints(cloud, by), by), by, cell))
    if not found.where(c("wall") >= MOST_WALLS).isEmpty():
        raise ValueError(f"a storey has more than {MOST_WALLS} walls")
    walls = found.withColumn("_wall", c("wall")).withColumn("wall", c(by) * MOST_WALLS + c("_wall")).withColumn("base", num(SKIRT))
    cells = wall_cells(cloud, walls, by, cell, depth)
    sizes = walls.select("wall", X.length(c("x0"), c("y0"), c("x1"), c("y1")).alias("length"), num(height).alias("height"))
    holes = detected_openings(cells, sizes, cell).join(walls.select("wall", by, "_wall", "label", "thickness"), "wall")
    along = lambda v, more=0: mm((c(v) + more) * num(cell)).alias(f"{v}_mm")
    up = lambda v, more=0: F.when(c(v) + more > 0, mm((c(v) + more) * num(cell) + num(SKIRT))).otherwise(0).alias(f"{v}_mm")
    hole_rows = holes.select(by, "kind", c("_wall").alias("wall"), "label", along("x0"), along("x1", 1), up("y0"), up("y1", 1), mm(c("thickness")).alias("thickness_mm"))
    wall_rows = walls.select(by, F.lit("wall").alias("kind"), c("_wall").alias("wall"), "label", *[mm(c(v)).alias(f"{v}_mm") for v in ("x0", "x1", "y0", "y1")], mm(c("thickness")).alias("thickness_mm"))
    return wall_rows.unionByName(hole_rows)


def junctions(walls: DataFrame, reach: float, cell: float = 1.0) -> DataFrame:
    """Places (storey, x, y) of ends within ``reach`` of the inside of another wall of their storey: its ``host`` and foot (fx, fy) on the nearest one.

    Ties go to the smaller id. Ends of one place and walls of one place meet once, as a place and the wall of the smallest id. A wall spreads over
    the cells of its bounding box, an end lies in one; a wall's own ends are never inside it.
    """
    at = lambda v: F.floor(v / num(cell)).cast("long")
    span = lambda a, b: F.explode(F.sequence(at(F.least(a, b) - num(reach)), at(F.greatest(a, b) + num(reach))))
    names = ("x0", "y0", "x1", "y1")
    body = walls.groupBy("storey", *names).agg(F.min("id").alias("host")).select("storey", "host", *[c(n).alias(f"h_{n}") for n in names])
    body = body.withColumn("cx", span(c("h_x0"), c("h_x1"))).withColumn("cy", span(c("h_y0"), c("h_y1")))
    j = ends_of(walls).select("storey", "x", "y").distinct().withColumn("cx", at(c("x"))).withColumn("cy", at(c("y"))).join(body.hint("merge"), ["storey", "cx", "cy"])
    h = [c(f"h_{n}") for n in names]
    j = j.where(~(((c("x") == h[0]) & (c("y") == h[1])) | ((c("x") == h[2]) & (c("y") == h[3]))))
    ux, uy = X.unit(*h)
    along, off = (c("x") - h[0]) * ux + (c("y") - h[1]) * uy, (c("y") - h[1]) * ux - (c("x") - h[0]) * uy
    near = j.withColumn("along", along).withColumn("off", F.abs(off)).where((c("off") <= num(reach)) & (c("along") > num(reach)) & (c("along") < X.length(*h) - num(reach)))
    foot = F.struct(F.round(c("off") * num(1e6)).cast("long").alias("d"), "host", (h[0] + c("along") * ux).alias("x"), (h[1] + c("along") * uy).alias("y"))
    return near.groupBy("storey", "x", "y").agg(F.min(foot).alias("f")).select("storey", "x", "y", "f.host", c("f.x").alias("fx"), c("f.y").alias("fy"))


def ends_of(walls: DataFrame) -> DataFrame:
    """Both ends of each wall: (storey, wall, end, node, x, y)."""
    both = F.array(F.struct(F.lit(0).alias("end"), c("x0").alias("x"), c("y0").alias("y")), F.struct(F.lit(1).alias("end"), c("x1").alias("x"), c("y1").alias("y")))
    return walls.select("storey", c("id").alias("wall"), F.explode(both).alias("e")).select("storey", "wall", "e.end", (c("wall") * 2 + c("e.end")).cast("long").alias("node"), "e.x", "e.y")


def snapped_topology(walls: DataFrame, reach: float, least: float) -> DataFrame:
    """Walls (storey, id, x0, y0, x1, y1) whose ends meet: corners at the mean of their ends, T-junctions at the foot on the wall they run into.

    All moves come from one snapshot of the walls. A wall that would get shorter than ``least`` keeps its own ends (``restored``); a
    corner takes precedence over a junction. Coordinates are in millimetres, so equal corners are equal numbers.
    """
    at, all_ends = ["storey", "x", "y"], ends_of(walls)
    own = kept(corner_places(all_ends, reach))
    corner = own.groupBy("corner").agg(*[F.round(F.sum(mm(c(v)) * c("n")) / F.sum("n")).cast("long").alias(f"c{v}") for v in "xy"])
    corner = own.join(corner, "corner").select(*at, "cx", "cy")
    foot = junctions(walls, reach).select(*at, mm(c("fx")).alias("tx"), mm(c("fy")).alias("ty"))
    j = all_ends.join(corner.hint("merge"), at, "left").join(foot.hint("merge"), at, "left")
    moved = j.select("storey", "wall", "end", mm(c("x")).alias("x"), mm(c("y")).alias("y"), F.coalesce("cx", "tx", mm(c("x"))).alias("nx"), F.coalesce("cy", "ty", mm(c("y"))).alias("ny"), F.when(c("cx").isNotNull(), "corner").when(c("tx").isNotNull(), "junction").otherwise("free").alias("kind"))
    end = lambda v, k: F.max(F.when(c("end") == k, c(v)))
    names = [(f"{v}{k}", end(v, k)) for k in (0, 1) for v in ("x", "y", "nx", "ny", "kind")]
    whole = moved.groupBy("storey", c("wall").alias("id")).agg(*[v.alias(n) for n, v in names])
    square = (c("nx1") - c("nx0")) * (c("nx1") - c("nx0")) + (c("ny1") - c("ny0")) * (c("ny1") - c("ny0"))
    lost = square < int(round(least * 1e3)) ** 2
    pick = lambda v, k: F.when(lost, c(f"{v}{k}")).otherwise(c(f"n{v}{k}")).alias(f"{v}{k}_mm")
    return whole.select("storey", "id", *[pick(v, k) for k in (0, 1) for v in "xy"], *[F.when(lost, "free").otherwise(c(f"kind{k}")).alias(n) for k, n in ((0, "start"), (1, "end"))], lost.alias("restored"))


def faces_by_openings(faces: DataFrame, openings: DataFrame, thickness: tuple[float, float], slack: float) -> DataFrame:
    """Parallel faces that show the same openings are the two sides of one wall: (a, b, matches, thickness_mm, lo, hi).

    ``faces`` (storey, id, offset, a0, a1) are parallel and in one frame, ``openings`` (face, kind, centre) lie along it. Two
    faces pair where their distance is a wall's thickness and openings of one kind agree within ``slack``. Each face
    prefers most matches, then the thinner wall, then the smaller id; only mutual choices become walls, over the common extent.
    """
    at = F.floor(c("centre") / num(slack)).cast("long")
    placed = openings.join(faces, openings["face"] == faces["id"]).select("storey", "face", "kind", "centre", "offset", "a0", "a1", at.alias("cell"))
    left = placed.select(*[c(n).alias(f"l_{n}") for n in placed.columns]).withColumn("cell", F.explode(F.array(*[c("l_cell") + k for k in (-1, 0, 1)])))
    right = placed.select("cell", *[c(n).alias(f"r_{n}") for n in placed.columns if n != "cell"])
    j = left.join(right, (c("l_storey") == c("r_storey")) & (c("l_kind") == c("r_kind")) & (left["cell"] == right["cell"])).where("l_face < r_face")
    gap = F.abs(c("l_offset") - c("r_offset"))
    j = j.where((F.abs(c("l_centre") - c("r_centre")) <= num(slack)) & gap.between(num(thickness[0]), num(thickness[1])))
    lo, hi = F.greatest("l_a0", "r_a0"), F.least("l_a1", "r_a1")
    pairs = j.where(hi > lo).groupBy(c("l_face").alias("a"), c("r_face").alias("b")).agg(F.count_distinct("l_centre").alias("matches"), F.min(mm(gap)).alias("thickness_mm"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    place = lambda mine, other: F.row_number().over(Window.partitionBy(mine).orderBy(F.desc("matches"), "thickness_mm", other))
    sides = pairs.select(c("a").alias("me"), c("b").alias("you"), "matches", "thickness_mm").unionByName(pairs.select(c("b").alias("me"), c("a").alias("you"), "matches", "thickness_mm"))
    choice = sides.withColumn("k", place("me", "you")).where("k = 1").select("me", "you")
    ab, ba = choice.select(c("me").alias("a"), c("you").alias("b")), choice.select(c("you").alias("a"), c("me").alias("b"))
    return pairs.join(ab, ["a", "b"], "left_semi").join(ba, ["a", "b"], "left_semi")


def facade_groups(frames: DataFrame, gap: float = 0.16, rail: float = 0.75, least: int = 4) -> DataFrame:
    """Rows of at least ``least`` aligned frames on a host are a curtain wall: (host, grp, id).

    ``frames`` (host, id, lo, hi, sill, height, rail): members share sill and height in steps of 5 cm, neighbours are at most ``gap`` apart and
    have rails of support ``rail`` or more. ``grp`` is the smallest id of its group.
    """
    level = lambda v: F.round(c(v) * num(20)).cast("long")
    good = frames.where(c("rail") >= num(rail)).select("host", "id", "lo", "hi", level("sill").alias("row"), level("height").alias("rows"))
    by = ["host", "row", "rows"]
    w = Window.partitionBy(*by).orderBy("lo", "id")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = good.withColumn("new", F.when(c("lo") - reach <= num(gap), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*by, "run")
    return marked.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("grp", F.min("id").over(own)).where(c("n") >= least).select("host", "grp", "id")


def horizontal_surfaces(points: DataFrame, by: str, step: float, least: int, cell: float, flat: float = 0.97, curved: float = 0.025) -> DataFrame:
    """Slab faces of each group from points with normals (x, y, z, nz, curvature).

    Flat points fill a height histogram; runs of bins with ``least`` points or more are surfaces, each with its occupied cells
    and its plane z = a + b x + c y (least squares over integer sums): (by, from_bin, to_bin, points, cells, mean_mm, slope_x, slope_y in millionths).
    """
    level = points.where((F.abs(c("nz")) >= num(flat)) & (c("curvature") <= num(curved))).withColumn("bin", F.floor(c("z") / num(step) + num(1e-9)).cast("long"))
    dense = level.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= least)
    runs = O.runs(dense, [by], "bin").select(by, c("start").alias("from_bin"), c("end").alias("to_bin"))
    bins = runs.withColumn("bin", F.explode(F.sequence("from_bin", "to_bin")))
    at = lambda v: F.floor(c(v) / num(cell) + num(1e-9)).cast("long")
    held = level.join(bins, [by, "bin"]).select(by, "from_bin", "to_bin", mm(c("x")).alias("x"), mm(c("y")).alias("y"), mm(c("z")).alias("z"), at("x").alias("ix"), at("y").alias("iy"))
    keys = [by, "from_bin", "to_bin"]
    total = lambda v: F.sum(v.cast("decimal(38,0)")).cast("double")
    # One partial sum for each cell, so that neither sums nor cells need a second reading.
    part = held.groupBy(*keys, "ix", "iy").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in (("x", c("x")), ("y", c("y")), ("z", c("z")), ("xx", c("x") * c("x")), ("xy", c("x") * c("y")), ("yy", c("y") * c("y")), ("xz", c("x") * c("z")), ("yz", c("y") * c("z")))])
    s = part.groupBy(*keys).agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("cells"), *[total(c(k)).alias(k) for k in ("x", "y", "z", "xx", "xy", "yy", "xz", "yz")])
    n = c("points").cast("double")
    sxx, sxy, syy = c("xx") - c("x") * c("x") / n, c("xy") - c("x") * c("y") / n, c("yy") - c("y") * c("y") / n
    sxz, syz = c("xz") - c("x") * c("z") / n, c("yz") - c("y") * c("z") / n
    det = sxx * syy - sxy * sxy
    slope = lambda v: F.when(F.abs(det) > num(1e-6) * sxx * syy, F.round(v / det * num(1e6)).cast("long"))
    return s.select(*keys, "points", "cells", F.round(c("z") / n).cast("long").alias("mean_mm"), slope(sxz * syy - syz * sxy).alias("slope_x"), slope(syz * sxx - sxz * sxy).alias("slope_y"))


def outlines(labels: DataFrame) -> DataFrame:
    """Polygons of occupied cells (grp, ix, iy, component): area, outer and inner border in cell sides, and holes.

    Sides that only one cell has are border. A component's holes follow from its corners, sides and cells: holes = 1 - corners + sides -
    cells. Cells that share a corner are connected, as in ``raster.labelled``.
    """
    by = ["grp", "component"]
    cells = labels.select(*by, "ix", "iy").distinct()
    side = lambda d, x, y: F.struct(F.lit(d).alias("d"), (c("ix") + x).alias("x"), (c("iy") + y).alias("y"))
    sides = cells.select(*by, F.explode(F.array(side(0, 0, 0), side(0, 0, 1), side(1, 0, 0), side(1, 1, 0))).alias("s")).groupBy(*by, "s").agg(F.count(F.lit(1)).alias("n"))
    corners = cells.select(*by, F.explode(F.array(*[side(2, x, y) for x in (0, 1) for y in (0, 1)])).alias("s")).distinct()
    a = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("area"))
    e = sides.groupBy(*by).agg(F.count(F.lit(1)).alias("sides"), F.count_if(c("n") == 1).alias("border"))
    v = corners.groupBy(*by).agg(F.count(F.lit(1)).alias("corners"))
    return a.join(e, by).join(v, by).select(*by, "area", "border", (1 - c("corners") + c("sides") - c("area")).alias("holes"))


def hole_evidence(slabs: DataFrame, below: DataFrame, frames: DataFrame, least: int) -> DataFrame:
    """Holes of slabs: empty components of at least ``least`` cells that do not reach the frame, with what was seen through them.

    ``slabs`` and ``below`` are masks (grp, ix, iy) of the slab and of returns under it. ``open`` holes show returns in half of their
    cells or more, ``unseen`` ones in none, the rest are ``partly`` seen: (grp, component, area, seen, kind).
    """
    f = frames.select("grp", *[c(n).alias(f"f_{n}") for n in ("x0", "x1", "y0", "y1")])
    lab = M.labelled(M.complement(slabs, frames))
    inner = M.boxes(lab).join(f, "grp").where((c("x0") > c("f_x0")) & (c("x1") < c("f_x1")) & (c("y0") > c("f_y0")) & (c("y1") < c("f_y1")) & (c("area") >= least)).select("grp", "component", "area")
    seen = lab.join(below.select("grp", "ix", "iy").distinct(), ["grp", "ix", "iy"], "left_semi").groupBy("grp", "component").agg(F.count(F.lit(1)).alias("seen"))
    j = inner.join(seen, ["grp", "component"], "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
    return j.withColumn("kind", F.when(c("seen") * 2 >= c("area"), "open").when(c("seen") == 0, "unseen").otherwise("partly"))


def stair_voids(treads: DataFrame, slabs: DataFrame, cuts: DataFrame, cell: float, headroom: float = 2.0) -> DataFrame:
    """What each slab must be cut for stairs, and what its cuts leave: (host, slab, needed, cut, missing, physical, spare) in cells.

    ``treads`` (host, x0, x1, y0, y1, top), ``slabs`` (host, box, underside, top), ``cuts`` (host, box). A tread needs its place free
    where it lacks ``headroom`` under the slab, and ``physical`` counts missing cells whose tread reaches into the slab itself. Only
    cells of the slab count; treads above the slab need nothing.
    """
    s = slabs.select("host", "underside", c("top").alias("s_top"))
    short = treads.join(s, "host").where((c("underside") - c("top") < num(headroom)) & (c("top") <= c("s_top") + num(1e-9)))
    mark = lambda df, need, hit, cut, slab: M.rasterised(df, cell, "host").select("grp", "ix", "iy", *[F.lit(v).alias(n) for n, v in (("need", need), ("hit", hit), ("cut", cut), ("slab", slab))])
    cells = mark(short, 1, 0, 0, 0).unionAll(mark(short.where(c("top") > c("underside")), 0, 1, 0, 0)).unionAll(mark(cuts, 0, 0, 1, 0)).unionAll(mark(slabs, 0, 0, 0, 1))
    one = cells.groupBy("grp", "ix", "iy").agg(*[F.max(n).alias(n) for n in ("need", "hit", "cut", "slab")]).where("slab = 1")
    return one.groupBy(c("grp").alias("host")).agg(
        F.count(F.lit(1)).alias("slab"), F.sum("need").alias("needed"), F.sum("cut").alias("cut"), F.sum(c("need") * (1 - c("cut"))).alias("missing"),
        F.sum(c("hit") * (1 - c("cut"))).alias("physical"), F.sum((1 - c("need")) * c("cut")).alias("spare"),
    )


def coalesced_faces(faces: DataFrame, turn: float, lateral: float, gap: float) -> DataFrame:
    """Collinear faces of a storey as one: (storey, turn, line, lo_mm, hi_mm, faces).

    Faces (storey, angle in degrees, offset, lo, hi) of one direction (steps of ``turn`` degrees) whose offsets follow each other within
    ``lateral`` share a line; on a line, extents at most ``gap`` apart merge.
    """
    keyed = faces.withColumn("turn", F.pmod(F.round(c("angle") / num(turn)).cast("long"), F.lit(int(round(180 / turn)))))
    lined = O.clusters_in_order(keyed, ["storey", "turn"], "offset", lateral).select("storey", "turn", c("cluster").alias("line"), mm(c("lo")).alias("lo"), (mm(c("hi")) + int(round(gap * 1e3))).alias("hi"))
    by = ["storey", "turn", "line"]
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = lined.withColumn("new", F.when(c("lo") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "run").agg(F.min("lo").alias("lo_mm"), (F.max("hi") - int(round(gap * 1e3))).alias("hi_mm"), F.count(F.lit(1)).alias("faces")).drop("run")


def storey_points(cloud: DataFrame, storeys: DataFrame, cell: float = 1.0) -> DataFrame:
    """Points with the storey whose interval [bottom, top) holds them; points of none are left out, of several appear in each.

    Storeys spread over the height cells they touch, so this is an equi-join.
    """
    at = lambda v: F.floor(v / num(cell)).cast("long")
    spread = storeys.select("storey", "bottom", "top", F.explode(F.sequence(at(c("bottom")), at(c("top")))).alias("_cell"))
    j = cloud.withColumn("_cell", at(c("z"))).join(small(spread), "_cell")
    return j.where((c("z") >= c("bottom")) & (c("z") < c("top"))).select(*cloud.columns, "storey")


def point_limit(request: Column, memory: Column, share: float, bytes_each: int, least: int = 30) -> Column:
    """Points a budget of memory allows: the request, at most a share of the memory, at least ``least``."""
    return F.greatest(F.lit(least).cast("long"), F.least(request.cast("long"), F.floor(memory * num(share) / num(bytes_each)).cast("long")))


#: Classes that an evaluation counts as one (fixed values).
FAMILY = {"door": "opening", "window": "opening", "opening": "opening"}


def family(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in FAMILY.items() for v in kv]), kind), kind)


def vertical_interval(kind: Column, base: Column, height: Column, sill: Column, thickness: Column) -> Column:
    """Lowest and highest place of an element: openings stand on their sill, slabs hang below their base, all else rises from it."""
    return F.when(family(kind) == "opening", F.struct((base + sill).alias("lo"), (base + sill + height).alias("hi"))).when(kind == "slab", F.struct((base - thickness).alias("lo"), base.alias("hi"))).otherwise(F.struct(base.alias("lo"), (base + height).alias("hi")))


def snapshot(elements: DataFrame, parts: DataFrame, cuts: DataFrame) -> DataFrame:
    """Annotation rows (id, kind, area_mm2) of a model as it stands: rejected elements are left out, cuts are taken off,
    and an element of several parts gets one row for each, ``id#1``, ``id#2``, ... in order of their place.

    ``elements`` (id, kind, review_state), ``parts`` (id, x0, x1, y0, y1) boxes in millimetres, apart from each other, ``cuts`` likewise and approved; cuts of a
    part do not overlap.
    """
    live = elements.where(~F.coalesce(c("review_state") == "rejected", F.lit(False))).select("id", "kind")
    box = ["x0", "x1", "y0", "y1"]
    numbered = parts.withColumn("part", F.row_number().over(Window.partitionBy("id").orderBy(*box))).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("id")))
    cut = cuts.select("id", *[c(n).alias(f"c_{n}") for n in box])
    common = lambda a, z: F.greatest(F.lit(0), F.least(c(z), c(f"c_{z}")) - F.greatest(c(a), c(f"c_{a}")))
    off = numbered.join(cut, "id").groupBy("id", "part").agg(F.sum(common("x0", "x1") * common("y0", "y1")).alias("off"))
    j = live.join(numbered, "id").join(off, ["id", "part"], "left")
    name = F.when(c("of") > 1, F.concat_ws("#", c("id").cast("string"), c("part").cast("string"))).otherwise(c("id").cast("string"))
    return j.select(name.alias("id"), "kind", ((c("x1") - c("x0")) * (c("y1") - c("y0")) - F.coalesce("off", F.lit(0))).cast("long").alias("area_mm2")).where("area_mm2 > 0")


def clean_profile(ring: Column, tolerance: float) -> Column:
    """A ring of points without repeated ones and without corners whose height over their neighbours' line is within ``tolerance``.

    Null where fewer than three corners are left or the area changes by more than ``tolerance`` times the ring's length: a repair, not a change.
    """
    at = lambda a, k: F.element_at(a, (F.pmod(k, F.size(a)) + 1).cast("int"))
    dist = lambda p, q: X.length(p["x"], p["y"], q["x"], q["y"])
    cross = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    once = lambda a: F.filter(a, lambda p, k: dist(p, at(a, k + 1)) > num(tolerance))
    plain = lambda a: F.filter(a, lambda p, k: F.abs(cross(at(a, k - 1), p, at(a, k + 1))) > num(tolerance) * dist(at(a, k - 1), at(a, k + 1)))
    sound = lambda a: F.when((F.size(a) >= 3) & (F.abs(ring_area(ring) - ring_area(a)) <= num(tolerance) * ring_length(ring)), a)
    return _with(_with(_with(ring, once), plain), sound)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once: expressions that name it repeatedly would repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of points (x, y), positive anticlockwise."""
    nxt = lambda k: F.element_at(ring, (F.pmod(k + 1, F.size(ring)) + 1).cast("int"))
    twice = F.transform(ring, lambda p, k: p["x"] * nxt(k)["y"] - nxt(k)["x"] * p["y"])
    return F.aggregate(twice, num(0), lambda a, v: a + v) / 2


def ring_length(ring: Column) -> Column:
    nxt = lambda k: F.element_at(ring, (F.pmod(k + 1, F.size(ring)) + 1).cast("int"))
    sides = F.transform(ring, lambda p, k: X.length(p["x"], p["y"], nxt(k)["x"], nxt(k)["y"]))
    return F.aggregate(sides, num(0), lambda a, v: a + v)


def seed_planes(points: DataFrame, neighbours: DataFrame, distance: float, most: int = 8) -> DataFrame:
    """A plane for each point that has no region: the best of at most ``most`` pairs of its neighbours.

    ``neighbours`` (id, rank, nx, ny, nz) are places of a point's nearest ones in order. Pair k is neighbours 2k-1 and 2k; the plane through
    the point and a pair wins that holds most neighbours within ``distance``, the earlier pair on ties: (id, pair, inliers).
    """
    own = points.select("id", "x", "y", "z").join(neighbours, "id").select("id", "rank", (c("nx") - c("x")).alias("dx"), (c("ny") - c("y")).alias("dy"), (c("nz") - c("z")).alias("dz"))
    each = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "dx", "dy", "dz"))).alias("near"))
    count = F.least(F.lit(most), F.floor(F.size("near") / 2).cast("int"))
    p, q = (lambda k: F.element_at(c("near"), (2 * k - 1).cast("int"))), (lambda k: F.element_at(c("near"), (2 * k).cast("int")))

    def held(k):
        a, b = p(k), q(k)
        nx, ny, nz = a["dy"] * b["dz"] - a["dz"] * b["dy"], a["dz"] * b["dx"] - a["dx"] * b["dz"], a["dx"] * b["dy"] - a["dy"] * b["dx"]
        size = F.sqrt(nx * nx + ny * ny + nz * nz)
        n = F.size(F.filter(c("near"), lambda v: F.abs(v["dx"] * nx + v["dy"] * ny + v["dz"] * nz) <= num(distance) * size))
        return F.struct(F.when(size > num(1e-9), n).otherwise(F.lit(0)).alias("inliers"), (-k).alias("order"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), count), held))
    return each.where(count >= 1).withColumn("best", best).where(c("best.inliers") > 0).select("id", (-c("best.order")).cast("long").alias("pair"), c("best.inliers").cast("long").alias("inliers"))
