"""Masks as sparse cells (group, ix, iy): morphology, components, strips, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators import ordered as O
from pointloom.operators.cloud import num
from pointloom.operators.graph import connected_components
from pointloom.operators.grid import small


def moved(mask: DataFrame, reach: int) -> DataFrame:
    """Each cell at all offsets up to ``reach``."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return mask.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).select("grp", (F.col("ix") + F.col("_dx")).alias("ix"), (F.col("iy") + F.col("_dy")).alias("iy"))


def dilated(mask: DataFrame, reach: int = 1) -> DataFrame:
    return moved(mask, reach).distinct()


def eroded(mask: DataFrame, reach: int = 1) -> DataFrame:
    """Cells whose whole surroundings are set; beyond the raster nothing is."""
    n = (2 * reach + 1) ** 2
    return moved(mask.distinct(), reach).groupBy("grp", "ix", "iy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).drop("n")


def closed(mask: DataFrame, reach: int = 1) -> DataFrame:
    return eroded(dilated(mask, reach), reach)


def labelled_runs(runs: DataFrame, columns: int = 1 << 20, block: int = 64) -> DataFrame:
    """Components over eight neighbours of runs (grp, ix, start, end), named by the smallest cell key (grp, ix, iy).

    Cells of one ``ix`` that follow each other are one node, so that the graph has runs instead of cells. Runs of neighbouring ``ix``
    meet by blocks of ``iy``, so a long row of many runs does not meet itself whole.
    """
    key = (F.col("grp") * columns + F.col("ix")) * columns + F.col("start")
    runs = runs.select("grp", "ix", "start", "end", key.alias("k"))
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block)))
    left = runs.select("grp", (F.col("ix") + 1).alias("ix"), (F.col("start") - 1).alias("lo"), (F.col("end") + 1).alias("hi"), F.col("k").alias("a"))
    left = left.withColumn("block", spread(F.col("lo"), F.col("hi")))
    right = runs.select("grp", "ix", "start", "end", F.col("k").alias("b")).withColumn("block", spread(F.col("start"), F.col("end")))
    edges = left.join(right, ["grp", "ix", "block"]).where("start <= hi AND end >= lo").select("a", "b")
    every = edges.unionByName(runs.select(F.col("k").alias("a"), F.col("k").alias("b")))
    return runs.join(connected_components(every), F.col("k") == F.col("node")).select("grp", "ix", "start", "end", "component")


def labelled(mask: DataFrame, columns: int = 1 << 20, block: int = 64) -> DataFrame:
    """Components over eight neighbours: (grp, ix, iy, component), named by the smallest cell key (grp, ix, iy)."""
    found = labelled_runs(O.runs(mask.select("grp", "ix", "iy").distinct(), ["grp", "ix"], "iy"), columns, block)
    return found.select("grp", "ix", F.explode(F.sequence("start", "end")).alias("iy"), "component")


def boxes(labels: DataFrame) -> DataFrame:
    """Bounding box and area of each component."""
    return labels.groupBy("grp", "component").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.count(F.lit(1)).alias("area"))


def words(mask: DataFrame) -> DataFrame:
    """Cells of each column, 32 to a word: (grp, ix, block, bits); bit b of block k is ``iy`` 32 k + b."""
    return mask.groupBy("grp", "ix", F.shiftright("iy", 5).alias("block")).agg(F.expr("bit_or(shiftleft(1L, CAST(iy & 31 AS INT)))").alias("bits"))


def span_bits(lo: Column, hi: Column, block: Column) -> Column:
    """The bits of a word from ``iy`` lo to hi."""
    below = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.least(F.lit(32), n - block * 32)).cast("int")) - 1
    return below(hi + 1).bitwiseAND(F.bitwise_not(below(lo)))


def empty_runs(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """Runs (grp, ix, start, end) of the cells in each frame (grp, x0, x1, y0, y1) that no cell of ``cells`` (words) touches or sets.

    They are the complement of the dilated mask, found on words: three shifts instead of nine copies of each cell.
    """
    part = lambda step, bits: F.struct((F.col("block") + step).alias("block"), bits.alias("bits"))
    bits, low = F.col("bits"), F.lit((1 << 32) - 1)
    tall = bits.bitwiseOR(F.shiftleft(bits, 1)).bitwiseOR(F.shiftright(bits, 1)).bitwiseAND(low)
    grown = F.array(part(0, tall), part(1, F.shiftright(bits, 31)), part(-1, F.shiftleft(bits.bitwiseAND(F.lit(1)), 31)))
    near = cells.join(small(frames.select("grp", "x0", "x1", "y0", "y1")), "grp").select("grp", "x0", "x1", F.explode(F.array(*[F.col("ix") + d for d in (-1, 0, 1)])).alias("ix"), F.filter(grown, lambda w: (w.bits != 0) & w.block.between(F.shiftright("y0", 5), F.shiftright("y1", 5))).alias("w"))
    near = near.where(F.col("ix").between(F.col("x0"), F.col("x1"))).select("grp", "ix", F.explode("w").alias("w")).select("grp", "ix", "w.block", "w.bits", F.lit(0).cast("long").alias("inside"))
    whole = frames.select("*", F.explode(F.sequence("x0", "x1")).alias("ix")).select("*", F.explode(F.sequence(F.shiftright("y0", 5), F.shiftright("y1", 5))).alias("block"))
    every = whole.select("grp", "ix", "block", F.lit(0).cast("long").alias("bits"), span_bits(F.col("y0"), F.col("y1"), F.col("block")).alias("inside")).unionByName(near)
    left = every.groupBy("grp", "ix", "block").agg(F.bit_or("inside").bitwiseAND(F.bitwise_not(F.bit_or("bits"))).alias("bits")).where("bits <> 0")
    at = lambda v: F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("shiftright", v, b).bitwiseAND(F.lit(1)) == 1)
    first, last = at(bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1)))), at(bits.bitwiseAND(F.bitwise_not(F.shiftright(bits, 1))))
    runs = left.select("grp", "ix", "block", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("r")).select("grp", "ix", (F.col("block") * 32 + F.col("r.first")).alias("lo"), (F.col("block") * 32 + F.col("r.last") + 1).alias("hi"))
    return O.interval_union(runs, ["grp", "ix"]).select("grp", "ix", F.col("lo").alias("start"), (F.col("hi") - 1).alias("end"))


def words_set(strips: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many cells of the strips (by, grp, x0, x1, y0, y1) are set in ``cells`` (words): (by, n); strips without any are left out."""
    tall = strips.select("*", F.explode(F.sequence(F.shiftright("y0", 5), F.shiftright("y1", 5))).alias("block"))
    spread = tall.select(*by, "grp", F.explode(F.sequence("x0", "x1")).alias("ix"), "block", span_bits(F.col("y0"), F.col("y1"), F.col("block")).alias("span"))
    hit = cells.join(small(spread), ["grp", "ix", "block"])
    return hit.groupBy(*by).agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("span")))).alias("n")).where("n > 0")


def row_runs(mask: DataFrame) -> DataFrame:
    """Disjoint rectangles one row high that make up the mask; their areas add up."""
    return O.runs(mask.distinct(), ["grp", "iy"], "ix").select("grp", "iy", F.col("start").alias("x0"), F.col("end").alias("x1"))


def strip_support(strips: DataFrame, mask: DataFrame) -> DataFrame:
    """Share of each strip's cells (id, grp, x0, x1, y0, y1) that are set; empty cells count as 0.

    A strip spreads into its own rows, so the join with the mask is on (grp, row).
    """
    spread = strips.withColumn("iy", F.explode(F.sequence("y0", "y1")))
    hit = mask.distinct().join(small(spread), ["grp", "iy"]).where(F.col("ix").between(F.col("x0"), F.col("x1")))
    n = hit.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    area = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    return strips.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), area.alias("area"), (F.coalesce("n", F.lit(0).cast("long")) / area).alias("support"))


def complement(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """Empty cells inside each frame (grp, x0, x1, y0, y1)."""
    every = frames.withColumn("ix", F.explode(F.sequence("x0", "x1"))).withColumn("iy", F.explode(F.sequence("y0", "y1"))).select("grp", "ix", "iy")
    return every.join(mask.distinct(), ["grp", "ix", "iy"], "left_anti")


def opening_kind(width, height, sill, wall_height, vacancy, sill_support, cell: float):
    """door, window or unknown for a void; null where its size or vacancy make it no opening.

    A door starts in the lowest two rows of cells without a supported sill and ends well below the ceiling; glazing may
    reach from floor to ceiling; other windows have a sill of 0.05 to 1.8 m.
    """
    clear = wall_height - sill - height
    fits = width.between(num(0.5), num(3.2)) & height.between(num(0.55), num(2.8)) & (vacancy >= num(0.8))
    door = (sill <= num(1.5 * cell)) & (sill_support < num(0.15)) & (clear >= num(0.35)) & width.between(num(0.65), num(3.2)) & (height >= num(1.65))
    glazing = (sill <= num(0.2)) & (clear <= num(0.25))
    return F.when(fits, F.when(door, "door").when(glazing | sill.between(num(0.05), num(1.8)), "window").otherwise("unknown"))


def split_columns(support: DataFrame, least: float, width: int, by: Sequence[str] = ("grp",)) -> DataFrame:
    """Parts of a wide void between columns (grp, ix, support) that are supported: runs at least ``width`` wide."""
    return O.runs(support.where(F.col("support") < num(least)), list(by), "ix").where(F.col("cells") >= width)


def rasterised(boxes: DataFrame, cell: float, by: str = "grp") -> DataFrame:
    """Cells whose centre lies in a box (by, x0, x1, y0, y1); the plan algebra works on such cells."""
    low = lambda c: F.ceil(F.col(c) / num(cell) - num(0.5)).cast("long")
    out = boxes.withColumn("ix", F.explode(F.sequence(low("x0"), F.greatest(low("x0"), low("x1") - 1)))).withColumn("iy", F.explode(F.sequence(low("y0"), F.greatest(low("y0"), low("y1") - 1))))
    return out.where((F.col("ix") < low("x1")) & (F.col("iy") < low("y1"))).select(F.col(by).alias("grp"), "ix", "iy").distinct()


def plan_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of the union, intersection, differences and symmetric difference of two masks, counted per group in one pass."""
    one, zero = F.lit(1), F.lit(0)
    both = a.distinct().withColumn("in_a", one).withColumn("in_b", zero).unionByName(b.distinct().withColumn("in_a", zero).withColumn("in_b", one))
    cells = both.groupBy("grp", "ix", "iy").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return cells.groupBy("grp").agg(
        F.count(one).alias("union"), F.sum(F.col("in_a") * F.col("in_b")).alias("intersection"), F.sum(F.col("in_a") * (1 - F.col("in_b"))).alias("a_only"),
        F.sum((1 - F.col("in_a")) * F.col("in_b")).alias("b_only"), F.sum(F.abs(F.col("in_a") - F.col("in_b"))).alias("symmetric"),
    )


def spaces(walls: DataFrame, frames: DataFrame, least: int) -> DataFrame:
    """Rooms: free components of at least ``least`` cells that do not reach the frame (grp, x0, x1, y0, y1)."""
    found = boxes(labelled(complement(walls, frames)))
    f = frames.select("grp", *[F.col(c).alias(f"f_{c}") for c in ("x0", "x1", "y0", "y1")])
    inside = (F.col("x0") > F.col("f_x0")) & (F.col("x1") < F.col("f_x1")) & (F.col("y0") > F.col("f_y0")) & (F.col("y1") < F.col("f_y1"))
    return found.join(f, "grp").where(inside & (F.col("area") >= least)).select("grp", "component", "x0", "x1", "y0", "y1", "area")


def protruding(found: DataFrame, cell: float, depth: float = 0.08, width: tuple[float, float] = (0.08, 1.2), tall: float = 1.5, fill: float = 0.4) -> DataFrame:
    """Boxes of deep cells that may be columns: deep, narrow, tall and filled enough."""
    w, h = (F.col("x1") - F.col("x0") + 1) * num(cell), (F.col("y1") - F.col("y0") + 1) * num(cell)
    dense = F.col("area") >= num(fill) * (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    return found.where(w.between(num(width[0]), num(width[1])) & (h >= num(tall)) & dense)


def semantic_regions(members: DataFrame, voids: DataFrame, least: int = 6, covered: float = 0.5) -> DataFrame:
    """Labelled components (component, grp, ix, iy) of enough cells of which voids do not cover more than a share."""
    m = members.join(voids.distinct().withColumn("void", F.lit(1)), ["grp", "ix", "iy"], "left")
    n = m.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("cells"), F.count("void").alias("in_void"))
    return n.where((F.col("cells") >= least) & (F.col("in_void") <= num(covered) * F.col("cells")))
