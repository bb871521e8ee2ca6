"""What the original points say about faces and walls: counts, residuals, refits, supported extents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import ordered as O
from pointloom.operators.cloud import num

#: Sums of doubles run over integers of this unit, so that they do not depend on the plan.
UNIT = 1e9


def micro(c, unit: float = 1e6):
    return F.round(c * num(unit)).cast("long")


def scan_counts(near: DataFrame, owner: str = "face") -> DataFrame:
    return near.groupBy(owner, "scan").agg(F.count_distinct("rid").alias("n"))


def fit_quality(near: DataFrame, owner: str) -> DataFrame:
    """Points, RMSE and largest distance of each owner; a point counts with its nearest face."""
    each = near.groupBy(owner, "rid").agg(F.min(F.abs("resid")).alias("d"))
    square = micro(F.col("d") * F.col("d"), UNIT)
    return each.groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("s"), F.max("d").alias("most")).select(owner, "n", micro(F.sqrt(F.col("s") / num(UNIT) / F.col("n"))).alias("rmse_micro"), micro(F.col("most")).alias("max_micro"))


def refit(near: DataFrame, bins: float, owner: str = "face") -> DataFrame:
    """Robust refit: residual histogram -> median -> deviation -> trim -> line through what is left.

    One histogram and one pass of sums; all in integers, so any partitioning gives the same plane.
    """
    h = near.withColumn("bin", F.floor(F.col("resid") / num(bins)).cast("long")).groupBy(owner, "bin").agg(F.count(F.lit(1)).alias("n"))
    md = O.weighted_median(h, [owner]).drop("n")
    dev = h.join(md, owner).withColumn("dev", F.abs(F.col("bin") - F.col("median_bin")))
    mad = O.weighted_median(dev.groupBy(owner, "dev").agg(F.sum("n").alias("n")), [owner], "dev").select(owner, F.col("median_bin").alias("mad_bin"))
    limits = md.join(mad, owner).withColumn("reach", F.greatest(F.lit(1).cast("long"), 3 * F.col("mad_bin")))
    kept = near.withColumn("bin", F.floor(F.col("resid") / num(bins)).cast("long")).join(limits, owner).where(F.abs(F.col("bin") - F.col("median_bin")) <= F.col("reach"))
    a, r = micro(F.col("along"), 1e4), micro(F.col("resid"), 1e4)
    sums = kept.groupBy(owner, "median_bin", "mad_bin").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sa"), F.sum(r).alias("sr"), F.sum(a * a).alias("saa"), F.sum(a * r).alias("sar"))
    # Products of two sums: more than a long holds, for a face of some hundred thousand points.
    n, sa, sr, saa, sar = (F.col(v).cast("decimal(19,0)") for v in ("n", "sa", "sr", "saa", "sar"))
    spread = n * saa - sa * sa
    slope = F.when(spread != 0, (n * sar - sa * sr).cast("double") / spread.cast("double"))
    return sums.select(owner, "median_bin", "mad_bin", "n", micro(slope).alias("slope_micro"), micro(F.col("sr").cast("double") / F.col("n") / num(1e4)).alias("offset_micro"))


def height_support(near: DataFrame, owner: str = "face", bands: int = 12) -> DataFrame:
    """Counts in equal height bands and the share of bands that hold enough points."""
    share = (F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0"))
    band = F.least(F.lit(bands - 1).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor(share * num(bands)).cast("long")))
    counts = near.groupBy(owner, band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(owner).agg(F.sum("n").alias("total"))
    good = counts.join(total, owner).where(F.col("n") >= F.greatest(num(6), num(0.005) * F.col("total")))
    return total.join(good.groupBy(owner).agg(F.count(F.lit(1)).alias("bands")), owner, "left").select(owner, "total", F.coalesce("bands", F.lit(0).cast("long")).alias("bands"))


def supported_extents(near: DataFrame, width: float, height: float, least_bands: int = 2, bridge: int = 1, owner: str = "face") -> DataFrame:
    """Runs of columns along a face that at least ``least_bands`` height slices support; short gaps are bridged."""
    cells = near.select(owner, F.floor(F.col("along") / num(width)).cast("long").alias("col"), F.floor(F.col("z") / num(height)).cast("long").alias("slice")).distinct()
    columns = cells.groupBy(owner, "col").agg(F.count(F.lit(1)).alias("slices")).where(F.col("slices") >= least_bands)
    return O.runs(columns, [owner], "col", gap=1 + bridge)


def raster_stats(near: DataFrame, pixel: float, owner: str = "face") -> DataFrame:
    """Per pixel of a wall image: returns, sum and least of depth."""
    px, pz = F.floor(F.col("along") / num(pixel)).cast("long"), F.floor(F.col("z") / num(pixel)).cast("long")
    return near.groupBy(owner, px.alias("px"), pz.alias("pz")).agg(F.count(F.lit(1)).alias("n"), F.sum(micro(F.col("resid"))).alias("sum_micro"), F.min(F.abs("resid")).alias("least"))


def wall_image(near: DataFrame, pixel: float, face_depth: float, owner: str = "face") -> DataFrame:
    """Per pixel: face and other returns, nearest signed depth (ties to the smaller), record of the nearest by (depth, scan, id)."""
    px, pz = F.floor(F.col("along") / num(pixel)).cast("long"), F.floor(F.col("z") / num(pixel)).cast("long")
    return near.groupBy(owner, px.alias("px"), pz.alias("pz")).agg(
        F.count_if(F.abs("resid") <= num(face_depth)).alias("face_n"),
        F.count_if(F.abs("resid") > num(face_depth)).alias("return_n"),
        F.min(F.struct(F.abs("resid").alias("a"), "resid"))["resid"].alias("depth"),
        F.min(F.struct(F.abs("resid").alias("a"), "scan", "rid"))["rid"].alias("nearest_rid"),
    )


def most_common_bin(histogram: DataFrame, by: str, bin_: str = "bin", n: str = "n") -> DataFrame:
    """The fullest bin, the first one on ties."""
    return histogram.groupBy(by).agg(F.max_by(bin_, F.struct(F.col(n), -F.col(bin_))).alias("top_bin"))
