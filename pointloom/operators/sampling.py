"""Grid reduction and samples that keep original record ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.cloud import binned, bounds, num


def voxel_keys(origin: Sequence[float], size: float) -> list[Column]:
    return [binned(F.col(c), size, o).alias(f"v{c}") for c, o in zip("xyz", origin, strict=True)]


def voxels(cloud: DataFrame, size: float, origin: Sequence[float] | None = None, last: bool = False) -> DataFrame:
    """One row for each occupied voxel: its first (and last) record id and its number of points."""
    if origin is None:
        b = bounds(cloud).first()
        origin = (b.min_x, b.min_y, b.min_z) if b.n else (0.0, 0.0, 0.0)
    extra = [F.max("rid").alias("last_rid")] if last else []
    return cloud.groupBy(*voxel_keys(origin, size)).agg(F.min("rid").alias("first_rid"), *extra, F.count(F.lit(1)).alias("n"))


def voxel_sample(cloud: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """The original record with the lowest id of each voxel, by one partial aggregation and no join back."""
    others = [c for c in cloud.columns if c != "rid"]
    first = F.min(F.struct("rid", *others)).alias("p")
    return cloud.groupBy(*voxel_keys(origin, size)).agg(first).select("p.*")


def budgeted_size(cloud: DataFrame, size: float, most: int, doublings: int = 64) -> tuple[float, int, int]:
    """(size, voxels, doublings): the voxel doubles until at most ``most`` voxels are occupied.

    Every doubling bins the original points anew; only counts come back, four sizes of one pass at a time.
    """
    b = bounds(cloud).first()
    if not b.n:
        return size, 0, 0
    origin = (b.min_x, b.min_y, b.min_z)
    for start in range(0, doublings + 1, 4):
        tried = range(start, min(start + 4, doublings + 1))
        keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *voxel_keys(origin, size * 2**k)) for k in tried])).alias("v")
        counts = {r.k: r.n for r in cloud.select(keys).select("v.*").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
        for k in tried:
            if counts[k] <= most:
                return size * 2**k, counts[k], k
    raise ValueError("the budget cannot be met")


def top_by_hash(rows: DataFrame, by: Sequence[str], k: int, hashed: Column, tie: str = "rid") -> DataFrame:
    """Per group the k smallest hashes; ranking limits each partition before it shuffles."""
    order = Window.partitionBy(*by).orderBy(hashed, tie)
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def nearest_peak(bin_: Column, peaks: Sequence[int], reach: int = 1) -> Column:
    """The nearest peak of a sorted list, the lower one on ties, null beyond ``reach`` bins."""
    options = F.array(*[F.struct(F.abs(bin_ - p).alias("d"), F.lit(p).cast("long").alias("p")) for p in sorted(peaks)])
    best = F.array_min(options)
    return F.when(best["d"] <= reach, best["p"])


def evenly_spaced(cloud: DataFrame, most: int, position: str = "pos", total: int | None = None) -> DataFrame:
    """At most ``most`` rows, evenly spaced by position 0 .. n - 1: floor(i * (n - 1) / (c - 1))."""
    n = cloud.count() if total is None else total
    if n <= most or most < 2:
        return cloud
    # Position p is taken when some i has floor(i * (n - 1) / (c - 1)) = p.
    i = F.floor((F.col(position) * (most - 1) + (n - 2)) / num(n - 1)).cast("long")
    return cloud.where(F.floor(i * (n - 1) / num(most - 1)).cast("long") == F.col(position))


def examples(rows: DataFrame, by: str, k: int, order: str = "rid") -> DataFrame:
    """The first k ids of each group as one array."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    few = rows.withColumn("_k", rank).where(F.col("_k") <= k)
    return few.groupBy(by).agg(F.sort_array(F.collect_list(order)).alias("examples"))


def voxel_inverse(cloud: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """Every record with the representative of its voxel (lowest scan, then id)."""
    keyed = cloud.select("*", *voxel_keys(origin, size))
    first = keyed.groupBy("vx", "vy", "vz").agg(F.min(F.struct("scan", "rid")).alias("r"))
    return keyed.join(first, ["vx", "vy", "vz"]).select("rid", "scan", F.col("r.scan").alias("rep_scan"), F.col("r.rid").alias("rep_rid"))
