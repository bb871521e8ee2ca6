"""Point filters, transforms, crops and whole-cloud aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num(v: float) -> Column:
    return F.lit(float(v))


def finite(c: Column) -> Column:
    """Not NaN, not infinite; null stays null."""
    return ~F.isnan(c) & (F.abs(c) < num(math.inf))


def valid_points(cloud: DataFrame, flag: str = "invalid") -> DataFrame:
    """Points whose invalid flag is 0 and whose coordinates are finite."""
    return cloud.where((F.col(flag) == 0) & finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))


def scan_counters(cloud: DataFrame, flag: str = "invalid") -> DataFrame:
    """Raw, valid, invalid and nonfinite points of each scan; nonfinite counts only where the flag is 0."""
    good = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    unflagged = F.col(flag) == 0
    return cloud.groupBy("scan").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(unflagged & good).alias("valid"),
        F.count_if(~unflagged).alias("invalid"),
        F.count_if(unflagged & ~good).alias("nonfinite"),
    )


def channel(value: Column, flag: Column) -> tuple[Column, Column]:
    """(value, valid): valid where finite and unflagged; a value that is not finite is stored as 0."""
    good = F.coalesce(finite(value), F.lit(False))
    return F.when(good, value).otherwise(num(0)), good & (flag == 0)


def rotation(w: float, x: float, y: float, z: float) -> list[list[float]]:
    """Rotation matrix of a quaternion, scaled to length 1; one that is off by more than 1e-6 is an error."""
    norm = math.sqrt(w * w + x * x + y * y + z * z)
    if not abs(norm - 1) <= 1e-6:
        raise ValueError("a quaternion must have length 1")
    w, x, y, z = w / norm, x / norm, y / norm, z / norm
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def posed(cloud: DataFrame, poses: DataFrame) -> DataFrame:
    """Each point by its scan's pose (r00..r22, tx, ty, tz), applied once. Poses are one row per scan."""
    out = cloud.join(F.broadcast(poses) if poses.count() <= 100_000 else poses, "scan")
    at = [sum((F.col(f"r{i}{j}") * F.col(c) for j, c in enumerate("xyz") if j), F.col(f"r{i}0") * F.col("x")) + F.col(f"t{c}") for i, c in enumerate("xyz")]
    return out.select("rid", "scan", *[e.alias(c) for e, c in zip(at, "xyz", strict=True)])


def cartesian(distance: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    flat = distance * F.cos(elevation)
    return flat * F.cos(azimuth), flat * F.sin(azimuth), distance * F.sin(elevation)


def in_height(cloud: DataFrame, low: float, high: float) -> DataFrame:
    """Inclusive at both ends."""
    return cloud.where(F.col("z").between(num(low), num(high)))


def edge_tolerance(polygon: Sequence[tuple[float, float]]) -> float:
    xs, ys = zip(*polygon, strict=True)
    return max(1.0, max(xs) - min(xs), max(ys) - min(ys)) * 1e-10


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]], boundary: bool = True) -> Column:
    """Ray casting with the boundary inside, as one expression over at most 64 edges.

    A point is on an edge if the cross product with it is at most the tolerance, whatever the edge's length. Without
    ``boundary``, rays alone decide, also for points on edges.
    """
    if not 3 <= len(polygon) <= 64:
        raise ValueError("a polygon needs 3 to 64 vertices")
    tolerance = edge_tolerance(polygon)
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        dx, dy = bx - ax, by - ay
        cross = num(dx) * (y - num(ay)) - num(dy) * (x - num(ax))
        on_edge = on_edge | (
            (F.abs(cross) <= num(tolerance))
            & x.between(num(min(ax, bx) - tolerance), num(max(ax, bx) + tolerance))
            & y.between(num(min(ay, by) - tolerance), num(max(ay, by) + tolerance))
        )
        if dy:
            straddles = (F.lit(ay) > y) != (F.lit(by) > y)
            crossings = crossings + F.when(straddles & (x < num(dx) * (y - num(ay)) / num(dy) + num(ax)), 1).otherwise(0)
    return (on_edge | (crossings % 2 == 1)) if boundary else crossings % 2 == 1


def cropped(cloud: DataFrame, polygon: Sequence[tuple[float, float]], low: float, high: float, boundary: bool = True) -> DataFrame:
    """Height, then bounding box with the polygon's tolerance (both reach the scan), then the polygon itself. Ids stay."""
    xs, ys = zip(*polygon, strict=True)
    t = edge_tolerance(polygon)
    box = in_height(cloud, low, high).where(F.col("x").between(num(min(xs) - t), num(max(xs) + t)) & F.col("y").between(num(min(ys) - t), num(max(ys) + t)))
    return box.where(in_polygon(F.col("x"), F.col("y"), polygon, boundary))


def checked_crop(polygon: Sequence[tuple[float, float]], low: float, high: float) -> None:
    """A crop has 3 to 64 finite vertices, heights in order, and sides that neither cross nor touch but at common corners."""
    points = [tuple(map(float, p)) for p in polygon]
    if not 3 <= len(points) <= 64 or not all(map(math.isfinite, (low, high, *(v for p in points for v in p)))) or low >= high:
        raise ValueError("a crop needs 3 to 64 finite vertices and a lower height below the upper")

    def side(a, b, p) -> float:
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def touches(a, b, p) -> bool:
        return side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])

    n = len(points)
    sides = [(points[k], points[(k + 1) % n]) for k in range(n)]
    for i, (a, b) in enumerate(sides):
        for j in range(i + 1, n):
            c, d = sides[j]
            if j == i + 1 or (i == 0 and j == n - 1):
                far, corner = (d, b) if j == i + 1 else (c, a)
                bad = a == b or touches(a, b, far) or touches(c, d, a if corner == b else b)
            else:
                bad = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
                bad = bad or any(touches(*s, p) for s, p in (((a, b), c), ((a, b), d), ((c, d), a), ((c, d), b)))
            if bad:
                raise ValueError("a crop polygon must not cross or touch itself")


def not_empty(cloud: DataFrame, what: str = "selection") -> DataFrame:
    """The cloud itself, or an error where it has no points: an empty crop is never taken for a result."""
    if cloud.isEmpty():
        raise ValueError(f"the {what} holds no points")
    return cloud


def strided(cloud: DataFrame, stride: int, position: str = "rid") -> DataFrame:
    return cloud.where(F.pmod(F.col(position), F.lit(stride)) == 0)


def bounds(cloud: DataFrame) -> DataFrame:
    return cloud.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("n"))


def local_origin(cloud: DataFrame) -> tuple[float, float, float] | None:
    """Middle in x and y, lowest z; None for an empty cloud."""
    b = bounds(cloud).first()
    return None if not b.n else ((b.min_x + b.max_x) / 2, (b.min_y + b.max_y) / 2, b.min_z)


def binned(value: Column, size: float, origin: float = 0.0, epsilon: float = 1e-9) -> Column:
    """floor((value - origin) / size + epsilon)."""
    shifted = value - num(origin) if origin else value
    return F.floor(shifted / num(size) + num(epsilon)).cast("long")


def height_histogram(cloud: DataFrame, size: float, *, by: Sequence[str] = ()) -> DataFrame:
    """Sparse counts of every z, anchored at 0: (bin, n)."""
    return cloud.groupBy(*by, binned(F.col("z"), size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def gap_filled(histogram: DataFrame) -> DataFrame:
    """(bin, n) with every bin from the first to the last."""
    ends = histogram.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence("a", "b")).alias("bin"))
    return every.join(histogram, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
