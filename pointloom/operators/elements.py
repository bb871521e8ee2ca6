"""Element tables: walls, openings, storeys, slabs, stairs; hosting, clamping, merging, constraints."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.shipping import ship
from pointloom.operators.cloud import num

#: An overhang up to this much is clamped; beyond it, an opening is for review.
OVERHANG = 1e-6


def clamped(offset: Column, width: Column, length: Column) -> tuple[Column, Column, Column]:
    """(action, offset, excess) of an opening on its host: kept, clamped or review."""
    excess = F.greatest(-offset, offset + width - length, num(0))
    action = F.when(excess <= 0, "kept").when(excess <= num(OVERHANG), "clamped").otherwise("review")
    return action, F.when(action == "clamped", F.greatest(num(0), F.least(offset, length - width))).otherwise(offset), excess


def best_by(pairs: DataFrame, key: str, order: Sequence[str | Column], take: Sequence[str]) -> DataFrame:
    """For each key the row that is smallest by ``order``: an arg-min in one aggregation."""
    ranked = [c if isinstance(c, Column) else F.col(c) for c in order]
    best = F.min(F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(ranked)], *take)).alias("b")
    return pairs.groupBy(key).agg(best).select(key, *[F.col(f"b.{c}").alias(c) for c in take])


def rehosted(openings: DataFrame, walls: DataFrame, most: float) -> DataFrame:
    """The best host of each opening: in its storey and within ``most`` of its plane, by (distance, pairing, centring, id)."""
    pairs = openings.join(walls, "storey")
    distance = F.abs(F.col("centre") - F.col("axis"))
    inside = (F.col("along") - F.col("width") / 2 >= num(-OVERHANG)) & (F.col("along") + F.col("width") / 2 <= F.col("length") + num(OVERHANG))
    fits = pairs.withColumn("distance", distance).where((F.col("distance") <= num(most)) & inside)
    return best_by(fits, "opening", ["distance", ~F.col("paired"), F.abs(F.col("along") - F.col("length") / 2), "wall"], ["wall", "distance"])


def _accepted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []  # of one host
    for batch in batches:
        out = []
        for row in zip(*(batch.column(n).to_pylist() for n in ("host", "opening", "x0", "x1", "y0", "y1")), strict=True):
            host, opening, x0, x1, y0, y1 = row
            if kept and kept[0][0] != host:
                kept = []
            if all(min(x1, k[3]) - max(x0, k[2]) <= 0.6 * min(x1 - x0, k[3] - k[2]) or min(y1, k[5]) - max(y0, k[4]) <= 0.6 * min(y1 - y0, k[5] - k[4]) for k in kept):
                kept.append(row)
                out.append((host, opening))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["host", "opening"])


def accepted(boxes: DataFrame) -> DataFrame:
    """Greedy acceptance per host in order of (rank, id): a box is dropped that overlaps an accepted one by 60 % both ways.

    Boxes stream through Python in that order; only the accepted ones of one host are held.
    """
    ordered = boxes.repartition("host").sortWithinPartitions("host", F.asc_nulls_last("rank"), "opening")
    return ordered.select("host", "opening", "x0", "x1", "y0", "y1").mapInArrow(_accepted, "host long, opening long")


def _complete_links(pdf: pd.DataFrame) -> pd.DataFrame:
    groups: list[list] = []

    def same(a, b) -> bool:
        w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
        return w > 0 and h > 0 and w * h >= 0.5 * min((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))

    for row in pdf.sort_values("opening").itertuples(index=False):
        for g in groups:
            if all(same(row, k) for k in g):
                g.append(row)
                break
        else:
            groups.append([row])
    return pd.DataFrame([(r.host, r.opening, g[0].opening) for g in groups for r in g], columns=["host", "opening", "grp"])


def complete_links(boxes: DataFrame) -> DataFrame:
    """Groups of boxes per host, in order of id: a box joins the first group of which it duplicates every member."""
    return boxes.groupBy("host").applyInPandas(_complete_links, "host long, opening long, grp long")


def _paired(pdf: pd.DataFrame) -> pd.DataFrame:
    used, rows = set(), []
    for first, group in pdf.sort_values(["first", "along", "second"]).groupby("first", sort=True):
        free = group[~group["second"].isin(used)]
        if len(free):
            r = free.iloc[0]
            used.add(r["second"])
            rows.append((r["wall"], first, r["second"]))
    return pd.DataFrame(rows, columns=["wall", "first", "second"])


def paired_openings(candidates: DataFrame) -> DataFrame:
    """Openings of two walls matched in order of id, each to its nearest free counterpart (wall, first, second, along)."""
    return candidates.groupBy("wall").applyInPandas(_paired, "wall long, first long, second long")


def _nearest_free(pdf: pd.DataFrame, reach: float) -> list[tuple[int, int]]:
    """Each first opening, in order of id, with its nearest free second one: least (distance, id) within ``reach``.

    Second openings of one place queue by id. Places whose queue is empty are skipped for good, so a search looks at the nearest
    place on either side, and at further ones only while they are no farther in double precision.
    """
    own = pdf["side"].to_numpy() == 0
    ids, xs = pdf["id"].to_numpy(), pdf["x"].to_numpy()
    place, at = np.unique(xs[~own], return_inverse=True)
    queues: list[list[int]] = [[] for _ in place]
    for i, k in sorted(zip(ids[~own].tolist(), at.tolist(), strict=True), reverse=True):
        queues[k].append(i)
    place, size, used = place.tolist(), len(place), set()
    skip = {-1: list(range(-1, size)), 1: list(range(size + 1))}  # the next place that may have some: to the left (moved by one), to the right

    def live(k: int, step: int) -> int:
        """The first place from ``k`` on, in that direction, that has free openings."""
        to, shift = skip[step], int(step < 0)
        seen = []
        while 0 <= k < size:
            if to[k + shift] == k:
                while queues[k] and queues[k][-1] in used:
                    queues[k].pop()
                if queues[k]:
                    break
                to[k + shift] = k + step
            seen.append(k)
            k = to[k + shift]
        for s in seen:
            to[s + shift] = k
        return k

    rows, order = [], sorted(zip(ids[own].tolist(), xs[own].tolist(), strict=True))
    for first, group in groupby(order, key=lambda r: r[0]):
        best = None
        for x in dict.fromkeys(r[1] for r in group):
            start = bisect_left(place, x)
            for k, step in ((start - 1, -1), (start, 1)):
                k = live(k, step)
                while 0 <= k < size:
                    d = abs(x - place[k])
                    if d > reach or (best is not None and d > best[0]):
                        break
                    best = min(best or (d, queues[k][-1]), (d, queues[k][-1]))
                    k = live(k + step, step)
        if best is not None:
            used.add(best[1])
            rows.append((first, best[1]))
    return rows


def nearest_free(first: DataFrame, second: DataFrame, reach: float) -> DataFrame:
    """``paired_openings`` of the openings (wall, id, x) of two sides of a wall at most ``reach`` apart, without their pairs: (wall, first, second)."""
    rows = first.select("wall", "id", "x", F.lit(0).alias("side")).unionByName(second.select("wall", "id", "x", F.lit(1).alias("side")))
    finite = rows.where(F.col("wall").isNotNull() & F.col("id").isNotNull() & (F.abs("x") < num(math.inf)))

    def paired(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["wall"].iloc[0], *r) for r in _nearest_free(pdf, reach)], columns=["wall", "first", "second"])

    return finite.groupBy("wall").applyInPandas(paired, "wall long, first long, second long")


def transformed(rows: DataFrame, yaw: float, dx: float, dy: float, dz: float, planar: Sequence[tuple[str, str]], heights: Sequence[str]) -> DataFrame:
    """Rigid alignment that keeps the vertical: planar coordinate pairs are turned and moved, heights moved."""
    c, s = math.cos(math.radians(yaw)), math.sin(math.radians(yaw))
    new = {}
    for x, y in planar:
        new[x] = num(c) * F.col(x) - num(s) * F.col(y) + num(dx)
        new[y] = num(s) * F.col(x) + num(c) * F.col(y) + num(dy)
    return rows.withColumns({**new, **{z: F.col(z) + num(dz) for z in heights}})


def split_walls(walls: DataFrame, cuts: DataFrame, openings: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Walls (id, length) cut at cuts (id, at) into parts (id, part, lo, hi), and openings (opening, id, offset, width) on the part
    that holds them; a cut that leaves too short a part or goes through an opening is not made."""
    through = cuts.join(openings, "id").where((F.col("offset") < F.col("at")) & (F.col("offset") + F.col("width") > F.col("at"))).select("id", "at")
    fit = cuts.join(walls, "id").where((F.col("at") >= num(least)) & (F.col("length") - F.col("at") >= num(least))).select("id", "at").join(through, ["id", "at"], "left_anti").distinct()
    marks = walls.select("id", num(0).alias("at")).unionByName(fit)
    w = Window.partitionBy("id").orderBy("at")
    parts = marks.join(walls, "id").select("id", F.row_number().over(w).alias("part"), F.col("at").alias("lo"), F.coalesce(F.lead("at").over(w), F.col("length")).alias("hi"))
    moved = openings.join(parts, "id").where((F.col("offset") >= F.col("lo")) & (F.col("offset") + F.col("width") <= F.col("hi"))).select("opening", "id", "part", (F.col("offset") - F.col("lo")).alias("offset"))
    return parts, moved


def endpoint_status(ends: DataFrame, segments: DataFrame, snap: float, t_snap: float) -> DataFrame:
    """Class of each wall end (id, x, y) by the nearest point of another wall's segment in its storey: corner, junction, free."""
    pairs = ends.join(segments, "storey").where(F.col("wall") != F.col("other"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.greatest(num(0), F.least(num(1), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / (dx * dx + dy * dy)))
    px, py = F.col("x0") + t * dx - F.col("x"), F.col("y0") + t * dy - F.col("y")
    at_end = F.least(
        F.sqrt((F.col("x0") - F.col("x")) * (F.col("x0") - F.col("x")) + (F.col("y0") - F.col("y")) * (F.col("y0") - F.col("y"))),
        F.sqrt((F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")) + (F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y"))),
    )
    near = pairs.groupBy("wall", "side").agg(F.min(F.sqrt(px * px + py * py)).alias("d"), F.min(at_end).alias("e"))
    out = ends.select("wall", "side").join(near, ["wall", "side"], "left")
    return out.select("wall", "side", F.when(F.col("e") <= num(snap), "corner").when(F.col("d") <= num(t_snap), "junction").otherwise("free").alias("status"))


def validated_cuts(openings: DataFrame, sources: DataFrame) -> DataFrame:
    """Slab openings (id, source_ids) that may be cut: there is a source, all of them exist and all are confirmed."""
    each = openings.select("id", F.explode_outer("source_ids").alias("source"))
    ok = F.coalesce(F.bool_and(F.coalesce("confirmed", F.lit(False))), F.lit(False))
    return each.join(sources, "source", "left").groupBy("id").agg(ok.alias("valid"))


def live(elements: DataFrame, rejected: DataFrame, key: str, host: str | None = None) -> DataFrame:
    """Elements that are not rejected, and whose host is not either."""
    out = elements.join(rejected.select(F.col("id").alias(key)), key, "left_anti")
    return out.join(rejected.select(F.col("id").alias(host)), host, "left_anti") if host else out


def merged_fragments(walls: DataFrame, group: str) -> DataFrame:
    """Length-weighted merge of each group's fragments: mean axis and thickness, pooled residual, summed evidence."""
    w = F.col("length_mm")
    return walls.groupBy(group).agg(F.sum(w).alias("length_mm"), (F.sum(w * F.col("axis_mm")) / F.sum(w)).alias("axis"), (F.sum(w * F.col("thickness_mm")) / F.sum(w)).alias("thickness"), F.sum("evidence").alias("evidence"), F.max_by("id", F.struct(w, -F.col("id"))).alias("reference"))


def remapped(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Rows with ids replaced where the mapping (old, new) names them."""
    return rows.join(mapping.withColumnRenamed("old", key), key, "left").withColumn(key, F.coalesce("new", key)).drop("new")


def deduplicated(targets: DataFrame, extra: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(extra_id, target_id): elements to merge into the first target of their kind within ``tolerance``; null keeps them."""
    key = F.floor(F.col("x") / num(cell)).cast("long")
    e = extra.select(F.col("id").alias("extra_id"), F.col("kind"), F.col("x").alias("ex"), F.explode(F.sequence(key - 1, key + 1)).alias("cell"))
    t = targets.select(F.col("id").alias("target_id"), "kind", F.col("x").alias("tx"), key.alias("cell"))
    found = e.join(t, ["kind", "cell"]).where(F.abs(F.col("ex") - F.col("tx")) <= num(tolerance)).groupBy("extra_id").agg(F.min("target_id").alias("target_id"))
    return extra.select(F.col("id").alias("extra_id")).join(found, "extra_id", "left")


def violations(storeys: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """(rule, id) for broken constraints: repeated ids, missing hosts, sizes that are not positive, openings beyond their wall."""
    parts = []
    for name, df in (("storey", storeys), ("wall", walls), ("opening", openings)):
        parts.append(df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"{name}_id_repeated").alias("rule"), "id"))
    parts.append(walls.join(storeys.select(F.col("id").alias("storey")), "storey", "left_anti").select(F.lit("wall_storey_missing").alias("rule"), "id"))
    parts.append(openings.join(walls.select(F.col("id").alias("wall")), "wall", "left_anti").select(F.lit("opening_wall_missing").alias("rule"), "id"))
    parts.append(walls.where(~F.coalesce((F.col("length") > 0) & (F.col("thickness") > 0), F.lit(False))).select(F.lit("wall_size").alias("rule"), "id"))
    hosted = openings.join(walls.select(F.col("id").alias("wall"), "length"), "wall")
    parts.append(hosted.where((F.col("offset") < 0) | (F.col("offset") + F.col("width") > F.col("length"))).select(F.lit("opening_outside").alias("rule"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_below(left: DataFrame, right: DataFrame, value: str, level: str, slack: float, take: str) -> DataFrame:
    """As-of join: for each left row the highest level at or below ``value`` + slack, in one pass over the union of both."""
    marks = right.select("grp", F.col(level).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(level).alias("level"), F.col(take).alias("take")).alias("_m"), F.lit(None).cast("long").alias("id"))
    asks = left.select("grp", (F.col(value) + num(slack)).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_m"].dataType).alias("_m"), F.col("id"))
    w = Window.partitionBy("grp").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("_f", F.last("_m", ignorenulls=True).over(w)).where("_side = 1").select("id", F.col("_f.take").alias(take), F.col("_f.level").alias(level))


def signature(elements: DataFrame, *columns: str) -> DataFrame:
    """Order-free SHA-256 of geometry quantised to a millionth; ids do not enter."""
    quantised = F.concat_ws(",", *[F.round(F.col(c) * num(1e6)).cast("long").cast("string") for c in columns])
    # Digests of rows are sorted within 4096 buckets first, so no task holds all rows.
    row = elements.select(F.sha2(quantised, 256).alias("h")).withColumn("b", F.substring("h", 1, 3))
    part = row.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("p"))
    return part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "p"))), lambda x: x["p"]), ""), 256).alias("signature"))


def geometry_change(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest change per kind over elements paired by ordinal; an unpaired element gives null."""
    j = before.select("kind", "ordinal", *[F.col(c).alias(f"b_{c}") for c in columns]).join(after.select("kind", "ordinal", *[F.col(c).alias(f"a_{c}") for c in columns]), ["kind", "ordinal"], "full_outer")
    change = F.array_max(F.array(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns]))
    whole = F.bool_and(F.col(f"a_{columns[0]}").isNotNull() & F.col(f"b_{columns[0]}").isNotNull())
    return j.groupBy("kind").agg(F.when(whole, F.max(change)).alias("change"))


def stage_rollup(events: DataFrame) -> DataFrame:
    """Telemetry per stage: records, visits, passes, peak and elapsed."""
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("user").alias("unique_users"), F.sum("visits").alias("visits"), F.max("peak").alias("peak"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("elapsed_us"))


ship(__name__)
