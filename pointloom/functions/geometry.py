"""Bounded NumPy kernels for one group at a time: peaks, hulls, outlines, lines, regions, sequences."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np

from pointloom.functions.shipping import ship


def peaks(values: np.ndarray, height: float, prominence: float, distance: int, ends: bool = False) -> list[int]:
    """Local maxima at least ``height`` high, ``distance`` apart (higher ones first) and ``prominence`` above their saddle.

    A plateau counts at its middle. With ``ends``, the first and last place count if not below their neighbour.
    """
    v, found, i = np.asarray(values, float), [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i] and v[i] >= height:
            found.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-v[p], p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def rises(p: int) -> float:
        left = v[: p + 1][::-1]
        right = v[p:]
        base = []
        for side in (left, right):
            higher = np.flatnonzero(side > v[p])
            base.append(side[: higher[0]].min() if len(higher) else side.min())
        return v[p] - max(base)

    out = {p for p in kept if rises(p) >= prominence}
    if ends and len(v):
        out |= {p for p, q in ((0, 1), (len(v) - 1, len(v) - 2)) if v[p] >= height and (len(v) == 1 or v[p] >= v[q])}
    return sorted(out)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counterclockwise."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def area(polygon: np.ndarray) -> float:
    """Signed area by the shoelace formula."""
    if len(polygon) < 3:
        return 0.0
    x, y = np.asarray(polygon, float).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clipped(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Intersection of a polygon with a convex, counterclockwise window."""
    out = [tuple(p) for p in np.asarray(subject, float)]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
        new = []
        for k, p in enumerate(out):
            q, sp, sq = out[k - 1], side[k], side[k - 1]
            if (sp >= 0) != (sq >= 0):
                t = sq / (sq - sp)
                new.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if sp >= 0:
                new.append(p)
        out = new
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def outlines(cells: set[tuple[int, int]]) -> list[np.ndarray]:
    """Closed outlines of a set of unit cells, one for each border, vertices at corners only."""
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in cells:
        for inside, a, b in (((x, y - 1), (x, y), (x + 1, y)), ((x + 1, y), (x + 1, y), (x + 1, y + 1)), ((x, y + 1), (x + 1, y + 1), (x, y + 1)), ((x - 1, y), (x, y + 1), (x, y))):
            if inside not in cells:
                edges.setdefault(a, []).append(b)
    loops = []
    while edges:
        start = min(edges)
        loop, at, before = [start], start, None
        while True:
            options = edges[at]
            # At a corner where two borders touch, turn so that the loops stay apart.
            pick = 0 if before is None or len(options) == 1 else max(range(len(options)), key=lambda k: (at[0] - before[0]) * (options[k][1] - at[1]) - (at[1] - before[1]) * (options[k][0] - at[0]))
            nxt = options.pop(pick)
            if not options:
                del edges[at]
            before, at = at, nxt
            if at == start:
                break
            loop.append(at)
        p = np.array(loop)
        turn = np.any(np.roll(p, -1, axis=0) - p != p - np.roll(p, 1, axis=0), axis=1)
        loops.append(p[turn])
    return loops


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker on an open line."""
    line = np.asarray(line, float)
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        length = math.hypot(*d)
        r = line[a + 1 : b] - line[a]
        off = np.abs(d[0] * r[:, 1] - d[1] * r[:, 0]) / length if length else np.hypot(*r.T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[sorted(keep)]


def segments_of(cells: set[tuple[int, int]], cell: float, tolerance: float, least: float) -> list[tuple[float, float, float, float]]:
    """Straight parts of a mask's outlines, in metres."""
    out = []
    for loop in outlines(cells):
        far = int(np.argmax(((loop - loop[0]) ** 2).sum(axis=1)))
        closed = np.concatenate([loop, loop[:1]]) * cell
        for part in (closed[: far + 1], closed[far:]):
            if len(part) > 1:
                s = simplified(part, tolerance)
                out += [(*a, *b) for a, b in zip(s, s[1:], strict=False) if math.dist(a, b) >= least]
    return sorted(tuple(map(float, s)) for s in out)


def fitted_line(points: np.ndarray, trim: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(centre, direction, rmse) of a line through points, once more without those further off than ``trim``."""
    p = np.asarray(points, float)
    for _ in range(2):
        if len(p) < 3:
            return None
        centre = p.mean(axis=0)
        _, _, axes = np.linalg.svd(p - centre, full_matrices=False)
        off = np.abs((p - centre) @ axes[1])
        p = p[off <= trim]
    d = axes[0] * (1 if (axes[0][0], axes[0][1]) > (0, 0) else -1)
    return centre, d, float(np.sqrt((off**2).mean()))


def best_chain(zones: list[tuple[float, float, float]], clear: float, spacing: float, usual: float = 3.2, price: float = 0.15) -> list[int]:
    """Best sequence of slab zones (bottom, top, score), lowest first.

    Zones are the nodes of an acyclic graph: an arc leads from a zone to one whose bottom is at least ``clear`` above
    its top and whose top is at most ``spacing`` above. An arc earns its end's score less ``price`` for each metre off the ``usual``
    spacing. Values rise to the fixed point of ``value[j] = max(score[j], max_i(value[i] + arc[i, j]))``; the chain is read
    back from the best end that has a predecessor, or is the best single zone where no arc exists.
    """
    if not zones:
        return []
    bottom, top, score = np.array(zones, float).T
    step = top[None, :] - top[:, None]
    allowed = (bottom[None, :] - top[:, None] >= clear) & (step <= spacing)
    arc = np.where(allowed, score[None, :] - price * np.abs(step - usual), -np.inf)
    value = score.copy()
    while True:
        via = (value[:, None] + arc).max(axis=0)
        better = np.maximum(score, via)
        if np.array_equal(better, value):
            break
        value = better
    end = int(np.argmax(via)) if np.isfinite(via).any() else int(np.argmax(score))
    chain = [end]
    joined = np.isfinite(via[end])
    while joined:
        end = int(np.argmax(value + arc[:, end]))
        chain.append(end)
        joined = via[end] > score[end]
    return chain[::-1]


@dataclass(frozen=True)
class TreadRules:
    """What makes patches a flight (metres; axes by the sine of their angle): fixed values."""

    rise: tuple[float, float] = (0.10, 0.24)
    going: tuple[float, float] = (0.18, 0.45)
    off_height: float = 0.025
    off_along: float = 0.045
    off_across: float = 0.10
    axis: float = 0.2
    width: float = 0.25
    most_missing_in_a_row: int = 2
    least: int = 4
    missing: float = 0.4


def _lattices(t: np.ndarray, rules: TreadRules) -> np.ndarray:
    """Hypotheses (x, y, z of step 0, dx, dy, dz a step, axis-free width) from every two patches that may lie one to three steps apart."""
    out = []
    for apart in range(1, rules.most_missing_in_a_row + 2):
        step = (t[None, :, :3] - t[:, None, :3]) / apart
        run = np.hypot(step[..., 0], step[..., 1])
        safe = np.where(run > 0, run, 1)
        turned = np.abs((step[..., 0] * t[:, None, 3] + step[..., 1] * t[:, None, 4]) / safe), np.abs((step[..., 0] * t[None, :, 3] + step[..., 1] * t[None, :, 4]) / safe)
        ok = (run >= rules.going[0]) & (run <= rules.going[1]) & (step[..., 2] >= rules.rise[0]) & (step[..., 2] <= rules.rise[1])
        ok &= (turned[0] <= rules.axis) & (turned[1] <= rules.axis)
        i, j = np.nonzero(ok)
        out.append(np.column_stack([t[i, :3], step[i, j], t[i, 5]]))
    return np.concatenate(out)


def _on(t: np.ndarray, lattice: np.ndarray, rules: TreadRules) -> list[tuple[int, int]]:
    """(step, patch) of the unbroken run of steps of a lattice that patches fill: the nearest patch of each step."""
    run = math.hypot(lattice[3], lattice[4])
    d = lattice[3:5] / run
    rel = t[:, :3] - lattice[:3]
    step = np.rint(rel[:, 2] / lattice[5])
    miss = np.stack([rel[:, 2] - step * lattice[5], rel[:, :2] @ d - step * run, rel[:, :2] @ np.array([-d[1], d[0]])])
    bound = np.array([rules.off_height, rules.off_along, rules.off_across])[:, None]
    fits = (np.abs(miss) <= bound).all(axis=0) & (step >= 0) & (np.abs(t[:, 3:5] @ d) <= rules.axis) & (np.abs(t[:, 5] - lattice[6]) <= rules.width)
    rows = np.flatnonzero(fits)
    rows = rows[np.lexsort((rows, np.abs(miss[:, rows]).sum(axis=0), step[rows]))]
    places, first = np.unique(step[rows].astype(int), return_index=True)
    gaps = np.flatnonzero(np.diff(places) > rules.most_missing_in_a_row + 1)
    stop = gaps[0] + 1 if len(gaps) else len(places)
    return list(zip(places[:stop].tolist(), rows[first[:stop]].tolist(), strict=True))


def tread_sequences(treads: np.ndarray, rules: TreadRules = TreadRules()) -> list[dict]:
    """Regular flights among tread patches (x, y, z, axis x, axis y, width), by consensus: lattices proposed by pairs are held
    against all free patches; the one that most patches fill, without too many holes, is fitted to them and taken out, until none is left.

    The axis of a tread lies across the flight; its width is that of the others. End steps are never extrapolated.
    """
    t = np.asarray(treads, float).reshape(-1, 6)
    free, found = np.arange(len(t)), []
    proposed = _lattices(t, rules) if len(t) else np.zeros((0, 7))
    while len(free) >= rules.least and len(proposed):
        best, alive = None, []
        for k, lattice in enumerate(proposed):
            run = _on(t[free], lattice, rules)
            if len(run) < rules.least or run[0][0] != 0:
                continue
            alive.append(k)
            steps, members = [s for s, _ in run], [int(free[m]) for _, m in run]
            holes = steps[-1] + 1 - len(steps)
            if holes <= rules.missing * (steps[-1] + 1):
                rank = (-len(members), holes, members)
                if best is None or rank < best[0]:
                    best = rank, steps, members
        if best is None:
            break
        (_, holes, members), steps, _ = best
        n, k = len(steps), np.array(steps, float)
        along = ((k - k.mean())[:, None] * (t[members, :3] - t[members, :3].mean(axis=0))).sum(axis=0) / ((k - k.mean()) ** 2).sum()
        start = t[members, :3].mean(axis=0) - along * k.mean()
        found.append({"members": members, "steps": steps[-1] + 1, "missing": holes, "rise": float(along[2]), "going": math.hypot(along[0], along[1]), "start": start.tolist(), "observed": n})
        free = np.setdiff1d(free, members)
        proposed = proposed[alive]  # a lattice that fails with more patches fails with fewer
    return sorted(found, key=lambda f: (f["start"][2], f["start"][0], f["start"][1]))


def paired_walls(faces: np.ndarray, centre: tuple[float, float], border: np.ndarray, thickness: tuple[float, float], least: float, assumed: float, exterior: float, near: float, angle: float = 5.0) -> list[dict]:
    """Walls of one storey from observed faces (x0, y0, x1, y1): (start, end, thickness, label, faces).

    Parallel faces within the bounds of thickness that run side by side for ``least`` are the two sides of one wall, along
    what they have in common; closest pairs go first. What a face has left over beyond its pairs, if long enough, is a face of its own.
    A face without a partner is an exterior wall where it lies on the border of the footprint (its body outside), else a
    wall of assumed thickness on the face itself.
    """
    f = np.asarray(faces, float).reshape(-1, 4)
    d = f[:, 2:] - f[:, :2]
    length = np.hypot(*d.T)
    d = d / length[:, None]
    cosine = math.cos(math.radians(angle))
    options = []
    for i in range(len(f)):
        n = np.array([-d[i, 1], d[i, 0]])
        for j in range(i + 1, len(f)):
            if abs(d[i] @ d[j]) < cosine:
                continue
            offset = float(((f[j, :2] + f[j, 2:]) / 2 - f[i, :2]) @ n)
            ends = sorted(((f[j, :2] - f[i, :2]) @ d[i], (f[j, 2:] - f[i, :2]) @ d[i]))
            if thickness[0] <= abs(offset) <= thickness[1] and min(length[i], ends[1]) - max(0.0, ends[0]) >= least:
                options.append((round(abs(offset), 6), i, j, offset))
    rest = {i: [(0.0, float(length[i]))] for i in range(len(f))}  # stretches of each face that no wall has yet
    out = []
    for gap, i, j, offset in sorted(options):
        flip = float(d[i] @ d[j])
        shift = float((f[j, :2] - f[i, :2]) @ d[i])
        for a, b in list(rest[i]):
            for p, q in list(rest[j]):
                lo, hi = sorted((shift + flip * p, shift + flip * q))
                lo, hi = max(a, lo), min(b, hi)
                if hi - lo < least or (a, b) not in rest[i]:
                    continue
                n = np.array([-d[i, 1], d[i, 0]])
                start, end = (f[i, :2] + v * d[i] + offset / 2 * n for v in (lo, hi))
                out.append({"start": start, "end": end, "thickness": gap, "label": "paired_faces", "faces": [i, j]})
                rest[i].remove((a, b))
                rest[i] += [s for s in ((a, lo), (hi, b)) if s[1] - s[0] >= least]
                u, v = sorted(((lo - shift) / flip, (hi - shift) / flip))
                rest[j].remove((p, q))
                rest[j] += [s for s in ((p, u), (v, q)) if s[1] - s[0] >= least]
    edges = np.concatenate([border, np.roll(border, -1, axis=0)], axis=1)
    for i, stretches in rest.items():
        for a, b in stretches:
            start, end = f[i, :2] + a * d[i], f[i, :2] + b * d[i]
            middle, n = (start + end) / 2, np.array([-d[i, 1], d[i, 0]])
            t = np.clip(((middle - edges[:, :2]) * (edges[:, 2:] - edges[:, :2])).sum(axis=1) / ((edges[:, 2:] - edges[:, :2]) ** 2).sum(axis=1), 0, 1)
            away = np.hypot(*(edges[:, :2] + t[:, None] * (edges[:, 2:] - edges[:, :2]) - middle).T).min()
            if away <= near:
                n = -n if n @ (np.asarray(centre) - middle) > 0 else n
                start, end = start + n * exterior / 2, end + n * exterior / 2
                out.append({"start": start, "end": end, "thickness": exterior, "label": "exterior_candidate", "faces": [i]})
            else:
                out.append({"start": start, "end": end, "thickness": assumed, "label": "single_face_candidate", "faces": [i]})
    return sorted(out, key=lambda w: tuple(np.round((w["start"] + w["end"]) / 2, 6)))


def normals(covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals (largest component positive) and curvature of 3 x 3 covariances; degenerate ones give NaN."""
    values, vectors = np.linalg.eigh(covariances)
    n = vectors[:, :, 0]
    sign = np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], 1)
    n = n * np.where(sign < 0, -1, 1)
    total = values.sum(axis=1)
    flat = values[:, 1] <= 1e-12 * np.maximum(total, 1e-300)
    curvature = np.where(total > 0, values[:, 0] / np.where(total > 0, total, 1), np.nan)
    return np.where(flat[:, None], np.nan, n), np.where(flat, np.nan, np.maximum(curvature, 0))


def neighbour_covariances(points: np.ndarray, core: np.ndarray, radius: float, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of points within ``radius``, covariance of them) of each ``core`` point; ``points`` hold all that is within reach.

    Points of one cell meet the cells around together: cells wholly within reach of it give their sums at once, those
    on the border are tested point by point, and sums of those that pass are one product of matrices.
    """
    near2, low = radius * radius, points.min(axis=0)
    span = np.maximum(points.max(axis=0) - low, radius)
    k = int(np.clip(round((len(points) / np.prod(span) * radius**3 / 24) ** (1 / 3)), 1, 8))
    h, reach = radius / k, k + 1
    at = np.floor((points - low) / h).astype(np.int64) + reach
    nx, ny, nz = at.max(axis=0) + reach + 1
    flat = (at[:, 2] * ny + at[:, 1]) * nx + at[:, 0]
    order = np.argsort(flat, kind="stable")
    p, own, flat = points[order], core[order], flat[order]
    first = np.zeros(nx * ny * nz + 1, np.int64)
    np.cumsum(np.bincount(flat, minlength=nx * ny * nz), out=first[1:])
    # Rows of cells (along x) around a cell: how far they may reach, and how far they are wholly within reach (-1: nowhere).
    steps = np.arange(-reach, reach + 1)
    gap, far = (np.maximum(np.abs(steps) - 1, 0) * h) ** 2, ((np.abs(steps) + 1) * h) ** 2
    oy, oz = (a.ravel() for a in np.meshgrid(steps, steps))
    half = np.arange(reach + 1)
    out_to = (gap[oy + reach][:, None] + gap[oz + reach][:, None] + gap[half + reach][None] <= near2 * (1 + 1e-6)).sum(axis=1) - 1
    in_to = (far[oy + reach][:, None] + far[oz + reach][:, None] + far[half + reach][None] <= near2 * (1 - 1e-6)).sum(axis=1) - 1
    used = out_to >= 0
    row, out_to, in_to = (oz * ny + oy)[used] * nx, out_to[used], in_to[used]
    inner = in_to >= 0
    irow, ito = row[inner], in_to[inner]
    lo_off, hi_off = np.concatenate([row - out_to, irow + ito + 1]), np.concatenate([np.where(inner, row - in_to, row + out_to + 1), irow + out_to[inner] + 1])

    def places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = b - a
        ends = np.cumsum(n)
        return np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)

    def sums(d: np.ndarray) -> np.ndarray:
        x, y, z = d.T
        return np.stack([np.ones(len(d)), x, y, z, x * x, x * y, x * z, y * y, y * z, z * z], axis=1)

    room = np.empty((2, 64 * block))

    def within(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which of the points ``d`` (a row for each axis) are within reach of each of ``q``, as 0 and 1."""
        shape = (len(q), d.shape[1])
        d2, t = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
        np.subtract(d[0], q[:, :1], out=d2)
        np.multiply(d2, d2, out=d2)
        for axis in (1, 2):
            np.subtract(d[axis], q[:, axis : axis + 1], out=t)
            np.multiply(t, t, out=t)
            np.add(d2, t, out=d2)
        return np.less_equal(d2, near2, out=t, casting="unsafe")

    mine = np.flatnonzero(own)
    found, axes, weights = np.zeros((len(p), 10)), np.ascontiguousarray(p.T), sums(p - (low + span / 2))
    for cell in np.unique(flat[mine]):
        a, b = first[cell], first[cell + 1]
        who = a + np.flatnonzero(own[a:b])
        inside = places(first[cell + irow - ito], first[cell + irow + ito + 1])
        test = places(first[cell + lo_off], first[cell + hi_off])
        w, turned, sure = weights[test], axes[:, test], weights[inside].sum(axis=0)
        for part in np.array_split(who, -(-len(who) // 64)):
            total = np.repeat(sure[None], len(part), axis=0)
            for i in range(0, len(test), block):
                total += within(p[part], turned[:, i : i + block]) @ w[i : i + block]
            # Where neighbours lie close together, sums about the point itself keep their digits.
            m = total[:, 1:] / np.maximum(total[:, :1], 1)
            small = (m[:, 3] + m[:, 6] + m[:, 8] - (m[:, :3] ** 2).sum(axis=1)) < 1e-2 * near2
            for i in np.flatnonzero(small):
                total[i] = 0
                for j in np.split(every := np.concatenate([inside, test]), range(block, len(every), block)):
                    total[i] += sums(p[j[within(p[part[i]][None], axes[:, j])[0] > 0]] - p[part[i]]).sum(axis=0)
            found[part] = total
    n = found[mine, 0]
    m = found[mine, 1:] / np.maximum(n, 1)[:, None]
    c = m[:, 3:] - np.stack([m[:, i] * m[:, j] for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))], axis=1)
    return order[mine], n.astype(np.int64), c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)


def regions(points: np.ndarray, normal: np.ndarray, curvature: np.ndarray, radius: float, angle: float, plane: float, least: int) -> np.ndarray:
    """Region of each point (-1: none), numbered in order of growth. Seeds go by rounded curvature, then row; a region takes
    neighbours whose normal and distance agree with its plane, which is fitted again at 12 points and then every 64."""
    cells: dict[tuple[int, int, int], list[int]] = {}
    keys = np.floor(points / radius).astype(int)
    for i, k in enumerate(map(tuple, keys)):
        cells.setdefault(k, []).append(i)
    label, number = np.full(len(points), -1), 0
    limit = math.cos(math.radians(angle))
    usable = ~np.isnan(curvature)
    for seed in np.lexsort((np.arange(len(points)), np.round(np.where(usable, curvature, np.inf), 6))):
        if label[seed] >= 0 or not usable[seed]:
            continue
        members, todo, seen = [seed], deque([seed]), {seed}
        n, c = normal[seed], points[seed]
        while todo:
            k = keys[todo[0]]
            at = points[todo.popleft()]
            near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for j in cells.get((k[0] + dx, k[1] + dy, k[2] + dz), ())]
            near = [j for j in near if j not in seen and label[j] < 0 and usable[j]]
            if not near:
                continue
            near = np.array(sorted(near))
            ok = (((points[near] - at) ** 2).sum(axis=1) <= radius * radius) & (np.abs(normal[near] @ n) >= limit) & (np.abs((points[near] - c) @ n) <= plane)
            for j in near[ok].tolist():
                seen.add(j)
                members.append(j)
                todo.append(j)
                if len(members) == 12 or len(members) % 64 == 0:
                    c = points[members].mean(axis=0)
                    n = np.linalg.eigh(np.cov((points[members] - c).T))[1][:, 0]
        if len(members) >= least:
            label[members] = number
            number += 1
    return label


ship(__name__)
