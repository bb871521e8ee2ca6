"""Queries on small tables that show what the findings of the second round were about."""

import random
from collections import Counter, deque

import duckdb
import pytest
from helpers import duck_rows, spark_rows

from pointloom.operators import cluster, elements, evidence, graph, grid, ordered, quality, raster, relations, structure
from pointloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture
def same(spark, tmp_path):
    """Write tables given as SQL, and hold a query on them against its own SQL."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        rows = spark_rows(QUERIES[name](spark, str(tmp_path)))
        assert rows == duck_rows(con, ORACLES[name])
        return rows[1]

    return check


@pytest.mark.parametrize("name", ["crop_polygon", "crop_voxel_levels"])
def test_points_on_a_side_of_the_polygon(name, same):
    # (4, 0.75) lies on the side from (0.5, 0.5) to (7.5, 1), (0.5, 0.5) is a corner.
    same(name, orders="SELECT * FROM (VALUES (1::BIGINT, 175::BIGINT, 200000e0), (17, 50, 25000e0), (18, 100, 150000e0)) t(o_orderkey, o_custkey, o_totalprice)")


def brute_dbscan(points, radius, least):
    near = {a: [b for b, (x, y) in points.items() if (points[a][0] - x) ** 2 + (points[a][1] - y) ** 2 <= radius * radius] for a in points}
    core, label = {a for a in points if len(near[a]) >= least}, {}
    for a in sorted(core):
        todo = [] if a in label else [a]
        while todo:
            b = todo.pop()
            if b not in label:
                label[b] = a
                todo += [k for k in near[b] if k in core]
    found = {a: (label[a], True) if a in core else (min((label[b] for b in near[a] if b in core), default=None), False) for a in points}
    size = Counter(c for c, _ in found.values())
    return sorted((a, c, k) for a, (c, k) in found.items() if c is not None and size[c] >= least)


def test_dbscan_keeps_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    points = {k: (rng.randrange(60) / 20, rng.randrange(60) / 20) for k in range(500)} | {1000 + k: (1.0, 4.0 + k % 3 / 50) for k in range(300)}
    written, keep = [], cluster.kept

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(cluster, "kept", counted)
    for radius, least in ((0.1, 4), (0.17, 9)):
        df = spark.createDataFrame([(k, *p) for k, p in points.items()], "rid long, x double, y double")
        assert sorted(map(tuple, cluster.dbscan(df, radius, least).select("rid", "cluster", "core").collect())) == brute_dbscan(points, radius, least)
    assert max(written) <= 20 * len(points)


CROWD = "SELECT (120 * i + k)::BIGINT AS c_custkey, (k % 2)::INTEGER AS c_nationkey FROM range(6) a(i), range(80) b(k)"


@pytest.mark.parametrize("name", ["wall_pairs", "merged_walls", "wall_corners", "snapped_topology"])
def test_walls_of_one_place(name, same):
    same(name, customer=CROWD)


def test_walls_of_one_place_meet_once(spark, monkeypatch, tmp_path):
    written, keep = [], relations.kept

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    duckdb.connect().execute(f"COPY ({CROWD}) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    monkeypatch.setattr(relations, "kept", counted)
    monkeypatch.setattr(graph, "kept", counted)
    QUERIES["merged_walls"](spark, str(tmp_path)).collect()
    assert written and max(written) <= 240
    del written[:]
    QUERIES["snapped_topology"](spark, str(tmp_path)).collect()
    assert written and max(written) <= 600


FACES = ["face_selection", "face_index_equivalence", "scan_evidence_counts", "face_evidence", "face_refit", "height_support", "slice_occupancy", "raster_stats", "wall_image", "dominant_offset", "near_segments"]


@pytest.mark.parametrize("name", FACES)
def test_faces_of_one_place(name, same):
    suppliers = "SELECT (400 * i + k)::BIGINT AS s_suppkey FROM range(3) a(i), range(8) b(k)"
    same(name, supplier=suppliers, orders="SELECT k::BIGINT AS o_orderkey, (k * 7 % 1500)::BIGINT AS o_custkey, (k * 7919 % 500000)::DOUBLE AS o_totalprice FROM range(400) t(k)")


def test_faces_of_one_place_meet_points_once(spark, sf):
    wide = spark.range(900).selectExpr("400 * (id % 300) AS face", "0D AS x0", "0D AS y0", "1D AS x1", "0D AS y1", "0D AS z0", "1D AS z1")
    shapes, members = grid.face_shapes(grid.with_frame(wide))
    assert shapes.count() == 1 and members.count() == 900


def test_refit_of_many_points(spark):
    near = spark.range(400_000).selectExpr("1L AS face", "100D + (id % 100) / 100D AS along", "0.01D * (id % 100) / 100D AS resid")
    assert evidence.refit(near, 0.02).first().slope_micro == 10_000


@pytest.mark.parametrize("name", ["knn", "radius_neighbours", "point_normals"])
def test_clouds_are_not_broadcast(name, spark, sf):
    assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_one_place(same, spark, tmp_path):
    same("candidate_pairs", part="SELECT (4000 * i + k)::BIGINT AS p_partkey, (k % 20)::INTEGER AS p_size FROM range(5) a(i), range(60) b(k)")
    assert "HashAggregate" in QUERIES["candidate_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def most_and_cheapest(supply, demand, edges):
    units, best = [i for i, n in enumerate(supply) for _ in range(n)], []

    def go(k, left, n, cost):
        if k == len(units):
            best.append((-n, cost))
            return
        go(k + 1, left, n, cost)
        for j, c in edges[units[k]].items():
            if left[j]:
                go(k + 1, [x - (y == j) for y, x in enumerate(left)], n + 1, cost + c)

    go(0, demand, 0, 0)
    return min(best)


def test_transport_against_all_choices():
    rng = random.Random(7)
    for _ in range(300):
        supply, demand = ([rng.randrange(1, 3) for _ in range(rng.randrange(1, 4))] for _ in "ab")
        edges = [{j: rng.randrange(6) for j in range(len(demand)) if rng.random() < 0.6} for _ in supply]
        flow = quality.transport(supply, demand, edges)
        sent, got = Counter(), Counter()
        for (i, j), n in flow.items():
            sent[i], got[j] = sent[i] + n, got[j] + n
        assert all(n <= supply[i] for i, n in sent.items()) and all(n <= demand[j] for j, n in got.items())
        assert (-sum(flow.values()), sum(n * edges[i][j] for (i, j), n in flow.items())) == most_and_cheapest(supply, demand, edges)


def test_many_instances_of_one_class(spark, tmp_path):
    duckdb.connect().execute(f"COPY (SELECT k::BIGINT AS p_partkey, 1::INTEGER AS p_size FROM range(9000) t(k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    rows = QUERIES["instance_match"](spark, str(tmp_path)).collect()
    found = sum(k % 7 != 0 for k in range(9000))  # each prediction has its own truth, so all can be matched
    assert len(rows) == len({r.truth_id for r in rows}) == len({r.pred_id for r in rows}) == found and min(r.iou for r in rows) >= 0.25
    assert [tuple(r) for r in QUERIES["instance_counts"](spark, str(tmp_path)).collect()] == [(1, 9000, found, found)]


def test_boxes_of_one_place_are_matched_one_to_one(spark):
    t = spark.createDataFrame([(k, 1, 0.0, 0.0, 2.0, 2.0) for k in range(5)] + [(9, 1, 1.0, 0.0, 3.0, 2.0)], "id long, cls int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(20 + k, 1, 0.0, 0.0, 2.0, 2.0) for k in range(3)] + [(30 + k, 1, 1.0, 0.0, 3.0, 2.0) for k in range(2)], t.schema)
    got = sorted((r.truth_id, r.pred_id, round(r.iou, 3)) for r in quality.matched_boxes(t, p, 4.0, 0.25).collect())
    assert got == [(0, 20, 1.0), (1, 21, 1.0), (2, 22, 1.0), (3, 30, 0.333), (9, 31, 1.0)]
    assert sum(r.iou for r in quality.matched_instances(quality.box_overlaps(t, p, 4.0, 0.25)).collect()) == pytest.approx(4 + 1 / 3)


@pytest.mark.parametrize("seed", range(2))
def test_openings_on_words_of_cells(spark, seed):
    rng = random.Random(seed)
    holes = [(g, rng.randrange(40), rng.randrange(80), rng.randrange(3, 12), rng.randrange(3, 45)) for g in (16, 17, 35) for _ in range(4)]
    cells = [(g, x, y) for g in (16, 17, 35) for x in range(-1, 45) for y in range(-1, 100) if rng.random() < 0.97 and not any(g == h and a <= x < a + w and b <= y < b + t for h, a, b, w, t in holes)]
    mask = spark.createDataFrame([*cells, *cells[:50]], "grp long, ix long, iy long")
    frames = spark.createDataFrame([(g, 0, 43, 0, 98 - g) for g in (16, 17, 35)], "grp long, x0 long, x1 long, y0 long, y1 long")
    words = raster.words(mask)
    runs = raster.empty_runs(words, frames).selectExpr("grp", "ix", "explode(sequence(start, end)) AS iy")
    assert spark_rows(runs) == spark_rows(raster.complement(raster.dilated(mask), frames))
    assert raster.empty_runs(words, frames).count() == ordered.runs(runs, ["grp", "ix"], "iy").count()
    strips = spark.createDataFrame([(k, rng.choice((16, 17, 35)), x := rng.randrange(-2, 40), x + rng.randrange(6), y := rng.randrange(-3, 90), y + rng.randrange(70)) for k in range(60)], "id long, grp long, x0 long, x1 long, y0 long, y1 long")
    assert spark_rows(raster.words_set(strips, words, ["id"])) == spark_rows(raster.strip_support(strips, mask).where("n > 0").select("id", "n"))


def test_openings_copy_no_cells(spark, sf, monkeypatch):
    monkeypatch.setattr(raster, "moved", None)  # nine copies of each cell
    assert QUERIES["detected_openings"](spark, sf).count() == 2 * spark.read.parquet(f"{sf}/supplier.parquet").count()


@pytest.mark.parametrize("seed", range(4))
def test_nearest_free_openings_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), rng.randrange(300), rng.randrange(40) / 10 if seed % 2 else rng.uniform(0, 3)) for _ in range(400)]
    rows += [(0, 500, float("nan")), (0, 501, None), (1, 502, float("inf")), (1, 503, float("inf"))]
    o = spark.createDataFrame(rows, "wall long, id long, x double")
    a, b = o.where("id % 2 = 0"), o.where("id % 2 = 1")
    pairs = a.selectExpr("wall", "id AS first", "x AS ax").join(b.selectExpr("wall", "id AS second", "x AS bx"), "wall").selectExpr("wall", "first", "second", "abs(ax - bx) AS along").where("along <= 0.15D")
    assert spark_rows(elements.nearest_free(a, b, 0.15)) == spark_rows(elements.paired_openings(pairs))


def test_openings_of_one_wall_make_no_pairs(spark, tmp_path):
    duckdb.connect().execute(f"COPY (SELECT k::BIGINT AS c_custkey, 1::INTEGER AS c_nationkey FROM range(60000) t(k)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    df = QUERIES["paired_openings"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    free, want = {}, []  # 15 million pairs come near enough
    for k in range(1, 60_000, 2):
        free.setdefault(k * 7 % 120 / 10, deque()).append(k)
    for k in range(0, 60_000, 2):
        near = min(((abs(k * 7 % 120 / 10 - x), q[0], x) for x, q in free.items() if q and abs(k * 7 % 120 / 10 - x) <= 0.15), default=None)
        if near:
            want.append((1, k, free[near[2]].popleft()))
    assert sorted(map(tuple, df.collect())) == want


def test_slab_faces_of_one_place(same, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(structure, "MEMBERS", 7)
    same("slab_zone_pairs", part="SELECT (100 * i + k)::BIGINT AS p_partkey, (k % 16)::INTEGER AS p_size FROM range(20) a(i), range(40) b(k)")
    plan = QUERIES["slab_zone_pairs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(a_ids") < plan.index("Join")  # lists of members meet, not members
