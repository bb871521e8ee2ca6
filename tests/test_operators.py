"""Results that must not depend on partitions or order, contracts, and proposals end to end."""

import pandas as pd
import pytest
from helpers import spark_rows
from pyspark.sql import functions as F

from pointloom.functions.shipping import ship
from pointloom.operators import cluster, grid, providers, quality
from pointloom.operators import sampling as S
from pointloom.operators.elements import signature
from pointloom.plans.spatial import faces
from pointloom.sources.generations import Generations
from pointloom.sources.tables import orders_cloud

OPERATORS = {
    "sample": lambda c: S.voxel_sample(c, 0.5, (0.0, 0.0, 0.0)),
    "dbscan": lambda c: cluster.dbscan(c.where("z < 0.3"), 0.3, 3),
    "knn": lambda c: grid.nearest_k(c.where("z < 0.5"), 4, 0.5),
    "tiles": lambda c: grid.tiles_with_halo(c, 2.0, 0.4).groupBy("tx", "ty").count(),
    "signature": lambda c: signature(c, "x", "y", "z"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_order_and_partitions_do_not_matter(name, spark, sf):
    cloud = orders_cloud(spark, sf)
    assert spark_rows(OPERATORS[name](cloud.orderBy("y").repartition(7))) == spark_rows(OPERATORS[name](cloud.coalesce(1)))


def test_cell_join_equals_nested_loop(spark, sf):
    cloud, f = orders_cloud(spark, sf), faces(spark, sf)
    for size in (0.3, 1.0):
        near = grid.points_near_faces(cloud, f, 0.3, 0.1, size).select("face", "rid")
        assert spark_rows(near) == spark_rows(grid.face_selection(cloud.crossJoin(f), 0.3, 0.1).select("face", "rid"))


def test_counts_over_the_limit_are_errors(spark, sf):
    cloud = orders_cloud(spark, sf)
    assert grid.neighbour_counts(cloud, 0.3, 10_000).count() == cloud.count()
    with pytest.raises(Exception, match="too many neighbours"):
        grid.neighbour_counts(cloud, 2.0, 3).collect()


def test_empty_scores_are_null(spark):
    (r,) = quality.scores(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).collect()
    assert (r.precision, r.recall, r.f1, r.iou) == (None, None, None, None)


def test_matching_prefers_more_pairs_over_a_better_one(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.5), (1, 2, 1, 0.5)], "cls int, truth_id long, pred_id long, iou double")
    assert sorted((r.truth_id, r.pred_id) for r in quality.matched_instances(pairs).collect()) == [(1, 2), (2, 1)]


def test_benchmark_needs_a_required_held_out_case(spark):
    results = spark.createDataFrame([(1, True), (2, True)], "case long, passed boolean")
    for rows, want in (([(1, True, True), (2, True, False)], True), ([(1, True, False)], False), ([(1, False, True)], False), ([(1, True, True), (3, True, False)], False)):
        cases = spark.createDataFrame(rows, "case long, required boolean, held_out boolean")
        assert quality.benchmark_passes(cases, results).first().passed is want


ship(__name__)  # tasks must know these classes


class Broken(providers.Provider):
    name = "broken"

    def prepare(self, cloud):
        raise providers.ProviderUnavailable("no model")

    def infer(self, tile):
        raise AssertionError


class Wrong(providers.FaceProvider):
    name = "wrong"

    def infer(self, tile):
        return pd.DataFrame({"label": [99] * len(tile), "score": [0.5] * len(tile)})


def test_proposals_are_cached_checked_and_fall_back(spark, tmp_path, sf):
    cloud = orders_cloud(spark, sf)
    provider = providers.FaceProvider([(2, 0.0, 2.0, 1.0, 0.0, 10.0, 0.0, 3.2), (1, 0.0, 2.02, 1.0, 0.0, 10.0, 0.0, 3.2)])
    store = Generations(spark, f"file://{tmp_path}/proposals")
    key, labels, warnings = providers.propose(cloud, provider, store)
    want = {r.rid: 1 if abs(r.y - 2.02) <= 0.035 else 2 if abs(r.y - 2) <= 0.035 else -1 for r in cloud.collect()}
    assert {r.row: r.label for r in labels.collect()} == want and warnings == []
    assert providers.propose(cloud.repartition(5), provider, store)[0] == key
    again, _, warnings = providers.propose(cloud, Broken(), store, fallback=provider)
    assert again == key and "no model" in warnings[0]
    with pytest.raises(providers.ProviderUnavailable):
        providers.propose(cloud, Broken(), store)
    with pytest.raises(ValueError, match="contract"):
        providers.propose(cloud, Wrong([(0, 0, 0, 1, 0, 1, 0, 1)]), store)
    with pytest.raises(ValueError, match="twice"):
        providers.propose(cloud.unionByName(cloud.limit(1)), provider, store)


def test_voids_against_a_flood_fill(spark):
    from pointloom.plans.spatial import layered_mask, void_candidates

    sf, want = "/root/testdata/sf0.01", []
    rasters: dict = {}
    for r in layered_mask(spark, sf).collect():
        rasters.setdefault(r.grp, set()).update((r.ix + a, r.iy + b) for a in range(-2, 3) for b in range(-2, 3))
    for grp, filled in rasters.items():
        empty = {(x, y) for x in range(40) for y in range(32)} - filled
        while empty:
            todo, part = [empty.pop()], set()
            while todo:
                x, y = todo.pop()
                part.add((x, y))
                beside = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & empty
                empty -= beside
                todo += beside
            xs, ys = [x for x, _ in part], [y for _, y in part]
            if 2 <= max(xs) - min(xs) + 1 <= 12 and 2 <= max(ys) - min(ys) + 1 <= 12 and min(xs) > 0 and max(xs) < 39 and max(ys) < 31:
                want.append((grp, min(xs), max(xs), min(ys), max(ys), len(part)))
    got = [(r.grp, r.x0, r.x1, r.y0, r.y1, r.area) for r in void_candidates(spark, sf).collect()]
    assert sorted(got) == sorted(want) and want


def test_rules_of_crops_and_poses():
    from pointloom.operators import cloud as C

    C.checked_crop([(0, 0), (4, 0), (4, 3), (0, 3)], 0, 1)
    for bad in ([(0, 0), (1, 1)], [(0, 0), (4, 0), (0, 3), (4, 3)], [(0, 0), (4, 0), (2, 0), (2, 3)], [(0, 0), (0, 0), (1, 1)], [(0, 0), (float("nan"), 0), (1, 1)]):
        with pytest.raises(ValueError):
            C.checked_crop(bad, 0, 1)
    with pytest.raises(ValueError):
        C.checked_crop([(0, 0), (4, 0), (4, 3)], 1, 1)
    r = C.rotation(1 + 5e-7, 0, 0, 0)
    assert r == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_points_on_long_edges_and_empty_crops(spark):
    from pointloom.operators import cloud as C

    square = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1.0), (0.0, 1.0)]
    points = spark.createDataFrame([(1, 500.0, 0.0), (2, 500.0, -5e-11), (3, 500.0, -9e-8), (4, 1000.0, 0.5)], "rid long, x double, y double").selectExpr("*", "1D AS z")
    assert sorted(r.rid for r in C.cropped(points, square, 0, 2).collect()) == [1, 2, 4]  # the tolerance does not grow with the edge
    with pytest.raises(ValueError):
        C.not_empty(C.cropped(points, square, 5, 6))


def test_name_based_ids(spark):
    import uuid

    from pointloom.operators.relations import uuid5

    names = ["wall-1", "", "Tür 7"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(uuid5(uuid.NAMESPACE_URL.hex, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
