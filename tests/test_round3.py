"""Findings of the third round: results that outgrow a type, and rows of faces that share a place."""

import duckdb
import numpy as np
import pytest
from helpers import duck_rows, spark_rows

from pointloom.functions import geometry
from pointloom.operators import grid, recognise
from pointloom.plans.catalog import ORACLES, QUERIES
from pointloom.plans.spatial import NEAR_SQL


def tables(folder, **made):
    """The given tables as files in ``folder``, and DuckDB over them."""
    con = duckdb.connect()
    for name, text in made.items():
        con.execute(f"COPY ({text}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("base, kind", [(0, "bigint"), (2_000_000_000, "decimal(38,0)")])
def test_checksum_beyond_a_bigint(spark, tmp_path, base, kind):
    con = tables(
        tmp_path,
        supplier=f"SELECT ({base} + 400 * i + k)::BIGINT AS s_suppkey FROM range(3) a(i), range(8) b(k)",
        orders=f"SELECT ({base} + k)::BIGINT AS o_orderkey, (k * 7 % 1500)::BIGINT AS o_custkey, (k * 7919 % 500000)::DOUBLE AS o_totalprice FROM range(400) t(k)",
    )
    df = QUERIES["face_index_equivalence"](spark, str(tmp_path))
    pairs, checksum = con.execute(f"WITH {NEAR_SQL} SELECT count(*), sum(rid::HUGEINT * face) FROM near").fetchall()[0]
    assert [(int(r.pairs), int(r.checksum)) for r in df.collect()] == [(pairs, int(checksum))] and pairs > 100
    assert dict(df.dtypes) == {"pairs": "bigint", "checksum": kind} and (int(checksum) >= 2**63) == (base > 0)
    if not base:
        assert spark_rows(df) == duck_rows(con, ORACLES["face_index_equivalence"])


def test_checksum_of_no_pairs(spark, tmp_path):
    tables(tmp_path, supplier="SELECT 1::BIGINT AS s_suppkey WHERE false", orders="SELECT 1::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 1::DOUBLE AS o_totalprice")
    assert [tuple(r) for r in QUERIES["face_index_equivalence"](spark, str(tmp_path)).collect()] == [(0, None)]


@pytest.mark.parametrize("name", ["face_selection", "near_segments"])
def test_rows_of_faces_of_one_place_take_little_room(spark, tmp_path, name):
    con = tables(
        tmp_path,
        supplier="SELECT (400 * i + k)::BIGINT AS s_suppkey FROM range(300) a(i), range(12) b(k)",
        orders="SELECT k::BIGINT AS o_orderkey, (k * 7 % 1500)::BIGINT AS o_custkey, (k * 7919 % 500000)::DOUBLE AS o_totalprice FROM range(3000) t(k)",
    )
    QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    cols = ", ".join(QUERIES[name](spark, str(tmp_path)).columns)
    con.execute(f"CREATE TABLE want AS SELECT {cols} FROM ({ORACLES[name]})")
    con.execute(f"CREATE TABLE got AS SELECT {cols} FROM '{tmp_path}/out/*.parquet'")
    differ = con.execute("SELECT (SELECT count(*) FROM (FROM got EXCEPT ALL FROM want)), (SELECT count(*) FROM (FROM want EXCEPT ALL FROM got)), (SELECT count(*) FROM got)").fetchall()[0]
    taken = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert differ[:2] == (0, 0) and differ[2] > 100_000 and taken < 0.7 * differ[2]


def test_long_lists_of_faces(spark, monkeypatch):
    monkeypatch.setattr(grid, "MEMBERS", 7)
    members = spark.range(100).selectExpr("id AS face", "id % 3 AS shape")
    found = spark.range(12).selectExpr("id % 4 AS face", "id AS rid")
    assert spark_rows(grid.all_faces(found, members)) == spark_rows(grid.each_face(found, members)) and grid.all_faces(found, members).count() == 300
    assert grid.dealt(found.limit(0)).count() == 0 and grid.dealt(found, 5).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("n, span", [(300, 2.0), (6000, 2.0), (1500, 0.01)])
def test_covariances_equal_all_pairs(n, span):
    rng = np.random.default_rng(n)
    p = rng.uniform(0, span, (n, 3))
    p[: n // 3] = np.round(p[: n // 3] * 20) / 20  # many at the very radius
    p[: n // 5, 2] = 0
    at, number, cov = geometry.neighbour_covariances(p, core := rng.random(n) < 0.5, 0.5)
    assert set(at) == set(np.flatnonzero(core))
    for i in range(0, len(at), 7):
        d = p - p[at[i]]
        d = d[d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= 0.25]
        want = d.T @ d / len(d) - np.outer(d.mean(axis=0), d.mean(axis=0))
        assert len(d) == number[i] and np.allclose(want, cov[i], rtol=1e-9, atol=1e-11 * np.trace(want))


@pytest.mark.parametrize("most", [500_000, 40, 5])
def test_normals_make_no_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(recognise, "TILE_POINTS", most)  # fewer make smaller tiles
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.uniform(-2, 2, (600, 3)))] + [(700, None, 0.0, 0.0), (701, float("nan"), 0.0, 0.0), (702, float("inf"), 0.0, 0.0), (703, 50.0, 50.0, 50.0)]
    df = recognise.point_normals(spark.createDataFrame(rows, "rid long, x double, y double, z double"), 0.5)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got, p = {r.rid: r for r in df.collect()}, np.array([r[1:] for r in rows[:600]])
    assert df.count() == len(got)
    for i, v in enumerate(p):
        d = p[((p - v) ** 2).sum(axis=1) <= 0.25]
        assert (len(d) >= 4) == (i in got)
        if i in got:
            (n,), (curvature,) = geometry.normals(np.cov(d.T, bias=True)[None])
            assert np.allclose([got[i].nx, got[i].ny, got[i].nz, got[i].curvature], [*n, curvature], atol=1e-6)
    assert max(got) < 600 and recognise.point_normals(df.select("rid", "x", "y", "z").limit(0), 0.5).count() == 0
