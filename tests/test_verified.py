"""Inputs that differ from their manifest are found; paths stay in their folder."""

import hashlib
import os

import pytest

from pointloom.sources import verified as V


def test_files_are_held_against_their_digests(spark, tmp_path):
    for name, text in (("a", b"one"), ("b", b"two"), ("d", b"four")):
        (tmp_path / name).write_bytes(text)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("a", sha(b"one")), ("b", sha(b"other")), ("c", sha(b"three"))], "name string, sha256 string")
    got = V.verified_files(spark, f"file://{tmp_path}", listed).collect()
    assert sorted(tuple(r) for r in got) == [("b", "changed"), ("c", "missing"), ("d", "unknown")]


def test_tables_of_another_type_or_size_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).selectExpr("id", "cast(id as float) AS x").write.parquet(path)
    assert V.verified_table(spark, path, "id long, x float", 5).count() == 5
    for schema, rows in (("id long, x double", 5), ("x float, id long", 5), ("id long", 5), ("id long, x float", 6)):
        with pytest.raises(V.InputError):
            V.verified_table(spark, path, schema, rows)


def test_paths_stay_in_their_folder(tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    os.symlink(tmp_path, root / "out")
    assert V.contained(str(root), "models", "a.json") == os.path.realpath(root / "models" / "a.json")
    for parts in (("..", "x"), ("/etc/passwd",), ("out", "x"), (), ("a", "..")):
        with pytest.raises(V.InputError):
            V.contained(str(root), *parts)
