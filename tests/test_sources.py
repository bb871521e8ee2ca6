import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from pointloom.sources import documents, generations, xyz
from pointloom.sources.tables import orders_cloud
from pointloom.streaming import incremental


def test_xyz_round_trip_and_stride(spark, tmp_path, sf):
    path = f"file://{tmp_path}/cloud"
    cloud = orders_cloud(spark, sf).orderBy("rid").coalesce(1)
    xyz.write_xyz(cloud, path)
    back = xyz.read_xyz(spark, path)
    assert [tuple(r) for r in back.orderBy("pos").select("x", "y", "z").collect()] == [tuple(r) for r in cloud.select("x", "y", "z").collect()]
    assert [r.pos for r in xyz.read_xyz(spark, path, 7).orderBy("pos").limit(4).collect()] == [0, 7, 14, 21]


@pytest.mark.parametrize("bad", ["1 2", "1 2 3 4", "1 2 nan", "1 two 3", "1 2 inf"])
def test_xyz_refuses_rows_that_the_stride_skips(spark, tmp_path, bad):
    f = tmp_path / "a.txt"
    f.write_text(f"X Y Z\n// note\n1 2 3\n{bad}\n4 5 6\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="bad row"):
        xyz.read_xyz(spark, f"file://{f}", 2).collect()
    f.write_text("X Y Z\n// note\n1 2 3\n\n4\t5\t6\n")
    assert [(r.pos, r.x) for r in xyz.read_xyz(spark, f"file://{f}").orderBy("pos").collect()] == [(0, 1.0), (1, 4.0)]


@pytest.mark.parametrize("bad", ['{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', "{"])
def test_strict_json(bad):
    with pytest.raises(ValueError):
        documents.read_json(bad)
    assert documents.canonical({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'


def test_model_tables(spark):
    doc = {"schema_version": 2, "unit": "metre", "walls": [{"id": "w", "storey_id": "s", "start": {"x": 0.0, "y": 1.0}, "height": 2.5}]}
    tables = documents.model_tables(spark, json.dumps(doc))
    assert set(tables) == set(documents.MODEL) and tables["walls"].first().start.y == 1.0 and tables["stairs"].count() == 0
    for change in ({"unit": "mm"}, {"schema_version": 1}, {"doors": []}, {"walls": [{"id": "w", "colour": 1}]}):
        with pytest.raises(ValueError):
            documents.model_tables(spark, json.dumps({**doc, **change}))


def test_generations(spark, tmp_path):
    g = generations.Generations(spark, f"file://{tmp_path}/project")
    a, b = g.key(content="a"), g.key(content="b")
    assert g.get(a) is None and g.publish(a, spark.range(3)).count() == 3
    assert g.publish(a, spark.range(9)).count() == 3  # never changes
    g.publish(b, spark.range(1))
    g.point(a)
    assert g.current() == a and g.collect_garbage(set()) == [b] and g.get(b) is None and g.get(a).count() == 3
    with pytest.raises(ValueError):
        g.get("../elsewhere")


def test_write_once(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    generations.write_once(spark, path, spark.range(3))
    generations.write_once(spark, path, spark.range(3))
    with pytest.raises(FileExistsError):
        generations.write_once(spark, path, spark.range(4))


def test_streaming_equals_batch(spark, tmp_path, sf):
    from helpers import spark_rows

    cloud = orders_cloud(spark, sf).repartition(4)
    folder = f"file://{tmp_path}/scans"
    cloud.write.parquet(folder)
    stream = incremental.histogram(incremental.arriving(spark, folder, cloud.schema, 1), 0.05)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("heights").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/check").start()
    q.awaitTermination(120)
    assert spark_rows(spark.table("heights")) == spark_rows(incremental.histogram(cloud, 0.05))
