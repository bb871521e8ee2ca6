"""Point clouds and elements from tables, generated rooms, and tables kept in a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent, a session of this machine alone (a ``local`` master, as in tests) takes a folder of its
    own; on a cluster it is an error, since executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/pointloom-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage: a table in the shared folder, whose files outlive executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Remove tables that ``kept`` wrote. Only for those that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_kept_at", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def orders_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud with a unique record id: (rid, scan, x, y, z)."""
    d = lambda v: F.lit(float(v))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rid"),
        (F.col("o_custkey") % 17).alias("scan"),
        (F.col("o_totalprice") / d(50000)).alias("x"),
        (((F.col("o_custkey") * 37) % 800) / d(100)).alias("y"),
        (((F.col("o_orderkey") * 13) % 64) * d(0.05)).alias("z"),
    )


def lineitem_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk cloud without record ids: (scan, x, y, z)."""
    d = lambda v: F.lit(float(v))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("scan"), (F.col("l_quantity") * d(0.13)).alias("x"), (F.col("l_extendedprice") * d(1e-4)).alias("y"), (F.col("l_discount") * d(30)).alias("z")
    )


def generated_room(spark: SparkSession, width: int = 120, depth: int = 80, height: int = 60, step: float = 0.05) -> DataFrame:
    """A room of planes on a grid: floor, ceiling, four walls and both faces of a partition; distinct points."""
    n = lambda k, c: spark.range(k + 1).select(F.col("id").alias(c))
    s = F.lit(step)
    x, y, z = n(width, "i"), n(depth, "j"), n(height, "k")
    ends = lambda *v: F.explode(F.array(*[F.lit(float(a)) for a in v]))
    flat = x.crossJoin(y).select((F.col("i") * s).alias("x"), (F.col("j") * s).alias("y"), ends(0, 3).alias("z"))
    along = x.crossJoin(z).select((F.col("i") * s).alias("x"), ends(0, 4).alias("y"), (F.col("k") * s).alias("z"))
    across = y.crossJoin(z).select(ends(0, 6, 2.9, 3.1).alias("x"), (F.col("j") * s).alias("y"), (F.col("k") * s).alias("z"))
    return flat.unionByName(along).unionByName(across).distinct()


#: The same tables as DuckDB common table expressions.
CLOUD_SQL = "cloud AS (SELECT o_orderkey AS rid, o_custkey % 17 AS scan, o_totalprice / 50000e0 AS x, ((o_custkey * 37) % 800) / 100e0 AS y, ((o_orderkey * 13) % 64) * 0.05e0 AS z FROM orders)"
BULK_SQL = "bulk AS (SELECT l_suppkey AS scan, l_quantity * 0.13e0 AS x, l_extendedprice * 1e-4 AS y, l_discount * 30e0 AS z FROM lineitem)"
ROOM_SQL = """xs AS (SELECT unnest(generate_series(0, 120)) AS i), ys AS (SELECT unnest(generate_series(0, 80)) AS j), zs AS (SELECT unnest(generate_series(0, 60)) AS k),
room AS (SELECT DISTINCT * FROM (
  SELECT i * 0.05e0 AS x, j * 0.05e0 AS y, unnest([0e0, 3e0]) AS z FROM xs, ys
  UNION ALL SELECT i * 0.05e0, unnest([0e0, 4e0]), k * 0.05e0 FROM xs, zs
  UNION ALL SELECT unnest([0e0, 6e0, 2.9e0, 3.1e0]), j * 0.05e0, k * 0.05e0 FROM ys, zs))"""
