"""Text point files: three to seven columns, validated whole, strided by numeric row; and their writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = {3: ("x", "y", "z"), 4: ("x", "y", "z", "intensity"), 6: ("x", "y", "z", "r", "g", "b"), 7: ("x", "y", "z", "intensity", "r", "g", "b")}


def read_xyz(spark: SparkSession, path: str, stride: int = 1, columns: int = 3) -> DataFrame:
    """Points in file order with ``pos``, the number of the numeric row; every ``stride``-th is kept.

    Blank lines, ``//`` and ``#`` comments and a header of names are no rows. A row with another number of columns or with a
    value that is not finite is an error even where the stride skips it. Rows are numbered
    by block of the file: counts of blocks are summed, and rows are counted within their block only.
    """
    if columns not in COLUMNS or stride < 1:
        raise ValueError("columns must be 3, 4, 6 or 7 and the stride positive")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    trimmed = F.trim(F.regexp_replace("value", r"[\t,;]+", " "))
    rows = lines.withColumn("t", trimmed).where((F.col("t") != "") & ~F.col("t").rlike(r"^(//|#)") & ~F.col("t").rlike(r"(?i)^x\s+y\s+z"))
    parts = rows.withColumn("p", F.transform(F.split("t", r"\s+"), lambda s: F.try_cast(s, "double") if hasattr(F, "try_cast") else s.try_cast("double")))
    good = (F.size("p") == columns) & ~F.exists("p", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    checked = parts.withColumn("p", F.when(good, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("bad row: "), F.substring("t", 1, 80))).cast("array<double>")))
    counts = checked.groupBy("file", "block").agg(F.count("p").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("n")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")) - 1
    numbered = checked.withColumn("k", inside).join(before, ["file", "block"]).withColumn("pos", (F.col("before") + F.col("k")).cast("long"))
    return numbered.where(F.pmod("pos", F.lit(stride)) == 0).select("pos", *[F.col("p")[i].alias(c) for i, c in enumerate(COLUMNS[columns])])


def write_xyz(cloud: DataFrame, path: str, channels: tuple[str, ...] = ("x", "y", "z")) -> None:
    """Tab-separated text. Files appear at ``path`` only when all of them are written."""
    spark = cloud.sparkSession
    staging = f"{path.rstrip('/')}.staging"
    cloud.select(*channels).write.mode("overwrite").option("sep", "\t").csv(staging)
    jvm = spark.sparkContext._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # The old files stay until the new ones are in place: a failure between the steps loses neither.
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.previous")
    if fs.exists(target):
        fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise OSError(f"cannot move the old {path} aside")
    if not fs.rename(source, target):
        fs.rename(aside, target)
        raise OSError(f"cannot publish {path}")
    fs.delete(aside, True)
