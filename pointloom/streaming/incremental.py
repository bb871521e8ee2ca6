"""An extension: height histograms and votes kept up to date as scans arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.cloud import binned


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of points or votes as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def histogram(points: DataFrame, size: float) -> DataFrame:
    """(scan, bin, n): state is one counter for each occupied bin of a scan, never points."""
    return points.groupBy("scan", binned(F.col("z"), size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def vote_counts(votes: DataFrame) -> DataFrame:
    """(row, label, n, best), from which the majority follows at any time by ``proposals.majority``'s order."""
    return votes.where("label >= 0").groupBy("row", "label").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def telemetry(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Records and largest value per stage and window of event time; later events than ``late`` are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")).select("window.start", "event_type", "n", "most")


def decided(counts: DataFrame) -> DataFrame:
    """The winner of each row from ``vote_counts``."""
    best = F.max(F.struct("n", (-F.col("label")).alias("l"), "best")).alias("w")
    return counts.groupBy("row").agg(best).select("row", (-F.col("w.l")).alias("label"), F.col("w.n").alias("votes"), F.col("w.best").alias("score"))
