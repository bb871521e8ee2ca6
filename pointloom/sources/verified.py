"""Inputs that are checked before use: tables of an exact schema, size and digest, and paths that stay in their folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InputError(ValueError):
    """An input is not what its manifest says."""


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, by executors; each file is one row, so it is for files of bounded size (channels, models)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Differences between files and ``expected`` (name, sha256): (name, rule); empty where all are there, unchanged and known."""
    have = digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    j = have.join(expected.withColumn("listed", F.lit(True)), "name", "full")
    rule = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unknown").when(~F.col("found").eqNullSafe(F.col("sha256")), "changed")
    return j.select("name", rule.alias("rule")).where("rule IS NOT NULL")


def verified_table(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """A Parquet table whose columns have exactly these names and types in this order, and that many rows if given."""
    from pyspark.sql.types import _parse_datatype_string

    df = spark.read.parquet(path)
    want, have = ([(f.name, f.dataType.simpleString()) for f in s.fields] for s in (_parse_datatype_string(schema), df.schema))
    if want != have:
        raise InputError(f"columns are {have}, not {want}")
    if rows is not None and (n := df.count()) != rows:
        raise InputError(f"{n} rows, not {rows}")
    return df


def contained(root: str, *parts: str) -> str:
    """A path below ``root``: absolute parts, ``..`` and links that lead out of it are errors."""
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, *parts))
    if any(os.path.isabs(p) for p in parts) or path == base or os.path.commonpath([base, path]) != base:
        raise InputError(f"{os.path.join(*parts) if parts else root} leads out of its folder")
    return path
