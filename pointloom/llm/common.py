"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources.tables import kept, released  # noqa: F401

#: White space that separates words, as a character class of Java and Python regular expressions.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive executors."""
    return kept(df)


def spare(columns: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column of the table has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def code_points(column):
    """A sort key that orders strings by code point (UTF-8 bytes order alike)."""
    return F.encode(column, "UTF-8")


ship(__name__)
