"""Immutable, content-addressed generations of a table, and the pointer to the current one."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Generations:
    """Parquet directories ``<root>/generations/<sha256>`` that never change, and ``<root>/current.json``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def _name(self, key: str) -> str:
        if not re.fullmatch(r"[0-9a-f]{64}", key):
            raise ValueError("a generation is named by a SHA-256")
        return f"{self.root}/generations/{key}"

    @staticmethod
    def key(**facts) -> str:
        return hashlib.sha256(json.dumps(facts, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()

    def get(self, key: str) -> DataFrame | None:
        name = self._name(key)
        return self.spark.read.parquet(name) if self.fs.exists(self.jvm.org.apache.hadoop.fs.Path(f"{name}/_SUCCESS")) else None

    def publish(self, key: str, df: DataFrame) -> DataFrame:
        """Write to a private folder, then rename; whoever comes second takes what is there."""
        name, staging = self._name(key), f"{self.root}/staging/{uuid.uuid4().hex}"
        if (there := self.get(key)) is None:
            df.write.parquet(staging)
            self.fs.mkdirs(self._path("generations"))
            Path = self.jvm.org.apache.hadoop.fs.Path
            if not self.fs.rename(Path(staging), Path(name)):
                self.fs.delete(Path(staging), True)
            there = self.get(key)
        return there

    def point(self, key: str) -> None:
        """Make a generation the current one, by replacing a small file."""
        self._name(key)
        self.spark.createDataFrame([(json.dumps({"current": key}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/current.json")

    def current(self) -> str | None:
        if not self.fs.exists(self._path("current.json")):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/current.json").first().value)["current"]

    def collect_garbage(self, referenced: set[str]) -> list[str]:
        """Remove generations that are neither referenced nor current."""
        keep, gone = referenced | {self.current()}, []
        if self.fs.exists(self._path("generations")):
            for status in self.fs.listStatus(self._path("generations")):
                name = status.getPath().getName()
                if name not in keep:
                    self.fs.delete(status.getPath(), True)
                    gone.append(name)
        return sorted(gone)


def write_once(spark: SparkSession, path: str, df: DataFrame) -> None:
    """A frozen report: writing it again is allowed only with equal rows."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = Path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(Path):
        df.write.parquet(path)
        return
    old = spark.read.parquet(path)
    if old.dtypes != df.dtypes or old.exceptAll(df).limit(1).count() or df.exceptAll(old).limit(1).count():
        raise FileExistsError(f"{path} is frozen with other content")
