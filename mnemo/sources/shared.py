"""Folders and tables that driver and executors share, below spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path. Only a local master may go without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Work:
    """Tables that a job of several rounds writes: each cuts lineage and outlives lost executors.

    ``close`` deletes all but those that are kept.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, shared_path(spark, name), 0
        self.paths: dict[int, str] = {}

    def written(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path, partitionBy=list(partition_by) or None)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._hold = getattr(self, "_hold", [])
        self._hold.append(out)  # so that no other table takes its id
        return out

    def close(self, *kept: DataFrame) -> None:
        for at, path in self.paths.items():
            if at not in {id(k) for k in kept}:
                delete(self.spark, path)
