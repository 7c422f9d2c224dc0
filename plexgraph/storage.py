"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master gets a temporary folder and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plexgraph-")
    return _own[app]


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/plexgraph/graph-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """df written once and read again: cuts lineage in loops, and a lost executor costs no recomputation. Tables stay
    until clear()."""
    path = f"{_home(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path as it names it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = at(spark, path)
    fs.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application has stashed. Results that are still to be read from them are lost."""
    delete(spark, _home(spark))


class Scratch:
    """The stored tables of one call: called like stash(); close() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{_home(spark)}/call-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}-{what}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        delete(self.spark, self.path)
