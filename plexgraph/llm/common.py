"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plexgraph-")
    return _own[app]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/plexgraph/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The stored tables of one call of an operator. Called like stash(); drop() deletes tables that have been read for
    the last time, close() all but those named. What a lazy result still reads must stay."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __call__(self, df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
        path = new_path(self.spark, what)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.paths:
                delete(self.spark, self.paths.pop(id(t))[1])

    def close(self, *kept: DataFrame) -> None:
        stay = {id(t) for t in kept}
        self.drop(*[t for i, (t, _) in self.paths.items() if i not in stay])


#: Words of 64 bits of the filters below: 16 MB in numpy, and a table of so many rows for a broadcast join.
FILTER_WORDS, TABLE_WORDS = 1 << 21, 1 << 17


def bits_of(keys: DataFrame, col: str, words: int = TABLE_WORDS) -> DataFrame:
    """A filter of bounded size over hashed keys: (word, bits), at most so many rows. Keys beyond its capacity make it
    pass more than it should, never less, so what it passes must be looked up."""
    word = F.shiftrightunsigned(col, 6).bitwiseAND(F.lit(words - 1).cast("long"))
    return keys.select(word.alias("word"), F.col(col).alias("_k")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(_k & 63 AS INT))")).alias("bits"))


def filter_of(keys: DataFrame, col: str, words: int = FILTER_WORDS) -> np.ndarray:
    """bits_of as an array, whose size is fixed whatever the number of keys."""
    got = bits_of(keys, col, words).toArrow()
    out = np.zeros(words, dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def passes(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64 bits) the array passes."""
    k = keys.view(np.uint64)
    word = ((k >> np.uint64(6)) & np.uint64(len(known) - 1)).astype(np.int64)
    return (known[word] >> (k & np.uint64(63))) & np.uint64(1) == np.uint64(1)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(splitters: list, leaf, below) -> Column:
    """A balanced tree of comparisons: leaf(i) where i counts the splitters at or below the row.

    below(s) is the condition that the row stands before splitter s.
    """

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(below(splitters[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(splitters))
