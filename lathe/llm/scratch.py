"""Shared-folder tables that cut lineage, and helpers every operator needs."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="lathe-scratch-")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only where that is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ""
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_root()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a Python worker holds little whatever the length of texts.

    Two settings of the session are set, and stay so, as plans are run after the operator returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


_open: list[Scratch] = []


class Scratch:
    """A folder of intermediate Parquet tables in the shared root.

    A table that is written and read again has no lineage behind it, so a lost executor costs only
    the stage that runs, and the files survive it. An operator's result reads its tables when it is
    run, so the caller ends their life: with release(), once the result has been used.
    """

    def __init__(self, spark: SparkSession, tag: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.base)


def opened() -> int:
    """A mark for release()."""
    return len(_open)


def release(since: int = 0) -> None:
    """Delete the tables of every operator called since the mark. Their results can't be run again."""
    while len(_open) > since:
        _open.pop().close()


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark's own writers would take it to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spans(sizes, limit: int):
    """Consecutive row ranges whose sizes sum to about limit at most; a larger row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
