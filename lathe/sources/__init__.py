"""Text batches in, labels out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOISE = -1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batch(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(row_id, text) from a table: the shape every operator takes."""
    return df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))


def from_list(spark: SparkSession, texts: Sequence[object]) -> DataFrame:
    """An ad-hoc request: the place in the list is the row id, items that aren't text are converted."""
    return spark.createDataFrame([(i, str(t)) for i, t in enumerate(texts)], "row_id long, text string")


def reject_empty(batch: DataFrame) -> DataFrame:
    if batch.isEmpty():
        raise ValueError("the batch holds no texts")
    return batch


def aligned_labels(labels: DataFrame, label: str | Column = "cluster_id") -> DataFrame:
    """(row_id, cluster_id) in request order; the only place where a global order is made."""
    return labels.select("row_id", (F.col(label) if isinstance(label, str) else label).cast("int").alias("cluster_id")).orderBy("row_id")


def health(spark: SparkSession) -> DataFrame:
    """One row if the session can run a job."""
    return spark.range(1).select(F.lit("healthy").alias("status"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a Python worker holds little however long its rows are.

    Two settings of the session are set, and stay so, as plans are run after the operator returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lathe-")


_held: list[tuple[SparkSession, str]] = []


def held() -> int:
    """A mark for release()."""
    return len(_held)


def release(since: int = 0) -> None:
    """Delete the tables settled since the mark. What was made from them can't be run again."""
    while len(_held) > since:
        spark, path = _held.pop()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: no lineage behind it, and safe when executors are lost.

    Results are lazy and read these tables, so it is the caller who ends their life, with release().
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(root or _own_folder()).rstrip('/')}/settled-{uuid.uuid4().hex[:12]}"
    _held.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
