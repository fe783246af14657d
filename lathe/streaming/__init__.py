"""Rounds of texts: a batch takes part only with texts that recent rounds didn't use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources


def text_key(df: DataFrame) -> DataFrame:
    return df.withColumn("text_key", F.sha2(fn.clean_joined(F.col("text")), 256))


def unused(batch: DataFrame, used: DataFrame) -> DataFrame:
    """Rows whose normalised text no earlier round held, one for each text."""
    new = text_key(batch).join(text_key(used).select("text_key").distinct(), "text_key", "left_anti")
    first = new.groupBy("text_key").agg(F.min("row_id").alias("row_id"))
    return new.join(first, ["text_key", "row_id"], "left_semi").drop("text_key")


def eligible(docs: DataFrame, lang: str = "en", least: int = 80) -> DataFrame:
    """The language and length gates of a round."""
    return docs.filter((F.col("lang") == lang) & (F.col("n_chars") >= least))


def cluster_stream(batches: DataFrame, preset, sink: str, checkpoint: str):
    """A Structured Streaming query that labels each micro-batch by itself and appends it to a Parquet sink."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            mark = sources.held()
            preset(batch).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(sink)
            sources.release(mark)

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
