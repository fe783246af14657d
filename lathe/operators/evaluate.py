"""Agreement of two labellings (row_id, truth, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def _two(n: Column) -> Column:
    return n * (n - 1) / 2


def _margins(table: DataFrame, of) -> DataFrame:
    a = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(of(F.col("n")).alias("a"))
    b = table.groupBy("pred").agg(F.sum("n").alias("n")).agg(of(F.col("n")).alias("b"))
    return table.agg(F.sum("n").alias("n"), of(F.col("n")).alias("ab")).crossJoin(a).crossJoin(b)


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    m = _margins(contingency(pairs), lambda n: F.sum(_two(n)))
    expected = F.col("a") * F.col("b") / F.nullif(_two(F.col("n")), F.lit(0.0))
    gap = (F.col("a") + F.col("b")) / 2 - expected
    return m.select(F.coalesce(F.when(gap == 0, 1.0).otherwise((F.col("ab") - expected) / gap), F.lit(1.0)).alias("ari"))


def normalised_mutual_information(pairs: DataFrame) -> DataFrame:
    """Arithmetic mean normalisation; two labellings of one cluster each agree fully."""
    m = _margins(contingency(pairs), lambda n: F.sum(n * F.log(n)))
    n = F.col("n")
    h = {c: F.log(n) - F.col(c) / n for c in ("a", "b", "ab")}
    mean = (h["a"] + h["b"]) / 2
    return m.select(F.when(mean <= 1e-15, 1.0).otherwise((h["a"] + h["b"] - h["ab"]) / mean).alias("nmi"))


def combined(pairs: DataFrame) -> DataFrame:
    both = adjusted_rand(pairs).crossJoin(normalised_mutual_information(pairs))
    return both.select("ari", "nmi", ((F.greatest(F.lit(0.0), F.col("ari")) + F.col("nmi")) / 2).alias("combined"))


def round_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("combined").alias("round_score"))


def to_beat(scores: DataFrame) -> DataFrame:
    return scores.select((F.col("round_score") * 1.01).alias("to_beat"))
