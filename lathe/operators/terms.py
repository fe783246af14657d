"""Term statistics and weights as long tables (row_id, term, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import functions as fn
from . import pairs as pairs_of


def term_counts(batch: DataFrame, terms: Column) -> DataFrame:
    """(row_id, term, n). Texts are dealt out by row before they are taken apart, so what is shuffled is the texts and not their terms.

    terms: an expression that mentions its words once, as it is worked out where the rows are exploded.
    """
    # a number of partitions, as few bytes of text make many terms, and Spark would join partitions by bytes
    batch = batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_id")
    return batch.select("row_id", F.explode(terms).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("n"))


def bigram_counts(batch: DataFrame, words: Column) -> DataFrame:
    """term_counts of words and pairs of neighbours; words become a column first, and are made once."""
    return term_counts(batch.select("row_id", words.alias("words")), fn.with_bigrams(F.col("words")))


def term_frequencies(batch: DataFrame, terms: Column) -> DataFrame:
    """(term, n, df) in one shuffle: each row sends its terms, and its distinct terms, to one aggregation by term."""
    rows = batch.select(terms.alias("terms"))
    said = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("df")))
    held = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("df")))
    return rows.select(F.inline(F.concat(said, held))).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def prune(frequencies: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    return frequencies.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))


def top_vocabulary(frequencies: DataFrame, k: int, by: str = "cf") -> DataFrame:
    """The k terms of the largest total; ties go to the lesser term."""
    return frequencies.orderBy(F.desc(by), "term").limit(k)


def title_vocabulary(frequencies: DataFrame, k: int = 6000, min_df: int = 3, least: int = 50) -> DataFrame:
    """Terms by falling document frequency; none at all if fewer than `least` pass."""
    kept = frequencies.filter(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(k)
    return kept.crossJoin(F.broadcast(kept.agg(F.count("*").alias("n_kept")))).filter(F.col("n_kept") >= least).drop("n_kept")


def l2_normalise(weights: DataFrame) -> DataFrame:
    """Rows of unit length; a row of zeros stays."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row_id")))
    return weights.withColumn("w", F.when(norm > 0, F.col("w") / norm).otherwise(F.col("w")))


def tfidf(counts: DataFrame, vocabulary: DataFrame, n_docs: int, sublinear: bool = False) -> DataFrame:
    """Smooth idf, raw or log term frequency, unit rows."""
    tf = 1 + F.log("n") if sublinear else F.col("n").cast("double")
    idf = F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1
    joined = counts.join(vocabulary.select("term", "df"), "term")
    return l2_normalise(joined.select("row_id", "term", (tf * idf).alias("w")))


def bm25(counts: DataFrame, vocabulary: DataFrame, n_docs: int, k1: float = 3.0, b: float = 0.75) -> DataFrame:
    """OURS in the last factor: the standard saturation of the term frequency."""
    joined = counts.join(vocabulary.select("term", "df"), "term")
    sized = joined.withColumn("size", F.sum("n").over(Window.partitionBy("row_id")))
    mean = joined.agg((F.sum("n") / F.countDistinct("row_id")).alias("mean"))
    sized = sized.crossJoin(F.broadcast(mean))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    base = k1 * (1 - b + b * F.col("size") / F.greatest("mean", F.lit(1e-9)))
    return sized.select("row_id", "term", (idf * F.col("n") * (k1 + 1) / (F.col("n") + base)).alias("w"))


def hashed_counts(counts: DataFrame, buckets: int) -> DataFrame:
    """Counts by a hash of the term (OURS, as the tables that fix a hash are not available)."""
    bucket = (fn.digest(F.col("term")) % buckets).cast("string")
    return counts.groupBy("row_id", bucket.alias("term")).agg(F.sum("n").cast("double").alias("w"))


def log_damped(weights: DataFrame) -> DataFrame:
    return l2_normalise(weights.withColumn("w", F.log1p("w")))


def feature_union(*blocks: tuple[str, DataFrame, float]) -> DataFrame:
    """Blocks side by side: (name, weights, factor)."""
    out = None
    for name, weights, factor in blocks:
        part = weights.select("row_id", F.concat(F.lit(f"{name}:"), "term").alias("term"), (F.col("w") * factor).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


def window_cooccurrence(batch: DataFrame, words: Column, width: int = 6, among: DataFrame | None = None) -> DataFrame:
    """(t1, t2, n) over pairs at most `width` apart, both ways.

    Pairs are made inside a row, not by a self-join, and counted once in alphabetical order, so that one
    shuffle serves both directions. among: (term), a vocabulary that is broadcast if Spark knows it to be
    small; pairs with other terms are dropped before they are counted. Without it the pairs are packed.
    """
    if among is None:
        return pairs_of.listed(pairs_of.counted(batch, words, width))
    rows = batch.select("row_id", words.alias("words")).filter(F.size("words") > 1)
    at = F.sequence(F.lit(0), F.size("words") - 2)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.slice("words", i + 2, F.lit(width)), lambda b: F.struct(F.get("words", i).alias("t1"), b.alias("t2")))))
    one = rows.select(F.inline(pairs))
    for side in ("t1", "t2"):
        one = one.join(among.select(F.col("term").alias(side)), side, "left_semi")
    one = one.select(F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    both = F.array(F.struct(F.col("a").alias("t1"), F.col("b").alias("t2")), F.struct(F.col("b").alias("t1"), F.col("a").alias("t2")))
    same = F.array(F.struct(F.col("a").alias("t1"), F.col("b").alias("t2")))
    n = F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))
    return one.select(F.inline(F.when(F.col("a") == F.col("b"), same).otherwise(both)), n.alias("n")).select("t1", "t2", "n")


def document_cooccurrence(counts: DataFrame) -> DataFrame:
    """(t1, t2, n): documents that hold both terms; pairs are made inside each document's own list of terms."""
    lists = counts.groupBy("row_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    pair = lists.select(F.explode("terms").alias("t1"), "terms").select("t1", F.explode("terms").alias("t2")).filter("t1 <> t2")
    return pair.groupBy("t1", "t2").agg(F.count("*").alias("n"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """max(0, ln(n N / (row col))) for symmetric pairs; zero entries are left out."""
    margins = pairs.groupBy("t1").agg(F.sum("n").alias("s"))
    total = margins.agg(F.sum("s").alias("total"))
    joined = pairs.join(margins.withColumnRenamed("s", "s1"), "t1").join(margins.select(F.col("t1").alias("t2"), F.col("s").alias("s2")), "t2").crossJoin(F.broadcast(total))
    w = F.greatest(F.lit(0.0), F.log(F.col("n") * F.col("total") / F.greatest(F.col("s1") * F.col("s2"), F.lit(1e-12))))
    return joined.select("t1", "t2", w.alias("w")).filter("w > 0")


def window_ppmi(batch: DataFrame, words: Column, width: int = 6) -> DataFrame:
    """ppmi of window_cooccurrence over all terms, from packed pairs."""
    return pairs_of.ppmi(pairs_of.counted(batch, words, width))


def top_terms(weights: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("row_id").orderBy(F.desc(F.round("w", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def words_of(batch: DataFrame) -> DataFrame:
    """The default long table: cleaned text, analyzer tokens, counts."""
    return term_counts(batch, fn.analyzer_tokens(fn.clean_joined(F.col("text"))))
