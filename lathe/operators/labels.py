"""Label post-processing. Labels are (row_id, label); -1 is noise; points are (row_id, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources import settled
from . import terms
from .vectors import dot, knn, mean_vectors, unit

NOISE = -1
FIRST_SINGLETON = 1_000_000


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, c): unit mean of each cluster, noise left out."""
    rows = points.join(labels.filter(F.col("label") != NOISE), "row_id")
    return mean_vectors(rows, "label").select("label", unit(F.col("v")).alias("c"))


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(row_id, label, sim): the most similar centre; ties go to the lesser label. By block products, as for neighbours."""
    found = knn(centres.select(F.col("label").alias("row_id"), F.col("c").alias("v")), 1, queries=points.select("row_id", "v"))
    return found.select(F.col("src").alias("row_id"), F.col("dst").alias("label"), (1 - F.col("dist")).alias("sim"))


def refine(points: DataFrame, labels: DataFrame, rounds: int = 2) -> DataFrame:
    """Every row to the nearest centre of the clusters as they are; centres are made anew in each round."""
    for _ in range(rounds):
        labels = settled(nearest(points, centroids(points, labels)).select("row_id", "label"))
    return labels


def small_clusters(points: DataFrame, labels: DataFrame, least: int, mode: str = "noise") -> DataFrame:
    """Clusters below `least`: left (none), made noise, or moved to the nearest large centre."""
    if mode == "none":
        return labels
    counted = labels.join(sizes(labels), "label").withColumn("small", (F.col("n") < least) & (F.col("label") != NOISE))
    if mode == "noise":
        return counted.select("row_id", F.when(F.col("small"), NOISE).otherwise(F.col("label")).alias("label"))
    big = counted.filter(~F.col("small")).select("row_id", "label")
    return _moved(points, counted.filter("small").select("row_id", "label"), big, F.lit(True)).unionByName(big)


def _moved(points: DataFrame, small: DataFrame, big: DataFrame, where: Column) -> DataFrame:
    found = nearest(points.join(small.select("row_id"), "row_id", "left_semi"), centroids(points, big))
    joined = small.join(found.select("row_id", F.col("label").alias("to"), "sim"), "row_id", "left")
    return joined.select("row_id", F.when(F.col("to").isNotNull() & where, F.col("to")).otherwise(F.col("label")).alias("label"))


def reassign_small(points: DataFrame, labels: DataFrame, below: int = 5, similarity: float = 0.77) -> DataFrame:
    """Members of small clusters go to the nearest large centre if they are similar enough."""
    counted = labels.join(sizes(labels), "label")
    big = counted.filter((F.col("n") >= below) & (F.col("label") != NOISE)).select("row_id", "label")
    small = counted.filter((F.col("n") < below) | (F.col("label") == NOISE)).select("row_id", "label")
    return _moved(points, small, big, F.col("sim") >= similarity).unionByName(big)


def merge_mutual(points: DataFrame, labels: DataFrame, similarity: float = 0.85, max_size: int = 60, rounds: int = 1) -> DataFrame:
    """Clusters that are each other's nearest and similar enough become one, under the lesser label."""
    for _ in range(rounds):
        small = sizes(labels).filter((F.col("n") <= max_size) & (F.col("label") != NOISE))
        c = centroids(points, labels).join(small.select("label"), "label", "left_semi")
        best = settled(knn(settled(c.select(F.col("label").alias("row_id"), F.col("c").alias("v"))), 1).select(F.col("src").alias("a"), F.col("dst").alias("b"), (1 - F.col("dist")).alias("sim")))
        back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merged = settled(best.join(back, ["a", "b"]).filter((F.col("sim") >= similarity) & (F.col("a") > F.col("b"))).select(F.col("a").alias("label"), F.col("b").alias("to")))
        if merged.isEmpty():
            break
        labels = settled(labels.join(merged, "label", "left").select("row_id", F.coalesce("to", "label").alias("label")))
    return labels


def merge_most_similar(weights: DataFrame, labels: DataFrame, similarity: float = 0.7) -> DataFrame:
    """The one pair of clusters with the most similar term weights becomes one if it is similar enough.

    weights: (row_id = label, term, w) with unit rows. Pairs come from shared terms, not from all pairs.
    """
    a, b = weights.select(F.col("row_id").alias("a"), "term", F.col("w").alias("wa")), weights.select(F.col("row_id").alias("b"), "term", F.col("w").alias("wb"))
    sims = a.join(b, "term").filter("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 12).alias("sim"))
    best = sims.orderBy(F.desc("sim"), "a", "b").limit(1).filter(F.col("sim") >= similarity).select(F.col("b").alias("label"), F.col("a").alias("to"))
    return labels.join(F.broadcast(best), "label", "left").select("row_id", F.coalesce("to", "label").alias("label"))


def _ranked(scores: DataFrame, order: list[Column]) -> DataFrame:
    """A global rank without one task that sorts all: places in the partitions of a range sort, plus offsets."""
    rows = scores.orderBy(*order).withColumn("mark", F.monotonically_increasing_id())
    rows = settled(rows)
    part = F.shiftright("mark", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    placed = rows.withColumn("part", part).join(F.broadcast(before), "part")
    return placed.withColumn("rank", F.col("before") + F.col("mark") - F.shiftleft("part", 33) + 1).drop("part", "before", "mark")


def outliers_to_singletons(labels: DataFrame, scores: DataFrame, share: float) -> DataFrame:
    """The int(n share) rows of the highest score become clusters of their own. scores: (row_id, score); below 0 is exempt."""
    ranked = _ranked(labels.join(scores, "row_id"), [F.desc("score"), F.col("row_id")])
    n = int(labels.count() * share + 1e-9)
    hit = (F.col("rank") <= n) & (F.col("score") >= 0)
    return ranked.select("row_id", F.when(hit, F.lit(FIRST_SINGLETON) + F.col("rank") - 1).otherwise(F.col("label")).alias("label"))


def protected(points: DataFrame, labels: DataFrame, top: int = 3) -> DataFrame:
    """Labels of the clusters with most size x cohesion among those of middling size."""
    n = labels.count()
    c = centroids(points, labels)
    sims = points.join(labels, "row_id").join(c, "label").groupBy("label").agg(F.count("*").alias("n"), F.avg(dot(unit(F.col("v")), F.col("c"))).alias("cohesion"))
    fit = sims.filter((F.col("n") >= max(40, 0.012 * n)) & (F.col("n") <= 0.12 * n))
    return fit.orderBy(F.desc(F.round(F.col("n") * F.col("cohesion"), 9)), "label").limit(top).select("label", "n", "cohesion")


def combined_score(points: DataFrame, labels: DataFrame, kth: DataFrame) -> DataFrame:
    """Distance to the last neighbour plus distance to the own centre (noise has no centre: 1)."""
    c = centroids(points, labels)
    joined = points.join(labels, "row_id").join(c, "label", "left").join(kth, "row_id")
    return joined.select("row_id", (F.col("score") + F.coalesce(1 - dot(unit(F.col("v")), F.col("c")), F.lit(1.0))).alias("score"))


def cluster_weights(batch: DataFrame, labels: DataFrame, words: Column, per_cluster: int = 80, top: int = 4000) -> DataFrame:
    """Term weights of clusters for merge_most_similar, from the first `per_cluster` rows of each, as their definition has it."""
    first = F.row_number().over(Window.partitionBy("label").orderBy("row_id"))
    rows = batch.join(labels.withColumn("nth", first).filter(F.col("nth") <= per_cluster).select("row_id", "label"), "row_id")
    counts = settled(terms.term_counts(rows.select(F.col("label").alias("row_id"), "text"), words))
    n = counts.select("row_id").distinct().count()
    return terms.tfidf(counts, terms.top_vocabulary(terms.document_frequency(counts), top), n)


def extra_noise(labels: DataFrame, scores: DataFrame, share: float, exempt: DataFrame | None = None) -> DataFrame:
    """The int(n share) rows of the highest score, of those not noise yet nor exempt (row_id), become noise."""
    n = int(labels.count() * share + 1e-9)
    if not n:
        return labels
    able = labels.filter(F.col("label") != NOISE).join(scores, "row_id")
    if exempt is not None:
        able = able.join(exempt.select("row_id"), "row_id", "left_anti")
    hit = able.orderBy(F.desc("score"), "row_id").limit(n).select("row_id", F.lit(NOISE).cast("long").alias("to"))
    return labels.join(hit, "row_id", "left").select("row_id", F.coalesce("to", "label").alias("label"))


def reclaim(points: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Noise rows go to the nearest centre if they are similar enough; 0 turns this off."""
    if similarity <= 0:
        return labels
    noise, rest = labels.filter(F.col("label") == NOISE), labels.filter(F.col("label") != NOISE)
    return _moved(points, noise, rest, F.col("sim") >= similarity).unionByName(rest)


def noise_policy(points: DataFrame, labels: DataFrame, scores: DataFrame, mode: str = "singleton", bucket: float = 0.5) -> DataFrame:
    """Noise rows go to the nearest centre (none), become singletons, are graded (the worst share one bucket), or share one."""
    noise, rest = labels.filter(F.col("label") == NOISE), labels.filter(F.col("label") != NOISE)
    if mode == "none":
        return nearest(points.join(noise, "row_id", "left_semi"), centroids(points, rest)).select("row_id", "label").unionByName(rest)
    top = labels.agg(F.max("label")).first()[0]
    base = (top if top is not None else -1) + 1
    ranked = _ranked(noise.join(scores, "row_id"), [F.desc("score"), F.col("row_id")])
    shared = {"singleton": 0, "graded": round(noise.count() * bucket) if mode == "graded" else 0}.get(mode, 2**62)
    new = F.when(F.col("rank") <= shared, base).otherwise(base + F.col("rank"))
    return ranked.select("row_id", new.alias("label")).unionByName(rest)


def merge_scripts(labels: DataFrame, scripts: DataFrame, low: float = 0.05, high: float = 0.4, least: int = 3, purity: float = 0.55) -> DataFrame:
    """Per script class of middling share: clusters that are mostly of it become one. scripts: (row_id, script)."""
    rows = labels.join(scripts, "row_id")
    total = rows.agg(F.count("*").alias("total"))
    share = rows.filter("script > 0").groupBy("script").agg(F.count("*").alias("k")).crossJoin(F.broadcast(total)).filter((F.col("k") >= low * F.col("total")) & (F.col("k") <= high * F.col("total")))
    per = rows.groupBy("label", "script").agg(F.count("*").alias("k")).join(sizes(labels), "label").filter(F.col("label") != NOISE)
    pure = per.filter((F.col("n") >= least) & (F.col("k") >= purity * F.col("n"))).join(share.select("script"), "script", "left_semi")
    # a cluster that is mostly of two classes goes with the lower one
    pure = pure.groupBy("label").agg(F.min("script").alias("script"))
    to = pure.select("label", F.min("label").over(Window.partitionBy("script")).alias("to"))
    return labels.join(to, "label", "left").select("row_id", F.coalesce("to", "label").alias("label"))


def vote(labels: DataFrame, keys: DataFrame, least: int = 2) -> DataFrame:
    """Rows that share a key take its most frequent label other than noise; the lesser label wins ties. keys: (row_id, key)."""
    rows = labels.join(keys.filter("key is not null"), "row_id", "left")
    known = rows.filter("key is not null")
    groups = known.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    counts = known.filter(F.col("label") != NOISE).groupBy("key", "label").agg(F.count("*").alias("k"))
    best = counts.groupBy("key").agg(F.max(F.struct("k", (-F.col("label")).alias("neg"))).alias("b")).select("key", (-F.col("b.neg")).alias("to"))
    return rows.join(best.join(groups, "key", "left_semi"), "key", "left").select("row_id", F.coalesce("to", "label").alias("label"))


def densify(labels: DataFrame) -> DataFrame:
    """Labels 0, 1, 2 ... in their order; noise stays. The ranks are made over distinct labels."""
    names = labels.filter(F.col("label") != NOISE).select("label").distinct()
    ranks = _ranked(names, [F.col("label")]).select("label", (F.col("rank") - 1).alias("to"))
    return labels.join(ranks, "label", "left").select("row_id", F.coalesce("to", F.lit(NOISE)).alias("label"))


def expand(batch: DataFrame, labels: DataFrame) -> DataFrame:
    """A label for every row of the batch: rows without one are noise."""
    return batch.select("row_id").join(labels, "row_id", "left").select("row_id", F.coalesce("label", F.lit(NOISE)).alias("label"))


def fresh_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of more, as clusters of their own, after the labels in use."""
    top = labels.agg(F.max("label")).first()[0]
    ranked = _ranked(more.select("row_id"), [F.col("row_id")])
    return labels.unionByName(ranked.select("row_id", (F.lit((top if top is not None else -1)) + F.col("rank")).alias("label")))
