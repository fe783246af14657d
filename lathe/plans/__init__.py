"""The three presets: from a batch of texts to (row_id, cluster_id)."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import cluster, labels, terms, vectors
from ..sources import NOISE, reject_empty, settled


@dataclass(frozen=True)
class Settings:
    """Parameters of the third preset. Those marked OURS have no published value."""

    time_budget: float | None = None
    large_batch: int = 8000
    large_clusters: int = 100
    large_noise: float = 0.2
    min_cluster_size: int = 25
    min_samples: int = 15
    reduce_mode: str = "svd"
    reduce_dim: int = 80
    spectral_knn: int = 25
    noise_mode: str = "singleton"
    noise_bucket: float = 0.5
    noise_reclaim: float = 0.0
    extra_noise: float = 0.0
    small_cluster_mode: str = "noise"
    k_candidates: tuple[int, ...] = cluster.CANDIDATES
    w_lsa: float = 1.0
    w_ppmi: float = 1.2
    w_distilled: float = 0.5
    lsa_dim: int = 192
    ppmi_dim: int = 128
    ppmi_features: int = 2000  # OURS
    char_weight: float = 0.35  # OURS
    drop_components: int = 1  # OURS
    smooth_k: int = 12  # OURS
    smooth_alpha: float = 0.2  # OURS
    merge_scripts: bool = True  # OURS
    merge_mutual: bool = True  # OURS
    vote_duplicates: bool = True  # OURS
    title: dict = field(default_factory=dict)  # OURS: overrides for batches of titles

    def of(self, titles: bool) -> Settings:
        return Settings(**{**self.__dict__, **self.title, "title": {}}) if titles and self.title else self


class Clock:
    """Skips optional stages once a share of the budget is spent; never without a budget."""

    def __init__(self, budget: float | None):
        self.budget, self.begun = budget, time.monotonic()

    def allows(self, share: float) -> bool:
        return self.budget is None or time.monotonic() - self.begun < share * self.budget


def profile(batch: DataFrame) -> DataFrame:
    """One row: median clean length, shares of texts with a line feed and with a link, and whether they look like titles.

    OURS: titles have a median below 120 characters and next to no line feeds or links.
    """
    size = F.length(fn.clean_spaced(F.col("text")))
    link = F.lower("text").rlike("http|www\\.")
    rows = batch.select(size.alias("size"), F.col("text").contains("\n").cast("int").alias("nl"), link.cast("int").alias("url"))
    long = F.when(F.col("size") >= 40, F.col("size"))
    out = rows.agg(
        F.count("*").alias("n"),
        F.when(F.count(long) >= 50, F.median(long)).otherwise(F.median("size")).cast("double").alias("median_length"),
        F.avg("nl").alias("line_feeds"), F.avg("url").alias("links"),
    )
    return out.withColumn("is_titles", (F.col("median_length") < 120) & (F.col("line_feeds") < 0.02) & (F.col("links") < 0.02))


def _split(batch: DataFrame, clean: Column) -> tuple[DataFrame, int, int]:
    """Texts that are not empty after cleaning, how many all are, and how many these are."""
    full = settled(batch.select("row_id", clean.alias("text")).filter(F.length("text") > 0))
    return full, reject_empty(batch).count(), full.count()


def tiny(batch: DataFrame, n: int, filled: int, least: int) -> DataFrame | None:
    """Batches too small to cluster: one label for all, or each row its own (three and more rows of a kind apart)."""
    if least == 2 and (n < 2 or filled < 2):
        return batch.select("row_id", F.lit(0).cast("long").alias("label"))
    if least == 3 and n < 3:
        return labels.densify(batch.select("row_id", F.col("row_id").alias("label")))
    if least == 3 and filled < 3:
        return batch.select("row_id", F.lit(0).cast("long").alias("label"))
    return None


def tfidf_features(full: DataFrame, n: int, top: int, min_df: int, max_df: float, sublinear: bool) -> DataFrame:
    counts = settled(terms.bigram_counts(full, fn.analyzer_tokens(F.col("text"))))
    vocabulary = terms.top_vocabulary(terms.prune(terms.document_frequency(counts), n, min_df, max_df), top)
    return settled(terms.tfidf(counts, vocabulary, n, sublinear))


def bm25_union(full: DataFrame, n: int, words: tuple[int, int, float], chars: tuple[int, int, float], char_weight: float) -> DataFrame:
    """Word (1, 2)-grams and character n-grams side by side, both as BM25. words, chars: (vocabulary, min_df, max_df)."""
    blocks = []
    for name, counts, (top, low, high), factor in (
        ("w", terms.bigram_counts(full, fn.analyzer_tokens(F.col("text"))), words, 1.0),
        ("c", terms.term_counts(full.select("row_id", F.lower("text").alias("text")), fn.char_ngrams(F.col("text"))), chars, char_weight),
    ):
        counts = settled(counts)
        vocabulary = settled(terms.top_vocabulary(terms.prune(terms.document_frequency(counts), n, low, high), top))
        blocks.append((name, terms.bm25(counts, vocabulary, n), factor))
    return settled(terms.feature_union(*blocks))


def hashed_features(full: DataFrame, dim: int) -> DataFrame:
    """Hashed counts of word (1, 2)-grams and of character n-grams, damped and projected."""
    clean = full.select("row_id", fn.clean_hash(F.col("text")).alias("text"))
    words = terms.hashed_counts(terms.bigram_counts(clean, fn.analyzer_tokens(F.col("text"))), 8192)
    chars = terms.hashed_counts(terms.term_counts(clean, fn.char_ngrams(F.col("text"))), 4096)
    return vectors.random_projection(terms.log_damped(terms.feature_union(("w", words, 1.0), ("c", chars, 1.0))), dim)


def preset_a(batch: DataFrame, rank: int = 50) -> DataFrame:
    """TF-IDF and k-means. OURS: k-means runs on the leading singular directions of the TF-IDF rows."""
    full, n, filled = _split(batch, fn.clean_joined(F.col("text")))
    if (few := tiny(batch, n, filled, 2)) is not None:
        return few
    weights = tfidf_features(full, filled, 50_000, 2, 0.95, False)
    if weights.isEmpty():
        return batch.select("row_id", F.lit(0).cast("long").alias("label"))
    points = vectors.truncated_svd(weights, min(rank, max(2, filled - 1)))
    return labels.expand(batch, cluster.kmeans(points, cluster.k_for(filled)))


def _ppmi_points(full: DataFrame, n: int, top: int, dim: int, width: int, drop: int, pooling: str = "idf") -> DataFrame:
    """Documents as weighted sums of their words' vectors from windowed co-occurrence.

    pooling: idf (of every occurrence), tfidf (log frequency and smooth idf), or sif (rare words more).
    """
    words = fn.analyzer_tokens(F.col("text"))
    counts = settled(terms.term_counts(full, words))
    vocabulary = settled(terms.top_vocabulary(terms.prune(terms.document_frequency(counts), n, 2, 0.5), top))
    pairs = settled(terms.window_cooccurrence(full, words, width, vocabulary.select("term")))
    weights = settled(terms.ppmi(pairs).select(F.col("t1").alias("row_id"), F.col("t2").alias("term"), "w"))
    word_vectors = settled(vectors.truncated_svd(weights, dim).withColumnRenamed("row_id", "term"))
    joined = counts.join(vocabulary.select("term", "df", "cf"), "term")
    if pooling == "sif":
        total = float(vocabulary.agg(F.sum("cf")).first()[0] or 1)
        weight = F.col("n") * 0.001 / (0.001 + F.col("cf") / total)
    elif pooling == "tfidf":
        weight = (1 + F.log("n")) * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)
    else:
        weight = F.log(F.lit(float(n)) / (1 + F.col("df"))) * F.col("n")
    return vectors.remove_top_components(settled(vectors.pooled(joined, word_vectors, weight)), drop)


def _title_words(titles: DataFrame, n: int, dim: int = 96) -> DataFrame | None:
    """Documents as idf sums of the vectors of their frequent words, from words that share documents; none for few words."""
    counts = settled(terms.term_counts(titles, fn.word_tokens(F.col("text"))))
    vocabulary = settled(terms.title_vocabulary(terms.document_frequency(counts)))
    if vocabulary.isEmpty():
        return None
    held = settled(counts.join(vocabulary.select("term", "df"), "term"))
    weights = settled(terms.ppmi(terms.document_cooccurrence(held)).select(F.col("t1").alias("row_id"), F.col("t2").alias("term"), "w"))
    if weights.isEmpty():
        return None
    word_vectors = settled(vectors.truncated_svd(weights, min(dim, vocabulary.count() - 1)).withColumnRenamed("row_id", "term"))
    return vectors.pooled(held, word_vectors, F.log(F.lit(float(n)) / (1 + F.col("df"))))


def _aligned(full: DataFrame, dim: int, points: DataFrame) -> DataFrame:
    """A vector for every row: zeros, slightly moved, where the features found nothing."""
    zero, points = F.array(*[F.lit(0.0)] * dim), settled(points)
    rows = full.select("row_id").join(points, "row_id", "left")
    return vectors.jitter_empty(rows.select("row_id", F.coalesce("v", zero).alias("v"))).select("row_id", vectors.unit(F.col("v")).alias("v"))


def _spectral(points: DataFrame, n: int, dim: int, k: int) -> DataFrame | None:
    """Unit rows of the spectral embedding of the neighbour graph; none for small batches."""
    if n < 50 or dim < 2:
        return None
    found = vectors.spectral(vectors.symmetric(settled(vectors.knn(points, k))), min(dim, n - 2))
    return settled(found.select("row_id", vectors.unit(F.col("v")).alias("v")))


def reduced(points: DataFrame, n: int, mode: str, dim: int, k: int) -> DataFrame:
    """`spectral`, which falls back to `svd` where it can't be had; any other mode leaves points as they are."""
    if mode == "spectral":
        if (found := _spectral(points, n, dim, k)) is not None:
            return found
        mode = "svd"
    row = points.select(F.size("v").alias("width")).first()
    dim = min(dim, row["width"] - 1, n - 1) if row else 0
    if mode != "svd" or dim < 2:
        return points
    cells = points.select("row_id", F.posexplode("v").alias("term", "w"))
    return settled(vectors.truncated_svd(cells, dim).select("row_id", vectors.unit(F.col("v")).alias("v")))


def _large(full: DataFrame, batch: DataFrame, filled: int, clusters: int, noise: float, near: int = 0, voted: bool = False) -> DataFrame:
    """Hashed features, k-means, and rows far away as singletons: from their centre, or from their near-th neighbour; then the vote of near-duplicates."""
    counts = terms.bigram_counts(full, fn.analyzer_tokens(F.col("text")))
    points = vectors.random_projection(terms.log_damped(terms.hashed_counts(counts, 32_768)), 64)
    points = settled(_aligned(full, 64, points))
    found = settled(cluster.kmeans(points, min(clusters, cluster.k_for_large(filled)), (42,)))
    if near:
        score = vectors.kth_distance(vectors.knn(points, near, "euclidean"))
    else:
        own = points.join(found, "row_id").join(labels.centroids(points, found), "label")
        score = own.select("row_id", (1 - vectors.dot(F.col("v"), F.col("c"))).alias("score"))
    score = _latin_only(score, _scripts(full))
    found = settled(labels.outliers_to_singletons(found, score, noise))
    if voted:
        found = _voted(found, full)
    return labels.expand(batch, labels.densify(found))


def _scripts(full: DataFrame) -> DataFrame:
    return settled(full.select("row_id", fn.script_id(F.col("text")).alias("script")))


def _latin_only(score: DataFrame, scripts: DataFrame) -> DataFrame:
    """Scores below 0, which exempt, for rows of a script class."""
    return score.join(scripts, "row_id").select("row_id", F.when(F.col("script") > 0, -1.0).otherwise(F.col("score")).alias("score"))


def _voted(found: DataFrame, full: DataFrame) -> DataFrame:
    return settled(labels.vote(found, settled(full.select("row_id", fn.prefix_key(F.col("text")).alias("key")))))


def _joined_blocks(*blocks: tuple[DataFrame, float]) -> DataFrame:
    """Blocks end to end, as unit rows."""
    both = vectors.concat_blocks(*blocks)
    return settled(both.select("row_id", vectors.unit(F.col("v")).alias("v")))


def title_path(full: DataFrame, filled: int, clock: Clock, lsa: int = 192, ppmi: int = 96, sample: int = cluster.MAX_DENSE) -> DataFrame | None:
    """(row_id, label) of a batch of titles: BM25 union, word vectors of shared documents, hashed block; strong smoothing; linkage.

    None if no block has features. Above `sample` rows all but the hashed block are made for a sample, and
    the others are labelled by their neighbours in that block.
    """
    titles = settled(full.select("row_id", fn.clean_title(F.col("text")).alias("text")))
    part = settled(cluster.sample_rows(titles, sample)) if filled > sample else titles
    n = min(filled, sample)
    blocks = []
    weights = bm25_union(part, n, (20_000, 2, 0.95), (8000, 2, 0.95), 0.35)
    if not weights.isEmpty():
        blocks.append((_aligned(part, (dim := min(lsa, n - 1)), vectors.truncated_svd(weights, dim)), 1.0))
    words = _title_words(part, n, ppmi) if clock.allows(0.45) else None
    if words is not None:
        width = words.select(F.size("v").alias("k")).first()
        blocks.append((_aligned(part, width["k"] if width else ppmi, words), 1.0))
    hashed = settled(_aligned(titles, 24, hashed_features(titles, 24))) if clock.allows(0.62) else None
    if hashed is not None:
        blocks.append((hashed, 3.0))
    if not blocks:
        return None
    points = _joined_blocks(*blocks)
    if clock.allows(0.62):
        points = settled(vectors.smooth(points, settled(vectors.knn(points, 20)), 0.6, 4))
    found = settled(cluster.linkage_labels(points, min(100, max(2, n // 2))))
    if filled <= sample:
        score = vectors.kth_distance(vectors.knn(points, 12))
    else:
        if hashed is None:
            return None
        known = hashed.join(part.select("row_id"), "row_id", "left_semi")
        score = vectors.kth_distance(vectors.knn(known, 5, queries=hashed))
        found = settled(cluster.propagate(hashed, found))
    return labels.outliers_to_singletons(found, score, 0.3)


def preset_b(batch: DataFrame, large: int = 15_000, lsa: int = 192, ppmi: int = 128, sample: int = cluster.MAX_DENSE, time_budget: float | None = None, titles: bool | None = None) -> DataFrame:
    """Several feature blocks, average linkage, merges and singletons for outliers; titles have a path of their own.

    OURS: a hashed projection in place of the tables that are not available. titles: what the profile says, if not given.
    """
    full, n, filled = _split(batch, fn.clean_spaced(F.col("text")))
    if (few := tiny(batch, n, filled, 3)) is not None:
        return few
    clock = Clock(time_budget)
    if filled > large:
        return _large(full, batch, filled, 400, 0.2, near=12)
    p = profile(batch).first()
    titles = p["is_titles"] if titles is None else titles
    mid = 230 < p["median_length"] < 330
    if titles:
        raw = batch.join(full.select("row_id"), "row_id", "left_semi").select("row_id", "text")
        if (found := title_path(raw, filled, clock, lsa, min(ppmi, 96), sample)) is not None:
            return labels.expand(batch, labels.densify(found))
    weights = tfidf_features(full, filled, 100_000, 2 if filled >= 50 else 1, 0.5, True)
    if weights.isEmpty():
        return batch.select("row_id", F.lit(0).cast("long").alias("label"))
    lsa_points = settled(_aligned(full, lsa, vectors.truncated_svd(weights, lsa)))
    share = vectors.explained_variance(lsa_points)
    concentrated, diffuse = not titles and share > 0.045, share < 0.03
    drop = 1 if titles else 4 if concentrated else 1 if diffuse else 3 if mid else 2
    words = settled(_aligned(full, ppmi, _ppmi_points(full, filled, 2000, ppmi, 6, drop, "sif" if titles else "tfidf")))
    if concentrated:
        lsa_points = settled(vectors.remove_top_components(lsa_points, 1).select("row_id", vectors.unit(F.col("v")).alias("v")))
    hashed = _aligned(full, 48, hashed_features(full, 48))
    points = _joined_blocks((words, 1.0), (lsa_points, 1.0 if titles or concentrated else 0.8 if diffuse else 0.94), (hashed, 1.0))
    if clock.allows(0.45):
        k, alpha = (12, 0.2) if mid else (8, 0.1)
        points = settled(vectors.smooth(points, settled(vectors.knn(points, k)), alpha, 1))
    if not titles and clock.allows(0.55):
        wide, narrow = (36, 16) if mid else (28, 12)
        more = _spectral(points, filled, wide if concentrated else narrow if diffuse else 32, 15)
        if more is not None:
            points = _joined_blocks((points, 1.0), (more, 1.0))
    edges = settled(vectors.knn(points, 20 if mid else 12))
    k, noise = (25, 0.9) if titles else cluster.k_and_noise(vectors.contrast(points, edges).first()["rel"] or 0.0)
    if mid and filled <= sample:
        k, noise = 28, 0.25
    found = settled(cluster.linkage_labels(points, min(k, max(2, filled // 2)), sample))
    scripts = _scripts(full)
    found = settled(labels.merge_scripts(found, scripts))
    if titles:
        found = labels.refine(points, found, 2)
    elif diffuse:
        found = settled(labels.merge_most_similar(labels.cluster_weights(full, found, fn.analyzer_tokens(F.col("text"))), found))
    score = settled(_latin_only(vectors.kth_distance(edges), scripts))
    if titles or diffuse:
        safe = found.join(labels.protected(points, found).select("label"), "label", "left_semi").select("row_id", F.lit(True).alias("safe"))
        score = score.join(safe, "row_id", "left").select("row_id", F.when(F.col("safe"), -1.0).otherwise(F.col("score")).alias("score"))
    found = settled(labels.outliers_to_singletons(found, score, noise))
    if not titles and not mid:
        found = settled(labels.reassign_small(points, found))
        found = settled(labels.merge_mutual(points, found, 0.8, 1, 1))
        found = settled(labels.merge_mutual(points, found, 0.86, 5, 4))
    return labels.expand(batch, labels.densify(found))


def preset_c(batch: DataFrame, settings: Settings = Settings(), lsa: int | None = None) -> DataFrame:
    """Density clustering with linkage as the second choice, then the label operators by settings. lsa: one width for both blocks."""
    full, n, filled = _split(batch, fn.clean_post(F.col("text")))
    if (few := tiny(batch, n, filled, 3)) is not None:
        return few
    titles = bool(profile(batch).first()["is_titles"])
    s = settings.of(titles)
    clock = Clock(s.time_budget)
    if filled > s.large_batch:
        return _large(full, batch, filled, s.large_clusters, s.large_noise, voted=s.vote_duplicates)
    lowered = settled(full.select("row_id", F.lower("text").alias("text")))
    weights = bm25_union(lowered, filled, (60_000, 2, 0.5), (20_000, 3, 0.5), s.char_weight)
    if weights.isEmpty():
        return batch.select("row_id", F.lit(0).cast("long").alias("label"))
    dims = (lsa or s.lsa_dim, min(lsa or s.ppmi_dim, s.ppmi_dim))
    blocks = [(_aligned(full, dims[0], vectors.truncated_svd(weights, dims[0])), s.w_lsa)]
    if clock.allows(0.55):
        blocks.append((_aligned(full, dims[1], _ppmi_points(lowered, filled, s.ppmi_features, dims[1], 25 if titles else 10, s.drop_components)), s.w_ppmi))
    blocks.append((_aligned(full, 48, hashed_features(full, 48)), s.w_distilled))
    points = _joined_blocks(*blocks)
    if clock.allows(0.7):
        points = settled(vectors.smooth(points, settled(vectors.knn(points, s.smooth_k)), s.smooth_alpha, 1))
    if clock.allows(0.78):
        points = reduced(points, filled, s.reduce_mode, s.reduce_dim, s.spectral_knn)
    found = settled(cluster.hdbscan_labels(points, s.min_cluster_size, s.min_samples))
    if found.filter(F.col("label") != NOISE).count() < 0.2 * filled:
        found = settled(cluster.best_cut(points, settled(vectors.symmetric(vectors.knn(points, s.spectral_knn))), s.k_candidates))
    scripts = _scripts(full)
    if s.merge_scripts:
        found = settled(labels.merge_scripts(found, scripts, 0.02, 0.45))
    found = settled(labels.small_clusters(points, found, s.min_cluster_size, s.small_cluster_mode))
    if s.merge_mutual and clock.allows(0.95):
        found = settled(labels.merge_mutual(points, found, 0.85, 60, 3))
    score = settled(labels.combined_score(points, found, vectors.kth_distance(vectors.knn(points, 12))))
    if s.extra_noise:
        found = settled(labels.extra_noise(found, score, s.extra_noise, scripts.filter("script > 0")))
    found = settled(labels.reclaim(points, found, s.noise_reclaim)) if s.noise_reclaim else found
    found = settled(labels.noise_policy(points, found, score, s.noise_mode, s.noise_bucket))
    if s.vote_duplicates:
        found = _voted(found, full)
    return labels.expand(batch, labels.densify(found))


def with_fallback(preset):
    """A preset that answers whatever happens: any error of it gives the labels of the fallback clusterer instead.

    For callers who must answer; an error is logged, but not raised, so nothing else here uses it.
    """

    def run(batch: DataFrame, *args, **kwargs) -> DataFrame:
        try:
            return preset(batch, *args, **kwargs)
        except Exception:
            logging.getLogger(__name__).exception("preset failed; labels come from the fallback clusterer")
            full, _, filled = _split(batch, fn.clean_spaced(F.col("text")))
            if filled < 2:
                return batch.select("row_id", F.lit(0).cast("long").alias("label"))
            return labels.expand(batch, cluster.fallback(full))

    return run


PRESETS = {"a": preset_a, "b": preset_b, "c": preset_c}
