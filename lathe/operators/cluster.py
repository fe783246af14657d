"""Clustering operators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..sources import settled
from . import terms
from .vectors import knn, matrix, modularity, truncated_svd

#: Rows that average linkage holds at once, and density clustering; larger batches are sampled first.
MAX_DENSE = 6000
MAX_DENSITY = 8000


def k_for(n: int) -> int:
    return max(2, min(int(math.sqrt(n / 2)), 100))


def k_for_large(n: int, most: int = 400) -> int:
    return max(2, min(int(2 * math.sqrt(n / 2)), most))


def k_and_noise(rel: float) -> tuple[int, float]:
    """Number of clusters and share of noise from the distance contrast."""
    t = min(max((rel - 0.1) / 0.22, 0.0), 1.0)
    return round(40 + 180 * t), 0.25 + 0.15 * t


def kmeans(points: DataFrame, k: int, seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """(row_id, label) of the run of least cost."""
    data = settled(points).select("row_id", array_to_vector("v").alias("features"))
    runs = [KMeans(k=k, seed=s, maxIter=30).fit(data) for s in seeds]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("row_id", F.col("prediction").cast("long").alias("label"))


def average_linkage(x: np.ndarray) -> np.ndarray:
    """Merges (a, b, distance, size) by nearest-neighbour chains over cosine distances, sorted by distance."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    n = len(x)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            row[a] = np.inf
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((min(a, b), max(a, b), d[a, b], size[a] + size[b]))
        keep, gone = min(a, b), max(a, b)
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[keep], d[:, keep] = new, new
        d[keep, keep] = np.inf
        size[keep] += size[gone]
        alive[gone] = False
    out = np.array(merges).reshape(-1, 4)
    return out[np.argsort(out[:, 2], kind="stable")]


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of k clusters: the first n - k merges, joined through representatives."""
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, *_ in merges[: max(0, n - k)]:
        x, y = find(int(a)), find(int(b))
        parent[max(x, y)] = min(x, y)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def _dense(points: DataFrame, labels_of, cuts: tuple[int, ...] = (0,)) -> DataFrame:
    """(row_id, k, label): one group of a bounded number of rows, in one task; labels_of gives one labelling for each cut."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("row_id").to_numpy()
        order = np.argsort(ids)
        found = labels_of(matrix(t.column("v"))[order])
        return pa.table({"row_id": np.tile(ids[order], len(cuts)), "k": np.repeat(np.array(cuts, np.int32), len(ids)), "label": np.concatenate(found).astype(np.int64)})

    return points.select("row_id", "v", F.lit(0).alias("g")).groupBy("g").applyInArrow(lambda t: run(t), "row_id long, k int, label long")


def sample_rows(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows by the order of a hash: the same ones whatever the partitions."""
    return points.orderBy(fn.digest(F.col("row_id"), F.lit(seed)), "row_id").limit(k)


def propagate(points: DataFrame, labelled: DataFrame, k: int = 5) -> DataFrame:
    """Rows without a label take the most frequent one of their k nearest labelled rows; the lesser wins ties."""
    return propagate_cuts(points, labelled.withColumn("k", F.lit(0)), k).select("row_id", "label")


def propagate_cuts(points: DataFrame, labelled: DataFrame, k: int = 5) -> DataFrame:
    """propagate for several labellings (row_id, k, label) of the same rows, with one search for neighbours."""
    ids = labelled.select("row_id").distinct()
    known = points.join(ids, "row_id", "left_semi").select("row_id", "v")
    rest = points.join(ids, "row_id", "left_anti")
    near = knn(known, k, queries=rest).join(labelled.select(F.col("row_id").alias("dst"), "k", "label"), "dst")
    counts = near.groupBy("src", "k", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("src", "k").agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("b"))
    return labelled.select("row_id", "k", "label").unionByName(best.select(F.col("src").alias("row_id"), "k", (-F.col("b.neg")).alias("label")))


def linkage_cuts(points: DataFrame, cuts: tuple[int, ...], most: int = MAX_DENSE) -> DataFrame:
    """(row_id, k, label): cuts of one tree of average linkage; above `most` rows, of a sample whose labels are propagated."""

    def of(x: np.ndarray) -> list[np.ndarray]:
        merges = average_linkage(x)
        return [cut(merges, len(x), min(k, len(x))) for k in cuts]

    if points.count() <= most:
        return _dense(points, of, cuts)
    found = settled(_dense(sample_rows(points, most), of, cuts))
    return propagate_cuts(points, found)


def linkage_labels(points: DataFrame, k: int, most: int = MAX_DENSE) -> DataFrame:
    """Average linkage cut at k."""
    return linkage_cuts(points, (k,), most).select("row_id", "label")


def hdbscan(x: np.ndarray, min_cluster_size: int = 25, min_samples: int = 15) -> np.ndarray:
    """Density clustering: mutual reachability tree, condensed by cluster size, selected by excess of mass."""
    n = len(x)
    if n <= min_cluster_size:
        return np.full(n, -1)
    square = (x * x).sum(1)
    reach = x @ x.T  # one matrix, changed in place: distances, then mutual reachability
    reach *= -2
    reach += square[:, None]
    reach += square
    np.sqrt(np.maximum(reach, 0, out=reach), out=reach)
    core = np.array([np.partition(r, min(min_samples, n - 1))[min(min_samples, n - 1)] for r in reach])
    np.maximum(np.maximum(reach, core[:, None], out=reach), core, out=reach)
    best, source, inside = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    edges = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[j], source[j], j))
        inside[j] = True
        closer = reach[j] < best
        best[closer], source[closer] = reach[j][closer], j
    edges.sort()
    # binary tree of merges: node n + i joins left[i] and right[i] at height[i]
    top, parent = list(range(n)), list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right, height, size = [], [], [], [1] * n
    for h, a, b in edges:
        a, b = find(a), find(b)
        left.append(top[a])
        right.append(top[b])
        height.append(max(h, 1e-12))
        size.append(size[top[a]] + size[top[b]])
        parent[b] = a
        top[a] = n + len(left) - 1

    def leaves(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack += [left[i - n], right[i - n]]
        return out

    # condensed clusters: (birth, stability, children, points)
    birth, stability, children, root = [0.0], [0.0], [[]], [n + len(left) - 1]
    work = [(root[0], 0)]
    while work:
        node, c = work.pop()
        if node < n:
            continue
        lam, l, r = 1 / height[node - n], left[node - n], right[node - n]
        big = [s for s in (l, r) if size[s] >= min_cluster_size]
        if len(big) == 2:
            stability[c] += (lam - birth[c]) * size[node]
            for s in big:
                birth.append(lam)
                stability.append(0.0)
                children.append([])
                root.append(s)
                children[c].append(len(birth) - 1)
                work.append((s, len(birth) - 1))
        else:
            for s in (l, r):
                if size[s] < min_cluster_size:
                    stability[c] += (lam - birth[c]) * size[s]
            work += [(s, c) for s in big]
    chosen: set[int] = set()
    total = stability[:]
    for c in reversed(range(1, len(birth))):
        below = sum(total[k] for k in children[c])
        if children[c] and below > stability[c]:
            total[c] = below
        else:
            chosen.add(c)
    for c in range(1, len(birth)):  # a chosen cluster hides those below it
        if c in chosen:
            stack = children[c][:]
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack += children[k]
    out = np.full(n, -1)
    for i, c in enumerate(sorted(chosen)):
        out[leaves(root[c])] = i
    return out


def hdbscan_labels(points: DataFrame, min_cluster_size: int = 25, min_samples: int = 15, most: int = MAX_DENSITY) -> DataFrame:
    def of(x: np.ndarray) -> list[np.ndarray]:
        return [hdbscan(x, min_cluster_size, min_samples)]

    if points.count() <= most:
        return _dense(points, of).select("row_id", "label")
    return propagate(points, settled(_dense(sample_rows(points, most), of).select("row_id", "label")))


CANDIDATES = (24, 32, 40, 48, 60, 75, 95, 120)


def best_cut(points: DataFrame, edges: DataFrame, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """Average linkage at the number of clusters of the highest modularity; the lesser number wins ties.

    One tree gives all cuts, and one job scores them.
    """
    n = points.count()
    tried = tuple(k for k in candidates if k < n) or tuple(sorted({max(2, n // d) for d in (25, 10, 4)}))
    cuts = settled(linkage_cuts(points, tried))
    score = modularity(edges, cuts, "k").select("k", F.round(F.coalesce("modularity", F.lit(0.0)), 12).alias("m"))
    best = score.agg(F.max(F.struct("m", (-F.col("k")).alias("neg"))).alias("b")).first()["b"]
    return cuts.filter(F.col("k") == -best["neg"]).select("row_id", "label")


def fallback(full: DataFrame, rank: int = 192) -> DataFrame:
    """(row_id, label): k-means of TF-IDF directions, for callers who want labels whatever happens. full: (row_id, text)."""
    n = full.count()
    counts = settled(terms.bigram_counts(full, fn.analyzer_tokens(F.col("text"))))
    vocabulary = terms.top_vocabulary(terms.prune(terms.document_frequency(counts), n, 1, 1.0), 60_000)
    weights = settled(terms.tfidf(counts, vocabulary, n, True))
    if weights.isEmpty():
        return full.select("row_id", F.lit(0).cast("long").alias("label"))
    points = truncated_svd(weights, max(1, min(rank, n - 1)))
    return kmeans(points, max(2, min(60, n // 40)), (0,))
