"""Dense vectors: neighbours, graphs, smoothing, reduction and pooling. Tables are (row_id, v ARRAY<DOUBLE>)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import functions as fn
from ..sources import settled, small_batches

#: Rows of one side of a block product, so that a task holds a bounded matrix; bytes of a side of all
#: blocks that meet in one task, which are sent to it; pairs of sides that there are if there is work for them.
BLOCK = 4096
SIDE = 96 << 20
SHARES = 32
#: Bytes of one dense matrix over the terms of a vocabulary, or the rows of a batch's graph, and its terms,
#: that the driver and every task may hold; what has more stays distributed.
DENSE_BYTES = 256 << 20
MAX_TERMS = 500_000
#: Rows of a graph whose dense columns the driver and every task may hold: 36 columns of them are 600 MB.
MAX_ROWS = 2_000_000
#: Bytes of a matrix that the driver may hold, and tasks in slabs of columns.
SLABS_BYTES = 1 << 30
#: Bytes of the products of entries that a task holds before it adds them up.
PIECE = 8 << 20
#: Tasks of a product whose every task may send back a matrix over all terms.
SQUARED = 32


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as one array."""
    n = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.array(flat.to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length 1; zeros stay. The length is bound by an outer lambda, so that it is worked out once and not for each element."""
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))[0]


class Packed:
    """Points as few rows, each of many ids and vectors as bytes, in the shared folder."""

    def __init__(self, points: DataFrame):
        spark = points.sparkSession
        small_batches(spark)

        def run(batches):
            part, held, n, k = TaskContext.get().partitionId() << 32, [], 0, 0

            def row(ids, x):
                nonlocal k
                k += 1
                return pa.RecordBatch.from_arrays([pa.array([part + k]), pa.array([len(ids)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["chunk", "n", "width", "ids", "vs"])

            for b in batches:
                if b.num_rows:
                    held.append((b.column(0).to_numpy(), matrix(b.column(1))))
                    n += b.num_rows
                if n >= BLOCK or n and n * held[0][1].shape[1] * 8 >= PIECE:
                    yield row(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
            if held:
                yield row(*map(np.concatenate, zip(*held, strict=True)))

        rows = points.select(F.col("row_id").cast("long").alias("row_id"), "v")
        self.rows = settled(rows.mapInArrow(run, "chunk long, n int, width int, ids binary, vs binary"))
        self.chunks = self.rows.select("chunk", "n", "width").orderBy("chunk").collect()
        self.n, self.width = sum(r["n"] for r in self.chunks), max([0, *(r["width"] for r in self.chunks)])

    def dealt(self, name: str, parts: int) -> DataFrame:
        """Rows with the number of their part, of about as many points each."""
        rows, at = [], 0
        for r in self.chunks:
            rows.append((r["chunk"], min(parts - 1, at * parts // max(1, self.n))))
            at += r["n"]
        own = self.rows.sparkSession.createDataFrame(rows, f"chunk long, {name} int")
        return self.rows.join(F.broadcast(own), "chunk").select(name, "ids", "vs")


def _points(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of packed rows: small ones joined, none of more than BLOCK rows."""
    out, held, n = [], [], 0
    for ids, x in zip(*([v.as_buffer() for v in t.column(c)] for c in ("ids", "vs")), strict=True):
        i = np.frombuffer(ids, np.int64)
        held.append((i, np.frombuffer(x, float).reshape(len(i), -1)))
        n += len(i)
        if n >= BLOCK // 2:
            out.append(held)
            held, n = [], 0
    whole = [tuple(map(np.concatenate, zip(*h, strict=True))) if len(h) > 1 else h[0] for h in [*out, *([held] if held else [])]]
    return [(i[at : at + BLOCK], x[at : at + BLOCK]) for i, x in whole for at in range(0, len(i), BLOCK)]


def _nearest(left: list, right: list, k: int, cosine: bool, apart: bool) -> list[tuple]:
    """(src, dst, dist) arrays: for each row of left the k nearest of right, lesser ids first among equals.

    Scores of all pairs are made in single precision; every pair that may be among the nearest, by a
    bound of its error, is worked out again in full. apart: a row is no neighbour of its own id.
    """

    def usable(ids: np.ndarray, x: np.ndarray) -> tuple:
        size = (x * x).sum(1)
        if not (good := np.isfinite(size)).all():
            ids, x, size = ids[good], x[good], size[good]
        return ids, x / np.maximum(np.sqrt(size), 1e-300)[:, None] if cosine else x, np.ones(len(ids)) if cosine else size

    left, right = ([p for p in (usable(*c) for c in side) if len(p[0])] for side in (left, right))
    if not left or not right:
        return []
    most = max(c[2].max() for side in (left, right) for c in side)
    kind = np.float32 if cosine or 1e-20 < most < 1e20 else float
    # a score is a product of the longer rows below; its error is under their width in units, times the largest terms
    slack = (left[0][1].shape[1] + 16) * 2 * np.finfo(kind).eps * 4 * most + 1e-11
    # distances fall as scores rise: cosine a b, else 2 a b - b b
    sides = [x.astype(kind) if cosine else np.hstack([x, size[:, None]]).astype(kind) for _, x, size in right]

    def exact(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(r)), max(1, PIECE // (8 * a.shape[1]))
        for i in range(0, len(r), step):
            x, y = a[r[i : i + step]], b[c[i : i + step]]
            out[i : i + step] = 1 - np.einsum("ij,ij->i", x, y) if cosine else np.sqrt(((x - y) ** 2).sum(1))
        return np.round(out, 12)

    found, room = [], np.empty(1024 * max(len(x) for x in sides), kind)
    for ids, a, own in ((i[at : at + 1024], x[at : at + 1024], s[at : at + 1024]) for i, x, s in left for at in range(0, len(i), 1024)):
        m = len(ids)
        q = a.astype(kind) if cosine else np.hstack([2 * a, np.full((m, 1), -1.0)]).astype(kind)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # row, id, distance
        low = np.full(m, -np.inf)
        for (pi, b, _), side in zip(right, sides, strict=True):
            score = np.matmul(q, side.T, out=room[: m * len(side)].reshape(m, len(side)))
            if apart:
                order = np.argsort(pi, kind="stable")
                first, last = (np.searchsorted(pi[order], ids, s) for s in ("left", "right"))
                for r in np.flatnonzero(last > first):
                    score[r, order[first[r] : last[r]]] = -np.inf
            if np.isneginf(low).any():
                bar = np.maximum(low, np.partition(score, -k, axis=1)[:, -k] - 2 * slack) if k < score.shape[1] else low
            else:
                bar = low
            bar = np.maximum(bar.astype(kind), np.finfo(kind).min)
            rows = np.flatnonzero(score.max(1) >= bar)
            if not rows.size:
                continue
            r, c = np.divmod(np.flatnonzero(score[rows] >= bar[rows, None]), score.shape[1])
            r = rows[r]
            dist = exact(a, b, r, c)
            r, i, dist = (np.concatenate(x) for x in zip(best, (r, pi[c], dist), strict=True))
            good = np.isfinite(dist)
            r, i, dist = r[good], i[good], dist[good]
            order = np.lexsort((i, dist, r))
            r, i, dist = r[order], i[order], dist[order]
            first = np.searchsorted(r, np.arange(m))
            keep = np.arange(len(r)) - first[r] < k
            best = [r[keep], i[keep], dist[keep]]
            full = np.bincount(best[0], minlength=m) >= k
            kth = np.zeros(m)
            np.maximum.at(kth, best[0], best[2])
            low = np.where(full, (1 - kth if cosine else own - (kth + 1e-11) ** 2) - slack, -np.inf)
        found.append((ids[best[0]], best[1], best[2]))
    return found


def knn(points: DataFrame, k: int, metric: str = "cosine", queries: DataFrame | None = None, self_too: bool = False) -> DataFrame:
    """Exact nearest neighbours (src, dst, rank, dist); ties go to the lesser dst.

    Both sides are packed and dealt out to parts of bounded size; each pair of parts is met in a task of
    its own, block by block, and sends on k rows for each query. No side is broadcast or collected.
    """
    same = queries is None or queries is points
    p = Packed(points)
    q = p if same else Packed(queries)
    parts = max(1, -(-p.n * p.width * 8 // SIDE))
    # parts of queries are smaller where there are few, so that there are tasks enough
    shares = max(1, -(-q.n * q.width * 8 // SIDE), min(-(-q.n // BLOCK), -(-SHARES // parts)))
    left = q.dealt("qb", shares).select(F.col("qb").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("pb"), F.col("ids").alias("ids"), F.col("vs").alias("vs"))
    right = p.dealt("pb", parts).select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("qb"), F.col("pb").alias("pb"), F.col("ids").alias("ids"), F.col("vs").alias("vs"))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _nearest(_points(left), _points(right), k, metric == "cosine", same and not self_too)
        kinds = (("src", np.int64), ("dst", np.int64), ("dist", float))
        return pa.table({c: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, (c, kind) in enumerate(kinds)})

    found = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(near, "src long, dst long, dist double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "dst", F.col("rank").cast("int").alias("rank"), "dist")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once, with weight 1."""
    pair = edges.filter("src <> dst").select("src", "dst")
    return pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1.0))


def fuzzy_graph(edges: DataFrame, k: int) -> DataFrame:
    """Smooth neighbour weights: exp(-(d - nearest) / sigma), sigma by 32 bisections so that they sum to log2 k; joined by a + b - ab."""
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    rho, target = F.col("near")[0]["dist"], float(np.log2(k))

    def total(sigma: Column) -> Column:
        return F.aggregate("near", F.lit(0.0), lambda s, e: s + F.exp(-F.greatest(e["dist"] - rho, F.lit(0.0)) / sigma))

    start = F.struct(F.lit(1e-6).alias("lo"), F.lit(1e3).alias("hi"))
    ends = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)), start,
        lambda s, _: F.struct(
            F.when(total((s["lo"] + s["hi"]) / 2) > target, s["lo"]).otherwise((s["lo"] + s["hi"]) / 2).alias("lo"),
            F.when(total((s["lo"] + s["hi"]) / 2) > target, (s["lo"] + s["hi"]) / 2).otherwise(s["hi"]).alias("hi"),
        ),
    )
    one = lists.withColumn("sigma", (ends["lo"] + ends["hi"]) / 2).select("src", rho.alias("rho"), "sigma", F.explode("near").alias("e"))
    one = one.select("src", F.col("e.dst").alias("dst"), F.exp(-F.greatest(F.col("e.dist") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("w")).filter("src <> dst")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    a = both.groupBy("src", "dst").agg(F.sum("w").alias("s"), F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0).alias("p"))
    return a.select("src", "dst", (F.col("s") - F.col("p")).alias("w"))


def mean_vectors(rows: DataFrame, key: str, weight: Column | None = None, total: bool = False) -> DataFrame:
    """Weighted mean (or total) of v by key: one vector aggregate, with partial sums before the shuffle."""
    rows = rows.select(key, array_to_vector("v").alias("x"), (F.lit(1.0) if weight is None else weight).alias("w"))
    return rows.groupBy(key).agg(vector_to_array((Summarizer.sum if total else Summarizer.mean)(F.col("x"), F.col("w"))).alias("v"))


def smooth(points: DataFrame, edges: DataFrame, alpha: float = 0.2, rounds: int = 1) -> DataFrame:
    """Points moved toward the (weighted) mean of their neighbours and brought back to unit length."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    links = edges.select("src", "dst", w.alias("w"))
    for _ in range(rounds):
        near = links.join(points.select(F.col("row_id").alias("dst"), "v"), "dst")
        near = mean_vectors(near, "src", F.col("w")).select(F.col("src").alias("row_id"), F.col("v").alias("m"))
        moved = F.zip_with("v", F.coalesce("m", "v"), lambda a, b: a * (1 - alpha) + b * alpha)
        points = points.join(near, "row_id", "left").select("row_id", unit(moved).alias("v"))
    return points


def kth_distance(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.max("dist").alias("score")).withColumnRenamed("src", "row_id")


def contrast(points: DataFrame, edges: DataFrame, sample: int = 1500) -> DataFrame:
    """OURS: 1 - mean neighbour distance / mean distance of pairs in a sample that is fixed by a hash."""
    chosen = points.orderBy(fn.digest(F.col("row_id"), F.lit(0)), "row_id").limit(sample).select("row_id", unit(F.col("v")).alias("v"))
    # the mean over all pairs of unit vectors follows from the length of their mean
    mean = mean_vectors(chosen.withColumn("g", F.lit(0)), "g").select(dot(F.col("v"), F.col("v")).alias("m"))
    n = chosen.agg(F.count("*").alias("n"))
    pairs = mean.crossJoin(n).select((1 - (F.col("m") * F.col("n") * F.col("n") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("far"))
    return edges.agg(F.avg("dist").alias("near")).crossJoin(pairs).select((1 - F.col("near") / F.col("far")).alias("rel"))


def modularity(edges: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """Share of weight inside clusters less a quarter of the expected share. edges hold both directions.

    by: columns that tell several labellings of the rows apart; one row comes of each.
    """
    a, b = (labels.select(*by, F.col("row_id").alias(x), F.col("label").alias(f"l_{x}")) for x in ("src", "dst"))
    joined = edges.join(a, "src").join(b, ["dst", *by])
    inside = F.sum(F.when(F.col("l_src") == F.col("l_dst"), F.col("w")).otherwise(0.0)).alias("inside")
    per = joined.groupBy(*by, "l_src").agg(F.sum("w").alias("deg"), inside)
    whole = per.groupBy(*by).agg(F.sum("deg").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("deg") * F.col("deg")).alias("d2"))
    return whole.select(*by, (F.col("inside") / F.col("m2") - 0.25 * F.col("d2") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def _scaled(factor: float) -> Column:
    return F.transform("v", lambda x: x * factor)


def concat_blocks(*blocks: tuple[DataFrame, float]) -> DataFrame:
    """Vectors of several tables end to end, each scaled."""
    out = None
    for i, (df, factor) in enumerate(blocks):
        part = df.select("row_id", _scaled(factor).alias(f"b{i}"))
        out = part if out is None else out.join(part, "row_id")
    return out.select("row_id", F.concat(*(F.col(f"b{i}") for i in range(len(blocks)))).alias("v"))


def fits(n_terms: int, k: int) -> bool:
    """Whether a dense matrix of so many terms and columns is one that the driver and tasks may hold."""
    return n_terms <= MAX_TERMS and n_terms * k * 8 <= DENSE_BYTES


class Sparse:
    """Rows (row_id, term, w) as one sparse list for each row, against a dense matrix over a bounded set of terms.

    Terms are turned into numbers once; products then read numbers only.
    """

    def __init__(self, weights: DataFrame, terms: list | None = None, most: int = MAX_TERMS):
        spark = weights.sparkSession
        self.kind = weights.schema["row_id"].dataType.simpleString()
        if terms is None:
            terms = [r[0] for r in weights.select("term").distinct().orderBy("term").limit(most + 1).collect()]
        if len(terms) > most:
            raise ValueError(f"more than {most} terms: use truncated_svd or pooled, which keep them distributed")
        self.terms = terms
        small_batches(spark)
        index = spark.sparkContext.broadcast(pa.array(terms))

        def coded(batches):
            for b in batches:
                lists = b.column(1)
                size = lists.value_lengths().to_numpy()
                words = lists.flatten()
                code = pc.fill_null(pc.index_in(words, value_set=index.value.cast(words.type)), -1).to_numpy()
                w, end = b.column(2).flatten().to_numpy(), np.cumsum(size)
                parts = [(c[c >= 0].tobytes(), x[c >= 0].tobytes()) for c, x in ((code[e - n : e], w[e - n : e]) for n, e in zip(size, end, strict=True))]
                codes, ws = zip(*parts, strict=True) if parts else ([], [])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), pa.array(ws, pa.binary())], ["row_id", "codes", "ws"])

        lists = weights.groupBy("row_id").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("w").cast("double")).alias("ws"))
        self.rows = settled(lists.mapInArrow(coded, f"row_id {self.kind}, codes binary, ws binary"))
        index.unpersist()

    def times(self, m: np.ndarray) -> DataFrame:
        """(row_id, v): every row times m, whose rows are terms."""
        m = self.rows.sparkSession.sparkContext.broadcast(m)

        def run(batches):
            for b in batches:
                row, code, w = _codes(b)
                out = _sums(row, code, w, m.value, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(out)], ["row_id", "v"])

        return self.rows.mapInArrow(run, f"row_id {self.kind}, v array<double>")

    def collected(self, m: np.ndarray) -> np.ndarray:
        """A m on the driver, for rows whose ids are the terms. What is sent is the product itself, whatever the number of tasks."""
        shared, terms = self.rows.sparkSession.sparkContext.broadcast(m), np.array(self.terms)

        def run(batches):
            for b in batches:
                row, code, w = _codes(b)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_sums(row, code, w, shared.value, b.num_rows).tobytes()], pa.binary())], ["ids", "part"])

        out = np.zeros(m.shape)
        for r in self.rows.mapInArrow(run, "ids binary, part binary").collect():
            at = np.searchsorted(terms, np.frombuffer(r["ids"], np.int64))
            out[at] = np.frombuffer(r["part"], float).reshape(len(at), -1)
        shared.destroy()
        return out

    def square(self, m: np.ndarray) -> np.ndarray:
        """A'(A m): summed in each task, then by blocks of terms that the task has touched, so that one matrix comes back. Wide ones go in slabs."""
        if m.nbytes > DENSE_BYTES and len(slabs := _slabs(m)) > 1:
            return np.hstack([self.square(x) for x in slabs])
        shared, k = self.rows.sparkSession.sparkContext.broadcast(m), m.shape[1]

        def run(batches):
            total, touched = np.zeros(shared.value.shape), np.zeros(len(shared.value) // 1024 + 1, bool)
            for b in batches:
                row, code, w = _codes(b)
                y = _sums(row, code, w, shared.value, b.num_rows)
                order = np.argsort(code, kind="stable")
                _add(total, code[order], row[order], w[order], y)
                touched[code // 1024] = True
            for i in np.flatnonzero(touched):
                at = int(i) * 1024
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + 1024].tobytes()], pa.binary())], ["at", "part"])

        def add(t: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x, float) for x in t.column("part").to_pylist()]
            return pa.table({"at": t.column("at").slice(0, 1), "part": [np.sum(parts, axis=0).tobytes()]})

        got = self.rows.coalesce(SQUARED).mapInArrow(run, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary").collect()
        shared.unpersist()
        out = np.zeros(m.shape)
        for r in got:
            x = np.frombuffer(r["part"], float).reshape(-1, k)
            out[r["at"] : r["at"] + len(x)] = x
        return out


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, weight) of a batch of coded rows."""
    raw = batch.column(1).to_pylist()
    row = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
    return row, np.frombuffer(b"".join(raw), np.int32).astype(np.int64), np.frombuffer(b"".join(batch.column(2).to_pylist()), float)


def _add(out: np.ndarray, to: np.ndarray, at: np.ndarray, w: np.ndarray, m: np.ndarray) -> None:
    """out[to] += w m[at], a bounded number of entries at a time. to: in order."""
    step = max(1, PIECE // (8 * max(1, m.shape[1])))
    for i in range(0, len(to), step):
        key, x = to[i : i + step], m[at[i : i + step]]
        x *= w[i : i + step, None]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        out[key[first]] += np.add.reduceat(x, first)


def _sums(row: np.ndarray, code: np.ndarray, w: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """Of n rows, each the sum of w times the row of m that code says."""
    out = np.zeros((n, m.shape[1]))
    _add(out, row, code, w, m)
    return out


def truncated_svd(weights: DataFrame, rank: int, rounds: int = 2, over: int = 8, seed: int = 7) -> DataFrame:
    """(row_id, v): rows projected on the leading right singular vectors, by a randomised range finder.

    Rows stay distributed. While the terms' side fits (DENSE_BYTES), it is what is sent around; beyond,
    both sides are tables that meet in joins, and only matrices of rank x rank come to the driver.
    """
    n_terms = weights.select("term").distinct().count()
    k = min(rank + over, n_terms)
    turned = not fits(n_terms, k)
    if turned:
        weights = settled(weights.select("row_id", "term", F.col("w").cast("double").alias("w")))
        n_rows = weights.select("row_id").distinct().count()
        k = min(k, n_rows)
        if n_rows > MAX_ROWS or n_rows * k * 8 > SLABS_BYTES:
            return _wide_svd(weights, rank, k, rounds, seed)
    a = Sparse(weights.select(F.col("term").alias("row_id"), F.col("row_id").alias("term"), "w") if turned else weights, most=MAX_ROWS if turned else MAX_TERMS)
    q = np.random.default_rng(seed).standard_normal((len(a.terms), k))
    for _ in range(rounds):
        q, _ = np.linalg.qr(a.square(q))
    y = a.square(q)
    value, vector = np.linalg.eigh(q.T @ y)
    top = np.argsort(-value)[:rank]
    if turned:  # left singular vectors at the length of their values are the rows on the right ones
        return _handed_out(weights, a.terms, q @ (vector[:, top] * np.sqrt(np.maximum(value[top], 0))))
    return a.times(q @ vector[:, top])


def _handed_out(weights: DataFrame, ids: list, m: np.ndarray) -> DataFrame:
    """(row_id, v) from a matrix of the driver whose rows are ids, in order; a slab of columns at a time is sent."""
    spark, rows, parts = weights.sparkSession, weights.select("row_id").distinct(), []
    kind, index = weights.schema["row_id"].dataType.simpleString(), spark.sparkContext.broadcast(pa.array(ids))
    for i, slab in enumerate(_slabs(m)):
        shared = spark.sparkContext.broadcast(slab)

        def run(batches, shared=shared):
            for b in batches:
                at = pc.index_in(b.column(0), value_set=index.value.cast(b.column(0).type)).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(shared.value[at])], ["row_id", "v"])

        parts.append(settled(rows.mapInArrow(run, f"row_id {kind}, v array<double>")))
        shared.unpersist()
    out = parts[0].withColumnRenamed("v", "v0")
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumnRenamed("v", f"v{i}"), "row_id")
    return out.select("row_id", F.concat(*(f"v{i}" for i in range(len(parts)))).alias("v"))


def _slabs(m: np.ndarray) -> list[np.ndarray]:
    """Columns of m some at a time, so that a task holds a bounded matrix."""
    step = max(1, DENSE_BYTES // 2 // (8 * max(1, len(m))))
    return [np.ascontiguousarray(m[:, i : i + step]) for i in range(0, max(1, m.shape[1]), step)]


def weighted_sums(weights: DataFrame, key: str, other: str, vectors: DataFrame) -> DataFrame:
    """(key, v): sums of w times the vector of `other`, by joins alone. vectors: (other, v)."""
    rows = weights.select(key, other, "w").join(vectors, other).select(key, array_to_vector(F.transform("v", lambda x: x * F.col("w"))).alias("x"))
    return rows.groupBy(key).agg(vector_to_array(Summarizer.sum(F.col("x"))).alias("v"))


def _wide_svd(weights: DataFrame, rank: int, k: int, rounds: int, seed: int) -> DataFrame:
    """truncated_svd with the terms' side distributed, too; columns are made orthonormal through their k x k products."""
    weights = settled(weights.select("row_id", "term", F.col("w").cast("double").alias("w")))
    start = F.array(*(F.randn(seed + i) for i in range(k)))
    q = settled(weights.select("term").distinct().select("term", start.alias("v")))
    for _ in range(rounds):
        y = settled(weighted_sums(weights, "row_id", "term", q))
        z = settled(weighted_sums(weights, "term", "row_id", y))
        value, vector = np.linalg.eigh(_gram(z))
        good = value > value.max() * 1e-12
        turn = vector[:, good] / np.sqrt(value[good])
        q = settled(_each(z, "term", lambda x, turn=turn: x @ turn))
    y = settled(weighted_sums(weights, "row_id", "term", q))
    value, vector = np.linalg.eigh(_gram(y))
    turn = vector[:, np.argsort(-value)[:rank]]
    return _each(y, "row_id", lambda x: x @ turn)


def _lists(x: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as one list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _each(rows: DataFrame, key: str, f) -> DataFrame:
    """(key, v) with f applied to the matrix of v's rows, a batch at a time. A batch of no rows stays so."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(f(matrix(b.column(1))))], [key, "v"])

    return rows.select(key, "v").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, v array<double>")


def _gram(rows: DataFrame, centre: np.ndarray | float = 0.0) -> np.ndarray:
    """V'V of (.., v - centre) by one partial sum matrix for each task, of k x k numbers; these are summed by row of the matrix."""

    def run(batches):
        total = None
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                x = x - centre
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), _lists(total)], ["i", "v"])

    got = mean_vectors(rows.select("v").mapInArrow(run, "i int, v array<double>"), "i", total=True).orderBy("i").collect()
    return np.array([r["v"] for r in got]) if got else np.zeros((0, 0))


def pooled(counts: DataFrame, vectors: DataFrame, weight: Column) -> DataFrame:
    """Document vectors: the weighted sum of word vectors. counts: (row_id, term, ...), vectors: (term, v) of a bounded vocabulary."""
    width = vectors.select(F.size("v").alias("k")).first()
    weighted = counts.select("row_id", "term", weight.alias("w"))
    if width is None or not fits(vectors.count(), width["k"]):
        return weighted_sums(weighted, "row_id", "term", vectors)
    known = vectors.orderBy("term").collect()
    return Sparse(weighted, [r["term"] for r in known]).times(np.array([r["v"] for r in known], float))


def remove_top_components(points: DataFrame, n: int) -> DataFrame:
    """Centred points less their projection on the n leading components."""
    mean = mean_vectors(points.withColumn("g", F.lit(0)), "g").first()
    centre = np.array(mean["v"]) if mean else np.zeros(0)
    if not n or not mean:
        return _each(points, "row_id", lambda x: x - centre)
    value, vector = np.linalg.eigh(_gram(points, centre))
    top = vector[:, np.argsort(-value)[:n]]
    return _each(points, "row_id", lambda x: (x - centre) - (x - centre) @ top @ top.T)


def explained_variance(points: DataFrame) -> float:
    """Share of the leading component."""
    mean = mean_vectors(points.withColumn("g", F.lit(0)), "g").first()
    value = np.linalg.eigvalsh(_gram(points, np.array(mean["v"]))) if mean else np.zeros(0)
    return float(value.max() / value.sum()) if value.size and value.sum() else 0.0


def spectral(edges: DataFrame, dim: int, rounds: int = 12, seed: int = 11) -> DataFrame:
    """Leading eigenvectors of the normalised adjacency of a batch's graph, scaled by their eigenvalues. edges: both directions.

    Block power iteration on half the matrix plus half the identity, which has no negative
    eigenvalues, so that the largest algebraic ones lead.
    """
    edges = settled(edges)
    degree = edges.groupBy("src").agg(F.sum("w").alias("deg"))
    a = edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("deg").alias("deg2")), "dst")
    a = a.select(F.col("src").alias("row_id"), F.col("dst").alias("term"), (F.col("w") / F.sqrt(F.col("deg") * F.col("deg2")) / 2).alias("w"))
    half = Sparse(a.unionByName(degree.select(F.col("src").alias("row_id"), F.col("src").alias("term"), F.lit(0.5).alias("w"))), most=MAX_ROWS)
    # a graph is as wide as it is long, and its matrix symmetric: each task sends back its own rows of a product, not a sum over all
    q = np.random.default_rng(seed).standard_normal((len(half.terms), min(dim + 4, len(half.terms))))
    for _ in range(rounds):
        q, _ = np.linalg.qr(half.collected(half.collected(q)))
    value, vector = np.linalg.eigh(q.T @ half.collected(half.collected(q)))
    top = np.argsort(-value)[:dim]
    # value is the square of (eigenvalue + 1) / 2
    scale = np.maximum(2 * np.sqrt(np.maximum(value[top], 1e-18)) - 1, 0) / np.sqrt(np.maximum(value[top], 1e-18))
    return half.times(q @ vector[:, top] * scale)


def random_projection(weights: DataFrame, dim: int) -> DataFrame:
    """OURS: a projection whose entries are signs, the bits of hashes of a term; one sum for each column, and no explode."""
    words = -(-dim // 32)
    rows = weights.select("row_id", "w", *(fn.digest(F.col("term"), F.lit(i)).alias(f"h{i}") for i in range(words)))

    def bit(i: int) -> Column:
        return F.shiftright(F.col(f"h{i // 32}"), i % 32).bitwiseAND(F.lit(1))

    sums = [F.sum(F.when(bit(i) == 0, F.col("w")).otherwise(-F.col("w"))) / float(np.sqrt(dim)) for i in range(dim)]
    return rows.groupBy("row_id").agg(F.array(*sums).alias("v"))


def jitter_empty(points: DataFrame, scale: float = 1e-3, seed: int = 5) -> DataFrame:
    """Zero vectors get small noise that depends on the row id."""
    zero = ~F.exists("v", lambda x: x != 0)
    noise = F.transform("v", lambda x, i: x + scale * ((fn.digest(F.col("row_id"), i, F.lit(seed)) % 2001 - 1000) / 1000.0))
    return points.select("row_id", F.when(zero, noise).otherwise(F.col("v")).alias("v"))
