"""Benchmark decontamination by latent semantic retrieval.

1. Documents are coded by the words of the benchmark, once, into a table of small integers; other
   words are all 0. Document frequencies come from the codes of all documents.
2. Passages are overlapping word windows, as TF-IDF vectors over the benchmark's rarer words. A
   randomised SVD of the passages of all documents (end to end, not overlapping), with the benchmark's
   own items, gives the latent space: two distributed products with the passage matrix, then a small
   eigenproblem. A large corpus is weighed down as a whole, so that the items still count beside it.
3. Every passage of every document that holds enough of those words is projected; items whose
   cosine reaches `cosine` are candidates.
4. For a candidate, the longest common subsequence of words with the item, over the item's length,
   decides: at `copied` it is a leak; at `paraphrased` it is one if the item's answer is there too.
   The answer is the column `answer` if the benchmark has one, else the item's last words.

Benchmark items are the query set against all rows. They are searched in blocks of a fixed number in
one latent space, which does not change what is found; a benchmark of more words than one space may
hold (`part_words`) is taken in parts, each with a space of its own, until all are done.
Null or blank texts are clean; items without words are ignored, as are items of a null id; an empty
benchmark leaves all clean. Item ids may repeat: one item's best text counts. A null or blank answer
is none. Repeated rows are judged each by itself; an empty table gives an empty result. Texts of any
length are searched whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

#: Documents that a larger corpus weighs as many as, beside the items, in the fit of the latent space.
FITTED_WEIGHT = 5_000
#: Bounds: items in one block of the search; words of items in one latent space.
MAX_ITEMS = 2_000
PART_WORDS = 250_000
RANK, OVERSAMPLING = 96, 16
CACHE_ENTRIES = 400_000
#: Codes in one row of a product.
PRODUCT_CODES = 1_024


def words(raw: bytes | None) -> list[bytes]:
    """Words with ASCII letters lowered."""
    return (raw or b"").lower().split()


def subsequence(item: dict[int, int], n: int, codes: list[int]) -> int:
    """Length of the longest common subsequence; item: for each code, a bit at each of its places among n."""
    full = (1 << n) - 1
    v = full
    for c in codes:
        if u := v & item.get(c, 0):
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Items:
    """Benchmark items by codes, in the order of their ids and texts; what every worker gets.

    Codes up to n_weighed are words of items; those above are words of answers alone.
    """

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        self.code: dict[bytes, int] = {}
        self.ids, self.words, self.answers = [], [], []
        split = [(i, words(text.encode("utf-8", "replace")), words((answer or "").encode("utf-8", "replace"))) for i, text, answer in sorted(rows, key=lambda r: (r[0], r[1], r[2] or ""))]
        for i, w, _ in split:
            if w:
                self.ids.append(i)
                self.words.append([self.code.setdefault(x, len(self.code) + 1) for x in w])
        self.n_weighed = len(self.code)
        for _, w, answer in split:
            if w:
                self.answers.append([self.code.setdefault(x, len(self.code) + 1) for x in answer or w[-3:]])
        self.counts = [{c: w.count(c) for c in set(w)} for w in self.words]
        self.bits = [{c: sum(1 << j for j, x in enumerate(w) if x == c) for c in set(w)} for w in self.words]

    @property
    def n_codes(self) -> int:
        return len(self.code) + 1


class Retrieval:
    """The latent space of a block, and the search of one document's codes in it."""

    def __init__(self, items: Items, weight: np.ndarray, window: int, step: int):
        self.items, self.weight, self.window, self.step = items, weight, window, step
        self.basis = np.zeros((len(weight), 1), np.float32)
        rare = [sum(weight[c] > 0 for c in w) for w in items.words]
        self.longest = max(map(len, items.words), default=0)
        self.least = max(1, min([3, *(r for r in rare if r)]))

    def passages(self, codes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each passage with enough weighted words, passage index, code) of one document."""
        hits = np.flatnonzero(self.weight[codes] > 0)
        if hits.size < self.least:
            return np.zeros(0, np.int64), hits[:0], hits[:0]
        starts = np.arange(0, max(1, codes.size - self.window + step), step)
        lo, hi = np.searchsorted(hits, starts), np.searchsorted(hits, starts + self.window)
        good = hi - lo >= self.least
        starts, lo, hi = starts[good], lo[good], hi[good]
        size = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        return starts, np.repeat(np.arange(starts.size), size), codes[hits[at]]

    def entries(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised TF-IDF rows as (row, code, value), sorted by row then code."""
        pair, count = np.unique(row.astype(np.int64) * self.weight.size + code, return_counts=True)
        row, code = pair // self.weight.size, pair % self.weight.size
        value = (count * self.weight[code]).astype(np.float32)
        if row.size:
            first = np.append(True, row[1:] != row[:-1])
            norm = np.sqrt(np.add.reduceat(value * value, np.flatnonzero(first)))
            value /= np.maximum(norm, 1e-9)[np.cumsum(first) - 1]
        return row, code, value

    def item_matrix(self, a: int, b: int) -> np.ndarray:
        """Items a to b as dense normalised rows."""
        w = self.items.words[a:b]
        row, code, value = self.entries(np.repeat(np.arange(len(w)), [len(x) for x in w]), np.array([c for x in w for c in x], np.int64))
        x = np.zeros((len(w), self.weight.size), np.float32)
        x[row, code] = value
        return x

    def latent(self, row: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Unit vectors of the rows in the latent space."""
        row, code, value = self.entries(row, code)
        out = np.add.reduceat(self.basis[code] * value[:, None], np.flatnonzero(np.append(True, row[1:] != row[:-1])))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def prepare(self, most: int) -> None:
        """Items in the latent space, in blocks of `most`."""
        self.blocks = []
        for at in range(0, len(self.items.words), most):
            x = self.item_matrix(at, at + most) @ self.basis
            self.blocks.append((at, (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)))

    def search(self, codes: np.ndarray, cosine: float, copied: float, paraphrased: float) -> dict[int, float]:
        """Share of each leaked item that the document holds in order; item index to share."""
        starts, row, code = self.passages(codes, self.step)
        found: dict[int, float] = {}
        if not starts.size:
            return found
        for at in range(0, starts.size, 2048):
            part = (row >= at) & (row < at + 2048)
            unit = self.latent(row[part], code[part])
            near = [(p, first + t) for first, targets in self.blocks for p, t in [np.nonzero(unit @ targets >= cosine)]]
            p, t = (np.concatenate(x) for x in zip(*near, strict=True))
            present: dict[int, set[int]] = {}
            for begin, i in zip(starts[at + p].tolist(), t.tolist(), strict=True):
                if found.get(i) == 1.0:
                    continue
                n = len(self.items.words[i])
                if begin not in present:
                    present[begin] = set(codes[max(0, begin - self.longest) : begin + self.window + self.longest].tolist())
                count = self.items.counts[i]
                # words of the item that are there at all bound the common subsequence
                if sum(map(count.__getitem__, count.keys() & present[begin])) < n * min(copied, paraphrased):
                    continue
                near = codes[max(0, begin - n) : begin + self.window + n].tolist()
                share = subsequence(self.items.bits[i], n, near) / n
                if share >= copied or share >= paraphrased and _holds(near, self.items.answers[i]):
                    found[i] = max(share, found.get(i, 0.0))
        return found


def _best(found: dict[int, float], ids: list[int]) -> dict[int, float]:
    """By item id, the best share of its texts."""
    out: dict[int, float] = {}
    for i, share in found.items():
        out[ids[i]] = max(share, out.get(ids[i], 0.0))
    return dict(sorted(out.items()))


def _holds(codes: list[int], part: list[int]) -> bool:
    """Whether part, of one word at least, occurs in codes without gaps."""
    n = len(part)
    return any(codes[i : i + n] == part for i, c in enumerate(codes[: len(codes) - n + 1]) if c == part[0])


class Decontaminator:
    def __init__(self, window: int = 40, step: int = 10, cosine: float = 0.45, copied: float = 0.7, paraphrased: float = 0.55, max_df: float = 0.02, id_col: str = "doc_id", text_col: str = "text", block: int = MAX_ITEMS, part_words: int = PART_WORDS):
        self.block, self.part_words = block, part_words
        self.window, self.step, self.cosine, self.copied, self.paraphrased, self.max_df = window, step, cosine, copied, paraphrased, max_df
        self.id_col, self.text_col = id_col, text_col

    def _coder(self, code: dict[bytes, int]):
        def run(batches):
            get = code.get
            for batch in batches:
                coded = []
                for raw in batch.column(2).cast(pa.binary()).to_pylist():
                    w = words(raw)
                    coded.append(np.fromiter(map(get, w, (0,) * len(w)), np.int32, len(w)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.binary())], ["id", "t", "codes"])

        return run

    @staticmethod
    def _frequencies(n_codes: int):
        def run(batches):
            df = np.zeros(n_codes, np.int64)
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    df[np.unique(np.frombuffer(raw, np.int32))] += 1
            code = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(df[code])], ["code", "df"])

        return run

    @staticmethod
    def _product(space: Retrieval, q: np.ndarray):
        """Of each task's passages A: A' (A q), by blocks of codes. Passages don't overlap here."""

        def run(batches):
            out = np.zeros(q.shape, np.float32)
            for batch in batches:
                n, rows, codes = 0, [], []
                for raw in batch.column(0).to_pylist():
                    starts, row, code = space.passages(np.frombuffer(raw, np.int32), space.window)
                    rows.append(row + n)
                    codes.append(code)
                    n += starts.size
                row, code = np.concatenate(rows), np.concatenate(codes)
                cuts = np.searchsorted(row, np.arange(0, n + 4096, 4096))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a:
                        r, c, value = space.entries(row[a:b] - row[a], code[a:b])
                        y = np.add.reduceat(q[c] * value[:, None], np.flatnonzero(np.append(True, r[1:] != r[:-1])))
                        back = y[np.cumsum(np.append(False, r[1:] != r[:-1]))] * value[:, None]
                        order = np.argsort(c, kind="stable")
                        first = np.flatnonzero(np.append(True, np.diff(c[order]) != 0))
                        out[c[order][first]] += np.add.reduceat(back[order], first)
            for at in range(0, len(out), PRODUCT_CODES):
                block = out[at : at + PRODUCT_CODES]
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["at", "product"])

        return run

    @staticmethod
    def _added(batches):
        """The sum of all products of each block of codes."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.float32)
                total[at] = total[at] + part if at in total else part.astype(np.float64)
        for at, block in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["at", "product"])

    def _corpus_product(self, coded: DataFrame, space: Retrieval, q: np.ndarray) -> np.ndarray:
        """A' (A q) of the passages A of all documents; one row for each block of codes comes to the driver."""
        parts = coded.select("codes").mapInArrow(self._product(space, q), "at int, product binary")
        y = np.zeros(q.shape)
        for r in parts.repartition("at").mapInArrow(self._added, "at int, product binary").toLocalIterator():
            block = np.frombuffer(r["product"]).reshape(-1, q.shape[1])
            y[r["at"] : r["at"] + len(block)] = block
        return y

    def _fit(self, coded: DataFrame, space: Retrieval, n: int) -> None:
        """Randomised SVD with one power step over the passages of n documents and the items."""
        k = min(RANK + OVERSAMPLING, space.weight.size)
        q = np.random.default_rng(7).standard_normal((space.weight.size, k)).astype(np.float32)
        for _ in range(2):
            y = self._corpus_product(coded, space, q) * min(1.0, FITTED_WEIGHT / n)
            for at in range(0, len(space.items.words), self.block):
                items = space.item_matrix(at, at + self.block)
                y += items.T @ (items @ q)
            before, (q, _) = q, np.linalg.qr(y.astype(np.float64))
            small = before.T.astype(np.float64) @ y
            q = q.astype(np.float32)
        # y = A'A q for the orthonormal q of the first round, so its projection is symmetric
        value, vector = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-value)[: min(RANK, k)]
        space.basis = (before @ vector[:, order]).astype(np.float32)

    def leaks(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """Per row of docs: id, t (hash of the text), contaminated, item_ids, shares (of each item, in the document)."""
        spark = docs.sparkSession
        scratch = Scratch(spark, "leaks")
        text = docs[self.text_col].cast("string")
        rows = docs.select(docs[self.id_col].cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
        answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
        items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("text"), answer.alias("answer")).filter("i is not null and text is not null")
        size = items.agg(F.sum(F.size(F.split("text", "\\s+"))).alias("n")).first()["n"] or 0
        parts = max(1, -(-size // self.part_words))
        out = None
        for b in range(parts):
            # one part of the items at a time, of about part_words words, comes to the driver
            part = items.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == b)
            found = self._part(rows, Items([tuple(r) for r in part.collect()]), scratch, b)
            if parts > 1:  # rows of equal id and text have equal leaks
                found = found.filter(F.size("item_ids") > 0).select("id", "t", F.explode(F.arrays_zip("item_ids", "shares")).alias("x"))
            out = found if out is None else out.unionByName(found)
        if parts > 1:
            best = scratch.save(out.groupBy("id", "t", F.col("x.item_ids").alias("i")).agg(F.max("x.shares").alias("s")), "best")
            best = best.groupBy(F.col("id").alias("b_id"), F.col("t").alias("b_t")).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("x"))
            none = F.array().cast("array<struct<i: bigint, s: double>>")
            out = rows.select("id", "t").join(best, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("t") == F.col("b_t")), "left").withColumn("x", F.coalesce("x", none))
            out = out.select("id", "t", F.col("x.i").alias("item_ids"), F.col("x.s").alias("shares"))
        return out.select("id", "t", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "shares")

    def _part(self, rows: DataFrame, items: Items, scratch: Scratch, b: int) -> DataFrame:
        spark = rows.sparkSession
        coded = scratch.save(rows.mapInArrow(self._coder(items.code), "id long, t long, codes binary"), f"codes-{b}")
        n = coded.count()
        df = np.zeros(items.n_codes)
        # one row for each word of the part
        for r in coded.select("codes").mapInArrow(self._frequencies(items.n_codes), "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
            df[r["code"]] = r["df"]
        weight = np.log((1 + n) / (1 + df)) + 1
        common = df > max(self.max_df * n, 20)
        for counts in items.counts:  # every item keeps its rarest words, however common its text is
            common[sorted(counts, key=lambda c: (df[c], c))[:8]] = False
        weight[common] = 0
        weight[0] = 0
        weight[items.n_weighed + 1 :] = 0
        space = Retrieval(items, weight.astype(np.float32), self.window, self.step)
        if items.ids and n:
            self._fit(coded, space, n)
            space.prepare(self.block)
        shared = spark.sparkContext.broadcast(space)
        limits = (self.cosine, self.copied, self.paraphrased)

        def run(batches):
            space = shared.value
            for batch in batches:
                ids, shares = [], []
                for raw in batch.column(2).to_pylist():
                    got = _best(space.search(np.frombuffer(raw, np.int32), *limits), space.items.ids) if space.items.ids else {}
                    ids.append(list(got))
                    shares.append(list(got.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float64()))], ["id", "t", "item_ids", "shares"]
                )

        return coded.mapInArrow(run, "id long, t long, item_ids array<long>, shares array<double>")

    def clean(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """docs without contaminated documents."""
        bad = self.leaks(docs, benchmark).filter("contaminated").select("id", "t").distinct()
        text = docs[self.text_col].cast("string")
        row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[self.id_col].cast("long").alias("_id"), F.xxhash64(text).alias("_t"))
        return row.join(bad, row["_id"].eqNullSafe(bad["id"]) & (row["_t"] == bad["t"]), "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Decontaminator().leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    share = F.round(F.coalesce(F.array_max("shares"), F.lit(0.0)), 6)
    return out.select(F.col("id").alias("doc_id"), "contaminated", F.size("item_ids").cast("long").alias("n_items"), "item_ids", share.alias("best_share"))
