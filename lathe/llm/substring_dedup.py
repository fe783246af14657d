"""Repeated byte strings across documents, by bucket-pointer refinement.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a
smaller id. Buckets of equal q-grams are refined to buckets of longer strings by the bucket
identifiers of later offsets, and each refinement takes up only the positions that the one before
left open:

1. Identifiers of q-grams come from those of shorter grams at later offsets (1, 2, 4, 8, 16, then q);
   each round reuses the identifiers of the round before. In every window of `length` bytes the
   position with the least identifier is a pointer. Equal windows have the same pointer, so pointers
   stand for all windows (about two in each length - q + 2 positions).
2. Pointers are sorted into buckets by their q-gram. A bucket with one document is finished. Within
   a bucket, pointers are refined by the identifiers of the grams around them, so that two pointers
   agree if all their windows do: all but the first document's are settled at once.
3. Pointers still open are refined by a gram on their left and one on their right, half of the rest
   of the window each: a window that repeats must repeat one of them.
4. Windows of the pointers that stay open are compared one by one, by the identifiers at their
   offsets 0, q and length - q.

A chunk of documents sends each bucket the pointers of the first document of every class, so copies
are merged before the shuffle and a string that all documents hold costs one pointer a chunk. A gram
that very many texts hold in different surroundings is spread over buckets by its surroundings: the
classes are settled there, and what stays is open without a look at the others of the gram, as it
would be with one. Such grams are found by counting the pointers of one document in COUNTED. That
decides where pointers go and nothing else: results are the same whatever is found. Identifiers have
63 bits, with 32 more to tell classes apart within a bucket.

Null text is empty. A null id has no order: nothing is removed there and it marks nothing. Rows of
equal id are not smaller than each other; equal rows have equal results. A very long text is handled
whole in memory (about 60 bytes for each of its own). An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, spans, table, width

CHUNK_BYTES = 1 << 20
POINTERS_PER_BUCKET = 400_000
#: One document in so many is read to find the grams that have more pointers than a bucket should hold.
COUNTED = 64
#: Of such grams, at most; with more data, more pointers make one.
MAX_SPREAD = 100_000
SETTLED, OPEN = 1, 2
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
TOP = np.uint64(2**64 - 1)
BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x ^= x >> np.uint64(29)
    return x


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(ODD), n, 2**64))


class Grams:
    """Identifiers of grams at every position of joined texts; positions past the end hold 0."""

    def __init__(self, flat: np.ndarray):
        self.level = {1: BYTE[flat]}

    def double(self, upto: int) -> np.ndarray:
        n = 1
        while 2 * n <= upto:
            self.level.setdefault(2 * n, self._join(self.level[n], n, self.level[n], n))
            n *= 2
        return self.level[n]

    @staticmethod
    def _join(a: np.ndarray, la: int, b: np.ndarray, lb: int) -> np.ndarray:
        """Identifiers of strings of la bytes followed by lb bytes."""
        out = a * _power(lb)
        out[:-la] += b[la:]
        return out

    def of(self, length: int) -> np.ndarray:
        """Identifiers of grams of any length, from those of powers of two."""
        if length not in self.level:
            out, have = None, 0
            for bit in reversed(range(length.bit_length())):
                n = 1 << bit
                if length & n:
                    self.double(n)
                    out = self.level[n] if out is None else self._join(out, have, self.level[n], n)
                    have += n
            self.level[length] = out
        return self.level[length]


def _slide(x: np.ndarray, w: int, fold, fill) -> np.ndarray:
    """fold over x[i : i + w] for every i; places past the end count as fill."""
    out, n = x.copy(), 1
    while n < w:
        step = min(n, w - n)
        out[:-step] = fold(out[:-step], out[step:]) if step < out.size else out[:-step]
        tail = out[max(0, out.size - step) :]
        np.copyto(tail, fold(tail, fill))
        n += step
    return out


def pointers(grams: Grams, end: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, mixed gram identifiers) of all pointers; end: of each position, its document's end."""
    gram = _mix(grams.of(q)) | np.uint64(1)
    place = np.arange(gram.size)
    gram[place + q > end] = TOP
    w = length - q + 1
    least = _slide(gram, w, np.minimum, TOP)
    least[place + length > end] = 0
    # position p is a pointer if it is the least of a window that starts at p - w + 1 ... p
    most = _slide(least[::-1], w, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((most == gram) & (gram != TOP))
    return at, gram[at]


def _context(grams: Grams, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: int, length: int) -> np.ndarray:
    """32 bits for what lies in [lo, hi), around the grams at `at`; q-grams cover it without gaps."""
    ids = grams.of(q)
    out = _mix(((at - lo) * 131 + (hi - at)).astype(np.uint64) + ODD)
    steps = -(-(2 * length - q) // q)
    for j in range(steps):
        out = _mix(out * ODD + ids[np.minimum(np.minimum(at - (length - q) + j * q, hi - q), np.maximum(hi - q, lo)).clip(lo)])
    return (out >> np.uint64(32)).astype(np.uint32)


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that the high ones, mostly zero, compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


SENT = "bucket int, docs binary, orders binary, sizes binary, gram binary, context binary, place binary, settled_sizes binary, settled_place binary"


class Names:
    """Unique keys of documents, and the numbers that order them: the keys themselves unless ids repeat."""

    def __init__(self, key: np.ndarray, order: np.ndarray | None):
        self.key, self.order, self.same = key, key if order is None else order, order is None


#: Of grams that are sent: 0 for those that are spread.
KEPT_TOGETHER = np.uint64(1)
NONE = np.zeros(0, np.uint64)


def _send(doc: np.ndarray, names: Names, place: np.ndarray, gram: np.ndarray, context: np.ndarray, buckets: int, spread: np.ndarray = NONE):
    """One row for each bucket: the first document's pointers of every class, and the places settled here.

    doc: index into names. spread: sorted grams that go to buckets by their context.
    """
    if not gram.size:
        return
    gram = gram | KEPT_TOGETHER
    if spread.size:
        gram[spread[np.minimum(np.searchsorted(spread, gram), spread.size - 1)] == gram] ^= KEPT_TOGETHER
    rank = names.order
    order = np.lexsort((rank[doc], context, gram))
    doc, place, gram, context = doc[order], place[order], gram[order], context[order]
    fresh = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    settled = rank[doc] > rank[doc[first]]
    to = gram >> np.uint64(1)
    if spread.size:
        to = np.where(gram & KEPT_TOGETHER, to, _mix(to * ODD + context))
    bucket = (to % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((place, doc, bucket))
    doc, place, gram, context, settled, bucket = (x[order] for x in (doc, place, gram, context, settled, bucket))
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), bucket.size)
    rows = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own, off = doc[a:b], settled[a:b]
        of, index = np.unique(own, return_inverse=True)
        sizes = [np.bincount(index[m], minlength=of.size) for m in (~off, off)]
        rows.append((int(bucket[a]), names.key[of].tobytes(), b"" if names.same else rank[of].tobytes(), _planes(sizes[0]), gram[a:b][~off].tobytes(), context[a:b][~off].tobytes(), _planes(place[a:b][~off]), _planes(sizes[1]), _planes(place[a:b][off])))
    kinds = [pa.int32()] + [pa.binary()] * 8
    columns = [c.split()[0] for c in SENT.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)


FLAGGED = "doc long, place int, flag int"


def _refine(whole: bool):
    """Flags of one bucket's pointers. whole: classes decide alone, and none is left open."""

    def run(group: pa.Table) -> pa.Table:
        doc, key, place, gram, context, sdoc, splace = [], [], [], [], [], [], []
        for r in group.to_pylist():
            ids, size = np.frombuffer(r["docs"], np.int64), _unplanes(r["sizes"])
            doc.append(np.repeat(ids, size))
            key.append(np.repeat(np.frombuffer(r["orders"], np.int64), size) if r["orders"] else doc[-1])
            place.append(_unplanes(r["place"]))
            gram.append(np.frombuffer(r["gram"], np.uint64))
            context.append(np.frombuffer(r["context"], np.uint32))
            sdoc.append(np.repeat(ids, _unplanes(r["settled_sizes"])))
            splace.append(_unplanes(r["settled_place"]))
        doc, key, place, gram, context, sdoc, splace = map(np.concatenate, (doc, key, place, gram, context, sdoc, splace))
        order = np.lexsort((key, context, gram))
        doc, place, gram, context, key = doc[order], place[order], gram[order], context[order], key[order]
        new_gram = np.append(True, gram[1:] != gram[:-1])
        fresh = new_gram | np.append(True, context[1:] != context[:-1])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        flag = np.where(key > key[first], SETTLED, 0)
        if not whole:
            start = np.flatnonzero(new_gram)
            of = np.cumsum(new_gram) - 1
            classes = np.add.reduceat(fresh.astype(np.int64), start)
            span = np.maximum.reduceat(key, start) > np.minimum.reduceat(key, start)
            alone = (gram & KEPT_TOGETHER) == 0  # the others of its gram are in other buckets
            flag = np.where((flag == 0) & (((classes > 1) & span)[of] | alone), OPEN, flag)
        hit = flag > 0
        return pa.table(
            {"doc": np.concatenate([doc[hit], sdoc]), "place": np.concatenate([place[hit], splace]).astype(np.int32), "flag": np.concatenate([flag[hit], np.full(sdoc.size, SETTLED)]).astype(np.int32)}
        )

    return run


def _joined(raw: list[bytes]):
    """Texts end to end: bytes, document index, start and end of each position's document."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    stop = np.cumsum(size)
    of = np.repeat(np.arange(len(raw)), size)
    return np.frombuffer(b"".join(raw), np.uint8), of, (stop - size), stop


def _extent(at: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """What the windows that hold the gram at `at` cover."""
    return np.maximum(at - (length - q), start), np.minimum(at + length, end)


def _texts(batches, *more: str):
    """(texts, their names, further columns) of about CHUNK_BYTES at a time."""
    for batch in batches:
        raw = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]
        ids = batch["key"].to_numpy()
        order = batch["rank"].to_numpy() if "rank" in batch.schema.names else None
        rest = [batch[c] for c in more]
        for a, b in spans([len(t) for t in raw], CHUNK_BYTES):
            yield (raw[a:b], Names(ids[a:b], None if order is None else order[a:b]), *(c.slice(a, b - a) for c in rest))


class SubstringDedup:
    """length: of the strings; q: of the first grams. Results are the same for any q below length - 1."""

    def __init__(self, length: int = 50, q: int = 25, id_col: str = "doc_id", text_col: str = "text"):
        if not 2 <= q < length - 1 or 2 * q < length - q:
            raise ValueError("q must lie below length and be a third of it at least")
        self.length, self.q, self.id_col, self.text_col = length, q, id_col, text_col

    def _keyed(self, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
        """(key, text) with unique keys in the order of ids; if ids repeat, (key, rank, text) and the table (key, rank, hash).

        rank: the id, which orders documents. Then a key stands for an id with one of its texts.
        """
        text = docs[self.text_col].cast("string")
        rows = docs.select(docs[self.id_col].cast("long").alias("key"), text.alias("text"), F.xxhash64(text).alias("hash")).filter("key is not null")
        most = rows.groupBy("key").count().agg(F.max("count").alias("n")).first()["n"] or 0
        if most <= 1:
            return rows.select("key", "text"), None
        names = rows.select(F.col("key").alias("rank"), "hash").distinct().withColumn("key", F.monotonically_increasing_id())
        names = scratch.save(names.select("key", "rank", "hash"), "names")  # written, so that keys stay what they are
        rows = rows.withColumnRenamed("key", "rank").dropDuplicates(["rank", "hash"]).join(names, ["rank", "hash"])
        return scratch.save(rows.select("key", "rank", "text"), "texts"), names

    def _flags(self, sent: DataFrame, whole: bool) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_refine(whole), FLAGGED)

    @staticmethod
    def _spread(sent: DataFrame, scratch: Scratch, name: str) -> np.ndarray:
        """The grams that would fill a bucket. sent: of one document in COUNTED. At most MAX_SPREAD come back."""

        def count(batches):
            for batch in batches:
                gram = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
                gram, n = np.unique(np.concatenate([*gram, np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n, pa.int64())], ["gram", "n"])

        counts = sent.select("gram").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        full = scratch.save(counts.filter(F.col("n") >= POINTERS_PER_BUCKET // COUNTED), name)
        least = (full.agg(F.sum("n").alias("n")).first()["n"] or 0) // MAX_SPREAD + 1
        return np.sort(np.array([r["gram"] for r in full.filter(F.col("n") >= least).collect()], np.int64).view(np.uint64))

    @staticmethod
    def _counted(rows: DataFrame) -> DataFrame:
        return rows.filter(F.pmod(F.xxhash64("key"), F.lit(COUNTED)) == 0)

    def _first(self, buckets: int, spread: np.ndarray = NONE):
        length, q = self.length, self.q

        def run(batches):
            for raw, names in _texts(batches):
                flat, of, start, stop = _joined(raw)
                if flat.size < length:
                    continue
                grams = Grams(flat)
                at, gram = pointers(grams, stop[of], length, q)
                doc = of[at]
                lo, hi = _extent(at, start[doc], stop[doc], length, q)
                context = _context(grams, at, lo, hi, q, length)
                yield from _send(doc, names, at - start[doc], gram, context, buckets, spread)

        return run

    def _half(self, buckets: int, spread: np.ndarray = NONE):
        """Open pointers, by the gram that reaches half of the rest to the left, and to the right."""
        length, q = self.length, self.q
        more = (length - q + 1) // 2

        def run(batches):
            for raw, names, open_ in _texts(batches, "open"):
                flat, of, start, stop = _joined(raw)
                if flat.size < q:
                    continue
                doc, at = _places(open_, start)
                grams = Grams(flat)
                ids_of = grams.of(q + more)
                for side, a in ((0, at - more), (1, at)):
                    fits = (a >= start[doc]) & (a + q + more <= stop[doc])
                    gram = _mix(ids_of[a[fits]] + np.uint64(side) * MIX)
                    # the context tells documents' own pointers apart, so that a class is one document
                    yield from _send(doc[fits], names, (at - start[doc])[fits], gram, _mix(names.order[doc[fits]].astype(np.uint64)).astype(np.uint32), buckets, spread)

        return run

    def _windows(self, buckets: int):
        length, q = self.length, self.q

        def run(batches):
            for raw, names, open_ in _texts(batches, "open"):
                flat, of, start, stop = _joined(raw)
                if flat.size < length:
                    continue
                doc, at = _places(open_, start)
                w = (at[:, None] - np.arange(length - q + 1)).ravel()
                doc = np.repeat(doc, length - q + 1)
                fits = (w >= start[doc]) & (w + length <= stop[doc])
                w, first = np.unique(w[fits], return_index=True)
                doc = doc[fits][first]
                g = Grams(flat).of(q)
                later = [w + min(j * q, length - q) for j in range(1, -(-length // q))]
                gram, context = g[w], g[w]
                for x in later:
                    gram, context = _mix(gram * ODD + g[x]), _mix(context * MIX + g[x] * ODD)
                yield from _send(doc, names, w - start[doc], _mix(gram), (context >> np.uint64(32)).astype(np.uint32), buckets)

        return run

    def _cut(self):
        length, q = self.length, self.q

        def run(batches):
            for raw, names, settled, windows in _texts(batches, "settled", "windows"):
                _, _, start, stop = _joined(raw)
                out = []
                for text, a, b in zip(raw, settled.to_pylist(), windows.to_pylist(), strict=True):
                    n = len(text)
                    a, b = np.array(a or [], np.int64), np.array(b or [], np.int64)
                    lo, hi = _extent(a, np.zeros_like(a), np.full_like(a, n), length, q)
                    edge = np.bincount(np.concatenate([lo, b]), minlength=n + 1) - np.bincount(np.concatenate([hi, b + length]), minlength=n + 1)
                    gone = np.cumsum(edge)[:n] > 0
                    keep = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((int(gone.sum()), runs, hashlib.sha256(keep).hexdigest(), keep))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names.key), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

        return run

    def changed(self, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Of the documents that lose bytes or may: key, n_removed, n_spans, kept_sha256, kept; and the table of names if ids repeat."""
        spark = docs.sparkSession
        scratch = Scratch(spark, "substrings")
        rows, names = self._keyed(docs, scratch)
        id_columns = rows.columns[:-1]  # key, and rank if ids repeat
        total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        buckets = max(width(spark), int(total * 2 / (self.length - self.q + 2) / POINTERS_PER_BUCKET) + 1)
        spread = self._spread(self._counted(rows).mapInArrow(self._first(1), SENT), scratch, "full-grams")
        flags = scratch.save(self._flags(rows.mapInArrow(self._first(buckets, spread), SENT), False), "flags")
        per_doc = flags.groupBy(F.col("doc").alias("key")).agg(
            F.collect_list(F.when(F.col("flag") == OPEN, F.col("place"))).alias("open"),
            F.collect_list(F.when(F.col("flag") == SETTLED, F.col("place"))).alias("settled"),
        )
        held = scratch.save(rows.join(per_doc, "key").select(*id_columns, "text", "open", "settled"), "held")
        scratch.drop("flags")
        opened = held.filter(F.size("open") > 0).select(*id_columns, "text", "open")
        spread = self._spread(self._counted(opened).mapInArrow(self._half(1), SENT), scratch, "full-halves")
        half = self._flags(opened.mapInArrow(self._half(buckets, spread), SENT), False)
        half = scratch.save(half.groupBy(F.col("doc").alias("key")).agg(F.array_sort(F.collect_set("place")).alias("open")), "half")
        opened = held.select(*id_columns, "text").join(half, "key")
        windows = self._flags(opened.mapInArrow(self._windows(buckets), SENT), True)
        windows = scratch.save(windows.groupBy(F.col("doc").alias("key")).agg(F.collect_list("place").alias("windows")), "windows")
        final = held.select("key", "text", "settled").join(windows, "key", "left")
        return final.select("key", "text", "settled", "windows").mapInArrow(self._cut(), "key long, n_removed long, n_spans long, kept_sha256 string, kept binary"), names

    def digests(self, docs: DataFrame) -> DataFrame:
        """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256.

        Documents without a repeated string are digested where they are read; only the others are shuffled.
        """
        changed, names = self.changed(docs)
        changed = changed.drop("kept")
        text = F.coalesce(docs[self.text_col].cast("string"), F.lit(""))
        base = docs.select(docs[self.id_col].alias("id"), docs[self.id_col].cast("long").alias("rank"), F.xxhash64(docs[self.text_col].cast("string")).alias("hash"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
        if names is None:
            out = base.join(changed.withColumnRenamed("key", "rank"), "rank", "left")
        else:
            out = base.join(changed.join(names, "key"), ["rank", "hash"], "left")
        zero = F.lit(0).cast("long")
        return out.select(
            F.col("id").alias(self.id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
        )


def _places(lists: pa.Array, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, position in the joined texts) of every listed place."""
    size = np.fromiter((len(x or ()) for x in lists.to_pylist()), np.int64, len(lists))
    doc = np.repeat(np.arange(len(lists)), size)
    return doc, start[doc] + lists.flatten().to_numpy().astype(np.int64)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SubstringDedup(50).digests(table(spark, sf_dir, "documents"))
