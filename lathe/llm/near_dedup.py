"""Near-duplicates by bottom-k sketches from one hash function.

1. Every document's set of word shingles is hashed with one function; the k least values are its
   sketch. Documents with equal sets (by a 128-bit digest) form a class, and one class counts once.
2. Inverted lists of the `listed` least values bring together classes that share one. Two sets
   of similarity s share none of the least r values with a probability of (1 - s)^r at most. A list
   above `list_block` classes is compared within blocks and with hubs; what this connects, such as a
   family of near copies, is done. A few members outside the list's largest component are compared
   with all. Many have little else in common: they are listed by pairs of the value and another of
   their `paired` least values, and so are the other members, but only under pairs that one outside
   has too.
3. Within a list, union sketches estimate similarities: of the least values of both sketches
   together, the share that lies in both. Pairs whose estimate is too low to be a link (chance of a
   wrong rejection about one in 10^8) go. What remains joins classes into families.
4. Within each family, full sets are compared exactly; links make the components.

Lists and families above a block are not compared pair by pair. First each block is compared in itself
and with a few hubs, members of the list that a hash picks and every block gets. What this connects
needs no more comparison; only the members that stay outside the list's largest component are compared
with the others, in pairs of blocks. So a family of near copies costs in proportion to its size. A
group sends out who is connected, not all its pairs.

`risk` 0 is the exact way: lists of every value of which two linked sets must share one (the least
n - least overlap + 1 of n), and full sets compared in the lists.

Null or empty text has an empty set and is linked with nothing, as is a null id (component null,
kept). Rows of equal id are one document for the components; an empty table gives an empty result;
a very long text is held whole; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch, table

CACHE_ENTRIES = 150_000
#: Odd, for keys of pairs.
_A = 0x5851F42D4C957F2D
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        code = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, code.size)
        h = np.full(code.size - n + 1, np.uint64(code.size if code.size < self.words else self.words))
        for j in range(n):
            h = (h ^ (code[j : code.size - n + 1 + j] * M1)) * M2
            h ^= h >> np.uint64(31)
        h *= M3
        h ^= h >> np.uint64(32)
        return np.unique(h)


@lru_cache
def least_share(k: int, similarity: float, risk: float = 1e-8) -> float:
    """The share of k union values in both sets that a pair of the similarity falls short of with this risk at most."""
    total = 0.0
    for i in range(k + 1):
        total += comb(k, i) * similarity**i * (1 - similarity) ** (k - i)
        if total > risk:
            return i / k
    return 1.0


def _label(near: np.ndarray) -> np.ndarray:
    """Least index connected with each row of a symmetric boolean matrix."""
    n = len(near)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            seen = near[i].copy()
            seen[i] = True
            front = seen
            while front.any():
                grown = near[front].any(axis=0) & ~seen
                seen |= grown
                front = grown
            label[seen] = i
    return label


def _overlaps(sets: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """Sizes of all intersections, over the values that two sets share, a block of columns at a time."""
    n = len(sets)
    if n == 2:
        return np.array([[0, v := np.intersect1d(*sets, assume_unique=True).size], [v, 0]], np.float32)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [s.size for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    edge = np.append(flat[1:] == flat[:-1], False)
    shared = edge | np.append(False, edge[:-1])
    flat, row = flat[shared], row[shared]
    column = np.cumsum(np.append(False, flat[1:] != flat[:-1])) if flat.size else np.zeros(0, np.int64)
    out = np.zeros((n, n), np.float32)
    most = int(column[-1]) + 1 if column.size else 0
    for at in range(0, most, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        x = np.zeros((n, min(columns, most - at)), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        out += x @ x.T
    return out


def _estimated(ids: list[int], sets: list[np.ndarray], sizes: list[int], k: int, num: int, den: int) -> np.ndarray:
    """Pairs whose union sketch does not rule out a link."""
    n = len(sets)
    both = _overlaps(sets)
    np.fill_diagonal(both, 0)
    least = least_share(k, num / den)
    kept = np.array([s.size for s in sets])
    size = np.array(sizes)
    near = both > 0
    for at in range(0, n, 128):  # a few rows at a time, as whole matrices of integers would take most of a worker's memory
        rows = slice(at, at + 128)
        near[rows] &= np.minimum.outer(size[rows], size) * den >= num * np.maximum.outer(size[rows], size)
        near[rows] &= both[rows] >= np.floor(least * np.minimum.outer(kept[rows], kept))
    if not near.any():
        return near
    whole = size <= kept  # the sketch is the full set
    last = np.array([s[-1] for s in sets], np.uint64)
    limit = np.where(whole, np.uint64(2**64 - 1), last)
    padded = np.full((n, k), np.uint64(2**64 - 1))
    for i, s in enumerate(sets):
        padded[i, : s.size] = s
    i, j = (x.astype(np.int32) for x in np.nonzero(np.triu(near)))
    for at in range(0, i.size, 10_000):
        a, b = i[at : at + 10_000], j[at : at + 10_000]
        top = np.minimum(limit[a], limit[b])[:, None]
        inside = [np.minimum((padded[x] <= top).sum(axis=1), kept[x]) for x in (a, b)]
        union = inside[0] + inside[1] - both[a, b]
        fine = both[a, b] >= np.floor(np.where(union >= k, least, 0.0) * union)
        near[a, b] = near[b, a] = fine
    return near


def _exact(ids, sets, sizes, k, num: int, den: int) -> np.ndarray:
    both = _overlaps(sets).astype(np.int64)
    size = np.array([s.size for s in sets])
    near = both * den >= num * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, False)
    return near


EDGES = "a long, b long"


def _groups(test, k: int, num: int, den: int):
    """Streams rows (key..., id, size, values) that are sorted by key; yields who is connected in each group."""

    def run(batches):
        key, ids, sets, sizes = None, [], [], []
        out: list[tuple[int, int]] = []

        def close():
            if len(ids) > 1:
                label = _label(test(ids, sets, sizes, k, num, den))
                out.extend((ids[i], ids[j]) for i, j in enumerate(label.tolist()) if i != j)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *now, i, size, raw in zip(*columns, strict=True):
                if now != key:
                    close()
                    key, ids, sets, sizes = now, [], [], []
                ids.append(i)
                sizes.append(size)
                sets.append(np.frombuffer(raw, np.uint64))
            if out:
                yield _edges(out)
                out.clear()
        close()
        if out:
            yield _edges(out)

    return run


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


HUBS = 8
#: Blocks of a list's members outside its largest component up to which they are compared with all.
FEW = 4
#: Keys that a broadcast may hold (about 60 bytes each); counted before.
MAX_KEYS = 1_000_000


def _only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of df whose keys are among `keys`; these are sent to all tasks while they are few, and joined beyond."""
    return df.join(F.broadcast(keys) if keys.count() <= MAX_KEYS else keys, keys.columns, "left_semi")


def _brought_together(rows: DataFrame, test, *key: str) -> DataFrame:
    """The edges within each group of rows (key..., id, size, values)."""
    return rows.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(test, EDGES)


def _in_block(n: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")


def hub_edges(entries: DataFrame, filled, key: str, block: int, test, scratch: Scratch, name: str) -> DataFrame:
    """Edges within each block of the rows of one key, and between these and the key's hubs. Arguments as in edges_of."""
    n = F.col("blocks").cast("int")
    hub = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.lit(float(HUBS << 30)) / (n * block)
    at = F.when(n <= 1, F.array(F.lit(0))).when(hub, F.sequence(F.lit(0), n - 1)).otherwise(F.array(_in_block(n, 7)))
    rows = filled(entries).select(key, F.explode(at).alias("lo"), "id", "size", "values")
    return scratch.save(_brought_together(rows, test, key, "lo"), f"{name}-1")


def outside_of(long: DataFrame, edges: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """(key, id, all, rest, outside) of the rows of each key that edges don't connect as a whole.

    outside: of the key's largest component; rest: how many are, of all.
    """
    label = connected(edges, scratch, f"{name}-in")
    known = long.select(key, "id").join(label.withColumnRenamed("node", "id"), "id", "left").select(key, "id", F.coalesce("component", "id").alias("component"))
    known = scratch.save(known.distinct(), f"{name}-known")
    largest = known.groupBy(key, "component").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("x"))
    largest = largest.select(key, "all", F.col("x.component").alias("main"), (F.col("all") - F.col("x.n")).alias("rest")).filter("rest > 0")
    return known.join(largest, key).select(key, "id", "all", "rest", (F.col("component") != F.col("main")).alias("outside"))


def met_edges(long: DataFrame, outside: DataFrame, key: str, block: int, test, scratch: Scratch, name: str) -> DataFrame:
    """Edges of those outside with all of their key, in pairs of blocks. long: (key, blocks, id, size, values)."""
    rows = long.join(outside, [key, "id"])
    n = F.col("blocks").cast("int")
    own = _in_block(n, 7)
    pairs = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda x: x != own), lambda x: F.struct(F.least(x, own).alias("lo"), F.greatest(x, own).alias("hi")))
    # few are outside: their blocks against all blocks
    r = F.ceil(F.col("rest") / F.lit(block)).cast("int")
    met = F.transform(F.sequence(F.lit(0), r - 1), lambda x: F.struct(x.alias("lo"), own.alias("hi")))
    mine = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(_in_block(r, 13).alias("lo"), x.alias("hi")))
    few = F.when(F.col("outside"), F.array_distinct(F.concat(met, mine))).otherwise(met)
    second = rows.select(key, F.inline(F.when(2 * F.col("rest") > F.col("all"), pairs).otherwise(few)), "id", "size", "values")
    return scratch.save(_brought_together(second, test, key, "lo", "hi"), f"{name}-2")


def edges_of(entries: DataFrame, filled, key: str, block: int, test, scratch: Scratch, name: str) -> DataFrame:
    """Edges that connect all that `test` connects among rows of one key.

    entries: a table with key and blocks, the number into which the key's rows are cut.
    filled: from some of them to (key, blocks, id, size, values).
    """
    first = hub_edges(entries, filled, key, block, test, scratch, name)
    long = entries.filter("blocks > 1")
    if long.isEmpty():
        return first
    long = filled(long)
    return first.unionByName(met_edges(long, outside_of(long, first, key, scratch, name), key, block, test, scratch, name))


class NearDedup:
    """words: shingle length; num / den: the least similarity of a link; k: sketch size.

    risk: of a link's two sets sharing no listed value (or, in pairs, fewer than two); it sets how many values
    of a sketch are listed. 0 is the exact way.
    list_block, block: rows of a list and of a family that are compared at once.
    """

    def __init__(self, words: int = 5, num: int = 80, den: int = 100, k: int = 64, risk: float = 1e-6, list_block: int = 1024, block: int = 512, id_col: str = "doc_id", text_col: str = "text"):
        self.words, self.num, self.den, self.k, self.list_block, self.block = words, num, den, k, list_block, block
        if not 0 < num <= den or not 0 <= risk < 1:
            raise ValueError("0 < num <= den and 0 <= risk < 1")
        self.exact, far = risk == 0, 1 - num / den
        self.listed = 1 if self.exact or not far else min(k, max(1, ceil(log(risk) / log(far))))
        self.paired = self.listed + 1
        while not self.exact and self.paired < k and far ** (self.paired - 1) * (far + self.paired * (1 - far)) > risk:
            self.paired += 1
        self.id_col, self.text_col = id_col, text_col

    def _sketches(self):
        words, k = self.words, self.k

        def run(batches):
            shingle = Shingler(words)
            for batch in batches:
                rows = []
                for raw in batch.column(1).cast(pa.binary()).to_pylist():
                    s = shingle(raw or b"")
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    rows.append((s.size, digest, s[:k].tobytes()))
                n, digest, sketch = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["id", "hash", "n", "digest", "sketch"])

        return run

    def _sets(self):
        words = self.words

        def run(batches):
            shingle = Shingler(words)
            for batch in batches:
                sets = [shingle(raw or b"").tobytes() for raw in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sets, pa.binary())], ["id", "family", "blocks", "size", "values"])

        return run

    @staticmethod
    def _least(n: int):
        def run(batches):
            for batch in batches:
                found = [np.frombuffer(x, np.uint64)[:n] for x in batch.column(1).to_pylist()]
                count = [f.size for f in found]
                values = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
                digests = batch.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)))
                yield pa.RecordBatch.from_arrays([pa.array(values), digests], ["value", "digest"])

        return run

    def _paired_with(self):
        """Of (value, digest, outside, sketch): the pair of the value and each other of the `paired` least."""
        paired = self.paired

        def run(batches):
            for batch in batches:
                found, count = [], []
                for value, raw in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    v = np.frombuffer(raw, np.uint64)[:paired].view(np.int64)
                    v = v[v != value]
                    found.append(np.minimum(v, value) * np.int64(_A) + np.maximum(v, value))
                    count.append(v.size)
                row = pa.array(np.repeat(np.arange(len(count)), count))
                values = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))
                yield pa.RecordBatch.from_arrays([values, batch.column(1).take(row), batch.column(2).take(row)], ["value", "digest", "outside"])

        return run

    def _prefixes(self):
        """Of texts: all values of which a linked set must share one, and the whole sets."""
        words, num, den = self.words, self.num, self.den

        def run(batches):
            shingle = Shingler(words)
            for batch in batches:
                sets = [shingle(raw or b"") for raw in batch.column(1).cast(pa.binary()).to_pylist()]
                least = [s[: s.size - -(-s.size * num // den) + 1].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(least, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "id", "size", "least", "values"])

        return run

    def _lists(self, sketched: DataFrame, column: str, scratch: Scratch) -> DataFrame:
        """(value, digest, blocks) for all lists of two classes and more. sketched: (digest, and column: their least values)."""
        listed = sketched.select("digest", column).mapInArrow(self._least(2**31 if self.exact else self.listed), "value long, digest binary")
        lengths = scratch.save(listed.groupBy("value").agg(F.count("*").alias("length")).filter("length > 1"), "lengths")
        return scratch.save(listed.join(lengths, "value").select("value", "digest", self._blocks()), "entries")

    def _blocks(self) -> Column:
        return F.ceil(F.col("length") / F.lit(self.list_block)).alias("blocks")

    def _pairs(self, outside: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
        """Entries by pairs of values, of all that are outside in long lists and of those that may be linked with them.

        Of two linked classes that no edge connects yet, one at least is outside in each list that both are in.
        """
        has = outside.join(classes.select("digest", "id", "sketch"), "id").select("value", "digest", "outside", "sketch")
        pair = has.mapInArrow(self._paired_with(), "value long, digest binary, outside boolean")
        pair = scratch.save(pair.groupBy("value", "digest").agg(F.max("outside").alias("outside")), "pairs")
        lengths = pair.groupBy("value").agg(F.count("*").alias("length"), F.max("outside").alias("any")).filter("length > 1 and any")
        return scratch.save(pair.join(lengths.drop("any"), "value").select("value", "digest", self._blocks()), "paired")

    def components(self, docs: DataFrame) -> DataFrame:
        """Per row of docs: id, n_shingles, component_id, kept."""
        spark = docs.sparkSession
        scratch = Scratch(spark, "near")
        text = docs[self.text_col].cast("string")
        # ids may repeat with other texts, so a row is known by its id and the hash of its text
        rows = docs.select(docs[self.id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
        sketched = scratch.save(rows.mapInArrow(self._sketches(), "id long, hash long, n long, digest binary, sketch binary"), "sketches")
        filled = sketched.filter("n > 0 and id is not null")
        classes = filled.groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        classes = scratch.save(classes.select("digest", "row.id", "row.hash", "n", "sketch"), "classes")
        links = self._exact_links(rows, classes, scratch) if self.exact else self._links(rows, classes, scratch)
        named = filled.select("id", "digest").join(classes.select("digest", F.col("id").alias("of")), "digest")
        found = connected(links.unionByName(self._shared_ids(named)), scratch, "found")

        of = classes.select("digest", F.col("id").alias("node")).join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
        out = sketched.select("id", "n", "digest").join(of, "digest", "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
        component = F.when(F.col("id").isNotNull(), component)
        return out.select(
            F.col("id").cast(docs.schema[self.id_col].dataType).alias(self.id_col),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )

    def _exact_links(self, rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
        whole = rows.join(classes.select("digest", "id", "hash", F.col("n").alias("size")), ["id", "hash"]).dropDuplicates(["digest"]).select("digest", "text", "id", "size")
        whole = scratch.save(whole.mapInArrow(self._prefixes(), "digest binary, id long, size long, least binary, values binary"), "whole")
        entries = self._lists(whole, "least", scratch)
        return edges_of(entries, lambda e: e.join(whole.drop("least"), "digest").drop("digest"), "value", self.list_block, _groups(_exact, self.k, self.num, self.den), scratch, "links")

    def _links(self, rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
        entries = self._lists(classes, "sketch", scratch)
        sketches = classes.select("digest", "id", F.col("n").alias("size"), F.col("sketch").alias("values"))
        test = _groups(_estimated, self.k, self.num, self.den)

        def filled(e: DataFrame) -> DataFrame:
            # of long lists alone, few sketches are needed, and only these are shuffled
            return e.join(sketches if e is entries else _only(sketches, e.select("digest").distinct()), "digest").drop("digest")

        likely = hub_edges(entries, filled, "value", self.list_block, test, scratch, "likely")
        long = entries.filter("blocks > 1")
        if not long.isEmpty():
            outside = scratch.save(outside_of(long.join(classes.select("digest", "id"), "digest"), likely, "value", scratch, "likely"), "outside")
            few, many = (outside.filter(F.col("rest") <= FEW * self.list_block), outside.filter(F.col("rest") > FEW * self.list_block))
            if not few.isEmpty():
                likely = likely.unionByName(met_edges(filled(long), few, "value", self.list_block, test, scratch, "likely"))
            if not many.isEmpty():
                likely = likely.unionByName(edges_of(self._pairs(many, classes, scratch), filled, "value", self.list_block, test, scratch, "paired-of"))
        families = connected(likely, scratch, "families")

        # whole sets, once for each class of a family; blocks are bounded by members and by shingles
        members = families.select(F.col("node").alias("id"), F.col("component").alias("family")).join(classes.select("id", "hash", F.col("n").alias("size")), "id")
        bounds = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / F.lit(self.block), F.sum("size") / F.lit(1_000_000.0))).alias("blocks"))
        members = scratch.save(members.join(bounds, "family").select("id", "hash", "family", "blocks", "size"), "members")
        full = _only(rows, members.select("id", "hash")).join(members, ["id", "hash"]).dropDuplicates(["id", "hash"]).select("id", "text", "family", "blocks", "size")
        full = scratch.save(full.mapInArrow(self._sets(), "id long, family long, blocks long, size long, values binary"), "full")
        return edges_of(full, lambda e: e, "family", self.block, _groups(_exact, self.k, self.num, self.den), scratch, "links")

    @staticmethod
    def _shared_ids(named: DataFrame) -> DataFrame:
        """Edges between all classes that rows of one id are in, as such rows are one document. named: (id, of: least id of its class)."""
        several = named.groupBy("id").agg(F.min("of").alias("a"), F.max("of").alias("last")).filter("a <> last")
        return named.join(several, "id").select("a", F.col("of").alias("b"))

    def keep_one(self, docs: DataFrame) -> DataFrame:
        """docs without all but one document of each component; of rows that share an id one stays."""
        marked = self.components(docs).filter("kept").select(F.col(self.id_col).alias("_kept_id")).filter("_kept_id is not null").distinct()
        row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[self.id_col].alias("_kept_id"))
        known = row.join(marked, "_kept_id", "left_semi").dropDuplicates(["_kept_id"])
        return known.unionByName(row.filter("_kept_id is null")).select("row.*")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDedup(words=3, num=85, den=100).components(table(spark, sf_dir, "documents"))
