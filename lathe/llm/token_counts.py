"""Token counts by rank-synchronous merging of ragged numpy arrays.

All distinct pre-tokens of a batch lie in one flat symbol array. In each round every sequence finds
its own lowest-rank adjacent pair, all sequences apply theirs at once, and the array shrinks; the
symbols that survive when no sequence has a mergeable pair are its tokens. A very long sequence has
far more rounds than the others, so it goes by itself, and a round looks up only the pairs it changed.

Null text counts as empty (0 bytes, 0 tokens); empty text has 0 tokens; rows are independent, so
repeated rows repeat their counts, and other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import pretokens
from .scratch import small_batches, spans, table

NEVER = np.int32(2**31 - 1)
CACHE_ENTRIES = 300_000
CHUNK_BYTES = 4 << 20
#: Bytes from which a pre-token is merged by itself.
LONG = 512


class RankMerger:
    """The merge table of a byte-level BPE vocabulary as sorted numpy columns."""

    def __init__(self, vocabulary: str):
        model = pretokens.description(vocabulary)["model"]
        ids = model["vocab"]
        self.of_byte = np.array([ids[c] for c in pretokens.byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made[order]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of neighbours."""
        key = a << 20 | b
        slot = np.minimum(np.searchsorted(self.key, key), self.key.size - 1)
        return np.where(self.key[slot] == key, self.rank[slot], NEVER), self.made[slot]

    def count_long(self, word: bytes) -> int:
        """The number of tokens of one pre-token."""
        symbol = self.of_byte[np.frombuffer(word, np.uint8)]
        rank, made = self._ranks(symbol[:-1], symbol[1:])
        while rank.size and (best := rank.min()) != NEVER:
            at = np.flatnonzero(rank == best)
            fresh = np.append(True, np.diff(at) != 1)
            at = at[(at - at[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
            symbol[at] = made[at]
            keep = np.ones(symbol.size, bool)
            keep[at + 1] = False
            symbol = symbol[keep]
            # the pair at i goes with the symbol at i; pairs that start or end at a merged symbol are new
            rank, made = rank[keep[:-1]], made[keep[:-1]]
            now = at - np.arange(at.size)
            rank, made = rank[: symbol.size - 1], made[: symbol.size - 1]
            new = np.unique(np.concatenate([now - 1, now]))
            new = new[(new >= 0) & (new < rank.size)]
            rank[new], made[new] = self._ranks(symbol[new], symbol[new + 1])
        return symbol.size

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            result = self._counts([w if len(w) <= LONG else b"" for w in words])
            result[long] = [self.count_long(words[i]) for i in long]
            return result
        return self._counts(words)

    def _counts(self, words: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        result = size.copy()
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        while symbol.size > 1:
            key = symbol[:-1] << 20 | symbol[1:]
            slot = np.minimum(np.searchsorted(self.key, key), self.key.size - 1)
            rank = np.where((self.key[slot] == key) & (owner[:-1] == owner[1:]), self.rank[slot], NEVER)
            rank = np.append(rank, NEVER)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, symbol.size))
            best = np.repeat(lowest, length)
            hit = (rank == best) & (rank != NEVER)
            # of overlapping hits (one symbol three times and more) the leftmost ones count
            at = np.flatnonzero(hit)
            if not at.size:
                result[owner[first]] = length
                break
            fresh = np.append(True, np.diff(at) != 1)
            begin = at[fresh][np.cumsum(fresh) - 1]
            at = at[(at - begin) % 2 == 0]
            symbol[at] = self.made[slot[at]]
            done = best == NEVER
            ended = lowest == NEVER
            result[owner[first[ended]]] = length[ended]
            keep = ~done
            keep[at + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        else:
            if symbol.size:
                result[owner] = 1
        return result


@cache
def _merger(vocabulary: str) -> RankMerger:
    return RankMerger(vocabulary)


class TokenCounter:
    """Counts of texts, with the counts of pre-tokens kept between batches up to a fixed number."""

    def __init__(self, vocabulary: str):
        self.vocabulary, self.known = vocabulary, {}

    def __call__(self, texts: list[str]) -> list[int]:
        marks, special = pretokens.specials(self.vocabulary)
        lists, extra = [], []
        for text in texts:
            if marks is not None and marks.search(text):
                parts = marks.split(text)
                lists.append([p for t in parts[::2] for p in pretokens.pieces(t, self.vocabulary)])
                extra.append(len(parts) // 2)
            else:
                lists.append(pretokens.pieces(text, self.vocabulary))
                extra.append(0)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = [w for w in set().union(*lists) if w not in self.known]
        if new:
            counts = _merger(self.vocabulary).counts([w.encode("utf-8", "surrogateescape") for w in new])
            self.known.update(zip(new, counts.tolist(), strict=True))
        count = self.known.__getitem__
        return [n + sum(map(count, words)) for words, n in zip(lists, extra, strict=True)]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, UTF-8 bytes, tokens, and whether the tokens exceed limit.

    vocabulary: a byte-level BPE file, by path or by the name of a public vocabulary file.
    Narrow: no shuffle, nothing kept but a bounded cache of pre-token counts in each worker.
    """
    small_batches(docs.sparkSession)
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = TokenCounter(vocabulary)
        for batch in batches:
            key = batch.column(0)
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            size = [len(t or b"") for t in raw]
            for a, b in spans(size, CHUNK_BYTES):
                tokens = counter([(t or b"").decode("utf-8", "replace") for t in raw[a:b]])
                yield pa.RecordBatch.from_arrays(
                    [key.slice(a, b - a), pa.array(size[a:b], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {ids}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1024)
