"""Token ids in Arrow stream files of equal-length sequences.

A shard holds the ids of a run of documents in ascending doc_id order, cut into sequences of a fixed
length: record batches with a fixed-size-list column of ids and one of masks (False where the last
sequence is padded). All batches but the last hold the same number of sequences and take the same
number of bytes, so any sequence is found by arithmetic: in place in a mapped file, or by reading one
batch of a remote one. A second stream file beside it says where each document starts. The manifest, a
Parquet table, names the files that count: a task that runs twice leaves an extra file that no
manifest row names.

Files are opened through pyarrow's file systems by a URI that the driver has resolved as Spark's own
writers would (file, hdfs, viewfs, s3, gs, abfs); of any other scheme the driver says so at once.

Null text is empty and holds only the end id. Rows of equal doc_id follow each other, ordered by a
hash of their text; a null doc_id comes first. So that rows without an id, or of one id, are dealt
like others, shards are ranges of (doc_id, hash). A long text is encoded whole, in memory. An empty
table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .scratch import Scratch, qualified, spans, table, width

CACHE_ENTRIES = 600_000
CHUNK_BYTES = 4 << 20
SEQUENCES = 64
#: Bytes of a source file, compressed, for one shard at most.
SHARD_BYTES = 64 << 20


class _Pieces(dict):
    """Ids of pre-tokens as bytes, filled by the library's model as they are asked for."""

    def __init__(self, vocabulary: str, dtype: np.dtype):
        self.model, self.kind = pretokens.library(vocabulary).model, "H" if dtype.itemsize == 2 else "I"
        self.letter = pretokens.byte_letters().__getitem__

    def __missing__(self, piece: str) -> bytes:
        found = self.model.tokenize("".join(map(self.letter, piece.encode())))
        self[piece] = ids = array(self.kind, [t.id for t in found]).tobytes()
        return ids


class Encoder:
    """Ids as the tokenizers library gives them; each distinct pre-token is encoded once."""

    def __init__(self, vocabulary: str, dtype: np.dtype):
        self.vocabulary, self.dtype = vocabulary, dtype
        self.known = _Pieces(vocabulary, dtype)

    def _whole(self, text: str) -> bytes:
        coded = pretokens.library(self.vocabulary).encode(text, add_special_tokens=False)
        return np.array(coded.ids, self.dtype).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        marks, _ = pretokens.specials(self.vocabulary)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        ids, out = self.known.__getitem__, []
        for text in texts:
            if pretokens.UNSAFE.search(text) or (marks is not None and marks.search(text)):
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(ids, pretokens.PIECE.findall(text))))
        return out


@cache
def id_type(vocabulary: str) -> np.dtype:
    """The smallest unsigned type that holds every id."""
    return np.dtype("<u2") if pretokens.library(vocabulary).get_vocab_size() <= 1 << 16 else np.dtype("<u4")


#: Spark's names of schemes that pyarrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "file": "file"}


def reachable(uri: str) -> str:
    """A qualified URI as pyarrow takes it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme not in SCHEMES:
        raise ValueError(f"token files can't be written to {uri}: pyarrow has no file system for it")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES[scheme]}:{rest}"


def filesystem(uri: str):
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class ShardWriter:
    """Packs ids into sequences and writes them batch by batch; holds one batch at most."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.length, self.dtype, self.n = length, dtype, 0
        self.pending: list[bytes] = []
        self.waiting = 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        self.n += len(ids) // self.dtype.itemsize
        if self.waiting >= SEQUENCES * self.length * self.dtype.itemsize:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.pending), self.dtype)
        step = SEQUENCES * self.length
        full = flat.size // step * step
        for at in range(0, full, step):
            self._write(flat[at : at + step], step)
        rest = flat[full:]
        if last and rest.size:
            padded = np.zeros(-(-rest.size // self.length) * self.length, self.dtype)
            padded[: rest.size] = rest
            self._write(padded, rest.size)
            rest = rest[:0]
        self.pending, self.waiting = [rest.tobytes()], rest.nbytes

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(flat.size) < used
        cut = lambda x: pa.FixedSizeListArray.from_arrays(x, self.length)
        self.writer.write_batch(pa.RecordBatch.from_arrays([cut(pa.array(flat)), cut(pa.array(mask))], schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()


class ShardReader:
    """Random access to the sequences of one shard; a local file is mapped, of a remote one a batch is read and kept at a time."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self.size, self.at = self.source.size(), -1
        self.schema = pa.ipc.open_stream(self.source).schema
        self.source.seek(0)
        pa.ipc.read_message(self.source)
        self.first = self.source.tell()
        self.length = self.schema.field(0).type.list_size
        if self.first < self.size - 8:  # eight bytes end a stream
            pa.ipc.read_message(self.source)
            self.step = self.source.tell() - self.first
            self.n_batches = -(-(self.size - 8 - self.first) // self.step)
        else:
            self.n_batches = 0

    def batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.source.seek(self.first + i * self.step)
            self.held, self.at = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema), i
        return self.held

    @property
    def n_sequences(self) -> int:
        return (self.n_batches - 1) * SEQUENCES + self.batch(self.n_batches - 1).num_rows if self.n_batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        batch, row = self.batch(i // SEQUENCES), i % SEQUENCES
        return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the shard's stream; a view where they lie in one batch."""
        step, parts = SEQUENCES * self.length, []
        while n:
            at = start % step
            values = self.batch(start // step).column(0).flatten().to_numpy()[at : at + n]
            parts.append(values)
            start, n = start + values.size, n - values.size
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


MANIFEST = "shard int, ids_uri string, index_uri string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, base: str, vocabulary: str, end_id: int, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under base (a URI that all executors share); one manifest row per shard.

    One range shuffle by (id, hash of the text) brings the texts into order; each task streams its range
    into one file. The number of shards follows from the size of the source, as the plan knows it.
    """
    key_type = pa.int64()
    base = reachable(qualified(docs.sparkSession, base))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        dtype = id_type(vocabulary)
        encode = Encoder(vocabulary, dtype)
        end = np.array([end_id], dtype).tobytes()
        stem = f"{base}/{task.partitionId():06d}-{uuid.uuid4().hex[:8]}"
        system, path = filesystem(stem)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        index_schema = pa.schema([("doc_id", key_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        writer = index = sink = side = None
        n_docs = 0
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            keys = batch.column(0).to_pylist()
            for a, b in spans([len(t or b"") for t in raw], CHUNK_BYTES):
                if writer is None:
                    sink, side = system.open_output_stream(f"{path}.ids.arrows"), system.open_output_stream(f"{path}.index.arrows")
                    writer, index = ShardWriter(sink, dtype, length), pa.ipc.new_stream(side, index_schema)
                starts, sizes = [], []
                for ids in encode([(t or b"").decode("utf-8", "replace") for t in raw[a:b]]):
                    starts.append(writer.n)
                    writer.add(ids + end)
                    sizes.append(writer.n - starts[-1])
                index.write_batch(pa.RecordBatch.from_arrays([pa.array(keys[a:b], key_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=index_schema))
                n_docs += b - a
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            side.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([task.partitionId()], pa.int32()), "ids_uri": [f"{stem}.ids.arrows"], "index_uri": [f"{stem}.index.arrows"], "n_docs": [n_docs], "n_tokens": [writer.n]}
            )

    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # what has no known size counts as endless there
    n = max(width(docs.sparkSession), -(-size // SHARD_BYTES) if size < 1 << 60 else 0)
    parts = rows.repartitionByRange(n, "id", "hash").sortWithinPartitions("id", "hash").select("id", "text")
    return parts.mapInArrow(run, MANIFEST)


def with_offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's global offset. One row per shard file, so it fits the driver."""
    spark, at, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((*r, at))
        at += r.n_tokens
    schema = T._parse_datatype_string(MANIFEST).add("offset", "long")
    return spark.createDataFrame(rows, schema)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["ids_uri"])
                system, path = filesystem(row["index_uri"])
                with system.open_input_stream(path) as f:
                    for part in pa.ipc.open_stream(f):
                        start, size = part.column(1).to_numpy(), part.column(2).to_numpy()
                        crc = [zlib.crc32(shard.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0), pa.array(start + row["offset"]), part.column(2), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    n = max(1, width(manifest.sparkSession))
    return manifest.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, length: int = 1024) -> DataFrame:
    """Write docs as token files in the shared folder and return what the files hold per document."""
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = scratch.save(write_shards(docs, scratch.path("shards"), vocabulary, end_id, length), "manifest")
    return read_documents(with_offsets(manifest))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
