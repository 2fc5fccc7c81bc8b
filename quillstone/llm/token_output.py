"""Token-ID output: documents as separately compressed id arrays that share one trained Zstandard dictionary.

A folder holds `dictionary.zdict` and shards `part-NNNNN.ids`. A shard is

    magic "QSIDS002" | frames, one per document | index, a record of fixed width per document | tail

A record holds doc_id, whether that is null, where the frame starts, and the number of ids; records are in the order of
the documents, so a doc_id is found by binary search in the file. The tail, of fixed width too, holds the dictionary's
SHA-256, bytes per id, documents, ids, where the index starts, and the magic. A short document is read by a few small
reads and one frame. Shards follow the bytes of the texts and the number of documents, and whoever reads a whole one
reads it frame by frame, and its index some records at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.tokens import encoder

MAGIC = b"QSIDS002"
RECORD = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("at", "<u8"), ("n", "<u8")])
TAIL = np.dtype([("dictionary", "V32"), ("width", "u1"), ("docs", "<u8"), ("tokens", "<u8"), ("index", "<u8"), ("magic", "V8")])
#: Records of an index that are read at a time.
SOME = 4096
#: Documents whose id arrays train the dictionary (whole ones of smallest hash) and their characters in all, its bytes, and the level. The dictionary changes sizes only, never contents.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 1024, 16_000_000, 65_536, 3
#: Bytes of text in a shard: at most so many on average, and where that makes fewer shards than the cluster has use for, not under the second.
SHARD_BYTES, LEAST_BYTES = 256_000_000, 4_000_000
#: Documents in a shard, on average: at most so many, whatever their bytes.
SHARD_DOCS = 1_000_000


def _pack(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _unpack(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def train(samples: list[bytes]) -> bytes:
    """A dictionary trained on serialized id arrays; samples too few or too small to train on serve as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode doc_id, text and write the shards in ascending order of doc_id; one row per shard: shard, n_docs, n_tokens.

    A null text is an empty one (only the end id). Null doc_ids come first. Repeated doc_ids and rows are kept, in
    order of their texts' hashes; even those of one doc_id are dealt to several shards. Other columns are ignored. An
    empty table gives shards without documents.
    """
    spark = df.sparkSession
    docs = df.select("doc_id", "text")
    if not shards:
        whole, cores = docs.agg(F.sum(F.octet_length("text").cast("bigint")).alias("size"), F.count("*").alias("n")).first(), spark.sparkContext.defaultParallelism
        size = whole["size"] or 0
        shards = max(1, -(-size // SHARD_BYTES), -(-whole["n"] // SHARD_DOCS), min(4 * cores, -(-size // LEAST_BYTES)))
    e = encoder(tokenizer)
    width = 2 if e.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    raw = train([_pack(x, width) for x in e.encode([x["text"] for x in common.drawn(docs, "doc_id", "text", SAMPLE, SAMPLE_CHARS)]) if x])
    common.write_file(folder, "dictionary.zdict", iter([raw]), "driver")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own = TaskContext.get(), encoder(tokenizer)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        index: list[np.ndarray] = []
        docs = tokens = 0

        def chunks() -> Iterator[bytes]:
            nonlocal docs, tokens
            at = len(MAGIC)
            yield MAGIC
            for batch in batches:
                some = np.zeros(batch.num_rows, RECORD)
                for i, (doc, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist(), grouped=True), strict=True)):
                    frame = squeeze.compress(_pack(ids + end, width))
                    some[i] = (doc or 0, doc is None, at, len(ids) // 4 + 1)
                    at += len(frame)
                    yield frame
                index.append(some)
                docs, tokens = docs + len(some), tokens + int(some["n"].sum())
            for some in index:
                yield some.tobytes()
            yield np.array([(hashlib.sha256(raw).digest(), width, docs, tokens, at, MAGIC)], TAIL).tobytes()

        k = task.partitionId()
        common.write_file(folder, f"part-{k:05d}.ids", chunks(), str(task.taskAttemptId()))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    order = [F.col("doc_id").asc_nulls_first(), "hash", "row"]
    numbered = docs.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return common.cut(ordered.mapInArrow(run, "shard int, n_docs bigint, n_tokens bigint"))


class _Shard:
    """An open shard: its tail, and records by position."""

    def __init__(self, folder: str, shard: int):
        self.file = common.open_file(folder, f"part-{shard:05d}.ids")
        size = self.file.size()
        head = self.file.read(len(MAGIC))
        self.file.seek(max(0, size - TAIL.itemsize))
        tail = self.file.read(TAIL.itemsize)
        if head != MAGIC or len(tail) < TAIL.itemsize or not tail.endswith(MAGIC):
            raise ValueError("not a whole shard")
        self.tail = np.frombuffer(tail, TAIL)[0]
        self.docs, self.width, self.index = (int(self.tail[x]) for x in ("docs", "width", "index"))

    def __enter__(self) -> _Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def check(self, dictionary: bytes) -> None:
        if hashlib.sha256(dictionary).digest() != self.tail["dictionary"].tobytes():
            raise ValueError("the dictionary isn't the one that this shard was written with")

    def records(self, first: int, n: int) -> np.ndarray:
        self.file.seek(self.index + first * RECORD.itemsize)
        return np.frombuffer(self.file.read(min(n, self.docs - first) * RECORD.itemsize), RECORD)

    def spans(self) -> Iterator[tuple[int | None, int, int]]:
        """doc_id, length of the frame, number of ids of each document; one record beyond each part tells where its last frame ends."""
        for first in range(0, self.docs, SOME):
            some = self.records(first, SOME + 1)
            ends = [*some["at"].tolist()[1:], self.index] if first + SOME >= self.docs else some["at"].tolist()[1:]
            for doc, null, at, end, n in zip(some["doc_id"].tolist(), some["null"].tolist(), some["at"].tolist(), ends, some["n"].tolist(), strict=False):
                yield None if null else doc, end - at, n

    def position(self, doc_id: int | None) -> int:
        """The first place of a doc_id, by binary search over the records, null before all others; KeyError without one."""
        key = lambda r: (not r["null"], int(r["doc_id"]))
        want, low, high = (doc_id is not None, doc_id or 0), 0, self.docs
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if key(self.records(mid, 1)[0]) < want else (low, mid)
        if low == self.docs or key(self.records(low, 1)[0]) != want:
            raise KeyError(doc_id)
        return low


def fetch(folder: str, shard: int, position: int) -> np.ndarray:
    """The ids of the document at a place of a shard: its record and its frame alone are read."""
    raw = common.read_file(folder, "dictionary.zdict")
    with _Shard(folder, shard) as f:
        f.check(raw)
        some = f.records(position, 2)
        at, end = int(some["at"][0]), int(some["at"][1]) if len(some) > 1 else f.index
        f.file.seek(at)
        plain = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress(f.file.read(end - at))
        return np.frombuffer(_unpack(plain, f.width), "<u4")


def find(folder: str, shard: int, doc_id: int | None) -> np.ndarray:
    """The ids of the first document with this doc_id in a shard; KeyError where it has none."""
    with _Shard(folder, shard) as f:
        position = f.position(doc_id)
    return fetch(folder, shard, position)


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (unsigned 32-bit, little-endian).

    shards is what write() returned. Its one row per file gives each file's first start.
    """
    sizes = dict(shards.select("shard", "n_tokens").collect())
    count = max(sizes, default=-1) + 1
    base = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(count)])]).tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                if k not in sizes:
                    continue
                name, dictionary, at = f"part-{k:05d}.ids", common.read_file(folder, "dictionary.zdict"), base[k]
                expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
                rows: list[tuple] = []
                held = 0
                with _Shard(folder, k) as about, common.open_stream(folder, name) as f:
                    about.check(dictionary)
                    f.read(len(MAGIC))
                    for doc, length, n in about.spans():
                        ids = _unpack(expand.decompress(f.read(length)), about.width)
                        if len(ids) != 4 * n:
                            raise ValueError(f"document {doc} has {len(ids) // 4} ids, its index says {n}")
                        rows.append((doc, at, n, zlib.crc32(ids), ids))
                        at, held = at + n, held + len(ids)
                        if len(rows) == 1000 or held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return spark.range(0, count, 1, max(1, count)).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
