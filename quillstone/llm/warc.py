"""WARC archives whose records are single Zstandard frames with a dictionary trained on archived records.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, so it can be read by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import common

#: The skippable frame that the WARC-zstd format reserves for a dictionary (fixed value).
SKIPPABLE = 0x184D2A5D
#: Pages that train the dictionary (whole ones of smallest hash) and their characters in all, the dictionary's size, and the level.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 1024, 16_000_000, 65_536, 3
#: The date in the headers; no page has one of its own, and a rerun task must write the same bytes.
DATE = "1970-01-01T00:00:00Z"
#: Bytes of an archive that are read at a time.
PART = 65_536
#: Bytes of records, before compression, that end an archive; a task with more writes several.
ARCHIVE_BYTES = 256_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has no payload, but the full one's digest and length."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the content of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:n]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def records(archive: BinaryIO | pa.NativeFile) -> Iterator[bytes]:
    """The records of an archive, which is read from its beginning on, a part at a time."""
    head = archive.read(8)
    if int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame")
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(archive.read(int.from_bytes(head[4:], "little"))))
    rest = archive.read(PART)
    while rest:
        one, parts = expand.decompressobj(), []
        while not one.eof:
            if not rest:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else archive.read(PART)
        rest = rest or archive.read(PART)
        yield b"".join(parts)


def write(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive page_id, url, html; one row per archive: file, n_records.

    The payload is the html in UTF-8; a null one is empty. Of pages with equal payloads of at least `least` bytes,
    that with the largest page_id is the response, and the others revisit it; all others are responses. Rows that
    repeat this page_id are responses too; where all are null, all are responses. Other columns are ignored; an
    empty table gives no archive. A payload that many pages share is split over tasks, and an archive ends with the
    record that reaches `archive_bytes`.
    """
    spark = pages.sparkSession
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    # a page that is too small to be looked up has a key that no other's equals, so that these don't meet in one task
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "html").cast("string"))
    p = p.withColumn("size", F.octet_length("html")).withColumn("key", F.when(F.col("size") >= least, F.sha1(F.encode("html", "UTF-8"))).otherwise(alone))
    again = p.where(F.col("size") >= least).groupBy("key").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null")
    again, total = common.kept(again), p.count()
    p = common.join_spread(p, again, ["key"], "n", total, ["page_id", "url"], "left").withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("refers")), F.col("refers")))
    chosen = common.drawn(pages.select("page_id", "url", "html"), "page_id", "html", SAMPLE, SAMPLE_CHARS)
    samples = [record(x["page_id"], x["url"], y, hashlib.sha1(y).hexdigest(), None, False) for x in chosen for y in [x["html"].encode("utf-8", "surrogatepass")]]
    try:
        raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small to train on
        raw = b"".join(samples)[-DICTIONARY_BYTES:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, squeeze = TaskContext.get(), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        rest = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers")), strict=True))
        names, counts, following = [], [], next(rest, None)

        def archive() -> Iterator[bytes]:
            nonlocal following
            held = 0
            yield SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
            while following is not None and held < archive_bytes:
                page, url, html, refers = following
                payload = html.encode("utf-8", "surrogatepass")
                one = record(page, url, payload, hashlib.sha1(payload).hexdigest(), refers, refers is not None)
                held, counts[-1] = held + len(one), counts[-1] + 1
                yield squeeze.compress(one)
                following = next(rest, None)

        while following is not None:
            names.append(f"part-{task.partitionId():05d}-{len(names):05d}.warc.zst")
            counts.append(0)
            common.write_file(folder, names[-1], archive(), str(task.taskAttemptId()))
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "n_records": pa.array(counts, pa.int64())})

    return common.cut(p.select("page_id", "url", "html", "refers").mapInArrow(run, "file string, n_records bigint"))


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    files is what write() returned. A response's length and digest are taken from the payload that was read, and
    must be those in its header.
    """
    names = sorted(x[0] for x in files.select("file").where("n_records > 0").collect())
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def page(x: str | None) -> int | None:
        return int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None

    def one(raw: bytes) -> tuple:
        fields, content = parse(raw)
        size, digest, kind = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        if kind == "response" and (len(content), hashlib.sha1(content).hexdigest()) != (size, digest):
            raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest don't agree")
        return page(fields["WARC-Record-ID"]), size, digest, kind, page(fields.get("WARC-Refers-To")), content if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows, held = [], 0
                with common.open_stream(folder, names[k]) as archive:
                    for x in records(archive):
                        rows.append(one(x))
                        held += len(x)
                        if len(rows) == 500 or held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")
