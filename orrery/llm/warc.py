"""Operator 3: WARC archives with a Zstandard dictionary in a leading skippable frame.

A dictionary is trained on about `SAMPLE_PAGES` records that a hash picks, of each
the first `SAMPLE_BYTES / SAMPLE_PAGES` bytes of its payload. Every archive starts
with a skippable frame that holds it; every record follows as a Zstandard
frame of its own, so one record can be read at its offset. Executors write
archives of about `ARCHIVE` bytes into a shared folder, each first under a
name of its own and then renamed to a name that its partition fixes: an attempt
repeated after a lost executor replaces the file by one with the same content.
Archives are read back with Spark's binary reader.

Of records with equal payloads of `LEAST_EQUAL` bytes or more, that with the
smallest page_id is a response and the others revisit it. Which payloads have
copies is found by digest, summed up before the shuffle; pages with a copy are
joined with the first id of their digest.

Cases: null html is an empty payload; null url an empty target; a page without
page_id is always a response and never revisited; repeated rows are separate
records (equal page_id and payload: the first by url stays the response only
by id, so all rows with the smallest id are responses); an empty table gives
no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, scratch_path, staged

# The magic number of the skippable frame; the least size of payloads that are compared.
SKIPPABLE = 0x184D2A5D
LEAST_EQUAL = 100
#: Bytes of an archive before the next begins; sample and size of the dictionary.
ARCHIVE, SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY = 8 << 20, 1_000, 8 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
_BLANK = b"\r\n"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the payload's size and digest only."""
    revisit = refers_to is not None
    seed = hashlib.sha256(f"{page_id}\n{url}\n{digest}".encode("utf-8", "surrogatepass")).digest()[:16]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=seed)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    body = b"" if revisit else payload
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _BLANK * 2 + body + _BLANK * 2


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and content of a record."""
    head, rest = data.split(_BLANK * 2, 1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != _BLANK * 2:
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A Zstandard dictionary; with too little to train on, empty."""
    samples = [s for s in samples if s]
    if len(samples) < 8 or sum(map(len, samples)) < 4 * size // 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, level=3, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


def header_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame: the dictionary, itself compressed."""
    held = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(held)) + held


def read_archive(data: bytes):
    """Records of an archive, in order: (offset, headers, content)."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]) if size else b""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for at, length in frames(data):
        yield at, *parse_record(reader.decompress(data[at : at + length]))


def frames(data: bytes):
    """(offset, size) of each frame after the first, by the frame headers alone."""
    size = struct.unpack_from("<I", data, 4)[0]
    at = 8 + size
    while at < len(data):
        start = at
        info = zstandard.get_frame_parameters(data[at : at + 18])
        at += zstandard.frame_header_size(data[at : at + 18])
        while True:
            block = int.from_bytes(data[at : at + 3], "little")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        at += 4 if info.has_checksum else 0
        yield start, at - start


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file under a name of its own, then rename it. The folder is a path or a URI of any store pyarrow knows."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """(page_id, url, html, ...) -> archives in the folder; returns (archive, records, bytes), written by one action."""
    spark = pages.sparkSession
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    picked = rows.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(1_000_003)) < min(1.0, 2 * SAMPLE_PAGES / max(rows.count(), 1)) * 1_000_003)
    head = SAMPLE_BYTES // SAMPLE_PAGES  # of long payloads only the beginning teaches the dictionary
    sample = [record_bytes(r["page_id"], r["url"], bytes(r["payload"]), r["digest"], None) for r in picked.select("page_id", "url", F.substring("payload", 1, head).alias("payload"), "digest").limit(SAMPLE_PAGES).collect()]
    dictionary = train_dictionary(sample)
    long_enough = (F.length("payload") >= LEAST_EQUAL) & F.col("page_id").isNotNull()
    equal = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Rows that need no partner get keys of their own, so that they don't meet in one task.
    alone = F.concat(F.lit("~"), F.xxhash64("page_id", "url", "digest").cast("string"))
    known = rows.withColumn("key", F.when(long_enough, F.col("digest")).otherwise(alone)).join(equal.select(F.col("digest").alias("key"), "first"), "key", "left")
    marked = known.select("page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))
    marked = marked.sortWithinPartitions("page_id", "url", "digest")  # so that every attempt writes the same files

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, number = task.partitionId() if task else 0, 0
        head, pack = header_frame(dictionary), _compressor(dictionary)
        held, size, n = [head], len(head), 0
        done = []

        def close():
            name = f"part-{part:06d}-{number:05d}.warc.zst"
            _put(folder, name, b"".join(held))
            done.append((name, n, size))

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frame = pack.compress(record_bytes(page_id, url, payload, digest, refers_to))
                if n and size + len(frame) > archive_bytes:
                    close()
                    number += 1
                    held, size, n = [head], len(head), 0
                held.append(frame)
                size += len(frame)
                n += 1
        if n:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "records", "bytes"])

    return staged(marked.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder: archive, offset, page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a revisit is null. Responses are checked against their digest and length.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    schema = T.StructType(
        [T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()),
         T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for offset, h, payload in read_archive(content):
                    digest, size = h["warc-payload-digest"].partition(":")[2], int(h["x-payload-length"])
                    response = h["warc-type"] == "response"
                    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path} at {offset}: payload differs from its digest")
                    page, first = h["x-page-id"], h.get("x-refers-to-page-id")
                    rows.append((path.rpartition("/")[2], offset, int(page) if page else None, h["warc-target-uri"], payload if response else None, size, digest, h["warc-type"], int(first) if first else None))
                    if len(rows) >= 500:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return files.mapInArrow(run, schema)


def _batch(rows, schema):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages and read them back: the records of the archives."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    index = write_archives(pages, folder)
    if index.limit(1).count() == 0:
        return spark.createDataFrame([], "archive string, offset long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d AND payload_bytes >= 100 AND page_id IS NOT NULL
"""


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """The whole pages table, written as archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
